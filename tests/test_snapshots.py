import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainloom.sources import snapshots


@pytest.fixture()
def labels(spark):
    return spark.createDataFrame([("0x1", 1, "operational", "high", ["a", "b"]), ("0x2", 1, "treasury", None, None)], "address string, chain_id bigint, address_role string, confidence string, aliases array<string>")


def test_snapshot_is_written_once(spark, labels, tmp_path):
    path, state = snapshots.load_snapshot(labels, str(tmp_path), "labels")
    assert state == "loaded"
    assert snapshots.load_snapshot(labels.repartition(3), str(tmp_path), "labels") == (path, "reused")
    other, state = snapshots.load_snapshot(labels.limit(1), str(tmp_path), "labels")
    assert state == "loaded" and other != path
    snapshots.point_view(spark, "label_view", other)
    snapshots.point_view(spark, "label_view", path)
    assert spark.table("label_view").count() == 2
    assert snapshots.content_digest(labels.limit(0)) != snapshots.content_digest(labels)


def test_validation(labels):
    assert snapshots.validate_labels(labels).first()["passed"]
    assert not snapshots.validate_labels(labels.union(labels)).first()["passed"]


def test_schema_differences():
    wanted = T.StructType([T.StructField("a", T.LongType(), False), T.StructField("s", T.ArrayType(T.StructType([T.StructField("x", T.DateType())])))])
    found = T.StructType([T.StructField("a", T.LongType()), T.StructField("s", T.ArrayType(T.StructType([T.StructField("x", T.StringType())]))), T.StructField("more", T.LongType())])
    assert snapshots.schema_differences(found, wanted) == ["a: may be null", "s[].x: string instead of date"]
    assert snapshots.schema_differences(T.StructType([]), wanted)[0] == "a: missing"


def test_csv_round_trip(spark, tmp_path):
    schema = T.StructType([T.StructField("v", T.DecimalType(38, 0)), T.StructField("t", T.TimestampType()), T.StructField("a", T.ArrayType(T.StringType())), T.StructField("s", T.StringType())])
    df = spark.createDataFrame([(Decimal(10**37), dt.datetime(2026, 6, 1, 2, 3, 4, 5), ["x", "y"], 'quoted "a",\nb')], schema)
    snapshots.export_csv(df, str(tmp_path / "out"))
    assert snapshots.read_csv(spark, str(tmp_path / "out"), schema).collect() == df.collect()
    snapshots.export_csv(df.limit(0), str(tmp_path / "none"))
    assert snapshots.read_csv(spark, str(tmp_path / "none"), schema).count() == 0
    with pytest.raises(ValueError):
        snapshots.read_csv(spark, str(tmp_path / "out"), T.StructType([T.StructField("zz", T.StringType())]))


def test_manifest(labels):
    body = json.loads(snapshots.manifest({"labels": labels}, "2026-06-01", "2026-06-02"))
    assert body["tables"]["labels"]["rows"] == 2 and len(body["sha256"]) == 64


def test_chain(spark):
    frame = spark.createDataFrame([("j", 1, "a", ""), ("j", 2, "b", None), ("j", 3, "c", "zz")], "journal string, seq int, payload string, previous string")
    one = frame.where("seq = 1").withColumn("digest", F.sha2(F.concat_ws("|", F.lit(""), "payload"), 256))
    first = one.first()["digest"]
    two = frame.where("seq = 2").withColumn("previous", F.lit(first)).withColumn("digest", F.sha2(F.concat_ws("|", "previous", "payload"), 256))
    three = frame.where("seq = 3").withColumn("digest", F.sha2(F.concat_ws("|", "previous", "payload"), 256))
    assert [tuple(r) for r in snapshots.chain_breaks(one.unionByName(two).unionByName(three)).collect()] == [("j", 3)]


def test_questions_anywhere(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text('{"question": "a", "in": {"questions": ["b", null], "id": "no"}}\n{"question": null}\n')
    assert sorted(r["text"] for r in snapshots.question_texts(spark, str(path)).collect()) == ["a", "b"]
