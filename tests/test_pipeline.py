import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainloom.functions import text
from chainloom.operators import dataset, evaluation, extraction, linking, mentions
from chainloom.sources import snapshots
from test_operators import lexical_scores_of


def test_generated_and_expanded(spark):
    rows = dataset.generated_records(spark, {"a": 30, "b": 3, "c": 0}, "2026-06-01", "2026-06-20", 7, (5, 10))
    got = rows.orderBy("template_id", "position").collect()
    assert len(got) == 33 and len({r["id"] for r in got}) == 33 and {r["template_id"] for r in got} == {"a", "b"}
    assert got[0]["window_start"] == dt.date(2026, 6, 1) and all((r["window_end"] - r["window_start"]).days == 7 and r["window_end"] <= dt.date(2026, 6, 20) for r in got)
    assert [r["n"] for r in got[:30]] == [5] * 13 + [10] * 13 + [5] * 4
    patterns = spark.createDataFrame([("a", "en", "List {n} from {window_start}."), ("a", "vi", "Liệt kê {n}.")], "template_id string, language string, pattern string")
    out = dataset.expanded_questions(rows, patterns).collect()
    assert len(out) == 30 * 8 and len({r["id"] for r in out}) == 240 and all("{" not in r["question"] for r in out)
    diverse = dataset.wording_diversity(dataset.expanded_questions(rows.where("position = 0"), patterns)).collect()
    assert {(r["language"], r["pairs"]) for r in diverse} == {("en", 6), ("vi", 6)} and all(0 < r["diversity"] < 1 for r in diverse)


def test_limit_witnesses(spark):
    rows = [("k1", "SELECT a FROM t ORDER BY a LIMIT 20"), ("k2", "select a\nfrom t order by a limit 5;"), ("k3", "select a from t order by a limit 5"), ("k4", "select a from t order by a"), ("k5", "select b from t"), (None, "x"), ("k6", None)]
    got = {(r["base"], r["proof"]): (r["members"], r["witness"], r["least_n"]) for r in dataset.limit_witnesses(spark.createDataFrame(rows, "key string, sql string")).collect()}
    assert got == {("select a from t order by a", "limit_monotonic"): (3, "k2", 5), ("select a from t order by a", "exact"): (1, "k4", None), ("select b from t", "exact"): (1, "k5", None)}


def test_noise_keeps_its_gates(spark):
    rows = [(f"k{i}", f"Show the transactions of account 0x{'a' * 40} number {i} please") for i in range(200)] + [("n", None), (None, "x"), ("e", "")]
    frame = spark.createDataFrame(rows, "key string, text string")
    quotas = {"typo": 10, "abbreviation": 10, "fragment": 3, "mixed_case": 5}
    out = dataset.with_noise(frame, quotas, "s")
    got = out.collect()
    count = {k: sum(r["kind"] == k for r in got) for k in quotas}
    assert count == quotas and len({r["key"] for r in got}) == len(got) and all("0x" + "a" * 40 in r["noisy"] for r in got)
    assert all(r["invalid"] == 0 for r in dataset.noise_statistics(out).collect())
    assert sorted(map(tuple, got)) == sorted(map(tuple, dataset.with_noise(frame.repartition(5), quotas, "s").collect()))
    assert dataset.with_noise(frame.limit(0), quotas, "s").count() == 0


def test_snapshot_faults(spark):
    rows = [("a", "one two", "train"), ("a", "three", "train"), (None, "four", "test"), ("d", None, "train"), ("e", "Held OUT", "train"), ("f", "three", None)]
    r = dataset.snapshot_faults(spark.createDataFrame(rows, "key string, text string, split string"), spark.createDataFrame([("held out",), (None,)], "text string")).first()
    assert tuple(r) == (6, 1, 1, 1, 2, 1, False)
    clean = dataset.snapshot_faults(spark.createDataFrame(rows[:1], "key string, text string, split string"), spark.createDataFrame([], "text string")).first()
    assert clean["valid"] and clean["rows"] == 1


def test_dictionary(spark):
    raw = [("0xA", "Acme Ltd", "exchange", "Acme|  the  ACME "), ("0xb", "Other", "exchange", "acme|"), ("0xc", "Solo", None, None), (None, "x", "y", "z"), ("0xA", "Acme Ltd", "exchange", "Acme|  the  ACME ")]
    entities, concepts, aliases = dataset.build_dictionary(spark.createDataFrame(raw, "address string, owner string, category string, aliases string"))
    assert {r["address"]: r["names"] for r in entities.collect()} == {"0xa": ["acme", "acme ltd", "the acme"], "0xb": ["acme", "other"], "0xc": ["solo"]}
    assert [tuple(r) for r in concepts.collect()] == [("exchange", 2)]
    assert {tuple(r) for r in aliases.collect()} == {("acme ltd", "Acme Ltd"), ("the acme", "Acme Ltd"), ("other", "Other"), ("solo", "Solo")}


def test_catalogue_faults():
    good = {"sources": ["raw"], "relations": {"a": {"source": "raw", "fields": {"x": "STRING"}}, "b": {"source": "raw", "fields": {"y": "INTEGER"}}}, "joins": [{"left": "a", "right": "b", "keys": [["x", "y"]]}]}
    assert dataset.catalogue_faults(good) == []
    bad = {"sources": [], "relations": {"a": {"source": "raw", "fields": {"x": "FLOAT"}}, "c": {"source": "raw", "fields": {}}}, "joins": [{"left": "a", "right": "z", "keys": [["q", "r"]]}] * 2}
    faults = dataset.catalogue_faults(bad)
    assert any("unknown type" in f for f in faults) and any("unknown source" in f for f in faults) and any("no fields" in f for f in faults) and any("repeated" in f for f in faults)
    assert dataset.catalogue_faults({}) == ["relations: missing", "sources: missing", "joins: missing"]


@pytest.mark.parametrize("question", ["Which payments did the wallet send per day?", "Khối lượng token của sàn giao dịch", "blocks by validator", "nothing alike", "Sent BY whom? sent by me"])
def test_lexical_scores_against_brute_force(spark, question):
    frame = spark.createDataFrame([("k", question)], "key string, question string")
    got = {s["relation"]: s["lexical"] for s in linking.lexical_scores(frame).first()["scores"]}
    assert got == pytest.approx(lexical_scores_of(question), abs=1e-8)
    best = linking.link_schema(frame, 8, mentions.hashed_vector).collect()
    fused = {n: 0.5 * v + 0.5 * float(mentions.hashed_vector(question.lower()) @ mentions.hashed_vector(linking.SCHEMA_DOCUMENTS[n])) for n, v in lexical_scores_of(question).items()}
    assert [r["relation"] for r in sorted(best, key=lambda r: r["place"])] == sorted(fused, key=lambda n: (-round(fused[n], 6), n))


def test_paired_delta_and_intervals(spark):
    rng = random.Random(2)
    rows = [(f"c{i}", b, rng.random() < (0.7 if b == "b1" else 0.5)) for i in range(300) for b in ("b1", "b2")]
    r = evaluation.paired_delta(spark.createDataFrame(rows, "case_id string, baseline string, matched boolean"), "b1", "b2", 2000).first()
    a = {c: m for c, b, m in rows if b == "b1"}
    d = [a[c] - m for c, b, m in rows if b == "b2"]
    assert r["cases"] == 300 and abs(r["delta"] - sum(d) / 300) < 1e-12 and r["low"] < r["delta"] < r["high"]
    error = (sum(x * x for x in d) / 300 - (sum(d) / 300) ** 2) ** 0.5 / 300**0.5
    assert abs((r["high"] - r["low"]) / (2 * 1.96 * error) - 1) < 0.1
    lat = spark.createDataFrame([("b", float(i % 100)) for i in range(1000)] + [("b", None), ("c", 5.0)], "baseline string, latency_ms double")
    got = {(x["baseline"], x["name"]): (x["low"], x["high"]) for x in evaluation.latency_intervals(lat, 200).collect()}
    assert got["c", "p50"] == (5.0, 5.0) and got["b", "p50"][0] <= 50 <= got["b", "p50"][1] and got["b", "p99"][1] <= 99
    assert evaluation.paired_delta(spark.createDataFrame([], "case_id string, baseline string, matched boolean"), "b1", "b2").first()["cases"] == 0


def test_matches_are_structural(spark):
    gold = "SELECT a AS b FROM `t` WHERE c = 'X' LIMIT 5"
    cases = spark.createDataFrame([("c", gold, "en")], "case_id string, gold_sql string, language string")
    said = [gold, f"Here:\n```sql\n{gold};\n```\nDone.", f"This is it. {gold.lower().replace(chr(39) + 'x', chr(39) + 'X')}", gold + " -- and more", gold.replace("'X'", "'x'"), f"{gold} UNION ALL {gold}", None, "42"]
    frame = spark.createDataFrame([(i, "r", "b", "c", t) for i, t in enumerate(said)], "prediction_id int, run_id string, baseline string, case_id string, prediction string")
    assert {r["prediction_id"] for r in evaluation.exact_matches(frame, cases).where("matched").collect()} == {0, 1, 2}


def test_addresses_stand_alone(spark):
    rows = [("0x" + "a" * 40 + ", 0X" + "B" * 40 + "; 0x" + "c" * 64 + " x0x" + "d" * 40,)]
    assert spark.createDataFrame(rows, "t string").select(text.addresses_in(F.col("t"))).first()[0] == ["0x" + "a" * 40, "0x" + "b" * 40]


def test_url_quoting(spark):
    from urllib.parse import quote

    rows = [("A b&c/d~e_f.g-h*i",), ("Đường 中",), ("",)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(text.url_quoted(F.col("t"))).collect()] == [quote(t, safe="") for (t,) in rows]


def test_arrays_in_csv_round_trip(spark, tmp_path):
    rows = [("a", ["x|y", "back\\slash", "", 'q"uote']), ("b", []), ("c", ["|", "\\|"])]
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.ArrayType(T.StringType()))])
    snapshots.export_csv(spark.createDataFrame(rows, schema), str(tmp_path / "out"))
    assert sorted((r["k"], list(r["v"] or [])) for r in snapshots.read_csv(spark, str(tmp_path / "out"), schema).collect()) == rows


def test_two_writers_of_a_snapshot(spark, tmp_path):
    frame = spark.range(5).toDF("n")
    path, how = snapshots.load_snapshot(frame, str(tmp_path), "s")
    assert how == "loaded" and snapshots.load_snapshot(frame, str(tmp_path), "s") == (path, "reused")
    spark.range(5).write.parquet(str(tmp_path / "mine"))
    assert snapshots._move(spark, str(tmp_path / "mine"), path) is False and spark.read.parquet(path).count() == 5
    assert len(list(tmp_path.iterdir())) == 1


def test_bound_query(spark):
    spark.createDataFrame([(dt.date(2026, 6, d),) for d in range(1, 11)], "d date").createOrReplaceTempView("days_of_june")
    sql = "select count(*) as n from days_of_june where d >= :start_date and d < :end_date"
    assert extraction.bound_query(spark, sql, dt.date(2026, 6, 2), dt.date(2026, 6, 5)).first()["n"] == 3
    with pytest.raises(ValueError):
        extraction.bound_query(spark, sql, dt.date(2026, 6, 5), dt.date(2026, 6, 2))
