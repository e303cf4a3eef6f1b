"""Immutable label snapshots, exports and their manifests, schema conformance.

A snapshot lives at a path that holds its digest: equal content is written once
and found again, a view points at one snapshot and can be pointed back.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainloom.operators.evaluation import canonical_value, row_digests


def content_digest(df: DataFrame) -> str:
    """Digest of a table as a multiset of rows: order and partitioning don't count.

    Row digests are added up as numbers in 4 limbs of 64 bits, so only sums move.
    """
    limbs = [F.conv(F.substring("digest", 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = row_digests(df).agg(F.count("*").alias("n"), *[F.sum(x).cast("string").alias(f"s{i}") for i, x in enumerate(limbs)])
    names = "|".join(f"{c}:{t}" for c, t in df.dtypes)
    parts = [F.lit(names), F.col("n").cast("string"), *[F.coalesce(f"s{i}", F.lit("0")) for i in range(4)]]
    return sums.select(F.sha2(F.concat_ws("|", *parts), 256)).first()[0]


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def load_snapshot(df: DataFrame, base: str, name: str) -> tuple[str, str]:
    """(path, "loaded" or "reused"); a snapshot that is there is never changed.
    A write that broke off has no success mark and is done again."""
    spark = df.sparkSession
    path = f"{base}/{name}_{content_digest(df)[:12]}"
    if exists(spark, f"{path}/_SUCCESS"):
        return path, "reused"
    # Each writer has a folder of its own; renaming it into place succeeds for one of them only.
    own = f"{path}.{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(own)
    return path, "loaded" if _move(spark, own, path) else "reused"


def _move(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a folder unless the target is there whole; the source is removed then."""
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    system = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(b) and not exists(spark, f"{target}/_SUCCESS"):
        system.delete(b, True)  # a write that broke off
    if not system.exists(b) and system.rename(a, b):
        return True
    system.delete(a, True)
    return False


def point_view(spark: SparkSession, view: str, path: str) -> None:
    """Creates the view or points it at another (also an older) snapshot."""
    spark.read.parquet(path).createOrReplaceTempView(view)


def validate_labels(labels: DataFrame) -> DataFrame:
    """One row of counts that a snapshot must satisfy, with ``passed``."""
    return labels.agg(
        F.count("*").alias("rows"), F.count_distinct("address").alias("addresses"), F.count_if(F.col("chain_id") != 1).alias("other_chains"),
        F.count_if(~F.col("address_role").isin("operational", "token", "treasury")).alias("unknown_roles"),
        F.count_if(~F.col("confidence").isin("high", "medium", "low")).alias("unknown_confidence"),
    ).withColumn("passed", (F.col("rows") == F.col("addresses")) & (F.col("other_chains") == 0) & (F.col("unknown_roles") == 0) & (F.col("unknown_confidence") == 0))


def schema_differences(found: T.DataType, wanted: T.DataType, path: str = "") -> list[str]:
    """What ``found`` lacks or has otherwise, recursively; further fields are fine."""
    if isinstance(wanted, T.StructType):
        if not isinstance(found, T.StructType):
            return [f"{path or 'root'}: {found.simpleString()} instead of a struct"]
        have = {f.name: f for f in found.fields}
        out = []
        for field in wanted.fields:
            where = f"{path}.{field.name}" if path else field.name
            if field.name not in have:
                out.append(f"{where}: missing")
                continue
            out += schema_differences(have[field.name].dataType, field.dataType, where)
            if not field.nullable and have[field.name].nullable:
                out.append(f"{where}: may be null")
        return out
    if isinstance(wanted, T.ArrayType) and isinstance(found, T.ArrayType):
        return schema_differences(found.elementType, wanted.elementType, f"{path}[]")
    return [] if found == wanted else [f"{path}: {found.simpleString()} instead of {wanted.simpleString()}"]


def csv_columns(df: DataFrame) -> DataFrame:
    """Columns as text that loses nothing: decimals in full, timestamps in ISO form,
    arrays joined by ``|``, which is escaped inside of items; null items are left out."""

    def shown(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind.startswith("timestamp"):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        if kind.startswith("array<string"):  # a bar or backslash inside of an item is escaped
            return F.array_join(F.transform(c, lambda x: F.regexp_replace(x, r"([\\|])", r"\\$1")), "|")
        return c.cast("string")

    return df.select(*[shown(c, t).alias(c) for c, t in df.dtypes])


def export_csv(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """CSV files with headers; an empty table leaves one file with the header."""
    csv_columns(df).write.mode("overwrite").option("header", True).option("escape", '"').option("maxRecordsPerFile", rows_per_file).csv(path)


def read_csv(spark: SparkSession, path: str, wanted: T.StructType) -> DataFrame:
    """The exported columns with their types again; a missing column raises."""
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    missing = [f.name for f in wanted.fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}")

    def typed(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            items = F.regexp_extract_all(F.concat(c, F.lit("|")), F.lit(r"((?:[^\\|]|\\.)*+)\|"), F.lit(1))
            return F.when(c == "", F.array().cast(f.dataType)).otherwise(F.transform(items, lambda x: F.regexp_replace(x, r"\\(.)", "$1"))).alias(f.name)
        return c.try_cast(f.dataType).alias(f.name)

    return raw.select(*[typed(f) for f in wanted.fields])


def manifest(tables: dict[str, DataFrame], start: str, end: str) -> str:
    """Canonical JSON (sorted keys, no blanks) of an export: period, rows, digests;
    ``sha256`` covers the rest."""
    import hashlib

    body = {"period": [start, end], "tables": {n: {"rows": df.count(), "digest": content_digest(df), "columns": df.columns} for n, df in tables.items()}}
    text = json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    body["sha256"] = hashlib.sha256(text.encode()).hexdigest()
    return json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def chain_breaks(journal: DataFrame) -> DataFrame:
    """Input (journal, seq, payload, previous, digest); entries whose digest isn't
    SHA-256 of previous and payload, or whose previous isn't the entry before.
    Entries meet on (journal, seq), so no journal is ordered in one task."""
    before = journal.select("journal", (F.col("seq") + 1).alias("seq"), F.col("digest").alias("before"))
    own = F.sha2(F.concat_ws("|", F.coalesce("previous", F.lit("")), F.coalesce("payload", F.lit(""))), 256)
    joined = journal.join(before, ["journal", "seq"], "left")
    broken = ~F.col("digest").eqNullSafe(own) | ~F.coalesce("previous", F.lit("")).eqNullSafe(F.coalesce("before", F.lit("")))
    return joined.where(broken).select("journal", "seq")


def question_texts(spark: SparkSession, path: str, fields: tuple[str, ...] = ("question", "nl", "text")) -> DataFrame:
    """(text): the values of question fields anywhere in JSON lines, CSV or Parquet."""
    if path.endswith((".json", ".jsonl")):
        raw = spark.read.json(path)
    elif path.endswith(".csv"):
        raw = spark.read.option("header", True).csv(path)
    else:
        raw = spark.read.parquet(path)

    def found(prefix: str, kind: T.DataType) -> list:
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in found(f"{prefix}.`{f.name}`" if prefix else f"`{f.name}`", f.dataType)]
        name = prefix.rsplit("`", 2)[-2].lower() if prefix else ""
        if any(name.startswith(f) for f in fields):
            if isinstance(kind, T.StringType):
                return [F.array(F.col(prefix))]
            if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
                return [F.col(prefix)]
        return []

    columns = found("", raw.schema)
    if not columns:
        return spark.createDataFrame([], "text string")
    return raw.select(F.explode(F.flatten(F.array_compact(F.array(*columns)))).alias("text")).where("text is not null")
