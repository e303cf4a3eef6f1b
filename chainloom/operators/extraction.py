"""Selecting the part of the ledger that is exported: labelled and sampled
transactions with their blocks, transfers and contracts.

Membership in the label set is a semi-join flag, so no row is multiplied; the
sample is a hash of the key and hence stable between runs.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.functions.text import hash_bucket
from chainloom.sources import ledger


def lagged_window(today: dt.date, lag: int = 2, days: int = 28) -> tuple[dt.date, dt.date]:
    """[today - lag - days, today - lag): late rows have arrived by then."""
    end = today - dt.timedelta(days=lag)
    return end - dt.timedelta(days=days), end


def selected_transactions(spark: SparkSession, folder: str, start, end, sample: int = 1) -> DataFrame:
    """Facts with ``tier``: ``labelled`` (an end is a labelled address) or
    ``sample`` (``sample`` percent of the rest)."""
    facts = ledger.transaction_facts(spark, folder, start, end)
    labels = ledger.entity_labels(spark, folder).select(F.col("address").alias("labelled_address"), F.lit(True).alias("known"))
    side = lambda c: labels.withColumnRenamed("labelled_address", f"{c}_address").withColumnRenamed("known", f"{c}_known")
    marked = facts.join(side("from"), "from_address", "left").join(side("to"), "to_address", "left")
    tier = F.when(F.coalesce("from_known", "to_known"), "labelled").when(hash_bucket(F.col("transaction_hash")) < sample, "sample")
    return marked.withColumn("tier", tier).where("tier is not null").drop("from_known", "to_known")


def selected_blocks(spark: SparkSession, folder: str, start, end) -> DataFrame:
    keys = selected_transactions(spark, folder, start, end).select("block_number", "block_hash")
    return ledger.block_facts(spark, folder, start, end).join(keys, ["block_number", "block_hash"], "left_semi")


def selected_transfers(spark: SparkSession, folder: str, start, end) -> DataFrame:
    keys = selected_transactions(spark, folder, start, end).select("transaction_hash")
    return ledger.token_transfer_facts(spark, folder, start, end).join(keys, "transaction_hash", "left_semi")


def selected_contracts(spark: SparkSession, folder: str, end) -> DataFrame:
    """Contracts that are labelled."""
    return ledger.contract_dimension(spark, folder, end).join(ledger.entity_labels(spark, folder).select("address"), "address", "left_semi")


def batch_lookup(facts: DataFrame, keys: list[str], column: str = "transaction_hash") -> DataFrame:
    """Many point lookups as one scan; the given keys are literals of the plan."""
    return facts.where(F.col(column).isin(sorted({k.lower() for k in keys if k})))


def latest_between_pairs(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Input pairs (group_id, account_a, account_b); the latest transaction in
    either direction of each.  Both sides meet on (lesser, greater) end, an equi-join
    instead of an OR over both directions."""
    low, high = F.least("from_address", "to_address"), F.greatest("from_address", "to_address")
    left = facts.where("to_address is not null").withColumns({"low": low, "high": high})
    right = pairs.where("account_a is not null and account_b is not null").select(
        "group_id", F.least(F.lower("account_a"), F.lower("account_b")).alias("low"), F.greatest(F.lower("account_a"), F.lower("account_b")).alias("high")
    )
    best = F.max_by(F.struct("transaction_hash", "block_timestamp", "from_address", "to_address", "value_wei"), F.struct("block_timestamp", "transaction_hash"))
    return left.join(right, ["low", "high"]).groupBy("group_id").agg(best.alias("t")).select("group_id", "t.*")


def bound_query(spark: SparkSession, sql: str, start: dt.date, end: dt.date) -> DataFrame:
    """A statement with the typed parameters ``:start_date`` and ``:end_date``."""
    first, last = ledger.check_bounds(start, end)
    return spark.sql(sql, args={"start_date": first, "end_date": last})


def day_sample(spark: SparkSession, folder: str, day: dt.date | str, rows: int = 100) -> DataFrame:
    """The first transactions of one day by hash: a small extract for a trial."""
    first = day if isinstance(day, dt.date) else dt.date.fromisoformat(day)
    return ledger.transaction_facts(spark, folder, first, first + dt.timedelta(days=1)).orderBy("transaction_hash").limit(rows)
