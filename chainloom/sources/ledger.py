"""The analytical relations over the raw ledger tables.

Facts are bounded by ``[start, end)`` dates; the bounds are checked before any
plan is built and reach the scan as pushed filters.  Rows delivered more than
once count once, hashes and addresses are lower case.  Raw tables that a data
folder doesn't hold are derived: blocks by grouping transactions (the sender of
a block's first transaction stands for its beneficiary), contracts from creating
transactions and from the token list.

Defined results: a null recipient stays null (contract creation); a value that
is no number of at most 38 digits keeps its text and gets a null number;
``normalized_amount`` is null unless the token is ERC-20, not ERC-721 and has 0
to 38 decimals; empty tables give empty relations.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainloom.sources.tables import table

MOST_DAYS = 31
LABEL_COLUMNS = ("primary_label", "owner", "category", "concept_class", "address_role", "confidence")


def check_bounds(start: str | dt.date | None, end: str | dt.date | None, most_days: int = MOST_DAYS) -> tuple[dt.date, dt.date]:
    """Dates of a half-open window; raises for null, reversed and too long ones."""
    if start is None or end is None:
        raise ValueError("both bounds are needed")
    first, last = (d if isinstance(d, dt.date) else dt.date.fromisoformat(d) for d in (start, end))
    if not 0 < (last - first).days <= most_days:
        raise ValueError(f"the window [{first}, {last}) must span 1 to {most_days} days")
    return first, last


def _within(column: str, first: dt.date, last: dt.date) -> Column:
    return (F.col(column) >= F.lit(dt.datetime(*first.timetuple()[:3]))) & (F.col(column) < F.lit(dt.datetime(*last.timetuple()[:3])))


def transaction_facts(spark: SparkSession, folder: str, start, end) -> DataFrame:
    """16 columns, one row per transaction hash."""
    first, last = check_bounds(start, end)
    raw = table(spark, folder, "eth_transactions").where(_within("block_timestamp", first, last))
    low = F.lower
    return raw.select(
        low("hash").alias("transaction_hash"), F.col("transaction_index"), F.col("block_timestamp"), F.col("block_number"),
        low("block_hash").alias("block_hash"), low("from_address").alias("from_address"), low("to_address").alias("to_address"),
        F.col("value").alias("value_wei"), F.col("gas").alias("gas_limit"), F.col("gas_price").alias("gas_price_wei"), F.col("receipt_gas_used"),
        F.col("receipt_status"), (F.col("receipt_status") == 1).alias("is_success"), F.col("input"),
        low("receipt_contract_address").alias("receipt_contract_address"), F.col("transaction_type"),
    ).dropDuplicates(["transaction_hash"])


def block_facts(spark: SparkSession, folder: str, start, end) -> DataFrame:
    """7 columns, one row per block."""
    facts = transaction_facts(spark, folder, start, end)
    return facts.groupBy("block_number", "block_hash").agg(
        F.min("block_timestamp").alias("block_timestamp"),
        F.min(F.struct("transaction_index", "transaction_hash", "from_address"))["from_address"].alias("beneficiary_address"),
        F.sum("receipt_gas_used").alias("gas_used"),
        F.count("*").alias("transaction_count"),
        F.min("gas_price_wei").alias("base_fee_per_gas_wei"),
    )


def token_dimension(spark: SparkSession, folder: str) -> DataFrame:
    """address, symbol, name, decimals (null unless 1 to 3 digits); one row per address."""
    raw = table(spark, folder, "amended_tokens")
    digits = F.when(F.col("decimals").rlike("^[0-9]{1,3}$"), F.col("decimals")).cast("int")
    rows = raw.where("address is not null").select(F.lower("address").alias("address"), "symbol", "name", digits.alias("decimals"))
    return rows.groupBy("address").agg(F.min(F.struct("symbol", "name", "decimals")).alias("t")).select("address", "t.*")


def _contracts(spark: SparkSession, folder: str) -> DataFrame:
    """Raw contracts: created by a transaction, or listed as a token (dated before
    the ledger; ERC-721 with 0 decimals, ERC-20 with more)."""
    unknown = F.lit(None).cast("boolean")
    made = table(spark, folder, "eth_transactions").where("receipt_contract_address is not null").select(
        F.lower("receipt_contract_address").alias("address"), unknown.alias("is_erc20"), unknown.alias("is_erc721"),
        F.col("block_timestamp").alias("created_at"), "block_number", F.lower("block_hash").alias("block_hash"),
    )
    listed = token_dimension(spark, folder).select(
        "address", (F.col("decimals") > 0).alias("is_erc20"), (F.col("decimals") == 0).alias("is_erc721"),
        F.lit(dt.datetime(2015, 7, 30)).alias("created_at"), F.lit(0).cast("bigint").alias("block_number"), F.lit("0x").alias("block_hash"),
    )
    return made.unionByName(listed)


def contract_dimension(spark: SparkSession, folder: str, end) -> DataFrame:
    """6 columns, one row per address: its latest deployment before ``end``."""
    if end is None:
        raise ValueError("the end bound is needed")
    last = end if isinstance(end, dt.date) else dt.date.fromisoformat(end)
    raw = _contracts(spark, folder).where(F.col("created_at") < F.lit(dt.datetime(*last.timetuple()[:3])))
    order = Window.partitionBy("address").orderBy(F.desc("created_at"), F.desc("block_number"), F.desc("block_hash"))
    return raw.withColumn("at", F.row_number().over(order)).where("at = 1").drop("at")


def scaled_amount(value: Column, decimals: Column) -> Column:
    """Digits shifted by ``decimals`` as decimal(38, 18), cut after 18 places; null
    where more than 20 digits are left of the point.  Works on the text, hence
    exactly."""
    padded = F.when(F.length(value) <= decimals, F.concat(F.repeat(F.lit("0"), decimals - F.length(value) + 1), value)).otherwise(value)
    whole = F.substring(padded, F.lit(1), F.length(padded) - decimals)
    part = F.rpad(F.substring(padded, F.length(padded) - decimals + 1, F.lit(18)), 18, "0")
    return F.concat(whole, F.lit("."), part).try_cast("decimal(38,18)")


def token_transfer_facts(spark: SparkSession, folder: str, start, end) -> DataFrame:
    """17 columns, one row per (transaction_hash, log_index).

    Tokens and contracts are dimensions: the token list is joined as it is and
    Spark broadcasts it while its measured size allows.
    """
    first, last = check_bounds(start, end)
    low = F.lower
    raw = table(spark, folder, "token_transfers").where(_within("block_timestamp", first, last)).select(
        low("transaction_hash").alias("transaction_hash"), "log_index", "block_timestamp", "block_number", low("block_hash").alias("block_hash"),
        low("token_address").alias("token_address"), low("from_address").alias("from_address"), low("to_address").alias("to_address"), F.col("value").alias("value_raw"),
    ).dropDuplicates(["transaction_hash", "log_index"])
    tokens = token_dimension(spark, folder).select(F.col("address").alias("token_address"), F.col("symbol").alias("token_symbol"), F.col("name").alias("token_name"), F.col("decimals").alias("token_decimals"))
    contracts = contract_dimension(spark, folder, last).select(F.col("address").alias("token_address"), "is_erc20", "is_erc721")
    joined = raw.join(tokens, "token_address", "left").join(contracts, "token_address", "left")
    valid = F.col("value_raw").rlike("^[0-9]{1,38}$")
    countable = valid & F.expr("is_erc20 is true and is_erc721 is not true") & F.col("token_decimals").between(0, 38)
    return joined.select(
        "transaction_hash", "log_index", "block_timestamp", "block_number", "block_hash", "token_address", "from_address", "to_address", "value_raw",
        F.when(valid, F.col("value_raw")).try_cast("decimal(38,0)").alias("value_bignumeric"),
        F.coalesce(valid, F.lit(False)).alias("value_cast_valid"), "token_symbol", "token_name", "token_decimals", "is_erc20", "is_erc721",
        F.when(countable, scaled_amount(F.col("value_raw"), F.col("token_decimals"))).alias("normalized_amount"),
    )


def entity_labels(spark: SparkSession, folder: str) -> DataFrame:
    """12 columns, one row per labelled address."""
    raw = table(spark, folder, "entities").where("address_lower is not null")
    role = F.when(F.col("concept_class") == "TreasuryAccount", "treasury").otherwise("operational")
    source = "array<struct<name:string,url:string,revision:string,locator:string,retrieved_date:date,note:string>>"
    rows = raw.select(
        F.lower("address_lower").alias("address"), F.lit(1).cast("bigint").alias("chain_id"), "primary_label", "owner", "category", "concept_class",
        role.alias("address_role"), "aliases", "confidence", F.lit(None).cast("date").alias("verified_date"), F.array().cast(source).alias("sources"),
        F.sha2(F.concat_ws("|", "address_lower", "owner", "category"), 256).alias("dictionary_sha256"),
    )
    return rows.dropDuplicates(["address"])


def _with_labels(facts: DataFrame, labels: DataFrame, sides: tuple[str, ...]) -> DataFrame:
    """Left joins on ``<side>_address``; addresses are unique in labels, so no row
    is lost or multiplied."""
    for side in sides:
        own = labels.select(F.col("address").alias(f"{side}_address"), *[F.col(c).alias(f"{side}_{c}") for c in LABEL_COLUMNS])
        facts = facts.join(own, f"{side}_address", "left")
    return facts


def labeled_transactions(spark: SparkSession, folder: str, start, end) -> DataFrame:
    """transaction_facts with 6 label columns for each end."""
    return _with_labels(transaction_facts(spark, folder, start, end), entity_labels(spark, folder), ("from", "to"))


def labeled_token_transfers(spark: SparkSession, folder: str, start, end) -> DataFrame:
    """token_transfer_facts with 6 label columns for sender, recipient and token."""
    return _with_labels(token_transfer_facts(spark, folder, start, end), entity_labels(spark, folder), ("from", "to", "token"))


#: Name, builder and parameters of each relation, in order of dependence.
RELATIONS = (
    ("transaction_facts", transaction_facts, ("start", "end")), ("block_facts", block_facts, ("start", "end")),
    ("token_dimension", token_dimension, ()), ("contract_dimension", contract_dimension, ("end",)),
    ("token_transfer_facts", token_transfer_facts, ("start", "end")), ("entity_labels", entity_labels, ()),
    ("labeled_transactions", labeled_transactions, ("start", "end")), ("labeled_token_transfers", labeled_token_transfers, ("start", "end")),
)


def register(spark: SparkSession, folder: str, start, end, names: set[str] | None = None) -> None:
    """The relations as temporary views for a window."""
    given = {"start": start, "end": end}
    for name, build, wanted in RELATIONS:
        if names is None or name in names:
            build(spark, folder, *[given[w] for w in wanted]).createOrReplaceTempView(name)
