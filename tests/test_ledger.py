import datetime as dt
from decimal import Decimal

import pytest

from chainloom.sources import ledger

TX = (
    "hash string, transaction_index bigint, block_timestamp timestamp, block_number bigint, block_hash string, from_address string, to_address string, value decimal(38,0), gas bigint, gas_price bigint, "
    "receipt_gas_used bigint, receipt_status bigint, input string, receipt_contract_address string, transaction_type bigint, ingested_at timestamp"
)
TRANSFERS = "transaction_hash string, log_index bigint, block_timestamp timestamp, block_number bigint, block_hash string, token_address string, from_address string, to_address string, value string, ingested_at timestamp"
TOKENS = "address string, symbol string, name string, decimals string"
ENTITIES = "address string, address_lower string, primary_label string, owner string, category string, concept_class string, aliases array<string>, confidence string"


def at(day, hour=0):
    return dt.datetime(2026, 6, day, hour)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("ledger"))

    def tx(h, day, to, status, value=1, made=None, late=0, n=0):
        return (h, n, at(day), day, f"B{day}", "0xAA", to, Decimal(value), 1, None, 5, status, "0x", made, None, at(day, late))

    rows = [tx("H1", 1, "0xBB", 1), tx("H1", 1, "0xBB", 1, late=5), tx("h2", 2, None, None, 0, "0xC0"), tx("h3", 2, "0xbb", 0, 10**30, n=1), tx("h4", 8, "0xbb", 1), tx("h5", 3, None, 1, 0, "0xC0")]
    spark.createDataFrame(rows, TX).write.parquet(f"{base}/eth_transactions.parquet")
    transfers = [("h1", i, at(1), 1, "b1", t, "0xaa", "0xbb", v, at(1)) for i, (t, v) in enumerate([("0xT1", "1500000"), ("0xT1", "x"), ("0xT2", "7"), ("0xT9", "5"), ("0xT1", "1" * 39), ("0xT3", "12"), ("0xT1", None)])]
    spark.createDataFrame(transfers + transfers[:1], TRANSFERS).write.parquet(f"{base}/token_transfers.parquet")
    tokens = [("0xT1", "ONE", "One", "6"), ("0xt2", "NFT", "Nft", "0"), ("0xt3", "BAD", "Bad", "77"), (None, "x", "x", "1")]
    spark.createDataFrame(tokens, TOKENS).write.parquet(f"{base}/amended_tokens.parquet")
    labels = [("0xBB", "0xbb", "B", "Owner", "exchange", "ExchangeAccount", ["b"], "high"), ("0xT1", "0xt1", "T", None, None, None, None, None)]
    spark.createDataFrame(labels, ENTITIES).write.parquet(f"{base}/entities.parquet")
    return base


@pytest.mark.parametrize("start, end", [(None, "2026-06-02"), ("2026-06-02", "2026-06-02"), ("2026-06-03", "2026-06-02"), ("2026-06-01", "2026-07-03")])
def test_bad_windows(start, end):
    with pytest.raises(ValueError):
        ledger.check_bounds(start, end)


def test_transactions(spark, folder):
    rows = {r["transaction_hash"]: r for r in ledger.transaction_facts(spark, folder, "2026-06-01", "2026-06-08").collect()}
    assert set(rows) == {"h1", "h2", "h3", "h5"}  # repeated rows once, the end bound is out
    assert rows["h2"]["is_success"] is None and rows["h3"]["is_success"] is False and rows["h2"]["to_address"] is None
    assert rows["h3"]["value_wei"] == 10**30 and rows["h1"]["from_address"] == "0xaa"


def test_blocks_and_contracts(spark, folder):
    blocks = {r["block_number"]: r for r in ledger.block_facts(spark, folder, "2026-06-01", "2026-06-08").collect()}
    assert blocks[2]["transaction_count"] == 2 and blocks[2]["gas_used"] == 10
    contracts = {r["address"]: r for r in ledger.contract_dimension(spark, folder, "2026-06-08").collect()}
    assert contracts["0xc0"]["block_number"] == 3  # the later deployment
    assert {r["address"] for r in ledger.contract_dimension(spark, folder, "2026-06-03").where("block_number = 2").collect()} == {"0xc0"}
    assert contracts["0xt1"]["is_erc20"] and contracts["0xt2"]["is_erc721"]


def test_transfers(spark, folder):
    rows = {r["log_index"]: r for r in ledger.token_transfer_facts(spark, folder, "2026-06-01", "2026-06-08").collect()}
    assert len(rows) == 7
    assert rows[0]["normalized_amount"] == Decimal("1.5") and rows[0]["value_cast_valid"]
    assert rows[1]["value_bignumeric"] is None and not rows[1]["value_cast_valid"] and rows[1]["value_raw"] == "x"
    assert rows[2]["normalized_amount"] is None and rows[2]["is_erc721"]
    assert rows[3]["token_symbol"] is None and rows[4]["value_bignumeric"] is None
    assert rows[5]["normalized_amount"] is None and rows[5]["token_decimals"] == 77
    assert rows[6]["value_raw"] is None and rows[6]["value_cast_valid"] is False


def test_labels_keep_cardinality(spark, folder):
    window = ("2026-06-01", "2026-06-30")
    assert ledger.labeled_transactions(spark, folder, *window).count() == ledger.transaction_facts(spark, folder, *window).count()
    row = ledger.labeled_token_transfers(spark, folder, *window).where("log_index = 0").first()
    assert (row["to_owner"], row["token_primary_label"], row["from_owner"]) == ("Owner", "T", None)


def test_filters_reach_the_scan(spark, folder):
    plan = ledger.transaction_facts(spark, folder, "2026-06-01", "2026-06-08").select("transaction_hash")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(block_timestamp" in plan and "value" not in plan.split("ReadSchema")[1]
