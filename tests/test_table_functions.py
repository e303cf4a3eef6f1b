import os

import pytest

from chainloom.sources import ledger, table_functions

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
WINDOW = ("2026-06-01", "2026-06-20")


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.fixture(scope="module")
def deployed(spark):
    return table_functions.deploy(spark, DATA)


@pytest.mark.parametrize("name", ["transaction_facts", "block_facts", "token_transfer_facts", "labeled_transactions", "labeled_token_transfers"])
def test_functions_equal_relations(spark, deployed, name):
    got = spark.sql(f"select * from {name}_tf(date '{WINDOW[0]}', date '{WINDOW[1]}')")
    want = getattr(ledger, name)(spark, DATA, *WINDOW)
    columns = [c for c in got.columns if c in want.columns]
    assert set(columns) == set(want.columns)
    assert rows(got.select(columns)) == rows(want.select(columns))


def test_dimension(spark, deployed):
    got = spark.sql("select * from contract_dimension_tf(date '2026-06-20')")
    assert rows(got) == rows(ledger.contract_dimension(spark, DATA, "2026-06-20").select(got.columns))


@pytest.mark.parametrize("bounds", ["date '2026-06-02', date '2026-06-02'", "date '2026-06-01', date '2026-08-01'", "null, date '2026-06-02'"])
def test_bad_windows_raise(spark, deployed, bounds):
    with pytest.raises(Exception, match="window|bound"):
        spark.sql(f"select count(transaction_hash), min(block_number) from transaction_facts_tf({bounds})").collect()
