"""The relations as SQL table functions: ``SELECT * FROM transaction_facts_tf(DATE
'2026-06-01', DATE '2026-06-08')``.

The bounds are arguments, so each call keeps its own window; null, reversed and
too long windows raise when the query runs.  The filter stands next to the scan
of the raw view and is pushed into it.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from chainloom.sources import ledger
from chainloom.sources.tables import table

# The guard is the lower bound itself, so it is evaluated before anything is filtered.
_START = """if(start_date is not null and end_date is not null and datediff(end_date, start_date) between 1 and {days},
    start_date, cast(raise_error('the window must span 1 to {days} days') as date))"""
_WINDOW = f"block_timestamp >= {_START} and block_timestamp < end_date"

# In order of dependence; raw_* and the two dimensions are temporary views.
FUNCTIONS = (
    ("transaction_facts_tf", "start_date date, end_date date", f"""
        select distinct lower(hash) as transaction_hash, transaction_index, block_timestamp, block_number, lower(block_hash) as block_hash, lower(from_address) as from_address,
          lower(to_address) as to_address, value as value_wei, gas as gas_limit, gas_price as gas_price_wei, receipt_gas_used, receipt_status, receipt_status = 1 as is_success,
          input, lower(receipt_contract_address) as receipt_contract_address, transaction_type
        from raw_transactions where {_WINDOW}"""),
    ("block_facts_tf", "start_date date, end_date date", """
        select block_number, block_hash, min(block_timestamp) as block_timestamp, min_by(from_address, transaction_index) as beneficiary_address,
          sum(receipt_gas_used) as gas_used, count(*) as transaction_count, min(gas_price_wei) as base_fee_per_gas_wei
        from transaction_facts_tf(start_date, end_date) group by block_number, block_hash"""),
    ("contract_dimension_tf", "end_date date", """
        select address, is_erc20, is_erc721, created_at, block_number, block_hash from (
          select *, row_number() over (partition by address order by created_at desc, block_number desc, block_hash desc) as place
          from raw_contracts where created_at < coalesce(end_date, cast(raise_error('the end bound is needed') as date))) where place = 1"""),
    ("token_transfer_facts_tf", "start_date date, end_date date", f"""
        select transaction_hash, log_index, block_timestamp, block_number, block_hash, token_address, from_address, to_address, value_raw,
          if(value_cast_valid, try_cast(value_raw as decimal(38,0)), null) as value_bignumeric, value_cast_valid, token_symbol, token_name, token_decimals, is_erc20, is_erc721,
          if(value_cast_valid and is_erc20 is true and is_erc721 is not true and token_decimals between 0 and 38, try_cast(concat(
            substring(padded, 1, length(padded) - token_decimals), '.', rpad(substring(padded, length(padded) - token_decimals + 1, 18), 18, '0')) as decimal(38,18)), null) as normalized_amount
        from (select f.*, t.symbol as token_symbol, t.name as token_name, t.decimals as token_decimals, c.is_erc20, c.is_erc721,
          if(length(value_raw) <= t.decimals, concat(repeat('0', t.decimals - length(value_raw) + 1), value_raw), value_raw) as padded
        from (select distinct lower(transaction_hash) as transaction_hash, log_index, block_timestamp, block_number, lower(block_hash) as block_hash,
                lower(token_address) as token_address, lower(from_address) as from_address, lower(to_address) as to_address, value as value_raw,
                coalesce(value rlike '^[0-9]{{{{1,38}}}}$', false) as value_cast_valid
              from raw_token_transfers where {_WINDOW}) f
        left join token_dimension t on f.token_address = t.address
        left join contract_dimension_tf(end_date) c on f.token_address = c.address)"""),
    ("labeled_transactions_tf", "start_date date, end_date date", """
        select f.*, {from_labels}, {to_labels}
        from transaction_facts_tf(start_date, end_date) f
        left join entity_labels a on f.from_address = a.address left join entity_labels b on f.to_address = b.address"""),
    ("labeled_token_transfers_tf", "start_date date, end_date date", """
        select f.*, {from_labels}, {to_labels}, {token_labels}
        from token_transfer_facts_tf(start_date, end_date) f left join entity_labels a on f.from_address = a.address
        left join entity_labels b on f.to_address = b.address left join entity_labels c on f.token_address = c.address"""),
)


def _labels(alias: str, side: str) -> str:
    """The six label columns of one side."""
    return ", ".join(f"{alias}.{c} as {side}_{c}" for c in ledger.LABEL_COLUMNS)


def deploy(spark: SparkSession, folder: str, days: int = ledger.MOST_DAYS) -> list[str]:
    """Creates views and functions in order of dependence; names of the functions."""
    table(spark, folder, "eth_transactions").createOrReplaceTempView("raw_transactions")
    table(spark, folder, "token_transfers").createOrReplaceTempView("raw_token_transfers")
    ledger._contracts(spark, folder).createOrReplaceTempView("raw_contracts")
    ledger.register(spark, folder, None, None, {"token_dimension", "entity_labels"})
    for name, arguments, body in FUNCTIONS:
        text = body.format(days=days, from_labels=_labels("a", "from"), to_labels=_labels("b", "to"), token_labels=_labels("c", "token"))
        spark.sql(f"create or replace temporary function {name}({arguments}) returns table return {text}")
    return [name for name, _, _ in FUNCTIONS]
