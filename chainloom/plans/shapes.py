"""Analytical queries over the relations, in the common subset of both engines.

Each entry is one reviewed shape (g..), template (t..), competency question
(c..) or contract check (b..) of the survey.  Spark runs the text over temporary
views of the relations; the same text with the relations written out as common
table expressions is the independent check.  Every top-k has a full tie-break.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chainloom.plans.reference_sql import mentioned, with_relations
from chainloom.sources import ledger

START, END = "2026-06-01", "2026-07-01"
ETH = "1000000000000000000"

DAY = "cast(block_timestamp as date)"
STANDARD = "case when is_erc721 is true then 'erc721' when is_erc20 is true then 'erc20' else 'other_or_unknown' end"
SHOWN = "transaction_hash, cast(block_timestamp as string) as at, from_address, to_address, value_wei"

GOLD = {
    "g01_transaction_count": "select count(*) as transaction_count from transaction_facts",
    "g02_successful_count": "select count_if(is_success is true) as successful_transaction_count from transaction_facts",
    "g03_failed_count": "select count_if(is_success is false) as failed_transaction_count from transaction_facts",
    "g04_total_value": "select coalesce(sum(value_wei), 0) as total_value_wei from transaction_facts",
    "g05_block_count": "select count(*) as block_count from block_facts",
    "g06_average_per_block": "select avg(cast(transaction_count as double)) as average_transactions_per_block from block_facts",
    "g07_transfer_count": "select count(*) as token_transfer_count from token_transfer_facts",
    "g08_normalized_count": "select count_if(normalized_amount is not null) as normalized_transfer_count from token_transfer_facts",
    "g09_daily_transactions": f"select {DAY} as activity_date, count(*) as transaction_count from transaction_facts group by {DAY} order by activity_date",
    "g10_daily_outcomes": f"""select {DAY} as activity_date, count_if(is_success is true) as successful_count, count_if(is_success is false) as failed_count
        from transaction_facts group by {DAY} order by activity_date""",
    "g11_daily_gas": f"""select {DAY} as activity_date, avg(cast(gas_price_wei as double)) as average_gas_price_wei,
        avg(cast(receipt_gas_used as double)) as average_receipt_gas_used from transaction_facts group by {DAY} order by activity_date""",
    "g12_top_beneficiaries": """select beneficiary_address, count(*) as block_count from block_facts where beneficiary_address is not null
        group by beneficiary_address order by block_count desc, beneficiary_address limit 10""",
    "g13_daily_blocks": f"""select {DAY} as activity_date, count(*) as block_count, sum(gas_used) as total_gas_used, sum(transaction_count) as total_transaction_count
        from block_facts group by {DAY} order by activity_date""",
    "g14_top_tokens": """select token_address, count(*) as transfer_count from token_transfer_facts group by token_address
        order by transfer_count desc, token_address limit 10""",
    "g15_token_volume": """select token_symbol, sum(cast(normalized_amount as decimal(38,9))) as total_normalized_amount from token_transfer_facts
        where normalized_amount is not null and token_symbol is not null group by token_symbol order by total_normalized_amount desc, token_symbol limit 10""",
    "g16_token_standards": f"select {STANDARD} as token_standard, count(*) as transfer_count from token_transfer_facts group by {STANDARD} order by token_standard",
    "g17_top_transfer_senders": """select from_address as sender_address, count(*) as transfer_count from token_transfer_facts where from_address is not null
        group by from_address order by transfer_count desc, sender_address limit 10""",
    "g18_top_transfer_recipients": """select to_address as recipient_address, count(*) as transfer_count from token_transfer_facts where to_address is not null
        group by to_address order by transfer_count desc, recipient_address limit 10""",
    "g19_transaction_types": """select transaction_type, count(*) as transaction_count from transaction_facts group by transaction_type
        order by transaction_count desc, transaction_type nulls first""",
    "g20_created_contracts": """select receipt_contract_address as created_contract_address, value_wei as transaction_value_wei from transaction_facts
        where receipt_contract_address is not null order by transaction_value_wei desc nulls last, created_contract_address limit 10""",
    "g21_recipient_classes": """select labels.concept_class as recipient_concept_class, count(*) as transaction_count from transaction_facts as tx
        join entity_labels as labels on tx.to_address = labels.address group by labels.concept_class
        order by transaction_count desc, recipient_concept_class nulls first limit 10""",
    "g22_top_senders": """select from_address as sender_address, count(*) as transaction_count from transaction_facts group by from_address
        order by transaction_count desc, sender_address limit 10""",
    "g23_top_recipients": """select to_address as recipient_address, count(*) as transaction_count from transaction_facts where to_address is not null
        group by to_address order by transaction_count desc, recipient_address limit 10""",
    "g24_daily_reconciliation": f"""with tx_daily as (select {DAY} as activity_date, count(*) as observed_transaction_rows from transaction_facts group by {DAY}),
        block_daily as (select {DAY} as activity_date, sum(transaction_count) as joined_block_transaction_total from block_facts group by {DAY})
        select activity_date, observed_transaction_rows, joined_block_transaction_total from tx_daily join block_daily using (activity_date) order by activity_date""",
    "g25_contract_recipients": f"""select {STANDARD} as recipient_contract_class, count(*) as transaction_count, coalesce(sum(tx.value_wei), 0) as total_value_wei
        from transaction_facts as tx join contract_dimension as contracts on tx.to_address = contracts.address group by {STANDARD} order by recipient_contract_class""",
    "g26_busiest_transactions": """with transfer_counts as (select transaction_hash, block_number, block_hash, count(*) as transfer_count from token_transfer_facts
        group by transaction_hash, block_number, block_hash)
        select tx.transaction_hash as transaction_hash, tx.value_wei as native_value_wei, transfer_counts.transfer_count as transfer_count from transaction_facts as tx
        join transfer_counts on tx.transaction_hash = transfer_counts.transaction_hash and tx.block_number = transfer_counts.block_number
        and tx.block_hash = transfer_counts.block_hash order by transfer_count desc, native_value_wei desc nulls last, transaction_hash limit 10""",
    "g27_sender_classes": """select labels.concept_class as sender_concept_class, count(*) as transaction_count, coalesce(sum(tx.value_wei), 0) as total_value_wei
        from transaction_facts as tx join entity_labels as labels on tx.from_address = labels.address group by labels.concept_class
        order by total_value_wei desc, sender_concept_class nulls first limit 10""",
    "g28_owner_token_volume": """select labels.owner as recipient_owner, transfers.token_symbol as token_symbol, sum(cast(transfers.normalized_amount as decimal(38,9))) as total_normalized_amount
        from token_transfer_facts as transfers join entity_labels as labels on transfers.to_address = labels.address
        where transfers.normalized_amount is not null and transfers.token_symbol is not null group by labels.owner, transfers.token_symbol
        order by total_normalized_amount desc, recipient_owner nulls first, token_symbol limit 20""",
    "g29_period_totals": """with period_totals as (select case when block_timestamp < timestamp '2026-06-11 00:00:00' then 'early' else 'late' end as period_name,
        value_wei from transaction_facts) select period_name, count(*) as transaction_count, coalesce(sum(value_wei), 0) as total_value_wei
        from period_totals group by period_name order by period_name""",
}

#: A sender and a pair that occur in every data folder, found by the query itself.
BUSY_SENDER = "(select from_address from transaction_facts group by from_address order by count(*) desc, from_address limit 1)"
BUSY_RECIPIENT = "(select to_address from transaction_facts where to_address is not null group by to_address order by count(*) desc, to_address limit 1)"
BUSY_SYMBOL = "(select token_symbol from token_transfer_facts where token_symbol is not null group by token_symbol order by count(*) desc, token_symbol limit 1)"
BUSY_MINER = "(select beneficiary_address from block_facts group by beneficiary_address order by count(*) desc, beneficiary_address limit 1)"
BUSY_PAIR = """pair as (select least(from_address, to_address) as low, greatest(from_address, to_address) as high from transaction_facts
    where to_address is not null group by least(from_address, to_address), greatest(from_address, to_address) order by count(*) desc, low, high limit 1)"""

TEMPLATES = {
    "t01_count_tx_in_range": "select count(*) as transaction_count from transaction_facts",
    "t02_list_tx_from_account": f"select {SHOWN} from transaction_facts where from_address = {BUSY_SENDER} order by block_timestamp desc, transaction_hash limit 20",
    "t03_list_tx_to_account": f"select {SHOWN} from transaction_facts where to_address = {BUSY_RECIPIENT} order by block_timestamp desc, transaction_hash limit 20",
    "t04_filter_tx_by_value": f"select {SHOWN} from transaction_facts where value_wei >= 1 * cast('{ETH}' as decimal(38,0)) order by value_wei desc, transaction_hash limit 50",
    "t05_list_failed_tx": f"select {SHOWN} from transaction_facts where is_success is false order by block_timestamp desc, transaction_hash limit 20",
    "t06_block_by_number": """select block_number, block_hash, cast(block_timestamp as string) as at, gas_used, transaction_count from block_facts
        where block_number = (select min(block_number) from transaction_facts)""",
    "t07_tx_by_hash": f"select {SHOWN}, is_success from transaction_facts where transaction_hash = (select min(transaction_hash) from transaction_facts)",
    "t08_known_exchanges": """select address, primary_label, owner from entity_labels where concept_class = 'ExchangeAccount' and address_role = 'operational'
        order by address limit 100""",
    "t09_top_senders_by_value": """select from_address as sender_address, sum(value_wei) as total_value_wei from transaction_facts group by from_address
        order by total_value_wei desc nulls last, sender_address limit 10""",
    "t10_top_recipients_by_count": """select to_address as recipient_address, count(*) as transaction_count from transaction_facts where to_address is not null
        group by to_address order by transaction_count desc, recipient_address limit 10""",
    "t11_tx_between_accounts": f"""with {BUSY_PAIR} select {SHOWN} from transaction_facts join pair on least(from_address, to_address) = low and greatest(from_address, to_address) = high
        order by block_timestamp desc, transaction_hash limit 20""",
    "t12_tx_grouped_by_owner": """select from_owner as owner, count(*) as transaction_count from labeled_transactions where from_owner is not null
        group by from_owner order by transaction_count desc, owner limit 20""",
    "t13_token_volume_by_symbol": """select token_symbol, sum(cast(normalized_amount as decimal(38,9))) as volume, count(*) as transfer_count from token_transfer_facts
        where token_symbol is not null and normalized_amount is not null group by token_symbol""",
    "t14_transfers_of_token": f"""select transaction_hash, log_index, cast(block_timestamp as string) as at, normalized_amount from token_transfer_facts
        where token_symbol = {BUSY_SYMBOL} order by block_timestamp desc, transaction_hash, log_index limit 20""",
    "t15_failed_high_gas_tx": """select transaction_hash, receipt_gas_used from transaction_facts where is_success is false and receipt_gas_used > 50000
        order by receipt_gas_used desc, transaction_hash limit 20""",
    "t16_blocks_by_validator": f"""select block_number, block_hash, transaction_count from block_facts where beneficiary_address = {BUSY_MINER}
        order by block_number desc limit 20""",
    "t17_accounts_by_category": "select category, address_role, count(*) as account_count from entity_labels group by category, address_role",
    "t18_tx_by_hour": """select cast(date_trunc('hour', block_timestamp) as string) as hour_start, count(*) as transaction_count from transaction_facts
        group by cast(date_trunc('hour', block_timestamp) as string)""",
    "t19_large_tx_to_class": f"""select transaction_hash, from_address, to_address, to_owner, value_wei from labeled_transactions
        where to_concept_class = 'TreasuryAccount' and value_wei >= cast('{ETH}' as decimal(38,0)) order by value_wei desc, transaction_hash limit 50""",
    "t20_owner_net_native_flow": """with flows as (
          select to_owner as owner, value_wei as incoming, cast(0 as decimal(38,0)) as outgoing from labeled_transactions where to_owner is not null and is_success is true
          union all select from_owner, cast(0 as decimal(38,0)), value_wei from labeled_transactions where from_owner is not null and is_success is true),
        net as (select owner, sum(incoming) as incoming_wei, sum(outgoing) as outgoing_wei, sum(incoming) - sum(outgoing) as net_wei from flows group by owner),
        top as (select owner, incoming_wei, outgoing_wei, net_wei from net order by abs(net_wei) desc, owner limit 20)
        select owner, incoming_wei, outgoing_wei, net_wei, rank() over (order by abs(net_wei) desc) as flow_rank from top""",
    "t21_category_owner_distribution": """with per as (select category, count(distinct owner) as owner_count, count(*) as account_count from entity_labels group by category)
        select category, owner_count, account_count, cast(account_count as double) / nullif(owner_count, 0) as accounts_per_owner,
        dense_rank() over (order by owner_count desc, account_count desc) as category_rank from per""",
    "t22_token_after_native_funding": """with funded as (select to_address as account, block_timestamp as funded_at, transaction_hash as funding_hash from labeled_transactions
          where from_concept_class = 'TreasuryAccount' and is_success is true and value_wei > 0 and to_address is not null),
        days as (select account, funded_at, funding_hash, cast(funded_at as date) as on_day from funded
          union all select account, funded_at, funding_hash, cast(cast(funded_at as date) + interval 1 day as date) from funded)
        select f.funding_hash as funding_hash, t.transaction_hash as transfer_hash, t.log_index as log_index, f.account as account
        from days f join token_transfer_facts t on t.from_address = f.account and cast(t.block_timestamp as date) = f.on_day
        where t.block_timestamp >= f.funded_at and t.block_timestamp < f.funded_at + interval 720 minutes""",
    "t23_treasury_concentration": """with pairs as (select from_owner as owner, to_address, count(*) as n from labeled_transactions
          where from_concept_class = 'TreasuryAccount' and from_owner is not null and to_address is not null group by from_owner, to_address),
        shares as (select owner, n, cast(n as double) / sum(n) over (partition by owner) as share, sum(n) over (partition by owner) as total from pairs)
        select owner, max(total) as transaction_count, count(*) as counterparty_count, round(sum(share * share), 9) as concentration
        from shares group by owner having max(total) >= 10""",
    "t24_treasury_token_diversity": """with per as (select from_owner as owner, count(distinct token_address) as contract_count, count(distinct to_address) as recipient_count,
          count(*) as transfer_count from labeled_token_transfers where from_concept_class = 'TreasuryAccount' and from_owner is not null group by from_owner),
        top as (select owner, contract_count, recipient_count, transfer_count from per order by contract_count desc, recipient_count desc, owner limit 50)
        select owner, contract_count, recipient_count, transfer_count, rank() over (order by contract_count desc, recipient_count desc) as diversity_rank from top""",
    "t25_repeated_pair_flow": """select from_address, to_address, count(*) as transaction_count, sum(value_wei) as total_value_wei from transaction_facts
        where to_address is not null group by from_address, to_address having count(*) >= 2 order by transaction_count desc, total_value_wei desc, from_address, to_address limit 50""",
}

COMPETENCY = {
    "c02_at_least_one_eth": f"select transaction_hash, value_wei from transaction_facts where value_wei >= cast('{ETH}' as decimal(38,0))",
    "c03_failed": "select transaction_hash, receipt_gas_used from transaction_facts where is_success is false",
    "c04_by_sender": f"select transaction_hash from transaction_facts where from_address = {BUSY_SENDER}",
    "c05_by_recipient": f"select transaction_hash from transaction_facts where to_address = {BUSY_RECIPIENT}",
    "c06_block_of_transaction": """select t.transaction_hash as transaction_hash, b.block_number as block_number, b.transaction_count as transaction_count from transaction_facts t
        join block_facts b on t.block_number = b.block_number and t.block_hash = b.block_hash""",
    "c07_exchange_accounts": "select address, owner from entity_labels where concept_class = 'ExchangeAccount'",
    "c08_token_by_symbol": "select address, symbol, decimals from token_dimension where symbol is not null",
    "c09_blocks": "select block_number, transaction_count from block_facts",
    "c10_low_confidence": "select address, confidence from entity_labels where confidence = 'low'",
    "c13_exchange_to_dex": """select transaction_hash, from_owner, to_owner from labeled_transactions
        where from_concept_class = 'ExchangeAccount' and to_concept_class = 'DexProtocol'""",
    "c14_transfers_with_exchange": """select transaction_hash, log_index from labeled_token_transfers
        where from_concept_class = 'ExchangeAccount' or to_concept_class = 'ExchangeAccount'""",
    "c16_failed_high_gas": "select transaction_hash, receipt_gas_used from transaction_facts where is_success is false and receipt_gas_used > 100000",
    "c18_contract_calls": """select t.transaction_hash as transaction_hash, length(t.input) as input_length from transaction_facts t
        join contract_dimension c on t.to_address = c.address where length(t.input) > 10""",
    "c19_transfers_in_high_value": f"""select f.transaction_hash as transaction_hash, f.log_index as log_index, t.value_wei as value_wei from token_transfer_facts f
        join transaction_facts t on f.transaction_hash = t.transaction_hash where t.value_wei >= cast('{ETH}' as decimal(38,0))""",
    "c20_accounts_by_owner": "select owner, category, count(*) as account_count from entity_labels group by owner, category",
    "c21_any_mev_to_dex": """select count(*) > 0 as found from labeled_transactions where from_concept_class = 'MevActor' and to_concept_class = 'DexProtocol'""",
    "c22_exchange_to_lending": """select from_owner, to_owner, sum(value_wei) as total_value_wei from labeled_transactions
        where from_concept_class = 'ExchangeAccount' and to_concept_class = 'LendingProtocol' group by from_owner, to_owner
        order by total_value_wei desc, from_owner nulls first, to_owner nulls first limit 1""",
    "c23_funded_then_token": """with funded as (select to_address as account, min(block_timestamp) as funded_at from labeled_transactions
          where from_concept_class = 'MevActor' and is_success is true and to_address is not null group by to_address)
        select distinct t.from_address as account, t.to_address as exchange_address from labeled_token_transfers t join funded f on t.from_address = f.account
        where t.to_concept_class = 'ExchangeAccount' and t.block_timestamp >= f.funded_at""",
    "c25_dex_volume": """select token_symbol, sum(cast(normalized_amount as decimal(38,9))) as volume from labeled_token_transfers
        where (from_concept_class = 'DexProtocol' or to_concept_class = 'DexProtocol') and token_symbol is not null and normalized_amount is not null
        group by token_symbol order by volume desc, token_symbol limit 1""",
    "c26_bridge_outflow": """with funded as (select to_address as bridge, block_timestamp as at from labeled_transactions
          where from_concept_class = 'ExchangeAccount' and to_concept_class = 'BridgeProtocol'),
        sent as (select from_address as bridge, block_timestamp as at, transaction_hash from labeled_transactions where from_concept_class = 'BridgeProtocol')
        , days as (select x.bridge as bridge, x.at as at, cast(x.at as date) as on_day from funded x
          union all select y.bridge, y.at, cast(cast(y.at as date) + interval 1 day as date) from funded y)
        select distinct s.transaction_hash as transaction_hash, s.bridge as bridge from sent s join days f on s.bridge = f.bridge and cast(s.at as date) = f.on_day
        where s.at > f.at and s.at <= f.at + interval 1440 minutes""",
    "c27_lending_high_value": f"""select transaction_hash, to_owner, value_wei from labeled_transactions
        where to_concept_class = 'LendingProtocol' and value_wei >= cast('{ETH}' as decimal(38,0))""",
    "c28_mev_to_dex": """select from_owner, count(*) as transaction_count from labeled_transactions
        where from_concept_class = 'MevActor' and to_concept_class = 'DexProtocol' group by from_owner""",
    "c29_token_then_exchange": """with got as (select to_address as account, min(block_timestamp) as got_at from token_transfer_facts group by to_address)
        select t.transaction_hash as transaction_hash, t.from_address as account from labeled_transactions t join got g on t.from_address = g.account
        where t.to_concept_class = 'ExchangeAccount' and t.block_timestamp > g.got_at""",
    "c30_owners_across_categories": """select owner, count(distinct category) as category_count from entity_labels where owner is not null
        group by owner having count(distinct category) > 1""",
}

CHECKS = {
    "b1_label_contract": """select count(*) as row_count, count(distinct address) as address_count, count(distinct owner) as owner_count,
        count_if(address_role = 'treasury') as treasury_count, count_if(address_role = 'operational') as operational_count,
        count(*) = count(distinct address) as passed from entity_labels""",
    "b2_transaction_count": """select count(*) as relation_rows, count(distinct transaction_hash) as key_rows, count(*) = count(distinct transaction_hash) as passed
        from transaction_facts""",
    "b3_block_count": """select count(*) as relation_rows, count(distinct block_hash) as key_rows, sum(transaction_count) as transaction_rows,
        sum(transaction_count) = (select count(*) from transaction_facts) as passed from block_facts""",
    "b4_contract_dimension": """select count(*) as row_count, count(distinct address) as address_count,
        count_if(created_at >= timestamp '2026-07-01 00:00:00') as late_count, count(*) = count(distinct address) as passed from contract_dimension""",
    "b5_label_cardinality": """select count(*) as labelled_rows, count(distinct transaction_hash) as labelled_keys,
        count(*) = (select count(*) from transaction_facts) as passed from labeled_transactions""",
    "b6_labeled_transfers": """select count(*) as row_count, count(distinct concat(transaction_hash, '#', cast(log_index as string))) as key_count,
        count_if(normalized_amount is not null and is_erc20 is not true) as standard_violations,
        count_if(normalized_amount is not null and token_decimals not between 0 and 38) as precision_violations from labeled_token_transfers""",
    "o052_edge_case_profile": """select count_if(to_address is null) as null_recipients, count_if(value_wei = 0) as zero_values,
        count_if(value_wei > 9007199254740992) as beyond_double, count_if(gas_price_wei = 0) as zero_gas_prices,
        count_if(transaction_type is not null and transaction_type > 0) as typed_transactions from transaction_facts""",
    "o051_address_pattern": "select count_if(regexp_like(from_address, '^0x[0-9a-f]{40}$')) as well_formed, count(*) as total from transaction_facts",
}

RELATION_DUMPS = {
    "transaction_facts": "select transaction_hash, cast(block_timestamp as string) as at, block_number, from_address, to_address, value_wei, gas_price_wei, is_success, transaction_type from transaction_facts",
    "block_facts": "select block_number, block_hash, cast(block_timestamp as string) as at, beneficiary_address, gas_used, transaction_count, base_fee_per_gas_wei from block_facts",
    "token_dimension": "select address, symbol, decimals from token_dimension",
    "contract_dimension": "select address, is_erc20, is_erc721, cast(created_at as string) as created, block_number from contract_dimension",
    "token_transfer_facts": "select transaction_hash, log_index, token_address, value_raw, value_bignumeric, value_cast_valid, token_symbol, token_decimals, normalized_amount from token_transfer_facts",
    "entity_labels": "select address, primary_label, owner, category, concept_class, address_role, confidence from entity_labels",
    "labeled_transactions": "select transaction_hash, from_owner, from_concept_class, to_owner, to_concept_class, value_wei from labeled_transactions",
    "labeled_token_transfers": "select transaction_hash, log_index, from_owner, to_owner, token_owner, token_symbol, normalized_amount from labeled_token_transfers",
}

ALL = {**GOLD, **TEMPLATES, **COMPETENCY, **CHECKS, **RELATION_DUMPS}


def run_shape(spark: SparkSession, folder: str, name: str, start: str = START, end: str = END) -> DataFrame:
    """The DataFrame of a shape over a window of dates, by default all of the ledger's month."""
    ledger.register(spark, folder, start, end, mentioned(ALL[name]))
    return spark.sql(ALL[name])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, name=name: run_shape(spark, folder, name)) for name in ALL}


def oracle_sql() -> dict[str, str]:
    own = {name: sql.replace("regexp_like(", "regexp_matches(") for name, sql in ALL.items()}
    return {name: with_relations(sql, START, END) for name, sql in own.items()}
