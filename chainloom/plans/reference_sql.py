"""The relations as common table expressions for an independent SQL engine."""

from __future__ import annotations

import re

LABELS = ("primary_label", "owner", "category", "concept_class", "address_role", "confidence")


def _labelled(facts: str, sides: tuple[str, ...]) -> str:
    columns = ", ".join(f"{s}_l.{c} as {s}_{c}" for s in sides for c in LABELS)
    joins = " ".join(f"left join entity_labels {s}_l on f.{s}_address = {s}_l.address" for s in sides)
    return f"select f.*, {columns} from {facts} f {joins}"


def relations(start: str, end: str) -> dict[str, str]:
    """Text of each relation by name, in order of dependence."""
    window = f"(block_timestamp at time zone 'UTC') >= timestamp '{start}' and (block_timestamp at time zone 'UTC') < timestamp '{end}'"
    return {
        "transaction_facts": f"""select distinct lower(hash) as transaction_hash, transaction_index, block_timestamp at time zone 'UTC' as block_timestamp, block_number,
            lower(block_hash) as block_hash, lower(from_address) as from_address, lower(to_address) as to_address, value as value_wei, gas as gas_limit,
            gas_price as gas_price_wei, receipt_gas_used, receipt_status, receipt_status = 1 as is_success, input,
            lower(receipt_contract_address) as receipt_contract_address, transaction_type from eth_transactions where {window}""",
        "block_facts": """select block_number, block_hash, min(block_timestamp) as block_timestamp, arg_min(from_address, transaction_index) as beneficiary_address,
            sum(receipt_gas_used) as gas_used, count(*) as transaction_count, min(gas_price_wei) as base_fee_per_gas_wei from transaction_facts group by 1, 2""",
        "token_dimension": """select lower(address) as address, min(symbol) as symbol, min(name) as name,
            min(case when regexp_full_match(decimals, '[0-9]{1,3}') then cast(decimals as int) end) as decimals from amended_tokens where address is not null group by 1""",
        "contract_dimension": f"""select address, is_erc20, is_erc721, created_at, block_number, block_hash from (
            select *, row_number() over (partition by address order by created_at desc, block_number desc, block_hash desc) as place from (
              select lower(receipt_contract_address) as address, null::boolean as is_erc20, null::boolean as is_erc721, block_timestamp at time zone 'UTC' as created_at,
                     block_number, lower(block_hash) as block_hash from eth_transactions where receipt_contract_address is not null
              union all select address, decimals > 0, decimals = 0, timestamp '2015-07-30', 0, '0x' from token_dimension)
            where created_at < timestamp '{end}') where place = 1""",
        "token_transfer_facts": f"""select f.*, regexp_full_match(value_raw, '[0-9]{{1,38}}') as value_cast_valid,
            case when regexp_full_match(value_raw, '[0-9]{{1,38}}') then try_cast(value_raw as decimal(38,0)) end as value_bignumeric,
            t.symbol as token_symbol, t.name as token_name, t.decimals as token_decimals, c.is_erc20, c.is_erc721,
            case when regexp_full_match(value_raw, '[0-9]{{1,38}}') and c.is_erc20 is true and c.is_erc721 is not true and t.decimals between 0 and 38 then
              try_cast(left(lpad(value_raw, greatest(length(value_raw), t.decimals + 1)::int, '0'), (greatest(length(value_raw), t.decimals + 1) - t.decimals)::int) || '.' ||
                rpad(left(right(lpad(value_raw, greatest(length(value_raw), t.decimals + 1)::int, '0'), t.decimals::int), 18), 18, '0') as decimal(38,18)) end as normalized_amount
            from (select distinct lower(transaction_hash) as transaction_hash, log_index, block_timestamp at time zone 'UTC' as block_timestamp, block_number,
                    lower(block_hash) as block_hash, lower(token_address) as token_address, lower(from_address) as from_address, lower(to_address) as to_address,
                    value as value_raw from token_transfers where {window}) f
            left join token_dimension t on f.token_address = t.address left join contract_dimension c on f.token_address = c.address""",
        "entity_labels": """select lower(address_lower) as address, 1::bigint as chain_id, primary_label, owner, category, concept_class,
            case when concept_class = 'TreasuryAccount' then 'treasury' else 'operational' end as address_role, aliases, confidence,
            sha256(concat_ws('|', address_lower, owner, category)) as dictionary_sha256 from entities where address_lower is not null""",
        "labeled_transactions": _labelled("transaction_facts", ("from", "to")),
        "labeled_token_transfers": _labelled("token_transfer_facts", ("from", "to", "token")),
    }


NEEDS = {
    "block_facts": {"transaction_facts"}, "contract_dimension": {"token_dimension"}, "token_transfer_facts": {"token_dimension", "contract_dimension"},
    "labeled_transactions": {"transaction_facts", "entity_labels"}, "labeled_token_transfers": {"token_transfer_facts", "entity_labels"},
}


def mentioned(sql: str) -> set[str]:
    """Relations that a query names, with those they are built from."""
    names = set(relations("", "")) & set(re.findall(r"[a-z_]+", sql))
    while more := set().union(*(NEEDS.get(n, set()) for n in names)) - names:
        names |= more
    return names


def with_relations(sql: str, start: str, end: str) -> str:
    """A complete statement: the relations it needs, then its own text."""
    wanted = mentioned(sql)
    parts = [f"{name} as ({text})" for name, text in relations(start, end).items() if name in wanted]
    if not parts:
        return sql
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return "with recursive " + ", ".join(parts) + ", " + body[15:]
    if body.lower().startswith("with "):
        return "with " + ", ".join(parts) + ", " + body[5:]
    return "with " + ", ".join(parts) + " " + body
