"""Answering questions by rule: typed slots, templates, abstention.

Templates are a fixed table of the plan, so a question is matched by expressions
next to the scan: nothing is joined or shuffled.  Seed patterns decide first; the
most specific one (most literal words) wins and a tie abstains.  Otherwise the
question's words, without its slot values, are compared with every template's by
multiset F1; within the margin the words of its relations decide, else it abstains.

Defined results: null, empty and overlong questions abstain; a template answers
only where exactly its slots are named, its dates are a window of 1 to 31 days and
its limits lie within 1 to 100.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.functions.text import fold_accents, words

#: Least F1 of a structural match, and how far behind the best still counts as equal.
LEAST_F1, MARGIN = 0.62, 0.03
MOST_DAYS, MOST_ROWS, LONGEST_QUESTION = 31, 100, 4000

# How slot values are written.
DATE = r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)"
ADDRESS = r"(?i)(?<!\w)0x[0-9a-f]{40}(?!\w)"
HASH = r"(?i)(?<!\w)0x[0-9a-f]{64}(?!\w)"
NUMBER = r"(?<![\w.])\d+(?:\.\d+)?(?![\w.])"
SYMBOL = r"\b(?:token|for|of)\s+([A-Z][A-Z0-9]{1,15})\b"
# Classes by the words questions use for them.
CLASSES = {
    "exchange": "ExchangeAccount", "decentralised exchange": "DexProtocol", "treasury": "TreasuryAccount", "bridge": "BridgeProtocol",
    "lending": "LendingProtocol", "mev": "MevActor",
}


@dataclass(frozen=True)
class Template:
    """``seeds`` hold {slot} places; ``slots`` are (name, type) in source order."""

    name: str
    seeds: tuple[str, ...]
    slots: tuple[tuple[str, str], ...]
    relation: str
    sql: str


_DATES = (("start_date", "date"), ("end_date", "date"))
_TX = "`transaction_facts`(DATE '{start_date}', DATE '{end_date}')"
TEMPLATES = (
    Template("count_transactions", ("count all transactions recorded between {start_date} and {end_date}", "what is the number of transactions in the window {start_date} to {end_date}"),
             _DATES, "transaction_facts", f"SELECT COUNT(*) AS transaction_count FROM {_TX}"),
    Template("count_failed", ("how many failed transactions were there from {start_date} until {end_date}", "count the transactions that failed between {start_date} and {end_date}"),
             _DATES, "transaction_facts", f"SELECT COUNTIF(is_success IS FALSE) AS failed_count FROM {_TX}"),
    Template("count_succeeded", ("count the transactions that succeeded between {start_date} and {end_date}",),
             _DATES, "transaction_facts", f"SELECT COUNTIF(is_success IS TRUE) AS success_count FROM {_TX}"),
    Template("sum_value", ("what was the total native value moved from {start_date} until {end_date}", "sum the wei sent in all transactions between {start_date} and {end_date}"),
             _DATES, "transaction_facts", f"SELECT COALESCE(SUM(value_wei), 0) AS total_wei FROM {_TX}"),
    Template("latest_sent", ("list the latest {n} transactions sent by account {account} between {start_date} and {end_date}", "which {n} transactions did {account} send most recently in the window {start_date} to {end_date}"),
             (("n", "limit"), ("account", "address"), *_DATES), "transaction_facts",
             f"SELECT transaction_hash, value_wei FROM {_TX} WHERE from_address = '{{account}}' ORDER BY block_timestamp DESC, transaction_hash ASC LIMIT {{n}}"),
    Template("latest_received", ("list the latest {n} transactions received by account {account} between {start_date} and {end_date}", "which {n} transactions arrived most recently at {account} in the window {start_date} to {end_date}"),
             (("n", "limit"), ("account", "address"), *_DATES), "transaction_facts",
             f"SELECT transaction_hash, from_address FROM {_TX} WHERE to_address = '{{account}}' ORDER BY block_timestamp DESC, transaction_hash ASC LIMIT {{n}}"),
    Template("between_accounts", ("show up to {n} transactions in either direction between {account} and {other} from {start_date} until {end_date}", "what are the last {n} transfers of native value linking {account} with {other} between {start_date} and {end_date}"),
             (("n", "limit"), ("account", "address"), ("other", "address"), *_DATES), "transaction_facts",
             f"SELECT transaction_hash FROM {_TX} WHERE (from_address = '{{account}}' AND to_address = '{{other}}') OR (from_address = '{{other}}' AND to_address = '{{account}}') ORDER BY block_timestamp DESC LIMIT {{n}}"),
    Template("failed_high_gas", ("which {n} failed transactions burned more than {gas} gas between {start_date} and {end_date}", "list {n} unsuccessful transactions whose gas exceeded {gas} from {start_date} until {end_date}"),
             (("n", "limit"), ("gas", "number"), *_DATES), "transaction_facts",
             f"SELECT transaction_hash, receipt_gas_used FROM {_TX} WHERE is_success IS FALSE AND receipt_gas_used > {{gas}} ORDER BY receipt_gas_used DESC, transaction_hash ASC LIMIT {{n}}"),
    Template("latest_of_token", ("show the {n} most recent transfers of token {symbol} between {start_date} and {end_date}", "which {n} transfers of {symbol} came last in the window {start_date} to {end_date}"),
             (("n", "limit"), ("symbol", "symbol"), *_DATES), "token_transfer_facts",
             "SELECT transaction_hash, log_index FROM `token_transfer_facts`(DATE '{start_date}', DATE '{end_date}') WHERE token_symbol = '{symbol}' ORDER BY block_timestamp DESC, transaction_hash ASC, log_index ASC LIMIT {n}"),
    Template("token_volume", ("what volume of {symbol} was transferred between {start_date} and {end_date}",),
             (("symbol", "symbol"), *_DATES), "token_transfer_facts",
             "SELECT SUM(normalized_amount) AS volume FROM `token_transfer_facts`(DATE '{start_date}', DATE '{end_date}') WHERE token_symbol = '{symbol}' AND normalized_amount IS NOT NULL"),
    Template("blocks_of_beneficiary", ("list the last {n} blocks whose beneficiary was {account} between {start_date} and {end_date}", "which {n} blocks paid their fees to {account} most recently from {start_date} until {end_date}"),
             (("n", "limit"), ("account", "address"), *_DATES), "block_facts",
             "SELECT block_number FROM `block_facts`(DATE '{start_date}', DATE '{end_date}') WHERE beneficiary_address = '{account}' ORDER BY block_number DESC LIMIT {n}"),
    Template("block_by_number", ("what are the hash and the gas used of block {block} mined between {start_date} and {end_date}", "look up block {block} in the window {start_date} to {end_date} and return its hash and gas"),
             (("block", "number"), *_DATES), "block_facts",
             "SELECT block_hash, gas_used FROM `block_facts`(DATE '{start_date}', DATE '{end_date}') WHERE block_number = {block}"),
    Template("top_senders", ("who were the top {n} senders by total value from {start_date} until {end_date} ignoring transactions of {least} wei or less",),
             (("n", "limit"), *_DATES, ("least", "number")), "transaction_facts",
             f"SELECT from_address, SUM(value_wei) AS total_wei FROM {_TX} WHERE value_wei > {{least}} GROUP BY from_address ORDER BY total_wei DESC, from_address ASC LIMIT {{n}}"),
    Template("counterparties", ("how many different recipients did {account} pay successfully between {start_date} and {end_date}", "count the distinct counterparties that account {account} sent funds to from {start_date} until {end_date}"),
             (("account", "address"), *_DATES), "transaction_facts",
             f"SELECT COUNT(DISTINCT to_address) AS recipient_count FROM {_TX} WHERE from_address = '{{account}}' AND is_success IS TRUE"),
    Template("net_flow", ("what is the net native flow of {account} from {start_date} until {end_date}",),
             (("account", "address"), *_DATES), "transaction_facts",
             f"SELECT SUM(IF(to_address = '{{account}}', value_wei, 0)) - SUM(IF(from_address = '{{account}}', value_wei, 0)) AS net_wei FROM {_TX} WHERE '{{account}}' IN (from_address, to_address)"),
)
_KINDS = {"date": "dates", "hash": "hashes", "address": "addresses", "number": "numbers", "limit": "numbers", "symbol": "symbols"}
_COUNTED = ("dates", "hashes", "addresses", "numbers", "symbols")


def typed_slots(question: Column) -> Column:
    """Struct of arrays (dates, hashes, addresses, numbers, symbols) in source order;
    addresses and hashes in lower case; numbers don't count inside of the others."""
    found = lambda text, pattern, group=0: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rest = question
    for pattern in (DATE, HASH, ADDRESS):
        rest = F.regexp_replace(rest, pattern, " ")
    low = lambda c: F.transform(c, F.lower)
    return F.struct(
        found(question, DATE).alias("dates"), low(found(question, HASH)).alias("hashes"), low(found(question, ADDRESS)).alias("addresses"),
        found(rest, NUMBER).alias("numbers"), found(question, SYMBOL, 1).alias("symbols"),
    )


def classes_named(question: Column) -> Column:
    """Array of the classes a question names, the longest phrase first."""
    text, out = F.concat(F.lit(" "), F.array_join(words(fold_accents(question)), " "), F.lit(" ")), []
    for phrase in sorted(CLASSES, key=lambda p: (-len(p), p)):
        out.append(F.when(text.contains(f" {phrase}"), F.lit(CLASSES[phrase])))
        text = F.regexp_replace(text, f" {phrase}", " ")
    return F.array_compact(F.array(*out))


def _tokens(text: str) -> list[str]:
    return [w for w in re.split(r"[^0-9a-z]+", re.sub(r"\{\w+\}", " ", text.lower())) if w]


def _catalogue(templates: tuple[Template, ...]) -> Column:
    """The templates as one constant array of structs."""
    out = []
    for t in templates:
        seeds = [_tokens(s) for s in t.seeds]
        kinds = [_KINDS[kind] for _, kind in t.slots]
        pattern = "|".join(re.sub(r"\\\{\w+\\\}", r"\\S+", re.escape(s)) for s in t.seeds)
        slots = [
            F.struct(F.lit("{" + name + "}").alias("name"), F.lit(_KINDS[kind]).alias("kind"), F.lit(kinds[:i].count(_KINDS[kind])).alias("at"), F.lit(kind == "limit").alias("limit"))
            for i, (name, kind) in enumerate(t.slots)
        ]
        named = t.relation.split("_")
        out.append(
            F.struct(
                F.lit(t.name).alias("template"), F.lit(f"^(?:{pattern})$").alias("pattern"), F.lit(max(map(len, seeds))).alias("literal"), F.lit(t.sql).alias("sql"),
                F.array(*[F.array(*map(F.lit, s)) for s in seeds]).alias("seeds"), F.array(*slots).alias("slots"),
                F.array(*map(F.lit, sorted({*named, named[0] + "s"}))).alias("words"), *[F.lit(kinds.count(k)).alias(k) for k in _COUNTED],
            )
        )
    return F.array(*out)


def _value(slot: Column) -> Column:
    value = F.when(slot["kind"] == _COUNTED[0], F.get(_COUNTED[0], slot["at"]))
    for kind in _COUNTED[1:]:
        value = value.when(slot["kind"] == kind, F.get(kind, slot["at"]))
    return value


def _fits(slot: Column) -> Column:
    """Numbers are whole; limits lie within 1 to MOST_ROWS."""
    value = _value(slot)
    return (slot["kind"] != "numbers") | (value.rlike("^[0-9]+$") & (~slot["limit"] | value.try_cast("bigint").between(1, MOST_ROWS)))


def _multiset_f1(tokens: Column, literal: Column) -> Column:
    times = lambda words_, w: F.size(F.filter(words_, lambda x: x == w))
    shared = F.aggregate(F.array_distinct(literal), F.lit(0), lambda n, w: n + F.least(times(tokens, w), times(literal, w)))
    return F.when(F.size(tokens) > 0, 2.0 * shared / (F.size(tokens) + F.size(literal))).otherwise(F.lit(0.0))


def _candidate(t: Column) -> Column:
    """What one template makes of a question."""
    good = F.col("window") & F.forall(t["slots"], _fits)
    for kind in _COUNTED:
        good &= F.size(kind) == t[kind]
    score = F.round(F.array_max(F.transform(t["seeds"], lambda seed: _multiset_f1(F.col("tokens"), seed))), 9)
    return F.struct(
        F.coalesce(good, F.lit(False)).alias("good"), F.regexp_like("text", t["pattern"]).alias("seed"), t["literal"].alias("literal"), score.alias("score"),
        F.size(F.array_intersect("tokens", t["words"])).alias("overlap"), t["template"].alias("template"),
        F.aggregate(t["slots"], t["sql"], lambda sql, slot: F.replace(sql, slot["name"], F.coalesce(_value(slot), F.lit("")))).alias("sql"),
    )


def answer_by_rule(questions: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Input (key, question); output (key, template, how, score, sql) of the questions
    that are answered; the others abstain and have no row."""
    question = F.col("question")
    text = F.trim(F.regexp_replace(F.regexp_replace(F.lower(question), r"[?.!,;]+", " "), r"\s+", " "))
    masked = F.regexp_replace(question, SYMBOL, " ")
    for pattern in (DATE, HASH, ADDRESS, NUMBER):
        masked = F.regexp_replace(masked, pattern, " ")
    slots = typed_slots(question)
    asked = questions.where(question.isNotNull() & F.length("question").between(1, LONGEST_QUESTION)).select(
        "key", text.alias("text"), words(masked).alias("tokens"), *[slots[k].alias(k) for k in _COUNTED]
    )
    date = lambda i: F.get("dates", F.lit(i)).try_cast("date")
    asked = asked.withColumn("window", F.datediff(date(1), date(0)).between(1, MOST_DAYS))
    found = asked.select("key", F.filter(F.transform(_catalogue(templates), _candidate), lambda c: c["good"]).alias("c"))
    split = found.select(
        "key", F.filter("c", lambda x: x["seed"]).alias("seeds"), F.filter("c", lambda x: ~x["seed"] & (x["score"] >= LEAST_F1)).alias("near")
    )
    top = lambda c, field: F.array_max(F.transform(c, lambda x: x[field]))
    split = split.select("key", "seeds", "near", top("seeds", "literal").alias("literal"), top("near", "score").alias("score"))
    split = split.select(
        "key", "seeds", F.filter("seeds", lambda x: x["literal"] == F.col("literal")).alias("first"), F.filter("near", lambda x: x["score"] >= F.col("score") - MARGIN).alias("best")
    )
    split = split.select("key", "seeds", "first", "best", top("best", "overlap").alias("overlap"))
    split = split.select("key", "seeds", "first", "best", F.filter("best", lambda x: (x["overlap"] == F.col("overlap")) & (x["overlap"] > 0)).alias("most"))
    unseeded = F.size("seeds") == 0
    chosen = (
        F.when(F.size("first") == 1, F.struct(F.lit("seed").alias("how"), F.get("first", F.lit(0)).alias("c")))
        .when(unseeded & (F.size("best") == 1), F.struct(F.lit("structural").alias("how"), F.get("best", F.lit(0)).alias("c")))
        .when(unseeded & (F.size("most") == 1), F.struct(F.lit("schema").alias("how"), F.get("most", F.lit(0)).alias("c")))
    )
    # the generator keeps the filter from being pushed down, where it would repeat all of the above
    picked = split.select("key", F.explode_outer(F.array(chosen)).alias("p")).where("p is not null")
    score = F.when(F.col("p.how") == "seed", F.lit(1.0)).otherwise(F.col("p.c.score"))
    return picked.select("key", F.col("p.c.template").alias("template"), F.col("p.how").alias("how"), score.alias("score"), F.col("p.c.sql").alias("sql"))
