"""The ledger as subject-predicate-object rows, and constraints over them.

A triple is (s, p, o, o_kind, o_datatype); graphs are sets, so duplicates are
removed.  Each source row becomes an array of triples that is exploded in one
pass over the relation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.sources import ledger

IRI, LITERAL = "iri", "literal"


def _triple(subject: Column, predicate: str, value: Column, datatype: str | None) -> Column:
    return F.when(
        value.isNotNull(),
        F.struct(
            subject.alias("s"), F.lit(predicate).alias("p"), value.cast("string").alias("o"),
            F.lit(LITERAL if datatype else IRI).alias("o_kind"), F.lit(datatype).alias("o_datatype"),
        ),
    )


def _mapped(rows: DataFrame, subject: Column, kind: Column, fields: list[tuple[str, Column, str | None]]) -> DataFrame:
    """Triples of every row: its class and its non-null fields."""
    all_fields = [("type", kind, None), *fields]
    made = F.array_compact(F.array(*[_triple(subject, p, v, d) for p, v, d in all_fields]))
    return rows.select(F.explode(made).alias("t")).select("t.*")


def _iri(prefix: str, *parts: Column) -> Column:
    return F.when(F.lit(True) if not parts else parts[0].isNotNull(), F.concat(F.lit(prefix), F.concat_ws("-", *parts)))


def transaction_triples(facts: DataFrame) -> DataFrame:
    c = F.col
    return _mapped(
        facts, _iri("tx/", c("transaction_hash")), F.lit("Transaction"),
        [("hash", c("transaction_hash"), "string"), ("hasFrom", _iri("account/", c("from_address")), None), ("hasTo", _iri("account/", c("to_address")), None),
         ("hasValue", c("value_wei"), "decimal"), ("hasGasUsed", c("receipt_gas_used"), "integer"), ("hasGasPrice", c("gas_price_wei"), "decimal"),
         ("hasReceiptStatus", c("is_success"), "boolean"), ("hasBlockNumber", c("block_number"), "integer"), ("includedInBlock", _iri("block/", c("block_number").cast("string")), None),
         ("hasTimestamp", F.date_format("block_timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "dateTime")],
    )


def block_triples(facts: DataFrame) -> DataFrame:
    c = F.col
    return _mapped(
        facts, _iri("block/", c("block_number").cast("string")), F.lit("Block"),
        [("number", c("block_number"), "integer"), ("beneficiary", _iri("account/", c("beneficiary_address")), None), ("transactionCount", c("transaction_count"), "integer")],
    )


def transfer_triples(facts: DataFrame) -> DataFrame:
    c = F.col
    return _mapped(
        facts, _iri("transfer/", c("transaction_hash"), c("log_index").cast("string")), F.lit("TokenTransfer"),
        [("inTransaction", _iri("tx/", c("transaction_hash")), None), ("hasFrom", _iri("account/", c("from_address")), None),
         ("hasTo", _iri("account/", c("to_address")), None), ("token", _iri("token/", c("token_address")), None), ("rawValue", c("value_raw"), "string")],
    )


def contract_triples(contracts: DataFrame) -> DataFrame:
    c = F.col
    return _mapped(
        contracts, _iri("account/", c("address")), F.lit("Contract"), [("isErc20", c("is_erc20"), "boolean"), ("isErc721", c("is_erc721"), "boolean")]
    )


def label_triples(labels: DataFrame) -> DataFrame:
    c = F.col
    own = _mapped(
        labels, _iri("account/", c("address")), c("concept_class"),
        [("label", c("primary_label"), "string"), ("owner", c("owner"), "string"), ("category", c("category"), "string")],
    )
    names = labels.select(F.explode("aliases").alias("alias"), "address").where("alias is not null and trim(alias) <> ''")
    return own.unionByName(names.select(_iri("account/", c("address")).alias("s"), F.lit("alias").alias("p"), c("alias").alias("o"), F.lit(LITERAL).alias("o_kind"), F.lit("string").alias("o_datatype")))


def ledger_graph(spark: SparkSession, folder: str, start, end, once: bool = True) -> DataFrame:
    """The five maps together, each triple once unless ``once`` is off (validation
    doesn't need that, and saves moving the whole graph)."""
    parts = (
        transaction_triples(ledger.transaction_facts(spark, folder, start, end)),
        block_triples(ledger.block_facts(spark, folder, start, end)),
        transfer_triples(ledger.token_transfer_facts(spark, folder, start, end)),
        contract_triples(ledger.contract_dimension(spark, folder, end)),
        label_triples(ledger.entity_labels(spark, folder)),
    )
    graph = parts[0]
    for part in parts[1:]:
        graph = graph.unionByName(part)
    return graph.distinct() if once else graph


def n_triples(graph: DataFrame, base: str = "http://example.org/") -> DataFrame:
    """One line of N-Triples a row, escaped; write it with ``df.write.text``."""
    value = F.col("o")
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        value = F.replace(value, F.lit(raw), F.lit(escaped))
    iri = lambda x: F.concat(F.lit(f"<{base}"), x, F.lit(">"))
    literal = F.concat(F.lit('"'), value, F.lit('"^^<http://www.w3.org/2001/XMLSchema#'), "o_datatype", F.lit(">"))
    return graph.select(F.concat_ws(" ", iri(F.col("s")), iri(F.col("p")), F.when(F.col("o_kind") == IRI, iri(F.col("o"))).otherwise(literal), F.lit(".")).alias("value"))


def read_n_triples(lines: DataFrame, base: str = "http://example.org/") -> DataFrame:
    """Inverse of ``n_triples`` for lines in column ``value``."""
    pattern = r'^<([^>]*)> <([^>]*)> (?:<([^>]*)>|"((?:[^"\\]|\\.)*)"\^\^<[^#>]*#([^>]*)>) \.$'
    part = lambda i: F.regexp_extract("value", pattern, i)
    own = lambda x: F.regexp_replace(x, "^" + base, "")
    is_iri = part(5) == ""
    text = F.replace(part(4), F.lit("\\\\"), F.lit("\x00"))
    for raw, escaped in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\\", "\x00")):
        text = F.replace(text, F.lit(escaped), F.lit(raw))
    return lines.where(F.col("value").rlike(pattern)).select(
        own(part(1)).alias("s"), own(part(2)).alias("p"), F.when(is_iri, own(part(3))).otherwise(text).alias("o"),
        F.when(is_iri, IRI).otherwise(LITERAL).alias("o_kind"), F.when(~is_iri, part(5)).alias("o_datatype"),
    )


# Fixed values: (class, path, least, most, datatype, not below 0).
SHAPES = (
    ("Transaction", "hasFrom", 1, 1, None, False), ("Transaction", "hasTo", 0, 1, None, False), ("Transaction", "hasValue", 1, 1, "decimal", True),
    ("Transaction", "hasGasUsed", 0, 1, "integer", True), ("Transaction", "hasGasPrice", 0, 1, "decimal", True), ("Transaction", "hasReceiptStatus", 0, 1, "boolean", False),
    ("Transaction", "hasBlockNumber", 1, 1, "integer", False), ("Transaction", "hasTimestamp", 1, 1, "dateTime", False), ("Transaction", "includedInBlock", 0, 1, None, False),
    ("Block", "beneficiary", 1, 1, None, False), ("ExchangeAccount", "label", 1, 1, "string", False),
    ("ExchangeAccount", "owner", 1, 1, "string", False), ("TokenTransfer", "token", 1, 1, None, False), ("TokenTransfer", "inTransaction", 1, 1, None, False),
)


def shape_violations(graph: DataFrame, shapes=SHAPES) -> DataFrame:
    """(focus, path, message): cardinality, datatype and range violations.

    The graph, with or without repeated triples, is moved once, by subject: first
    each (subject, path) is reduced to its least and greatest object and datatype
    (different ones are more than one value), then each subject's paths meet the
    shapes of its classes, which are a constant of the plan.  Cardinalities of 0 and
    1 are all that shapes use.
    """
    if any(least > 1 or most != 1 for _, _, least, most, _, _ in shapes):
        raise ValueError("shapes bound a path by 0 or 1 and 1")
    paths = sorted({"type", *(s[1] for s in shapes)})
    value = F.col("o").try_cast("decimal(38,0)")
    by_path = (
        graph.where(F.col("p").isin(paths)).repartition("s").groupBy("s", "p").agg(
            F.min("o").alias("low"), F.max("o").alias("high"), F.min(F.coalesce("o_datatype", F.lit(""))).alias("t0"), F.max(F.coalesce("o_datatype", F.lit(""))).alias("t1"),
            F.min(value).alias("least"), F.collect_set(F.when(F.col("p") == "type", F.col("o"))).alias("classes"),
        )
    )
    entry = F.struct(F.when(F.col("low") == F.col("high"), 1).otherwise(2).alias("n"), "t0", "t1", "least")
    nodes = by_path.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("p", entry))).alias("paths"), F.flatten(F.collect_list("classes")).alias("classes")).where("size(classes) > 0")
    table = F.array(
        *[F.struct(*[F.lit(x).cast(k).alias(n) for x, (n, k) in zip(shape, (("class", "string"), ("path", "string"), ("least", "int"), ("most", "int"), ("datatype", "string"), ("natural", "boolean")))]) for shape in shapes]
    )

    def judged(shape: Column) -> Column:
        held = F.try_element_at("paths", shape["path"])
        n = F.coalesce(held["n"], F.lit(0))
        wrong_type = shape["datatype"].isNotNull() & ((held["t0"] != shape["datatype"]) | (held["t1"] != shape["datatype"]))
        messages = F.array(
            F.when(n < shape["least"], "minCount"), F.when(n > shape["most"], "maxCount"),
            F.when(wrong_type, "datatype"), F.when(shape["natural"] & (held["least"] < 0), "minInclusive"),
        )
        return F.transform(F.array_compact(messages), lambda m: F.struct(shape["path"].alias("path"), m.alias("message")))

    own = F.filter(table, lambda shape: F.array_contains("classes", shape["class"]))
    found = nodes.select("s", F.explode(F.array_distinct(F.flatten(F.transform(own, judged)))).alias("v"))
    return found.select(F.col("s").alias("focus"), "v.path", "v.message")


def violation_summary(graph: DataFrame) -> DataFrame:
    return shape_violations(graph).groupBy("path", "message").agg(F.count("*").alias("violations"))


def with_supertypes(graph: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph with a type triple for every superclass of a type (RDFS entailment).
    Input edges (sub, super); they are an ontology's, so their closure is small."""
    up = ancestors(edges).withColumnRenamed("sub", "o")
    more = graph.where("p = 'type'").join(up, "o").select("s", "p", F.col("super").alias("o"), "o_kind", "o_datatype")
    return graph.unionByName(more).distinct()


def ontology_inventory(graph: DataFrame) -> DataFrame:
    """(kind, name, uses): the classes and properties of a graph and how often each is used."""
    classes = graph.where("p = 'type'").select(F.lit("class").alias("kind"), F.col("o").alias("name"))
    properties = graph.select(F.lit("property").alias("kind"), F.col("p").alias("name"))
    return classes.unionByName(properties).groupBy("kind", "name").agg(F.count("*").alias("uses"))


def enough_triples(graph: DataFrame, least: int = 1000) -> int:
    """Number of triples; raises where there are fewer than ``least``."""
    found = graph.count()
    if found < least:
        raise ValueError(f"{found} triples, at least {least} are needed")
    return found


def ancestors(edges: DataFrame, steps: int = 32) -> DataFrame:
    """Transitive closure of (sub, super): rounds double the reach until nothing
    is added; for ontologies, whose size doesn't grow with the ledger."""
    from chainloom.sources.checkpoints import stored

    known = stored(edges.where("sub <> super").select("sub", "super").distinct())
    for _ in range(steps):
        longer = known.alias("a").join(known.alias("b"), F.col("a.super") == F.col("b.sub")).select("a.sub", "b.super").where("sub <> super")
        more = stored(known.union(longer).distinct())
        if more.count() == known.count():
            return more
        known = more
    return known
