import datetime as dt
import decimal
import random

import pytest
from pyspark.sql import functions as F

from chainloom.functions import text
from chainloom.functions.noise import change
from chainloom.operators import dataset, evaluation, extraction, linking, triples
from chainloom.operators.components import connected_components


def lexical_scores_of(question):
    """The score of every relation, word by word."""
    import re

    words = [w for w in re.split(r"[\W]+", question.lower()) if w]
    q = set(words) | (set(linking.TIME_TERMS) if set(words) & set(linking.TIME_CUES) else set())
    line, expanded, matched = f" {' '.join(words)} ", set(q), []
    for group in linking.SYNONYMS:
        hits = [p for p in group if f" {p} " in line]
        matched += hits
        if hits:
            expanded |= set(" ".join(group).split())
    out = {}
    for name, doc in linking.SCHEMA_DOCUMENTS.items():
        d = set(doc.split())
        out[name] = min(1.0, 0.6 * len(q & d) / len(q) + 0.3 * len(expanded & d) / len(expanded) + 0.1 * any(set(p.split()) <= d for p in matched))
    return out


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(45)] + [("n1", None), (None, None), ("x", "x")] + [("hub", f"leaf{i}") for i in range(80)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    got = dict(rows(connected_components(spark.createDataFrame(edges, "a string, b string"), "a", "b")))
    assert got == {n: min(m for m in parent if find(m) == find(n)) for n in parent}
    assert connected_components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_indel_similarity_against_lcs():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(15))) for _ in range(2))
        want = 1.0 if not a and not b else 2 * lcs(a, b) / (len(a) + len(b))
        assert abs(text.indel_similarity(a, b) - want) < 1e-12


def test_text_functions(spark):
    frame = spark.createDataFrame([("Đường  Ｘ ",), ("plain   Text",), ("",), (None,)], "t string")
    got = frame.select(text.fold_accents(F.col("t")), text.fold_text(F.col("t")), F.size(text.shingles(text.words(F.col("t")))), text.hash_bucket(F.col("t"))).collect()
    assert got[0][0] == "Duong  Ｘ " and got[0][1] == "đường x" and got[1][1] == "plain text"
    assert got[2][2] == 0 and got[3][0] is None and got[3][1] is None and got[3][3] is None


def test_held_out_overlap(spark):
    base = "one two three four five six seven eight nine ten"
    held = spark.createDataFrame([(base,), (None,), ("",)], "text string")
    own = spark.createDataFrame([("a", base), ("b", "one two three four five zzz seven eight nine ten"), ("c", None), ("d", ""), ("e", "short text"), ("f", base.upper())], "key string, text string")
    got = {r["key"]: r for r in dataset.held_out_overlap(own, held).collect()}
    assert got["a"]["leaked"] and got["f"]["leaked"] and not got["b"]["leaked"] and not got["e"]["leaked"] and set(got) == {"a", "b", "e", "f"}
    assert {r["key"] for r in dataset.without_held_out(own, held.where("length(text) > 0")).collect()} == {"b", "c", "d", "e"}


def test_kappa(spark):
    frame = spark.createDataFrame([("y", "y")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15 + [(None, "y")], "a string, b string")
    r = dataset.cohen_kappa(frame).first()
    assert (r["items"], r["observed"], r["kappa"]) == (50, 0.7, 0.4)
    none = dataset.cohen_kappa(frame.limit(0)).first()
    assert none["items"] == 0 and none["kappa"] is None
    assert dataset.cohen_kappa(spark.createDataFrame([("y", "y")], "a string, b string")).first()["kappa"] == 1.0


def test_fold_and_sample(spark):
    events = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 2, "b"), (None, 3, "c")], "k string, at int, v string")
    assert rows(dataset.fold_events(events, "k", ["at"], ["v"])) == [("k", "b", 3)]
    assert dataset.audit_sample(events.where("k is not null"), ["k"], "v", "s", 1).count() == 1


@pytest.mark.parametrize("kind", ["typo", "mixed_case", "abbreviation", "fragment"])
def test_noise_keeps_protected_spans(kind):
    source = "Show the transactions of account 0xabc and ABCD please"
    for seed in range(30):
        out = change(source, kind, random.Random(seed), ["0xabc", "ABCD"])
        assert "0xabc" in out and "ABCD" in out
        assert out == change(source, kind, random.Random(seed), ["0xabc", "ABCD"])
    assert change("", kind, random.Random(1), []) == ""


def test_multisets(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "n int, t string")
    b = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "m bigint, u string")
    r = evaluation.multiset_scores(a, b).first()
    assert (r["expected_rows"], r["actual_rows"], r["shared"], r["equal"]) == (3, 3, 2, False)
    assert abs(r["f1"] - 2 / 3) < 1e-12
    assert evaluation.multiset_scores(a, a.repartition(3)).first()["equal"]
    assert evaluation.multiset_scores(a.limit(0), b.limit(0)).first()["f1"] == 1.0


def test_token_f1(spark):
    frame = spark.createDataFrame([(1, "a a b", "a b b"), (2, "", "x"), (3, None, "x"), (4, "A-b", "a b")], "key int, a string, b string")
    assert dict(rows(evaluation.token_f1(frame))) == {1: 0.666666667, 2: 0.0, 4: 1.0}


def test_mcnemar():
    assert evaluation.exact_mcnemar(0, 0) == 1.0
    assert abs(evaluation.exact_mcnemar(1, 9) - 2 * 11 / 1024) < 1e-12
    assert evaluation.exact_mcnemar(5, 5) == 1.0


def test_bootstrap_interval(spark):
    frame = spark.range(2000).select(F.col("id").alias("prediction_id"), (F.col("id") % 4 == 0).alias("matched"))
    r = evaluation.bootstrap_ratio(frame, 200).first()
    assert r["n"] == 2000 and r["low"] < 0.25 < r["high"] and r["high"] - r["low"] < 0.06


def test_bootstrap_has_ten_thousand_replicates(spark):
    import inspect

    assert inspect.signature(evaluation.bootstrap_ratio).parameters["replicates"].default == 10_000
    frame = spark.range(400).select(F.col("id").alias("prediction_id"), (F.col("id") % 4 == 0).alias("matched"))
    r = evaluation.bootstrap_ratio(frame).first()
    exact = [0.2075, 0.2925]  # quantiles of Binomial(400, 1/4) / 400
    assert abs(r["low"] - exact[0]) <= 0.0025 and abs(r["high"] - exact[1]) <= 0.0025
    assert evaluation.bootstrap_ratio(frame.repartition(3)).first() == r
    assert tuple(evaluation.bootstrap_ratio(frame.limit(0)).first()) == (None, None, None, None)


def test_pairs_in_both_directions(spark):
    at = lambda d: dt.datetime(2026, 6, d)
    facts = spark.createDataFrame(
        [("t1", "a", "b", at(1), 1), ("t2", "b", "a", at(2), 2), ("t3", "b", "a", at(2), 3), ("t4", "a", None, at(3), 4), ("t5", "a", "c", at(3), 5)],
        "transaction_hash string, from_address string, to_address string, block_timestamp timestamp, value_wei int",
    )
    pairs = spark.createDataFrame([("g", "A", "b"), ("h", None, "b"), ("i", "a", "z")], "group_id string, account_a string, account_b string")
    assert [(r["group_id"], r["transaction_hash"]) for r in extraction.latest_between_pairs(facts, pairs).collect()] == [("g", "t3")]
    assert extraction.batch_lookup(facts, ["T1", "t5", None]).count() == 2


def test_neighbours_against_brute_force(spark):
    rng = random.Random(1)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)] + [(500, None)]
    frame = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    got = {(r["vec_id"], r["place"]): r["neighbour_id"] for r in linking.nearest_neighbours(frame, frame.where("vec_id < 20"), 3, block=7).collect()}
    unit = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] for i, v in vectors if v}
    for i in range(20):
        best = sorted(((-sum(a * b for a, b in zip(unit[i], unit[j])), j) for j in unit if j != i))[:3]
        assert [got[i, p] for p in (1, 2, 3)] == [j for _, j in best]


def test_rows_without_a_whole_vector_take_no_part(spark):
    rows_ = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [None, 1.0]), (None, [1.0, 0.0])]
    frame = spark.createDataFrame(rows_, "vec_id bigint, embedding array<double>")
    assert {tuple(r) for r in linking.nearest_neighbours(frame, frame, 3).collect()} == {(1, 1, 2), (2, 1, 1)}
    assert linking.nearest_neighbours(frame, frame.where("vec_id = 3")).count() == 0


def test_mentions(spark):
    labels = spark.createDataFrame(
        [("0x" + "a" * 40, "Acme Markets", "Acme Markets", ["Acme", "shared"]), ("0x" + "b" * 40, "Other", "Vault", ["shared", None])], "address string, owner string, primary_label string, aliases array<string>"
    )
    phrases = linking.entity_phrases(labels)
    assert ("shared",) not in rows(phrases.select("phrase"))
    texts = spark.createDataFrame([(1, "Paid to ACME   markets at 0x" + "A" * 40), (2, None), (3, ""), (4, "acme")], "key int, text string")
    assert rows(linking.longest_mentions(linking.phrase_mentions(texts, phrases)).select("key", "phrase")) == [(1, "acme markets"), (4, "acme")]
    assert rows(linking.address_mentions(texts, labels).select("key", "owner")) == [(1, "Acme Markets")]
    typed = spark.createDataFrame([(9, "acme marketz"), (8, "zzzz")], "key int, word string")
    assert rows(linking.fuzzy_mentions(typed, phrases).select("key", "owner")) == [(9, "Acme Markets")]
    assert ("acme", "Acme Markets") not in rows(linking.entity_words(labels)) and ("markets", "Acme Markets") in rows(linking.entity_words(labels))
    assert linking.link_schema(spark.createDataFrame([(1, None), (2, "")], "key int, question string")).count() == 0


def test_phrases_of_any_length_are_mentioned(spark):
    name = "the long acme markets holding company of europe"
    phrases = spark.createDataFrame([(name, "A"), ("acme markets", "B")], "phrase string, owner string")
    texts = spark.createDataFrame([(1, f"who paid {name.title()}?"), (2, "Acme Markets"), (3, name[:-7])], "key int, text string")
    found = linking.longest_mentions(linking.phrase_mentions(texts, phrases))
    assert sorted(rows(found.select("key", "owner"))) == [(1, "A"), (2, "B"), (3, "B")]
    assert linking.phrase_mentions(texts, phrases.limit(0)).count() == 0


def test_phrase_mentions_against_brute_force_without_broadcast(spark):
    rng = random.Random(11)
    vocabulary = ["acme", "of", "bank", "north", "x1", "é", "labs"]
    phrases = sorted({" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 6))).replace("é", "e") for _ in range(40)} | {"of"})
    lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12))).title() for _ in range(60)]
    found = linking.phrase_mentions(spark.createDataFrame(list(enumerate(lines)), "key bigint, text string"), spark.createDataFrame([(p, p) for p in phrases], "phrase string, owner string"))
    plain = [f" {' '.join(t.lower().replace('é', 'e').split())} " for t in lines]
    assert sorted(rows(found.select("key", "phrase"))) == sorted((i, p) for i, t in enumerate(plain) for p in phrases if len(p) >= 4 and f" {p} " in t)
    assert sorted(rows(linking.phrase_mentions(spark.createDataFrame([(1, "acme bank north")], "key int, text string"), spark.createDataFrame([("acme bank", "a"), ("acme bank north", "b")], "phrase string, owner string"), 2).select("owner"))) == [("a",)]
    # the size of a compressed file says nothing about the runs of a text
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_queries_over_whole_tables_against_brute_force(spark, tmp_path):
    import re
    import unicodedata

    from chainloom.plans import catalogue

    texts = ["Tổng Đơn", "счёт й", "取引 transfer", "e\u0301 token", "ǽ", "한글", "plain transaction value", "", None, "İstanbul từ ngày transactions from"]
    spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "case_id string, question string").write.parquet(f"{tmp_path}/evaluation_cases.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "prediction_id bigint, prediction string").write.parquet(f"{tmp_path}/evaluation_predictions.parquet")
    bare = lambda t: unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t.replace("đ", "d").replace("Đ", "D")) if unicodedata.category(c) != "Mn"))
    got = rows(catalogue.queries()["o147_accent_fold"](spark, str(tmp_path)))
    assert sorted(got) == sorted((f"c{i}", bare(t)) for i, t in enumerate(texts) if t is not None)
    want = []
    for i, t in enumerate(texts):
        if t and re.search(r"\w", t):
            scored = sorted((-round(v, 9), name) for name, v in lexical_scores_of(t).items() if round(v, 9) > 0)
            want += [(i, name, -score, place) for place, (score, name) in enumerate(scored[:3], 1)]
    assert sorted(rows(catalogue.queries()["o192_lexical_score"](spark, str(tmp_path)))) == sorted(want)


@pytest.mark.parametrize("least", [0.85, 0.7])
def test_fuzzy_mentions_against_brute_force(spark, least):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcd") for _ in range(rng.randint(4, 14))) for _ in range(40)]
    typed = [w[: rng.randrange(len(w))] + rng.choice("abcd") + w[rng.randrange(len(w)) :] for w in base] + base[:5]
    words_, phrases = sorted({w for w in typed if w}), sorted(set(base))
    got = linking.fuzzy_mentions(
        spark.createDataFrame([(i, w) for i, w in enumerate(words_)], "key int, word string"), spark.createDataFrame([(p, "o") for p in phrases], "phrase string, owner string"), least
    )
    assert set(rows(got.select("word", "phrase"))) == {(w, p) for w in words_ for p in phrases if text.indel_similarity(w, p) >= least}


def test_n_triples_round_trip_and_shapes(spark):
    graph = spark.createDataFrame(
        [
            ("tx/1", "type", "Transaction", "iri", None), ("tx/1", "hasFrom", "account/a", "iri", None), ("tx/1", "hasTo", "account/b", "iri", None), ("tx/1", "hasTo", "account/c", "iri", None),
            ("tx/1", "hasValue", "-1", "literal", "decimal"), ("tx/1", "hasTimestamp", 'odd "text"\n\\n', "literal", "string"),
        ],
        "s string, p string, o string, o_kind string, o_datatype string",
    )
    assert rows(triples.read_n_triples(triples.n_triples(graph))) == rows(graph)
    found = {(r["path"], r["message"]) for r in triples.shape_violations(graph).collect()}
    assert found == {("hasTo", "maxCount"), ("hasValue", "minInclusive"), ("hasTimestamp", "datatype"), ("hasBlockNumber", "minCount")}
    assert {(r["path"], r["message"]) for r in triples.shape_violations(graph.union(graph)).collect()} == found
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")], "sub string, super string")
    assert triples.ancestors(edges).count() == 12
    line = spark.createDataFrame([("Transaction", "Event"), ("Event", "Thing")], "sub string, super string")
    assert {r["o"] for r in triples.with_supertypes(graph, line).where("p = 'type'").collect()} == {"Transaction", "Event", "Thing"}
    assert {(r["kind"], r["name"], r["uses"]) for r in triples.ontology_inventory(graph).collect()} >= {("class", "Transaction", 1), ("property", "hasTo", 2)}
    assert triples.enough_triples(graph, 6) == 6
    with pytest.raises(ValueError):
        triples.enough_triples(graph)


def test_a_contract_creation_violates_nothing(spark):
    facts = spark.createDataFrame(
        [("0x1", "0xa", None, decimal.Decimal(5), 21000, 7, True, 9, dt.datetime(2026, 6, 1))],
        "transaction_hash string, from_address string, to_address string, value_wei decimal(38,0), receipt_gas_used bigint, gas_price_wei bigint, is_success boolean, block_number bigint, block_timestamp timestamp",
    )
    assert triples.shape_violations(triples.transaction_triples(facts)).count() == 0


def test_windows(spark):
    assert dataset.date_windows(spark, "2026-06-01", "2026-06-10", 7).count() == 3
    assert extraction.lagged_window(dt.date(2026, 7, 3)) == (dt.date(2026, 6, 3), dt.date(2026, 7, 1))
