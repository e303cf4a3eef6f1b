import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom.functions.text import indel_similarity
from chainloom.operators import mentions as M
from chainloom.operators.similar import Trigrams, Vectors, similar_pairs

PHRASES = "phrase string, target string, signal boolean"
KNOWN = [("orbit capital", "Orbit Capital", False), ("orbit", "Orbit Capital", True), ("summit bridge", "Summit Bridge", False), ("bank of rome", "Bank of Rome", False), ("summit bridge", "Other Summit", False)]
A = "0x" + "ab" * 20


@pytest.mark.parametrize("text", ["Ａ  b\tc", "éx", "ﬁn al", " lead and trail  ", "가각 한", "ǅ İx", "", "a​ \n b"])
def test_offsets_point_into_the_source(text):
    import unicodedata

    plain, starts, ends = M.normalised(text)
    assert plain == " ".join(unicodedata.normalize("NFKC", text).casefold().split())
    assert len(plain) == len(starts) == len(ends) and all(0 <= a < b <= len(text) for a, b in zip(starts, ends))
    assert starts == sorted(starts)
    for ch, a, b in zip(plain, starts, ends):
        assert ch in unicodedata.normalize("NFKC", text[a:b]).casefold() or ch == " "


def test_linking(spark):
    texts = [("a", f"Sent by ORBIT to {A.upper().replace('0X', '0x')}"), ("b", "from Orbit Capitel and to the Bank  of Rome"), ("c", "orbit of a star"), ("d", None), ("e", ""), ("f", "Summit Bridge, Summit Bridge"), ("g", "the of to")]
    labels = spark.createDataFrame([(A, "Labelled Owner")], "address string, owner string")
    out = M.link_entities(spark.createDataFrame(texts, "key string, text string"), labels, spark.createDataFrame(KNOWN, PHRASES)).collect()
    got = {}
    source = dict(texts)
    for r in out:
        got.setdefault(r["key"], []).append((source[r["key"]][r["start"] : r["end"]], r["stage"], r["targets"]))
    assert sorted(got["a"]) == sorted([("ORBIT", "exact", ["Orbit Capital"]), (A.upper().replace("0X", "0x"), "address", ["Labelled Owner"])])
    assert sorted(got["b"]) == [("Bank  of Rome", "exact", ["Bank of Rome"]), ("Orbit Capitel", "fuzzy", ["Orbit Capital"])]
    assert [x[2] for x in got["f"]] == [["Other Summit", "Summit Bridge"]] * 2 and set(got) == {"a", "b", "f"}


def test_fuzzy_proposals_against_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(5, 9))) for _ in range(40)]
    phrases = [(w, f"t{i}", False) for i, w in enumerate(words[:20])]
    windows = M.token_windows(spark.createDataFrame([(i, w) for i, w in enumerate(words)], "key int, text string"))
    got = {r["key"]: (r["targets"], r["score"]) for r in M.fuzzy_proposals(windows, spark.createDataFrame(phrases, PHRASES), 0.7).collect()}
    for i, w in enumerate(words):
        scored = sorted((-indel_similarity(w, p), t) for p, t, _ in phrases if indel_similarity(w, p) >= 0.7)
        assert (i in got) == bool(scored)
        if scored:
            assert got[i][0] == [t for s, t in scored if s - scored[0][0] < 0.03][:3] and abs(got[i][1] + scored[0][0]) < 1e-6


@pytest.mark.parametrize("with_vectors", [False, True])
def test_linking_and_plans_never_broadcast(spark, with_vectors):
    texts = spark.createDataFrame([("a", f"from ORBIT to {A}"), ("b", "to Orbit Capitel"), ("c", "Summit Bridges Bridge")], "key string, text string")
    labels = spark.createDataFrame([(A, "Labelled Owner")], "address string, owner string")
    found = M.link_entities(texts, labels, spark.createDataFrame(KNOWN, PHRASES), with_vectors)
    assert {(r["key"], r["stage"]) for r in found.collect()} == {("a", "exact"), ("a", "address"), ("b", "fuzzy"), ("c", "fuzzy")}
    plans = M.resolution_plans(found, texts)
    assert {r["key"]: r["status"] for r in plans.collect()}["a"] == "resolved"
    for frame in (found, plans, M.address_proposals(texts, labels)):
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()


def test_fuzzy_windows_are_never_broadcast(spark):
    windows = M.token_windows(spark.createDataFrame([(1, "from Orbit Capitel"), (2, "Sumit  Bridge"), (3, "sumit bridge of")], "key int, text string"))
    phrases = spark.createDataFrame(KNOWN, PHRASES)
    found = M.fuzzy_proposals(M.uncovered(windows, M.exact_proposals(windows, phrases)), phrases)
    assert {(r["key"], r["start"], r["end"]) for r in found.collect()} == {(1, 5, 18), (2, 0, 13), (3, 0, 12)}
    # the size of a small file says nothing about the windows and keys made of it
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_vectors_against_brute_force(spark):
    texts = [(1, "Orbit Capitals"), (2, "nothing alike"), (3, "sumit bridge")]
    windows = M.token_windows(spark.createDataFrame(texts, "key int, text string"))
    rows = windows.collect()
    got = {(r["key"], r["start"], r["end"]) for r in M.vector_proposals(windows, spark.createDataFrame(KNOWN, PHRASES), 0.75, block=2).collect()}
    want = {(w["key"], w["start"], w["end"]) for w in rows for p, _, s in KNOWN if float(M.hashed_vector(w["window"]) @ M.hashed_vector(p)) >= 0.75 and not (w["tokens"] == 1 and s and not w["shouted"])}
    assert got == want and got


def test_vectors_at_the_threshold_count_in_every_cell(spark):
    # inner product exactly 0.75: 32-bit vectors made it 0.74999994 for some pairs
    rng = random.Random(5)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(4, 12))) for _ in range(150)]
    counts = lambda t: np.round(M.hashed_vector(t).astype(float) / np.min(np.abs(M.hashed_vector(t)[np.nonzero(M.hashed_vector(t))])), 3)
    phrases = [(w, w, False) for w in words[:60]]
    want = set()
    for w in words:
        for p in words[:60]:
            a, b = counts(w), counts(p)
            if float(a @ b) / ((a @ a) * (b @ b)) ** 0.5 >= 0.75 - 1e-6:
                want.add((w, p))
    windows = M.token_windows(spark.createDataFrame([(i, w) for i, w in enumerate(words)], "key int, text string"))
    for block in (7, 1000):
        got = similar_pairs(F.col("window"), windows, F.col("phrase"), spark.createDataFrame(phrases, PHRASES), Trigrams(0.75), block).collect()
        assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)
    other = similar_pairs(F.col("window"), windows, F.col("phrase"), spark.createDataFrame(phrases, PHRASES), Vectors(0.75 - 1e-6, M.hashed_vector), 50).collect()
    assert {(r["a"], r["b"]) for r in other} == want


def test_greedy_selection(spark):
    rows = [("k", 0, 5, "exact", ["x"], 1.0), ("k", 3, 12, "fuzzy", ["y"], 0.9), ("k", 11, 13, "address", ["z"], 1.0), ("k", 5, 9, "exact", ["b"], 1.0), ("k", 5, 9, "exact", ["a"], 1.0), ("l", 0, 1, "exact", ["q"], 1.0)]
    out = M.select_spans(spark.createDataFrame(rows, "key string, start int, end int, stage string, targets array<string>, score double")).collect()
    assert {(r["key"], r["start"], r["targets"][0]) for r in out} == {("k", 0, "x"), ("k", 5, "a"), ("k", 11, "z"), ("l", 0, "q")}


@pytest.mark.parametrize(
    "before, want",
    [("sent by ", "from"), ("from ", "from"), ("into ", "to"), ("from x to ", "to"), ("to x from ", "from"), ("from and to ", "unspecified"), ("to / from ", "unspecified"), ("", "unspecified"), ("from " + "x" * 45 + " ", "unspecified"), ("fromage ", "unspecified"), ("OUT  OF ", "from")],
)
def test_direction(spark, before, want):
    frame = spark.createDataFrame([(before + "Orbit", len(before))], "text string, start int")
    assert frame.select(M.direction(F.col("text"), F.col("start"))).first()[0] == want


def test_plans_and_scores(spark):
    texts = spark.createDataFrame([("a", "from Orbit to Rome"), ("b", "Orbit"), ("c", "nothing"), ("d", "any Summit"), ("e", None)], "key string, text string")
    schema = "key string, start int, end int, stage string, targets array<string>, score double"
    found = spark.createDataFrame([("a", 5, 10, "exact", ["o"], 1.0), ("a", 14, 18, "exact", ["r"], 1.0), ("b", 0, 5, "exact", ["o", "p"], 1.0), ("d", 4, 10, "exact", ["s", "t"], 1.0)], schema)
    got = {r["key"]: r["status"] for r in M.resolution_plans(found, texts).collect()}
    assert got == {"a": "resolved", "b": "unresolved", "c": "unresolved", "d": "partial"}
    gold = spark.createDataFrame([("a", 5, 10, "o"), ("a", 14, 18, "x"), ("z", 0, 1, "y")], "key string, start int, end int, target string")
    r = M.mention_scores(found, gold).first()
    assert (r["predicted"], r["gold"], r["hits"]) == (4, 3, 2) and r["precision"] == 0.5 and abs(r["f1"] - 4 / 7) < 1e-12 and abs(r["top1_accuracy"] - 1 / 3) < 1e-12
    assert M.mention_scores(found.limit(0), gold.limit(0)).first()["f1"] == 0.0


def test_encoders_and_coverage(spark):
    rows = [("a", 0.9, 0.7, 0.8, 5.0), ("b", 0.8, 0.79, 0.8, 5.0), ("c", 0.8, 0.8, 0.8, 9.0), ("d", 0.7, 0.9, 0.8, 1.0)]
    got = {r["model"]: r["place"] for r in M.choose_encoder(spark.createDataFrame(rows, "model string, metric_vi double, metric_en double, baseline_en double, latency_ms double")).collect()}
    assert got == {"a": None, "c": 1, "b": 2, "d": 3}
    labels = spark.createDataFrame([("o", "X", "token"), ("p", "X", "treasury"), ("q", "Y", None), ("r", "Z", "token")], "owner string, concept_class string, address_role string")
    roles = spark.createDataFrame([("X", "treasury"), ("Z", "treasury")], "concept_class string, required_role string")
    assert {(r["concept_class"], r["owners"], r["covered"]) for r in M.class_coverage(labels, roles).collect()} == {("X", 1, True), ("Y", 0, False), ("Z", 0, False)}


def _written(spark):
    """Bytes shuffled so far in this session."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    every = sc.statusStore().executorList(False)
    return sum(every.apply(i).totalShuffleWrite() for i in range(every.size()))


def test_vectors_of_a_frequent_window_write_no_pairs_of_places_and_phrases(spark):
    # 400 places, each of them like 400 phrases: 160,000 rows went through three shuffles
    windows = M.token_windows(spark.createDataFrame([(f"key {i:037d}", "fee collector") for i in range(400)], "key string, text string")).where("tokens = 2")
    phrases = spark.createDataFrame([(f"fee collector {i}", f"target {i:03d}", False) for i in range(400)], PHRASES)
    before = _written(spark)
    got = M.vector_proposals(windows, phrases, block=150).collect()
    assert _written(spark) - before < 300_000
    scores = sorted((-round(float(M.hashed_vector("fee collector").astype(float) @ M.hashed_vector(f"fee collector {i}").astype(float)), 6), f"target {i:03d}") for i in range(400))
    want = [t for s, t in scores if s - scores[0][0] < M.CLOSE][:3]
    assert len(got) == 400 and {tuple(r["targets"]) for r in got} == {tuple(want)} and abs(got[0]["score"] + scores[0][0]) < 1e-5


@pytest.mark.parametrize("block", [3, 1000])
def test_best_targets_against_brute_force(spark, block):
    rng = random.Random(8)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 7))) for _ in range(40)]
    texts = [(i, rng.choice([w, w.upper(), f"{w} {rng.choice(words)}", f"x{w}"])) for i, w in enumerate(words)] + [(90, "㏂ " + words[0]), (91, "a" * 400), (92, None)]
    # targets with several phrases, phrases with several targets, signals that count in capitals only, unknown signals
    phrases = [(w, f"t{rng.randint(0, 12)}", rng.choice([True, False, None])) for w in words for _ in range(2)] + [("a.m", "noon", False), ("a m", "morning", False), ("a" * 399, "long", False), (None, "none", False)]
    windows = M.token_windows(spark.createDataFrame(texts, "key int, text string"))
    unit = lambda t: M.hashed_vector(t).astype(float)
    best = {}
    for r in windows.collect():
        for p, t, signal in phrases:
            if p is None or (r["tokens"] == 1 and signal is not False and not r["shouted"]):
                continue
            a, b = unit(r["window"]), unit(p)
            s = round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 6) if a.any() and b.any() else 0
            if s >= 0.5:
                mine = best.setdefault((r["key"], r["start"], r["end"]), {})
                mine[t] = max(s, mine.get(t, 0))
    got = {(r["key"], r["start"], r["end"]): r for r in M.vector_proposals(windows, spark.createDataFrame(phrases, PHRASES), 0.5, block=block).collect()}
    assert set(got) == set(best) and (90, 0, 1) in got and (91, 0, 400) in got
    for place, targets in best.items():
        ordered = sorted((-s, t) for t, s in targets.items())
        assert got[place]["targets"] == [t for s, t in ordered if s - ordered[0][0] < M.CLOSE][:3] and abs(got[place]["score"] + ordered[0][0]) < 1e-5


def test_codes_of_many_texts_are_those_of_each():
    rng = random.Random(2)
    kind = Trigrams(0.75)
    texts = ["", "a", "aaaa" * 90, "\U0001f600 x"] + ["".join(rng.choice("abcd é漢") for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    sizes, low, high, _ = kind.together(texts)
    assert [kind.encode(t)[:2] for t in texts] == [(n, a | b << 64) for n, a, b in zip(sizes.tolist(), low.tolist(), high.tolist())]
