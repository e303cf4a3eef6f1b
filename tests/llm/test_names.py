import random
from itertools import combinations

import pytest

from chainloom.llm.names import Parser, _within, damerau, linked_pairs, metric_cells, radius_join, within_one, words_of

SCHEMA = "address_lower string, owner string, primary_label string, aliases array<string>"


def test_words():
    assert words_of("Delta.TisupefudProtocol") == ["delta", "tisupefud", "protocol"]
    assert words_of("DL G.m.b.H.") == ["dl"]
    assert words_of("Fee Collector 16 - Daridapur", True) == ["daridapur"]
    assert words_of("unlabelled") == [] and words_of(None) == [] and words_of("The  Co.") == []


@pytest.mark.parametrize("a, b, near", [("abc", "abc", True), ("abc", "acb", True), ("abc", "abd", True), ("abc", "ab", True), ("abc", "abcd", True), ("abc", "cba", False), ("abc", "a", False), ("", "a", True)])
def test_within_one(a, b, near):
    assert within_one(a, b) is near is (damerau(a, b) <= 1)


def test_radius_join_against_brute_force(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 6))) for _ in range(160)})
    got = {tuple(r) for r in radius_join(spark.createDataFrame([(w,) for w in words], "core string")).collect()}
    assert got == {(a, b) for a, b in combinations(words, 2) if damerau(a, b) <= 1}


@pytest.mark.parametrize("seed", [1, 2])
def test_metric_cells_lose_no_pair(spark, seed):
    """Pivots with cells of radius 0 and 1, short and long words, transpositions at
    the borders; every pair is in the home cell of one of both."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcd") for _ in range(n)) for n in (5, 9, 14, 22, 24, 26, 40)]

    def typed(word):
        i, way = rng.randrange(len(word) - 1), rng.randrange(4)
        return [word[:i] + word[i + 1] + word[i] + word[i + 2 :], word[:i] + word[i + 1 :], word[:i] + "x" + word[i:], word[:i] + "y" + word[i + 1 :]][way]

    words = sorted({w for stem in stems for _ in range(12) for w in (stem, typed(stem), typed(typed(stem)))})
    rows = [(w, 9 if w in stems else rng.choice([1, 1, 3])) for w in words]
    frame = spark.createDataFrame(rows, "core string, support int")
    want = {(a, b) for a, b in combinations(words, 2) if damerau(a, b) <= 1}
    assert {tuple(r) for r in radius_join(frame).collect()} == want
    cells = metric_cells(frame).collect()
    assert sorted(r["core"] for r in cells if r["home"]) == words
    assert all(damerau(r["core"], r["pivot"]) <= 2 for r in cells) and len(cells) > len(words)


def test_bounded_distances_in_the_jvm(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 6))) for _ in range(60)})
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for edits in (1, 2):
        got = {(r["a"], r["b"]): r["d"] for r in _within(pairs, "a", "b", edits).collect()}
        assert got == {(a, b): damerau(a, b) for a in words for b in words if damerau(a, b) <= edits}


def test_distance_is_a_metric():
    rng = random.Random(3)
    for _ in range(300):
        a, b, c = ("".join(rng.choice("abc") for _ in range(rng.randrange(7))) for _ in range(3))
        assert damerau(a, b) == damerau(b, a) and damerau(a, c) <= damerau(a, b) + damerau(b, c) and (damerau(a, b) == 0) == (a == b)
    assert damerau("ca", "abc") == 2


def test_frequent_names_keep_their_core(spark):
    """However often a surname stands beside other words, it is a core."""
    firsts = ["Daniel", "Victoria", "Ximerol", "Yolakum", "Zerinax", "Wopalek"]
    rows = [(f"{i}-{j}", f"{first} Sivahupes" if j else f"Sivahupes, {first}", None, None) for i, first in enumerate(firsts) for j in range(2)]
    assert {tuple(r) for r in linked_pairs(spark.createDataFrame(rows, SCHEMA)).collect()} >= {(f"{i}-0", f"{i}-1") for i in range(2)}
    parser = Parser({"sivahupes": 40, "velvet": 90})
    assert parser.record("Daniel Sivahupes", None, None)["core"] == "sivahupes"
    assert parser.record("Velvet Sivahupes Markets", None, None)["core"] == "sivahupes"


def test_names_of_any_script_and_names_like_listed_words():
    parser = Parser({})
    assert parser.record("Binance Ltd", None, None)["core"] == "binance" and parser.record("Kraken", None, None)["core"] == "=kraken"
    assert parser.record("Центральный Банк", None, None)["core"] and parser.record("中央銀行", None, None)["core"] == "=中央銀行"
    assert [parser.record(x, None, None) for x in ("", "  ", "unlabelled", None, "Foundation Network", "x")] == [None] * 6


def test_profile_of_a_person():
    p = Parser(frozenset()).record("Vinuhosik, D. P.", "Danny Vinuhosik Deployer", ["VINUHOSIK Daniel", None, ""])
    assert (p["core"], p["first"], p["middle"], p["person"]) == ("vinuhosik", "daniel", "p", True)


def test_links(spark):
    rows = [
        ("0x1", "Daniel Vinuhosik", "Vault", None), ("0x2", "Danny Vinuhosik", "Vault (Daniel Vinuhosik)", []), ("0x3", "Vinuhosik, D.", "x", ["daniel vinuhosik"]),
        ("0x4", "Daniel Vinuhosik", "Router", None), ("0x5", "Victoria Vinuhosik", "Router", None), ("0x6", None, "Vault - Daniel Vinuhsoik", None),
        ("0x7", "Cobalt Zigimigos Markets", "x", None), ("0x8", "cobalt zigimigos mkts ltd", "x", None), ("0x9", "Cobalt Nusesolax Markets", "x", None),
        ("0xa", None, None, None), ("0xb", "", "unlabelled", [None]), (None, "Daniel Vinuhosik", "x", None), ("0x8", "cobalt zigimigos mkts ltd", "x", None),
    ]
    got = {tuple(r) for r in linked_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {("0x1", "0x2"), ("0x1", "0x3"), ("0x1", "0x6"), ("0x2", "0x3"), ("0x2", "0x4"), ("0x2", "0x6"), ("0x3", "0x4"), ("0x3", "0x6"), ("0x4", "0x6"), ("0x7", "0x8")}
    assert got == want


@pytest.mark.parametrize("times", [1, 10])
def test_frequent_typos_are_linked_where_the_profile_agrees(spark, times):
    spelled = ["Daniel Vinuhosik"] * 6 * times + ["Daniel Vinuhosikk"] * 4 * times + ["Victoria Vinuhosig"] * 4 * times
    rows = [(f"0x{i:03}", name, None, None) for i, name in enumerate(spelled)]
    got = {tuple(r) for r in linked_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(a, b) for a, x, *_ in rows for b, y, *_ in rows if a < b and {x, y} == {"Daniel Vinuhosik", "Daniel Vinuhosikk"}}


def test_short_cores_link_to_equal_ones(spark):
    rows = [("1", "Acme Ltd", None, None), ("2", "ACME Limited", None, None), ("3", "Acmi Ltd", None, None), ("4", "Kix Lep", None, None), ("5", "Lep, Kix", None, None), ("6", "Ax", None, None), ("7", "Ax Ltd", None, None)]
    assert {tuple(r) for r in linked_pairs(spark.createDataFrame(rows, SCHEMA)).collect()} == {("1", "2"), ("4", "5")}


def test_no_rows(spark):
    assert linked_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
