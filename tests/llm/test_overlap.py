import random

import pytest

from chainloom.llm.overlap import allowed, banded_distance, canonical_question, canonical_statement, common_words, overlap_found, overlap_pairs, overlap_report, same_question, segments, trained_lengths, windows

CASES = "case_id string, question string, gold_sql string, split string, source string"
HELD = "name string, questions array<string>"


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, text, k):
    for _ in range(k):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + text[i + 1 :], text[:i] + rng.choice("abxyz ") + text[i:], text[:i] + rng.choice("abxyz") + text[i + 1 :]])
    return text


def test_banded_distance_is_exact_within_the_band():
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(12)))
        b = "".join(rng.choice("ab") for _ in range(rng.randrange(12)))
        assert banded_distance(a, b, 3) == min(4, plain_distance(a, b))


@pytest.mark.parametrize("k", [1, 2, 4])
def test_segments_and_windows_lose_no_pair(k):
    rng = random.Random(k)
    for _ in range(400):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randint(k + 2, 40)))
        b = changed(rng, a, rng.randint(0, k)) or "a"
        if plain_distance(a, b) <= k:
            keys = {(i, a[s : s + n]) for i, (s, n) in enumerate(segments(len(a), k))}
            assert any((i, b[s : s + n]) in keys for i, s, n in windows(len(b), len(a), k))


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("Show the 5 largest transactions from 2026-01-01 until 2026-01-09.", "Please tell me: show the 5 biggest txns from 2026-01-01 to 2026-01-09! Thanks", True),
        ("Show the 5 largest transactions from 2026-01-01 until 2026-01-09.", "Show the 5 largest tarnsactions from 2026-01-01 utnil 2026-01-09.", True),
        ("Show the 5 largest transactions from 2026-01-01 until 2026-01-09.", "Show the 6 largest transactions from 2026-01-01 until 2026-01-09.", False),
        ("What volume of ABC was transferred on 2026-01-01?", "What volume of ABD was transferred on 2026-01-01?", False),
        ("Hiển thị 5 giao dịch mới nhất từ ngày 01/02/2026.", "hien thi 5 gd gần đây nhất từ ngày 2026-02-01", True),
    ],
)
def test_questions(a, b, same):
    (sa, x), (sb, y) = canonical_question(a), canonical_question(b)
    assert (sa == sb and same_question(x, y, frozenset())) is same


def test_common_words_are_no_typos():
    assert not same_question("list # successful transactions", "list # unsuccessful transactions", frozenset(["successful", "unsuccessful"]))


@pytest.mark.parametrize("copies", [1, 2, 400])
def test_repeated_typos_are_found_all_the_same(spark, copies):
    cases = [(f"t{i}", "Which tarnsactions moved 5 ETH?", None, "train", "s") for i in range(copies)] + [("e", "Which transactions moved 5 ETH?", None, "test", "s")]
    cases += [(f"x{i}", f"Which transactions did account {'abcdefghij'[i]} send?", None, "train", "s") for i in range(10)]
    found = overlap_found(spark.createDataFrame(cases, CASES), spark.createDataFrame([], HELD))
    assert {tuple(r) for r in found.collect()} == {("e", f"t{i}") for i in range(copies)}


def test_common_words_are_no_slips_and_no_single_bodies(spark):
    rows = [(str(i), "list # transactions") for i in range(60)] + [(str(i), "show # transactions") for i in range(60)]
    rows += [(str(i), f"{verb} # tarnsactions") for i in range(3) for verb in ("list", "show")] + [(str(i), "count # acounts") for i in range(60)]
    found = common_words(spark.createDataFrame(rows, "signature string, body string"))
    assert found == {"list", "show", "transactions"}


def test_edits_grow_with_the_length_and_lose_no_pair():
    rng = random.Random(5)
    for size in (*range(15, 130, 7), 600):
        a = "".join(rng.choice("abcd ") for _ in range(size))
        for _ in range(20):
            b = changed(rng, a, rng.randint(0, allowed(size))) or "a"
            if plain_distance(a, b) <= allowed(len(b)) < len(b):
                assert len(b) in trained_lengths(len(a))
                keys = {(i, b[s : s + n]) for i, (s, n) in enumerate(segments(len(b), allowed(len(b))))}
                assert any((i, a[s : s + n]) in keys for i, s, n in windows(len(a), len(b), allowed(len(b))))


def test_five_typos_in_a_long_text_and_a_short_word_more(spark):
    asked = "Show the five largest successful transactions between two labelled exchange accounts after block 77 by value."
    typed = "Show the five lrgest succesful transctions betwen two labelled exchnge accounts after block 77 by value."
    other = asked.replace("successful", "unsuccessful")
    cases = [("t1", typed, None, "train", "s"), ("t2", asked.replace("Show", "Show me"), None, "train", "s"), ("t3", "Show me the five largst" + asked[21:], None, "train", "s"), ("t4", other + " Now", None, "train", "s")]
    cases += [(f"x{i}", f"List {w} accounts {v}", None, "train", "s") for i, (w, v) in enumerate((w, v) for w in ("successful", "unsuccessful") for v in ("here", "there", "everywhere"))]
    found = overlap_found(spark.createDataFrame(cases, CASES), spark.createDataFrame([("h", [asked])], HELD))
    assert {tuple(r) for r in found.collect()} == {("h#0", "t1"), ("h#0", "t2"), ("h#0", "t3")}


def test_statements():
    a = canonical_statement("SELECT x AS p FROM `d.t`(DATE '2026-01-01') WHERE y = 5 ORDER BY p;")
    assert a == canonical_statement("select x as out_1\n from d.t(date '2026-01-01') where y=5 order by out_1")
    assert a != canonical_statement("select x as p from d.t(date '2026-01-01') where y = 6 order by p")
    assert canonical_statement(None) is None and canonical_statement("") is None


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("select sum(x) total from t order by total", "SELECT SUM(x) AS s FROM t ORDER BY s", True),
        ("select a p, count(*) n from t group by p", "select a as q, count(*) as m from t group by q", True),
        ("select case when a then 1 else 2 end kind from t", "select case when a then 1 else 2 end as k from t", True),
        ("select sum(x) over (partition by y) w from t", "select sum(x) over (partition by y) as v from t", True),
        ("select sum(x) over (partition by y) w from t", "select sum(x) over (partition by z) as v from t", False),
        ("select a + interval 7 day d from t", "select a + interval 7 hour as d from t", False),
        ("select a, b from t", "select a b from t", False),
        ("select distinct a from t", "select a from t", False),
        ("select x as total from t where total = 5", "select x as total from t where total = 6", False),
    ],
)
def test_output_names(a, b, same):
    assert (canonical_statement(a) == canonical_statement(b)) is same


def test_report_counts_what_the_pairs_hold(spark):
    rng = random.Random(6)
    texts = [f"How many transfers did token {t} see from 2026-01-0{d} until 2026-02-0{d}?" for t in ("ABCD", "EFGH") for d in range(1, 5)]
    rows = [(f"c{i}", rng.choice(texts), f"select count(*) n{i % 3} from t where d = {rng.randrange(6)}", rng.choice(["train", "validation", "test"]), rng.choice(["a", "b", None])) for i in range(60)]
    cases = spark.createDataFrame(rows, "case_id string, question string, gold_sql string, split string, source string")
    held = spark.createDataFrame([("h1", texts[:3]), ("h2", [texts[0], None, "nothing alike"])], "name string, questions array<string>")
    pairs = [tuple(r) for r in overlap_pairs(cases, held).collect()]
    place = {r[0]: (r[3], r[4] or "") for r in rows} | {f"{n}#{i}": ("held_out", n) for n in ("h1", "h2") for i in range(3)}
    want = {}
    for key, group in place.items():
        if group[0] != "train":
            w = want.setdefault(group, [0, set(), set()])
            w[0] += 1
            for t, e in pairs:
                if e == key:
                    w[1].add(e)
                    w[2].add(t)
    got = {(r["split"], r["source"]): (r["records"], r["overlapping"], r["train_records"]) for r in overlap_report(cases, held).collect()}
    assert got == {g: (n, len(e), len(t)) for g, (n, e, t) in want.items()} and len(pairs) == len(set(pairs))


def test_tables(spark):
    q = "Show the 5 largest transactions from 2026-01-01 until 2026-01-09."
    cases = [
        ("a1", q, "select 1 as x", "train", "s"), ("a2", q.upper(), "select 9", "test", "s"), ("a3", "Something else entirely?", "SELECT 1 AS y;", "validation", "s"), ("a4", None, None, "train", None),
        ("a5", q, "select 77", None, "s"), (None, q, "select 1 as x", "test", "s"), ("a6", "", "", "test", "s"), ("a1", q, "select 1 as x", "train", "s"),
    ]
    held = [("h", ["nothing of that", "Hi, " + q.replace("largest", "largset"), None]), (None, [q]), ("e", None)]
    c, h = spark.createDataFrame(cases, CASES), spark.createDataFrame(held, HELD)
    assert {tuple(r) for r in overlap_found(c, h).collect()} == {("a1", "a2"), ("a1", "a3"), ("a1", "h#1")}
    report = {(r["split"], r["source"]): tuple(r)[2:] for r in overlap_report(c, h).collect()}
    assert report["held_out", "h"] == (3, 1, 1) and report["validation", "s"] == (1, 1, 1)
    assert overlap_found(c.limit(0), h.limit(0)).count() == 0
