import pytest
from pyspark.sql import functions as F

from chainloom.operators import baseline, statements

A, B = "0x" + "ab" * 20, "0x" + "cd" * 20


def test_typed_slots(spark):
    text = f"Token ABC for XYZ9, {A.upper().replace('0X', '0x')} and 0x{'12' * 32}, 2026-01-02, 7 of 2.5 x3 4.5.6 0x{'1' * 41}"
    s = spark.createDataFrame([(text,), (None,), ("",)], "q string").select(baseline.typed_slots(F.col("q")).alias("s")).collect()
    got = s[0]["s"]
    assert got["addresses"] == [A] and got["hashes"] == ["0x" + "12" * 32] and got["dates"] == ["2026-01-02"]
    assert got["numbers"] == ["7", "2.5"] and got["symbols"] == ["XYZ9"]
    assert s[2]["s"]["numbers"] == []


def test_classes(spark):
    rows = [("into decentralised exchanges",), ("Into Exchange accounts and bridges",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "q string").select(baseline.classes_named(F.col("q"))).collect()] == [["DexProtocol"], ["ExchangeAccount", "BridgeProtocol"], []]


@pytest.mark.parametrize(
    "question, template, how",
    [
        (f"List the latest 20 transactions sent by account {A} between 2026-01-01 and 2026-01-10.", "latest_sent", "seed"),
        (f"Which 5 transactions did {A} send most recently in the window 2026-01-01 to 2026-01-10?", "latest_sent", "seed"),
        (f"List latest 20 transactions that were sent by account {A} between 2026-01-01 and 2026-01-10", "latest_sent", "structural"),
        (f"List the latest 200 transactions sent by account {A} between 2026-01-01 and 2026-01-10.", None, None),
        (f"List the latest 20 transactions sent by account {A} between 2026-01-01 and 2026-03-10.", None, None),
        (f"List the latest 20 transactions sent by account {A} between 2026-01-10 and 2026-01-01.", None, None),
        (f"List the latest 20 transactions sent by account {A} or {B} between 2026-01-01 and 2026-01-10.", None, None),
        ("What is love between 2026-01-01 and 2026-01-10?", None, None),
        ("", None, None), (None, None, None), ("transactions " * 1000, None, None),
    ],
)
def test_answers_and_abstention(spark, question, template, how):
    out = baseline.answer_by_rule(spark.createDataFrame([("k", question)], "key string, question string")).collect()
    assert [(r["template"], r["how"]) for r in out] == ([(template, how)] if template else [])


def test_a_tie_of_seeds_abstains(spark):
    t = baseline.TEMPLATES[0]
    twin = baseline.Template("twin", t.seeds, t.slots, t.relation, t.sql)
    frame = spark.createDataFrame([("k", "Count all transactions recorded between 2026-01-01 and 2026-01-02.")], "key string, question string")
    assert baseline.answer_by_rule(frame, (t,)).first()["sql"] == "SELECT COUNT(*) AS transaction_count FROM `transaction_facts`(DATE '2026-01-01', DATE '2026-01-02')"
    assert baseline.answer_by_rule(frame, (t, twin)).count() == 0


def test_rendered_statements_are_safe(spark):
    rows = [(t.name, t.sql) for t in baseline.TEMPLATES]
    out = statements.extraction_status(spark.createDataFrame(rows, "key string, response string")).collect()
    assert {r["status"] for r in out} == {"ok"}


@pytest.mark.parametrize(
    "response, status",
    [
        (None, "empty"), ("  \n", "empty"), ("```sql\n\n```", "empty"), ("Here it is: SELECT 1", "prose"), ("```sql\nSELECT a FROM token_dimension\n```", "ok"),
        ("text ```sql\nSELECT a FROM token_dimension\n```", "prose"), ("DROP TABLE x", "unsafe_sql"), ("select a from p.d.token_dimension", "ok"), ("42", "prose"),
        ("SELECT a FROM token_dimension; SELECT b", "unsafe_sql"), ("SELECT a FROM token_dimension -- no", "unsafe_sql"), ("SELECT '--' AS a FROM token_dimension", "ok"),
        ("SELECT * FROM token_dimension", "unsafe_sql"), ("SELECT t.* FROM token_dimension t", "unsafe_sql"), ("SELECT COUNT(*) AS n FROM token_dimension", "ok"), ("SELECT a, 2 * b FROM token_dimension", "ok"),
        ("SELECT a FROM secrets", "unsafe_sql"), ("SELECT a FROM token_dimension, secrets", "unsafe_sql"), ("SELECT a FROM token_dimension WHERE x IN (SELECT y FROM secrets)", "unsafe_sql"),
        ("SELECT a FROM token_dimension WHERE EXISTS(SELECT 1 FROM secrets)", "unsafe_sql"), ("SELECT a FROM token_dimension WHERE f(g(h((SELECT 1 FROM secrets)))) = 1", "unsafe_sql"),
        ("WITH x AS (SELECT a FROM token_dimension) SELECT a FROM x", "ok"), ("WITH x AS (SELECT a FROM secrets) SELECT a FROM x", "unsafe_sql"), ("SELECT 1", "unsafe_sql"),
        ("SELECT a FROM transaction_facts(DATE '2026-01-01', DATE '2026-01-02') f JOIN block_facts(DATE '2026-01-01', DATE '2026-01-02') b ON f.n = b.n", "ok"),
        ("SELECT EXTRACT(YEAR FROM ts) AS y FROM block_facts", "ok"), ("SELECT a FROM (SELECT b AS a FROM token_dimension)", "ok"), ("SELECT a FROM token_dimension WHERE (b = 'x", "invalid_sql"),
        ("SELECT a FROM UNNEST([1]) a", "unsafe_sql"), ("SELECT 'it''s (' AS a FROM token_dimension", "ok"),
    ],
)
def test_extraction(spark, response, status):
    assert statements.extraction_status(spark.createDataFrame([(1, response)], "key int, response string")).first()["status"] == status


def test_structure(spark):
    rows = [("SELECT  a AS b\nFROM `t` WHERE c='X y';", "select a as b from t where c = 'X y'"), ("select 'A' from t", "select 'a' from t")]
    got = spark.createDataFrame(rows, "a string, b string").select(statements.structure(F.col("a")) == statements.structure(F.col("b"))).collect()
    assert [r[0] for r in got] == [True, False]


def test_very_long_texts(spark):
    """Open and closed literals, brackets, lists and words of any length are read in one pass."""
    texts = ["SELECT '" + "a''" * 50000 + "' AS x FROM token_dimension", "SELECT '" + "\\'" * 50000, "x " * 50000, "select a from t where " + "(" * 3000, "select a from " + "b, " * 20000 + "c", "\n" * 50000 + "x"]
    frame = spark.createDataFrame(list(enumerate(texts)), "key int, response string")
    got = {r["key"]: r["status"] for r in statements.extraction_status(frame).collect()}
    assert got == {0: "ok", 1: "invalid_sql", 2: "prose", 3: "invalid_sql", 4: "unsafe_sql", 5: "prose"}
    assert baseline.answer_by_rule(frame.select("key", F.col("response").alias("question"))).count() == 0
