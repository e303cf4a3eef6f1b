import pytest

from chainloom.llm.pairs import continued_shapes, defective_pairs, is_copy, judge, judged_pairs, language_of, length_spikes, shortened_shapes, statement_shape, truncation_evidence

QUESTION = "Show the 10 largest transactions worth 5 ETH or more from 2026-01-01 until 2026-01-20."
SQL = "SELECT transaction_hash AS tx FROM `a.b.facts`(DATE '2026-01-01', DATE '2026-01-20') WHERE value_wei >= 5 ORDER BY value_wei DESC, tx ASC LIMIT 10"


@pytest.mark.parametrize("text", [None, "", "  ", "None", "N/A", "n/a.", "null", "```sql\n```", "...", "-", "​﻿", "<no output>", "(không có)"])
def test_nothing_is_empty(text):
    assert judge(QUESTION, text)[0] == "empty"


@pytest.mark.parametrize(
    "text",
    ["I'm sorry, but I am not able to write this query.", "Xin lỗi, tôi không được phép viết câu truy vấn này.", QUESTION + "\n\nI have to decline this request.", "As an assistant, I can’t help with questions about accounts."],
)
def test_refusals(text):
    assert judge(QUESTION, text)[0] == "refusal"


@pytest.mark.parametrize(
    "text", [QUESTION, QUESTION.lower(), f'"{QUESTION}"', f"Question: {QUESTION}\nAnswer:", f"{QUESTION} {QUESTION}", f"```sql\n{QUESTION}\n```", "Ｓｈｏｗ" + QUESTION[4:]]
)
def test_copies(text):
    assert judge(QUESTION, text)[0] == "copied_question"


@pytest.mark.parametrize("text", ["None.", "Không có.", "Nothing.", "No", "Có", "không", "result", "Output", "0"])
def test_short_answers_are_answers(text):
    """A sentence that says there is nothing answers the question."""
    assert judge(QUESTION, text)[0] is None


def test_copies_of_short_questions():
    assert is_copy("Why?", "why") and is_copy("Why?", "Question: why?") and not is_copy("Why?", "That's why.") and not is_copy("5", "55")


def test_copies_of_a_framed_question():
    framed = "Q: " + QUESTION
    assert judge(framed, f"{framed} {framed}")[0] == judge(framed, framed)[0] == judge(framed, QUESTION)[0] == "copied_question"


def test_copy_of_another_question_is_none():
    assert not is_copy(QUESTION, QUESTION.replace("10", "20"))


@pytest.mark.parametrize("cut", [20, 60, 75, 100, 115, len(SQL) - 9])
def test_cut_statements_stop_open(cut):
    defect, shape, ending, _ = judge(QUESTION, SQL[:cut])
    assert ending in ("open", "shape")


@pytest.mark.parametrize("text, ending", [("Here it is.\n\n```s", "open"), ("Here it is.\n```sql\n", "open"), ("Here it is.\n```sql\n```", "done"), ("```\nx = 1.\n```\nHere it is.", "done")])
def test_code_that_only_begins(text, ending):
    assert judge(QUESTION, text)[2] == ending


@pytest.mark.parametrize("text", [SQL, f"```sql\n{SQL};\n```", f"I can't tell how fresh the labels are, but this is it.\n```\n{SQL}\n```", f"-- {QUESTION}\n{SQL}", "34", "The answer is 71.", f"{QUESTION}\n\n{SQL}"])
def test_usable_answers(text):
    defect, _, ending, _ = judge(QUESTION, text)
    assert defect is None and ending != "open"


@pytest.mark.parametrize("text", ["La fecha final no se incluye.", f"Das Enddatum zählt nicht mit.\n```\n{SQL}\n```", "结束日期不包括在内。", "Kết quả gồm mỗi dòng một giao dịch, mới nhất đứng trước."])
def test_other_languages(text):
    assert judge(QUESTION, text)[0] == "wrong_language"


def test_missing_accents_are_no_other_language():
    assert language_of("Duoi day la cau lenh cho giai doan ban hoi.") == "vi"
    assert judge("Hiển thị 10 giao dịch lớn nhất từ ngày 01/01/2026.", f"Day la cau lenh tra ve cac dong duoc yeu cau.\n```\n{SQL}\n```")[0] is None


def test_shape_abstracts_values_and_names():
    a, _ = statement_shape("SELECT x AS p FROM t WHERE y = 'a' ORDER BY p LIMIT 3")
    b, _ = statement_shape("select x as q\nfrom t where y='b' order by q limit 70;")
    assert a == b
    assert statement_shape("select x from t where (y = 'a")[1]


def test_shortened_shapes_are_found_over_partition_borders(spark):
    long = "select a from t where b = S order by a0 desc limit N"
    rows = [(long, 500), ("select a from t where b = S", 3), ("select a from t where b = S order by a0", 2), ("select z from t", 4), ("select a from t where c = S", 400)]
    out = shortened_shapes(spark.createDataFrame(rows, "shape string, n bigint").repartition(4))
    assert {r["shape"] for r in out.collect()} == {"select a from t where b = S", "select a from t where b = S order by a0"}


@pytest.mark.parametrize("parts", [1, 2, 3, 7])
def test_continuations_do_not_depend_on_partitions(spark, parts):
    stem = "select x from t where b = S"
    rows = [(stem, 3), (stem + " and c = N", 1), (stem + " and c = N limit N", 2), (stem + " order by x limit N", 500), ("select x from tab where b = S", 40)]
    rows += [("select x from t", 2), ("select x from t where b = S group by a1", 1), ("select x from t where b = S group by a10", 90), ("select y from u", 9)]
    want = {}
    for a, n in rows:
        on = [m for b, m in rows if b != a and b.startswith(a) and (b[len(a)] == " " or not a.endswith((" S", " N", " a1")))]
        if on:
            want[a] = (n, max(on))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = {r["shape"]: (r["n"], r["best"]) for r in continued_shapes(spark.createDataFrame(rows, "shape string, n bigint")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert out == want and out["select x from t"] == (2, 500)


def test_cuts_inside_words_and_hot_cuts_at_a_limit(spark):
    full = "SELECT hash AS item FROM facts WHERE value >= 5 ORDER BY block_number DESC, item ASC LIMIT {}"
    texts = [full.format(i) for i in range(10, 40)]
    word, name = texts[0][: texts[0].index("_number")], texts[0][: texts[0].index("em ASC")]
    hot = texts[0][: texts[0].index(" DESC")]  # far over a fifth of the full ones
    answers = texts + [word, name] + [hot] * 20
    rows = [(i, "r", f"c{i}", t) for i, t in enumerate(answers)]
    cases = spark.createDataFrame([(f"c{i}", "Show the largest items.") for i in range(len(rows))], "case_id string, question string")
    got = {r["prediction_id"]: r["defect"] for r in defective_pairs(spark.createDataFrame(rows, "prediction_id bigint, run_id string, case_id string, prediction string"), cases).collect()}
    assert got == {i: "truncated" for i in range(len(texts), len(rows))}


def test_sentences_are_judged_by_their_neighbours(spark):
    """Prose without a full stop is cut where other responses go on, and only there."""
    whole = ["The result has one row per match, newest first.", "No join is needed here."]
    cut, free = "No join is needed here. The result has one row per,", "The result fits the window"
    answers = whole + [cut, free, whole[0].rstrip(".")]
    rows = [(i, "r", f"c{i}", t) for i, t in enumerate(answers)]
    cases = spark.createDataFrame([(f"c{i}", "Show the largest items.") for i in range(len(rows))], "case_id string, question string")
    predictions = spark.createDataFrame(rows, "prediction_id bigint, run_id string, case_id string, prediction string")
    found = {r["prediction_id"]: r["evidence"] for r in truncation_evidence(judged_pairs(predictions, cases)).collect()}
    assert found == {0: None, 1: None, 2: "neighbour", 3: None, 4: None}


def test_stops_at_a_length_limit_are_cut(spark):
    """Nothing continues these texts, but far too many have one length."""
    texts = [chr(97 + i % 26) * 12 + " " + chr(97 + i // 26) * 12 + " runs on and on" for i in range(60)]
    rest = [f"Answer number {'x' * (i % 30)} ends here." for i in range(120)]
    rows = [(i, "r", None, t) for i, t in enumerate(texts + rest)]
    predictions = spark.createDataFrame(rows, "prediction_id bigint, run_id string, case_id string, prediction string")
    found = {r["prediction_id"]: r["evidence"] for r in truncation_evidence(judged_pairs(predictions, spark.createDataFrame([], "case_id string, question string"))).collect()}
    assert found == {i: "length" if i < 60 else None for i in range(180)}


def test_spikes(spark):
    rows = [("r", 200 + i % 40) for i in range(200)] + [("r", 220)] * 90 + [("other", 220)] * 3
    found = length_spikes(spark.createDataFrame(rows, "run_id string, length int")).collect()
    assert [tuple(r) for r in found] == [("r", 220)]


def test_table_with_nulls_ties_clashes_and_no_rows(spark):
    cases = spark.createDataFrame([("c1", QUESTION, "x"), ("c1", QUESTION, "y"), (None, "lost", "z"), ("c2", None, "w")], "case_id string, question string, prediction string")
    rows = [(1, "r", "c1", None), (2, "r", "c1", SQL), (3, "r", None, "null"), (4, "r", "c2", "x " * 200000 + "the"), (4, "r", "c2", SQL), (5, None, "c9", QUESTION), (6, "r", "c1", QUESTION)]
    schema = "prediction_id bigint, run_id string, case_id string, prediction string"
    got = {tuple(r) for r in defective_pairs(spark.createDataFrame(rows, schema), cases).collect()}
    assert {(1, "empty"), (3, "empty"), (6, "copied_question")} <= got
    assert not {2, 5} & {k for k, _ in got}
    assert defective_pairs(spark.createDataFrame([], schema), cases).count() == 0
