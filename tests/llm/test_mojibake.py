import pytest

from chainloom.llm.mojibake import CHAINS, CHAIN_NAMES, _posterior, _weights, garbled_documents, passages_of, repair_passage, restored_documents, undo

SCHEMA = "doc_id bigint, source string, text string"
GOOD = ["Người duyệt ghi: câu hỏi rõ nghĩa nhưng thời gian còn mơ hồ.", "La migración terminará mañana según la comisión.", "Der Schlüssel für die Überweisung enthält fünf ungültige Zeilen.", "Столбец может быть пустым; таких строк много.", "The naïve count wasn’t “fine” at the café – 70 µs."]


def damage(text, chain):
    for true, read in reversed(CHAINS[chain]):
        text = "".join(chr(b) if read == "latin-1" else _read(b, read) for b in text.encode(true))
    return text


def _read(byte, encoding):
    try:
        return bytes([byte]).decode(encoding)
    except UnicodeDecodeError:
        return chr(byte)


@pytest.mark.parametrize("chain", ["utf_8>cp1252", "utf_8>mac_roman", "utf_8>cp437", "utf_8>cp1250", "utf_8>cp1252>utf_8>cp1252"])
def test_undo_is_the_inverse(chain):
    for text in GOOD:
        for word in text.split():
            if not word.isascii():
                assert undo(damage(word, chain), CHAINS[chain]) == word


def test_undo_refuses_what_cannot_be():
    assert undo("VERSÃO", CHAINS["utf_8>cp1252"]) is None
    assert undo("привет", CHAINS["utf_8>cp1252"]) is None


def test_passages_keep_their_places():
    text = "plain. É aqui.\nsólo esto\n\nplain again"
    for place, piece in passages_of(text):
        assert text[place : place + len(piece)] == piece and not piece.isascii()
    assert passages_of("only ascii. text") == []


def test_found_and_restored(spark):
    rows = [(i, f"s{i % 2}", GOOD[i % len(GOOD)]) for i in range(400)]
    broken = {1000: ("utf_8>cp1252", 0), 1001: ("utf_8>mac_roman", 1), 1002: ("utf_8>cp437", 2), 1003: ("cp1251>cp1252", 3), 1004: ("utf_8>cp1252>utf_8>cp1252", 4)}
    rows += [(d, "s0", "Intro.\n" + damage(GOOD[g], chain) + "\n" + GOOD[0]) for d, (chain, g) in broken.items()]
    rows += [(2000, "s1", "La migraci�n termina."), (2001, None, None), (2002, None, ""), (2003, "s1", "ASCII only."), (2004, None, GOOD[1]), (1000, "s0", "Intro.\n" + damage(GOOD[0], "utf_8>cp1252") + "\n" + GOOD[0])]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert {r["doc_id"] for r in garbled_documents(frame).collect()} == {*broken, 2000}
    fixed = {r["doc_id"]: r for r in restored_documents(frame).collect()}
    for d, (chain, g) in broken.items():
        assert fixed[d]["repaired"] == "Intro.\n" + GOOD[g] + "\n" + GOOD[0]
    assert fixed[2000]["lost"] and fixed[2000]["repaired"] == "La migraci�n termina."


def test_trademark_after_a_capital_is_no_damage(spark):
    rows = [(i, "s", "La marque RELEVÉ® s’écrit toujours en capitales. " + GOOD[4]) for i in range(60)]
    assert garbled_documents(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_weak_evidence_counts_where_a_source_suffers(spark):
    """One weak passage in each of three sources: only where others of its source
    are damaged alike beyond doubt is it held damaged; the field lifts a source of
    which little is known."""

    def scored(rows):
        k = len(CHAIN_NAMES)
        gains = lambda chain, gain: [0.0] + [gain if i == chain else -1e6 for i in range(1, k)]
        return spark.createDataFrame([(s, gains(1, g)) for s, g in rows], "source string, gains array<double>")

    strong, weak = 40.0, 7.0
    rows = [("bad", strong)] * 60 + [("bad", weak), ("good", weak), ("small", weak)]
    totals = spark.createDataFrame([("bad", 300), ("good", 100_000), ("small", 2)], "source string, n bigint")
    weights, field = _weights(scored(rows), totals, 3)
    out = {r["source"]: r["damaged"] for r in _posterior(scored(rows).where("abs(gains[1]) < 20"), weights, 3).collect()}
    assert out["bad"] > 0.9 and out["good"] < 0.5 and out["good"] < out["small"] < out["bad"]
    assert 0.0003 < field[1] < 0.001
    alone, _ = _weights(scored(rows[60:]), totals, 3)
    assert all(r["damaged"] < 0.5 for r in _posterior(scored(rows[60:]), alone, 3).collect())


def test_repair_leaves_other_tokens():
    assert repair_passage("plain SÃ£o plain", "utf_8>cp1252") == "plain São plain"
    assert repair_passage("x", "clean") == "x"


def test_no_rows(spark):
    assert garbled_documents(spark.createDataFrame([], SCHEMA)).count() == 0
