import random
from itertools import combinations

import pytest

from chainloom.llm import glyphs
from chainloom.llm.glyphs import consistent, lookalike_pairs, normalise_text


@pytest.mark.parametrize(
    "text, form",
    [
        ("gіao dịch thеo", "giao dịch theo"), ("１６／０８", "16/08"), ("Ξ10", "Ξ10"), ("привет", "привет"), ("пpивет", "привет"), ("сасе", "cace"), ("diﬀerent", "different"),
        ("a​b﻿c", "abc"), ("a b", "a b"), ("ngày", "ngày"), ("2026‑06-08", "2026-06-08"), ("", ""), (None, None), ("​", ""), ("Case – Kept", "Case – Kept"),
    ],
)
def test_forms(text, form):
    assert consistent(text) == form


def test_form_is_stable():
    for text in ("Ｗｈｉｃｈ​ 10", "Тор 3", "o̲ο", "x" * 100000 + "а"):
        assert consistent(consistent(text)) == consistent(text)


def test_pairs_against_brute_force(spark):
    rows = [("c3", "pay"), ("c1", "pаy"), ("c2", "pay"), ("v1", "ｐａｙ"), ("v2", "Pay"), ("n", None), ("e", ""), ("z", "​"), ("v3", "p​ay"), ("v3", "p​ay"), ("w", "pay now")]
    frame = spark.createDataFrame(rows, "key string, text string")
    want = set()
    for (a, x), (b, y) in combinations(rows, 2):
        if x and y and x != y and consistent(x) and consistent(x) == consistent(y):
            want.add((min(a, b), max(a, b)))
    assert {tuple(r) for r in lookalike_pairs(frame).collect()} == want
    assert lookalike_pairs(frame.limit(0)).count() == 0


def test_output_column_may_exist(spark):
    frame = spark.createDataFrame([("pаy", "old")], "text string, form string")
    assert normalise_text(frame, "text", "form").collect()[0]["form"] == "pay"


def test_sentences_keep_their_script():
    russian, greek = "у нас есть хор", "το νερο ρει"
    assert consistent(russian) == russian and consistent("y нас есть xop") == russian
    assert consistent(greek) == greek
    assert consistent("The хор sang оn") == "The xop sang on" and consistent("хор") == "xop"


@pytest.mark.parametrize("text, form", [("ᏣᎳᎩ", "ᏣᎳᎩ"), ("Ꭲhe Ꭺge", "The Age"), ("սsed by all", "used by all"), ("հարց", "հարց")])
def test_further_scripts(text, form):
    assert consistent(text) == form


def test_respelling_is_stable_and_blind_to_the_spelling():
    """Whatever letters are swapped for their twins, one form comes out, and it stays."""
    rng = random.Random(4)
    for text in ("Top 5 native transfers of tokens", "у нас есть хор", "Показать все переводы to exchange", "ΟΝΟΜΑ και αριθμος", "каховка oracle"):
        form = consistent(text)
        assert consistent(form) == form
        for _ in range(40):
            swapped = "".join(rng.choice([ch, *glyphs_twins(ch)]) for ch in text)
            assert consistent(swapped) == form


def glyphs_twins(ch):
    latin = glyphs._TO_LATIN.get(ch, ch)
    return [t for t in (latin, *(twins[latin] for twins in glyphs._FROM_LATIN.values() if latin in twins)) if t != ch]
