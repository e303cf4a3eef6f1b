"""Problem 2: text that looks identical but is spelled with different characters.

Every token is resolved to one script.  Each character contributes the set of
scripts it could be read in (its own, plus those in which a twin letter looks
the same); the sets are intersected across the token:

* the intersection holds several scripts (a whole-script confusable) -> the one in
  which most of the text's unequivocal tokens are written, else Latin.  This
  covers tokens written wholly in look-alikes of another script, and leaves short
  words of a Cyrillic or Greek sentence in its script;
* it holds one script (mixed tokens such as "pаyment" with a Cyrillic a) -> every letter is respelled in that script;
* it is empty (a token that truly mixes scripts) -> letters stay as they are.

What a letter looks like decides its set, so texts that look alike have the same
sets, votes and spellings.

Before that, compatibility forms (full width, ligatures) are folded, invisible
characters dropped, every blank becomes an ordinary space, hyphen twins become
``-`` and accents are composed (NFC).  Letter case, accents, punctuation and
wording are never touched.

Defined results: null stays null; a text without visible characters becomes the
empty string and is no case in ``lookalike_pairs``.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Latin letters and their twins in other scripts.
CYRILLIC_TWINS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "ӓ": "ä",
    "ё": "ë", "ї": "ï", "ӧ": "ö", "Ё": "Ë", "Ї": "Ï",
}
GREEK_TWINS = {
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "υ": "u", "γ": "y", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z",
    "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ό": "ó",
}
ARMENIAN_TWINS = {"օ": "o", "ս": "u", "հ": "h", "ո": "n", "զ": "q", "ց": "g", "յ": "j", "Օ": "O", "Տ": "S", "Լ": "L"}
CHEROKEE_TWINS = {
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S",
    "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
}
# Letters of the IPA and similar blocks that look like plain Latin ones.
LATIN_TWINS = {"ɑ": "a", "ɡ": "g", "ı": "ı", "ℓ": "l"}
HYPHEN_TWINS = {"‐": "-", "‑": "-", "‒": "-", "−": "-", "﹣": "-"}

INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿\U000e0000-\U000e0fff]")
_BLANK = re.compile(r"\s+")
_PLAIN = re.compile(r"[\x21-\x7e]+(?: [\x21-\x7e]+)*")
_TOKEN = re.compile(r"[^\W_]+(?:[̀-ͯ][^\W_]*)*")

_TO_LATIN = CYRILLIC_TWINS | GREEK_TWINS | ARMENIAN_TWINS | CHEROKEE_TWINS
_FROM_LATIN = {
    script: {v: k for k, v in twins.items()}
    for script, twins in (("Cyrillic", CYRILLIC_TWINS), ("Greek", GREEK_TWINS), ("Armenian", ARMENIAN_TWINS), ("Cherokee", CHEROKEE_TWINS))
}
# First and last code points.
_BLOCKS = (("Greek", 0x0370, 0x03FF), ("Greek", 0x1F00, 0x1FFF), ("Cyrillic", 0x0400, 0x052F), ("Armenian", 0x0530, 0x058F), ("Cherokee", 0x13A0, 0x13FF))
_SPAN = re.compile("[Ͱ-Ͽἀ-῿Ѐ-ԯ԰-֏Ꭰ-᏿]")


def script_of(ch: str) -> str | None:
    """Script of a letter; None for characters common to all scripts."""
    code = ord(ch)
    for script, first, last in _BLOCKS:
        if first <= code <= last:
            return script
    if not ch.isalpha():
        return None
    return "Latin" if code < 0x0250 or 0x1E00 <= code <= 0x1EFF else "Other"


@lru_cache(maxsize=20_000)
def readable_scripts(ch: str) -> frozenset[str] | None:
    """Scripts in which a letter could be read without changing its looks."""
    own = script_of(ch)
    if own is None:
        return None
    found = {own}
    if ch in _TO_LATIN:
        found.add("Latin")
    latin = _TO_LATIN.get(ch, ch)
    for script, twins in _FROM_LATIN.items():
        if latin in twins:
            found.add(script)
    return frozenset(found)


@lru_cache(maxsize=50_000)
def shared_scripts(token: str) -> frozenset[str] | None:
    """Scripts in which all letters of a token can be read; None without letters."""
    common: frozenset[str] | None = None
    for ch in token:
        scripts = readable_scripts(ch)
        if scripts is not None:
            common = scripts if common is None else common & scripts
    return common


def written_script(text: str) -> str:
    """Script of most unequivocal tokens; Latin without any and at a tie."""
    votes: dict[str, int] = {}
    for token in _TOKEN.findall(text):
        scripts = shared_scripts(token)
        if scripts is not None and len(scripts) == 1:
            (script,) = scripts
            votes[script] = votes.get(script, 0) + 1
    return max(votes, key=lambda s: (votes[s], s == "Latin", s), default="Latin")


def respell(token: str, text_script: str = "Latin") -> str:
    """One token in the script shared by all of its letters."""
    common = shared_scripts(token)
    if common is None:
        return token  # digits
    latin = "".join(_TO_LATIN.get(ch, ch) for ch in token)
    if not common:
        return latin  # letters that no single script can spell
    script = text_script if text_script in common else "Latin" if "Latin" in common else min(common)
    return "".join(_FROM_LATIN[script].get(ch, old) for ch, old in zip(latin, token)) if script in _FROM_LATIN else latin if script == "Latin" else token


def consistent(text: str | None) -> str | None:
    """The one form of a text shared by everything that looks like it."""
    if text is None:
        return None
    if _PLAIN.fullmatch(text):
        return text
    text = unicodedata.normalize("NFKC", INVISIBLE.sub("", text))
    text = INVISIBLE.sub("", text)
    text = "".join(HYPHEN_TWINS.get(ch, LATIN_TWINS.get(ch, ch)) for ch in text)
    if _SPAN.search(text):
        script = written_script(text)
        text = unicodedata.normalize("NFC", _TOKEN.sub(lambda m: respell(m.group(), script), text))
    return _BLANK.sub(" ", text).strip()


@F.pandas_udf(StringType())
def _consistent_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else consistent(t)).astype(object)


def consistent_form(text: Column) -> Column:
    """Column form of ``consistent``; plain ASCII texts never leave the JVM."""
    plain = text.rlike(r"^[\x21-\x7e]+( [\x21-\x7e]+)*$")
    return F.when(text.isNull() | plain, text).otherwise(_consistent_udf(F.when(~plain, text)))


def normalise_text(df: DataFrame, column: str, output: str = "consistent_text") -> DataFrame:
    """Append the consistent form of ``column``; an existing ``output`` is replaced."""
    return df.withColumn(output, consistent_form(F.col(f"`{column}`")))


def lookalike_classes(texts: DataFrame) -> DataFrame:
    """Input (key, text); output (key, class_id, variants): rows whose form occurs
    in more than one spelling, with a class id that is equal for equal looks.

    The spellings are reduced map-side to (form, text) before any row moves, so
    copies of one text, however many, are one record per task.
    """
    formed = texts.select("key", "text", consistent_form(F.col("text")).alias("form")).where("text is not null and form <> ''")
    mixed = (
        formed.groupBy("form")
        .agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
        .where("lo <> hi")
        .select("form")
    )
    return formed.join(mixed, "form").select("key", "text", "form", F.sha2("form", 256).alias("class_id"))


def lookalike_pairs(texts: DataFrame) -> DataFrame:
    """Input (key, text); output (key_a, key_b) with key_a < key_b: the texts look
    the same and are not the same string.

    Works on spellings: pairs of distinct spellings of one form first, then the
    keys of both.  Copies of one spelling never meet each other, so a form held
    by a third of all rows costs only the pairs that are results.
    """
    rows = lookalike_classes(texts).select("class_id", "text", "key")
    spellings = rows.select("class_id", "text").distinct()
    pairs = (
        spellings.withColumnRenamed("text", "text_a")
        .join(spellings.withColumnRenamed("text", "text_b"), "class_id")
        .where("text_a < text_b")
    )
    left = rows.select("class_id", F.col("text").alias("text_a"), F.col("key").alias("left_key"))
    right = rows.select("class_id", F.col("text").alias("text_b"), F.col("key").alias("right_key"))
    return (
        pairs.join(left, ["class_id", "text_a"])
        .join(right, ["class_id", "text_b"])
        .select(F.least("left_key", "right_key").alias("key_a"), F.greatest("left_key", "right_key").alias("key_b"))
    )
