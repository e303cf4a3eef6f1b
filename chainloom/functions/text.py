"""Text functions as column expressions; Arrow UDFs only where the JVM has none.

Every function maps null to null and takes texts of any length.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: An address stands alone: a longer hexadecimal number holds none.
ADDRESS = r"(?<![0-9a-zA-Z_])0x[0-9a-f]{40}(?![0-9a-zA-Z_])"
ISO_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"


def _accents() -> tuple[str, str]:
    """Precomposed Latin letters and their base letters, by decomposition."""
    pairs = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii():
            pairs[chr(code)] = base
    pairs |= {"đ": "d", "Đ": "D"}
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _accents()


def fold_accents(text: Column) -> Column:
    """Letters without accents, inside code generation (one ``translate``)."""
    return F.translate(F.regexp_replace(text, "[\\u0300-\\u036f]", ""), _FROM, _TO)


@F.pandas_udf(StringType())
def _without_marks(texts: pd.Series) -> pd.Series:
    def fold(text: str | None) -> str | None:
        if text is None:
            return None
        apart = unicodedata.normalize("NFD", text.translate({0x111: "d", 0x110: "D"}))
        return unicodedata.normalize("NFC", "".join(c for c in apart if unicodedata.category(c) != "Mn"))

    return texts.map(fold)


def fold_marks(text: Column) -> Column:
    """Texts of any script without combining marks; ASCII texts stay in the JVM."""
    plain = text.rlike(r"^[\x00-\x7f]*$")
    return F.when(text.isNull() | plain, text).otherwise(_without_marks(F.when(~plain, text)))


@F.pandas_udf(StringType())
def _fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def fold_text(text: Column) -> Column:
    """NFKC, case folding and collapsed white space; ASCII texts stay in the JVM."""
    plain = text.rlike(r"^[\x00-\x7f]*$")
    cheap = F.trim(F.regexp_replace(F.lower(text), r"[\s\x1c-\x1f]+", " "))
    return F.when(text.isNull() | plain, cheap).otherwise(_fold(F.when(~plain, text)))


def normalised_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance by the longer length; 0 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, F.levenshtein(a, b) / longest).when(longest == 0, F.lit(0.0))


def indel_similarity(a: str, b: str) -> float:
    """2 LCS / (len a + len b), the similarity by insertions and deletions only.

    Bit-parallel: one machine word of Python holds a whole row.
    """
    if not a and not b:
        return 1.0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        u = row & where.get(ch, 0)
        row = (row + u | row - u) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_similarity(x, y) for x, y in zip(a, b)], dtype="float64")


def hash_bucket(text: Column, buckets: int = 100) -> Column:
    """First 32 bits of SHA-256 modulo ``buckets``."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint") % buckets


def words(text: Column) -> Column:
    """Words of letters and digits in lower case, in order."""
    return F.filter(F.split(F.lower(text), "[^0-9a-z]+"), lambda w: w != "")


def shingles(tokens: Column, size: int = 5) -> Column:
    """Distinct runs of ``size`` words, joined by a space; a shorter text is one run."""
    n = F.size(tokens)
    runs = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.concat_ws(" ", F.slice(tokens, i, size)))
    return F.when(n >= size, F.array_distinct(runs)).when(n > 0, F.array(F.concat_ws(" ", tokens))).otherwise(F.array().cast("array<string>"))


def addresses_in(text: Column) -> Column:
    """Addresses named in a text, in order, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({ADDRESS})"), F.lit(1))


def dates_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({ISO_DATE})"), F.lit(1))


def url_quoted(text: Column) -> Column:
    """Percent encoding of everything but letters, digits and ``_.-~``."""
    out = F.url_encode(text)
    for made, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(made), F.lit(wanted))
    return out


def statement_shape(sql: Column) -> Column:
    """A statement with literals as ``?``, in lower case, blanks collapsed."""
    out = F.lower(sql)
    for pattern, put in ((r"'[^']*'", "?"), (r"\b[0-9]+\b", "?"), (r"[`;]", ""), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, put)
    return F.trim(out)
