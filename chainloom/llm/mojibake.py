"""Problem 8: texts that were decoded with the wrong character encoding.

The unit is a passage (a sentence or line with anything beyond ASCII).  Each
passage has a latent *chain*: how its original was damaged, from ``clean`` over
"UTF-8 bytes read as cp1252" (once or twice) to "cp1251 bytes read as koi8-r".
Undoing a chain gives a candidate original; its likelihood comes from a
character-pair model of the corpus.  The chain weights differ by source and are
unknown, so they are estimated by expectation-maximization: posteriors of all
passages given the weights, then weights as mean posteriors over the records of
the field and of each source; a source's weights are drawn to the field's like by
POOL further passages.  Damage starts out as nearly impossible (PRIOR_DAMAGE), so
only what passages without any doubt show makes weaker evidence (a single word
that would read better otherwise) count, where a source or the field is known to
suffer from that chain.  Rounds end when the field's weights stand still.  After the first estimate the character model is trained again on
the passages held clean and the estimate is repeated.

Each passage is repaired by its posterior.  U+FFFD stands for bytes that are
gone: such a passage is garbled and restored only outside of the lost places.

Sizes: the character model is a hashed table of fixed size (2**MODEL_BITS
counters); weights are one row a source and stay a DataFrame.  Only sums per
source move between tasks.

Defined results: null, empty and ASCII-only texts are never garbled; ``repaired``
equals the text where nothing was found; equal texts of one source come out
equal.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.sources.checkpoints import stored

MODEL_BITS = 20
#: Sources whose weights may go to every executor (some 10 MB); more are joined.
MOST_SOURCES = 30_000
#: Share of damaged passages that is assumed before any is seen.
PRIOR_DAMAGE = 1e-4
#: Passages by which the field weighs in each source's weights.
POOL = 2000.0
#: EM ends where no weight of the field changes by more than this share of all damage (or after MOST_ROUNDS).
STILL, MOST_ROUNDS = 0.02, 12
#: Found documents whose ids may go to every executor (some 16 MB); more are joined.
MOST_IDS = 1_000_000
#: Log penalty of leaving a token as it is inside a damaged passage.
PENALTY = 9.0
#: A chain that gains no more than this can't compete with ``clean``.
HOPELESS = -8.0
#: Only such texts can be garbled.
NOT_ASCII = r"text is not null and text rlike '[^\\x00-\\x7f]'"
PASSAGE = re.compile(r"(?<=[.!?。！？])[ \t]+|[\r\n]+")
_LOST = "�"
_WORD = re.compile(r"[ \t\r\n]+")


def _to_byte(encoding: str) -> dict[str, int]:
    """Character -> byte; bytes without a character stand for themselves (C1)."""
    table: dict[str, int] = {}
    for b in range(256):
        try:
            ch = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            ch = chr(b)
        table.setdefault(ch, b)
    for b in range(0x80, 0xA0):  # the latin-1 reading of the same bytes
        table.setdefault(chr(b), b)
    return table


# Encodings in which text is misread, and the pairs (true, read).
READ_AS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1254", "cp1258", "koi8_r", "cp866")
SINGLE_BYTE = (
    ("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("cp866", "cp1252"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp1251", "cp866"),
    ("cp866", "cp1251"), ("cp1258", "cp1252"), ("cp1252", "cp1258"), ("gbk", "cp1252"), ("big5", "cp1252"), ("shift_jis", "cp1252"),
    ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp437"), ("cp437", "cp1252"), ("cp1252", "cp850"), ("cp850", "cp1252"),
    ("cp1250", "cp1252"), ("cp1252", "cp1250"), ("cp1252", "cp1251"), ("cp1253", "cp1252"), ("iso8859_2", "cp1252"), ("cp1252", "iso8859_2"),
)
_BYTES = {e: _to_byte(e) for e in {*READ_AS, *(read for _, read in SINGLE_BYTE)}}
#: Chains by name; each is the list of (true, read) steps to undo in turn.
CHAINS: dict[str, list[tuple[str, str]]] = (
    {"clean": []}
    | {f"utf_8>{e}": [("utf_8", e)] for e in READ_AS}
    | {f"utf_8>{e}>utf_8>{e}": [("utf_8", e)] * 2 for e in READ_AS[:6]}
    | {"utf_8>cp1252 three times": [("utf_8", "cp1252")] * 3}
    | {f"{true}>{read}": [(true, read)] for true, read in SINGLE_BYTE}
)
CHAIN_NAMES = tuple(CHAINS)
UTF8_CHAINS = frozenset(k for k, name in enumerate(CHAIN_NAMES) if name.startswith("utf_8"))


def undo(token: str, steps: list[tuple[str, str]]) -> str | None:
    """The token before the damage, None where the chain cannot have made it."""
    for true, read in steps:
        table = _BYTES[read]
        try:
            token = bytes([table[ch] for ch in token]).decode(true)
        except (KeyError, UnicodeDecodeError):
            return None
    if not token.isprintable() and any(unicodedata.category(ch) in ("Cc", "Cn", "Co") for ch in token):
        return None
    return unicodedata.normalize("NFC", token)


def _pair(a: str, b: str) -> int:
    return (ord(a) * 0x9E3779B1 + ord(b) * 0x85EBCA77) >> 7 & (1 << MODEL_BITS) - 1


def _single(a: str) -> int:
    return (ord(a) * 0xC2B2AE3D) >> 5 & (1 << MODEL_BITS) - 1


def hashed_counts(tokens: Counter) -> Counter:
    """Hashed counts: character pairs at even places, characters at odd ones."""
    out: Counter = Counter()
    for token, n in tokens.items():
        last = " "
        for ch in token:
            out[2 * _pair(last, ch)] += n
            out[2 * _single(last) + 1] += n
            last = ch
        out[2 * _pair(last, " ")] += n
        out[2 * _single(last) + 1] += n
    return out


class CharacterModel:
    """Log likelihood of tokens from hashed pair counts, backing off to characters."""

    def __init__(self, pairs: np.ndarray, singles: np.ndarray):
        self.pairs, self.singles, self.total = pairs, singles, float(singles.sum()) + 1.0
        self.logs: dict[str, float] = {}

    def _log(self, pair: str) -> float:
        last, ch = pair
        seen = float(self.singles[_single(last)])
        back = (float(self.singles[_single(ch)]) + 0.05) / (self.total + 5e4)
        if len(self.logs) > 500_000:
            self.logs.clear()
        value = self.logs[pair] = math.log((float(self.pairs[_pair(last, ch)]) + 2.0 * back) / (seen + 2.0))
        return value

    def score(self, token: str) -> float:
        total, last, logs = 0.0, " ", self.logs
        for ch in token + " ":
            value = logs.get(last + ch)
            total += self._log(last + ch) if value is None else value
            last = ch
        return total


class Reader:
    """Scores tokens and passages under every chain; remembers tokens."""

    def __init__(self, model: CharacterModel):
        self.model = model
        self.known: dict[str, list[tuple[int, float]]] = {}
        self.kept: dict[str, list[tuple[int, float]]] = {}

    def token(self, token: str) -> list[tuple[int, float]]:
        """(chain, gain over the token as it is) for chains that can be undone."""
        found = self.known.get(token)
        if found is None:
            base, found, scored = self.model.score(token), [], {token: 0.0}
            for k, name in enumerate(CHAIN_NAMES):
                if k:
                    original = undo(token, CHAINS[name])
                    if original is not None and original != token:
                        if original not in scored:
                            scored[original] = self.model.score(original) - base
                        found.append((k, scored[original]))
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[token] = found
        return found

    def useful(self, token: str) -> list[tuple[int, float]]:
        """Chains that explain the token better than leaving it as it is would."""
        found = self.kept.get(token)
        if found is None:
            if len(self.kept) > 300_000:
                self.kept.clear()
            found = self.kept[token] = [(k, g) for k, g in self.token(token) if g > -PENALTY]
        return found

    def passage(self, text: str) -> list[float]:
        """Gain in log likelihood of each chain over ``clean``; chains that improve
        no token are out."""
        words, sums, counts, better = 0, {}, {}, set()
        for word in _WORD.split(text):
            if not word.isascii():
                words += 1
                for k, gain in self.useful(word):
                    sums[k] = sums.get(k, 0.0) + gain
                    counts[k] = counts.get(k, 0) + 1
                    if gain > 0:
                        better.add(k)
        gains = [0.0] + [-1e6] * (len(CHAIN_NAMES) - 1)
        for k in better:
            gains[k] = sums[k] - PENALTY * (words - counts[k])
        return gains


def repair_passage(text: str, chain: str, reader: Reader | None = None) -> str:
    """The passage with the chain undone, token by token; blanks are kept."""
    if chain == "clean":
        return text
    k = CHAIN_NAMES.index(chain)

    def one(m: re.Match) -> str:
        token = m.group()
        if token.isascii():
            return token
        original = undo(token, CHAINS[chain])
        if original is None or (reader is not None and dict(reader.token(token)).get(k, -PENALTY) <= -PENALTY):
            return token
        return original

    return re.sub(r"[^ \t\r\n]+", one, text)


def passages_of(text: str) -> list[tuple[int, str]]:
    """(position, passage) of the passages that hold more than ASCII."""
    out, start = [], 0
    for m in PASSAGE.finditer(text):
        piece = text[start : m.start()]
        if piece and not piece.isascii():
            out.append((start, piece))
        start = m.end()
    piece = text[start:]
    if piece and not piece.isascii():
        out.append((start, piece))
    return out


def _train(passages: DataFrame, before: CharacterModel | None = None) -> CharacterModel:
    """Counts by task, summed by bucket; the driver gets the fixed-size table.

    With a model ``before``, tokens that are valid UTF-8 read otherwise and that
    it reads better so don't count: a damaged form must not vouch for itself.
    """
    shared = before and passages.sparkSession.sparkContext.broadcast((before.pairs, before.singles))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = shared and Reader(CharacterModel(*shared.value))

        def model_counts(tokens: Counter) -> Counter:
            if reader:
                tokens = Counter({t: n for t, n in tokens.items() if max((g for k, g in reader.token(t) if k in UTF8_CHAINS), default=0.0) <= 2.0})
            return hashed_counts(tokens)

        tokens: Counter = Counter()
        for batch in batches:
            for text in batch["passage"]:
                tokens.update(w for w in _WORD.split(text) if not w.isascii() and _LOST not in w)
            if len(tokens) > 200_000:
                counts = model_counts(tokens)
                tokens.clear()
                yield pd.DataFrame({"bucket": list(counts.keys()), "n": list(counts.values())})
        counts = model_counts(tokens)
        yield pd.DataFrame({"bucket": pd.Series(list(counts.keys()), dtype="int64"), "n": pd.Series(list(counts.values()), dtype="int64")})

    table = passages.select("passage").mapInPandas(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    pairs, singles = np.zeros(1 << MODEL_BITS, np.float32), np.zeros(1 << MODEL_BITS, np.float32)
    buckets, n = table["bucket"].to_numpy(np.int64), table["n"].to_numpy(np.float32)
    pairs[buckets[buckets % 2 == 0] // 2] = n[buckets % 2 == 0]
    singles[buckets[buckets % 2 == 1] // 2] = n[buckets % 2 == 1]
    return CharacterModel(pairs, singles)


def _score(passages: DataFrame, model: CharacterModel) -> DataFrame:
    """Adds ``gains`` and ``best``; passages for which no chain can compete (and
    that lost nothing) are left out, they are clean at any weight."""
    shared = passages.sparkSession.sparkContext.broadcast((model.pairs, model.singles))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(CharacterModel(*shared.value))
        for batch in batches:
            gains = [reader.passage(t) for t in batch["passage"]]
            best = [max(g[1:]) for g in gains]
            keep = [b > HOPELESS or _LOST in t for b, t in zip(best, batch["passage"])]
            out = batch.assign(gains=gains, best=best)
            yield out[keep]

    return passages.mapInPandas(run, "doc_id bigint, source string, place int, passage string, gains array<double>, best double")


def _with_weights(scored: DataFrame, weights: DataFrame, sources: int) -> DataFrame:
    """A broadcast while the sources are counted to be few, else a shuffled join
    (a hot source is split by the skew join)."""
    return scored.join(F.broadcast(weights) if sources <= MOST_SOURCES else weights, "source")


def _prior() -> list[float]:
    k = len(CHAIN_NAMES)
    return [1 - PRIOR_DAMAGE] + [PRIOR_DAMAGE / (k - 1)] * (k - 1)


def _weights(scored: DataFrame, totals: DataFrame, sources: int, most_rounds: int | None = None, start: list[float] | None = None) -> tuple[DataFrame, list[float]]:
    """EM over the chain weights of each source: (source, weights array), and the
    weights of the field, with which a further estimate may start.

    Passages whose best chain is hopeless (``best`` at most HOPELESS) have posterior 1
    for ``clean`` at any weight the prior allows, so they enter as a count.  Of each
    round the driver sees one row, the field's sums.
    """
    k, prior = len(CHAIN_NAMES), _prior()
    passages = totals.agg(F.sum("n")).first()[0] or 0
    competing = scored.groupBy("source").agg(F.count("*").alias("scored"))
    counts = stored(totals.join(competing, "source", "left").select("source", "n", (F.col("n") - F.coalesce("scored", F.lit(0))).alias("hopeless")))
    field = start or prior
    weights = totals.select("source", F.array(*map(F.lit, field)).alias("weights"))
    hopeless = counts.agg(F.sum("hopeless")).first()[0] or 0
    for _ in range(MOST_ROUNDS if most_rounds is None else most_rounds):
        joined = _with_weights(scored, weights, sources)
        logs = F.transform(F.arrays_zip("gains", "weights"), lambda x: x["gains"] + F.log(x["weights"]))
        tops = joined.select("source", logs.alias("logs")).withColumn("top", F.array_max("logs"))
        likely = tops.select("source", F.transform("logs", lambda x: F.exp(x - F.col("top"))).alias("e"))
        normed = likely.withColumn("z", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
        shares = normed.select("source", F.posexplode("e").alias("chain", "e"), "z").where("e > 0")
        sums = stored(shares.groupBy("source", "chain").agg(F.sum(F.col("e") / F.col("z")).alias("s")))
        seen = {r["chain"]: r["s"] for r in sums.groupBy("chain").agg(F.sum("s").alias("s")).collect()}  # a row a chain
        before, field = field, [(seen.get(i, 0.0) + (hopeless if i == 0 else 0) + prior[i]) / (passages + 1) for i in range(k)]
        own = sums.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("chain", "s"))).alias("own"))
        pooled = F.array(*[F.lit(POOL * x) for x in field])
        weights = counts.join(own, "source", "left").select(
            "source",
            F.transform(
                pooled,
                lambda x, i: (x + F.coalesce(F.try_element_at("own", i), F.lit(0.0)) + F.when(i == 0, F.col("hopeless")).otherwise(0)) / (F.col("n") + POOL),
            ).alias("weights"),
        )
        if max(abs(x - y) for x, y in zip(field, before)) <= STILL * (1 - field[0]):
            break
    return weights, field


def _posterior(scored: DataFrame, weights: DataFrame, sources: int) -> DataFrame:
    """Adds chain (index) and certainty of the most probable chain."""
    logs = F.transform(F.arrays_zip("gains", "weights"), lambda x: x["gains"] + F.log(x["weights"]))
    joined = _with_weights(scored, weights, sources).withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    clean = F.exp(F.col("logs")[0] - F.col("top"))
    z = F.aggregate(F.transform("logs", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    return joined.withColumn("chain", F.array_position("logs", F.col("top")).cast("int") - 1).withColumn("damaged", 1 - clean / z)


def read_chains(documents: DataFrame, rounds: int | None = None, certain: float = 0.9) -> DataFrame:
    """Input (doc_id, source, text); output (doc_id, source, place, passage, chain,
    damaged): the passages that are damaged with at least that probability, and
    those with lost bytes (chain null if nothing else can be undone)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (d, s, p, t)
                for d, s, text in zip(batch["doc_id"], batch["source"], batch["text"])
                for p, t in passages_of(text)
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "source", "place", "passage"])

    texts = documents.where(NOT_ASCII).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    passages = stored(texts.mapInPandas(cut, "doc_id bigint, source string, place int, passage string"))
    totals = stored(passages.groupBy("source").agg(F.count("*").alias("n")))
    sources = totals.count()
    rough = _train(passages)
    first = stored(_score(passages, rough).where(F.col("best") > HOPELESS).select("doc_id", "place", "source", "gains"))
    weights, field = _weights(first, totals, sources, rounds)
    guessed = _posterior(first, weights, sources).where("damaged > 0.5").select("doc_id", "place")
    held_clean = passages.join(guessed, ["doc_id", "place"], "left_anti")
    second = stored(_score(passages, _train(held_clean, rough)))
    judged = _posterior(second, _weights(second, totals, sources, rounds, field)[0], sources)
    lost = F.col("passage").contains(_LOST)
    sure = (F.col("damaged") >= certain) & (F.col("chain") > 0)
    names = F.array(*map(F.lit, CHAIN_NAMES))
    return judged.where(sure | lost).select(
        "doc_id", "source", "place", "passage", F.when(sure, names[F.col("chain")]).alias("chain"), "damaged"
    )


def garbled_documents(documents: DataFrame) -> DataFrame:
    """doc_id of every document with a garbled passage."""
    return read_chains(documents).select("doc_id").distinct()


def restored_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, repaired, chains, lost): the garbled documents in their original
    form as far as it can be recovered."""
    found = read_chains(documents)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                p if c is None or pd.isna(c) else repair_passage(p, c) for p, c in zip(batch["passage"], batch["chain"])
            ]
            yield batch[["doc_id", "place", "passage", "chain"]].assign(fixed=out)

    fixes = found.mapInPandas(run, "doc_id bigint, place int, passage string, chain string, fixed string")
    by_doc = fixes.groupBy("doc_id").agg(
        F.array_sort(F.collect_set(F.struct("place", "passage", "fixed"))).alias("fixes"),
        F.array_sort(F.collect_set("chain")).alias("chains"),
        F.max(F.col("passage").contains(_LOST)).alias("lost"),
    )
    by_doc = stored(by_doc)
    # Only texts of documents that were found move, where the ids are few enough to go to every task.
    texts = documents.where(NOT_ASCII).select("doc_id", "text")
    if by_doc.count() <= MOST_IDS:
        texts = texts.join(F.broadcast(by_doc.select("doc_id")), "doc_id", "left_semi")
    joined = texts.join(by_doc, "doc_id")

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, fixes in zip(batch["text"], batch["fixes"]):
                parts, at = [], 0
                for fix in fixes:
                    if fix["place"] < at or text[fix["place"] : fix["place"] + len(fix["passage"])] != fix["passage"]:
                        continue  # another row of a repeated id
                    parts += [text[at : fix["place"]], fix["fixed"]]
                    at = fix["place"] + len(fix["passage"])
                out.append("".join([*parts, text[at:]]))
            yield batch[["doc_id", "chains", "lost"]].assign(repaired=out)[["doc_id", "repaired", "chains", "lost"]]

    return joined.mapInPandas(apply, "doc_id bigint, repaired string, chains array<string>, lost boolean")
