"""Mentions of entities in texts: windows with source offsets, proposals by exact,
fuzzy and vector matching, selection without overlap, and what a mention means
for a query (direction, class, coverage).

A proposal is (key, start, end, stage, targets, score); ``start`` and ``end`` are
offsets into the text as it was written.  Windows meet phrases by equi-joins (on
the phrase) or, where they are only similar, in the cells of a grid;
selection and resolution are folds inside one row per text.

Defined results: null texts and texts without letters have no windows; an unknown
address is a target of its own; equal proposals count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainloom.functions.text import ADDRESS
from chainloom.operators.similar import SIDE, Characters, Trigrams, Vectors, best_pairs, similar_pairs
from chainloom.sources.checkpoints import stored

#: Longest window in tokens; least similarities; scores so close to the best are ambiguous; most targets.
LONGEST, LEAST_FUZZY, LEAST_VECTOR, CLOSE, MOST = 5, 0.85, 0.75, 0.03, 3
# Function words that can't begin or end a fuzzy mention alone.
FUNCTION_WORDS = ("a", "an", "and", "at", "by", "for", "from", "in", "into", "is", "of", "on", "or", "out", "the", "to", "was", "with")
# Cues of direction and of a class, the characters before a mention that may hold them, and joining words.
FROM_CUES, TO_CUES, CLASS_CUES = r"\b(?:from|sent\s+by|out\s+of)\b", r"\b(?:to|into|received\s+by)\b", r"\b(?:any|all|every|major)\s+$"
DIRECTION_REACH, CLASS_REACH, BRIDGES = 40, 20, ("and", "or", "and/or", "/")
_TOKEN = re.compile(r"\w+")


def normalised(text: str) -> tuple[str, list[int], list[int]]:
    """The text in NFKC, case folded, blanks collapsed, with the source range of
    every character.  The source is cut before each character that begins a new
    cluster in the normalised text, so composition never runs over a cut."""
    cuts = [0]
    for i in range(1, len(text)):
        pair = text[cuts[-1] : i + 1]
        joined = unicodedata.normalize("NFKC", pair)
        apart = unicodedata.normalize("NFKC", text[cuts[-1] : i]) + unicodedata.normalize("NFKC", text[i])
        if joined == apart and not unicodedata.combining(text[i]):
            cuts.append(i)
    out, starts, ends = [], [], []
    for a, b in zip(cuts, [*cuts[1:], len(text)]):
        for ch in unicodedata.normalize("NFKC", text[a:b]).casefold():
            if ch.isspace():
                if not out or out[-1] == " ":
                    if out:
                        ends[-1] = b
                    continue
                ch = " "
            out.append(ch)
            starts.append(a)
            ends.append(b)
    if out and out[-1] == " ":
        out, starts, ends = out[:-1], starts[:-1], ends[:-1]
    return "".join(out), starts, ends


def token_windows(texts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Input (key, text); output (key, window, start, end, tokens, shouted): all runs
    of 1 to ``longest`` tokens that hold a letter and a word that is no function word."""
    small = frozenset(FUNCTION_WORDS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["key"], batch["text"]):
                plain, starts, ends = normalised(text)
                tokens = [m.span() for m in _TOKEN.finditer(plain)]
                for i in range(len(tokens)):
                    for j in range(i, min(i + longest, len(tokens))):
                        words = [plain[a:b] for a, b in tokens[i : j + 1]]
                        if any(c.isalpha() for w in words for c in w) and not small.issuperset(words):
                            a, b = starts[tokens[i][0]], ends[tokens[j][1] - 1]
                            rows.append((key, " ".join(words), a, b, j - i + 1, text[a:b].isupper()))
            yield pd.DataFrame(rows, columns=["key", "window", "start", "end", "tokens", "shouted"])

    kind = texts.schema["key"].dataType.simpleString()
    return texts.where("text is not null").select("key", "text").mapInPandas(run, f"key {kind}, window string, start int, end int, tokens int, shouted boolean")


def address_proposals(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """Addresses named in (key, text); the target is the owner of a labelled address."""
    low = F.lower("text")
    spans = texts.where("text is not null").select("key", low.alias("text"), F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(f"({ADDRESS})"), F.lit(1)))).alias("address"))
    # every place of an address: the lengths of what stands between its occurrences
    pieces = F.split(F.col("text"), F.col("address"), -1)
    places = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: F.aggregate(F.slice(pieces, 1, i), F.lit(0), lambda n, p: n + F.length(p)) + (i - 1) * 42)
    at = spans.select("key", "address", F.explode(places).alias("start"))
    owners = labels.where("owner is not null").groupBy("address").agg(F.min("owner").alias("owner"))
    target = F.coalesce("owner", F.concat(F.lit("address:"), "address"))
    return at.hint("merge").join(owners, "address", "left").select("key", "start", (F.col("start") + 42).alias("end"), F.lit("address").alias("stage"), F.array(target).alias("targets"), F.lit(1.0).alias("score"))


def exact_proposals(windows: DataFrame, phrases: DataFrame) -> DataFrame:
    """Input windows and (phrase, target, signal); a phrase of one token whose
    ``signal`` is set only counts in capitals.  At most three targets, by name."""
    met = windows.hint("merge").join(phrases, F.col("window") == F.col("phrase")).where("not (tokens = 1 and signal and not shouted)")
    return met.groupBy("key", "start", "end").agg(F.slice(F.sort_array(F.collect_set("target")), 1, MOST).alias("targets")).select(
        "key", "start", "end", F.lit("exact").alias("stage"), "targets", F.lit(1.0).alias("score")
    )


def _ranked(scored: DataFrame, stage: str) -> DataFrame:
    """(key, start, end, target, score) -> proposals: the targets within CLOSE of the
    best one, best first, at most three."""
    best = scored.groupBy("key", "start", "end", "target").agg(F.max("score").alias("score"))
    ordered = best.groupBy("key", "start", "end").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("n"), "target"))).alias("r"))
    near = F.slice(F.filter("r", lambda x: x["n"] - F.col("r")[0]["n"] < CLOSE), 1, MOST)
    return ordered.select("key", "start", "end", F.lit(stage).alias("stage"), F.transform(near, lambda x: x["target"]).alias("targets"), F.round(-F.col("r")[0]["n"], 9).alias("score"))


def fuzzy_proposals(windows: DataFrame, phrases: DataFrame, least: float = LEAST_FUZZY) -> DataFrame:
    """Windows similar to a phrase (indel similarity); a function word at an edge
    must stand there in the phrase too."""
    near = similar_pairs(F.col("window"), windows, F.col("phrase"), phrases, Characters(least)).withColumnsRenamed({"a": "word", "b": "phrase"})
    small = F.array(*map(F.lit, FUNCTION_WORDS))
    edge = lambda c, i: F.element_at(F.split(F.col(c), " "), i)
    bad = F.lit(False)
    for i in (1, -1):
        bad |= F.array_contains(small, edge("word", i)) & (edge("word", i) != edge("phrase", i))
    met = windows.join(near.where(~bad), F.col("window") == F.col("word")).join(phrases.hint("merge"), "phrase").where("not (tokens = 1 and signal and not shouted)")
    return _ranked(met.select("key", "start", "end", "target", "score"), "fuzzy")


def hashed_vector(text: str, size: int = 256) -> np.ndarray:
    """Unit vector of a text's character trigrams, hashed: an encoder without a model."""
    import zlib

    out = np.zeros(size, np.float32)
    padded = f" {text} "
    for i in range(len(padded) - 2):
        h = zlib.crc32(padded[i : i + 3].encode())
        out[h % size] += 1.0 if h >> 16 & 1 else -1.0
    norm = float(np.linalg.norm(out))
    return out / norm if norm else out


def vector_proposals(windows: DataFrame, phrases: DataFrame, least: float = LEAST_VECTOR, encode=hashed_vector, block: int = 2 * SIDE) -> DataFrame:
    """Windows whose vector has an inner product of at least ``least`` with a
    phrase's.  Windows and phrases meet in cells of at most about ``block`` strings
    a side; hashed trigrams are filtered by their counts before any product, other
    encoders' vectors are multiplied in full."""
    kind = Trigrams(least) if encode is hashed_vector else Vectors(least, encode)
    # what a window means depends on its words and on whether signals count, so it is ranked once for all its places
    strict = ((F.col("tokens") == 1) & ~F.col("shouted")).alias("strict")
    places = windows.select("key", "start", "end", F.col("window").alias("text"), strict)
    known = phrases.select(F.col("phrase").alias("text"), "target", F.coalesce("signal", F.lit(True)).alias("loud"))
    found = best_pairs(places.select("text", "strict"), known, kind, CLOSE, MOST, block).repartition("text", "strict")
    best = found.groupBy("text", "strict", "target").agg(F.max("score").alias("score"))
    ordered = best.groupBy("text", "strict").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("n"), "target"))), 1, MOST).alias("r"))
    met = places.hint("merge").join(ordered, ["text", "strict"])
    # a sign that stands for two words gives one place two windows; hashes tell whether there is any
    spots = places.select(F.xxhash64("key", "start", "end").alias("spot")).groupBy("spot").count()
    if not spots.where("count > 1").isEmpty():
        met = met.groupBy("key", "start", "end").agg(F.sort_array(F.flatten(F.collect_list("r"))).alias("r"))
    near = F.filter("r", lambda x: x["n"] - F.col("r")[0]["n"] < CLOSE)
    targets = F.slice(F.array_distinct(F.transform(near, lambda x: x["target"])), 1, MOST)
    return met.select("key", "start", "end", F.lit("embedding").alias("stage"), targets.alias("targets"), F.round(-F.col("r")[0]["n"], 9).alias("score"))


def uncovered(windows: DataFrame, proposals: DataFrame) -> DataFrame:
    """Windows that touch no proposal of their text."""
    taken = proposals.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("taken"))
    touches = F.exists("taken", lambda t: (F.col("start") < t["end"]) & (t["start"] < F.col("end")))
    return windows.hint("merge").join(taken, "key", "left").where(F.col("taken").isNull() | ~touches).drop("taken")


def select_spans(proposals: DataFrame) -> DataFrame:
    """Proposals without overlap, greedily: addresses first, then the longest, the
    earliest, by target.  One fold over the sorted proposals of a text."""
    order = F.struct(
        (F.col("stage") != "address").alias("late"), (F.col("start") - F.col("end")).alias("size"), "start", F.col("targets")[0].alias("first"), "end", "stage", "targets", "score"
    )
    sorted_ = proposals.groupBy("key").agg(F.sort_array(F.collect_set(order)).alias("p"))
    kept = F.aggregate(
        "p",
        F.slice(F.col("p"), 1, 0),
        lambda done, x: F.when(F.exists(done, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])), done).otherwise(F.concat(done, F.array(x))),
    )
    return sorted_.select("key", F.explode(kept).alias("x")).select("key", "x.start", "x.end", "x.stage", "x.targets", "x.score")


def link_entities(texts: DataFrame, labels: DataFrame, phrases: DataFrame, with_vectors: bool = False) -> DataFrame:
    """Input (key, text); the selected mentions of every text.  Each stage sees only
    the windows that the stages before it left uncovered."""
    windows, phrases = stored(token_windows(texts)), stored(phrases)
    found = stored(address_proposals(texts, labels))
    found = stored(found.unionByName(exact_proposals(uncovered(windows, found), phrases)))
    # only what is still open is read again: its strings and, for their places, its rows
    open_ = stored(uncovered(windows, found))
    near = fuzzy_proposals(open_, phrases)
    if with_vectors:
        near = stored(near)
        near = near.unionByName(vector_proposals(stored(uncovered(open_, near)), phrases))
    return select_spans(found.unionByName(near))


def direction(text: Column, start: Column) -> Column:
    """``from``, ``to`` or ``unspecified``: the last cue in the 40 characters before a
    mention; two cues that a joining word connects say nothing."""
    begin = F.greatest(start - DIRECTION_REACH, F.lit(0))
    before = F.substring(text, begin + 1, start - begin)
    # greedy: what stands before the last cue
    head = lambda cue: F.regexp_extract(before, rf"(?is)^(.*)({cue}).*$", 1)
    cue = lambda c: F.regexp_extract(before, rf"(?is)^(.*)({c}).*$", 2)
    has_from, has_to = before.rlike(f"(?i){FROM_CUES}"), before.rlike(f"(?i){TO_CUES}")
    at_from, at_to = F.length(head(FROM_CUES)), F.length(head(TO_CUES))
    end_first = F.when(at_from < at_to, at_from + F.length(cue(FROM_CUES))).otherwise(at_to + F.length(cue(TO_CUES)))
    bridge = F.lower(F.trim(F.substring(before, end_first + 1, F.greatest(at_from, at_to) - end_first)))
    return (
        F.when(has_from & has_to & bridge.isin(*BRIDGES), "unspecified")
        .when(has_from & (~has_to | (at_from > at_to)), "from")
        .when(has_to, "to")
        .otherwise("unspecified")
    )


def names_a_class(text: Column, start: Column, end: Column) -> Column:
    """Whether an ambiguous mention means a class: "any", "all", ... before it, or a plural."""
    begin = F.greatest(start - CLASS_REACH, F.lit(0))
    span = F.substring(text, start + 1, end - start)
    return F.substring(text, begin + 1, start - begin).rlike(f"(?i){CLASS_CUES}") | F.lower(span).endswith("s")


def class_coverage(labels: DataFrame, roles: DataFrame) -> DataFrame:
    """Input labels (owner, concept_class, address_role) and (concept_class,
    required_role); output (concept_class, required_role, owners, covered): a class
    is covered where an owner has an address of the required role."""
    per = labels.where("concept_class is not null").join(roles, "concept_class", "left")
    return per.groupBy("concept_class", "required_role").agg(
        F.count_distinct(F.when(F.col("address_role") == F.col("required_role"), F.col("owner"))).alias("owners")
    ).withColumn("covered", F.col("required_role").isNotNull() & (F.col("owners") > 0))


def resolution_plans(mentions: DataFrame, texts: DataFrame) -> DataFrame:
    """Input selected mentions and (key, text); output (key, mentions, resolved,
    status) of every text: ``resolved``, ``partial`` (a mention is open, without
    direction, or two share one) or ``unresolved``."""
    joined = texts.where("text is not null").join(mentions.hint("merge"), "key", "left")
    where = F.when(F.col("start").isNotNull(), direction(F.col("text"), F.col("start")))
    open_ = F.size("targets") > 1
    solved = F.col("start").isNotNull() & (~open_ | names_a_class(F.col("text"), F.col("start"), F.col("end")))
    rows = joined.select("key", "start", where.alias("direction"), F.coalesce(solved, F.lit(False)).alias("solved"))
    per = rows.groupBy("key").agg(
        F.count("start").alias("mentions"), F.count_if("solved").alias("resolved"), F.count_if(F.col("direction") == "unspecified").alias("vague"),
        F.greatest(F.count_if(F.col("direction") == "from"), F.count_if(F.col("direction") == "to")).alias("same"),
    )
    status = F.when(F.col("resolved") == 0, "unresolved").when((F.col("resolved") < F.col("mentions")) | (F.col("vague") > 0) | (F.col("same") > 1), "partial").otherwise("resolved")
    return per.select("key", "mentions", "resolved", status.alias("status"))


def mention_scores(found: DataFrame, gold: DataFrame) -> DataFrame:
    """Input (key, start, end, targets) and gold (key, start, end, target); one row
    (predicted, gold, hits, precision, recall, f1, top1_accuracy)."""
    a = found.select("key", "start", "end", F.col("targets")[0].alias("first")).dropDuplicates(["key", "start", "end"]).withColumn("p", F.lit(1))
    b = gold.dropDuplicates(["key", "start", "end"]).withColumn("g", F.lit(1))
    both = a.join(b, ["key", "start", "end"], "full_outer")
    sums = both.agg(F.count("p").alias("predicted"), F.count("g").alias("gold"), F.count(F.col("p") + F.col("g")).alias("hits"), F.count_if(F.col("first") == F.col("target")).alias("right"))
    share = lambda x, n: F.when(F.col(n) > 0, F.col(x) / F.col(n)).otherwise(F.lit(0.0))
    f1 = F.when(F.col("predicted") + F.col("gold") > 0, 2 * F.col("hits") / (F.col("predicted") + F.col("gold"))).otherwise(F.lit(0.0))
    return sums.select("predicted", "gold", "hits", share("hits", "predicted").alias("precision"), share("hits", "gold").alias("recall"), f1.alias("f1"), share("right", "gold").alias("top1_accuracy"))


def choose_encoder(scores: DataFrame, regression: float = 0.02) -> DataFrame:
    """Input (model, metric_vi, metric_en, baseline_en, latency_ms); output adds
    ``place``, null for models whose English result fell by more than ``regression``."""
    fits = F.col("baseline_en") - F.col("metric_en") <= regression + 1e-12
    order = Window.partitionBy(fits).orderBy(F.desc("metric_vi"), F.desc("metric_en"), "latency_ms", "model")
    return scores.withColumn("place", F.when(fits, F.row_number().over(order)))
