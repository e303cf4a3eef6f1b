"""Operators of the dataset pipeline: windows, pools, hashing into splits, held-out
exclusion, audit samples, event-log folds, agreement and name conflicts."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainloom.functions.noise import change
from chainloom.functions.text import fold_accents, hash_bucket, normalised_distance, shingles, statement_shape, words


def date_windows(spark, start: str, end: str, days: int) -> DataFrame:
    """(window_start, window_end): all half-open windows of ``days`` within bounds."""
    last = F.date_sub(F.to_date(F.lit(end)), days)
    return spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), last)).alias("window_start")).withColumn("window_end", F.date_add("window_start", days))


def cycle_pool(rows: DataFrame, index: str, pool: list[str]) -> DataFrame:
    """``choice``: the pool's values in turn, by row index."""
    values = F.array(*map(F.lit, pool))
    return rows.withColumn("choice", F.element_at(values, (F.pmod(F.col(index), F.lit(len(pool))) + 1).cast("int")))


def share_quota(rows: DataFrame, key: str, most: float) -> DataFrame:
    """(key, n, share, within): each value's share of the non-null rows."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = rows.agg(F.count(key)).first()[0]
    share = F.round(F.col("n") / F.lit(total), 9)
    return counts.select(key, "n", share.alias("share"), (share <= most).alias("within"))


def hashed_split(rows: DataFrame, family: Column, seed: str, development: int = 10) -> DataFrame:
    """``bucket`` and ``part`` (train or development), equal for equal families."""
    bucket = hash_bucket(F.concat(F.lit(seed + ":"), family))
    return rows.withColumn("bucket", bucket).withColumn("part", F.when(F.col("bucket") < development, "development").otherwise("train"))


def held_out_overlap(rows: DataFrame, held_out: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """Input (key, text) on both sides; output (key, runs, shared, leaked): of each
    text's distinct five-word runs, how many occur anywhere in the held-out texts;
    ``leaked`` at ``similarity`` or more.

    Runs meet as 64-bit hashes against the distinct held-out runs, so no pairs of
    texts arise and a frequent run costs one record a text.
    """
    own = rows.where("text is not null").select("key", shingles(words(fold_accents(F.col("text"))), size).alias("runs")).where("size(runs) > 0")
    theirs = held_out.where("text is not null").select(F.explode(shingles(words(fold_accents(F.col("text"))), size)).alias("run"))
    known = theirs.select(F.xxhash64("run").alias("h")).distinct().withColumn("known", F.lit(1))
    met = own.select("key", F.explode("runs").alias("run")).select("key", F.xxhash64("run").alias("h")).join(known, "h", "left")
    counted = met.groupBy("key").agg(F.count("*").alias("runs"), F.count("known").alias("shared"))
    return counted.withColumn("leaked", F.col("shared") >= similarity * F.col("runs"))


def without_held_out(rows: DataFrame, held_out: DataFrame) -> DataFrame:
    """Rows whose folded text isn't held out word for word; null texts stay."""
    digest = F.sha2(F.concat_ws(" ", words(fold_accents(F.col("text")))), 256)
    gone = held_out.where("text is not null").select(digest.alias("digest")).distinct()
    return rows.withColumn("digest", digest).join(gone, "digest", "left_anti").drop("digest")


def audit_sample(rows: DataFrame, strata: list[str], key: str, seed: str, size: int = 2) -> DataFrame:
    """The ``size`` rows of each stratum with the least hash of their key."""
    order = Window.partitionBy(*strata).orderBy(F.sha2(F.concat(F.lit(seed + ":"), F.col(key)), 256), key)
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)


def fold_events(events: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The latest event of every key (an aggregation, not a window)."""
    last = F.max_by(F.struct(*columns), F.struct(*order))
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(last.alias("e"), F.count("*").alias("events")).select(key, "e.*", "events")


def cohen_kappa(pairs: DataFrame) -> DataFrame:
    """Input (a, b), one row per item rated twice; one row (items, observed,
    expected, kappa); kappa is null without items and 1 at full agreement."""
    cells = pairs.where("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))
    none = F.lit(0).cast("bigint")
    # both margins by rating in one aggregation
    rows = cells.select(F.col("a").alias("rating"), F.col("n").alias("ra"), none.alias("rb"), F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(none).alias("same"))
    columns = cells.select(F.col("b").alias("rating"), none.alias("ra"), F.col("n").alias("rb"), none.alias("same"))
    margins = rows.unionByName(columns).groupBy("rating").agg(F.sum("ra").alias("ra"), F.sum("rb").alias("rb"), F.sum("same").alias("same"))
    sums = margins.agg(*[F.coalesce(F.sum(x), none).alias(n) for x, n in ((F.col("ra"), "items"), (F.col("same"), "agreed"), (F.col("ra") * F.col("rb"), "product"))])
    n = F.col("items").cast("double")
    some = F.col("items") > 0
    observed, expected = F.when(some, F.col("agreed") / n), F.when(some, F.col("product") / (n * n))
    kappa = F.when(expected == 1, F.lit(1.0)).when(some, (observed - expected) / (1 - expected))
    return sums.select("items", F.round(observed, 9).alias("observed"), F.round(expected, 9).alias("expected"), F.round(kappa, 9).alias("kappa"))


def unambiguous_names(labels: DataFrame) -> DataFrame:
    """(alias, owner): aliases, folded, that name one owner only."""
    names = labels.where("owner is not null").select("owner", F.explode("aliases").alias("alias")).select(F.trim(F.lower("alias")).alias("alias"), "owner").where("alias <> ''")
    return names.groupBy("alias").agg(F.min("owner").alias("owner"), F.max("owner").alias("other")).where("owner = other").select("alias", "owner")


def statement_features(queries: DataFrame) -> DataFrame:
    """Input (key, sql); output (key, shape, has_join, has_group, has_window, has_limit, has_cte)."""
    shape = statement_shape(F.col("sql"))
    flag = lambda pattern: F.col("shape").rlike(pattern)
    return queries.where("sql is not null").select("key", shape.alias("shape")).select(
        "key", "shape", flag(r"\bjoin\b").alias("has_join"), flag(r"\bgroup by\b").alias("has_group"), flag(r"\bover \(").alias("has_window"),
        flag(r"\blimit\b").alias("has_limit"), flag(r"^with\b").alias("has_cte"),
    )


# The four styles of a question and how each frames it, by language.
STYLES = {
    ("en", "plain"): "{0}", ("en", "polite"): "Could you please tell me: {0}", ("en", "short"): "{0} Keep it short.", ("en", "formal"): "I would like to know the following. {0}",
    ("vi", "plain"): "{0}", ("vi", "polite"): "Xin cho biết: {0}", ("vi", "short"): "{0} Trả lời ngắn gọn.", ("vi", "formal"): "Tôi muốn biết điều sau đây. {0}",
}


def generated_records(spark: SparkSession, allocation: dict[str, int], start: str, end: str, days: int = 7, limits: tuple[int, ...] = (5, 10, 20, 50)) -> DataFrame:
    """(id, template_id, position, window_start, window_end, n): as many records of each
    template as allotted; windows and limits are taken from their pools in turn, the
    limit moving on once per round of windows.  Arithmetic on the row's number only."""
    rows = spark.createDataFrame(sorted(allocation.items()), "template_id string, allotted int")
    numbered = rows.where("allotted > 0").select("template_id", F.explode(F.sequence(F.lit(0), F.col("allotted") - 1)).alias("position"))
    windows = max(1, (dt.date.fromisoformat(end) - dt.date.fromisoformat(start)).days - days + 1)
    first = F.date_add(F.to_date(F.lit(start)), (F.col("position") % windows).cast("int"))
    n = F.element_at(F.array(*map(F.lit, limits)), (F.floor(F.col("position") / windows) % len(limits) + 1).cast("int"))
    return numbered.select(
        F.format_string("%s-%06d", "template_id", "position").alias("id"), "template_id", "position",
        first.alias("window_start"), F.date_add(first, days).alias("window_end"), n.alias("n"),
    )


def expanded_questions(records: DataFrame, patterns: DataFrame) -> DataFrame:
    """Input records (id, template_id, and slot columns) and patterns (template_id,
    language, pattern with {slot} places); output (id, family, language, style,
    question): every record in every language and style."""
    styles = F.array(*[F.struct(F.lit(lang).alias("language"), F.lit(style).alias("style"), F.lit(frame).alias("frame")) for (lang, style), frame in STYLES.items()])
    question = F.col("pattern")
    for slot in records.columns:
        if slot not in ("id", "template_id"):
            question = F.replace(question, F.lit("{" + slot + "}"), F.coalesce(F.col(slot).cast("string"), F.lit("")))
    rendered = records.join(patterns, "template_id").select("id", "language", question.alias("core"))
    framed = rendered.select("id", "language", "core", F.explode(styles).alias("s")).where("s.language = language")
    return framed.select(
        F.concat_ws("__", "id", "language", "s.style").alias("id"), F.col("id").alias("family"), "language", F.col("s.style").alias("style"), F.replace(F.col("s.frame"), F.lit("{0}"), F.col("core")).alias("question")
    )


def wording_diversity(variants: DataFrame, least: float = 0.3) -> DataFrame:
    """Input (family, language, style, question), one question a style; output
    (family, language, pairs, diversity, diverse): the mean normalised Levenshtein
    distance of all pairs of a family's styles.  A family holds as many variants as
    there are styles, so its pairs are formed inside one row."""
    held = variants.where("question is not null").groupBy("family", "language").agg(F.sort_array(F.collect_set(F.struct("style", "question"))).alias("v"))
    pairs = F.flatten(F.transform("v", lambda x, i: F.transform(F.slice("v", i + 2, F.size("v")), lambda y: normalised_distance(x["question"], y["question"]))))
    out = held.select("family", "language", pairs.alias("d")).withColumn("pairs", F.size("d"))
    mean = F.round(F.aggregate("d", F.lit(0.0), lambda a, x: a + x) / F.col("pairs"), 9)
    return out.where("pairs > 0").select("family", "language", "pairs", mean.alias("diversity"), (mean > least).alias("diverse"))


def limit_witnesses(queries: DataFrame) -> DataFrame:
    """Input (key, sql); output (base, members, witness, least_n, proof): statements that
    differ in their final LIMIT only form a group, and the one with the least limit
    proves the others (``limit_monotonic``); one without a limit proves itself."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower("sql"), r"[\s`;]+", " "), r"\s+", " "))
    read = queries.where("key is not null and sql is not null").select("key", plain.alias("plain"))
    n = F.regexp_extract("plain", r" limit ([0-9]{1,18})$", 1)
    split = read.select("key", F.regexp_replace("plain", r" limit [0-9]{1,18}$", "").alias("base"), F.when(n != "", n).cast("bigint").alias("n"))
    grouped = split.groupBy("base", F.col("n").isNull().alias("whole")).agg(
        F.count("*").alias("members"), F.min(F.struct("n", "key"))["key"].alias("witness"), F.min("n").alias("least_n")
    )
    return grouped.select("base", "members", "witness", "least_n", F.when(F.col("whole"), "exact").otherwise("limit_monotonic").alias("proof"))


# Kinds of noise and the distance each may make.
NOISE = {"typo": 0.10, "abbreviation": 0.35, "fragment": 0.45, "mixed_case": 0.0}


def with_noise(questions: DataFrame, quotas: dict[str, int], seed: str) -> DataFrame:
    """Input (key, text); output (key, kind, text, noisy, distance): as many noisy
    copies of each kind as its quota, if there are so many valid ones.

    A hash gives every question one kind, so no two kinds share a source; protected
    are addresses, dates, numbers and words in capitals.  A copy is valid within its
    kind's distance (mixed case: 0 by folded text) and if no question reads so.
    """
    kinds = sorted(NOISE)
    values = r"(0[xX][0-9a-fA-F]+|[0-9][0-9./,:-]*|\b[A-Z][A-Z0-9]+\b)"
    kind = F.element_at(F.array(*map(F.lit, kinds)), (hash_bucket(F.concat(F.lit(seed + ":kind:"), F.col("key"))) % len(kinds) + 1).cast("int"))
    asked = questions.where("key is not null and text is not null").select("key", "text", kind.alias("kind"), F.regexp_extract_all("text", F.lit(values), F.lit(1)).alias("kept"))

    @F.pandas_udf("string")
    def changed(key: pd.Series, text: pd.Series, kind: pd.Series, kept: pd.Series) -> pd.Series:
        return pd.Series([noisy(t, k, f"{seed}:{i}", list(p)) for i, t, k, p in zip(key, text, kind, kept)], dtype=object)

    fold = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    made = asked.withColumn("noisy", changed("key", "text", "kind", "kept")).where("noisy <> text").withColumn("distance", F.round(normalised_distance(fold("text"), fold("noisy")), 9))
    most = F.create_map(*[F.lit(x) for k in kinds for x in (k, NOISE[k])])
    fits = F.when(F.col("kind") == "mixed_case", F.col("distance") == 0).otherwise((F.col("distance") > 0) & (F.col("distance") <= most[F.col("kind")]))
    known = questions.where("text is not null").select(F.col("text").alias("noisy")).distinct()
    valid = made.where(fits).join(known, "noisy", "left_anti").withColumn("order", F.sha2(F.concat(F.lit(seed + ":"), F.col("key")), 256))
    once = valid.groupBy("kind", "noisy").agg(F.min(F.struct("order", "key", "text", "distance")).alias("v")).select("kind", "noisy", "v.*")
    parts = [once.where(F.col("kind") == k).orderBy("order", "key").limit(quotas.get(k, 0)) for k in kinds]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("key", "kind", "text", "noisy", "distance")


def noise_statistics(noise: DataFrame) -> DataFrame:
    """(kind, rows, mean_distance, most_distance, invalid) of noisy copies."""
    most = F.create_map(*[F.lit(x) for k, d in NOISE.items() for x in (k, d)])
    wrong = F.when(F.col("kind") == "mixed_case", F.col("distance") != 0).otherwise((F.col("distance") <= 0) | (F.col("distance") > most[F.col("kind")]))
    return noise.groupBy("kind").agg(
        F.count("*").alias("rows"), F.round(F.avg("distance"), 9).alias("mean_distance"), F.max("distance").alias("most_distance"), F.count_if(F.coalesce(wrong, F.lit(True))).alias("invalid")
    )


def snapshot_faults(rows: DataFrame, held_out: DataFrame, split: str = "train") -> DataFrame:
    """Input rows (key, text, split) and held-out (text); one row (rows, null_keys,
    repeated_keys, repeated_texts, other_splits, leaked, valid) of a training snapshot."""
    folded = lambda: F.sha2(F.concat_ws(" ", words(fold_accents(F.col("text")))), 256)
    gone = held_out.where("text is not null").select(folded().alias("digest")).distinct().withColumn("leak", F.lit(1))
    marked = rows.withColumn("digest", F.when(F.col("text").isNotNull(), folded())).join(gone, "digest", "left")
    none = F.lit(0).cast("bigint")
    repeats = lambda c: F.count(c) - F.count_distinct(c)
    out = marked.agg(
        F.count("*").alias("rows"), F.count_if(F.col("key").isNull()).alias("null_keys"), repeats("key").alias("repeated_keys"), repeats("text").alias("repeated_texts"),
        F.count_if(~F.col("split").eqNullSafe(split)).alias("other_splits"), F.coalesce(F.sum("leak").cast("bigint"), none).alias("leaked"),
    )
    faults = sum((F.col(c) for c in ("null_keys", "repeated_keys", "repeated_texts", "other_splits", "leaked")), none)
    return out.withColumn("valid", faults == 0)


def build_dictionary(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Input (address, owner, category, aliases joined by ``|``); entities (address,
    owner, category, names), concepts (category, owners) and aliases (alias, owner).
    Aliases are trimmed, in lower case and include the owner; one that names several
    owners is dropped from the last table."""
    fold = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    split = F.transform(F.split(F.coalesce("aliases", F.lit("")), r"\|"), fold)
    names = F.sort_array(F.array_distinct(F.filter(F.concat(split, F.array(fold(F.col("owner")))), lambda x: x != "")))
    entities = raw.where("address is not null and owner is not null").select(F.lower("address").alias("address"), "owner", "category", names.alias("names")).dropDuplicates(["address"])
    concepts = entities.where("category is not null").groupBy("category").agg(F.count_distinct("owner").alias("owners"))
    each = entities.select(F.explode("names").alias("alias"), "owner")
    aliases = each.groupBy("alias").agg(F.min("owner").alias("owner"), F.max("owner").alias("other")).where("owner = other").select("alias", "owner")
    return entities, concepts, aliases


def catalogue_faults(catalogue: dict) -> list[str]:
    """What is wrong with a catalogue ``{"relations": {name: {"fields": {name: type},
    "source": name}}, "sources": [..], "joins": [{"left", "right", "keys"}]}``:
    unknown types, sources, relations and fields, repeated joins, missing keys."""
    # Types of the catalogue.
    types = frozenset("BIGNUMERIC BOOLEAN DATE INTEGER JSON NUMERIC RECORD STRING TIMESTAMP".split())
    out = [f"{k}: missing" for k in ("relations", "sources", "joins") if k not in catalogue]
    relations, sources = catalogue.get("relations", {}), set(catalogue.get("sources", ()))
    for name, relation in sorted(relations.items()):
        if not relation.get("fields"):
            out.append(f"{name}: no fields")
        out += [f"{name}.{field}: unknown type {kind}" for field, kind in sorted(relation.get("fields", {}).items()) if kind not in types]
        if relation.get("source") not in sources:
            out.append(f"{name}: unknown source {relation.get('source')}")
    seen = set()
    for join in catalogue.get("joins", ()):
        label = f"{join.get('left')}-{join.get('right')}"
        for side in ("left", "right"):
            known = relations.get(join.get(side), {}).get("fields")
            if known is None:
                out.append(f"join {label}: unknown relation {join.get(side)}")
            else:
                out += [f"join {label}: {join[side]} has no {key[side == 'right']}" for key in join.get("keys", ()) if key[side == "right"] not in known]
        if not join.get("keys"):
            out.append(f"join {label}: no keys")
        mark = (join.get("left"), join.get("right"), tuple(map(tuple, join.get("keys", ()))))
        if mark in seen:
            out.append(f"join {label}: repeated")
        seen.add(mark)
    return out


def noisy(text: str, kind: str, seed: str, protected: list[str]) -> str:
    """One typo, abbreviation, fragment or change of case outside of protected
    spans; the same for the same seed.  Unchanged where nothing can be changed."""
    return change(text, kind, random.Random(seed), protected)
