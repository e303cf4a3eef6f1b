"""Comparing results and predictions: canonical values, multiset scores,
distributions, agreement of runs, paired tests, failure classes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.functions.text import statement_shape
from chainloom.operators.statements import structure


def canonical_value(column: Column, kind: str) -> Column:
    """A value as tagged text: numbers without trailing zeros, NaN and infinities
    named, timestamps in UTC, null as its own tag."""
    if kind in ("float", "double"):
        number = F.when(F.isnan(column), "nan").when(F.abs(column) == float("inf"), F.when(column > 0, "inf").otherwise("-inf")).otherwise(F.format_string("%.12g", column.cast("double")))
        tagged = F.concat(F.lit("f:"), number)
    elif kind.startswith("decimal"):
        tagged = F.concat(F.lit("d:"), F.regexp_replace(F.regexp_replace(column.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", ""))
    elif kind in ("tinyint", "smallint", "int", "bigint"):
        tagged = F.concat(F.lit("d:"), column.cast("string"))
    elif kind.startswith("timestamp"):
        tagged = F.concat(F.lit("t:"), F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    elif kind[:5] in ("array", "struc", "map<s"):
        tagged = F.concat(F.lit("j:"), F.to_json(column))
    else:
        tagged = F.concat(F.lit(kind[:1] + ":"), column.cast("string"))
    return F.coalesce(tagged, F.lit("null"))


def row_digests(result: DataFrame) -> DataFrame:
    """(digest): SHA-256 of every row's canonical values; column names are left
    out, their order counts."""
    parts = [F.concat(F.length(v).cast("string"), F.lit("|"), v) for v in (canonical_value(F.col(f"`{c}`"), t) for c, t in result.dtypes)]
    return result.select(F.sha2(F.concat(*parts) if parts else F.lit(""), 256).alias("digest"))


def multiset_scores(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row (expected_rows, actual_rows, shared, precision, recall, f1, equal).
    Copies count; two empty results are equal with an F1 of 1."""
    side = lambda df, name: row_digests(df).groupBy("digest").agg(F.count("*").alias(name))
    both = side(expected, "e").join(side(actual, "a"), "digest", "full_outer").fillna(0, ["e", "a"])
    sums = both.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(n) for x, n in ((F.col("e"), "expected_rows"), (F.col("a"), "actual_rows"), (F.least("e", "a"), "shared"))])
    e, a, s = (F.col(c).cast("double") for c in ("expected_rows", "actual_rows", "shared"))
    empty = (e == 0) & (a == 0)
    return sums.select(
        "expected_rows", "actual_rows", "shared",
        F.when(empty, 1.0).when(a == 0, 0.0).otherwise(s / a).alias("precision"), F.when(empty, 1.0).when(e == 0, 0.0).otherwise(s / e).alias("recall"),
        F.when(empty, 1.0).otherwise(2 * s / (e + a)).alias("f1"), ((e == a) & (e == s)).alias("equal"),
    )


def token_f1(pairs: DataFrame) -> DataFrame:
    """Input (key, a, b); output (key, f1): multiset F1 of lower-case word tokens.
    Keys must be unique; a side without tokens scores 0."""
    tokens = lambda c: F.filter(F.split(F.lower(c), "[^0-9a-z_]+"), lambda w: w != "")
    split = pairs.where("a is not null and b is not null").select("key", tokens(F.col("a")).alias("ta"), tokens(F.col("b")).alias("tb"))
    # copies of a word are numbered, so that multisets intersect as sets
    marked = lambda c: F.transform(F.col(c), lambda w, i: F.concat(w, F.lit("#"), F.size(F.filter(F.slice(F.col(c), F.lit(1), i + 1), lambda x: x == w)).cast("string")))
    shared = F.size(F.array_intersect(marked("ta"), marked("tb")))
    total = F.size("ta") + F.size("tb")
    return split.select("key", F.round(F.when(total > 0, 2 * shared / total).otherwise(F.lit(0.0)), 9).alias("f1"))


def exact_matches(predictions: DataFrame, cases: DataFrame) -> DataFrame:
    """(prediction_id, run_id, baseline, case_id, language, matched): the statement
    that the prediction consists of, or that stands in it between prose, equals the
    case's in structure: layout, keyword case, backticks and semicolons aside."""
    known = cases.where("case_id is not null").groupBy("case_id").agg(F.min(F.struct("gold_sql", "language")).alias("c")).select("case_id", "c.*")
    joined = predictions.where("case_id is not null").join(known, "case_id")
    fenced = F.regexp_extract("prediction", r"(?is)```[a-z]*\s*\n(.*?)```", 1)
    from_select = F.regexp_extract("prediction", r"(?s)(?:^|\n|[.:!?] )[ \t]*((?:SELECT|WITH|select|with)\b.*)$", 1)
    sql = F.coalesce(F.when(F.trim(fenced) != "", fenced), F.when(from_select != "", from_select))
    hit = F.coalesce(structure(sql) == structure(F.col("gold_sql")), F.lit(False))
    return joined.select("prediction_id", "run_id", "baseline", "case_id", "language", hit.alias("matched"))


def latency_distribution(predictions: DataFrame) -> DataFrame:
    """Exact p50, p95, p99 (linear) of latency by baseline, nulls aside."""
    at = lambda p: F.round(F.percentile("latency_ms", p), 6)
    return predictions.where("latency_ms is not null").groupBy("baseline").agg(F.count("*").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def run_agreement(predictions: DataFrame) -> DataFrame:
    """(run_a, run_b, cases, same): how often two runs gave a case the same shape of
    statement.  One row a run and case enters; runs are few by design, and the join
    is on the case."""
    shape = F.sha2(statement_shape(F.coalesce("prediction", F.lit(""))), 256)
    last = predictions.where("case_id is not null and run_id is not null").groupBy("run_id", "case_id").agg(F.max_by(shape, F.struct("generated_at", "prediction_id")).alias("shape"))
    left = last.select(F.col("run_id").alias("run_a"), "case_id", F.col("shape").alias("a"))
    right = last.select(F.col("run_id").alias("run_b"), "case_id", F.col("shape").alias("b"))
    return left.join(right, "case_id").where("run_a < run_b").groupBy("run_a", "run_b").agg(F.count("*").alias("cases"), F.count_if(F.col("a") == F.col("b")).alias("same"))


def mcnemar(matches: DataFrame, first: str, second: str) -> DataFrame:
    """Paired exact test of two baselines over the cases both answered: one row
    (only_first, only_second, p_value)."""
    best = matches.groupBy("case_id").agg(
        F.max(F.when(F.col("baseline") == first, F.col("matched"))).alias("a"), F.max(F.when(F.col("baseline") == second, F.col("matched"))).alias("b")
    )
    counts = best.where("a is not null and b is not null").agg(F.count_if(F.expr("a and not b")).alias("only_first"), F.count_if(F.expr("b and not a")).alias("only_second"))

    @F.udf("double")
    def p_value(b: int, c: int) -> float:
        return exact_mcnemar(b, c)

    return counts.withColumn("p_value", p_value("only_first", "only_second"))


def exact_mcnemar(b: int, c: int) -> float:
    """Two-sided binomial probability of a split at least as uneven."""
    n, least = b + c, min(b, c)
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(least + 1)]
    return min(1.0, 2 * math.fsum(math.exp(x) for x in logs))


def bootstrap_ratio(matches: DataFrame, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """One row (n, ratio, low, high): 95 % interval of the share of matches.

    The hits of n cases drawn with replacement are Binomial(n, hits / n), so each
    replicate is one draw, seeded by (seed, replicate), from two counts.
    """

    @F.pandas_udf("double")
    def draw(replicate: pd.Series, n: pd.Series, hits: pd.Series) -> pd.Series:
        drawn = [np.random.default_rng([seed, r]).binomial(size, h / size) / size if size else None for r, size, h in zip(replicate, n, hits)]
        return pd.Series(drawn, dtype="float64")

    counts = matches.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("matched").cast("int")), F.lit(0)).alias("hits")).where("n > 0")
    numbers = matches.sparkSession.range(1, replicates + 1).select(F.col("id").alias("replicate"))
    ratios = numbers.crossJoin(counts).withColumn("r", draw("replicate", "n", "hits"))
    return ratios.agg(F.max("n").alias("n"), F.max(F.col("hits") / F.col("n")).alias("ratio"), F.percentile("r", 0.025).alias("low"), F.percentile("r", 0.975).alias("high"))


def _resampled(values: DataFrame, column: str, keys: list[str], replicates: int, seed: int, statistics: dict[str, float | None]) -> DataFrame:
    """(keys, name, low, high): percentile intervals of the mean (None) and of
    quantiles of ``column`` by group.

    A resample of n values is a multinomial draw over the distinct values, so the
    groups arrive as (value, count) sums and each is drawn from in one task: as many
    rows as there are distinct values, never the cases themselves.
    """
    counts = values.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("value")).agg(F.count("*").alias("n"))
    schema = ", ".join([f"`{k}` {counts.schema[k].dataType.simpleString()}" for k in keys] + ["name string, low double, high double"])

    def draw(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("value")
        value, n = group["value"].to_numpy(float), group["n"].to_numpy(np.int64)
        total, rng = int(n.sum()), np.random.default_rng(seed)
        found: dict[str, list[float]] = {name: [] for name in statistics}
        for _ in range(replicates):
            drawn = rng.multinomial(total, n / total)
            ends = np.cumsum(drawn)
            for name, q in statistics.items():
                if q is None:
                    found[name].append(float(drawn @ value) / total)
                else:
                    at = q * (total - 1)
                    low, high = (value[np.searchsorted(ends, p, side="right")] for p in (int(at), min(int(at) + 1, total - 1)))
                    found[name].append(float(low + (at - int(at)) * (high - low)))
        rows = [(*key, name, *np.quantile(x, [0.025, 0.975])) for name, x in found.items()]
        return pd.DataFrame(rows, columns=[*keys, "name", "low", "high"])

    return counts.groupBy(*keys).applyInPandas(draw, schema)


def latency_intervals(predictions: DataFrame, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(baseline, name, low, high): 95 % intervals of p50, p95 and p99 of latency,
    which is counted by whole milliseconds."""
    rounded = predictions.select("baseline", F.round("latency_ms").alias("latency"))
    return _resampled(rounded, "latency", ["baseline"], replicates, seed, {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def paired_delta(matches: DataFrame, first: str, second: str, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """One row (cases, left_value, right_value, delta, low, high): the mean difference
    of two baselines over the cases both answered, with its 95 % interval.  A
    difference is -1, 0 or 1, so a resample is a draw of three counts."""
    side = lambda name: F.max(F.when(F.col("baseline") == name, F.col("matched").cast("int")))
    both = matches.groupBy("case_id").agg(side(first).alias("a"), side(second).alias("b")).where("a is not null and b is not null")
    sums = both.agg(F.count("*").alias("cases"), F.avg("a").alias("left_value"), F.avg("b").alias("right_value"))
    interval = _resampled(both.select((F.col("a") - F.col("b")).alias("difference"), F.lit(0).alias("all")), "difference", ["all"], replicates, seed, {"mean": None})
    bounds = interval.agg(F.max("low").alias("low"), F.max("high").alias("high"))
    return sums.join(bounds, F.lit(True)).select("cases", "left_value", "right_value", (F.col("left_value") - F.col("right_value")).alias("delta"), "low", "high")


def failure_classes(predictions: DataFrame, cases: DataFrame) -> DataFrame:
    """(prediction_id, failures): all classes of failure that apply, in order."""
    known = cases.where("case_id is not null").groupBy("case_id").agg(F.min("gold_sql").alias("gold_sql"))
    joined = predictions.select("prediction_id", "case_id", "prediction").join(known, "case_id", "left")
    text = F.lower(F.coalesce("prediction", F.lit("")))
    has_sql = text.contains("select")
    names = F.array_compact(
        F.array(
            F.when(F.col("gold_sql").isNull(), "no_case"), F.when(~has_sql, "no_statement"), F.when(has_sql & ~text.contains(" from "), "no_source"),
            F.when(has_sql & text.contains("limit") & ~F.lower("gold_sql").contains("limit"), "extra_limit"),
            F.when(has_sql & ~text.contains("limit") & F.lower("gold_sql").contains("limit"), "missing_limit"),
            F.when(has_sql & ~text.contains("group by") & F.lower("gold_sql").contains("group by"), "missing_group"),
        )
    )
    return joined.select("prediction_id", names.alias("failures"))


def breakdown(matches: DataFrame) -> DataFrame:
    """Counts by baseline and language with all subtotals (cube)."""
    return matches.withColumn("language", F.coalesce("language", F.lit("unknown"))).cube("baseline", "language").agg(F.count("*").alias("n"), F.sum(F.col("matched").cast("bigint")).alias("matched"))


def language_gaps(matches: DataFrame) -> DataFrame:
    """(baseline, rate_en, rate_vi, gap) of the share of matches."""
    rate = lambda lang: F.avg(F.when(F.col("language") == lang, F.col("matched").cast("double")))
    rates = matches.groupBy("baseline").agg(F.round(rate("en"), 9).alias("rate_en"), F.round(rate("vi"), 9).alias("rate_vi"))
    return rates.withColumn("gap", F.round(F.col("rate_en") - F.col("rate_vi"), 6))


def shared_statements(cases: DataFrame) -> DataFrame:
    """(sql_sha256, cases, first_case): each distinct statement once, for running it once."""
    return cases.where("gold_sql is not null").groupBy(F.sha2("gold_sql", 256).alias("sql_sha256")).agg(F.count("*").alias("cases"), F.min("case_id").alias("first_case"))
