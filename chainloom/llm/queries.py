"""Registered queries of the training-data operators and, where SQL can express
them on whole tables, their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.llm import bpe, glyphs, mojibake, names, overlap, packing, pairs, splits
from chainloom.sources.tables import table

#: Folder of the vocabulary files; a parameter of the operators.
TOKENIZERS = os.environ.get("CHAINLOOM_TOKENIZERS", bpe.DEFAULT_FOLDER)


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    cases = table(spark, folder, "evaluation_cases").select(F.col("case_id").alias("key"), F.col("question").alias("text"))
    votes = table(spark, folder, "review_votes").select(F.col("vote_id").alias("key"), F.col("revised_question").alias("text"))
    return cases.unionByName(votes)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.defective_pairs(table(spark, folder, "evaluation_predictions"), table(spark, folder, "evaluation_cases"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return glyphs.lookalike_pairs(_questions(spark, folder))


def p2_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every question and revised question in its consistent form."""
    return glyphs.normalise_text(_questions(spark, folder), "text", "form").select("key", "form")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return splits.tied_pairs(table(spark, folder, "evaluation_cases"), table(spark, folder, "witness_groups"))


def p3_split(spark: SparkSession, folder: str) -> DataFrame:
    return splits.assign_splits(
        table(spark, folder, "evaluation_cases"), table(spark, folder, "witness_groups"), table(spark, folder, "split_targets")
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.linked_pairs(table(spark, folder, "entities"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlap_found(table(spark, folder, "evaluation_cases"), table(spark, folder, "held_out_sources"))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlap_report(table(spark, folder, "evaluation_cases"), table(spark, folder, "held_out_sources"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, folder, "documents"), "byte_bpe_50k", TOKENIZERS)


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_containers(table(spark, folder, "documents"), table(spark, folder, "container_specs"), TOKENIZERS)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return mojibake.garbled_documents(table(spark, folder, "documents"))


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    return mojibake.restored_documents(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p2_found, p2_forms, p3_found, p3_split, p4_found, p5_found, p5_report, p6_ids, p7_containers, p8_found, p8_restored)
    return {f.__name__: f for f in found}


# Fixed values of the check, spelled out apart from the operator's tables: letters
# of other scripts above the letter that looks the same, and hyphens.
_LOOKS = (
    ("аеорсухѕіјһԁԛԝӏАВЕКМНОРСТУХЅІЈԚԜӓёїӧЁЇ", "aeopcyxsijhdqwlABEKMHOPCTYXSIJQWäëïöËÏ"),
    ("αονριυγΑΒΕΖΗΙΚΜΝΟΡΤΥΧό", "aovpiuyABEZHIKMNOPTYXó"),
    ("‐‑‒−﹣", "-----"),
)


def _consistent_sql(text: str) -> str:
    """The consistent form in SQL: one character map, ligatures and blanks."""
    wide = "".join(chr(0xFEE0 + code) for code in range(0x21, 0x7F)), "".join(map(chr, range(0x21, 0x7F)))
    blanks = "".join(map(chr, (0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
    pairs = (*_LOOKS, wide, (blanks, " " * len(blanks)))
    source, target = ("".join(p[i] for p in pairs).replace("'", "''") for i in (0, 1))
    out = f"regexp_replace({text}, '[­​-‏⁠﻿]', '', 'g')"
    for ligature, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("…", "...")):
        out = f"replace({out}, '{ligature}', '{letters}')"
    out = f"translate({out}, '{source}', '{target}')"
    return f"trim(regexp_replace(nfc_normalize({out}), '\\s+', ' ', 'g'))"


def oracle_sql() -> dict[str, str]:
    texts = """
        select case_id as key, question as text from evaluation_cases
        union all select vote_id, revised_question from review_votes"""
    form = _consistent_sql("text")
    listed = """
        with recursive listed as (
            select row_number() over () as r, group_id, template_id, member_record_ids from witness_groups),
        node as (
            select r, 'g:' || group_id as n from listed where trim(group_id) <> ''
            union all select r, 't:' || template_id from listed where trim(template_id) <> ''
            union all select r, 'c:' || m from (select r, unnest(member_record_ids) as m from listed) where trim(m) <> ''),
        edge as (select distinct a.n as u, b.n as v from node a join node b on a.r = b.r),
        reach as (
            select n as u, n as v from (select distinct n from node where n like 'c:%')
            union select reach.u, edge.v from reach join edge on reach.v = edge.u),
        lead as (
            select substr(u, 3) as case_id, min(substr(v, 3)) as lead_case_id from reach
            where v like 'c:%' and substr(v, 3) in (select case_id from evaluation_cases) group by u)
        """
    return {
        "p2_found": f"""
            with texts as ({texts}), formed as (select key, text, {form} as form from texts where text is not null)
            select least(a.key, b.key) as key_a, greatest(a.key, b.key) as key_b
            from formed a join formed b on a.form = b.form and a.text < b.text where a.form <> ''""",
        "p3_found": listed
        + """select lead_case_id, case_id from lead
             where case_id <> lead_case_id and case_id in (select case_id from evaluation_cases)""",
    }
