"""Fact tables from pages (row-local extraction, then one explode)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant import rules as R
from foliant.functions import facts as FX
from foliant.functions.text import text_or_empty
from foliant.plans.once import explode_once, with_columns_once


def match_facts(docs: DataFrame, rules: Sequence[tuple[str, Sequence[str], int]], text: str = "text",
                keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per (document, rule, distinct match); ``rules`` = (fact_key, patterns, max length)."""
    def found_by(name: str, patterns: Sequence[str], max_len: int) -> Column:
        return F.transform(
            FX.pattern_matches(text_or_empty(text), patterns, max_len),
            lambda v, i: F.struct(F.lit(name).alias("fact_key"), v.alias("fact_value"),
                                  (i + 1).cast("bigint").alias("position")),
        )

    found = [found_by(*rule) for rule in rules]
    return explode_once(docs, list(keys), F.concat(*found), "f").select(*keys, "f.*")


def program_fact_rows(docs: DataFrame) -> DataFrame:
    """Fact rows of documents (source_id, canonical_url, title, content, page_type).

    Only pages passing the fact-source gate are read further, so the expensive
    patterns run on a small share of a corpus.
    """
    url, title, content = F.col("canonical_url"), F.col("title"), F.col("content")
    gated = with_columns_once(
        docs.filter(FX.is_fact_source(F.col("page_type"), url)), {"_program": FX.program_name(url, title)}
    )
    facts = explode_once(
        gated, ["source_id", "canonical_url", "_program"],
        FX.program_facts(url, title, content, F.col("page_type"), F.col("_program")), "f",
    )
    named = F.when(F.col("f.fact_key") == "program_name", F.col("f.fact_value")).otherwise(F.col("_program"))
    return facts.select(
        "source_id", "canonical_url",
        F.when(named == "", F.lit(R.GENERAL_PROGRAM)).otherwise(named).alias("program_name"),
        "f.fact_key", "f.fact_value",
        F.substring(F.coalesce("f.evidence_text", F.lit("")), 1, 500).alias("evidence_text"),
        F.coalesce(F.nullif(F.col("f.confidence"), F.lit(0.0)), F.lit(0.7)).alias("confidence"),
    )


def profile_fact_rows(pages: DataFrame) -> DataFrame:
    found = FX.profile_facts(F.col("url"), F.col("title"), F.col("content"))
    return explode_once(pages, ["url"], found, "f").select("url", "f.*")
