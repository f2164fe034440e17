"""Captured pages -> documents -> chunks -> facts as one chain of transformations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant import rules as R
from foliant.functions import chunking as C
from foliant.functions import urls
from foliant.operators import chunks as CH
from foliant.operators import classify, cleaning, facts, ingest
from foliant.plans.lineage import materialize
from foliant.rules import PageRules


@dataclass(frozen=True)
class Corpus:
    """Results of one ingest batch; ``chunks`` feed ``retrieval.build_context`` as they are."""

    outcomes: DataFrame
    decisions: DataFrame
    documents: DataFrame
    chunks: DataFrame
    facts: DataFrame


def documents_from_outcomes(outcomes: DataFrame) -> DataFrame:
    """Accepted pages as document rows: canonical URL, cleaned text, hash, class, time of capture."""
    at = F.col("captured_at") if "captured_at" in outcomes.columns else F.lit(None)
    return outcomes.filter("outcome = 'accepted'").select(
        F.col("page_id").alias("doc_id"),
        urls.registered_domain("url").alias("source_id"),
        "url", urls.canonical_url("url").alias("canonical_url"),
        "title", "page_type", "authority_score", "content",
        cleaning.content_hash("content").alias("content_hash"), at.cast("timestamp").alias("fetched_at"),
    )


def label_duplicates(outcomes: DataFrame, decisions: DataFrame) -> DataFrame:
    """The outcomes without their texts; accepted pages that turned out to be copies become ``skipped:<reason>``."""
    copies = decisions.filter(F.col("decision").startswith("duplicate")).select(F.col("doc_id").alias("page_id"), "decision")
    rows = outcomes.select("page_id", "url", "outcome", "priority", "page_type", "authority_score").join(copies, "page_id", "left")
    final = F.when(F.col("decision").isNotNull(), F.concat(F.lit("skipped:"), "decision")).otherwise(F.col("outcome"))
    return rows.withColumn("outcome", final).drop("decision")


def prepare_documents(pages: DataFrame, rules: PageRules, allowed_host: Column | str) -> DataFrame:
    """Document rows of captured pages, written once (several later steps read them)."""
    return materialize(documents_from_outcomes(classify.page_outcomes(pages, rules, allowed_host)), "documents")


def surviving(docs: DataFrame, decisions: DataFrame, order: str = "doc_id") -> DataFrame:
    """New and changed documents; of several versions of a URL the last one by (``order``, doc_id)."""
    live = decisions.filter(F.col("decision").isin("saved", "updated"))
    last = live.groupBy("canonical_url").agg(F.max(F.struct(F.col(order).alias("_o"), "doc_id")).alias("_m"))
    last = last.select(F.col("_m.doc_id").alias("doc_id"))
    return docs.join(last, "doc_id", "left_semi")


def chunk_rows(documents: DataFrame, size: int = R.CHUNK_SIZE, overlap: int = R.CHUNK_OVERLAP,
               embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Chunks with their context and situated text, and what retrieval needs of their document.

    ``chunk_key`` packs doc_id and chunk_id (below 2**20 chunks a document);
    ``embed`` adds an ``embedding`` from the column ``situated``.
    """
    carried = [c for c in ("url", "fetched_at") if c in documents.columns]
    pieces = CH.with_offsets(documents, C.boundary_chunks("content", size, overlap), "content",
                             ("doc_id", "source_id", "title", *carried))
    rows = pieces.withColumn("context", CH.default_context(F.col("title"), F.col("heading")))
    key = F.shiftleft(F.col("doc_id").cast("long"), 20) + F.col("chunk_id")
    rows = rows.select(key.alias("chunk_key"), "doc_id", "source_id", *carried, "title", "chunk_id", "chunk_offset", "text", "context",
                       C.situated_text("context", "text").alias("situated"))
    return embed(rows) if embed else rows


def build_corpus(pages: DataFrame, rules: PageRules, allowed_host: Column | str,
                 stored: DataFrame | None = None, stored_counts: DataFrame | None = None,
                 embed: Callable[[DataFrame], DataFrame] | None = None) -> Corpus:
    """Whole ingest of one batch; only documents that are new or changed are chunked.

    Pages with their cleaned text and outcome are written once, so HTML is read and
    cleaned once however many of the results are used.
    """
    outcomes = materialize(classify.page_outcomes(pages, rules, allowed_host), "outcomes")
    docs = materialize(documents_from_outcomes(outcomes), "documents")
    decisions = materialize(ingest.dedup_decisions(docs, stored, stored_counts), "decisions")
    documents = surviving(docs, decisions)
    return Corpus(label_duplicates(outcomes, decisions), decisions, documents, chunk_rows(documents, embed=embed),
                  facts.program_fact_rows(documents))
