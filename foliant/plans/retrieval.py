"""Batch question answering: ranked lists -> fusion -> rerank -> tiers -> packed context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant import rules as R
from foliant.functions.answers import build_prompt, context_block
from foliant.functions.chunking import situated_text
from foliant.functions.text import text_or_empty
from foliant.operators import dense, fusion, lexical
from foliant.plans.lineage import materialize


def ranked_lists(chunks: DataFrame, queries: DataFrame, scoped_pattern: str = R.SCOPED_URL_PATTERN,
                 postings: DataFrame | None = None, positions: DataFrame | None = None,
                 stats: DataFrame | None = None, match: str = "web",
                 k_dense: int = R.TOP_K_DENSE, k_lexical: int = R.TOP_K_LEXICAL,
                 k_scoped: int = R.TOP_K_SCOPED) -> DataFrame:
    """Dense (0), lexical (1) and URL-scoped dense (2) lists: (query_id, chunk_key, rank, list_no).

    ``chunks``: chunk_key, source_id, url, title, text, embedding;
    ``queries``: query_id, source_id, text, embedding.  The lists are small (98
    rows per query at most) and used several times, so they are written once.
    """
    queries = materialize(queries, "queries")
    words = F.concat_ws(" ", text_or_empty("title"), F.col("text"))
    near = dense.dense_lists(chunks, queries, k_dense, F.col("url").rlike(scoped_pattern), k_scoped)
    lists = [
        near.filter("list_no = 0"),
        lexical.lexical_topk(chunks, queries, words, k_lexical, match=match, postings=postings,
                             positions=positions, stats=stats),
        near.filter("list_no = 1"),
    ]
    return materialize(fusion.stack_lists(lists), "lists")


def hybrid_topk(chunks: DataFrame, queries: DataFrame, scorer: Callable[[DataFrame], DataFrame] | None = None,
                final: int = R.FINAL_TOP, **options) -> DataFrame:
    """Fused and reranked chunks per query: (query_id, chunk_key, score, rerank_rank)."""
    fused = fusion.rrf_fuse(ranked_lists(chunks, queries, **options), 3)
    return rerank_fused(chunks, queries, fused, scorer, final)


def rerank_fused(chunks: DataFrame, queries: DataFrame, fused: DataFrame,
                 scorer: Callable[[DataFrame], DataFrame] | None = None, final: int = R.FINAL_TOP) -> DataFrame:
    """Attach texts to the fused ids (60 per query at most) and rerank the situated text.

    The ids are written first: Spark then knows how small they are when it plans the
    join, and texts are neither shuffled nor put together for chunks that are no candidates.
    """
    carried = [c for c in ("text", "context") if c in chunks.columns]
    context = F.col("context") if "context" in carried else F.lit("")
    fused = materialize(fused, "fused")
    texts = chunks.select("chunk_key", *carried).join(fused, "chunk_key")
    cand = texts.select(*fused.columns, situated_text(context, "text").alias("candidate_text")).join(
        queries.select("query_id", F.col("text").alias("query_text")), "query_id"
    )
    # At most 60 candidates per query; a scorer may read them several times.
    return fusion.rerank(materialize(cand, "candidates"), scorer, final)


def build_context(chunks: DataFrame, queries: DataFrame, scorer: Callable[[DataFrame], DataFrame] | None = None,
                  neighbor_pattern: str = "/carreras/", **options) -> DataFrame:
    """Packed context blocks per query: (query_id, chunk_key, tier, context_rank, block, used_chars).

    ``chunks`` also needs doc_id, chunk_id and fetched_at.
    """
    lists = ranked_lists(chunks, queries, **options)
    ranked = materialize(rerank_fused(chunks, queries, fusion.rrf_fuse(lists, 3), scorer), "ranked")
    seeds = (
        chunks.select("chunk_key", "doc_id", "chunk_id", "url")
        .join(ranked.filter(F.col("rerank_rank") <= R.NEIGHBOR_TOP), "chunk_key")
        .filter(F.lower("url").rlike(neighbor_pattern))
        .select("query_id", "doc_id", "chunk_id")
    )
    near = fusion.expand_neighbors(seeds, chunks.select("chunk_key", "doc_id", "chunk_id"))
    tiers = [
        lists.filter((F.col("list_no") == 2) & (F.col("rank") <= R.SCOPED_KEEP)).select("query_id", "chunk_key", F.col("rank").alias("pos")),
        ranked.select("query_id", "chunk_key", F.col("rerank_rank").alias("pos")),
        near.select("query_id", "chunk_key", F.col("chunk_id").alias("pos")),
    ]
    merged = materialize(fusion.merge_tiers(tiers), "tiers")
    carried = [c for c in ("url", "title", "fetched_at", "context", "text") if c in chunks.columns]
    context = F.col("context") if "context" in carried else F.lit("")
    block = context_block(F.col("url"), F.col("title"), F.col("fetched_at"), context, F.col("text"))
    blocks = chunks.select("chunk_key", *carried).join(merged, "chunk_key").select(*merged.columns, block.alias("block"))
    return fusion.pack_context(blocks)


def build_prompts(queries: DataFrame, packed: DataFrame, history: DataFrame | None, system: str) -> DataFrame:
    """(query_id, prompt) for queries (query_id, text); history brings (query_id, history_text)."""
    q = queries.join(fusion.join_blocks(packed), "query_id", "left")
    if history is not None:
        q = q.join(history, "query_id", "left")
    else:
        q = q.withColumn("history_text", F.lit(""))
    return q.select(
        "query_id",
        F.when(F.col("context_text").isNotNull(), build_prompt(
            system, text_or_empty("history_text"), F.col("context_text"), F.col("text"))).alias("prompt"),
    )
