"""Rank fusion, reranking, neighbour expansion, tiers and context packing.

Everything past the first-stage lists works on at most a few dozen rows per
query, partitioned by query_id.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant import rules as R
from foliant.functions.text import let, strip, text_or_empty, tokens
from foliant.plans.once import explode_once


def stack_lists(lists: Sequence[DataFrame], key: str = "chunk_key") -> DataFrame:
    """Ranked lists (query_id, key, rank) stacked with their list number, from 0."""
    out = None
    for n, df in enumerate(lists):
        part = df.select("query_id", key, "rank", F.lit(n).alias("list_no"))
        out = part if out is None else out.unionByName(part)
    return out


def rrf_fuse(ranked: DataFrame, n_lists: int, c: int = R.RRF_C, top: int = R.RRF_TOP,
             key: str = "chunk_key") -> DataFrame:
    """Reciprocal rank fusion: sum of 1/(c + rank), rank from 1; ties keep list order, then rank.

    The sum runs over the lists in a fixed order, so equal rank sets give equal
    scores whatever the partitioning.
    """
    ranks = [F.min(F.when(F.col("list_no") == n, F.col("rank"))).alias(f"r{n}") for n in range(n_lists)]
    per_item = ranked.groupBy("query_id", key).agg(
        *ranks, F.min(F.struct("list_no", "rank")).alias("first_seen")
    )
    score = F.lit(0.0)
    for n in range(n_lists):
        score = score + F.coalesce(F.lit(1.0) / (F.lit(c) + F.col(f"r{n}")), F.lit(0.0))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("first_seen"))
    return (
        per_item.withColumn("score", score)
        .withColumn("fused_rank", F.row_number().over(order).cast("bigint"))
        .filter(F.col("fused_rank") <= top)
        .select("query_id", key, "score", "fused_rank")
    )


def overlap_scorer(pairs: DataFrame, key: str = "chunk_key") -> DataFrame:
    """Default pair scorer: idf-weighted term overlap within the query's candidate pool.

    Input (query_id, key, query_text, candidate_text), output (query_id, key, score).
    A model takes its place as any function with the same shape, for example
    ``lambda df: df.mapInPandas(batch_model, schema)``.
    """
    shared = F.array_intersect(F.array_distinct(tokens("query_text")), tokens("candidate_text"))
    hits = explode_once(pairs, ["query_id", key], shared, "term")
    pool = pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("pool"))
    idf = hits.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df")).join(pool, "query_id").select(
        "query_id", "term", F.log(1 + F.col("pool") / F.col("df")).alias("w")
    )
    scored = hits.join(idf, ["query_id", "term"]).groupBy("query_id", key).agg(F.sum("w").alias("score"))
    return pairs.select("query_id", key).join(scored, ["query_id", key], "left").select(
        "query_id", key, F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score")
    )


def rerank(candidates: DataFrame, scorer: Callable[[DataFrame], DataFrame] | None = None,
           top: int = R.FINAL_TOP, key: str = "chunk_key") -> DataFrame:
    """(query_id, key, score, rerank_rank) for candidates with fused_rank, query_text, candidate_text.

    A scorer value of null (failed pair) sinks to the end; ties keep fused order,
    so a scorer that fails throughout leaves the fused order.
    """
    usable = candidates.filter(strip(text_or_empty("candidate_text")) != "")
    scored = (scorer or (lambda d: overlap_scorer(d, key)))(
        usable.select("query_id", key, "query_text", "candidate_text")
    )
    joined = usable.select("query_id", key, "fused_rank").join(scored, ["query_id", key], "left")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), F.col("fused_rank"))
    return joined.withColumn("rerank_rank", F.row_number().over(order).cast("bigint")).filter(
        F.col("rerank_rank") <= top
    ).select("query_id", key, "score", "rerank_rank")


def expand_neighbors(seeds: DataFrame, chunks: DataFrame, radius: int = R.NEIGHBOR_RADIUS) -> DataFrame:
    """Chunks of the same document within ``radius`` ordinals of a seed.

    ``seeds``: query_id, doc_id, chunk_id.  The band condition becomes an
    equi-join by listing the few ordinals around every seed.
    """
    around = seeds.select(
        "query_id", "doc_id", F.explode(F.sequence(F.col("chunk_id") - radius, F.col("chunk_id") + radius)).alias("chunk_id")
    ).distinct()
    return chunks.join(around, ["doc_id", "chunk_id"])


def merge_tiers(tiers: Sequence[DataFrame], key: str = "chunk_key") -> DataFrame:
    """(query_id, key, tier, pos, context_rank): tiers in order, each key in its first tier only.

    Every tier brings (query_id, key, pos).
    """
    out = None
    for n, df in enumerate(tiers, start=1):
        part = df.select("query_id", key, F.struct(F.lit(n).alias("tier"), F.col("pos").cast("bigint").alias("pos")).alias("at"))
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("query_id", key).agg(F.min("at").alias("at"))
    order = Window.partitionBy("query_id").orderBy("at.tier", "at.pos", key)
    return best.select(
        "query_id", key, F.col("at.tier").cast("bigint").alias("tier"), F.col("at.pos").alias("pos"),
        F.row_number().over(order).cast("bigint").alias("context_rank"),
    )


def pack_by_budget(blocks: DataFrame, group: Sequence[str], order: Sequence[Column | str], length: Column,
                   budget: int) -> DataFrame:
    """Longest prefix per group whose lengths sum to at most ``budget``.

    Lengths are positive, so the running sum only grows: filtering on it equals
    stopping at the first block that does not fit.
    """
    upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("used_chars", F.sum(length).over(upto)).filter(F.col("used_chars") <= budget)


def pack_context(blocks: DataFrame, budget: int = R.CONTEXT_CHARS) -> DataFrame:
    """Adds used_chars and keeps blocks (query_id, context_rank, block) that fit the budget."""
    tidy = blocks.withColumn("block", strip(text_or_empty("block"))).filter("block <> ''")
    return pack_by_budget(tidy, ["query_id"], ["context_rank"], F.length("block"), budget)


def join_blocks(packed: DataFrame) -> DataFrame:
    """(query_id, context_text): the packed blocks of a query, in order (bounded by the budget)."""
    ordered = F.sort_array(F.collect_list(F.struct("context_rank", "block")))
    return packed.groupBy("query_id").agg(F.array_join(ordered["block"], R.BLOCK_JOIN).alias("context_text"))


def composite_rank(rows: DataFrame, url: str = "url", age_days: str = "age_days",
                   retrieval: str = "retrieval_score", intent: Column | None = None,
                   factual: Column | None = None) -> DataFrame:
    """Adds authority, freshness and the composite score (documented design formula)."""
    u = F.lower(text_or_empty(url))
    authority = (
        F.when(u.contains("/carreras/"), F.lit(40)).otherwise(F.lit(0))
        + F.when(u.contains("/oferta-academica/") | u.contains("/ofertas-acad/"), F.lit(20)).otherwise(F.lit(0))
        - F.when(u.rlike("sitemap|/tag/|/archive"), F.lit(30)).otherwise(F.lit(0))
        - F.when(u.rlike("/noticia|/evento") & (F.lit(True) if factual is None else factual), F.lit(20)).otherwise(F.lit(0))
    )
    a = F.col(age_days)
    freshness = F.when(a <= 30, 15).when(a <= 90, 10).when(a <= 180, 5).when(a > 365, -8).otherwise(0)
    bonus = F.lit(0) if intent is None else intent
    return rows.withColumns({
        "authority_bonus": authority.cast("bigint"), "freshness_bonus": freshness.cast("bigint"),
    }).withColumn(
        "final_score", F.col(retrieval) + F.col("authority_bonus") + F.col("freshness_bonus") + bonus
    )


def sentence_overlap_answer(question: Column, blocks: Column) -> Column:
    """Extractive stand-in for an answer model: the context sentence sharing most question terms."""
    sentences = F.filter(F.split(F.array_join(blocks, "\n"), r"(?<=[.!?])\s+|\n"), lambda s: F.length(s) > 0)

    def best(q: Column) -> Column:
        return F.array_max(F.transform(
            sentences,
            lambda s, i: F.struct(F.size(F.array_intersect(q, tokens(s))).alias("hits"), (-i).alias("i"), s.alias("s")),
        ))["s"]

    return F.coalesce(let(F.array_distinct(tokens(question)), best), F.lit(R.NO_INFO_RESPONSE))


def ngram_groundedness(answer: Column, context: Column, n: int = 3) -> Column:
    """Share of the answer's word n-grams that occur in the context (1.0 for very short answers)."""

    def grams(text: Column) -> Column:
        return let(tokens(text), lambda xs: F.when(F.size(xs) >= n, F.transform(
            F.sequence(F.lit(1), F.size(xs) - n + 1), lambda i: F.array_join(F.slice(xs, i, F.lit(n)), " ")
        )).otherwise(F.array().cast("array<string>")))

    return let(F.array_distinct(grams(answer)), lambda ag: F.when(F.size(ag) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(ag, grams(context))) / F.size(ag)
    ))
