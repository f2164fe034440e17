"""Document store maintenance: duplicates, upserts, child replacement, source registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import urls
from foliant.plans.lineage import materialize
from foliant.plans.skew import attach_by_key, first_rows


def dedup_decisions(
    incoming: DataFrame, stored: DataFrame | None = None, chunk_counts: DataFrame | None = None,
    order: str = "doc_id",
) -> DataFrame:
    """Decide for every incoming page: saved, updated, or which kind of duplicate.

    ``incoming``: doc_id, source_id, canonical_url, content_hash (and ``order``);
    ``stored``: source_id, canonical_url, content_hash; ``chunk_counts``:
    canonical_url, n_chunks.  Batch rule: within one (source, hash) the row with
    the smallest (order, doc_id) wins.

    Only keys and hashes are shuffled, never text.  Copies are reduced to one row
    per (source, hash) map-side before the shuffle, and the result is attached
    with a hot-key safe join, so a group holding a third of all pages is fine.
    """
    key = ["source_id", "content_hash"]
    # Read several times below: the narrow key table is written once, so hashing runs once.
    inc = materialize(
        incoming.select("doc_id", *key, "canonical_url", *([order] if order != "doc_id" else [])), "incoming"
    )
    order_cols = [order] if order == "doc_id" else [order, "doc_id"]
    winners = first_rows(inc, key, order_cols, ["doc_id", "canonical_url"])
    per_hash = winners.select(
        *key, F.col("first_doc_id").alias("win_id"), F.col("first_canonical_url").alias("win_url"), "n_rows"
    )
    first_of_url = inc.groupBy("canonical_url").agg(
        F.min(F.struct(*order_cols)).getField("doc_id").alias("url_first_id")
    )
    if stored is None:
        per_hash = per_hash.withColumns({c: F.lit(None).cast("string") for c in ("old_min", "old_max")})
        by_url = None
    else:
        others = stored.groupBy(*key).agg(
            F.min("canonical_url").alias("old_min"), F.max("canonical_url").alias("old_max")
        )
        per_hash = per_hash.join(others, key, "left")
        by_url = stored.select("canonical_url", F.col("content_hash").alias("old_hash"))
        if chunk_counts is not None:
            by_url = by_url.join(chunk_counts.select("canonical_url", "n_chunks"), "canonical_url", "left")
        else:
            by_url = by_url.withColumn("n_chunks", F.lit(1).cast("bigint"))
    rows = attach_by_key(inc, materialize(per_hash, "per-hash"), key, "n_rows", "doc_id")
    rows = rows.join(first_of_url, "canonical_url", "left")
    if by_url is None:
        rows = rows.withColumns({"old_hash": F.lit(None).cast("string"), "n_chunks": F.lit(None).cast("bigint")})
    else:
        rows = rows.join(by_url, "canonical_url", "left")
    other_old = F.when(F.col("old_min") != F.col("canonical_url"), F.col("old_min")).when(
        F.col("old_max") != F.col("canonical_url"), F.col("old_max")
    )
    unchanged = (F.col("old_hash") == F.col("content_hash")) & (F.coalesce("n_chunks", F.lit(0)) > 0)
    decision = (
        F.when(unchanged, F.lit("duplicate_content"))
        .when(other_old.isNotNull(), F.lit("duplicate_content_other_url"))
        .when((F.col("win_id") != F.col("doc_id")) & (F.col("win_url") == F.col("canonical_url")),
              F.lit("duplicate_content"))
        .when(F.col("win_id") != F.col("doc_id"), F.lit("duplicate_content_other_url"))
        .when(F.col("old_hash").isNotNull() | (F.col("url_first_id") != F.col("doc_id")), F.lit("updated"))
        .otherwise(F.lit("saved"))
    )
    twin = F.when(F.col("decision") == "duplicate_content_other_url", F.coalesce(other_old, F.col("win_url")))
    return rows.withColumn("decision", decision).withColumn("same_as_url", twin).select(
        "doc_id", *key, "canonical_url", "decision", "same_as_url"
    )


def upsert_documents(stored: DataFrame, incoming: DataFrame, key: str = "canonical_url") -> DataFrame:
    """Stored rows overwritten by incoming rows of the same key; new keys appended.

    The stored ``original_filename`` and ``doc_id`` survive when the incoming
    value is empty.  ``incoming`` holds at most one row per key.
    """
    kept = [c for c in ("doc_id", "original_filename") if c in stored.columns]
    old = stored.select(F.col(key), *[F.col(c).alias(f"_old_{c}") for c in kept])
    merged = incoming.join(old, key, "left")

    def value(c: str):
        if c == "doc_id":
            return F.coalesce(F.col("_old_doc_id"), F.col("doc_id")).alias(c)
        if c == "original_filename":
            blank = F.coalesce(F.col(c), F.lit("")) == ""
            return F.when(blank, F.col("_old_original_filename")).otherwise(F.col(c)).alias(c)
        return F.col(c)

    fresh = merged.select(*[value(c) for c in stored.columns])
    return stored.join(incoming.select(key), key, "left_anti").unionByName(fresh)


def replace_children(stored: DataFrame, fresh: DataFrame, changed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop all stored children of changed parents and add the fresh ones."""
    return stored.join(changed.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh)


def register_sources(stored: DataFrame, seen: DataFrame, url: str = "url", at: str = "captured_at") -> DataFrame:
    """Get-or-create: known sources stay, unknown domains are added once.

    Domains are compared without ``www.``; a new source gets an id derived from
    its domain, so a repeated run creates the same row.
    """
    new = (
        seen.withColumn("domain", urls.registered_domain(url)).filter("domain <> ''")
        .groupBy("domain").agg(F.min(at).alias("created_at"))
    )
    known = stored.select(urls.registered_domain("domain").alias("domain")).distinct()
    digest = F.sha2(F.col("domain").cast("binary"), 256)
    made = new.join(known, "domain", "left_anti").select(
        F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4),
                    F.substring(digest, 17, 4), F.substring(digest, 21, 12)).alias("source_id"),
        "domain", "created_at",
    )
    return stored.unionByName(made)


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
