"""Sources, grants and access checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import urls
from foliant.functions.text import strip, text_or_empty

LOCAL_HOSTS = ("localhost", "127.0.0.1", "::1")


def source_overview(sources: DataFrame, documents: DataFrame, chunks: DataFrame, messages: DataFrame,
                    limit: int | None = None) -> DataFrame:
    """One row per source with document, chunk and session counts, freshest first.

    Every side is aggregated to one row per source before it is joined (no
    fan-out).  Chunks are counted per document first, so the second grouping
    moves one number per document.
    """
    docs = documents.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("documents_count"),
        F.min("fetched_at").alias("first_fetched_at"), F.max("fetched_at").alias("last_fetched_at"),
    )
    per_doc = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    n_chunks = documents.select("doc_id", "source_id").join(per_doc, "doc_id", "left").groupBy("source_id").agg(
        F.sum(F.coalesce("n", F.lit(0))).cast("bigint").alias("chunks_count")
    )
    sessions = messages.filter((F.col("role") == "user") & F.col("source_id").isNotNull()).groupBy("source_id").agg(
        F.count_distinct("session_id").alias("sessions_count")
    )
    out = sources.join(docs, "source_id", "left").join(n_chunks, "source_id", "left").join(sessions, "source_id", "left")
    out = out.select(
        "source_id", "domain", "created_at",
        F.coalesce("documents_count", F.lit(0)).cast("bigint").alias("documents_count"),
        "first_fetched_at", "last_fetched_at",
        F.coalesce("chunks_count", F.lit(0)).cast("bigint").alias("chunks_count"),
        F.coalesce("sessions_count", F.lit(0)).cast("bigint").alias("sessions_count"),
    ).orderBy(F.coalesce("last_fetched_at", "created_at").desc(), "source_id")
    return out.limit(limit) if limit else out


def recent_sources(sources: DataFrame, limit: int = 100) -> DataFrame:
    return sources.orderBy(F.col("created_at").desc(), "source_id").limit(max(limit, 1))


def pick_source(sources: DataFrame, newest: bool = False) -> DataFrame:
    """One source per registered domain: the oldest, or the newest, of its spellings."""
    at = F.struct(F.col("created_at").alias("t"), F.col("source_id").alias("s"))
    best = (F.max(at) if newest else F.min(at)).alias("b")
    return sources.withColumn("domain_key", urls.registered_domain("domain")).filter("domain_key <> ''").groupBy(
        "domain_key"
    ).agg(best).select("domain_key", F.col("b.s").alias("source_id"))


def resolve_references(requests: DataFrame, sources: DataFrame, ref: str = "ref", origin: str = "origin",
                       referer: str = "referer") -> DataFrame:
    """Adds source_id for a batch of requests: an id, a domain, else the caller's own domain."""
    by_domain = pick_source(sources)
    blank = strip(text_or_empty(ref)) == ""
    caller = F.when(strip(text_or_empty(origin)) != "", urls.registered_domain(origin)).otherwise(
        urls.registered_domain(referer)
    )
    keyed = requests.withColumns({
        "_id": F.when(urls.looks_like_uuid(ref), F.lower(strip(ref))),
        "_domain": F.when(blank, caller).otherwise(urls.registered_domain(ref)),
    })
    known = sources.select(F.lower("source_id").alias("_id"), F.col("source_id").alias("_by_id"))
    found = by_domain.select(F.col("domain_key").alias("_domain"), F.col("source_id").alias("_by_domain"))
    return keyed.join(known, "_id", "left").join(found, "_domain", "left").select(
        *requests.columns, F.when(F.col("_id").isNotNull(), F.col("_by_id")).otherwise(F.col("_by_domain")).alias("source_id")
    )


def allowed_requests(requests: DataFrame, sources: DataFrame, origin: str = "origin", test_origin: str = "",
                     source: str | None = None) -> DataFrame:
    """Adds allowed: the origin host is a spelling of a registered domain (of ``source`` when named)."""
    norm = urls.origin_of(origin)
    host = urls.host_exact(norm)
    req = requests.withColumns({"_norm": norm, "_host": host})
    hosts = sources.select("source_id", F.explode(urls.domain_variants("domain")).alias("_host"))
    if source is None:
        known = hosts.select("_host").distinct().withColumn("_known", F.lit(True))
        joined = req.join(known, "_host", "left")
    else:
        known = hosts.select(F.col("source_id").alias(source), "_host").distinct().withColumn("_known", F.lit(True))
        joined = req.join(known, [source, "_host"], "left")
    local = F.col("_host").isin(*LOCAL_HOSTS)
    test = (F.col("_norm") == test_origin) if test_origin else F.lit(False)
    ok = (F.col("_norm") != "") & (local | test | F.coalesce("_known", F.lit(False)))
    return joined.withColumn("allowed", ok).select(*requests.columns, "allowed")


def granted(requests: DataFrame, users: DataFrame, grants: DataFrame) -> DataFrame:
    """Requests (api_key, source_id) whose key holds a grant for the source."""
    keys = users.join(grants, "user_id").select("api_key", "source_id")
    return requests.join(keys, ["api_key", "source_id"], "left_semi")


def user_sources(users: DataFrame, grants: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources per user, newest grant first."""
    return users.select("user_id").join(grants, "user_id").join(sources.select("source_id", "domain"), "source_id", "left").select(
        "user_id", "source_id", "domain", F.col("created_at").alias("linked_at")
    ).orderBy(F.col("linked_at").desc(), "user_id", "source_id")


def link_sources(grants: DataFrame, wanted: DataFrame) -> DataFrame:
    """Idempotent grants: only pairs that do not exist yet are added, each once."""
    fresh = wanted.groupBy("user_id", "source_id").agg(F.min("created_at").alias("created_at"))
    return grants.unionByName(fresh.join(grants, ["user_id", "source_id"], "left_anti").select(*grants.columns))


def unlink_sources(grants: DataFrame, revoked: DataFrame, users: DataFrame) -> DataFrame:
    """Grants without the (external user id, source) pairs in ``revoked``."""
    pairs = revoked.join(users.select("external_id", "user_id"), "external_id").select("user_id", "source_id")
    return grants.join(pairs, ["user_id", "source_id"], "left_anti")


def latest_profiles(events: DataFrame, key: str, at: str, fields: list[str]) -> DataFrame:
    """Latest non-null value of every field per user (later nulls never erase an earlier value)."""
    newest = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.struct(F.col(at), F.col(f)))).alias(f) for f in fields]
    return events.groupBy(key).agg(*newest, F.max(at).alias("updated_at"), F.min(at).alias("created_at"))


def chunk_scope(chunks: DataFrame, documents: DataFrame, sources: DataFrame, domains: DataFrame) -> DataFrame:
    """Chunks of the wanted domains with their document and source columns.

    The domain filter reaches the documents through the small source side first;
    chunks are then joined on doc_id, which is evenly spread even for a source
    that owns a third of the corpus.
    """
    wanted = domains.select(urls.registered_domain("domain").alias("_d")).distinct()
    scope = sources.withColumn("_d", urls.registered_domain("domain")).join(wanted, "_d", "left_semi").select("source_id", "domain")
    docs = documents.join(scope, "source_id")
    return chunks.join(docs, "doc_id")
