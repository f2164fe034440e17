"""Crawl metrics: counters, rates, progress, page target, report lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import let
from foliant.operators.links import first_occurrences
from foliant.plans.skew import running_cutoff


def crawl_counters(outcomes: DataFrame, job: str = "job_id", outcome: str = "outcome") -> DataFrame:
    """One row of counters per job from labelled page results (one map-side aggregate)."""
    o = F.col(outcome)

    def n(cond: Column) -> Column:
        return F.count_if(cond)

    out = outcomes.groupBy(job).agg(
        F.count(F.lit(1)).alias("processed_results"),
        n(o == "blocked_host").alias("blocked_by_host_filter"),
        n(o == "blocked_pattern").alias("blocked_by_block_filter"),
        n(~o.isin("blocked_host", "blocked_pattern", "failed_fetch")).alias("successful_results"),
        n(o.startswith("invalid:")).alias("skipped_invalid_content"),
        n(o.startswith("skipped:")).alias("skipped_ingestion"),
        n((o == "accepted") | o.startswith("skipped:")).alias("accepted_valid_pages"),
        n(o == "accepted").alias("saved_docs"),
        n(((o == "accepted") | o.startswith("skipped:")) & F.coalesce(F.col("priority"), F.lit(False))).alias("matched_allow_filter"),
    )
    return out.withColumn("filtered_total", F.col("blocked_by_host_filter") + F.col("blocked_by_block_filter"))


def job_rates(jobs: DataFrame, now: str = "now") -> DataFrame:
    """Throughput, freshness, staleness and ETA per job.

    Needs started_at, updated_at, ``now``, status, total_results,
    processed_results, saved_docs, accepted_valid_pages.
    """
    def millis(a: str, b: str) -> Column:
        return F.timestamp_diff("MILLISECOND", F.col(a), F.col(b))

    elapsed = F.greatest(millis("started_at", now) / 1000.0, F.lit(0.0))
    fresh = F.greatest(millis("updated_at", now), F.lit(0)).cast("bigint")
    running = F.col("status").isin("running", "pending")

    def per_sec(c: str) -> Column:
        return F.when(F.col("_e") > 0, F.round(F.col(c) / F.col("_e"), 3)).otherwise(F.lit(0.0))

    rate = F.col("processed_results") / F.col("_e")
    left = F.greatest(F.greatest(F.col("total_results"), F.lit(1)) - F.col("processed_results"), F.lit(0))
    eta = F.when(
        (F.col("_e") >= 3.0) & (F.col("processed_results") >= 3),
        F.least(F.floor(left / rate), F.lit(3600)).cast("bigint"),
    )
    return jobs.withColumn("_e", elapsed).withColumns({
        "elapsed_seconds": F.round("_e", 2), "freshness_ms": fresh,
        "is_stale": running & (fresh > 12000),
        "in_discovery": running & (F.col("processed_results") == 0),
        "processed_per_sec": per_sec("processed_results"), "saved_per_sec": per_sec("saved_docs"),
        "valid_per_sec": per_sec("accepted_valid_pages"), "eta_seconds": eta,
    }).drop("_e")


def stop_at_target(pages: DataFrame, target: int, job: str = "job_id", position: str = "position",
                   accepted: str = "accepted", width: int = 1_000_000) -> DataFrame:
    """Rows up to and including the ``target``-th accepted page of every job, in arrival order.

    The cutoff per job is found by stretch counts (see ``running_cutoff``) and is
    one row per job, so the final join never moves a large job to one task: it is
    attached with a hot-key safe join.
    """
    from foliant.plans.skew import attach_by_key

    cut = running_cutoff(pages, job, position, accepted, target, width)
    sizes = pages.groupBy(job).agg(F.count(F.lit(1)).alias("_n")).join(cut, job, "left")
    out = attach_by_key(pages, sizes, [job], "_n", position)
    return out.filter(F.col("cutoff").isNull() | (F.col(position) <= F.col("cutoff"))).drop("_n")


def report_lists(outcomes: DataFrame, value: str = "url", position: str = "position") -> DataFrame:
    """The five reason lists of a crawl report: distinct entries in first-seen order."""
    def labelled(o: Column) -> Column:
        name = (
            F.when(o == "blocked_host", "blocked_by_host_filter")
            .when(o == "blocked_pattern", "blocked_by_block_filter")
            .when(o == "failed_fetch", "failed_fetch_or_scrape")
            .when(o.startswith("invalid:"), "skipped_invalid_content")
            .when(o.startswith("skipped:"), "skipped_ingestion")
        )
        reason = F.regexp_extract(o, "^(?:invalid|skipped):(.*)$", 1)
        entry = F.when(reason == "", F.col(value)).otherwise(F.concat(F.col(value), F.lit("\t"), reason))
        return F.struct(name.alias("list"), entry.alias("entry"))

    # One struct column: the outcome expression is evaluated once, not once per branch.
    keyed = outcomes.select(let(F.col("outcome"), labelled).alias("_k"), F.col(position).alias("position"))
    firsts = first_occurrences(keyed, "_k", ["position"])
    return firsts.select("_k.list", "_k.entry", "first_position", "times").filter(
        F.col("list").isNotNull() & (F.coalesce("entry", F.lit("")) != "")
    )


def crawl_summary(outcomes: DataFrame, target: int | None = None, job: str = "job_id", at: str = "ts", document: str = "is_document",
                  links: str = "document_links") -> DataFrame:
    """Per job: page counters, counters of linked documents, wall clock, and why it ended.

    ``document`` marks results that are linked files, ``links`` counts the file links of a page.
    A job ended with ``target_reached`` when it accepted at least ``target`` valid pages, else ``completed``.
    """
    doc, o = F.coalesce(F.col(document), F.lit(False)), F.col("outcome")
    pages = crawl_counters(outcomes.filter(~doc), job)
    n = lambda cond: F.count_if(doc & cond)
    rest = outcomes.groupBy(job).agg(
        F.sum(F.coalesce(F.when(~doc, F.col(links)), F.lit(0))).cast("bigint").alias("document_links_found"),
        n(F.lit(True)).alias("documents_processed"), n(o == "accepted").alias("documents_saved"),
        n(o.startswith("skipped:") | o.startswith("invalid:")).alias("documents_skipped"), n(o == "failed_fetch").alias("document_errors"),
        F.min(at).alias("started_at"), F.max(at).alias("ended_at"))
    rest = rest.withColumn("wall_seconds", F.round(F.timestamp_diff("MILLISECOND", "started_at", "ended_at") / 1000.0, 3))
    out = rest.join(pages, job, "left")
    counted = F.coalesce("accepted_valid_pages", F.lit(0))
    reached = counted >= F.lit(target) if target is not None else F.lit(False)
    return out.withColumn("finished_reason", F.when(reached, "target_reached").otherwise("completed"))
