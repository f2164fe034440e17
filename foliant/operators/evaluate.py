"""Evaluation: scoring gates, aggregates, run comparison, retrieval metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant import rules as R
from foliant.functions.answers import judge_context, probe_declined
from foliant.functions.text import col, contains_any, strip, text_or_empty


def is_refusal_case(category: Column | str, expects: Column | str) -> Column:
    return F.lower(strip(text_or_empty(category))).isin(*R.REFUSAL_CATEGORIES) | F.coalesce(col(expects), F.lit(False))


def eval_prompts(items: DataFrame, template: str, chunks: str = "context_chunks") -> DataFrame:
    """Adds prompt: ``template`` with {question}, {expected_facts}, {context}, {answer} filled in."""
    out = F.lit(template)
    for name, value in (
        ("{question}", strip(text_or_empty("question"))),
        ("{expected_facts}", F.to_json(F.coalesce("expected_facts", F.array().cast("array<string>")))),
        ("{context}", judge_context(F.coalesce(chunks, F.array().cast("array<string>")))),
        ("{answer}", strip(text_or_empty("answer"))),
    ):
        out = F.replace(out, F.lit(name), value)
    return items.withColumn("prompt", out)


def contains_judge(items: DataFrame) -> DataFrame:
    """Default judge without a model.

    correctness = share of expected facts named in the answer, faithfulness =
    share of answer words present in the context, hallucinated = a forbidden
    string occurs, refusal_correct = the answer declines.
    """
    answer = F.lower(strip(text_or_empty("answer")))
    facts = F.coalesce("expected_facts", F.array().cast("array<string>"))
    named = F.filter(facts, lambda f: F.contains(answer, F.lower(f)))
    words = F.array_distinct(F.filter(F.split(answer, r"[^\p{L}0-9]+"), lambda w: w != ""))
    context = F.split(F.lower(F.array_join(F.coalesce("context_chunks", F.array().cast("array<string>")), " ")), r"[^\p{L}0-9]+")
    forbidden = F.coalesce("must_not_contain", F.array().cast("array<string>"))
    return items.withColumns({
        "j_correctness": F.when(F.size(facts) == 0, F.lit(1.0)).otherwise(F.size(named) / F.size(facts)),
        "j_faithfulness": F.when(F.size(words) == 0, F.lit(0.0)).otherwise(
            F.size(F.array_intersect(words, context)) / F.size(words)),
        "j_hallucinated": F.exists(forbidden, lambda f: F.contains(answer, F.lower(f))),
        "j_refusal": contains_any(answer, R.DECLINE_MARKERS),
    })


def score_items(items: DataFrame, judge: Callable[[DataFrame], DataFrame] = contains_judge) -> DataFrame:
    """Scored items: judge values clamped and routed by the refusal rule; empty answers score zero."""
    refusal = is_refusal_case("category", "expects_clarification")
    empty = strip(text_or_empty("answer")) == ""

    def clamp(c: str) -> Column:
        return F.least(F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))

    def routed(c: str) -> Column:
        return F.when(empty, F.lit(0.0)).when(~refusal, clamp(c))

    return judge(items).select(
        "id", F.lower(strip(text_or_empty("category"))).alias("category"), "difficulty", "expects_clarification",
        "answer", "error", "elapsed_ms",
        F.coalesce(F.size("context_chunks"), F.lit(0)).alias("context_chunks_count"),
        routed("j_correctness").alias("correctness"), routed("j_faithfulness").alias("faithfulness"),
        F.when(empty, F.lit(False)).otherwise(F.coalesce("j_hallucinated", F.lit(False))).alias("hallucinated"),
        F.when(~empty & refusal, F.coalesce("j_refusal", F.lit(False))).alias("refusal_correct"),
        F.when(empty, F.lit("empty_answer")).alias("judge_error"),
    )


def eval_metrics(scored: DataFrame) -> DataFrame:
    """Metrics per category and overall in one pass (grouping sets; overall has category null)."""
    blank = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("unknown"))

    def rate(flag: Column) -> Column:
        return F.round(F.avg(F.when(flag, 1.0).when(flag.isNotNull(), 0.0)), 3)

    return scored.withColumn("category", blank).groupingSets([["category"], []], "category").agg(
        F.grouping("category").cast("bigint").alias("is_global"),
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("correctness"), 3).alias("correctness_avg"),
        F.round(F.avg("faithfulness"), 3).alias("faithfulness_avg"),
        rate(F.coalesce("hallucinated", F.lit(False))).alias("hallucination_rate"),
        rate(F.col("refusal_correct")).alias("refusal_correct_rate"),
        F.count_if(text_or_empty("error") != "").alias("errors"),
    )


def judge_probe(rows: DataFrame) -> DataFrame:
    """Adds decline and ok by the success policy (a decline is right exactly when expected)."""
    declined = probe_declined("answer")
    return rows.withColumn("decline", declined).withColumn(
        "ok", F.when(F.coalesce("expects_decline", F.lit(False)), declined).otherwise(~declined)
    )


def probe_summary(rows: DataFrame) -> DataFrame:
    """Totals per category and overall; overall has category null and two-digit percentages."""
    out = rows.withColumn("category", F.coalesce("category", F.lit("unknown"))).groupingSets([["category"], []], "category").agg(
        F.grouping("category").cast("bigint").alias("is_global"),
        F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("ok", F.lit(False))).alias("ok"),
        F.round(F.avg(F.coalesce("duration_s", F.lit(0.0))), 2).alias("avg_duration_s"),
        F.round(F.coalesce(F.avg("groundedness"), F.lit(0.0)), 3).alias("avg_groundedness"),
    )
    pct = F.col("ok") * 100.0 / F.greatest(F.col("total"), F.lit(1))
    return out.withColumns({
        "fail": F.col("total") - F.col("ok"),
        "ok_pct": F.when(F.col("is_global") == 1, F.round(pct, 2)).otherwise(F.round(pct, 1)),
    })


def worst_categories(summary: DataFrame, top: int = 15) -> DataFrame:
    """Categories by failure rate, small ones first among equals, ``top`` rows (a report)."""
    rate = F.col("fail") / F.greatest(F.col("total"), F.lit(1))
    return summary.filter(F.col("is_global") == 0).withColumn("fail_rate", F.round(rate, 6)).orderBy(
        F.col("fail_rate").desc(), "total", "category"
    ).limit(top)


def probe_failures(rows: DataFrame) -> DataFrame:
    """Failed rows for the report, answers cut to 300 characters."""
    return rows.filter(~F.coalesce("ok", F.lit(False))).select(
        "id", "category", "q", F.substring(text_or_empty("answer"), 1, 300).alias("answer"),
        "groundedness", "expects_decline", "decline", "error",
    )


def remaining(items: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Resume: items without a result."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def failed_only(items: DataFrame, results: DataFrame, key: str = "id") -> DataFrame:
    """Rerun: items whose result failed."""
    return items.join(results.filter(~F.coalesce("ok", F.lit(False))).select(key), key, "left_semi")


def select_items(items: DataFrame, ids: list | None = None, limit: int | None = None, order: str = "id") -> DataFrame:
    out = items.filter(F.col("id").isin(ids)) if ids else items
    return out.orderBy(order).limit(limit) if limit else out


def compare_runs(metrics: DataFrame, order: str = "stage", max_drop: float = 0.05) -> DataFrame:
    """Deltas to the run before, and whether the regression gate passes.

    One row per run, so the ordering window holds as many rows as there are runs.
    """
    w = Window.orderBy(order)
    d_corr = F.round(F.col("correctness") - F.lag("correctness").over(w), 6)
    d_hall = F.round(F.col("hallucination") - F.lag("hallucination").over(w), 6)
    passes = ~((F.coalesce(d_corr, F.lit(0.0)) < -max_drop) | (F.coalesce(d_hall, F.lit(0.0)) > 0))
    return metrics.withColumns({"correctness_delta": d_corr, "hallucination_delta": d_hall, "gate_passed": passes})


def retrieval_at_k(ranked: DataFrame, relevant: DataFrame, key: str, k: int) -> DataFrame:
    """Per query: hits within ``k``, first hit rank, reciprocal rank.

    ``relevant`` holds (query_id, key) pairs; both sides are keyed by the pair,
    so a query with very many relevant items stays spread out.
    """
    top = ranked.filter(F.col("rank") <= k)
    hits = top.join(relevant.select("query_id", key).distinct().withColumn("_rel", F.lit(1)), ["query_id", key], "left")
    first = F.min(F.when(F.col("_rel") == 1, F.col("rank")))
    return hits.groupBy("query_id").agg(
        F.count("_rel").alias("hits"), F.round(F.count("_rel") / F.lit(k), 6).alias("precision_at_k"),
        first.alias("first_hit_rank"), F.round(F.coalesce(1.0 / first, F.lit(0.0)), 6).alias("reciprocal_rank"),
    )


def value_at_rank(values: DataFrame, rank: int, bins: int = 4096) -> float:
    """The value of rank ``rank`` (from 0) of the non-null double column ``v``.

    Values are counted per bin of the range (summed map-side, at most ``bins``
    rows come back); the bin that holds the rank becomes the next range until it
    holds a single value.  No task ever gathers the values.
    """
    part, before = values, 0
    lo, hi = values.agg(F.min("v"), F.max("v")).first()
    while lo < hi:
        width = (hi - lo) / bins
        bin_ = F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)).alias("b")
        counts = part.groupBy(bin_).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        for row in counts.orderBy("b").collect():
            if before + row["n"] > rank:
                break
            before += row["n"]
        lo, hi = row["lo"], row["hi"]
        part = values.filter(F.col("v").between(lo, hi))
    return lo


def latency_p95(rows: DataFrame, value: str = "elapsed_ms", share: float = 0.95) -> DataFrame:
    """Exact percentile with linear interpolation (null without values)."""
    values = rows.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    n = values.count()
    out = None
    if n:
        place = share * (n - 1)
        low = value_at_rank(values, int(place))
        high = value_at_rank(values, min(int(place) + 1, n - 1))
        out = low + (high - low) * (place - int(place))
    return rows.sparkSession.range(1).select(F.round(F.lit(out).cast("double"), 6).alias("p95"))


def citation_hits(cited: DataFrame, truth: DataFrame, urls_of: str = "urls", truth_urls: str = "ground_truth_urls") -> DataFrame:
    """Per query: cited URLs, how many of them are ground truth, and the place of the first (0 without one).

    ``cited``: query_id and an ordered array of URLs; ``truth``: query_id and an array. URLs are
    compared in canonical form; a URL cited twice counts once. Queries without ground truth have no row.
    """
    from foliant.functions import urls

    def tidy(name: str):
        return F.array_distinct(F.filter(F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")), urls.canonical_url), lambda u: u != ""))

    both = truth.select("query_id", tidy(truth_urls).alias("_t")).filter(F.size("_t") > 0).join(
        cited.select("query_id", tidy(urls_of).alias("_c")), "query_id", "left")
    found = F.transform(F.coalesce("_c", F.array().cast("array<string>")), lambda u: F.array_contains("_t", u))
    place = F.array_position(found, True)
    return both.select("query_id", F.size(found).cast("bigint").alias("n_cited"), F.size(F.filter(found, lambda h: h)).cast("bigint").alias("n_hits"),
                       (place > 0).alias("hit"), place.cast("bigint").alias("first_hit"))
