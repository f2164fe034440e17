"""Mergeable sketches of sessions and response times, kept per key and day, merged for any range.

A theta sketch counts distinct sessions, a KLL sketch gives quantiles; both are a few
kilobytes however many rows they saw, are built map-side, and merge without the rows.  The exact forms
(``access.source_overview``, ``evaluate.latency_percentile``) stay for what must be exact.

With the default sizes the distinct count is within ``COUNT_ERROR`` and the rank of a quantile within
``RANK_ERROR`` of the true one, each in 99 of 100 cases.  Nulls are not seen; a
range without rows gives no result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_ENTRIES, K = 12, 200
COUNT_ERROR = 3 / 2 ** (LOG_ENTRIES / 2)  # three standard errors of a theta sketch
RANK_ERROR = 0.0165  # of a KLL sketch with k = 200, single quantiles, at 99 %


def daily(rows: DataFrame, keys: Sequence[str], at: str, session: str, value: str) -> DataFrame:
    """(keys, day, n, sessions, times): one row of sketches per key and day."""
    return rows.groupBy(*keys, F.to_date(at).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.theta_sketch_agg(session, LOG_ENTRIES).alias("sessions"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), K).alias("times"))


def merged(sketches: DataFrame, keys: Sequence[str], first: Column | None = None, last: Column | None = None) -> DataFrame:
    """(keys, n, sessions, times) of all days from ``first`` to ``last``; a coarser table of sketches, or a range to ask."""
    days = sketches
    if first is not None:
        days = days.filter(F.col("day") >= first)
    if last is not None:
        days = days.filter(F.col("day") <= last)
    return days.groupBy(*keys).agg(F.sum("n").alias("n"), F.theta_union_agg("sessions", LOG_ENTRIES).alias("sessions"),
                                   F.kll_merge_agg_double("times", K).alias("times"))


def estimates(sketches: DataFrame, quantiles: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """The sketch columns replaced by ``n_sessions`` and one value per quantile (``q50``, ``q95``)."""
    kept = [c for c in sketches.columns if c not in ("sessions", "times")]
    return sketches.select(*kept, F.theta_sketch_estimate("sessions").alias("n_sessions"), *[
        F.kll_sketch_get_quantile_double("times", F.lit(float(q))).alias(f"q{round(q * 100)}") for q in quantiles])
