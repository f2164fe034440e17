"""Mixing to target weights by iterative proportional fitting (DataFrame functions only).

Token counts are summed per cell (source, language, topic); the cells are raked
to the marginal targets of each dimension in turn.  A document is kept with
probability (raked weight / tokens) / (largest such ratio) of its cell, drawn
from a hash of its id and text, so the same documents are kept at every run.

The rounds go on until every marginal is met within ``tolerance``, so the kept tokens
meet the targets in expectation; where no weights of the given cells meet all
targets, they end when a round no longer brings them nearer.  A caller may bound
the ratio (``max_ratio``, with a fixed number of ``rounds``): more documents stay then,
of a mix between the table's and the wanted one.

A target is an exponent (shares go with tokens ** exponent: below 1 flattens) or
a mapping of values to shares.

Defined cases: null source or language is a value of its own; a null text has no
tokens and topic ``other``; cells without tokens keep their documents at
probability 1 / (largest ratio); values missing from a mapping get weight 0; rows
with equal id and text share their draw; an empty table gives an empty result; a column
named like one of the results is replaced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.plans.lineage import discard, materialize

WORD = r"[^\x20\x09-\x0D]+"
TOPICS = (("licence", r"(?i)licen[cs]ed|copyright"), ("table", r" \| "), ("numbers", r"[0-9]{3}"))
DIMENSIONS = ("source", "lang", "topic")
NULL = "\x00"
SALTS = 16
TOLERANCE = 1e-10
ROUNDS_A_STEP = 4  # rounds between two looks at the targets
CELLS_A_TASK = 50_000


def topic_of(text: Column, topics: Sequence[tuple[str, str]] = TOPICS) -> Column:
    """The first topic whose pattern occurs in the text."""
    out = F.lit("other")
    for name, pattern in reversed(topics):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def draw(doc_id: Column, text: Column, seed: str = "mix") -> Column:
    """Uniform number in [0, 1) from the id and the text (texts without an id are drawn one by one)."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"),
                            F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def with_cells(docs: DataFrame, topics: Sequence[tuple[str, str]] = TOPICS) -> DataFrame:
    """Adds topic, tokens and the null-free cell keys."""
    out = docs.withColumns({
        "topic": topic_of(F.col("text"), topics),
        "tokens": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
    })
    return out.withColumns({f"_{d}": F.coalesce(F.col(d), F.lit(NULL)) for d in DIMENSIONS})


def _for_rounds(spark: SparkSession, cells: int) -> SparkSession:
    """A session with the settings of ``spark``, for many shuffles of a small table of known size.

    Adaptive execution plans anew after each shuffle and starts a thread in the driver for it, which stays for
    a minute; a run of rounds has a hundred shuffles, and the driver's memory would grow with them.
    """
    out = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            out.conf.set(key, value)
    out.conf.set("spark.sql.adaptive.enabled", "false")
    out.conf.set("spark.sql.shuffle.partitions", str(cells // CELLS_A_TASK + 1))
    return out


def rake(cells: DataFrame, targets: Mapping[str, float | Mapping[str, float]], max_ratio: float | None = None,
         rounds: int = 6, tolerance: float = TOLERANCE) -> DataFrame:
    """Cells ``(_source, _lang, _topic, n)`` with their raked weight ``w``; without ``max_ratio``, ``rounds`` has no meaning."""
    keys = [f"_{d}" for d in DIMENSIONS]
    spark, given = cells.sparkSession, materialize(cells, "cells")
    cells = _for_rounds(spark, given.count()).read.schema(given.schema).parquet(given._staged_in)
    total = cells.agg(F.sum("n").cast("double").alias("_total"))
    now = cells.withColumn("w", F.col("n").cast("double"))
    for d, goal in targets.items():
        sums = cells.groupBy(f"_{d}").agg(F.sum("n").cast("double").alias("_n"))
        share = F.pow("_n", F.lit(float(goal))) if isinstance(goal, int | float) else _share(F.col(f"_{d}"), goal)
        sums = sums.withColumn("_s", F.when(F.col("_n") > 0, share).otherwise(0.0))
        scale = sums.agg(F.sum("_s").alias("_all")).crossJoin(total)  # one row by one row
        now = now.join(sums.crossJoin(F.broadcast(scale)).select(
            f"_{d}", (F.col("_s") / F.col("_all") * F.col("_total")).alias(f"_goal_{d}")), f"_{d}")
    now = materialize(now.withColumn("_off", F.lit(0.0)), "raked")
    discard(given)
    off, done = float("inf"), 0
    while max_ratio is None or done < rounds:
        before = off
        for _ in range(ROUNDS_A_STEP if max_ratio is None else rounds):
            done += 1
            old, now = now, now.withColumn("_off", F.lit(0.0))
            for d in targets:
                own, goal = F.sum("w").over(Window.partitionBy(f"_{d}")), F.col(f"_goal_{d}")
                now = now.withColumn("_sum", own)
                moved = F.col("w") * F.when(F.col("_sum") > 0, goal / F.col("_sum")).otherwise(1.0)
                if max_ratio is not None:
                    moved = F.least(moved, F.col("n") * F.lit(max_ratio))
                missed = F.when(goal > 0, F.abs(F.col("_sum") / goal - 1)).otherwise(0.0)
                now = now.withColumns({"w": moved, "_off": F.greatest("_off", missed)}).drop("_sum")
            now = materialize(now, "raked")
            discard(old)
        off = now.agg(F.max("_off")).first()[0] or 0.0
        if max_ratio is None and (off < tolerance or off > 0.99 * before):
            break
    return spark.read.schema(now.schema).parquet(now._staged_in).select(*keys, "n", "w")


def _share(value: Column, goal: Mapping[str, float]) -> Column:
    out = F.lit(0.0)
    for k, v in goal.items():
        out = F.when(value == F.lit(NULL if k is None else k), F.lit(float(v))).otherwise(out)
    return out


def mix(docs: DataFrame, targets: Mapping[str, float | Mapping[str, float]], max_ratio: float | None = None, rounds: int = 6,
        topics: Sequence[tuple[str, str]] = TOPICS, columns: Sequence[str] | None = None) -> DataFrame:
    """``columns`` of every document plus topic, tokens, prob and kept.

    The probabilities of the cells are written once and joined back by a salted
    key, so a cell that holds a third of all rows is spread over many tasks
    (or broadcast, where Spark measures the table as small).
    """
    columns = list(columns or docs.columns)
    keys = [f"_{d}" for d in DIMENSIONS]
    rows = with_cells(docs, topics)
    cells = rows.groupBy(*keys).agg(F.sum("tokens").alias("n"))
    weights, top = rake(cells, targets, max_ratio, rounds), max_ratio
    if top is None:
        top = weights.filter("n > 0").agg(F.max(F.col("w") / F.col("n"))).first()[0] or 1.0
    prob = F.when(F.col("n") > 0, F.col("w") / F.col("n")).otherwise(1.0) / F.lit(top)
    raked = materialize(weights.select(*keys, prob.alias("prob")), "probabilities")
    salted = raked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0))), F.lit(SALTS)).cast("int")
    rows = rows.drop("prob", "kept").withColumn("_salt", salt)
    out = rows.join(salted, [*keys, "_salt"])
    names = dict.fromkeys([*(c for c in columns if c not in ("prob", "kept")), "topic", "tokens"])
    return out.select(*names, "prob", (draw(F.col("doc_id"), F.col("text")) < F.col("prob")).alias("kept"))
