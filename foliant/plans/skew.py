"""Joins and groupings that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than 1/HOT_SHARE of all rows, so there can be
# at most HOT_SHARE hot keys - whatever the data size.  That is the size bound
# behind the broadcast below.
HOT_SHARE = 1000


def attach_by_key(
    rows: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    weight: str,
    row_id: str,
    hot_share: int = HOT_SHARE,
) -> DataFrame:
    """Left-join ``rows`` with ``per_key`` (unique on ``keys``) without a hot shuffle partition.

    ``weight`` names the column of ``per_key`` holding the number of rows per
    key (a by-product of the aggregate that built it).  Hot keys - at most
    ``hot_share`` of them, see above - are broadcast and joined where the rows
    already are.  Their rows then take a unique key into the shuffle join, so
    they spread evenly; all other keys join normally.  Nothing is dropped.
    """
    extra = [c for c in per_key.columns if c not in keys]
    total = per_key.agg(F.sum(weight).alias("t")).scalar()
    hot = per_key.filter(F.col(weight) * F.lit(hot_share) > total)
    hot = hot.select(*keys, F.lit(True).alias("_hot"), *[F.col(c).alias(f"_h_{c}") for c in extra])
    tagged = rows.join(F.broadcast(hot), list(keys), "left")
    cold_key = F.concat_ws("\x01", *[F.coalesce(F.col(k).cast("string"), F.lit("\x02")) for k in keys])
    own_key = F.concat(F.lit("\x03"), F.col(row_id).cast("string"))
    tagged = tagged.withColumn("_j", F.when(F.col("_hot"), own_key).otherwise(cold_key))
    cold = per_key.select(cold_key.alias("_j"), *[F.col(c).alias(f"_v_{c}") for c in extra])
    return tagged.join(cold, "_j", "left").select(
        *rows.columns, *[F.coalesce(F.col(f"_h_{c}"), F.col(f"_v_{c}")).alias(c) for c in extra]
    )


def first_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per key - the first by ``order`` - plus its row count, pre-aggregated map-side."""
    best = F.min(F.struct(*[F.col(o) for o in order], *[F.col(k) for k in keep if k not in order]))
    out = rows.groupBy(*keys).agg(best.alias("_b"), F.count(F.lit(1)).alias("n_rows"))
    names = list(dict.fromkeys([*order, *keep]))
    return out.select(*keys, *[F.col("_b")[n].alias(f"first_{n}") for n in names], "n_rows")


def running_cutoff(rows: DataFrame, group: str, position: str, flag: str, target: int,
                   width: int = 1_000_000) -> DataFrame:
    """Per group, the position of the ``target``-th flagged row (null when there are fewer).

    A running count over a hot group would sort that group in one task.  Instead
    flagged rows are counted per stretch of ``width`` positions (map-side), the
    short list of stretches is accumulated, and only the one stretch that crosses
    the target is ranked row by row.
    """
    from pyspark.sql import Window

    flagged = rows.filter(F.col(flag)).select(group, position, F.floor(F.col(position) / width).alias("_s"))
    stretches = flagged.groupBy(group, "_s").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(group).orderBy("_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    crossing = (
        stretches.withColumn("_run", F.sum("_n").over(upto))
        .filter((F.col("_run") >= target) & (F.col("_run") - F.col("_n") < target))
        .select(group, "_s", (F.lit(target) - (F.col("_run") - F.col("_n"))).alias("_need"))
    )
    ranked = flagged.join(crossing, [group, "_s"]).withColumn(
        "_r", F.row_number().over(Window.partitionBy(group).orderBy(position))
    )
    return ranked.filter(F.col("_r") == F.col("_need")).select(group, F.col(position).alias("cutoff"))


def first_in_order(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows by ``order`` (ties in any order), however many: no task merges them.

    A range-partitioned sort; the row counts of its partitions say how many rows
    each one still gives.
    """
    from pyspark.sql import Window

    from foliant.plans.lineage import materialize

    line = F.monotonically_increasing_id()  # partition in the upper bits, row within it in the lower 33
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.select("*", F.shiftright(line, 33).alias("_part"), line.bitwiseAND(F.lit((1 << 33) - 1)).alias("_line")), "sorted")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(counts, "_part").filter(F.col("_line") + F.col("_before") < n).select(*rows.columns)
