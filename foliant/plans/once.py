"""Evaluate expensive columns exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_columns_once(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Like ``withColumns``, but later filters and projections never repeat the expressions.

    The optimizer copies a projected expression into every predicate that uses
    it; for text extraction that means running it several times per row.  A
    generator of exactly one row is not copied, so the columns become plain
    attributes for everything downstream.
    """
    kept = [c for c in df.columns if c not in cols]
    return df.select(*kept, F.inline(F.array(F.struct(*[v.alias(k) for k, v in cols.items()]))))


def explode_once(df: DataFrame, keys: list, items: Column, value: str, position: str | None = None) -> DataFrame:
    """Explode an expensive array expression without evaluating it a second time.

    A plain explode makes the optimizer add a "not empty" filter that repeats the
    array expression below it.  The outer form has no such filter; the rows of
    empty arrays are removed by their missing position instead.
    """
    pos = position or "_pos"
    out = df.select(*keys, F.posexplode_outer(items).alias(pos, value)).filter(F.col(pos).isNotNull())
    return out if position else out.drop(pos)
