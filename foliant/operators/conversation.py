"""Conversation history and session analytics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant import rules as R
from foliant.functions.answers import clip_history, history_line
from foliant.operators.fusion import pack_by_budget


def recent_history(messages: DataFrame, items: int = 8, keys: Sequence[str] = ("session_id", "source_id"),
                   order: str = "created_at", roles: Sequence[str] | None = None, tie: str | None = None) -> DataFrame:
    """Newest ``items`` messages per key with position from the oldest (1) on, and ``ROLE: text``.

    The descending rank filter is applied before the shuffle as well
    (window group limit), so one huge session does not pile up in a task.
    """
    m = messages.filter(F.col("role").isin(list(roles))) if roles else messages
    place = [order, tie] if tie else [order]  # ``tie``: a message id that decides between equal times
    newest = Window.partitionBy(*keys).orderBy(*[F.col(p).desc() for p in place])
    oldest = Window.partitionBy(*keys).orderBy(*place)
    kept = m.withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= max(1, items)).drop("_back")
    return kept.withColumns({
        "position": F.row_number().over(oldest).cast("bigint"),
        "line": history_line("role", "text"),
    })


def transcript(messages: DataFrame, limit: int = 50, keys: Sequence[str] = ("session_id", "source_id"),
               order: str = "created_at", tie: str | None = None) -> DataFrame:
    """Oldest ``limit`` messages per session, in order (``tie``: a message id that decides between equal times)."""
    w = Window.partitionBy(*keys).orderBy(*([order, tie] if tie else [order]))
    return messages.withColumn("position", F.row_number().over(w).cast("bigint")).filter(
        F.col("position") <= max(limit, 1)
    )


def pack_history(messages: DataFrame, keys: Sequence[str] = ("session_id", "source_id"),
                 order: str = "created_at") -> DataFrame:
    """History for a prompt: last 12 lines, each clipped, kept from the oldest while they fit."""
    recent = recent_history(messages, R.HISTORY_ITEMS, keys, order).withColumn("line", clip_history("line"))
    return pack_by_budget(
        recent.filter("line <> ''"), keys, ["position"], F.length("line") + 1, R.HISTORY_TOTAL_CHARS
    )


def history_arrays(history: DataFrame, keys: Sequence[str] = ("session_id", "source_id")) -> DataFrame:
    """(keys, history): bounded arrays of lines, oldest first."""
    ordered = F.sort_array(F.collect_list(F.struct("position", "line")))
    return history.groupBy(*keys).agg(ordered["line"].alias("history"))


def latest_session(messages: DataFrame, order: str = "created_at") -> DataFrame:
    """Session with the newest user message, per source (reduced map-side)."""
    return messages.filter(F.col("role") == "user").groupBy("source_id").agg(
        F.max(F.struct(F.col(order).alias("last_at"), F.col("session_id"))).alias("m")
    ).select("source_id", F.col("m.session_id").alias("session_id"), F.col("m.last_at").alias("last_at"))


def first_turns(messages: DataFrame, greeted: DataFrame | None = None,
                keys: Sequence[str] = ("session_id", "source_id"), order: str = "created_at",
                tie: str | None = None) -> DataFrame:
    """Adds is_first_turn: no earlier message for the key and no greeting recorded.

    ``tie`` names a message id that decides between equal times.

    The first position per key is a map-side minimum; it is joined back on key
    *and* position, so rows of one large session spread over all partitions.
    """
    place = [order, tie] if tie else [order]
    first = messages.groupBy(*keys).agg(F.min(F.struct(*place)).alias("_m")).select(
        *keys, *[F.col("_m")[p].alias(p) for p in place], F.lit(True).alias("_first"))
    if greeted is not None:
        first = first.join(greeted.select("session_id").distinct(), "session_id", "left_anti")
    return messages.join(first, [*keys, *place], "left").withColumn(
        "is_first_turn", F.coalesce("_first", F.lit(False))
    ).drop("_first")


def merge_state(state: str, update: str):
    """JSON session state with the keys of ``update`` overriding (flat string maps)."""
    kind = "map<string,string>"
    empty = F.create_map().cast(kind)
    old = F.coalesce(F.from_json(F.col(state), kind), empty)
    new = F.coalesce(F.from_json(F.col(update), kind), empty)
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.to_json(F.map_concat(kept, new))


def group_items(items: DataFrame, conversation: str = "conversation_id", turn: str = "turn_number",
                item: str = "item_id", position: str = "position") -> DataFrame:
    """Items with the sort key of their conversation group.

    Order the result by (group_pos, turn, position) to play conversations one
    after another, groups by first appearance and items by turn.  Stand-alone
    items form their own group.  Groups are never collected: only their first
    position and size are aggregated, then attached with a hot-key safe join.
    """
    from foliant.plans.skew import attach_by_key

    keyed = items.withColumn(
        "group_key", F.coalesce(F.col(conversation).cast("string"), F.concat(F.lit("_single_"), F.col(item).cast("string")))
    ).withColumn("turn_order", F.coalesce(F.col(turn).cast("bigint"), F.lit(0).cast("bigint")))
    groups = keyed.groupBy("group_key").agg(F.min(position).alias("group_pos"), F.count(F.lit(1)).alias("group_size"))
    return attach_by_key(keyed, groups, ["group_key"], "group_size", item)
