"""Links between pages: extraction, first occurrence, breadth-first frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import html as H
from foliant.functions import urls
from foliant.functions.text import distinct_first, strip, text_or_empty
from foliant.plans.lineage import materialize
from foliant.plans.once import explode_once
from foliant.plans.skew import first_in_order


def page_links(pages: DataFrame, internal_only: bool = True) -> DataFrame:
    """(page_id, src_url, position, dst_url): absolute link targets in page order."""
    keys = ["page_id", F.col("url").alias("src_url")]
    found = explode_once(pages, keys, H.hrefs("html"), "href", "position").filter(strip(F.col("href")) != "")
    out = found.withColumn("dst_url", urls.resolve_link("src_url", "href"))
    if internal_only:
        out = out.filter(urls.host_exact("dst_url") == urls.host_exact("src_url"))
    return out.select("page_id", "src_url", F.col("position").cast("bigint").alias("position"), "dst_url")


def document_links(html: Column, base: Column) -> Column:
    """Absolute document links of a page: anchors first, then Markdown links; one per bare URL.

    Links that differ only by query or fragment count once; the first full form stays.
    """
    anchors = F.filter(F.transform(H.hrefs(html), lambda h: strip(h)), lambda h: urls.is_document_link(h))
    markdown = F.transform(
        F.regexp_extract_all(text_or_empty(html), F.lit(H.MARKDOWN_DOC_LINK), 1), lambda h: strip(h)
    )
    full = F.transform(F.concat(anchors, markdown), lambda h: urls.resolve_link(base, h))
    return distinct_first(full, lambda u: F.regexp_replace(u, r"[?#].*$", ""))


def first_occurrences(rows: DataFrame, key: str, position: list[str]) -> DataFrame:
    """Every distinct ``key`` with its earliest position (pre-aggregated before the shuffle)."""
    best = F.min(F.struct(*position)).alias("_p")
    return rows.groupBy(key).agg(best, F.count(F.lit(1)).alias("times")).select(
        key, *[F.col("_p")[p].alias(f"first_{p}") for p in position], "times"
    )


def crawl_budget(max_pages: int) -> int:
    """Links to look at for a wanted number of pages (some will be rejected)."""
    return max(max_pages * 4, max_pages + 500)


def frontier(seeds: DataFrame, links: DataFrame, max_depth: int | None = None, allowed: DataFrame | None = None,
             src: str = "src", dst: str = "dst", node: str = "node", budget: int | None = None) -> DataFrame:
    """Breadth-first walk: (node, depth) for all nodes reached within ``max_depth`` hops (default: all).

    One join per level.  A level is written once; what has been seen is the union
    of the level files, so nothing is rewritten and lost executors only repeat
    one level.  New nodes are reduced map-side before they are compared with the
    seen ones, so a node linked from a third of all pages costs no more than any
    other.  ``budget`` keeps the first nodes by (depth, node), as a page budget does:
    whole levels while they fit, and of the level that crosses it the first nodes.
    """
    level = seeds.select(F.col(node)).distinct()
    if allowed is not None:
        level = level.join(allowed.select(node), node, "left_semi")
    level = materialize(level.withColumn("depth", F.lit(0).cast("bigint")), "level")
    seen, depth, left = level.limit(0), 0, budget
    while True:
        if left is not None:
            size = level.count()
            if size >= left:
                return seen.unionByName(level if size == left else first_in_order(level, [node], left))
            left -= size
        seen = seen.unionByName(level)
        if max_depth is not None and depth >= max(1, max_depth):
            return seen
        depth += 1
        step = links.join(level, links[src] == level[node], "left_semi").select(F.col(dst).alias(node)).distinct()
        if allowed is not None:
            step = step.join(allowed.select(node), node, "left_semi")
        step = step.join(seen.select(node), node, "left_anti")
        level = materialize(step.withColumn("depth", F.lit(depth).cast("bigint")), "level")
        if level.isEmpty():
            return seen
