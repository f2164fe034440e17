"""URL filter: link-graph propagation over host edges (DataFrame functions only).

Trust starts at hosts with allowed pages and follows links; distrust starts at
hosts with blocked pages and follows links backwards (a site that links to a
blocked one is suspect).  Both are personalised PageRank with a fixed number of
rounds; mass at hosts without links leaves the system.  A page that no rule
fits is blocked when its host holds more distrust than trust.

Defined cases: a null URL, or one without ``://``, has an empty host and path
and is allowed unless a rule fits; null HTML has no links; repeated pages and
links only add weight; an empty table gives an empty result; other columns are
ignored.  Equal scores (also none at all) mean allow.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.plans.lineage import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]*)"""


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # allow or block

    @property
    def name(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _best_rule(host: Column, path: Column, rules: Sequence[Rule], what) -> Column:
    """The longest fitting rule decides."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(what(r))).otherwise(out)
    return out


def by_rule(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """``pages`` plus host, path, rule and rule_verdict (both null where no rule fits)."""
    parts = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    host, path = F.col("host"), F.col("path")
    return parts.withColumns({
        "rule": _best_rule(host, path, rules, lambda r: r.name),
        "rule_verdict": _best_rule(host, path, rules, lambda r: r.verdict),
    })


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Links between different hosts with their number, summed before the shuffle."""
    found = pages.select(
        url_host(F.col(url)).alias("src"),
        F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))).alias("_to"),
    ).select("src", F.translate("_to", UPPER, LOWER).alias("dst"))
    found = found.filter((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
    return found.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 10,
              cut_every: int = 5) -> DataFrame:
    """Scores ``(kind, host, score)``: trust along the edges, distrust against them.

    ``seeds`` has kind (trust or distrust), host and weight; weights are scaled
    to sum to one per kind.
    """
    forward = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("_next"), "n")
    back = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("_next"), "n")
    steps = forward.unionByName(back)
    out = steps.groupBy("kind", "host").agg(F.sum("n").alias("_all"))
    steps = cut_lineage(
        steps.join(out, ["kind", "host"]).select("kind", "host", "_next", (F.col("n") / F.col("_all")).alias("_share"))
    )
    total = seeds.groupBy("kind").agg(F.sum("weight").alias("_sum"))
    start = cut_lineage(
        seeds.join(F.broadcast(total), "kind")  # two rows: one per kind
        .select("kind", "host", (F.col("weight") / F.col("_sum")).alias("score"))
    )
    base = start.withColumn("score", F.col("score") * (1 - damping))
    scores = start
    for i in range(1, rounds + 1):
        moved = scores.join(steps, ["kind", "host"]).select(
            "kind", F.col("_next").alias("host"), (F.col("score") * F.col("_share") * damping).alias("score"))
        scores = base.unionByName(moved).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if i % cut_every == 0 and i < rounds:
            scores = cut_lineage(scores)
    return scores


def judge_urls(pages: DataFrame, rules: Sequence[Rule], page_id: str = "page_id", url: str = "url",
               html: str = "html", damping: float = 0.85, rounds: int = 10, ratio: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; see the module for the method."""
    judged = by_rule(pages.select(page_id, url), rules, url)
    marked = judged.filter((F.col("host") != "") & F.col("rule").isNotNull())
    kind = F.when(F.col("rule_verdict") == "allow", "trust").otherwise("distrust")
    seeds = marked.groupBy(kind.alias("kind"), "host").agg(F.count(F.lit(1)).alias("weight"))
    scores = propagate(host_edges(pages.select(url, html), url, html), seeds, damping, rounds)
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0))
    bad = scores.groupBy("host").agg((of("distrust") > of("trust") * ratio).alias("_bad")).filter("_bad")
    out = judged.join(bad, "host", "left")
    spread = F.when(F.col("_bad"), "block").otherwise("allow")
    return out.select(page_id, "host", "path", "rule", F.coalesce("rule_verdict", spread).alias("verdict"))
