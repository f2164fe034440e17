"""Readers: captured pages, binary documents, sitemaps, evaluation files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant import schemas as S
from foliant.functions import html as H
from foliant.functions import urls
from foliant.functions.text import strip, text_or_empty
from foliant.operators.links import first_occurrences, frontier
from foliant.plans.once import with_columns_once


def page_body(df: DataFrame) -> Column:
    """First non-empty of html, cleaned_html and raw_html (those that exist)."""
    names = [c for c in ("html", "cleaned_html", "raw_html") if c in df.columns]
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in names], F.lit(""))


def scan_pages(df: DataFrame, with_text: bool = True) -> DataFrame:
    """Captured pages as (page_id?, url, success, title, html, text).

    Title and text come from the capture when it has them, else from the HTML.
    Text extraction is evaluated once per page; leave it out with ``with_text=False``.
    """
    body = page_body(df)
    keep = [c for c in ("page_id", "job_id", "position", "captured_at") if c in df.columns]
    title = text_or_empty("title") if "title" in df.columns else H.title(body)
    success = F.coalesce(F.col("success"), F.lit(False)) if "success" in df.columns else body != ""
    markdown = [text_or_empty("markdown").alias("text")] if "markdown" in df.columns and with_text else []
    base = df.select(*keep, text_or_empty("url").alias("url"), success.alias("success"),
                     title.alias("title"), body.alias("html"), *markdown)
    if markdown or not with_text:
        return base
    return with_columns_once(base, {"text": H.text_from_html("html")})


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return scan_pages(spark.read.parquet(path))


def read_binary_documents(spark: SparkSession, path: str, max_bytes: int = 15 * 1024 * 1024) -> DataFrame:
    """PDF files up to ``max_bytes``; size and name are tested on metadata before any content is read."""
    files = spark.read.format("binaryFile").load(path)
    return files.filter((F.col("length") <= max_bytes) & F.lower("path").endswith(".pdf"))


def document_gate(df: DataFrame, url: str = "url", content_type: str = "content_type", size: str = "size",
                  max_bytes: int = 15 * 1024 * 1024) -> DataFrame:
    """Captured documents that are PDFs by type or name and not too large."""
    is_pdf = F.lower(text_or_empty(content_type)).contains("pdf") | F.lower(text_or_empty(url)).endswith(".pdf")
    return df.filter(is_pdf & (F.col(size) <= max_bytes))


_SITEMAP = "url array<struct<loc:string>>, sitemap array<struct<loc:string>>"


def expand_sitemaps(sitemaps: DataFrame, host: str, roots: DataFrame | None = None,
                    limit: int | None = None) -> DataFrame:
    """(url, position) listed by sitemaps, allowed host only, documents skipped; ``limit`` keeps the first ones.

    ``sitemaps`` is the table of fetched texts (sitemap_url, xml); unreadable XML
    lists nothing.  ``roots`` names the start files (default: every file); index
    files lead to their children by a join on the file address, down to any depth.
    """
    parsed = sitemaps.withColumn("_x", F.from_xml("xml", _SITEMAP, {"mode": "PERMISSIVE"}))
    # An index file lists children only, a url set lists pages only.
    is_index = F.col("xml").rlike(r"<(?:\w+:)?sitemapindex[\s>]")
    parsed = parsed.select(
        "sitemap_url",
        F.when(is_index, F.col("_x.sitemap.loc")).alias("children"),
        F.when(~is_index, F.col("_x.url.loc")).alias("pages"),
    )
    if roots is not None:
        edges = parsed.select(F.col("sitemap_url").alias("src"), F.explode("children").alias("dst")).withColumn(
            "dst", strip(F.col("dst")))
        order = frontier(roots.select(F.col("sitemap_url").alias("node")), edges)
        parsed = parsed.join(order.select(F.col("node").alias("sitemap_url"), F.col("depth").alias("level")), "sitemap_url")
    else:
        parsed = parsed.withColumn("level", F.lit(0))
    listed = parsed.select("level", "sitemap_url", F.posexplode("pages").alias("pos", "loc")).select(
        strip(F.col("loc")).alias("url"), "level", "sitemap_url", "pos"
    )
    ok = listed.filter(urls.host_allowed("url", host) & ~urls.is_document_link("url"))
    firsts = first_occurrences(ok, "url", ["level", "sitemap_url", "pos"])
    top = firsts.orderBy("first_level", "first_sitemap_url", "first_pos")
    return (top.limit(limit) if limit else top).select("url", "first_level", "first_sitemap_url", "first_pos")


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """Items of a nested evaluation file with their position."""
    raw = spark.read.schema(f"version string, site string, items array<struct<{_nested(S.EVAL_ITEM)}>>").option(
        "multiLine", True).json(path)
    return raw.select("version", "site", F.posexplode("items").alias("position", "i")).select(
        "version", "site", F.col("position").cast("bigint").alias("position"), "i.*"
    )


def _nested(ddl: str) -> str:
    return ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in S.struct(ddl).fields)


def read_jsonl(spark: SparkSession, path: str, schema: str = S.PROBE_RESULT) -> DataFrame:
    """One JSON record per line; unreadable lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
