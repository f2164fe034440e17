"""Text cleaning of captured pages and of document lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant import rules as R
from foliant.functions import html as H
from foliant.functions.text import (
    contains_any, let, limit_repeats, lines, strip, text_or_empty,
)

IMAGE_ONLY = r"^\[!\[[^\]]*\]\([^)]+\)\]\([^)]+\)$|^!\[[^\]]*\]\([^)]+\)$"
PART = 2 << 20  # bytes of pages whose results are held at once
PAGE_NUMBER = r"^\d{1,3}$"
RULER = r"^[.\-_=]{3,}$"
PAGE_OF = r"^(?:[Pp]ágina\s+\d+\s+de\s+\d+|[Pp]age\s+\d+\s+of\s+\d+)$"


def clean_lines(
    text: Column | str, max_repeats: int = 2, labels: tuple = R.STRUCTURAL_LABELS, press_mark: str = R.PRESS_MARK
) -> Column:
    """Drop blank and image-only lines, keep each line at most ``max_repeats`` times.

    Structural labels are never limited; press lines may occur once.  The whole
    rule runs inside the row (sort of the line array), so a corpus is cleaned in
    one pass over its partitions without shuffling any text.
    """
    kept = F.filter(
        F.transform(lines(text_or_empty(text)), lambda x: strip(x)),
        lambda x: (x != "") & ~x.rlike(IMAGE_ONLY),
    )

    def allowed(k: Column) -> Column:
        free = F.when(~k.isin(list(labels)), F.lit(max_repeats)) if labels else F.lit(max_repeats)
        return F.when(k.contains(press_mark), F.lit(1)).otherwise(free) if press_mark else free

    return strip(F.array_join(limit_repeats(kept, F.lower, allowed), "\n"))


def clean_document_lines(text: Column | str) -> Column:
    """Drop page numbers, rulers and "page x of y" lines; one blank line between paragraphs."""
    kept = F.filter(
        F.transform(lines(text_or_empty(text)), lambda x: strip(x)),
        lambda x: ~(x.rlike(PAGE_NUMBER) | x.rlike(RULER) | x.rlike(PAGE_OF)),
    )
    single = let(kept, lambda xs: F.filter(xs, lambda x, i: (x != "") | (i == 0) | (F.get(xs, i - 1) != "")))
    return strip(F.array_join(single, "\n"))


def document_gate(text: Column, pages: Column, min_chars: int = 50, max_pages: int = 120) -> Column:
    """Error name of a converted document, null when usable."""
    return F.when(pages > max_pages, F.lit("too_many_pages")).when(
        F.length(text) < min_chars, F.lit("insufficient_text")
    )


LINE = ("doc_id", "page", "block", "line")


def _runs_of_spans(spans: DataFrame) -> DataFrame:
    """Neighbouring rows of one line, size and weight with successive spans as one row: first span, number, texts joined by NUL.

    A text that holds a NUL is a row by itself.
    """
    same = [*LINE, "size", "bold"]
    schema = spans.select(*same, "span", F.lit(1).alias("n"), "text").schema

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            span, text = b.column("span"), b.column("text")
            known, at = span.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(span, 0).to_numpy()
            new = pc.match_substring(text, "\0").to_numpy(zero_copy_only=False).copy()
            new[1:] |= new[:-1] | ~known[1:] | ~known[:-1] | (at[1:] != at[:-1] + 1)
            new[:1] = True
            for c in same:
                codes = b.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            first = np.flatnonzero(new)
            cut = np.append(first, len(b))
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), text), "\0")
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(pa.array(first)) for c in (*same, "span")), pa.array(np.diff(cut), pa.int32()), texts], schema.names)

    return spans.mapInArrow(join, schema)


def spans_to_lines(spans: DataFrame, heading_size: float = 14.0) -> DataFrame:
    """Span table -> one Markdown line per (doc_id, page, block, line).

    Lines are small groups (a handful of spans), so collecting their spans is safe.
    """
    text = strip(text_or_empty("text"))
    body = spans.filter(F.col("block_type") == 0).select(
        *LINE, "size", F.col("flags").bitwiseAND(16).alias("bold"), "span", text.alias("text")).filter("text <> ''")
    grouped = _runs_of_spans(body).groupBy(*LINE).agg(
        F.collect_list(F.struct("span", "n", "text")).alias("runs"), F.max("size").alias("size"), F.max("bold").alias("bold"))

    def spread(r: Column) -> Column:
        texts = F.when(r["n"] == 1, F.array(r["text"])).otherwise(F.split(r["text"], r"\x00", -1))
        return F.transform(texts, lambda t, i: F.struct((r["span"] + i).alias("span"), t.alias("text")))

    parts = F.sort_array(F.flatten(F.transform("runs", spread)))
    line = F.array_join(parts["text"], " ")
    styled = (
        F.when(F.col("size") >= heading_size + 4, F.concat(F.lit("## "), line))
        .when(F.col("size") >= heading_size, F.concat(F.lit("### "), line))
        .when((F.col("bold") > 0) & (F.length(line) < 120) & ~line.endswith("."),
              F.concat(F.lit("**"), line, F.lit("**")))
        .otherwise(line)
    )
    return grouped.select("doc_id", "page", "block", "line", styled.alias("text"))


def lines_to_documents(lines_df: DataFrame) -> DataFrame:
    """Lines -> pages -> one cleaned Markdown text per document, pages apart by a blank line."""
    pages = lines_df.groupBy("doc_id", "page").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("block", "line", "text")))["text"], "\n").alias("text")
    )
    docs = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.array_join(F.sort_array(F.collect_list(F.struct("page", "text")))["text"], "\n\n").alias("text"),
    )
    return docs.withColumn("text", clean_document_lines("text"))


def html_to_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds title and text from the element tree (one small parse per page, about ``PART`` bytes of pages held at once)."""
    schema = pages.select(*[c for c in pages.columns if c not in ("title", "text")]).schema
    carried = [f.name for f in schema.fields]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.fill_null(pc.binary_length(b.column(html)), 0).to_numpy()
            group = (np.cumsum(size, dtype=np.int64) - 1) // PART
            cuts = np.flatnonzero(np.diff(group)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(b)], strict=True):
                part = b.slice(i, j - i)
                parsed = [H.parse_page(v.as_py()) for v in part.column(html)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *(pa.array([p[k] for p in parsed], pa.string()) for k in (0, 1))], [*part.schema.names, "title", "text"])

    out = schema.add("title", "string").add("text", "string")
    return pages.select(*carried).mapInArrow(parse, out)


def pruned_text(url: Column | str, html: Column | str, relaxed: tuple = R.RELAXED_URL_TOKENS) -> Column:
    """Keep blocks with enough words and little link text; career pages are pruned less.

    Own rule (documented here): a block stays when it has at least ``min_words``
    words and a score ``1 - link characters / characters`` of at least the
    threshold: 0.25 with 8 words normally, 0.08 with 1 word on relaxed URLs.
    """
    easy = contains_any(F.lower(text_or_empty(url)), relaxed)
    min_words = F.when(easy, F.lit(1)).otherwise(F.lit(8))
    threshold = F.when(easy, F.lit(0.08)).otherwise(F.lit(0.25))
    return F.array_join(
        F.transform(
            F.filter(
                H.blocks_from_html(html),
                lambda b: (F.size(F.split(b["text"], " ")) >= min_words)
                & ((F.lit(1.0) - b["link_chars"] / F.length(b["text"])) >= threshold),
            ),
            lambda b: b["text"],
        ),
        "\n",
    )


def content_hash(text: Column | str) -> Column:
    return F.sha2(text_or_empty(text).cast("binary"), 256)
