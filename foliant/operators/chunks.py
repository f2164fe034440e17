"""Documents -> chunk rows (row-local, then one explode)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant import rules as R
from foliant.functions import chunking as C
from foliant.functions.text import clip_at_space, let, strip, text_or_empty
from foliant.plans.once import explode_once


def split_documents(docs: DataFrame, text: str = "text", keys: Sequence[str] = ("doc_id",),
                    size: int = R.CHUNK_SIZE, overlap: int = R.CHUNK_OVERLAP) -> DataFrame:
    """(keys, chunk_id, text) with boundary-aware chunks."""
    cut = C.boundary_chunks(text, size, overlap)
    return explode_once(docs, [k for k in keys if k != text], cut, "text", "chunk_id")


def split_fixed(docs: DataFrame, text: str = "text", keys: Sequence[str] = ("doc_id",),
                size: int = R.FIXED_CHUNK_SIZE, overlap: int = R.FIXED_CHUNK_OVERLAP) -> DataFrame:
    cut = C.fixed_chunks(text, size, overlap)
    return explode_once(docs, [k for k in keys if k != text], cut, "text", "chunk_id")


def with_offsets(docs: DataFrame, chunks: Column, text: str = "text", keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(keys, chunk_id, text, chunk_offset, heading) for an array of chunks per document.

    ``heading`` is the last heading line before the chunk.  Offsets and headings
    are found inside the row; the document text itself is not copied per chunk.
    """
    def parts(cs: Column) -> Column:
        return F.arrays_zip(cs.alias("text"), C.chunk_offsets(text, cs).alias("chunk_offset"),
                            headings_before(cs).alias("heading"))

    zipped = explode_once(docs, list(keys), let(chunks, parts), "c", "chunk_id")
    return zipped.select(*keys, "chunk_id", *[F.col("c").getField(n).alias(n) for n in ("text", "chunk_offset", "heading")])


def headings_before(chunks: Column) -> Column:
    """For every chunk the last heading line of the chunks before it (empty when there is none)."""
    def last_heading(c: Column) -> Column:
        heads = F.regexp_extract_all(c, F.lit(r"(?m)^#{1,6}\s+(.+)$"), 1)
        return F.get(heads, F.size(heads) - 1)

    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(
        F.transform(chunks, last_heading), start,
        lambda acc, h: F.struct(F.coalesce(h, acc["now"]).alias("now"),
                                F.concat(acc["out"], F.array(acc["now"])).alias("out")),
        lambda acc: acc["out"],
    )


def default_context(title: Column, heading: Column) -> Column:
    """Context without a model: the title and the last heading before the chunk."""
    joined = F.concat_ws(" - ", F.nullif(strip(text_or_empty(title)), F.lit("")), F.nullif(strip(heading), F.lit("")))
    return clip_at_space(joined, R.CONTEXT_CLIP)


def document_windows(docs: DataFrame, chunks: Column, text: str = "text", keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(keys, chunk_id, window): the part of the document shown to a context model per chunk."""
    def parts(cs: Column) -> Column:
        return F.zip_with(cs, C.chunk_offsets(text, cs), lambda c, o: C.document_window(text, o, F.length(c)))

    return explode_once(docs, list(keys), let(chunks, parts), "window", "chunk_id")
