"""Chunk columns: fixed stride, boundary-aware, offsets, document windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant import rules
from foliant.functions.text import col, let, strip, text_or_empty


def fixed_chunks(text: Column | str, size: int = rules.FIXED_CHUNK_SIZE,
                 overlap: int = rules.FIXED_CHUNK_OVERLAP) -> Column:
    """Array of windows of ``size`` characters every ``size - overlap`` characters.

    The text is cut once into stride-long pieces and every window is a piece plus
    the head of the next one, so the cost is linear in the text (repeated
    ``substring`` calls would walk the text from its start each time).  The walk
    ends with the window that reaches the end of the text.
    """
    stride = size - overlap
    if not 0 <= overlap <= stride:
        raise ValueError("overlap must be between 0 and half of size")
    # Repetition counts above 1000 are split, which keeps the pattern portable.
    full, rest = divmod(stride, 1000)
    unit = "(?:.{1000}){%d}" % full if full else ""
    pattern = f"(?s){unit}.{{{rest}}}|.+" if rest else f"(?s){unit}|.+"
    pieces = F.regexp_extract_all(text_or_empty(text), F.lit(pattern), 0)

    def windows(ps: Column) -> Column:
        whole = F.transform(
            ps, lambda p, i: F.concat(p, F.substring(F.coalesce(F.get(ps, i + 1), F.lit("")), 1, overlap))
        )
        tail = F.element_at(ps, -1)
        drop_tail = (F.size(ps) > 1) & (F.length(tail) <= overlap)
        return F.when(F.size(ps) == 0, whole).otherwise(
            F.slice(whole, F.lit(1), F.size(ps) - drop_tail.cast("int"))
        )

    return let(pieces, windows)


def boundary_pattern(budget: int) -> str:
    """Longest run of at most ``budget`` characters ending at the best boundary."""
    return (
        rf"(?s).{{0,{budget - 2}}}\n\n"
        rf"|.{{0,{budget - 1}}}\n"
        rf"|.{{0,{budget - 2}}}\. "
        rf"|.{{0,{budget - 1}}} "
        rf"|.{{1,{budget}}}"
    )


def boundary_chunks(text: Column | str, size: int = rules.CHUNK_SIZE,
                    overlap: int = rules.CHUNK_OVERLAP) -> Column:
    """Array of stripped chunks of at most ``size`` characters.

    Contract: text that fits is one chunk.  Otherwise the text is cut, left to
    right, into runs of at most ``size - overlap`` characters; each run ends at
    the last paragraph break in reach, else the last line break, else the last
    sentence end, else the last space, else hard.  Every later chunk starts with
    the whole words among the last ``overlap`` characters of the run before it.
    Blank chunks are dropped.  One linear regex scan; nothing leaves the row.
    """
    budget = size - overlap
    t = text_or_empty(text)
    runs = F.regexp_extract_all(t, F.lit(boundary_pattern(budget)), 0)

    def with_carry(rs: Column) -> Column:
        def one(r: Column, i: Column) -> Column:
            before = F.coalesce(F.get(rs, F.when(i > 0, i - 1).otherwise(F.lit(-1))), F.lit(""))
            tail = F.right(before, F.lit(overlap))
            words = F.when(F.length(before) <= overlap, tail).otherwise(
                F.regexp_extract(tail, r"(?s)^\S*\s(.*)$", 1)
            )
            return strip(F.concat(words, r))

        return F.transform(rs, one)

    cut = F.filter(let(runs, with_carry), lambda c: c != "")
    whole = F.filter(F.array(strip(t)), lambda c: c != "")
    return F.when(F.length(t) <= size, whole).otherwise(cut)


def chunk_offsets(document: Column | str, chunks: Column) -> Column:
    """0-based start of every chunk, searched from the end of the chunk before it.

    A chunk that is not found from there (an overlapping one usually is not) gets
    that search position itself.
    """
    doc = text_or_empty(document)

    def step(acc: Column, c: Column) -> Column:
        found = F.call_function("locate", c, doc, acc["cursor"] + 1)
        start = F.when((c != "") & (found > 0), found - 1).otherwise(acc["cursor"])
        return F.struct(
            (start + F.length(c)).alias("cursor"),
            F.concat(acc["starts"], F.array(start)).alias("starts"),
        )

    init = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(chunks, init, step, lambda acc: acc["starts"])


def document_window(document: Column | str, offset: Column | str, length: Column | str) -> Column:
    """Whole text when short; else its head plus the neighbourhood of the chunk."""
    d, off, ln = text_or_empty(document), col(offset), col(length)
    total = F.length(d)
    start = F.greatest(F.lit(0), off - rules.WINDOW_HALF)
    end = F.least(total, off + ln + rules.WINDOW_HALF)
    near = F.substr(d, start + 1, end - start)
    near = F.concat(F.when(start > 0, F.lit("[…]\n")).otherwise(F.lit("")), near)
    near = F.concat(near, F.when(end < total, F.lit("\n[…]")).otherwise(F.lit("")))
    return F.when(total <= rules.WINDOW_DOC_BUDGET, d).otherwise(
        F.concat(F.substring(d, 1, rules.WINDOW_HEAD), F.lit("\n[…]\n"), near)
    )


def situated_text(context: Column | str, chunk: Column | str) -> Column:
    c = text_or_empty(context)
    return F.when(c == "", col(chunk)).otherwise(F.concat(c, F.lit("\n\n"), col(chunk)))
