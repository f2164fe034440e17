"""Finding fixed-width windows that occur again, without moving the text of the corpus.

A window of ``width`` symbols (words or bytes) is represented by its anchor: the
``gram`` symbols inside it with the smallest hash (leftmost of equals).  Equal
windows have equal anchors at equal offsets, and neighbouring windows mostly
share one, so a text gives few *stretches*: runs of windows with one anchor.
Stretches whose anchor occurs once hold no repeated window.  Of the others,
equal stretches are recognised by their hash, and only one of each kind goes, with
its symbols, to the comparison of the kinds that share an anchor.

``positions`` are symbol indices in the text.  Rows are keyed by ``id`` (doc_id,
null as the smallest long) and ``tag`` (hash of the text), so rows that share a
doc_id keep their own positions; equal rows are copies of each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import arrays
from foliant.plans.lineage import new_dir

NO_ID = -(1 << 63)
SEGMENT = 1 << 22  # window starts worked on at once
PLACE = np.uint64((1 << 24) - 1)
HOT = 1000  # kinds of stretches of one anchor that are compared in one task; beyond, window by window
STRETCH = "h long, g long, id long, tag long, pos int, n int"


def write_packed(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder (zstd) and read back."""
    path = new_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame) -> DataFrame:
    """``(id, tag, text)``: null ids and texts replaced, extra columns gone."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("tag"),
                       text.alias("text"))


def byte_symbols(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return arrays.BYTES[data], offs


def word_symbols(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e, bounds = arrays.words(data, offs)
    return arrays.word_hashes(data, s, e), bounds


SYMBOLS: dict[str, Callable] = {"bytes": byte_symbols, "words": word_symbols}


def stretches(symbols: np.ndarray, bounds: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, hash, text, start and number of windows of all stretches."""
    out = []
    all_starts = arrays.window_starts(bounds, width)
    for a in range(0, len(symbols), SEGMENT):
        lo, hi = np.searchsorted(all_starts, [a, a + SEGMENT])
        if lo == hi:
            continue
        starts = all_starts[lo:hi] - a
        part = symbols[a: a + SEGMENT + width - 1]
        p, q = arrays.powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * p[:-1], out=sums[1:])
        grams = arrays.mix((sums[gram:] - sums[:-gram]) * q[: len(part) - gram + 1] + np.uint64(gram))
        ranked = grams & ~PLACE | np.arange(len(grams), dtype=np.uint64)
        anchor = (arrays.sliding_min(ranked, width - gram + 1)[starts] & PLACE).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(starts)))
        first = starts[at]
        end = first + n - 1 + width
        g = arrays.mix((sums[end] - sums[first]) * q[first] + (end - first).astype(np.uint64))
        doc = np.searchsorted(bounds, first + a, "right") - 1
        out.append((grams[anchor[at]], g, doc, first + a - bounds[doc], n))
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    return tuple(np.concatenate(c) for c in zip(*out, none, strict=True))


def all_stretches(texts: DataFrame, kind: str, width: int, gram: int) -> DataFrame:
    """``(h, g, id, tag, pos, n)`` of every text."""
    symbols = SYMBOLS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = arrays.flat(batch.column("text"))
            for i, j in arrays.parts(offs):
                sym, bounds = symbols(data[offs[i]: offs[j]], offs[i: j + 1] - offs[i])
                h, g, doc, pos, n = stretches(sym, bounds, width, gram)
                take = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), batch.column("id").take(take),
                     batch.column("tag").take(take), pa.array(pos, pa.int32()), pa.array(n, pa.int32())],
                    ["h", "g", "id", "tag", "pos", "n"])

    return texts.mapInArrow(run, STRETCH)


def repeated_anchors(found: DataFrame) -> DataFrame:
    """The stretches whose anchor occurs at least twice.

    The anchors are written first: a join of two plain shuffles, without an
    aggregate in its stage, lets adaptive execution split a hot anchor.
    """
    again = found.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h")
    again = write_packed(again, "anchors")
    return write_packed(found.join(again, "h", "left_semi"), "candidates")


def kinds_of(candidates: DataFrame) -> DataFrame:
    """One row per distinct stretch: its first place (by id, then position) and its number of rows."""
    first = F.min(F.struct("id", "pos", "tag", "n")).alias("f")
    return write_packed(candidates.groupBy("h", "g").agg(F.count(F.lit(1)).alias("copies"), first), "kinds")


def contested(kinds: DataFrame) -> DataFrame:
    """The first rows of the kinds that share their anchor with another kind: ``STRETCH`` plus ``rivals``."""
    rivals = write_packed(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("rivals")).filter("rivals > 1"), "contested")
    return kinds.join(rivals, "h").select("h", "g", "f.id", "f.tag", "f.pos", "f.n", "rivals")


PIECES = STRETCH + ", piece binary"


def pieces(rows: DataFrame, texts: DataFrame, kind: str, width: int, hot: int = HOT) -> DataFrame:
    """The contested stretches with their symbols; those of a hot anchor as single windows without.

    For a single window ``g`` is the hash of that window and ``n`` is 1, so
    equal windows of a hot anchor meet by key, with partial aggregation.
    """
    symbols = SYMBOLS[kind]
    per_text = rows.groupBy("id", "tag").agg(F.collect_list(F.struct("pos", "n", "h", "g", "rivals")).alias("s"))
    joined = per_text.join(texts, ["id", "tag"]).select("id", "tag", "text", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = arrays.flat(batch.column("text"))
            lists = batch.column("s")
            for i, j in arrays.parts(offs):
                d, o = data[offs[i]: offs[j]], offs[i: j + 1] - offs[i]
                if kind == "words":
                    s, e, bounds = arrays.words(d, o)
                else:
                    bounds = o
                some = lists.slice(i, j - i)
                flat = some.flatten()
                owner = np.repeat(np.arange(j - i), np.diff(some.offsets.to_numpy()))
                get = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "n", "h", "g", "rivals")}
                start = bounds[owner] + get["pos"]
                end = start + get["n"] - 1 + width
                cold = np.flatnonzero(get["rivals"] <= hot)
                if kind == "words":
                    cut = [b" ".join(bytes(d[x:y]) for x, y in zip(s[a:b].tolist(), e[a:b].tolist(), strict=True))
                           for a, b in zip(start[cold].tolist(), end[cold].tolist(), strict=True)]
                else:
                    cut = [d[a:b].tobytes() for a, b in zip(start[cold].tolist(), end[cold].tolist(), strict=True)]
                yield _rows(batch, i + owner[cold], {c: get[c][cold] for c in ("h", "g", "pos", "n")}, cut)
                for k in range(0, len(hots := np.flatnonzero(get["rivals"] > hot)), 2000):
                    some_hot = hots[k: k + 2000]
                    n = get["n"][some_hot]
                    each = np.repeat(some_hot, n)
                    step = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                    sym, _ = symbols(d, o)
                    at = start[each] + step
                    g = arrays.run_hashes(sym, at, at + width).view(np.int64)
                    yield _rows(batch, i + owner[each], {"h": get["h"][each], "g": g, "pos": get["pos"][each] + step,
                                                         "n": np.ones(len(each))}, [None] * len(each))

    return write_packed(joined.mapInArrow(run, PIECES), "pieces")


def _rows(batch: pa.RecordBatch, owner: np.ndarray, c: dict[str, np.ndarray], piece: list) -> pa.RecordBatch:
    take = pa.array(owner)
    return pa.RecordBatch.from_arrays(
        [pa.array(c["h"], pa.int64()), pa.array(c["g"], pa.int64()), batch.column("id").take(take), batch.column("tag").take(take),
         pa.array(c["pos"].astype(np.int32)), pa.array(c["n"].astype(np.int32)), pa.array(piece, pa.binary())],
        ["h", "g", "id", "tag", "pos", "n", "piece"])


def by_anchor(cut: DataFrame, compare: Callable[[pa.Table], pa.RecordBatch], schema: str, limit: int = 6 << 20) -> DataFrame:
    """Runs ``compare`` on tables of whole anchors (at most ``HOT`` kinds each), about ``limit`` bytes of pieces at once."""
    rows = cut.filter("piece IS NOT NULL").repartition("h").sortWithinPartitions("h", "id", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for k in range(0, len(batch), 2000):
                some = batch.slice(k, 2000)
                held.append(some)
                size += sum(map(len, some.column("piece").to_pylist()))
                if size < limit:
                    continue
                table = pa.Table.from_batches(held)
                h = table["h"].to_numpy()
                end = int(np.flatnonzero(h != h[-1])[-1]) + 1 if h[0] != h[-1] else 0
                if end:
                    yield compare(table.slice(0, end).combine_chunks())
                held, size = table.slice(end).combine_chunks().to_batches(), 0
        if held:
            yield compare(pa.Table.from_batches(held).combine_chunks())

    return rows.mapInArrow(run, schema)
