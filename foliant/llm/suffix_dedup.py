"""Byte-exact dedup of long repeats by a column-wise multi-document suffix order.

Stretches of bytes that share an anchor (see ``repeats``) are aligned at it, so
equal windows begin in the same column.  The collection is built column by
column from the right: each round inserts one symbol of every document, re-sorts
the documents of each anchor stably by it - their Burrows-Wheeler order for that
column - and updates the common-prefix lengths of neighbours from those of the
column before.  A window is repeated where the common prefix with a neighbour
reaches ``min_bytes``.  A task works through blocks of whole anchors; anchors with
very many different stretches (see ``repeats.HOT``) are counted window by window
with Spark aggregates instead.

Defined cases: a null text is empty; texts below ``min_bytes`` bytes are kept
whole; repeats count within one document and across all, equal rows included; a
null doc_id is an id like others; an empty table gives an empty result; other
columns are ignored.  Kept bytes are joined as they are, so a cut inside a
character leaves its bytes (``kept`` is binary).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import arrays, repeats

MIN_BYTES = 400
GRAM = 120
SPAN = "id long, tag long, pos int, n int"


def _common(old: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of ``old[lo + 1 : hi + 1]`` for each pair: the common prefix of documents lo and hi places apart."""
    levels, have = [old], 1
    widest = int((hi - lo).max(initial=1))
    while have * 2 <= widest:
        levels.append(np.minimum(levels[-1][:-have], levels[-1][have:]))
        have *= 2
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    out = np.empty(len(lo), old.dtype)
    for k in np.unique(level):
        m = level == k
        out[m] = np.minimum(levels[k][lo[m] + 1], levels[k][hi[m] + 1 - (1 << k)])
    return out


def repeated_windows(group: np.ndarray, rows: list[bytes], left: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, window) pairs that are repeated among the documents of their group.

    ``left``: column of each document's first byte; window i begins at column
    left + i, for i < n.
    """
    m = len(rows)
    size = np.array([len(r) for r in rows])
    low, high = int(left.min()), int((left + size).max())
    columns = np.zeros((high - low, m), np.int16)  # 0: no symbol here
    for k, r in enumerate(rows):
        columns[left[k] - low: left[k] - low + len(r), k] = np.frombuffer(r, np.uint8).astype(np.int16) + 1
    _, g = np.unique(group, return_inverse=True)
    order = np.argsort(g, kind="stable")
    common = np.zeros(m, np.int32)  # with the document one place before
    docs, windows = [], []
    for c in range(high - low - 1, -1, -1):
        symbol = columns[c][order]
        key = g[order] * 512 + symbol
        place = np.argsort(key, kind="stable")
        order, key = order[place], key[place]
        symbol = symbol[place]
        same = np.flatnonzero((key[1:] == key[:-1]) & (symbol[1:] > 0)) + 1
        new = np.zeros(m, np.int32)
        if len(same):
            new[same] = _common(common, place[same - 1], place[same]) + 1
        common = new
        hit = common >= width
        hit[:-1] |= hit[1:]
        at = order[np.flatnonzero(hit)]
        w = c + low - left[at]
        ok = (w >= 0) & (w < n[at])
        docs.append(at[ok])
        windows.append(w[ok])
    return np.concatenate(docs), np.concatenate(windows)


def _in_block(table: pa.Table, width: int, gram: int) -> pa.RecordBatch:
    rows, h = table["piece"].to_pylist(), table["h"].to_numpy()
    n = table["n"].to_numpy().astype(np.int64)
    # The anchor is the leftmost gram with its hash among those that all windows of the piece hold.
    left = np.empty(len(rows), np.int64)
    data, offs = arrays.flat(table["piece"])
    for i, j in arrays.parts(offs):
        sym, b = repeats.byte_symbols(data[offs[i]: offs[j]], offs[i: j + 1] - offs[i])
        at = arrays.window_starts(b, gram)
        grams = arrays.run_hashes(sym, at, at + gram)
        doc = np.searchsorted(b, at, "right") - 1
        off = at - b[doc]
        shared = (off >= n[i + doc] - 1) & (off <= width - gram) & (grams == h[i + doc].view(np.uint64))
        first = np.full(j - i, np.iinfo(np.int64).max)
        np.minimum.at(first, doc[shared], off[shared])
        left[i:j] = -first
    doc, window = repeated_windows(h, rows, left, n, width)
    order = np.lexsort((window, doc))
    doc, window = doc[order], window[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (window[1:] != window[:-1] + 1)
    begin = np.flatnonzero(new)
    take = pa.array(doc[begin])
    pos = table["pos"].to_numpy()[doc[begin]] + window[begin]
    return pa.RecordBatch.from_arrays(
        [table["id"].combine_chunks().take(take), table["tag"].combine_chunks().take(take), pa.array(pos, pa.int32()),
         pa.array(np.diff(np.append(begin, len(doc))), pa.int32())], ["id", "tag", "pos", "n"])


def spans(texts: DataFrame, min_bytes: int = MIN_BYTES, gram: int = GRAM, hot: int = repeats.HOT) -> DataFrame:
    """Runs of ``n`` windows from byte ``pos`` that start elsewhere too: ``SPAN``."""
    found = repeats.write_packed(repeats.all_stretches(texts, "bytes", min_bytes, gram), "stretches")
    candidates = repeats.repeated_anchors(found)
    kinds = repeats.kinds_of(candidates)
    copies = candidates.join(kinds.filter("copies > 1").select("h", "g"), ["h", "g"]).select("id", "tag", "pos", "n")
    cut = repeats.pieces(repeats.contested(kinds), texts, "bytes", min_bytes, hot)
    blocks = repeats.by_anchor(cut, lambda t: _in_block(t, min_bytes, gram), SPAN)
    single = cut.filter("piece IS NULL").drop("piece")
    again = single.groupBy("h", "g").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h", "g")
    hot = single.join(again, ["h", "g"]).select("id", "tag", "pos", "n")
    return copies.unionByName(blocks).unionByName(hot)


RESULT = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
          "removed array<struct<start:int,bytes:int>>, kept binary")


def dedup(docs: DataFrame, min_bytes: int = MIN_BYTES, gram: int = GRAM, with_text: bool = True,
          hot: int = repeats.HOT) -> DataFrame:
    """Per document: counts, the removed runs, and (unless ``with_text`` is off) the kept bytes."""
    texts = repeats.keyed(docs)
    found = spans(texts, min_bytes, gram, hot).groupBy("id", "tag").agg(F.collect_set(F.struct("pos", "n")).alias("runs"))
    rows = texts.join(found, ["id", "tag"], "left").select("id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                out = [_document(*r, min_bytes, with_text) for r in zip(
                    *(batch.column(c).slice(i, 500).to_pylist() for c in ("id", "text", "runs")), strict=True)]
                yield pa.RecordBatch.from_pylist(out, SCHEMA)

    return rows.mapInArrow(run, RESULT)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                    ("kept_sha256", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("bytes", pa.int32())]))),
                    ("kept", pa.binary())])


def _document(doc: int, text: str, runs: list[dict] | None, width: int, with_text: bool) -> dict:
    data = text.encode()
    gone: list[list[int]] = []
    for a, b in sorted((r["pos"], r["pos"] + r["n"] - 1 + width) for r in runs or []):
        if gone and a <= gone[-1][1]:
            gone[-1][1] = max(gone[-1][1], b)
        else:
            gone.append([a, b])
    edges = [0, *(x for g in gone for x in g), len(data)]
    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
    return {"doc_id": None if doc == repeats.NO_ID else doc, "n_bytes": len(data), "n_removed": len(data) - len(kept),
            "n_spans": len(gone), "kept_sha256": hashlib.sha256(kept).hexdigest(),
            "removed": [{"start": a, "bytes": b - a} for a, b in gone], "kept": kept if with_text else None}
