"""Substring dedup by relative Lempel-Ziv parsing.

Every document is factored against all text before it (smaller doc_id, or the
same document further left).  The reference is indexed in blocks, one per anchor
(see ``repeats``): each block holds the distinct stretches of words that share
it, in order of their first place, and gives for each window of ``min_words``
words the first place it occurs.  A factor grows greedily while the next window
continues at the next reference position; where it ends, the window across the
boundary is looked up by itself and may open an overlapping factor.  Factors have
at least ``min_words`` words; what they cover is removed.

Defined cases: a null text has no words; texts below ``min_words`` words are
kept whole; of equal windows the first place stays (ties in doc_id and start, that
is repeated rows, all stay); a null doc_id counts as the smallest; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import arrays, repeats

MIN_WORDS = 20
GRAM = 5
MATCH = "id long, tag long, pos int, n int, ref_id long, ref_pos int"


def _in_block(table: pa.Table, width: int) -> pa.RecordBatch:
    """Match runs of the stretches of several blocks (rows ordered by anchor, id, position)."""
    data, offs = arrays.flat(table["piece"])
    s, e, b = arrays.words(data, offs)
    h = arrays.word_hashes(data, s, e)
    at = arrays.window_starts(b, width)
    row = np.searchsorted(b, at, "right") - 1
    block = table["h"].to_numpy().view(np.uint64)[row]
    key = arrays.mix(arrays.run_hashes(h, at, at + width) + block * np.uint64(arrays.BASE))
    order = np.argsort(key, kind="stable")  # rows come in order of their place, so the first of a run is the reference
    first = np.ones(len(key), bool)
    first[1:] = key[order][1:] != key[order][:-1]
    ref = np.empty(len(key), np.int64)
    ref[order] = order[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(key) else order
    ids, place = table["id"].to_numpy(), table["pos"].to_numpy()[row] + at - b[row]
    hit = np.flatnonzero((ids[row] != ids[row[ref]]) | (place != place[ref]))
    ref = ref[hit]
    new = np.ones(len(hit), bool)
    new[1:] = (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]]) | (ref[1:] != ref[:-1] + 1) | (row[ref[1:]] != row[ref[:-1]])
    begin = np.flatnonzero(new)
    take = pa.array(row[hit[begin]])
    return pa.RecordBatch.from_arrays(
        [table["id"].combine_chunks().take(take), table["tag"].combine_chunks().take(take), pa.array(place[hit[begin]], pa.int32()),
         pa.array(np.diff(np.append(begin, len(hit))), pa.int32()), pa.array(ids[row[ref[begin]]]), pa.array(place[ref[begin]], pa.int32())],
        ["id", "tag", "pos", "n", "ref_id", "ref_pos"])


def matches(texts: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, hot: int = repeats.HOT) -> DataFrame:
    """Runs of ``n`` windows from ``pos`` that begin earlier too, at (ref_id, ref_pos) and after: ``MATCH``."""
    candidates = repeats.repeated_anchors(repeats.all_stretches(texts, "words", min_words, gram))
    kinds = repeats.kinds_of(candidates)
    later = (F.col("id") != F.col("f.id")) | (F.col("pos") != F.col("f.pos"))
    copies = candidates.join(kinds.filter("copies > 1"), ["h", "g"]).filter(later).select(
        "id", "tag", "pos", "n", F.col("f.id").alias("ref_id"), F.col("f.pos").alias("ref_pos"))
    cut = repeats.pieces(repeats.contested(kinds), texts, "words", min_words, hot)
    blocks = repeats.by_anchor(cut, lambda t: _in_block(t, min_words), MATCH)
    single = cut.filter("piece IS NULL").drop("piece")
    first = single.groupBy("h", "g").agg(F.min(F.struct("id", "pos")).alias("f"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    hot = single.join(first, ["h", "g"]).filter(later).select(
        "id", "tag", "pos", "n", F.col("f.id").alias("ref_id"), F.col("f.pos").alias("ref_pos"))
    return copies.unionByName(blocks).unionByName(hot)


def parse(runs: list[dict], width: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, words, ref_id, ref_pos) of one document from its match runs."""
    out: list[tuple[int, int, int, int]] = []
    for r in sorted(runs, key=lambda r: (r["pos"], -r["n"], r["ref_id"], r["ref_pos"])):
        start, words = r["pos"], r["n"] - 1 + width
        if out:
            a, n, ref, at = out[-1]
            if start <= a + n - width + 1 and ref == r["ref_id"] and r["ref_pos"] - at == start - a:
                out[-1] = (a, max(n, start + words - a), ref, at)  # the same alignment goes on
                continue
            if start + words <= a + n:
                continue  # nothing beyond the boundary of the factor before
        out.append((start, words, r["ref_id"], r["ref_pos"]))
    return out


RESULT = ("doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors long, "
          "factors array<struct<start:int,words:int,ref_id:long,ref_pos:int>>, kept string")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, with_text: bool = True,
          hot: int = repeats.HOT) -> DataFrame:
    """Per document: counts, the factors, and (unless ``with_text`` is off) the kept words joined by spaces."""
    texts = repeats.keyed(docs)
    found = matches(texts, min_words, gram, hot).groupBy("id", "tag").agg(
        F.collect_set(F.struct("pos", "n", "ref_id", "ref_pos")).alias("runs"))
    rows = texts.join(found, ["id", "tag"], "left").select("id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                out = [_document(*r, min_words, with_text) for r in zip(
                    *(batch.column(c).slice(i, 500).to_pylist() for c in ("id", "text", "runs")), strict=True)]
                yield pa.RecordBatch.from_pylist(out, SCHEMA)

    return rows.mapInArrow(run, RESULT)


FACTOR = pa.struct([("start", pa.int32()), ("words", pa.int32()), ("ref_id", pa.int64()), ("ref_pos", pa.int32())])
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
                    ("n_factors", pa.int64()), ("factors", pa.list_(FACTOR)), ("kept", pa.string())])


def _document(doc: int, text: str, runs: list[dict] | None, width: int, with_text: bool) -> dict:
    words = text.encode().split()  # bytes.split takes exactly the six ASCII spaces
    factors = parse(runs or [], width)
    kept = words
    if factors:
        s = np.array([(a, a + n) for a, n, _, _ in factors])
        kept = list(compress(words, (~arrays.covered(s[:, 0], s[:, 1], len(words))).tolist()))
    joined = b" ".join(kept)
    return {"doc_id": None if doc == repeats.NO_ID else doc, "n_words": len(words), "n_removed": len(words) - len(kept),
            "kept_sha256": hashlib.sha256(joined).hexdigest(), "n_factors": len(factors),
            "factors": [dict(zip(("start", "words", "ref_id", "ref_pos"), f, strict=True)) for f in factors],
            "kept": joined.decode() if with_text else None}
