"""Benchmark decontamination: spaced-seed hashing with substitution-tolerant checks.

Tokens are lower-cased runs of ASCII letters and digits or non-ASCII bytes.  Each
mask looks at some positions of a short span and ignores the others, so a hit
survives substituted tokens.  Benchmark items are hashed with the same masks; a
Bloom filter of fixed size (``FILTER_BITS``, whatever the benchmark's size) lets
each task drop positions that cannot match, and a join on the hash decides.  Each
hit fixes an alignment of document and item; around it, the best ungapped overlap
(+1 per equal token, -2 per substituted one) has to hold ``min_tokens`` equal
tokens, or the same share of a shorter item.

The masks are chosen so that no overlap that would pass the check goes unseeded
(for ``min_tokens`` of 12 or more): an overlap with at least 12 equal tokens, or
80 % of an item of 10 or more, agrees with one of the five masks somewhere.  Items
of fewer tokens have masks of their own (``short_masks``).

Defined cases: null or token-free texts match nothing; null item ids are kept as
such; equal documents and equal items each give their rows; items may overlap in
one document; an empty table gives an empty result; other columns are ignored.
Null ids work (rows are told apart by their place, not by id).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import arrays
from foliant.plans.lineage import materialize

#: Fixed masks: 1 is compared, 0 ignored.  A greedy cover of all 846 ways in which an overlap can begin that passes
#: the check of an item of ``SHORT`` or more tokens; a test goes through them.
MASKS = ("111010011", "1110110001", "11110101", "101111001", "11101011")
SHORT = 10
FILTER_BITS = 1 << 24
PROBES = 3
CONTEXT = 32  # tokens kept on each side of a hit
MIN_TOKENS = 12
MIN_SHARE = 0.8  # of an item with fewer tokens than min_tokens

INSIDE = np.zeros(256, bool)
INSIDE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts and the index of each text's first token."""
    data, offs = arrays.flat(pc.utf8_lower(column))
    found, counts = [np.zeros(0, np.uint64)], []
    for i, j in arrays.parts(offs):
        d = data[offs[i]: offs[j]]
        s, e, b = arrays.tokens(INSIDE[d], offs[i: j + 1] - offs[i])
        found.append(arrays.word_hashes(d, s, e))
        counts.append(np.diff(b))
    return np.concatenate(found), np.concatenate([[0], np.cumsum(np.concatenate(counts or [[]]))]).astype(np.int64)


def seeds(h: np.ndarray, bounds: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the mask fits into its text, and the hash of the tokens it looks at."""
    at = arrays.window_starts(bounds, len(mask))
    n = max(0, len(h) - len(mask) + 1)
    total = np.full(n, len(mask), np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            total = total * np.uint64(arrays.BASE) + h[k: n + k]
    return at, arrays.mix(total[at])


def short_masks(n: int) -> list[str]:
    """Masks for items of ``n`` tokens (fewer than ``SHORT``): every beginning of an overlap that passes the check.

    Such a beginning holds just as many equal tokens as the check wants, and its
    score (see ``best_overlap``) stays above 0.
    """
    need = math.ceil(n * MIN_SHARE)
    found, done = [("1", 1)], []
    while found:
        mask, score = found.pop()
        ones = mask.count("1")
        if ones == need:
            done.append(mask)
            continue
        found.append((mask + "1", score + 1))
        if len(mask) - ones < n - need and score > 2:
            found.append((mask + "0", score - 2))
    return sorted(done)


def _probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((h >> np.uint64(20 * k)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(bits) for k in range(PROBES)]


def item_tokens(benchmark: DataFrame) -> DataFrame:
    """``(item, item_id, tokens)`` of the items that have tokens."""
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            h, b = token_hashes(batch.column("text"))
            rows = [h[x:y].view(np.int64) for x, y in zip(b[:-1], b[1:], strict=True)]
            ids = (part << 33) + done + np.arange(len(rows))
            done += len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), batch.column("item_id"), pa.array(rows, pa.list_(pa.int64()))], ["item", "item_id", "tokens"])

    items = benchmark.select("item_id", "text").mapInArrow(arrays.giving_back(run), f"item long, item_id {kind}, tokens array<long>")
    return materialize(items.filter(F.size("tokens") > 0), "items")


def item_seeds(items: DataFrame) -> DataFrame:
    """``(hash, item, item_pos, short)``: every mask at every position; ``short``: the item's length if below ``SHORT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item = batch.column("item").to_numpy()
            tokens = [np.asarray(t, np.int64).view(np.uint64) for t in batch.column("tokens").to_pylist()]
            b = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
            h, n = np.concatenate([*tokens, np.zeros(0, np.uint64)]), np.diff(b)
            out = []
            for m in MASKS:
                at, hashes = seeds(h, b, m)
                out.append((at, hashes, np.zeros(len(at), np.int64)))
            for size in np.unique(n[n < SHORT]):
                for m in short_masks(int(size)):
                    at, hashes = seeds(h, b, m)
                    own = n[np.searchsorted(b, at, "right") - 1] == size
                    out.append((at[own], hashes[own], np.full(int(own.sum()), size)))
            at, hashes, short = (np.concatenate(c) for c in zip(*out, strict=True))
            doc = np.searchsorted(b, at, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), pa.array(item[doc], pa.int64()), pa.array(at - b[doc], pa.int32()),
                 pa.array(short, pa.int32())], ["hash", "item", "item_pos", "short"])

    return items.select("item", "tokens").mapInArrow(arrays.giving_back(run), "hash long, item long, item_pos int, short int")


def seed_filter(item_seed: DataFrame) -> np.ndarray:
    """Bloom filter over the benchmark's hashes: each task sets bits, Spark joins them by byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unique(np.concatenate(_probes(batch.column("hash").to_numpy().view(np.uint64), FILTER_BITS)))
            at, first = np.unique(bits >> np.uint64(3), return_index=True)
            value = np.bitwise_or.reduceat((1 << (bits & np.uint64(7))).astype(np.uint8), first) if len(at) else first
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(value, pa.int32())], ["at", "bits"])

    rows = item_seed.select("hash").mapInArrow(arrays.giving_back(run), "at int, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros(FILTER_BITS // 8, np.uint8)  # at most this many rows were collected
    table[rows["at"]] = rows["bits"]
    return table


def hits(docs: DataFrame, bits: np.ndarray, short: list[int], keep: str = "doc_id") -> DataFrame:
    """Documents with possible hits: ``(doc, doc_id, base, tokens, hashes, places)``.

    ``tokens`` is the stretch of token hashes around the hits, beginning at
    token ``base`` of the document; ``places`` are positions in the document.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    kind = docs.schema[keep].dataType.simpleString()
    masks = list(dict.fromkeys([*MASKS, *(m for n in short for m in short_masks(n))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, done, part = shared.value, 0, TaskContext.get().partitionId()
        for batch in batches:
            for i in range(0, len(batch), 1000):
                some = batch.slice(i, 1000)
                h, b = token_hashes(some.column("text"))
                at, hashes = [], []
                for m in masks:
                    a, s = seeds(h, b, m)
                    rest = _all_probes(table, s)
                    at.append(a[rest])
                    hashes.append(s[rest])
                at, hashes = np.concatenate(at), np.concatenate(hashes)
                order = np.argsort(at, kind="stable")
                at, hashes = at[order], hashes[order]
                doc = np.searchsorted(b, at, "right") - 1
                rows = []
                for d in np.unique(doc):
                    x, y = np.searchsorted(doc, [d, d + 1])
                    lo, hi = max(b[d], at[x] - CONTEXT), min(b[d + 1], at[y - 1] + max(map(len, masks)) + CONTEXT)
                    rows.append(((part << 33) + done + int(d), int(d), lo - b[d], h[lo:hi].view(np.int64),
                                 hashes[x:y].view(np.int64), at[x:y] - b[d]))
                done += len(some)
                cols = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), some.column(keep).take(pa.array(cols[1], pa.int64())),
                     pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.int64())),
                     pa.array(cols[4], pa.list_(pa.int64())), pa.array(cols[5], pa.list_(pa.int64()))],
                    ["doc", keep, "base", "tokens", "hashes", "places"])

    return docs.select(keep, "text").mapInArrow(
        arrays.giving_back(run), f"doc long, {keep} {kind}, base long, tokens array<long>, hashes array<long>, places array<long>")


def _all_probes(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    left = np.arange(len(h))
    for p in _probes(h, FILTER_BITS):
        q = p[left]
        left = left[(table[q >> np.uint64(3)] >> (q & np.uint64(7)).astype(np.uint8)) & 1 > 0]
    return left


def best_overlap(doc: np.ndarray, item: np.ndarray, base: int, diagonal: int) -> tuple[int, int, int]:
    """Equal tokens, start in the document and length of the best ungapped overlap on one diagonal."""
    lo, hi = max(base, diagonal), min(base + len(doc), diagonal + len(item))
    if hi <= lo:
        return 0, lo, 0
    same = doc[lo - base: hi - base] == item[lo - diagonal: hi - diagonal]
    sums = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    gain = sums - np.minimum.accumulate(sums)
    end = int(gain.argmax())
    start = int(np.flatnonzero(sums[: end + 1] == sums[: end + 1].min())[-1]) if end else 0
    return int(same[start:end].sum()), lo + start, end - start


def contaminated(docs: DataFrame, benchmark: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """One row per document and item that overlap: ``(doc_id, item_id, start, length, n_equal, item_len)``.

    ``start`` and ``length`` count tokens of the document (the best overlap; of
    equally good ones the first).
    """
    items = item_tokens(benchmark)
    seed = materialize(item_seeds(items), "item-seeds")
    short = sorted(r[0] for r in seed.filter("short > 0").select("short").distinct().collect())  # at most SHORT lengths
    found = materialize(hits(docs, seed_filter(seed), short), "hits")
    places = found.select("doc", F.explode(F.arrays_zip("hashes", "places")).alias("z"))
    places = places.select("doc", F.col("z.hashes").alias("hash"), F.col("z.places").alias("place"))
    diagonals = (places.join(seed, "hash").select("doc", "item", (F.col("place") - F.col("item_pos")).alias("diagonal"))
                 .distinct())
    pairs = diagonals.join(found.select("doc", "doc_id", "base", "tokens"), "doc").join(
        items.withColumnRenamed("tokens", "item_tokens"), "item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("tokens", "item_tokens", "base", "diagonal"))
            for a, b, base, diagonal in zip(*columns, strict=True):
                out.append((*best_overlap(np.array(a), np.array(b), base, diagonal), len(b)))
            n = pd.DataFrame(out, columns=["n_equal", "start", "length", "item_len"])
            ok = np.flatnonzero(n["n_equal"] >= np.minimum(min_tokens, np.ceil(n["item_len"] * MIN_SHARE)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(ok)) for c in ("doc", "doc_id", "item", "item_id")),
                 *(pa.array(n[c].to_numpy()[ok], pa.int64()) for c in ("start", "length", "n_equal", "item_len"))],
                ["doc", "doc_id", "item", "item_id", "start", "length", "n_equal", "item_len"])

    ids = {c: pairs.schema[c].dataType.simpleString() for c in ("doc_id", "item_id")}
    checked = pairs.select("doc", "doc_id", "item", "item_id", "base", "diagonal", "tokens", "item_tokens").mapInArrow(
        arrays.giving_back(verify), f"doc long, doc_id {ids['doc_id']}, item long, item_id {ids['item_id']}, "
                "start long, length long, n_equal long, item_len long")
    best = F.max(F.struct("n_equal", -F.col("start"), "length"))
    out = checked.groupBy("doc", "doc_id", "item", "item_id", "item_len").agg(best.alias("b"))
    return out.select("doc_id", "item_id", (-F.col("b")["col2"]).alias("start"), F.col("b.length").alias("length"),
                      F.col("b.n_equal").alias("n_equal"), "item_len")
