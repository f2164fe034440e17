"""Ranked lexical search without a document index: an Aho-Corasick automaton of all item terms scans the texts.

The distinct terms of the items (the queries), each guarded by a separator on both
sides, make one automaton.  A text becomes one string in which every character
outside terms is the separator, so the automaton, walked once over it, reports
exactly the whole terms; their numbers map to the items that hold them.  A first scan
sums what the weights need - documents, terms, and the document frequency of the item
terms - in one row set per task; a second one scores and keeps each item's best
documents per task, and Spark ranks what the tasks kept.

The automaton is broadcast, hence bounded: terms of at most ``block_bytes`` bytes an
automaton; more items are searched in further blocks, each with its own two scans.

Defined cases: a term is a run of ASCII letters, digits and characters beyond ASCII,
with A-Z lower-cased only; a null or term-free text is no document of the statistics
and is never ranked; every row of the items is an item (equal ids have one ranking
each), items without a known term have no result; every row of the documents is a
document (repeated ones follow each other); a null doc_id comes before all others;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm import arrays
from foliant.plans.lineage import materialize

BEST = 10
BLOCK_BYTES = 1 << 20
GUARD = " "
#: Every byte of UTF-8: letters and digits (A-Z as a-z) and bytes beyond ASCII stay, the rest separates.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
NO_ID = -(1 << 63)
ENTRIES = 1 << 21  # (document, item) contributions added up at once


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Block:
    """Some items and their distinct terms: what a scan needs, small enough to send to every task."""

    def __init__(self, items: list[list[bytes]]):
        self.terms = sorted({t for i in items for t in i})
        at = {t: k for k, t in enumerate(self.terms)}
        pairs = sorted((at[t], i, n) for i, ts in enumerate(items) for t, n in Counter(ts).items())
        self.n_items = len(items)
        self.item = np.array([p[1] for p in pairs], np.int64)  # postings of the terms: items and times
        self.times = np.array([p[2] for p in pairs], np.int64)
        self.start = np.searchsorted(np.array([p[0] for p in pairs]), np.arange(len(self.terms) + 1))

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for k, t in enumerate(self.terms):
            out.add_word(GUARD + t.decode("latin-1") + GUARD, k)  # bytes as characters: texts are scanned as UTF-8
        out.make_automaton()
        return out


def scan(automaton, text: bytes) -> tuple[int, Counter]:
    """The number of terms of a text, and how often each term of the automaton occurs."""
    folded = text.translate(FOLD)
    n = len(folded.split())
    return n, Counter(k for _, k in automaton.iter(GUARD + folded.decode("latin-1") + GUARD)) if n else Counter()


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    data, offs = arrays.flat(batch.column("text"))
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        yield data[a:b].tobytes()


def statistics(docs: DataFrame, block: Block) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents holding each term of the block."""
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        automaton, df, found, total = block.automaton(), np.zeros(len(block.terms), np.int64), 0, 0
        for batch in batches:
            for text in _texts(batch):
                n, tf = scan(automaton, text)
                found, total = found + (n > 0), total + n
                df[list(tf)] += 1
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, [-1, -2]), pa.int64()), pa.array(np.append(df[seen], [found, total]), pa.int64())],
                                         ["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    sent.unpersist()
    counts = {r.term: r.n for r in rows}  # at most the terms of a block
    return counts.get(-1, 0), counts.get(-2, 0), np.array([counts.get(k, 0) for k in range(len(block.terms))], np.int64)


def weights(found: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * found + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)


class Best:
    """The best documents of each item so far, over batches of scored documents."""

    def __init__(self, n_items: int, best: int):
        self.best = best
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.zeros(n_items, np.int64)  # what a document must reach

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        may = (score > 0) & (score >= self.least[item])
        self.item, self.score, self.doc = (np.concatenate(x) for x in ((self.item, item[may]), (self.score, score[may]), (self.doc, doc[may])))
        order = np.lexsort((self.doc, -self.score, self.item))
        items = self.item[order]
        rank = np.arange(len(order)) - np.searchsorted(items, items)
        order = order[rank < self.best]
        self.item, self.score, self.doc = self.item[order], self.score[order], self.doc[order]
        full, n = np.unique(self.item, return_counts=True)
        last = np.cumsum(n) - 1
        self.least[full[n == self.best]] = self.score[last[n == self.best]]


def _scores(docs: DataFrame, block: Block, found: int, total: int, weight: np.ndarray, best: int) -> DataFrame:
    """``(item, doc_id, score)``: the best documents of each item, task by task."""
    sent = docs.sparkSession.sparkContext.broadcast((block, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weight = sent.value
        automaton, kept = block.automaton(), Best(block.n_items, best)
        many = np.diff(block.start)

        def flush(held: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
            term = np.concatenate([h[1] for h in held])
            owner = np.repeat(np.arange(len(held)), [len(h[1]) for h in held])
            part = weight[term] * np.concatenate([h[2] for h in held])
            reach = many[term]
            at = np.repeat(block.start[term] - (np.cumsum(reach) - reach), reach) + np.arange(int(reach.sum()))
            key = np.repeat(owner, reach) * block.n_items + block.item[at]
            value = np.repeat(part, reach) * block.times[at]
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            score = np.add.reduceat(value, first) if len(first) else value
            doc = np.array([h[0] for h in held], np.int64)
            kept.add(key[first] % block.n_items, score, doc[key[first] // block.n_items])

        for batch in batches:
            ids = batch.column("doc_id").fill_null(NO_ID).to_pylist()
            held, size = [], 0
            for doc, text in zip(ids, _texts(batch), strict=True):
                n, tf = scan(automaton, text)
                if not tf:
                    continue
                m = 25 + 75 * n * found // total
                term, times = np.array(list(tf), np.int64), list(tf.values())
                held.append((doc, term, np.array([1_000_000_000 * x // (1000 * x + 8 * m) for x in times], np.int64)))
                size += int(many[term].sum())
                if size > ENTRIES:
                    flush(held)
                    held, size = [], 0
            if held:
                flush(held)
        yield pa.RecordBatch.from_arrays([pa.array(kept.item), pa.array(kept.doc), pa.array(kept.score)], ["item", "doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "item long, doc_id long, score long")
    out = materialize(rows, "best")
    sent.unpersist()
    return out


def blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list, Block]]:
    """Ids and terms of the items, in runs of at most ``block_bytes`` bytes of terms (one item at least)."""
    ids, words, size = [], [], 0
    for r in items.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():  # one part of the query set at a time
        ts = terms((r.text or "").encode())
        new = sum(map(len, ts))
        if ids and size + new > block_bytes:
            yield ids, Block(words)
            ids, words, size = [], [], 0
        ids.append(r.item_id)
        words.append(ts)
        size += new
    if ids:
        yield ids, Block(words)


def search(docs: DataFrame, items: DataFrame, best: int = BEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``best`` highest-scoring documents of each item."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for ids, block in blocks(items, block_bytes):
        if not block.terms:
            continue
        found, total, df = statistics(docs, block)
        if not found:
            break
        named = spark.createDataFrame(list(enumerate(ids)), f"item long, item_id {kind}")
        order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        ranked = _scores(docs, block, found, total, weights(found, df), best).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
        out = out.union(ranked.join(named, "item").select(
            "item_id", F.col("rank").cast("int").alias("rank"), F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score"))
    return out
