"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles.

Shingles are five consecutive words (a shorter text is one shingle).  A shingle
weighs its count in the text times log(1 + documents / document frequency); the
frequencies of all documents are counted by Spark in 2**18 hash buckets, so the
table that tasks load has a fixed size and the weights do not depend on the size
of the corpus.  Shingles fall into 64 bins by hash, twice; each bin takes one of
its shingles with probability proportional to its weight (the random variables of
a shingle come from a fixed table addressed by its hash), and an empty bin takes
the sample of the next filled one in an order of its own.  Texts that agree in all
samples of a band meet in a bucket.  With 21 bands of 6 samples, texts of similarity
0.8 meet with probability 0.998, texts of 0.3 with 0.015.

Within a bucket the first few texts and then a few leaders a round are compared with
the others by weighted Jaccard similarity, leaders and others in blocks of texts;
links join texts to classes.  Leaders come from the smallest classes
of a bucket and are then done; the rounds end when the texts left in every bucket
are of one class, so every candidate pair has been compared or lies in one class
already - without pairing all texts of a bucket.

Exact copies (same words) are one text throughout.  Defined cases: a null or
word-free text is a class of its own per row; rows are told apart by doc_id and
text (``keyed``), so different texts without or with one doc_id are different
documents; a null doc_id counts as the smallest long; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm import arrays
from foliant.plans.lineage import materialize

SHINGLE = 5
BUCKET_BITS = 18
BANDS, ROWS = 21, 6
PASSES, BINS = 2, 64
SIMILARITY = 0.8
PIVOTS, LEADERS, BLOCK = 8, 512, 32
NO_ID = -(1 << 63)
KEY = ("doc_id", "tag")
SLOTS = 1 << 16

_rng = np.random.default_rng(4)
RATE = _rng.gamma(2, 1, SLOTS).astype(np.float32)
PER_RATE = (1 / RATE).astype(np.float32)
SHIFT = _rng.random(SLOTS).astype(np.float32)
LOG_C = np.log(_rng.gamma(2, 1, SLOTS)).astype(np.float32)
TURN = _rng.integers(1, 1 << 62, (PASSES, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = _rng.integers(0, BINS // 2, BINS) * 2 + 1  # odd: visits every bin


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of the distinct shingles (ordered by text), then word hashes and bounds."""
    s, e, b = arrays.words(data, offs)
    h = arrays.word_hashes(data, s, e)
    at = arrays.window_starts(b, SHINGLE)
    few = np.flatnonzero((np.diff(b) > 0) & (np.diff(b) < SHINGLE))
    all_h = np.concatenate([arrays.run_hashes(h, at, at + SHINGLE), arrays.run_hashes(h, b[few], b[few + 1])])
    doc = np.concatenate([np.searchsorted(b, at, "right") - 1, few])
    key = arrays.mix(all_h + doc.astype(np.uint64) * np.uint64(arrays.BASE))
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    pick = order[first]
    by_doc = np.argsort(doc[pick].astype(np.uint16) if len(offs) < 1 << 16 else doc[pick], kind="stable")
    return doc[pick][by_doc], all_h[pick][by_doc], count[by_doc], h, b


def _small_parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offs = arrays.flat(batch.column("text"))
    for i, j in arrays.parts(offs):
        yield i, j, data[offs[i]: offs[j]], offs[i: j + 1] - offs[i]


def keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, tag, text)``: the id without nulls, and a hash of the text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("tag"), "text")


def survey(docs: DataFrame) -> DataFrame:
    """One pass: per document its text key (two hashes of its words), per hash bucket the document frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << BUCKET_BITS, np.int64)
        names = ["bucket", "n", *KEY, "key1", "key2"]
        for batch in batches:
            for i, j, data, offs in _small_parts(batch):
                _, sh, _, h, b = shingles(data, offs)
                df += np.bincount((sh >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(df))
                k1, k2 = arrays.run_hashes(h, b[:-1], b[1:]), arrays.run_hashes(arrays.mix(h + np.uint64(1)), b[:-1], b[1:])
                none = pa.nulls(j - i, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [none, pa.array(np.diff(b), pa.int64()), *(batch.column(c).slice(i, j - i) for c in KEY),
                     pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))], names)
        at = np.flatnonzero(df)
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at]), none, none, none, none], names)

    return keyed(docs).mapInArrow(arrays.giving_back(run), "bucket int, n long, doc_id long, tag long, key1 long, key2 long")


def idf_table(surveyed: DataFrame) -> np.ndarray:
    """Weight of each of the 2**18 buckets."""
    n_docs = surveyed.filter("bucket IS NULL AND n > 0").count()
    rows = surveyed.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.full(1 << BUCKET_BITS, np.log1p(max(1, n_docs)), np.float32)
    table[rows["bucket"]] = np.log1p(n_docs / rows["n"]).astype(np.float32)
    return table


def samples(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts that have shingles, and their samples: one 64-bit value per sample, equal where the samples are.

    The value holds the (shifted) logarithm of the winner's hash value and 32
    bits of the shingle's hash, which also breaks ties.
    """
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros((0, PASSES * BINS), np.uint64)
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    row = np.cumsum(new) - 1
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((PASSES, row[-1] + 1, BINS), empty, np.uint64)
    log_w, low = np.log(weight).astype(np.float32), h & np.uint64(0xFFFFFFFF)
    for k, (turn, deal) in enumerate(TURN):
        slot = ((h * turn) >> np.uint64(48)).astype(np.int32)
        shift, rate = SHIFT[slot], RATE[slot]
        t = np.floor(log_w * PER_RATE[slot] + shift)
        log_a = LOG_C[slot] - rate * (t - shift + np.float32(1)) + np.float32(96)
        value = np.maximum(log_a, np.float32(0)).view(np.uint32).astype(np.uint64) << np.uint64(32) | low
        bin_ = ((h * deal) >> np.uint64(58)).astype(np.int64)
        own = out[k]
        np.minimum.at(own.reshape(-1), row * BINS + bin_, value)
        filled = own.copy()
        r, c = np.nonzero(own == empty)
        tries = 0
        while len(r):
            tries += 1
            got = filled[r, (c + tries * STEP[c]) % BINS]
            own[r, c] = got
            left = got == empty
            r, c = r[left], c[left]
    return doc[new], np.concatenate(list(out), axis=1)


def band_rows(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """``(key1, key2, bands)``: one hash per band for each text that has words."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in _small_parts(batch):
                doc, sh, n, h, b = shingles(data, offs)
                w = n * shared.value[(sh >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
                who, sig = samples(doc, sh, w, len(offs) - 1)
                bands = np.zeros((len(who), BANDS), np.uint64)
                for r in range(ROWS):
                    bands = arrays.mix(bands * np.uint64(arrays.BASE) + sig[:, r * BANDS: (r + 1) * BANDS])
                k1, k2 = arrays.run_hashes(h, b[who], b[who + 1]), arrays.run_hashes(arrays.mix(h + np.uint64(1)), b[who], b[who + 1])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(who) + 1) * BANDS, pa.int32()),
                                                 pa.array(bands.view(np.int64).reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), lists],
                                                 ["key1", "key2", "bands"])

    return docs.select("text").mapInArrow(arrays.giving_back(run), "key1 long, key2 long, bands array<long>")


def compare(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose weighted Jaccard similarity reaches the threshold."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    # The same plan at every size: the texts move once per side, however few the pairs are.
    both = pairs.hint("merge").join(right, "b").join(left.hint("merge"), "a").select("a", "b", "text_a", "text_b")

    def vectors(column: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
        data, offs = arrays.flat(column)
        doc, sh, n, _, _ = shingles(data, offs)
        w = n * shared.value[(sh >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
        cut = np.searchsorted(doc, np.arange(1, len(offs) - 1))
        return np.split(sh, cut), np.split(w, cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 200):
                some = batch.slice(i, 200)
                (ha, wa), (hb, wb) = vectors(some.column("text_a")), vectors(some.column("text_b"))
                ok = []
                for x, u, y, v in zip(ha, wa, hb, wb, strict=True):
                    _, p, q = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                    both_w = np.minimum(u[p], v[q]).sum()
                    ok.append(both_w >= similarity * (u.sum() + v.sum() - both_w) > 0)
                keep = pa.array(np.array(ok, bool))
                yield pa.RecordBatch.from_arrays([some.column("a").filter(keep), some.column("b").filter(keep)], ["a", "b"])

    return both.mapInArrow(arrays.giving_back(run), "a long, b long")


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of few rows while what is written inside holds large rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def compare_blocks(members: DataFrame, leaders: DataFrame, texts: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """Links ``(a, b)`` between leaders and members of a bucket with another label.

    Both sides come in blocks of about ``BLOCK`` texts, so a bucket of n members
    and m leaders gives n * m / BLOCK**2 rows; only links leave the task.
    """
    spark = members.sparkSession
    shared = spark.sparkContext.broadcast(idf)

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        size = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"))
        n_blocks = F.ceil(F.col("_n") / F.lit(BLOCK)).cast("long")
        dealt = rows.join(size, "bucket").withColumn("_b", F.pmod(F.xxhash64("node"), n_blocks))
        item = F.struct("node", "label", "text")
        return dealt.join(texts, "node").groupBy("bucket", "_b").agg(F.collect_list(item).alias(name)).drop("_b")

    def vectors(items: pa.StructArray) -> tuple[np.ndarray, ...]:
        data, offs = arrays.flat(items.field("text"))
        doc, sh, n, _, _ = shingles(data, offs)
        w = n * shared.value[(sh >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
        return doc, sh, w, np.bincount(doc, w, len(items)), items.field("node").to_numpy(), items.field("label").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in range(len(batch)):
                left, right = (batch.column(c).slice(k, 1).flatten() for c in ("members", "leaders"))
                d1, h1, w1, t1, n1, l1 = vectors(left)
                d2, h2, w2, t2, n2, l2 = vectors(right)
                order = np.argsort(h2)
                h2, d2, w2 = h2[order], d2[order], w2[order]
                lo, hi = np.searchsorted(h2, h1, "left"), np.searchsorted(h2, h1, "right")
                many = hi - lo
                at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                own = np.repeat(np.arange(len(h1)), many)
                both = np.bincount(d1[own] * len(t2) + d2[at], np.minimum(w1[own], w2[at]), len(t1) * len(t2)).reshape(len(t1), len(t2))
                ok = (both > 0) & (both >= similarity * (t1[:, None] + t2[None, :] - both)) & (l1[:, None] != l2[None, :])
                x, y = np.nonzero(ok)
                a.append(np.minimum(n1[x], n2[y]))
                b.append(np.maximum(n1[x], n2[y]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    both = blocks(members, "members").join(blocks(leaders, "leaders"), "bucket").select("members", "leaders")
    with batches_of(spark, 2):  # a row holds two blocks of texts
        out = materialize(both.mapInArrow(arrays.giving_back(run), "a long, b long").distinct(), "links")
    shared.unpersist()
    return out


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(node, label)``: the smallest node of each connected component.

    Rounds of taking the smallest label among the neighbours and then following
    the label of the label; the number of rounds grows with the logarithm of the
    longest path for most graphs, and the loop ends when nothing changes.
    """
    edges = materialize(links.select(F.col("a").alias("node"), F.col("b").alias("other"))
                        .union(links.select("b", "a")).distinct(), "edges")
    now = materialize(nodes.select("node", F.col("node").alias("label")).distinct(), "labels")
    while True:
        near = edges.join(now.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("least"))
        step = now.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("least", "label")).alias("new"))
        jump = now.select(F.col("node").alias("new"), F.col("label").alias("beyond"))
        new = materialize(step.join(jump, "new", "left").select(
            "node", F.least("new", F.coalesce("beyond", "new")).alias("label"), F.col("label").alias("old")), "labels")
        if new.filter("label < old").isEmpty():
            return new.select("node", "label")
        now = new.select("node", "label")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after joining the classes that ``links`` connect: only the graph between classes is walked."""
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("_a")), "a").join(
        labels.select(F.col("node").alias("b"), F.col("label").alias("_b")), "b")
    edges = materialize(ends.filter("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), "class-edges")
    if edges.isEmpty():
        return labels
    known = components(edges.select(F.col("a").alias("node")).union(edges.select("b")), edges)
    moved = labels.join(known.select(F.col("node").alias("label"), F.col("label").alias("_new")), "label", "left")
    return materialize(moved.select("node", F.coalesce("_new", "label").alias("label")), "labels")


def classes(docs: DataFrame, similarity: float = SIMILARITY, leaders: int = LEADERS) -> DataFrame:
    """``(doc_id, class_id, copy_of, n_links)`` of every document.

    ``class_id`` is the smallest doc_id of the class, ``copy_of`` the smallest
    with the same words, ``n_links`` the verified links of that text.
    """
    return keyed_classes(docs, similarity, leaders).select("doc_id", "class_id", "copy_of", "n_links")


def keyed_classes(docs: DataFrame, similarity: float = SIMILARITY, leaders: int = LEADERS) -> DataFrame:
    """``classes`` with ``tag`` and ``class_tag``: (class_id, class_tag) is the smallest (doc_id, tag) of the class.

    A node of the graph is a text, named by a hash of its two keys.
    """
    surveyed = materialize(survey(docs), "survey")
    idf = idf_table(surveyed)
    rows = surveyed.filter("bucket IS NULL")
    worded = rows.filter("n > 0")
    reps = worded.groupBy("key1", "key2").agg(F.min(F.struct(*KEY)).alias("own")).withColumn("node", F.xxhash64("key1", "key2"))
    reps = materialize(reps, "texts-once")
    banded = band_rows(docs, idf).groupBy("key1", "key2").agg(F.first("bands").alias("bands"))
    located = banded.join(reps, ["key1", "key2"]).select("node", F.posexplode("bands").alias("band", "hash"))
    located = materialize(located.select("node", F.xxhash64("band", "hash").alias("bucket")), "bands")
    shared = located.groupBy("bucket").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi")).filter("_lo < _hi")
    active = materialize(located.join(shared.select("bucket"), "bucket").distinct(), "buckets")
    nodes = active.select("node").distinct()
    wanted = reps.join(nodes, "node").select("own.*", "node")
    texts = keyed(docs).join(wanted.hint("merge"), [*KEY]).dropDuplicates([*KEY])
    texts = materialize(texts.select("node", "text"), "texts")

    # First a few texts of every bucket against all of it, then what is still in different classes.
    order = Window.partitionBy("bucket").orderBy("node")
    first = active.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= PIVOTS)
    first = materialize(first.select("bucket", F.col("node").alias("a")), "leaders")
    pairs = active.join(first, "bucket").filter("node <> a").select(
        F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    links = materialize(compare(pairs, texts, idf, similarity), "links")
    labels = merged(materialize(nodes.select("node", F.col("node").alias("label")), "labels"), links)
    active = active.join(first.select("bucket", F.col("a").alias("node")), ["bucket", "node"], "left_anti")
    while True:
        tagged = materialize(active.select("bucket", "node").join(labels, "node"), "active")
        open_ = tagged.groupBy("bucket").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).filter("_lo < _hi")
        tagged = materialize(tagged.join(open_.select("bucket"), "bucket"), "open")
        if tagged.isEmpty():
            break
        sizes = tagged.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("_n"))
        order = Window.partitionBy("bucket").orderBy("_n", "label", "node")
        lead = materialize(tagged.join(sizes, ["bucket", "label"]).withColumn("_k", F.row_number().over(order))
                           .filter(F.col("_k") <= leaders).select("bucket", "label", "node"), "leaders")
        new = compare_blocks(tagged, lead, texts, idf, similarity)
        links = links.union(new)
        labels = merged(labels, new)
        active = tagged.join(lead.select("bucket", "node"), ["bucket", "node"], "left_anti")

    links = links.distinct()
    n_links = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    per_node = labels.join(n_links, "node", "left")
    per_text = reps.join(per_node, "node", "left").select(
        "key1", "key2", "own", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    per_text = materialize(per_text, "per-text")
    firsts = per_text.groupBy("label").agg(F.min("own").alias("first"))
    per_text = per_text.join(firsts, "label").select(
        "key1", "key2", F.col("first.doc_id").alias("class_id"), F.col("first.tag").alias("class_tag"),
        F.col("own.doc_id").alias("copy_of"), "n_links")
    names = [*KEY, "class_id", "class_tag", "copy_of", "n_links"]
    alone = rows.filter("n = 0").select(*KEY, F.col("doc_id").alias("class_id"), F.col("tag").alias("class_tag"),
                                        F.col("doc_id").alias("copy_of"), F.lit(0).cast("long").alias("n_links"))
    return worded.select(*KEY, "key1", "key2").join(per_text, ["key1", "key2"]).select(*names).union(alone)
