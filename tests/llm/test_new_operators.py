"""Whitening, sharding and the term scan against plain versions, with their edge cases."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import sharding, term_scan, whitening
from test_llm_operators import SCHEMA, table, texts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    out = [(i, t, r.choice(["en", None]), "s") for i, t in enumerate(texts(4, 90))]
    out += [(None, "no id here", "en", "s"), (None, "no id here", "en", "s"), (3, "an ID twice: É_x-y" * 3, "en", "s"), out[20], out[20]]
    return [*out, *((1000 + k, "hot text", None, None) for k in range(60)), (5000, "long " * 400_000, "en", "s")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 11 --------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, d int, x binary, n long, component int, whitened string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, 1, b"", 2, 3, "w") for i, e in rows], VECTORS).repartition(4)


def plain_whitening(rows, top):
    """By numpy's own decomposition."""
    good = [(i, e) for i, e in rows if e and all(v is not None and math.isfinite(v) for v in e)]
    sizes = collections.Counter(len(k) for k in {tuple(math.floor(256 * np.float64(np.float32(v))) for v in e) for _, e in good})
    d = max(sizes, key=lambda k: (sizes[k], k))
    xs = [(i, tuple(math.floor(256 * np.float64(np.float32(v))) for v in e)) for i, e in good if len(e) == d]
    fit = np.array(sorted({x for _, x in xs}), np.float64)
    sums = [sum(map(int, c)) for c in zip(*{x for _, x in xs}, strict=True)]
    y = fit - fit.mean(axis=0)
    v = y.T @ y / len(fit)
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:top], q[:, ::-1][:, :top]
    out = {}
    for i, x in xs:
        w = (np.array(x) - np.array(sums) / len(fit)) @ q / np.sqrt(e)
        out[i] = (len(fit), sum((len(fit) * a - s) ** 2 for a, s in zip(x, sums, strict=True)), w, e / np.trace(v))
    return out


def test_whitening(spark):
    r = np.random.default_rng(2)
    mix = r.standard_normal((12, 12)) * np.linspace(0.2, 3, 12)
    rows = [(i, (r.standard_normal(12) @ mix).tolist()) for i in range(400)]
    rows += [(1000 + k, rows[0][1]) for k in range(300)]  # one hot vector counts once
    rows += [(2000, None), (2001, []), (2002, [1.0] * 11 + [None]), (2003, [1.0] * 11 + [float("nan")]),
             (2004, [1.0] * 11 + [float("inf")]), (2005, [1.0, 2.0]), (2006, [-0.0] * 12)]
    want = plain_whitening(rows, 4)
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert collections.Counter(x.vec_id for x in got) == {i: 4 for i in want}
    sign = {}
    for x in got:
        n, deviation, w, share = want[x.vec_id]
        k = x.component - 1
        assert (x.n, x.deviation) == (n, deviation)
        if x.vec_id == 0:
            sign[k] = np.sign(x.whitened * w[k])
        assert abs(x.explained / share[k] - 1) < 1e-9 and x.identity_error < 1e-9
    for x in got:
        k = x.component - 1
        assert abs(x.whitened * sign[k] - want[x.vec_id][2][k]) < 1e-8


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).collect() == []
    same = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(x.whitened, x.deviation, x.n, x.explained, x.identity_error) for x in same] == [(0, 0, 1, 0, 0)] * 4
    huge = whitening.whiten(vectors(spark, [(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [0.0, 1.0])])).collect()
    assert len(huge) == 6 and {x.deviation for x in huge if x.vec_id == 1} == {None}
    equal = whitening.whiten(vectors(spark, [(k, [float(k // 2 == j) for j in range(3)]) for k in range(6)])).collect()
    assert len(equal) == 18 and all(x.identity_error < 1e-9 for x in equal)


def test_decomposition_matches_numpy():
    r = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 60):
        b = r.standard_normal((n, n))
        for a in (b @ b.T, b + b.T, np.diag(np.repeat([4.0, 4.0, 1.0], n)[:n])):
            v, q = whitening.eigen(a)
            assert np.allclose(v, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * np.linalg.norm(a))
            assert np.abs(a @ q - q * v).max() <= 1e-12 * np.linalg.norm(a) and np.abs(q.T @ q - np.eye(n)).max() < 1e-11
    u = whitening.polar(b + b.T)
    e, q = np.linalg.eigh(b + b.T)
    assert np.abs(u - q @ np.diag(np.sign(e)) @ q.T).max() < 1e-10


# --- 12 --------------------------------------------------------------------------------


def test_sharding_keeps_the_law(docs, rows):
    shards = 7
    got = sharding.shard(docs, shards).collect()
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        assert (r.law, r.grown_shard) == ("rows", None)
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(shards)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    groups = collections.defaultdict(collections.Counter)
    for r in got:
        groups[r.text_crc32, r["size"]][r.shard] += 1
    quota = len(rows) // shards
    big = {k: g for k, g in groups.items() if g.total() > quota}
    assert len(big) == 1
    for k, g in groups.items():
        if k in big:  # it fills shards one after the other
            assert len(g) <= math.ceil(g.total() / quota) + 1
        elif k != (0, 1):  # null texts are not linked
            assert len(g) == 1


def test_sharding_of_small_tables_and_links(spark, none):
    assert sharding.shard(none).collect() == []
    few = table(spark, [(i, f"t{i}", None, None) for i in range(5)])
    assert sorted((r.shard, r.slot) for r in sharding.shard(few).collect()) == [(k, 0) for k in range(5)]
    r = random.Random(1)
    rows = [(i, f"t{i}", r.choice(["a", "b", "c", None]), f"s{i % 40}" if i < 120 else None) for i in range(300)]
    got = sharding.shard(table(spark, rows), 4, [F.col("source"), F.col("lang")]).collect()
    of = {x.doc_id: x.shard for x in got}
    assert collections.Counter(collections.Counter(of.values()).values()) == {75: 4}

    def kept(label):  # links inside a shard, counted by hub
        hubs = collections.defaultdict(collections.Counter)
        for i, _, lang, source in rows:
            for h in (lang, source):
                if h is not None:
                    hubs[h][label(i)] += 1
        return sum(n * (n - 1) for c in hubs.values() for n in c.values())

    assert kept(of.get) > 1.5 * kept(lambda i: i % 4)


def test_quotas_keep_counts():
    r = np.random.default_rng(5)
    for _ in range(200):
        n = int(r.integers(2, 6))
        wanted, spare = r.integers(0, 9, (n, n)), r.integers(0, 5, n)
        np.fill_diagonal(wanted, 0)
        granted = sharding.quotas(wanted, spare)
        net = granted.sum(axis=0) - granted.sum(axis=1)
        assert (granted >= 0).all() and (granted <= wanted).all() and (net <= spare).all()
        for a, lo, hi, b in sharding.fillers(granted):
            assert 0 <= lo < hi <= spare[a]
            net[a], net[b] = net[a] - (hi - lo), net[b] + (hi - lo)
        assert not net.any()


# --- 13 --------------------------------------------------------------------------------


def plain_search(rows, items, best):
    found = [(i, TERM.findall((t or "").translate(UPPER))) for i, t, _, _ in rows]
    found = [(i, collections.Counter(ts), len(ts)) for i, ts in found if ts]
    n, total = len(found), sum(f[2] for f in found)
    df = collections.Counter(t for _, c, _ in found for t in c)
    out = collections.Counter()
    for item, text in items:
        ranked = []
        for i, c, size in found:
            m = 25 + 75 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in TERM.findall((text or "").translate(UPPER)) if c[t])
            if score > 0:
                ranked.append((-score, term_scan.NO_ID if i is None else i))
        for rank, (score, i) in enumerate(sorted(ranked)[:best], 1):
            out[item, rank, None if i == term_scan.NO_ID else i, -score] += 1
    return out


@pytest.mark.parametrize("block_bytes", [term_scan.BLOCK_BYTES, 40])
def test_term_scan(spark, docs, rows, block_bytes):
    items = [(1, "w1 w2 W3 w3, of the"), (2, "É_x-y ID"), (3, None), (4, "!!"), (5, "absent words only"), (5, "hot text: hot"), (None, "中文 long w7"),
             (6, "w5 w5 w5 the"), (6, "w5 w5 w5 the"), (7, "xx x" + "x" * 39)]
    asked = spark.createDataFrame([(i, t, "r", 1) for i, t in items], "item_id long, text string, rank string, item int")
    got = term_scan.search(docs, asked, 6, block_bytes).collect()
    assert collections.Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == plain_search(rows, items, 6)


def test_term_scan_of_empty_tables(spark, docs, none):
    some = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert term_scan.search(none, some).collect() == []
    assert term_scan.search(docs, some.limit(0)).collect() == []
    assert term_scan.search(table(spark, [(1, None, None, None), (2, " .. ", None, None)]), some).collect() == []
