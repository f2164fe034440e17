"""Every operator against a plain version on small tables, with the defined edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm import (arrays, catalog, chat, contamination, lang_id, mixing, near_dedup, perplexity, repeats, rlz_dedup,
                         suffix_dedup, token_files, url_trust)

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, h long, kept string, score string, "
          "label string, topic string, tokens string, prob string, node long, piece string")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def texts(seed: int = 1, n: int = 60) -> list[str | None]:
    """Random words of a small vocabulary with copied passages, whole copies, nulls, blanks and one long text."""
    r = random.Random(seed)
    vocabulary = ["the", "of", "é", "中文", "a.", "x" * 40, "wörd", *(f"w{i}" for i in range(60))]
    passage = [r.choice(vocabulary) for _ in range(40)]
    out: list[str | None] = [None, "", " \n\t ", "one", "\x1c odd \xa0 space\x85"]
    for _ in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(1, 60))]
        if r.random() < 0.4:
            at = r.randint(0, 20)
            words[at:at] = passage[r.randint(0, 5): r.randint(20, 40)]
        out.append(r.choice([" ", "\n", "  "]).join(words))
    out += [out[10], out[10], out[11], "ab " * 3000, "z" * 5000]
    return out


def table(spark, rows):
    full = [(i, t, lang, src, len(t or ""), 1, "k", "s", "l", "t", "n", "p", 2, "q") for i, t, lang, src in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = [(i, t, r.choice(["en", "fr", None]), r.choice(["s0", "s0", "s1", None])) for i, t in enumerate(texts())]
    return [*out, (None, "no id " * 30, "en", "s0"), (7, "same id, other text " * 8, "fr", None), out[12], out[12]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def as_counter(df, *names):
    return collections.Counter(tuple(r[n] for n in names) for r in df.collect())


# --- 1 and 10 --------------------------------------------------------------------------


def later_windows(rows, width):
    """(row, start) of windows whose words start earlier; equal (doc_id, start) are ties."""
    key = lambda i: repeats.NO_ID if i is None else i
    places = collections.defaultdict(list)
    words = [[w.encode() for w in WORD.findall(t or "")] for _, t, _, _ in rows]
    for k, ws in enumerate(words):
        for s in range(len(ws) - width + 1):
            places[tuple(ws[s: s + width])].append((key(rows[k][0]), s, k))
    return words, {(k, s) for p in places.values() for i, s, k in p if (i, s) > min(p)[:2]}


@pytest.mark.parametrize("hot", [repeats.HOT, 0])
def test_rlz_dedup(docs, rows, hot):
    width = 6
    words, later = later_windows(rows, width)
    want = collections.Counter()
    for k, ws in enumerate(words):
        gone = {s + j for s in range(len(ws)) if (k, s) in later for j in range(width)}
        kept = b" ".join(w for j, w in enumerate(ws) if j not in gone)
        want[rows[k][0], len(ws), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()] += 1
    got = rlz_dedup.dedup(docs, width, 2, hot=hot)
    assert as_counter(got, "doc_id", "n_words", "n_removed", "kept_sha256", "kept") == want


def test_rlz_factors_are_copies(docs, rows):
    by_id = collections.defaultdict(list)
    for i, t, _, _ in rows:
        by_id[repeats.NO_ID if i is None else i].append(WORD.findall(t or ""))
    n = 0
    for r in rlz_dedup.dedup(docs, 6, 2).filter("n_factors > 0 AND doc_id <> 7").collect():
        own = by_id[r.doc_id][0]
        for f in r.factors:
            n += 1
            assert f.words >= 6
            if f.ref_id != 7:
                ref = by_id[f.ref_id][0]
                assert own[f.start: f.start + 6] == ref[f.ref_pos: f.ref_pos + 6]
                assert (f.ref_id, f.ref_pos) < (r.doc_id, f.start)
    assert n > 20


@pytest.mark.parametrize("hot", [repeats.HOT, 0])
def test_suffix_dedup(docs, rows, hot):
    width, seen = 24, collections.Counter()
    data = [(t or "").encode() for _, t, _, _ in rows]
    for d in data:
        seen.update(d[s: s + width] for s in range(len(d) - width + 1))
    want = collections.Counter()
    for (i, _, _, _), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d) + 1, bool)
        for s in range(len(d) - width + 1):
            if seen[d[s: s + width]] > 1:
                gone[s: s + width] = True
        n_spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[:-1]).sum()) if len(d) else 0
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        want[i, len(d), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()] += 1
    got = suffix_dedup.dedup(docs, width, 8, hot=hot)
    assert as_counter(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_column_order_matches_pairs():
    r = random.Random(5)
    rows = [bytes(r.choice(b"ab") for _ in range(r.randint(8, 30))) for _ in range(60)]
    group = np.array([r.randint(0, 4) for _ in rows])
    left, n = np.zeros(60, np.int64), np.array([len(x) - 7 for x in rows])
    got = set(zip(*(x.tolist() for x in suffix_dedup.repeated_windows(group, rows, left, n, 8)), strict=True))
    want = {(a, s) for a, x in enumerate(rows) for s in range(len(x) - 7) for b, y in enumerate(rows)
            if a != b and group[a] == group[b] and y[s: s + 8] == x[s: s + 8] and len(y) >= s + 8}
    assert got == want


def test_dedup_of_empty_tables(none):
    assert rlz_dedup.dedup(none).collect() == []
    assert suffix_dedup.dedup(none).collect() == []


def test_long_texts_fall_into_segments(monkeypatch):
    r = np.random.default_rng(1)
    symbols = r.integers(0, 3, 4000).astype(np.uint64) * arrays.U(0x9E3779B97F4A7C15)
    bounds = np.array([0, 10, 10, 2500, 4000])
    whole = repeats.stretches(symbols, bounds, 16, 4)
    windows = lambda out: {(int(d), int(p) + k, int(h)) for h, _, d, p, n in zip(*out, strict=True) for k in range(n)}
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    assert windows(repeats.stretches(symbols, bounds, 16, 4)) == windows(whole)


# --- 2 ---------------------------------------------------------------------------------


def test_token_files(spark, docs, rows, none):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(catalog.byte_bpe())
    files = token_files.write_tokens(docs, catalog.byte_bpe())
    got = token_files.read_tokens(spark, files).orderBy("start").collect()
    ids = lambda t: np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
    want = collections.Counter((i, len(ids(t)), zlib.crc32(ids(t).tobytes())) for i, t, _, _ in rows)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    keys = [repeats.NO_ID if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys)
    ranks = spark.read.parquet(files.ranks).orderBy("rank").collect()
    assert [r["n"] for r in ranks] == sorted((r["n"] for r in ranks), reverse=True)
    assert token_files.read_tokens(spark, token_files.write_tokens(none, catalog.byte_bpe())).collect() == []


def test_variable_length_code():
    r = np.random.default_rng(2)
    ranks = np.concatenate([r.integers(0, 1 << b, 50) for b in (8, 16, 24, 32)]).astype(np.uint32)
    r.shuffle(ranks)
    counts = np.array([3, 0, 1, 96, 100])
    control, data = token_files.compress(ranks, counts)
    join = lambda x: np.frombuffer(b"".join(x), np.uint8)
    assert token_files.decompress(join(control), join(data), counts).tolist() == ranks.tolist()
    assert [len(c) for c in control] == [1, 0, 1, 24, 25]


# --- 3 ---------------------------------------------------------------------------------


def test_quality_counts_and_bands(docs, rows, none):
    def plain(i, t):
        t = t or ""
        w = WORD.findall(t)
        c = collections.Counter(tuple(w[k: k + 8]) for k in range(len(w) - 7))
        again = {k + j for k in range(len(w) - 7) if c[tuple(w[k: k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
        return (i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), failed)

    got = perplexity.quality(docs)
    assert as_counter(got, "doc_id", *perplexity.COUNTS, "base_failed") == collections.Counter(plain(i, t) for i, t, _, _ in rows)
    assert not any(r.kept and r.base_failed for r in got.collect())
    assert perplexity.quality(none).collect() == []


def test_odd_texts_are_rejected(spark):
    r = random.Random(9)
    words = ["ther", "and", "tion", "ing", "es", "of", "in", "er", "on", "at"]
    clean = [(i, " ".join(r.choice(words) + r.choice(words) for _ in range(120)), "en", "s") for i in range(200)]
    junk = [(1000 + i, " ".join("".join(r.choice("qxzjvkwy0987") for _ in range(7)) for _ in range(120)), "en", "s") for i in range(4)]
    got = {x.doc_id: x.kept for x in perplexity.quality(table(spark, clean + junk)).collect()}
    assert all(got[i] for i in range(200)) and not any(got[1000 + i] for i in range(4))


def test_word_order_of_any_script_counts(spark):
    """Words alike in their bytes' classes at both ends: only longer n-grams tell a known order from a random one."""
    r = random.Random(12)
    words = [f"да{a}{b}ад" for a in "бвгжз" for b in "клмнпр"]

    def walk():
        k, out = r.randrange(30), []
        for _ in range(120):
            k = (k + r.randint(1, 3)) % 30
            out.append(words[k])
        return " ".join(out)

    clean = [(i, walk(), "ru", "s") for i in range(200)]
    junk = [(1000 + i, " ".join(r.choice(words) for _ in range(120)), "ru", "s") for i in range(4)]
    got = {x.doc_id: x.kept for x in perplexity.quality(table(spark, clean + junk)).collect()}
    assert sum(got[i] for i in range(200)) >= 198 and not any(got[1000 + i] for i in range(4))


def test_word_model_against_plain_counts(docs, rows):
    """Every trigram's probability without one of its documents, by plain counting."""
    def spans(t):
        return re.findall(r"[0-9A-Za-z\x80-\u07ff]+|[^\x20\x09-\x0D]", t or "")

    words = [spans(t) for _, t, _, _ in rows]
    docs_of = collections.Counter(g for w in words for g in set(zip(w, w[1:], w[2:], strict=False)))
    bi = collections.Counter(g[1:] for g in docs_of)
    orders = [docs_of, bi, collections.Counter((g[1],) for g in bi)]

    def discounts(c):
        r = [max(1, sum(n == k for n in c.values())) for k in (1, 2, 3, 4)]
        y = r[0] / (r[0] + 2 * r[1])
        return [0, *np.clip([k - (k + 1) * y * r[k] / r[k - 1] for k in (1, 2, 3)], 0.05, [0.95, 1.95, 2.95])]

    off = [discounts(c) for c in orders]
    by_context = [collections.defaultdict(dict) for _ in orders]
    for k, c in enumerate(orders):
        for g, n in c.items():
            by_context[k][g[:-1]][g] = n

    def p(g, k, less):
        if k == 3:
            return 1 / (len(orders[2]) + 1)
        counts = dict(by_context[k][g[:-1]])
        lower = p(g[1:], k + 1, int(less and counts[g] == 1))
        counts[g] -= less
        held = {x: n - off[k][min(n, 3)] for x, n in counts.items()}
        t = sum(counts.values())
        return (held[g] + (t - sum(held.values())) * lower) / t if t else lower

    want = sorted(-np.log2(p(g, 0, 1)) for g in docs_of)
    got = sorted(r.bits for r in perplexity.fit_words(docs).collect())
    assert len(got) == len(want) and np.allclose(got, want)


def test_word_model_in_passes_leaves_no_tables(spark, docs):
    """Any number of passes gives the same model; counts and model are gone once the texts are scored."""
    from foliant.plans import lineage

    made = lineage._made(spark)
    before = list(made)
    one, three = (as_counter(perplexity.fit_words(docs, k), "h", "bits") for k in (1, 3))
    assert one == three and sum(one.values()) > 500
    left = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in made if p not in before]
    assert left == ["word-model", "word-model"]
    before = list(made)
    perplexity.quality(docs)
    assert [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in made if p not in before] == ["perplexity"]


# --- 4 ---------------------------------------------------------------------------------


def near_copies(seed=4):
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(500)]
    out, k = [], 0
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(120)]
        for edits in [0, 0, 1, 1, 2, 3, 6, 12][: r.randint(1, 8)]:
            w = list(base)
            for _ in range(edits):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            out.append((k, " ".join(w), "en", "s"))
            k += 1
    return [*out, (500, "short text", "en", "s"), (501, "short text", "en", "s"), (502, None, "en", "s"), (503, "", "en", "s"),
            (504, None, "en", "s"), (None, "v1 v2 v3 v4 v5 v6", "en", "s"), out[0], out[0]]


def test_near_dedup_classes(spark, none):
    rows = near_copies()
    docs = table(spark, rows)
    got = {(r.doc_id, r.class_id) for r in near_dedup.classes(docs).collect()}
    idf = near_dedup.idf_table(near_dedup.survey(docs))
    vec = {}
    for i, t, _, _ in rows:
        data, offs = arrays.flat(pa.array([t]))
        _, h, n, _, _ = near_dedup.shingles(data, offs)
        vec[repeats.NO_ID if i is None else i] = dict(zip(h.tolist(), (n * idf[(h >> np.uint64(46)).astype(int)]).tolist(), strict=True))
    label = {i: i for i in vec}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in vec:
        for b in vec:
            both = sum(min(vec[a][k], vec[b][k]) for k in vec[a].keys() & vec[b].keys())
            if a < b and both > 0 and both >= 0.8 * (sum(vec[a].values()) + sum(vec[b].values()) - both):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    assert got == {(i, find(i)) for i in vec}
    assert near_dedup.classes(none).collect() == []


def test_a_bucket_with_several_classes_is_finished(spark, monkeypatch):
    """All texts in one bucket: links between others than the first text must be found as well."""
    rows = near_copies(8)[:60]
    docs = table(spark, rows)
    normal = {(r.doc_id, r.class_id) for r in near_dedup.classes(docs).collect()}
    whole = near_dedup.band_rows

    def one_bucket(d, idf):
        return whole(d, idf).withColumn("bands", F.array(F.lit(1).cast("long")))

    monkeypatch.setattr(near_dedup, "band_rows", one_bucket)
    assert {(r.doc_id, r.class_id) for r in near_dedup.classes(docs, leaders=3).collect()} == normal


def test_samples_follow_weights():
    """The share of equal samples estimates the weighted Jaccard similarity."""
    r = np.random.default_rng(6)
    got, want = [], []
    for _ in range(60):
        h = r.integers(1, 1 << 62, 200).astype(np.uint64)
        a, b = r.random(200) + 0.1, r.random(200) + 0.1
        _, sig = near_dedup.samples(np.repeat([0, 1], 200), np.tile(h, 2), np.concatenate([a, b]), 2)
        got.append((sig[0] == sig[1]).mean())
        want.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(got) - np.mean(want)) < 0.04


# --- 5, 8, 9 against SQL ---------------------------------------------------------------


@pytest.fixture(scope="module")
def con(rows):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    pages = pd.DataFrame([(1, "http://A.example.com/en/x?q#f", '<a href="//b.org/x">'), (2, None, None), (3, "no scheme", "x"),
                          (4, "https://b.net/es/", "<a href='http://A.example.com/'>" * 3), (5, "https://c.org", '<a href=https://B.net/1>'),
                          (6, "https://d.org/x", None), (6, "https://d.org/x", None), (7, "http://www.example.com/en/", ""),
                          (8, "ftp://e.com", '<A HREF="http://c.org/">'), (9, "https://b.net/en/", None)], columns=["page_id", "url", "html"])
    con.execute("CREATE TABLE pages AS SELECT * FROM pages")
    turns = pd.DataFrame([(1, 0, "system", "s"), (1, 1, "user", "a\\<|b"), (1, 2, "assistant", "<|im_end|>\n<"), (2, 0, "assistant", None),
                          (2, 0, "user", "x"), (3, 5, None, "y"), (4, None, "user", "é中"), (4, 1, "us<|er\n", "t")],
                         columns=["conv_id", "turn", "role", "text"]).astype({"turn": "Int64"})
    con.execute("CREATE TABLE conversations AS SELECT * FROM turns")
    d = pd.DataFrame([(i, t, lang, s) for i, t, lang, s in rows if i is not None], columns=["doc_id", "text", "lang", "source"])
    con.execute("CREATE TABLE documents AS SELECT * FROM d")
    return con


@pytest.mark.parametrize(("name", "source"), [("op5_url_trust", "pages"), ("op8_mixing", "documents"), ("op9_chat", "conversations")])
def test_against_sql(spark, con, tmp_path, name, source):
    from compare import differences

    con.execute(f"COPY {source} TO '{tmp_path}/{source}.parquet' (FORMAT parquet)")
    got = catalog.QUERIES[name](spark, str(tmp_path)).toPandas()
    assert len(got) > 3
    assert differences(got, con.execute(catalog.SQL[name]).df()) is None


def test_empty_pages_and_turns(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_trust.judge_urls(pages, catalog.URL_RULES).collect() == []
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(turns)).collect() == []


def test_escape_is_reversible():
    r = random.Random(1)
    for _ in range(2000):
        s = "".join(r.choice("\\<|n\n a") for _ in range(r.randint(0, 12)))
        assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)
        assert chat.unescape_role(chat.escape_role(s)) == s and "\n" not in chat.escape_role(s)


def test_mixing_meets_targets(docs, rows, none):
    cells = mixing.with_cells(docs).groupBy("_source", "_lang", "_topic").agg(F.sum("tokens").alias("n"))
    raked = mixing.rake(cells, {"source": {"s0": 0.5, "s1": 0.25, None: 0.25}, "lang": 1.0}, max_ratio=50, rounds=8)
    got = {r[0]: r[1] for r in raked.groupBy("_source").agg(F.sum("w")).collect()}
    total = sum(got.values())
    assert abs(got["s0"] / total - 0.5) < 0.01 and abs(got["s1"] / total - 0.25) < 0.01
    out = mixing.mix(docs, catalog.MIX_TARGETS)
    assert out.count() == len(rows) and out.filter("prob < 0 OR prob > 1.0000001 OR kept IS NULL").isEmpty()
    assert mixing.mix(none, catalog.MIX_TARGETS).collect() == []


def test_mixing_without_bound_meets_production_targets(spark, none):
    docs = catalog.table(spark, SF, "documents")
    out = mixing.mix(docs, catalog.MIX_TARGETS).persist()
    assert abs(out.agg(F.max("prob")).first()[0] - 1) < 1e-9
    for d, a in catalog.MIX_TARGETS.items():
        sums = out.groupBy(d).agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("prob"))).collect()
        goal, got = np.array([r[1] for r in sums], float) ** a, np.array([r[2] for r in sums])
        assert np.allclose(got / got.sum(), goal / goal.sum(), rtol=1e-3)
    tokens, kept = out.agg(F.sum("tokens"), F.sum(F.when(F.col("kept"), F.col("tokens")))).first()
    expected = out.agg(F.sum(F.col("tokens") * F.col("prob"))).first()[0]
    assert abs(kept - expected) < 0.15 * expected < tokens


def exchange_threads(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getThreadMXBean()
    names = [t.getThreadName() for t in beans.getThreadInfo(beans.getAllThreadIds()) if t is not None]
    return {n for n in names if n.startswith("shuffle-exchange-")}


def test_rounds_leave_no_threads_in_the_driver(spark):
    rows = [(i, "word " * (1 + i * i % 97) + ("licensed" if i % 3 else "123"), f"l{i % 4}", f"s{i % 7 * (i % 2)}") for i in range(400)]
    cells = mixing.with_cells(table(spark, rows)).groupBy("_source", "_lang", "_topic").agg(F.sum("tokens").alias("n"))
    before = exchange_threads(spark)
    raked = mixing.rake(cells, catalog.MIX_TARGETS)
    assert len(exchange_threads(spark) - before) <= 5  # one a shuffle of the cells, none a round
    assert raked.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true"
    assert raked.count() == cells.count()


def test_texts_without_an_id_are_drawn_one_by_one(spark):
    rows = [(None, f"some words in text {i}", "en", "s") for i in range(400)] + [(1, "other", "fr", "t")] * 400
    out = mixing.mix(table(spark, rows), {"source": {"s": 0.3, "t": 0.7}}, columns=["doc_id", "source"])
    assert 10 < out.filter("source = 's' AND kept").count() < 80  # each by itself: 400 with a probability of 0.086
    assert out.filter("source = 't'").select("kept").distinct().count() == 1  # copies together


# --- 6 and 7 ---------------------------------------------------------------------------


def test_language_of_held_out_rows(spark):
    rows = catalog.op6_lang_id(spark, SF).join(catalog.table(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    held = rows.filter("held_out").collect()
    assert len(held) > 30 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in held)


def test_language_edge_cases(docs, rows, none):
    model = lang_id.fit(docs)
    got = lang_id.predict(docs, model, keep=("doc_id", "text")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
        assert r.lang_pred != "und" or (r.score == 0 and not r.accepted)
    blank = lang_id.fit(none)
    assert {r.lang_pred for r in lang_id.predict(docs, blank).collect()} == {"und"}
    assert lang_id.predict(none, model).collect() == []


def test_unlearned_languages_and_junk_are_rejected(spark):
    """A language outside the labels and shuffled letters; nearly all texts of the learned languages stay."""
    docs = catalog.table(spark, SF, "documents").filter("length(text) > 400")
    r = random.Random(4)

    def shuffled(t):
        letters = [c for c in t.lower() if c.isalpha()]
        r.shuffle(letters)
        return "".join(letters.pop() if c.isalpha() else c for c in t.lower())

    for out in ("fr", "de"):
        model = lang_id.fit(docs.filter(F.col("lang") != out).filter(~catalog.held_out()))
        held = docs.filter(catalog.held_out()).persist()
        junk = [(i, shuffled(x.text)) for i, x in enumerate(held.limit(60).collect())]
        share = lambda df: np.mean([x.accepted for x in lang_id.predict(df, model).collect()])
        assert share(held.filter(F.col("lang") == out)) < 0.1
        assert share(spark.createDataFrame(junk, "doc_id long, text string")) < 0.1
        assert share(held.filter(F.col("lang") != out)) > 0.97


def test_decontamination(spark, none):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    items = [[word() for _ in range(n)] for n in (30, 18, 5, 1, 40, 9)]
    texts_, want = [], set()
    for k in range(60):
        w = [word() for _ in range(r.randint(0, 80))]
        if k % 3 == 0:
            i = r.choice([0, 1, 2, 4, 5])
            passage = [x.upper() + "," if r.random() < 0.3 else x for x in items[i]]
            for j in range(3, len(passage) - 12, 9):  # scattered substitutions
                passage[j] = "other"
            w[len(w) // 2: len(w) // 2] = passage
            want.add((k, i))
        texts_.append((k, " ".join(w), "en", "s"))
    texts_ += [(100, None, "en", "s"), (101, "", "en", "s"), (None, " ".join(items[1]), "en", "s")]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(90, None), (91, "!!")], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in contamination.contaminated(table(spark, texts_), bench).collect()}
    assert got == want | {(None, 1)}
    assert contamination.contaminated(none, bench).collect() == []
    assert contamination.contaminated(table(spark, texts_), bench.limit(0)).collect() == []


def passing(n):
    """All patterns of equal (True) and substituted tokens of an item of ``n`` tokens that the check accepts."""
    need = min(contamination.MIN_TOKENS, int(np.ceil(n * contamination.MIN_SHARE)))
    for bits in range(1 << n):
        if bits.bit_count() >= need:
            same = np.array([bits >> k & 1 for k in range(n)], bool)
            if contamination.best_overlap(same.astype(int), np.ones(n, int), 0, 0)[0] >= need:
                yield same


def test_no_passing_pattern_is_unseeded():
    for n in [*range(1, 17), 19]:
        masks = contamination.short_masks(n) if n < contamination.SHORT else contamination.MASKS
        looked_at = [sum(1 << s + k for k, c in enumerate(m) if c == "1") for m in masks for s in range(n - len(m) + 1)]
        for same in passing(n):
            bits = sum(1 << k for k in np.flatnonzero(same).tolist())
            assert any(bits & x == x for x in looked_at), (n, same)


def test_substitutions_in_short_items(spark):
    items = {n: [f"item{n}w{k}" for k in range(n)] for n in range(1, 16)}
    rows, want = [], set()
    for n, words in items.items():
        for same in passing(n):
            rows.append((len(rows), " ".join(["pad", *(w if s else "other" for w, s in zip(words, same, strict=True)), "pad"]), "en", "s"))
            want.add((len(rows) - 1, n))
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in contamination.contaminated(table(spark, rows), bench).collect()}
    assert got == want
