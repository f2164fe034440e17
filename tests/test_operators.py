"""Joins, windows, stores and retrieval on small hand-made or random tables."""

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant import rules as R
from foliant.operators import access, classify, cleaning, conversation, dense, evaluate, facts, fusion, ingest, lexical, links, metrics, scorers
from foliant.plans import corpus
from foliant.plans.skew import attach_by_key, running_cutoff
from foliant.rules import PageRules
from foliant.sources import captures, sinks
from foliant.streaming import ingest as stream
from foliant.streaming import sessions


# --- skew ---------------------------------------------------------------------------------


def test_attach_by_key_with_hot_and_null_keys(spark):
    rnd = random.Random(1)
    rows = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{rnd.randint(0, 400)}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, k string")
    per_key = df.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    got = {r.id: r.first_id for r in attach_by_key(df, per_key, ["k"], "n", "id", hot_share=10).collect()}
    firsts = {}
    for i, k in rows:
        firsts.setdefault(k, i)
    assert got == {i: None if k is None else firsts[k] for i, k in rows}


def test_hot_rows_spread_over_partitions(spark):
    df = spark.range(4000).select(F.col("id"), F.lit("same").alias("k"))
    per_key = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = attach_by_key(df, per_key, ["k"], "n", "id").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in parts) == 4000 and max(r["count"] for r in parts) < 2000


@pytest.mark.parametrize("target", [1, 37, 100, 10_000])
def test_running_cutoff(spark, target):
    rnd = random.Random(target)
    rows = [("hot" if rnd.random() < 0.6 else "b", p, rnd.random() < 0.5) for p in range(500)]
    df = spark.createDataFrame(rows, "job_id string, position int, accepted boolean")
    want = set()
    for job in ("hot", "b"):
        n = 0
        for j, p, ok in rows:
            if j == job:
                if n < target:
                    want.add((j, p))
                n += ok
    got = {(r.job_id, r.position) for r in metrics.stop_at_target(df, target, width=16).collect()}
    assert got == want
    assert running_cutoff(df, "job_id", "position", "accepted", target, 16).count() <= 2


# --- ingest ---------------------------------------------------------------------------------


def test_dedup_decisions(spark):
    inc = spark.createDataFrame([
        (1, "s", "https://s/a", "h1"), (2, "s", "https://s/b", "h1"), (3, "s", "https://s/c", "h2"), (4, "s", "https://s/c", "h3"),
        (5, "t", "https://t/a", "h1"), (6, "s", "https://s/d", "h4"), (7, "s", "https://s/e", "h5"), (8, "s", "https://s/a", "h1"),
    ], "doc_id int, source_id string, canonical_url string, content_hash string")
    stored = spark.createDataFrame([("s", "https://s/d", "h4"), ("s", "https://s/z", "h5"), ("s", "https://s/c", "h0")],
                                   "source_id string, canonical_url string, content_hash string")
    counts = spark.createDataFrame([("https://s/d", 2)], "canonical_url string, n_chunks bigint")
    got = {r.doc_id: (r.decision, r.same_as_url) for r in ingest.dedup_decisions(inc, stored, counts).collect()}
    assert got == {
        1: ("saved", None), 2: ("duplicate_content_other_url", "https://s/a"), 3: ("updated", None), 4: ("updated", None),
        5: ("saved", None), 6: ("duplicate_content", None), 7: ("duplicate_content_other_url", "https://s/z"), 8: ("duplicate_content", None),
    }
    # Same hash stored, but no chunks: the page is processed again.
    none = ingest.dedup_decisions(inc.filter("doc_id = 6"), stored, counts.limit(0)).first()
    assert none.decision == "updated"


def test_store_merge_touches_only_its_buckets(spark, tmp_path):
    cols = "doc_id int, canonical_url string, title string, original_filename string"
    path = str(tmp_path / "store")
    sinks.write_store(spark.createDataFrame([(i, f"u{i}", "old", "f.pdf") for i in range(20)], cols), path, buckets=8)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    sinks.merge_into_store(spark, path, spark.createDataFrame([(100, "u3", "new", ""), (101, "v1", "new", "n.pdf")], cols), buckets=8)
    rows = {r.canonical_url: (r.doc_id, r.title, r.original_filename) for r in sinks.read_store(spark, path).collect()}
    assert len(rows) == 21 and rows["u3"] == (3, "new", "f.pdf") and rows["v1"] == (101, "new", "n.pdf") and rows["u5"][1] == "old"
    kept = [p for p in before if p.exists()]
    assert 0 < len(kept) < len(before) and all(p.stat().st_mtime_ns == before[p] for p in kept)


def test_replace_children_and_register(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "doc_id int, text string")
    out = ingest.replace_children(old, spark.createDataFrame([(1, "z")], old.schema), spark.createDataFrame([(1,)], "doc_id int"), ["doc_id"])
    assert sorted(map(tuple, out.collect())) == [(1, "z"), (2, "c")]
    src = spark.createDataFrame([("id1", "www.a.org", 5)], "source_id string, domain string, created_at int")
    seen = spark.createDataFrame([("https://a.org/x", 1), ("https://b.org/y", 3), ("http://www.b.org", 2)], "url string, captured_at int")
    rows = ingest.register_sources(src, seen).collect()
    assert sorted((r.domain, r.created_at) for r in rows) == [("b.org", 2), ("www.a.org", 5)]


# --- sources ----------------------------------------------------------------------------------


def test_sitemaps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    rows = [
        ("https://h.org/sitemap.xml", f"<sitemapindex {ns}><sitemap><loc>https://h.org/s1.xml</loc></sitemap></sitemapindex>"),
        ("https://h.org/s1.xml", f"<urlset {ns}><url><loc> https://h.org/a </loc></url><url><loc>https://h.org/b.pdf</loc></url>"
                                 f"<url><loc>https://o.org/c</loc></url><url><loc>https://h.org/a</loc></url><url><loc>https://h.org/d</loc></url></urlset>"),
        ("https://h.org/bad.xml", "<urlset><url>"), ("https://h.org/other.xml", f"<urlset {ns}><url><loc>https://h.org/zz</loc></url></urlset>"),
    ]
    df = spark.createDataFrame(rows, "sitemap_url string, xml string")
    roots = spark.createDataFrame([("https://h.org/sitemap.xml",)], "sitemap_url string")
    assert [r.url for r in captures.expand_sitemaps(df, "h.org", roots).collect()] == ["https://h.org/a", "https://h.org/d"]
    assert {r.url for r in captures.expand_sitemaps(df, "h.org").collect()} == {"https://h.org/a", "https://h.org/d", "https://h.org/zz"}
    deep = [(f"s{n}", f"<sitemapindex {ns}><sitemap><loc>s{n + 1}</loc></sitemap><sitemap><loc>s0</loc></sitemap></sitemapindex>") for n in range(7)]
    deep.append(("s7", f"<urlset {ns}><url><loc>https://h.org/deep</loc></url></urlset>"))
    far = captures.expand_sitemaps(spark.createDataFrame(deep, "sitemap_url string, xml string"), "h.org",
                                   spark.createDataFrame([("s0",)], "sitemap_url string")).first()
    assert (far.url, far.first_level) == ("https://h.org/deep", 7)


def test_file_sources_and_sinks(spark, tmp_path):
    items = {"version": "1", "site": "s", "items": [{"id": "Q1", "category": "a", "expected_facts": ["x"]}, {"id": "Q2", "turn_number": 2}]}
    (tmp_path / "set.json").write_text(json.dumps(items, indent=1))
    got = captures.read_eval_set(spark, str(tmp_path / "set.json")).orderBy("position").collect()
    assert [(r.position, r.id, r.turn_number) for r in got] == [(0, "Q1", None), (1, "Q2", 2)]
    (tmp_path / "r.jsonl").write_text('{"id": 1, "ok": true}\nbroken{\n{"id": 2, "ok": false, "category": "c"}\n')
    rows = captures.read_jsonl(spark, str(tmp_path / "r.jsonl"))
    assert sorted(r.id for r in rows.collect()) == [1, 2]
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin" / "a.pdf").write_bytes(b"x" * 10)
    (tmp_path / "bin" / "b.pdf").write_bytes(b"x" * 100)
    (tmp_path / "bin" / "c.txt").write_bytes(b"x")
    assert captures.read_binary_documents(spark, str(tmp_path / "bin"), 50).count() == 1
    gate = spark.createDataFrame([("https://h/a.PDF", "", 5), ("https://h/a", "application/pdf", 5), ("https://h/b", "text/html", 5), ("https://h/c.pdf", "", 99)],
                                 "url string, content_type string, size int")
    assert captures.document_gate(gate, max_bytes=50).count() == 2
    out = str(tmp_path / "out")
    sinks.append_results(rows, out)
    sinks.append_results(rows, out)
    assert spark.read.json(out).count() == 4
    judged = rows.withColumn("decline", F.lit(False))
    sinks.write_probe_report(evaluate.probe_summary(rows), evaluate.probe_failures(judged), str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep/failures")).count() == 1
    pages = spark.createDataFrame([("https://h/x", "T", "body")], "url string, title string, text string")
    sinks.export_markdown(pages, str(tmp_path / "md"), 4)
    assert spark.read.parquet(str(tmp_path / "md")).first().file_name.startswith("t-")


def test_spans(spark):
    spans = [("d", 1, 0, 0, 0, 0, "Gran", 18.0, 0), ("d", 1, 0, 0, 0, 1, "título", 12.0, 0), ("d", 1, 1, 0, 0, 0, "Sub", 14.0, 0),
             ("d", 1, 2, 0, 0, 0, "negrita", 10.0, 16), ("d", 1, 2, 0, 1, 0, "punto.", 10.0, 16), ("d", 1, 3, 1, 0, 0, "imagen", 10.0, 0), ("d", 2, 0, 0, 0, 0, "7", 9.0, 0)]
    df = spark.createDataFrame(spans, "doc_id string, page int, block int, block_type int, line int, span int, text string, size double, flags int")
    doc = cleaning.lines_to_documents(cleaning.spans_to_lines(df)).first()
    assert (doc.text, doc.page_count) == ("## Gran título\n### Sub\n**negrita**\npunto.", 2)


def test_headings_and_windows(spark):
    from foliant.functions import chunking as C
    from foliant.operators import chunks

    doc = "# Uno\n" + "a " * 300 + "\n## Dos\n" + "b " * 300 + "\nfin"
    df = spark.createDataFrame([(1, doc)], "doc_id int, text string")
    rows = chunks.with_offsets(df, C.boundary_chunks("text")).orderBy("chunk_id").collect()
    assert [r.heading for r in rows][:2] == ["", "Uno"] and rows[-1].heading == "Dos"
    assert chunks.document_windows(df, C.boundary_chunks("text")).first().window == doc


# --- links -------------------------------------------------------------------------------------


def test_frontier(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "x"), ("x", "c"), ("c", "a")]
    df = spark.createDataFrame(edges, "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.depth for r in links.frontier(seeds, df, 3).collect()} == {"a": 0, "b": 1, "x": 1, "c": 2, "d": 3}
    allowed = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    assert {r.node for r in links.frontier(seeds, df, 9, allowed).collect()} == {"a", "b", "c"}
    assert {r.node: r.depth for r in links.frontier(seeds, df).collect()} == {"a": 0, "b": 1, "x": 1, "c": 2, "d": 3, "e": 4}
    assert [r.node for r in links.frontier(seeds, df, budget=3).orderBy("depth", "node").collect()] == ["a", "b", "x"]
    assert [links.crawl_budget(n) for n in (10, 400, 20_000)] == [510, 1600, 80_000]


# --- retrieval ---------------------------------------------------------------------------------


def vectors(spark, n, dims, seed, scopes=3):
    g = np.random.default_rng(seed)
    rows = [(i, f"s{0 if i % 3 == 0 else i % scopes}", [float(x) for x in g.integers(-3, 4, dims)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "chunk_key int, source_id string, embedding array<float>")


def test_dense_paths_agree_with_brute_force(spark):
    rows, chunks = vectors(spark, 300, 4, 1)
    chunks = chunks.unionByName(spark.createDataFrame([(900, "s0", None), (901, "s0", [0.0] * 4)], chunks.schema))
    qrows, q = vectors(spark, 20, 4, 2)
    q = q.withColumnRenamed("chunk_key", "query_id")
    want = set()
    for qid, qs, qv in qrows:
        scored = []
        for cid, cs, cv in rows:
            na, nb = np.linalg.norm(cv), np.linalg.norm(qv)
            if cs == qs and na > 0 and nb > 0:
                scored.append((-round(float(np.dot(cv, qv) / na / nb), 9) + 0.0, cid))
        want |= {(qid, cid, i + 1) for i, (_, cid) in enumerate(sorted(scored)[:7])}
    fast = {(r.query_id, r.chunk_key, r.rank) for r in dense.dense_topk(chunks, q, 7).collect()}
    joined = {(r.query_id, r.chunk_key, r.rank) for r in dense.dense_topk(chunks, q, 7, broadcast_bytes=0).collect()}
    assert fast == want and joined == want


def test_web_queries(spark):
    texts = {1: "el plan de estudios de medicina", 2: "estudios de plan", 3: "becas y comedor", 4: "plan de becas", 5: "comedor de medicina"}
    chunks = spark.createDataFrame([(k, "s", v) for k, v in texts.items()], "chunk_key int, source_id string, text string")
    ask = {1: "plan estudios", 2: '"plan de estudios"', 3: "becas or medicina", 4: "plan -becas", 5: "medicina -plan or becas comedor", 6: "-plan", 7: '"plan de" or "comedor de"'}
    q = spark.createDataFrame([(k, "s", v) for k, v in ask.items()], "query_id int, source_id string, text string")
    got = {}
    for r in lexical.lexical_topk(chunks, q, F.col("text")).collect():
        got.setdefault(r.query_id, set()).add(r.chunk_key)
    assert got == {1: {1, 2}, 2: {1}, 3: {1, 3, 4, 5}, 4: {1, 2}, 5: {3, 5}, 7: {1, 4, 5}}
    stored = lexical.build_postings(chunks, F.col("text"))
    again = lexical.lexical_topk(chunks, q, F.col("text"), postings=stored, match="any").count()
    assert again == lexical.lexical_topk(chunks, q, F.col("text"), match="any").count() > 0
    assert lexical.lexical_topk(chunks, q.drop("source_id"), F.col("text"), scope=None).count() > 0


def test_light_stem(one):
    assert one(lexical.light_stem(F.col("t")), t="carreras") == "carrer" == one(lexical.light_stem(F.col("t")), t="carrera")


def test_fusion_ties_and_rerank_fallback(spark):
    lists = [spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, chunk_key string, rank bigint"),
             spark.createDataFrame([(1, "c", 1), (1, "b", 2)], "query_id int, chunk_key string, rank bigint")]
    fused = fusion.rrf_fuse(fusion.stack_lists(lists), 2)
    assert [r.chunk_key for r in fused.orderBy("fused_rank").collect()] == ["b", "a", "c"]
    cand = fused.withColumns({"query_text": F.lit("x"), "candidate_text": F.col("chunk_key")})

    def failing(df):
        return df.select("query_id", "chunk_key", F.lit(None).cast("double").alias("score"))

    order = fusion.rerank(cand, failing).orderBy("rerank_rank").collect()
    assert [r.chunk_key for r in order] == ["b", "a", "c"]
    length = scorers.with_batches(lambda b: b[["query_id", "chunk_key"]].assign(score=[ord(k) * 1.0 for k in b.chunk_key]),
                                  "query_id int, chunk_key string, score double")
    assert [r.chunk_key for r in fusion.rerank(cand, length, 2).orderBy("rerank_rank").collect()] == ["c", "b"]


def test_pack_stops_at_first_overflow(spark):
    rnd = random.Random(8)
    rows = [(q, i, "x" * rnd.randint(1, 60)) for q in range(5) for i in range(30)]
    got = fusion.pack_context(spark.createDataFrame(rows, "query_id int, context_rank int, block string"), 300).collect()
    want = set()
    for q in range(5):
        used = 0
        for qq, i, b in rows:
            if qq == q:
                if used + len(b) > 300:
                    break
                used += len(b)
                want.add((q, i))
    assert {(r.query_id, r.context_rank) for r in got} == want


def test_default_scorers(spark):
    df = spark.createDataFrame([("cuánto dura la carrera", ["La carrera dura seis años. Otra cosa.", "nada"])], "query string, context array<string>")
    row = scorers.ngram_verifier(scorers.extractive_answers(df)).first()
    assert row.response == "La carrera dura seis años." and row.groundedness == 1.0
    assert scorers.identity_rewrite(df).first().resolved_query == "cuánto dura la carrera"


# --- conversation and access ------------------------------------------------------------------


def test_history_pack_matches_loop(spark):
    rnd = random.Random(9)
    rows = [(s, i, "user", "y" * rnd.randint(0, 900)) for s in range(6) for i in range(rnd.randint(1, 25))]
    df = spark.createDataFrame(rows, "session_id int, created_at int, role string, text string")
    got = {(r.session_id, r.created_at) for r in conversation.pack_history(df, keys=("session_id",)).collect()}
    want = set()
    for s in range(6):
        total = 0
        for _, i, role, t in [r for r in rows if r[0] == s][-12:]:
            line = f"USER: {t}"
            line = line if len(line) <= 500 else line[:499].rstrip() + "…"
            if total + len(line) + 1 > 5000:
                break
            total += len(line) + 1
            want.add((s, i))
    assert got == want


def test_state_and_grants(spark):
    df = spark.createDataFrame([('{"a":"1","b":"2"}', '{"b":"3","greeting_sent":"true"}'), (None, '{"x":"1"}')], "s string, u string")
    got = [json.loads(r.m) for r in df.select(conversation.merge_state("s", "u").alias("m")).collect()]
    assert got == [{"a": "1", "b": "3", "greeting_sent": "true"}, {"x": "1"}]
    grants = spark.createDataFrame([("u1", "s1", 1)], "user_id string, source_id string, created_at int")
    wanted = spark.createDataFrame([("u1", "s1", 9), ("u2", "s1", 5), ("u2", "s1", 6)], grants.schema)
    linked = access.link_sources(grants, wanted)
    assert sorted(map(tuple, linked.collect())) == [("u1", "s1", 1), ("u2", "s1", 5)]
    users = spark.createDataFrame([("x1", "u1")], "external_id string, user_id string")
    left = access.unlink_sources(linked, spark.createDataFrame([("x1", "s1")], "external_id string, source_id string"), users)
    assert [r.user_id for r in left.collect()] == ["u2"]
    # A later null never erases an earlier value.
    ev = spark.createDataFrame([("u", 1, "a@x"), ("u", 2, None), ("u", 0, "z@x")], "user_id string, ts int, email string")
    assert access.latest_profiles(ev, "user_id", "ts", ["email"]).first().email == "a@x"


def test_allowed_for_one_source(spark):
    src = spark.createDataFrame([("s1", "a.org"), ("s2", "www.b.org")], "source_id string, domain string")
    req = spark.createDataFrame([("s1", "https://www.a.org"), ("s1", "https://b.org"), ("s2", "HTTPS://B.org:444/x"), ("s2", "nope")], "source_id string, origin string")
    got = [r.allowed for r in access.allowed_requests(req, src, source="source_id").orderBy("source_id", "origin").collect()]
    assert sorted(got) == [False, False, True, True]


# --- evaluation --------------------------------------------------------------------------------


def test_scoring_and_selection(spark):
    schema = ("id string, category string, difficulty string, expects_clarification boolean, answer string, error string, elapsed_ms double, "
              "context_chunks array<string>, expected_facts array<string>, must_not_contain array<string>")
    items = spark.createDataFrame([
        ("1", "Listing", "easy", None, "seis años", None, 1.0, ["son seis años"], ["seis", "diez"], []),
        ("2", "out_of_scope", "easy", None, "Lamentablemente no puedo", None, 1.0, [], [], ["cura"]),
        ("3", "dates", "easy", True, "  ", "timeout", 1.0, None, ["x"], [])], schema)
    rows = {r.id: r for r in evaluate.score_items(items).collect()}
    assert (rows["1"].correctness, rows["1"].faithfulness, rows["1"].refusal_correct) == (0.5, 1.0, None)
    assert (rows["2"].correctness, rows["2"].refusal_correct, rows["2"].hallucinated) == (None, True, False)
    assert (rows["3"].correctness, rows["3"].judge_error) == (0.0, "empty_answer")
    assert [r.id for r in evaluate.select_items(items, ["1", "3"], 1).collect()] == ["1"]
    ok = evaluate.judge_probe(spark.createDataFrame([(1, "No tengo información.", True), (2, "No tengo información.", False), (3, "Sí", None)],
                                                    "id int, answer string, expects_decline boolean"))
    assert {r.id: r.ok for r in ok.collect()} == {1: True, 2: False, 3: True}


# --- plans and streaming -------------------------------------------------------------------------

PAGES = [
    (1, "https://h.org/carreras/medicina", "Medicina", "<main><h1>Medicina</h1><p>Director de carrera: Dra. Ana Pérez</p><p>Duración: 6 años</p></main>"),
    (2, "https://h.org/otra?utm_source=a", "Otra", "<main><p>uno dos tres cuatro cinco seis</p></main>"),
    (3, "https://h.org/copia", "Copia", "<main><p>uno dos tres cuatro cinco seis</p></main>"),
    (4, "https://o.org/x", "Fuera", "<main><p>uno dos tres cuatro cinco seis siete</p></main>"),
    (5, "https://h.org/noticias/1", "Novedad", "<main><p>uno dos tres cuatro cinco seis ocho</p></main>"),
    (6, "https://h.org/otra", "Otra", "<main><p>uno dos tres cuatro cinco seis nueve</p></main>"),
    (7, "https://h.org/corta", "Corta", "<main><p>uno dos</p></main>"),
]
PAGE_SCHEMA = "page_id int, url string, title string, html string"


def test_corpus(spark):
    pages = captures.scan_pages(spark.createDataFrame(PAGES, PAGE_SCHEMA))
    built = corpus.build_corpus(pages, PageRules(), "h.org")
    outcomes = {r.page_id: r.outcome for r in built.outcomes.collect()}
    assert outcomes == {1: "accepted", 2: "accepted", 3: "skipped:duplicate_content_other_url", 4: "blocked_host", 5: "blocked_pattern",
                        6: "accepted", 7: "invalid:too_short"}
    decisions = {r.doc_id: r.decision for r in built.decisions.collect()}
    assert decisions == {1: "saved", 2: "saved", 3: "duplicate_content_other_url", 6: "updated"}
    assert {r.doc_id for r in built.documents.collect()} == {1, 6}
    assert {(r.fact_key, r.fact_value) for r in built.facts.collect()} == {
        ("program_name", "Medicina"), ("director", "Dra. Ana Pérez"), ("duration", "6 años")}
    assert {(r.doc_id, r.chunk_id, r.context) for r in built.chunks.collect()} == {(1, 0, "Medicina"), (6, 0, "Otra")}


def test_stream_equals_batch(spark, tmp_path):
    store, inbox = str(tmp_path / "store"), tmp_path / "inbox"
    frame = spark.createDataFrame(PAGES, PAGE_SCHEMA)
    docs = corpus.prepare_documents(captures.scan_pages(frame), PageRules(), "h.org")
    sinks.write_store(docs.limit(0), store, buckets=4)
    for n, ids in enumerate(([1, 2], [3, 4], [5, 6, 7])):
        frame.filter(F.col("page_id").isin(ids)).coalesce(1).write.parquet(str(inbox / f"p{n}"))
        pages = stream.read_capture_stream(spark, str(inbox / "*"), PAGE_SCHEMA)
        q = stream.ingest_stream(pages, store, str(tmp_path / "check"), PageRules(), "h.org", buckets=4)
        q.awaitTermination()
    got = {(r.canonical_url, r.content_hash) for r in sinks.read_store(spark, store).collect()}
    batch = corpus.build_corpus(captures.scan_pages(frame), PageRules(), "h.org").documents
    assert got == {(r.canonical_url, r.content_hash) for r in batch.collect()}


def test_stream_links_and_activity(spark, tmp_path):
    rows = [("https://h.org/a", "2024-01-01 00:00:00", "<a href='/x'>1</a><a href='/y'>2</a>"), ("https://h.org/b", "2024-01-01 00:01:00", "<a href='/x'>1</a>")]
    df = spark.createDataFrame(rows, "url string, at string, html string").select("url", F.to_timestamp("at").alias("captured_at"), "html")
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream.new_links(s).writeStream.format("memory").queryName("links_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.url for r in spark.table("links_out").collect()) == ["https://h.org/x", "https://h.org/y"]
    batch = spark.createDataFrame([("s1", 1, "user", "t"), ("s1", 2, "assistant", "t"), ("s2", 1, "user", "t")], "session_id string, created_at int, role string, text string")
    known = spark.createDataFrame([("s2",)], "session_id string")
    got = {(r.session_id, r.created_at): r.is_first_turn for r in sessions.flag_first_turns(batch, known).collect()}
    assert got == {("s1", 1): True, ("s1", 2): False, ("s2", 1): False}


def test_stale_jobs(spark, tmp_path):
    spark.createDataFrame([("j1", "running"), ("j2", "completed")], "job_id string, status string").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("job_id string, status string").parquet(str(tmp_path / "in"))
    q = sessions.stale_jobs(s, 500).writeStream.format("memory").queryName("stale_out").option(
        "checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(60):
            time.sleep(0.5)
            if spark.table("stale_out").count():
                break
        assert [r.job_id for r in spark.table("stale_out").collect()] == ["j1"]
    finally:
        q.stop()


def test_profile_rows_and_gates(spark):
    df = spark.createDataFrame([("https://h.org/carreras/x", "Docentes", "plan", "career_canonical", "Medicina")],
                               "url string, title string, content string, page_type string, program_name string")
    assert {r.fact_key for r in facts.profile_fact_rows(df).collect()} == {"profile_docentes_page"}
    row = classify.program_page_gates(df).first()
    assert (row.is_canonical, row.is_program_page, row.is_fact_source, row.is_year_source, row.has_signals) == (True, True, True, True, False)
    assert R.RRF_C == 60


def test_reports_and_staging(spark, tmp_path):
    import os

    from foliant.plans import lineage

    rows = spark.createDataFrame([("https://h/a", 1, "blocked_host"), ("https://h/a", 2, "blocked_host"), ("https://h/b", 3, "invalid:too_short"),
                                  ("https://h/c", 4, "accepted")], "url string, position int, outcome string")
    lists = metrics.report_lists(rows)
    assert {(r.list, r.entry, r.times) for r in lists.collect()} == {
        ("blocked_by_host_filter", "https://h/a", 2), ("skipped_invalid_content", "https://h/b\ttoo_short", 1)}
    counters = metrics.crawl_counters(rows.withColumns({"job_id": F.lit(1), "priority": F.lit(True)}))
    sinks.write_report(lists, counters, str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report/lists")).count() == 2
    assert spark.read.json(str(tmp_path / "report/summary")).first().saved_docs == 1
    staged = lineage.materialize(rows, "kept")
    assert staged.count() == 4
    folder = staged.inputFiles()[0].split("file://")[-1].rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    lineage.clear_staged(spark)
    assert not os.path.isdir(folder)
    got = spark.range(1).select(F.round(dense.cosine(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0), F.lit(1.0))), 6).alias("c"),
                                dense.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("z")).first()
    assert (got.c, got.z) == (0.8, None)
