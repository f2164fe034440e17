"""Vector, lexical and hybrid retrieval over the embedding, document and benchmark tables.

Queries for the vector side are the label centroids (all vectors contribute);
text queries are the benchmark items, each bound to one source.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import roles as R
from catalog.registry import query
from catalog.roles import DOCS, NL
from foliant import rules as RULES
from foliant.functions.answers import history_line
from foliant.operators import conversation, dense, evaluate, fusion, lexical, lexical_index, scorers, vector_index
from foliant.plans import retrieval
from foliant.plans.lineage import new_dir
from foliant.schemas import read_table

# --- roles ------------------------------------------------------------------------


def vector_chunks(spark, d):
    v = read_table(spark, d, "embeddings")
    part = F.when(F.col("vec_id") % 2 == 0, F.lit("/carreras/")).otherwise(F.lit("/doc/"))
    return v.select(
        F.col("vec_id").alias("chunk_key"), F.concat(F.lit("src"), (F.col("vec_id") % 5).cast("string")).alias("source_id"),
        F.floor(F.col("vec_id") / 10).alias("doc_id"), (F.col("vec_id") % 10).alias("chunk_id"),
        F.concat(F.lit("https://x.example.org"), part, F.col("vec_id").cast("string")).alias("url"), "embedding", "label")


def centroids(spark, d):
    """(label, embedding): mean vector per label; one row per label and dimension moves."""
    v = read_table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = v.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m")))["m"].alias("embedding"))


def centroid_queries(spark, d):
    return centroids(spark, d).select(
        F.col("label").cast("bigint").alias("query_id"),
        F.concat(F.lit("src"), (F.col("label") % 5).cast("string")).alias("source_id"), "embedding")


def text_chunks(spark, d, vectors: bool = True):
    """Documents as chunks; ten neighbouring ids form one parent document."""
    c = R.documents(spark, d).select(
        F.col("doc_id").alias("chunk_key"), "source_id", "url", "title", "text", "fetched_at",
        F.floor(F.col("doc_id") / 10).alias("doc_id"), (F.col("doc_id") % 10).alias("chunk_id"))
    if not vectors:
        return c
    v = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_key"), "embedding")
    return c.join(v, "chunk_key", "left")


def text_queries(spark, d, vectors: bool = True):
    q = read_table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source_id"),
        "text", (F.col("item_id") % 10).cast("int").alias("label"))
    if not vectors:
        return q.drop("label")
    return q.join(centroids(spark, d), "label", "left").drop("label")


TOKEN = "[^\\p{L}0-9]+"
WORD_LIST = f"list_filter(string_split_regex(lower(%s), '{TOKEN}'), lambda x: x <> '')"

VEC = """vc AS (SELECT vec_id AS chunk_key, 'src' || (vec_id % 5) AS source_id, vec_id // 10 AS doc_id, vec_id % 10 AS chunk_id,
         'https://x.example.org' || CASE WHEN vec_id % 2 = 0 THEN '/carreras/' ELSE '/doc/' END || vec_id AS url, embedding, label FROM embeddings),
ce AS (SELECT label, list(m ORDER BY i) AS embedding FROM (SELECT label, i, avg(x::DOUBLE) AS m FROM
         (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
cq AS (SELECT label::BIGINT AS query_id, 'src' || (label % 5) AS source_id, embedding FROM ce)"""


def sql_dense(name: str, chunks: str, queries: str, k: int, scope: bool = True, where: str = "true") -> str:
    on = "c.source_id = q.source_id" if scope else "true"
    return f"""{name} AS (SELECT query_id, chunk_key, similarity, rank FROM (
  SELECT query_id, chunk_key, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_key) AS rank FROM (
    SELECT q.query_id, c.chunk_key, round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), {dense.DIGITS}) AS similarity
    FROM {chunks} c JOIN {queries} q ON {on} WHERE c.embedding IS NOT NULL AND {where})) WHERE rank <= {k})"""


SCOPED = f"regexp_matches(c.url, '{RULES.SCOPED_URL_PATTERN}')"


def shown(df):
    return df.withColumn("similarity", F.round("similarity", 6))


@query("dense_topk", f"WITH {VEC}, {sql_dense('t', 'vc', 'cq', RULES.TOP_K_DENSE)} SELECT query_id, chunk_key, round(similarity, 6) AS similarity, rank FROM t")
def dense_topk(spark, d):
    return shown(dense.dense_topk(vector_chunks(spark, d), centroid_queries(spark, d)))


@query("dense_scoped", f"WITH {VEC}, {sql_dense('t', 'vc', 'cq', RULES.TOP_K_SCOPED, where=SCOPED)} SELECT query_id, chunk_key, round(similarity, 6) AS similarity, rank FROM t")
def dense_scoped(spark, d):
    """The list over part of the corpus, from the scan that also gives the full one."""
    lists = dense.dense_lists(vector_chunks(spark, d), centroid_queries(spark, d), subset=F.col("url").rlike(RULES.SCOPED_URL_PATTERN))
    return shown(lists.filter("list_no = 1").drop("list_no"))


@query("dense_parts_topk", f"WITH {VEC}, {sql_dense('t', 'vc', 'cq', RULES.TOP_K_DENSE)} SELECT query_id, chunk_key, round(similarity, 6) AS similarity, rank FROM t")
def dense_parts_topk(spark, d):
    """The path for query batches above the broadcast bound: a grid of blocks."""
    return shown(dense.dense_topk(vector_chunks(spark, d), centroid_queries(spark, d), broadcast_bytes=0))


CELLS, PROBES, LLOYD = 16, 12, 3


def sql_cells() -> str:
    """The rounds of the cell centroids, started from the rows with the smallest digests, and the cell of every vector."""
    def placed(name: str, centers: str) -> str:
        return (f"{name} AS MATERIALIZED (SELECT k, u, (min({{'d': round(list_dot_product(m, m) - 2 * list_dot_product(u, m), {dense.DIGITS}), 'c': c}})).c AS c "
                f"FROM un, {centers} GROUP BY k, u)")

    steps = []
    for i in range(LLOYD):
        steps.append(placed(f"p{i}", f"m{i}"))
        steps.append(f"""m{i + 1} AS MATERIALIZED (SELECT m{i}.c, coalesce(n.m, m{i}.m) AS m FROM m{i} LEFT JOIN (SELECT c, list(x ORDER BY i) AS m FROM (
          SELECT c, i, avg(x) AS x FROM (SELECT c, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM p{i}) GROUP BY c, i) GROUP BY c) n ON n.c = m{i}.c)""")
    return f"""nv AS MATERIALIZED (SELECT vec_id AS k, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS len FROM embeddings),
    un AS MATERIALIZED (SELECT k, list_transform(v, lambda x: x / len) AS u FROM nv WHERE len > 0),
    m0 AS MATERIALIZED (SELECT c, u AS m FROM (SELECT u, row_number() OVER (ORDER BY md5(k::VARCHAR)) - 1 AS c FROM un) WHERE c < {CELLS}),
    {", ".join(steps)}, {placed("cell", f"m{LLOYD}")}"""


def vector_store(spark, d):
    """The stored index of all vectors, with parameters that the twin repeats."""
    chunks = vector_chunks(spark, d)
    return vector_index.build(chunks, new_dir(spark, "vectors"), cells=CELLS, groups=32, rounds=LLOYD)


@query("vector_cells", f"WITH {sql_cells()} SELECT k AS chunk_key, c::INTEGER AS cell FROM cell")
def vector_cells(spark, d):
    return vector_index.stored(spark, vector_store(spark, d)).select(F.col("key").alias("chunk_key"), "cell")


@query("ann_topk", f"""WITH {VEC}, {sql_cells()},
    qu AS (SELECT query_id, list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding))) AS q, embedding FROM cq),
    near AS (SELECT query_id, c FROM (SELECT query_id, c, row_number() OVER (PARTITION BY query_id ORDER BY
        round(list_dot_product(m, m) - 2 * list_dot_product(q, m), {dense.DIGITS}), c) AS r FROM qu, m{LLOYD}) WHERE r <= {PROBES}),
    s AS (SELECT query_id, k AS chunk_key, round(list_cosine_similarity(e.embedding::DOUBLE[], qu.embedding), {dense.DIGITS}) AS similarity
          FROM near JOIN cell USING (c) JOIN qu USING (query_id) JOIN embeddings e ON e.vec_id = k)
    SELECT query_id, chunk_key, round(similarity, 6) AS similarity, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_key) AS rank FROM s) WHERE rank <= {RULES.TOP_K_DENSE}""")
def ann_topk(spark, d):
    """The nearest vectors in 12 of 16 cells: chosen by codes, ranked exactly."""
    index = vector_store(spark, d)
    return shown(vector_index.search(spark, index, centroid_queries(spark, d), probes=PROBES, rerank=240))


LISTS2 = f"{VEC}, {sql_dense('l0', 'vc', 'cq', 40, False)}, {sql_dense('l1', 'vc', 'cq', 18, False, SCOPED)}"


def sql_fuse(lists: list[str]) -> str:
    union = " UNION ALL ".join(f"SELECT query_id, chunk_key, rank, {n} AS list_no FROM {name}" for n, name in enumerate(lists))
    parts = " + ".join(f"coalesce(1.0::DOUBLE / ({RULES.RRF_C} + min(rank) FILTER (WHERE list_no = {n})), 0.0)" for n in range(len(lists)))
    return f"""un AS ({union}),
fu AS (SELECT query_id, chunk_key, {parts} AS score, min({{'l': list_no, 'r': rank}}) AS fs FROM un GROUP BY 1, 2),
fused AS (SELECT * FROM (SELECT query_id, chunk_key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fs) AS fused_rank FROM fu)
          WHERE fused_rank <= {RULES.RRF_TOP})"""


def two_lists(spark, d):
    c, q = vector_chunks(spark, d), centroid_queries(spark, d)
    lists = dense.dense_lists(c, q, 40, F.col("url").rlike(RULES.SCOPED_URL_PATTERN), 18, scope=None)
    return [lists.filter(F.col("list_no") == n).drop("list_no") for n in (0, 1)]


@query("rrf_fuse", f"WITH {LISTS2}, {sql_fuse(['l0', 'l1'])} SELECT query_id, chunk_key, round(score, 9) AS score, fused_rank FROM fused")
def rrf_fuse(spark, d):
    return fusion.rrf_fuse(fusion.stack_lists(two_lists(spark, d)), 2).withColumn("score", F.round("score", 9))


@query("neighbors", f"""
WITH {LISTS2}, s AS (SELECT query_id, doc_id, chunk_id FROM l1 JOIN vc USING (chunk_key) WHERE rank <= {RULES.NEIGHBOR_TOP})
SELECT DISTINCT s.query_id, vc.doc_id, vc.chunk_id, vc.chunk_key FROM vc JOIN s ON s.doc_id = vc.doc_id AND abs(vc.chunk_id - s.chunk_id) <= {RULES.NEIGHBOR_RADIUS}""")
def neighbors(spark, d):
    c = vector_chunks(spark, d)
    seeds = two_lists(spark, d)[1].filter(F.col("rank") <= RULES.NEIGHBOR_TOP).join(c, "chunk_key").select("query_id", "doc_id", "chunk_id")
    return fusion.expand_neighbors(seeds, c.select("chunk_key", "doc_id", "chunk_id")).select("query_id", "doc_id", "chunk_id", "chunk_key")


@query("context_tiers", f"""
WITH {LISTS2}, u AS (SELECT query_id, chunk_key, 1 AS tier, rank AS pos FROM l1 WHERE rank <= 6 UNION ALL SELECT query_id, chunk_key, 2, rank FROM l0 WHERE rank <= 14),
m AS (SELECT query_id, chunk_key, min({{'t': tier, 'p': pos}}) AS w FROM u GROUP BY 1, 2)
SELECT query_id, chunk_key, w.t::BIGINT AS tier, w.p::BIGINT AS pos, row_number() OVER (PARTITION BY query_id ORDER BY w, chunk_key) AS context_rank FROM m""")
def context_tiers(spark, d):
    l0, l1 = two_lists(spark, d)
    pos = F.col("rank").alias("pos")
    return fusion.merge_tiers([
        l1.filter(F.col("rank") <= RULES.SCOPED_KEEP).select("query_id", "chunk_key", pos),
        l0.filter(F.col("rank") <= RULES.FINAL_TOP).select("query_id", "chunk_key", pos)])


@query("retrieval_at_k", f"""
WITH {LISTS2}, h AS (SELECT l0.*, label = query_id AS rel FROM l0 JOIN vc USING (chunk_key) WHERE rank <= 10)
SELECT query_id, count(*) FILTER (WHERE rel) AS hits, round(count(*) FILTER (WHERE rel) / 10, 6) AS precision_at_k,
       min(rank) FILTER (WHERE rel) AS first_hit_rank, round(coalesce(1.0 / min(rank) FILTER (WHERE rel), 0.0), 6) AS reciprocal_rank FROM h GROUP BY 1""")
def retrieval_at_k(spark, d):
    rel = vector_chunks(spark, d).select(F.col("label").cast("bigint").alias("query_id"), "chunk_key")
    return evaluate.retrieval_at_k(two_lists(spark, d)[0], rel, "chunk_key", 10)


# --- lexical ------------------------------------------------------------------------

LEX = f"""{DOCS},
ch AS (SELECT doc_id AS chunk_key, source_id, url, title, text, title || ' ' || text AS words, fetched_at, doc_id // 10 AS doc_id, doc_id % 10 AS chunk_id FROM docs),
qs AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS source_id, text, item_id % 10 AS label FROM benchmark),
cw AS (SELECT chunk_key, source_id, {WORD_LIST % 'words'} AS ws FROM ch),
ct AS (SELECT chunk_key, source_id, len(ws) AS doc_len, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS pos FROM cw),
qe AS (SELECT query_id, es, unnest(es) AS e, generate_subscripts(es, 1) AS i FROM
  (SELECT query_id, list_filter(regexp_extract_all(text, '{lexical.ITEM}', 1), lambda x: x <> '') AS es FROM qs)),
qi AS (SELECT query_id, len(list_filter(es[1:i], lambda x: lower(x) = 'or')) AS branch, i AS item, starts_with(e, '-') AS negative, {WORD_LIST % 'e'} AS terms
       FROM qe WHERE lower(e) <> 'or'),
qt AS (SELECT query_id, branch, item, negative, len(terms) AS n_terms, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS k FROM qi WHERE len(terms) > 0),
st AS (SELECT count(*)::DOUBLE AS n_docs, avg(len(ws)) AS avg_len FROM cw),
po AS (SELECT term, chunk_key, source_id, doc_len, count(*) AS tf FROM ct WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
sc AS (SELECT q.query_id, p.chunk_key, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * doc_len / avg_len))) AS bm25
  FROM (SELECT DISTINCT query_id, term FROM qt WHERE NOT negative) q JOIN qs USING (query_id) JOIN po p ON p.term = q.term AND p.source_id = qs.source_id
  JOIN df ON df.term = q.term, st GROUP BY 1, 2)"""
MATCH = """ht AS (SELECT DISTINCT qt.query_id, branch, item, negative, n_terms, k, chunk_key, CASE WHEN n_terms = 1 THEN 0 ELSE pos - k END AS start
  FROM qt JOIN qs USING (query_id) JOIN ct ON ct.term = qt.term AND ct.source_id = qs.source_id),
wh AS (SELECT query_id, branch, item, negative, chunk_key FROM ht GROUP BY query_id, branch, item, negative, chunk_key, n_terms, start HAVING count(DISTINCT k) = n_terms),
nd AS (SELECT query_id, branch, count(DISTINCT item) FILTER (WHERE NOT negative) AS n_need FROM qt GROUP BY 1, 2),
ma AS (SELECT DISTINCT query_id, chunk_key FROM (SELECT query_id, branch, chunk_key, count(DISTINCT item) FILTER (WHERE NOT negative) AS n_hit, bool_or(negative) AS bad
  FROM wh GROUP BY 1, 2, 3) JOIN nd USING (query_id, branch) WHERE NOT bad AND n_hit = n_need AND n_need > 0)"""
LEXTOP = """SELECT query_id, chunk_key, round(bm25, 6) AS bm25, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, chunk_key) AS rank FROM {src}) WHERE rank <= 40"""


def words():
    return F.concat_ws(" ", F.col("title"), F.col("text"))


@query("bm25_topk", f"WITH {LEX} {LEXTOP.format(src='sc')}")
def bm25_topk(spark, d):
    return lexical.lexical_topk(text_chunks(spark, d, False), text_queries(spark, d, False), words(), match="any")


@query("websearch_match", f"WITH {LEX}, {MATCH} {LEXTOP.format(src='(SELECT sc.* FROM sc JOIN ma USING (query_id, chunk_key))')}")
def websearch_match(spark, d):
    return lexical.lexical_topk(text_chunks(spark, d, False), text_queries(spark, d, False), words(), match="web")


def lexical_store(spark, d, segment_chunks=64):
    return lexical_index.build(text_chunks(spark, d, False), words(), new_dir(spark, "lexical"), segment_chunks=segment_chunks)


@query("bm25_indexed", f"WITH {LEX} {LEXTOP.format(src='sc')}")
def bm25_indexed(spark, d):
    """The same list as ``bm25_topk``, from the stored index, opening only segments that may hold one of the best."""
    return lexical_index.topk(spark, lexical_store(spark, d), text_queries(spark, d, False), match="any")


@query("websearch_indexed", f"WITH {LEX}, {MATCH} {LEXTOP.format(src='(SELECT sc.* FROM sc JOIN ma USING (query_id, chunk_key))')}")
def websearch_indexed(spark, d):
    return lexical_index.topk(spark, lexical_store(spark, d), text_queries(spark, d, False))


#: Web-style questions made of the words of every tenth document: a phrase, an alternative, and a word that must be absent.
ASKED = """qs AS (SELECT doc_id AS query_id, source_id, '"' || ws[2] || ' ' || ws[3] || '" ' || ws[6] || ' or ' || ws[8] || ' ' || ws[9] || ' -' || ws[12] AS text
  FROM (SELECT doc_id, source_id, {words} AS ws FROM docs WHERE doc_id % 10 = 0) WHERE len(ws) >= 12)""".format(words=WORD_LIST % "text")
LEX_WEB = LEX.replace(LEX[LEX.index("qs AS ("):LEX.index("cw AS (")], ASKED + ",\n")


def web_questions(spark, d):
    w = F.filter(F.split(F.lower("text"), r"[^\p{L}0-9]+"), lambda x: x != "")
    q = R.documents(spark, d).filter("doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), "source_id", w.alias("ws")).filter(F.size("ws") >= 12)
    at = lambda i: F.col("ws")[i - 1]
    text = F.concat(F.lit('"'), at(2), F.lit(" "), at(3), F.lit('" '), at(6), F.lit(" or "), at(8), F.lit(" "), at(9), F.lit(" -"), at(12))
    return q.select("query_id", "source_id", text.alias("text"))


@query("web_operators", f"WITH {LEX_WEB}, {MATCH} {LEXTOP.format(src='(SELECT sc.* FROM sc JOIN ma USING (query_id, chunk_key))')}")
def web_operators(spark, d):
    """Phrases, alternatives and negated words, from the stored index."""
    return lexical_index.topk(spark, lexical_store(spark, d), web_questions(spark, d))


# --- hybrid ---------------------------------------------------------------------------

HYBRID = f"""{LEX}, {MATCH}, {VEC},
hc AS (SELECT ch.*, e.embedding FROM ch LEFT JOIN embeddings e ON e.vec_id = ch.chunk_key),
hq AS (SELECT qs.query_id, qs.source_id, qs.text, ce.embedding FROM qs LEFT JOIN ce USING (label)),
{sql_dense('h0', 'hc', 'hq', 40)}, h1 AS ({LEXTOP.format(src='(SELECT sc.* FROM sc JOIN ma USING (query_id, chunk_key))')}),
{sql_dense('h2', 'hc', 'hq', 18, where=SCOPED)},
{sql_fuse(['h0', 'h1', 'h2'])},
ca AS (SELECT f.query_id, f.chunk_key, fused_rank, list_intersect(list_distinct({WORD_LIST % 'q.text'}), list_distinct({WORD_LIST % 'c.text'})) AS shared
       FROM fused f JOIN hc c USING (chunk_key) JOIN hq q ON q.query_id = f.query_id WHERE trim(c.text) <> ''),
cx AS (SELECT query_id, chunk_key, unnest(shared) AS term FROM ca),
pw AS (SELECT x.query_id, term, ln(1 + pool / x.df) AS w FROM (SELECT query_id, term, count(*) AS df FROM cx GROUP BY 1, 2) x
       JOIN (SELECT query_id, count(*) AS pool FROM ca GROUP BY 1) p ON p.query_id = x.query_id),
rs AS (SELECT cx.query_id, cx.chunk_key, sum(w) AS s FROM cx JOIN pw ON pw.query_id = cx.query_id AND pw.term = cx.term GROUP BY 1, 2),
rr AS (SELECT * FROM (SELECT ca.query_id, ca.chunk_key, round(coalesce(s, 0.0), 6) AS score,
         row_number() OVER (PARTITION BY ca.query_id ORDER BY round(coalesce(s, 0.0), 6) DESC, fused_rank) AS rerank_rank
       FROM ca LEFT JOIN rs ON rs.query_id = ca.query_id AND rs.chunk_key = ca.chunk_key) WHERE rerank_rank <= {RULES.FINAL_TOP})"""


@query("hybrid_topk", f"WITH {HYBRID} SELECT query_id, chunk_key, score, rerank_rank FROM rr")
def hybrid_topk(spark, d):
    return retrieval.hybrid_topk(text_chunks(spark, d), text_queries(spark, d))


@query("rerank_topk", f"""
WITH {LEX}, ma AS (SELECT query_id, chunk_key, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, chunk_key) AS fused_rank FROM sc),
ca AS (SELECT m.query_id, m.chunk_key, fused_rank, list_intersect(list_distinct({WORD_LIST % 'q.text'}), list_distinct({WORD_LIST % 'c.text'})) AS shared
       FROM ma m JOIN ch c USING (chunk_key) JOIN qs q ON q.query_id = m.query_id WHERE fused_rank <= 40),
cx AS (SELECT query_id, chunk_key, unnest(shared) AS term FROM ca),
pw AS (SELECT x.query_id, term, ln(1 + pool / x.df) AS w FROM (SELECT query_id, term, count(*) AS df FROM cx GROUP BY 1, 2) x
       JOIN (SELECT query_id, count(*) AS pool FROM ca GROUP BY 1) p ON p.query_id = x.query_id),
rs AS (SELECT cx.query_id, cx.chunk_key, sum(w) AS s FROM cx JOIN pw ON pw.query_id = cx.query_id AND pw.term = cx.term GROUP BY 1, 2)
SELECT * FROM (SELECT ca.query_id, ca.chunk_key, round(coalesce(s, 0.0), 6) AS score,
   row_number() OVER (PARTITION BY ca.query_id ORDER BY round(coalesce(s, 0.0), 6) DESC, fused_rank) AS rerank_rank
   FROM ca LEFT JOIN rs ON rs.query_id = ca.query_id AND rs.chunk_key = ca.chunk_key) WHERE rerank_rank <= {RULES.FINAL_TOP}""")
def rerank_topk(spark, d):
    c, q = text_chunks(spark, d, False), text_queries(spark, d, False)
    top = lexical.lexical_topk(c, q, words(), match="any").select("query_id", "chunk_key", F.col("rank").alias("fused_rank"))
    return retrieval.rerank_fused(c, q, top)


PACK = f"""{HYBRID},
sd AS (SELECT DISTINCT rr.query_id, hc.doc_id, hc.chunk_id FROM rr JOIN hc USING (chunk_key) WHERE rerank_rank <= {RULES.NEIGHBOR_TOP} AND contains(lower(hc.url), '/carreras/')),
ne AS (SELECT DISTINCT sd.query_id, hc.chunk_key, hc.chunk_id FROM hc JOIN sd ON sd.doc_id = hc.doc_id AND abs(hc.chunk_id - sd.chunk_id) <= {RULES.NEIGHBOR_RADIUS}),
ti AS (SELECT query_id, chunk_key, 1 AS tier, rank AS pos FROM h2 WHERE rank <= {RULES.SCOPED_KEEP}
       UNION ALL SELECT query_id, chunk_key, 2, rerank_rank FROM rr UNION ALL SELECT query_id, chunk_key, 3, chunk_id FROM ne),
tm AS (SELECT query_id, chunk_key, min({{'t': tier, 'p': pos}}) AS w FROM ti GROUP BY 1, 2),
bl AS (SELECT query_id, chunk_key, w.t::BIGINT AS tier, row_number() OVER (PARTITION BY query_id ORDER BY w, chunk_key) AS context_rank,
         'URL: ' || url || '{NL[1:-1]}Titulo: ' || trim(title, {R.BL}) || '{NL[1:-1]}FetchedAt: ' || strftime(fetched_at, '%Y-%m-%d %H:%M:%S') || '{NL[1:-1]}Contenido: ' || trim(text, {R.BL}) AS b
       FROM tm JOIN hc USING (chunk_key)),
pk AS (SELECT * FROM (SELECT query_id, chunk_key, tier, context_rank, trim(b, {R.BL}) AS block,
         sum(length(trim(b, {R.BL}))) OVER (PARTITION BY query_id ORDER BY context_rank)::BIGINT AS used_chars FROM bl) WHERE used_chars <= {RULES.CONTEXT_CHARS})"""


@query("context_pack", f"WITH {PACK} SELECT query_id, chunk_key, tier, context_rank, used_chars, md5(block) AS block_md5 FROM pk")
def context_pack(spark, d):
    return retrieval.build_context(text_chunks(spark, d), text_queries(spark, d)).select(
        "query_id", "chunk_key", "tier", "context_rank", "used_chars", F.md5(F.col("block").cast("binary")).alias("block_md5"))


SYSTEM = "Responde solo con el contexto."


@query("prompt_build", f"""
WITH {LEX}, bt AS (SELECT query_id, chunk_key, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, chunk_key) AS rank FROM sc),
bl AS (SELECT query_id, rank, trim(text, {R.BL}) AS b FROM bt JOIN ch USING (chunk_key) WHERE rank <= 40 AND trim(text, {R.BL}) <> ''),
pk AS (SELECT * FROM (SELECT *, sum(length(b)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM bl) WHERE used <= {RULES.CONTEXT_CHARS}),
cx AS (SELECT query_id, string_agg(b, '\n\n---\n\n' ORDER BY rank) AS context FROM pk GROUP BY 1),
hl AS (SELECT conv_id AS query_id, string_agg(upper(role) || ': ' || text, '\n' ORDER BY turn) AS history FROM conversations GROUP BY 1),
pt AS (SELECT qs.query_id, context, '{SYSTEM}\n\nHistorial reciente:\n' || coalesce(history, '') || '\n\nContexto recuperado:\n' AS pre,
         '\n\nPregunta del usuario:\n' || qs.text AS post FROM qs LEFT JOIN cx USING (query_id) LEFT JOIN hl USING (query_id)),
bu AS (SELECT *, greatest({RULES.PROMPT_CHARS} - length(pre) - length(post), {RULES.PROMPT_MIN_CONTEXT}) AS budget FROM pt)
SELECT query_id, length(p) AS prompt_chars, md5(p) AS prompt_md5 FROM (SELECT query_id, pre || CASE WHEN length(context) <= budget THEN context
   ELSE rtrim(substring(context, 1, budget - 1), {R.BL}) || '…' END || post AS p FROM bu)""")
def prompt_build(spark, d):
    c, q = text_chunks(spark, d, False), text_queries(spark, d, False)
    top = lexical.lexical_topk(c, q, words(), match="any")
    blocks = c.select("chunk_key", F.col("text").alias("block")).join(top.withColumnRenamed("rank", "context_rank"), "chunk_key")
    m = read_table(spark, d, "conversations").select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("position"), history_line("role", "text").alias("line"))
    hist = conversation.history_arrays(m, ["query_id"]).select("query_id", F.array_join("history", "\n").alias("history_text"))
    out = retrieval.build_prompts(q, fusion.pack_context(blocks), hist, SYSTEM)
    return out.select("query_id", F.length("prompt").cast("bigint").alias("prompt_chars"), F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


@query("composite_rank", f"""
WITH {DOCS}, a AS (SELECT doc_id, url, doc_id % 500 AS age_days, length(text) / 1000.0 AS retrieval FROM docs)
SELECT doc_id, CASE WHEN contains(url, '/carreras/') THEN 40 ELSE 0 END::BIGINT AS authority_bonus,
  CASE WHEN age_days <= 30 THEN 15 WHEN age_days <= 90 THEN 10 WHEN age_days <= 180 THEN 5 WHEN age_days > 365 THEN -8 ELSE 0 END::BIGINT AS freshness_bonus,
  round(retrieval + CASE WHEN contains(url, '/carreras/') THEN 40 ELSE 0 END
    + CASE WHEN age_days <= 30 THEN 15 WHEN age_days <= 90 THEN 10 WHEN age_days <= 180 THEN 5 WHEN age_days > 365 THEN -8 ELSE 0 END, 6)::DOUBLE AS final_score FROM a""")
def composite_rank(spark, d):
    rows = R.documents(spark, d).select("doc_id", "url", (F.col("doc_id") % 500).alias("age_days"), (F.length("text") / 1000.0).alias("retrieval_score"))
    return fusion.composite_rank(rows).select("doc_id", "authority_bonus", "freshness_bonus", F.round("final_score", 6).alias("final_score"))


@query("answer_check")
def answer_check(spark, d):
    """Default answer and groundedness steps over the retrieved blocks of every question."""
    c, q = text_chunks(spark, d, False), text_queries(spark, d, False)
    top = lexical.lexical_topk(c, q, words(), match="any")
    packed = fusion.pack_context(c.select("chunk_key", F.col("text").alias("block")).join(top.withColumnRenamed("rank", "context_rank"), "chunk_key"))
    ordered = F.sort_array(F.collect_list(F.struct("context_rank", "block")))["block"]
    ctx = packed.groupBy("query_id").agg(ordered.alias("context"))
    rows = q.select("query_id", F.col("text").alias("query")).join(ctx, "query_id")
    return scorers.ngram_verifier(scorers.extractive_answers(rows)).select("query_id", "response", "groundedness")


@query("hashed_vectors", f"SELECT doc_id, 64 AS dims, CASE WHEN len({WORD_LIST % 'text'}) > 0 THEN 1.0 ELSE 0.0 END AS norm2 FROM documents")
def hashed_vectors(spark, d):
    v = scorers.hashed_embeddings(R.documents(spark, d).select("doc_id", "text"), dims=64)
    return v.select("doc_id", F.size("embedding").alias("dims"), F.round(F.aggregate(
        "embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 3).alias("norm2"))
