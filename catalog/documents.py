"""Text cleaning, duplicates, store maintenance, chunks and facts over the document table."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import roles as R
from catalog.registry import query
from catalog.roles import BL, DOCS
from foliant import rules as RULES
from foliant.functions import chunking as C
from foliant.functions.text import LINE_BREAK, clip_at_space, let
from foliant.operators import access, chunks, cleaning, facts, ingest, links, metrics
from foliant.plans.once import explode_once
from foliant.schemas import read_table

LABELS = ("de.", "the.", "et.")
PRESS = "the "


@query("clean_lines", f"""
WITH l AS (SELECT doc_id, unnest(xs) AS line, generate_subscripts(xs, 1) AS pos
           FROM (SELECT doc_id, list_transform(string_split_regex(text, '{LINE_BREAK}'), lambda x: trim(x, {BL})) AS xs FROM documents)),
n AS (SELECT *, lower(line) AS k, row_number() OVER (PARTITION BY doc_id, lower(line) ORDER BY pos) AS seen
      FROM l WHERE line <> '' AND NOT regexp_matches(line, '{cleaning.IMAGE_ONLY}')),
kept AS (SELECT * FROM n WHERE k IN {LABELS} OR seen <= CASE WHEN contains(k, '{PRESS}') THEN 1 ELSE 2 END),
j AS (SELECT doc_id, string_agg(line, '\n' ORDER BY pos) AS t FROM kept GROUP BY doc_id)
SELECT d.doc_id, length(coalesce(t, '')) AS n_chars, md5(coalesce(t, '')) AS clean_md5 FROM documents d LEFT JOIN j USING (doc_id)""")
def clean_lines(spark, d):
    t = cleaning.clean_lines("text", 2, LABELS, PRESS)
    return R.text_table(spark, d, "documents").select("doc_id", t.alias("t")).select(
        "doc_id", F.length("t").cast("bigint").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("clean_md5"))


@query("doc_lines_clean", f"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '{LINE_BREAK}'), lambda x: trim(x, {BL})),
                  lambda x: NOT (regexp_matches(x, '{cleaning.PAGE_NUMBER}') OR regexp_matches(x, '{cleaning.RULER}')
                                 OR regexp_matches(x, '{cleaning.PAGE_OF}'))) AS xs FROM documents)
SELECT doc_id, length(t) AS n_chars, md5(t) AS clean_md5 FROM
 (SELECT doc_id, trim(array_to_string(list_filter(xs, lambda x, i: x <> '' OR i = 1 OR xs[i - 1] <> ''), '\n'), {BL}) AS t FROM l)""")
def doc_lines_clean(spark, d):
    return R.text_table(spark, d, "documents").select("doc_id", cleaning.clean_document_lines("text").alias("t")).select(
        "doc_id", F.length("t").cast("bigint").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("clean_md5"))


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash, sha1(text) AS short_hash FROM documents")
def content_hash(spark, d):
    return read_table(spark, d, "documents").select(
        "doc_id", cleaning.content_hash("text").alias("content_hash"), F.sha1(F.col("text").cast("binary")).alias("short_hash"))


STORED = f"""{DOCS}, inc AS (SELECT doc_id, source_id, url AS canonical_url, sha256(text) AS content_hash FROM docs),
stored AS (SELECT doc_id, source_id, canonical_url, CASE WHEN quality = 1 THEN content_hash ELSE sha256(content_hash) END AS content_hash,
                  toxic::BIGINT AS n_chunks, quality FROM inc JOIN labels USING (doc_id))"""


def incoming(spark, d):
    return R.documents(spark, d).select(
        "doc_id", "source_id", F.col("url").alias("canonical_url"), cleaning.content_hash("text").alias("content_hash"))


def stored(spark, d):
    """Labelled documents as the store: low quality means an outdated hash, not toxic means no chunks yet."""
    lab = read_table(spark, d, "labels")
    return incoming(spark, d).join(lab, "doc_id").select(
        "doc_id", "source_id", "canonical_url",
        F.when(F.col("quality") == 1, F.col("content_hash")).otherwise(F.sha2(F.col("content_hash"), 256)).alias("content_hash"),
        F.col("toxic").cast("bigint").alias("n_chunks"), "quality")


@query("dedup_decision", f"""
WITH {STORED},
w AS (SELECT source_id, content_hash, min(doc_id) AS win_id FROM inc GROUP BY 1, 2),
win AS (SELECT w.*, inc.canonical_url AS win_url FROM w JOIN inc ON inc.doc_id = w.win_id),
r AS (SELECT i.*, u.content_hash AS old_hash, coalesce(u.n_chunks, 0) AS n_chunks, win_id, win_url,
        (SELECT min(s.canonical_url) FROM stored s WHERE s.source_id = i.source_id AND s.content_hash = i.content_hash
           AND s.canonical_url <> i.canonical_url) AS lo,
        (SELECT max(s.canonical_url) FROM stored s WHERE s.source_id = i.source_id AND s.content_hash = i.content_hash
           AND s.canonical_url <> i.canonical_url) AS hi
      FROM inc i LEFT JOIN stored u USING (canonical_url) JOIN win ON win.source_id = i.source_id AND win.content_hash = i.content_hash),
d AS (SELECT *, CASE WHEN old_hash = content_hash AND n_chunks > 0 THEN 'duplicate_content'
        WHEN lo IS NOT NULL THEN 'duplicate_content_other_url'
        WHEN win_id <> doc_id THEN 'duplicate_content_other_url'
        WHEN old_hash IS NOT NULL THEN 'updated' ELSE 'saved' END AS decision FROM r)
SELECT doc_id, source_id, content_hash, canonical_url, decision,
       CASE WHEN decision = 'duplicate_content_other_url' THEN coalesce(
         (SELECT CASE WHEN min(s.canonical_url) <> d.canonical_url THEN min(s.canonical_url) WHEN max(s.canonical_url) <> d.canonical_url THEN max(s.canonical_url) END
          FROM stored s WHERE s.source_id = d.source_id AND s.content_hash = d.content_hash), win_url) END AS same_as_url
FROM d""")
def dedup_decision(spark, d):
    old = stored(spark, d)
    return ingest.dedup_decisions(incoming(spark, d), old, old.select("canonical_url", "n_chunks"))


@query("doc_upsert", f"""
WITH {STORED},
s AS (SELECT doc_id + 1000000 AS doc_id, canonical_url, 'old' AS title, CASE WHEN quality = 1 THEN 'kept.pdf' ELSE '' END AS original_filename FROM stored),
i AS (SELECT doc_id, url || CASE WHEN lang = 'fr' THEN '?v=2' ELSE '' END AS canonical_url, title, CASE WHEN lang = 'en' THEN '' ELSE 'new.pdf' END AS original_filename FROM docs)
SELECT coalesce(s.doc_id, i.doc_id) AS doc_id, i.canonical_url, i.title,
       CASE WHEN i.original_filename = '' THEN s.original_filename ELSE i.original_filename END AS original_filename
FROM i LEFT JOIN s USING (canonical_url)
UNION ALL SELECT s.* FROM s WHERE canonical_url NOT IN (SELECT canonical_url FROM i)""")
def doc_upsert(spark, d):
    s = stored(spark, d).select(
        (F.col("doc_id") + 1000000).alias("doc_id"), "canonical_url", F.lit("old").alias("title"),
        F.when(F.col("quality") == 1, "kept.pdf").otherwise("").alias("original_filename"))
    i = R.documents(spark, d).select(
        "doc_id", F.concat("url", F.when(F.col("lang") == "fr", "?v=2").otherwise("")).alias("canonical_url"), "title",
        F.when(F.col("lang") == "en", "").otherwise("new.pdf").alias("original_filename"))
    return ingest.upsert_documents(s, i)


def sql_chunks(size: int, overlap: int) -> str:
    """SELECT doc_id, chunk_id, text FROM documents, fixed stride."""
    stride = size - overlap
    n = f"CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= {size} THEN 1 ELSE ceil((length(text) - {overlap}) / {stride}.0)::BIGINT END"
    return (f"SELECT doc_id, i AS chunk_id, substring(text, i * {stride} + 1, {size}) AS text "
            f"FROM (SELECT doc_id, text, unnest(generate_series(0, {n} - 1)) AS i FROM documents)")


@query("chunk_fixed", f"""
SELECT doc_id, chunk_id, length(text) AS n_chars, md5(text) AS text_md5 FROM ({sql_chunks(RULES.FIXED_CHUNK_SIZE, RULES.FIXED_CHUNK_OVERLAP)})""")
def chunk_fixed(spark, d):
    return chunks.split_fixed(R.text_table(spark, d, "documents")).select(
        "doc_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), F.length("text").cast("bigint").alias("n_chars"),
        F.md5(F.col("text").cast("binary")).alias("text_md5"))


BUDGET = RULES.CHUNK_SIZE - RULES.CHUNK_OVERLAP


@query("chunk_recursive", f"""
WITH r AS (SELECT doc_id, text, regexp_extract_all(text, '{C.boundary_pattern(BUDGET)}') AS rs FROM documents),
c AS (SELECT doc_id, CASE WHEN length(text) <= {RULES.CHUNK_SIZE} THEN [trim(text, {BL})] ELSE list_transform(rs, lambda x, i: trim(
        CASE WHEN i = 1 THEN '' WHEN length(rs[i - 1]) <= {RULES.CHUNK_OVERLAP} THEN rs[i - 1]
             ELSE regexp_extract(right(rs[i - 1], {RULES.CHUNK_OVERLAP}), '(?s)^\\S*\\s(.*)$', 1) END || x, {BL})) END AS cs FROM r),
k AS (SELECT doc_id, list_filter(cs, lambda x: x <> '') AS cs FROM c)
SELECT doc_id, i - 1 AS chunk_id, length(t) AS n_chars, md5(t) AS text_md5 FROM (SELECT doc_id, unnest(cs) AS t, generate_subscripts(cs, 1) AS i FROM k)""")
def chunk_recursive(spark, d):
    return chunks.split_documents(R.text_table(spark, d, "documents")).select(
        "doc_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), F.length("text").cast("bigint").alias("n_chars"),
        F.md5(F.col("text").cast("binary")).alias("text_md5"))


SIZE, OVER = RULES.FIXED_CHUNK_SIZE, RULES.FIXED_CHUNK_OVERLAP


@query("chunk_offsets", f"""
WITH RECURSIVE c AS ({sql_chunks(SIZE, OVER)}),
w(doc_id, chunk_id, off, cursor) AS (
  SELECT doc_id, 0::BIGINT, strpos(d.text, c.text) - 1, strpos(d.text, c.text) - 1 + length(c.text) FROM c JOIN documents d USING (doc_id) WHERE chunk_id = 0
  UNION ALL
  SELECT doc_id, chunk_id, CASE WHEN f > 0 THEN cursor + f - 1 ELSE cursor END, CASE WHEN f > 0 THEN cursor + f - 1 ELSE cursor END + n FROM (
    SELECT w.doc_id, c.chunk_id, w.cursor, length(c.text) AS n, strpos(substring(d.text, w.cursor + 1), c.text) AS f
    FROM w JOIN c ON c.doc_id = w.doc_id AND c.chunk_id = w.chunk_id + 1 JOIN documents d ON d.doc_id = w.doc_id))
SELECT doc_id, chunk_id, off AS chunk_offset FROM w""")
def chunk_offsets(spark, d):
    return chunks.with_offsets(R.text_table(spark, d, "documents"), C.fixed_chunks("text")).select(
        "doc_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), F.col("chunk_offset").cast("bigint").alias("chunk_offset"))


@query("doc_window", f"""
WITH c AS ({sql_chunks(SIZE, OVER)}),
w AS (SELECT c.doc_id, chunk_id, d.text AS doc, length(d.text) AS total, greatest(0, chunk_id * {SIZE - OVER} - 1000) AS s,
             least(length(d.text), chunk_id * {SIZE - OVER} + length(c.text) + 1000) AS e FROM c JOIN documents d USING (doc_id))
SELECT doc_id, chunk_id, md5(CASE WHEN total <= 8000 THEN doc ELSE substring(doc, 1, 2000) || '\n[…]\n' ||
   CASE WHEN s > 0 THEN '[…]\n' ELSE '' END || substring(doc, s + 1, e - s) || CASE WHEN e < total THEN '\n[…]' ELSE '' END END) AS window_md5 FROM w""")
def doc_window(spark, d):
    docs = R.text_table(spark, d, "documents")
    cut = C.fixed_chunks("text")

    def windows(cs):
        return F.transform(cs, lambda c, i: C.document_window("text", i * (SIZE - OVER), F.length(c)))

    w = explode_once(docs, ["doc_id"], let(cut, windows), "window", "chunk_id")
    return w.select("doc_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), F.md5(F.col("window").cast("binary")).alias("window_md5"))


@query("situated_text", f"""
WITH c AS ({sql_chunks(SIZE, OVER)}), x AS (SELECT c.*, string_split(d.text, '\n')[1] AS line FROM c JOIN documents d USING (doc_id)),
y AS (SELECT *, CASE WHEN length(line) <= 600 THEN line ELSE regexp_replace(substring(line, 1, 600), ' [^ ]*$', '') END AS ctx FROM x)
SELECT doc_id, chunk_id, length(ctx) AS context_chars, md5(CASE WHEN ctx = '' THEN text ELSE ctx || '\n\n' || text END) AS situated_md5 FROM y""")
def situated_text(spark, d):
    docs = read_table(spark, d, "documents").withColumn("ctx", clip_at_space(F.split("text", "\n")[0], RULES.CONTEXT_CLIP))
    t = chunks.split_fixed(docs, keys=("doc_id", "ctx"))
    return t.select("doc_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), F.length("ctx").cast("bigint").alias("context_chars"),
                    F.md5(C.situated_text("ctx", "text").cast("binary")).alias("situated_md5"))


@query("chunk_replace", f"""
WITH a AS ({sql_chunks(SIZE, OVER)}), b AS ({sql_chunks(1000, 100)}), ch AS (SELECT doc_id FROM labels WHERE toxic = 1),
r AS (SELECT doc_id, text FROM a WHERE doc_id NOT IN (SELECT doc_id FROM ch) UNION ALL SELECT doc_id, text FROM b WHERE doc_id IN (SELECT doc_id FROM ch))
SELECT doc_id, count(*) AS n_chunks, sum(length(text))::BIGINT AS n_chars FROM r GROUP BY doc_id""")
def chunk_replace(spark, d):
    docs = read_table(spark, d, "documents")
    changed = read_table(spark, d, "labels").filter("toxic = 1").select("doc_id")
    fresh = chunks.split_fixed(docs.join(changed, "doc_id", "left_semi"), size=1000, overlap=100)
    out = ingest.replace_children(chunks.split_fixed(docs), fresh, changed, ["doc_id"])
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))


FACT_RULES = (
    ("email", (r"([a-z0-9][a-z0-9._]*@[a-z0-9.\-]+\.[a-z]{2,})",), 120),
    ("link", (r"(https?://[^\s)]+)", r"\b(www\.[^\s)]+)"), 120),
    ("number", (r"(\d{3}[- ]\d{2,4}[- ]\d{4})",), 40),
)


def _sql_facts() -> str:
    parts = []
    for name, patterns, max_len in FACT_RULES:
        found = " || ".join(f"regexp_extract_all(text, '(?i){p}', 1)" for p in patterns)
        parts.append(f"SELECT doc_id, '{name}' AS fact_key, {max_len} AS lim, {found} AS vs FROM documents")
    return " UNION ALL ".join(parts)


@query("fact_matches", f"""
WITH f AS ({_sql_facts()}), e AS (SELECT doc_id, fact_key, lim, unnest(vs) AS raw, generate_subscripts(vs, 1) AS pos FROM f),
t AS (SELECT doc_id, fact_key, pos, lim, trim(regexp_replace(trim(raw, ' .:-\t'), '\\s+', ' ', 'g'), {BL}) AS v FROM e),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, fact_key, lower(v) ORDER BY pos) AS rn FROM t WHERE v <> '' AND length(v) <= lim)
SELECT doc_id, fact_key, v AS fact_value, row_number() OVER (PARTITION BY doc_id, fact_key ORDER BY pos) AS position FROM u WHERE rn = 1""")
def fact_matches(spark, d):
    return facts.match_facts(R.text_table(spark, d, "documents"), FACT_RULES)


OVERVIEW_SQL = f"""
WITH {DOCS}, {R.SOURCES}, {R.MESSAGES}, c AS ({sql_chunks(SIZE, OVER)}),
ds AS (SELECT source_id, count(*) AS documents_count, min(fetched_at) AS first_fetched_at, max(fetched_at) AS last_fetched_at FROM docs GROUP BY 1),
cs AS (SELECT source_id, count(c.doc_id) AS chunks_count FROM docs LEFT JOIN c USING (doc_id) GROUP BY 1),
ss AS (SELECT source_id, count(DISTINCT session_id) AS sessions_count FROM msgs WHERE role = 'user' GROUP BY 1)
SELECT s.source_id, s.domain, s.created_at, coalesce(documents_count, 0) AS documents_count, first_fetched_at, last_fetched_at,
       coalesce(chunks_count, 0) AS chunks_count, coalesce(sessions_count, 0) AS sessions_count
FROM srcs s LEFT JOIN ds USING (source_id) LEFT JOIN cs USING (source_id) LEFT JOIN ss USING (source_id)
ORDER BY coalesce(last_fetched_at, s.created_at) DESC, source_id"""


@query("source_overview", OVERVIEW_SQL)
def source_overview(spark, d):
    ch = chunks.split_fixed(read_table(spark, d, "documents")).select("doc_id", "chunk_id")
    return access.source_overview(R.sources(spark, d), R.documents(spark, d), ch, R.messages(spark, d))


@query("recent_sources", f"WITH {R.SOURCES} SELECT * FROM srcs ORDER BY created_at DESC, source_id LIMIT 10")
def recent_sources(spark, d):
    return access.recent_sources(R.sources(spark, d), 10)


@query("chunk_scope", f"""
WITH {DOCS}, {R.SOURCES}, c AS ({sql_chunks(SIZE, OVER)}),
want AS (SELECT DISTINCT 'www.src' || (conv_id % 5) || '.example.org' AS domain FROM conversations)
SELECT c.doc_id, c.chunk_id, docs.source_id, docs.url, srcs.domain FROM c JOIN docs USING (doc_id) JOIN srcs USING (source_id)
WHERE 'www.' || srcs.domain IN (SELECT domain FROM want)""")
def chunk_scope(spark, d):
    ch = chunks.split_fixed(read_table(spark, d, "documents")).select("doc_id", F.col("chunk_id").cast("bigint").alias("chunk_id"))
    want = R.messages(spark, d).select(F.concat(F.lit("www."), "source_id", F.lit(".example.org")).alias("domain"))
    docs = R.documents(spark, d).select("doc_id", "source_id", "url")
    return access.chunk_scope(ch, docs, R.sources(spark, d).select("source_id", "domain"), want).select(
        "doc_id", "chunk_id", "source_id", "url", "domain")


@query("page_target", f"""
WITH {R.CRAWL}, r AS (SELECT *, sum(CASE WHEN outcome = 'accepted' THEN 1 ELSE 0 END) OVER
   (PARTITION BY job_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM crawl)
SELECT job_id, position, outcome FROM r WHERE coalesce(before, 0) < 7""")
def page_target(spark, d):
    rows = R.crawl_events(spark, d).withColumn("accepted", F.col("outcome") == "accepted")
    return metrics.stop_at_target(rows, 7, width=1000).select("job_id", "position", "outcome")


COUNTERS_SQL = """SELECT job_id, count(*) AS processed_results,
  count(*) FILTER (WHERE outcome = 'blocked_host') AS blocked_by_host_filter, 0::BIGINT AS blocked_by_block_filter,
  count(*) FILTER (WHERE outcome NOT IN ('blocked_host', 'failed_fetch')) AS successful_results,
  count(*) FILTER (WHERE starts_with(outcome, 'invalid:')) AS skipped_invalid_content,
  count(*) FILTER (WHERE starts_with(outcome, 'skipped:')) AS skipped_ingestion,
  count(*) FILTER (WHERE outcome = 'accepted' OR starts_with(outcome, 'skipped:')) AS accepted_valid_pages,
  count(*) FILTER (WHERE outcome = 'accepted') AS saved_docs,
  count(*) FILTER (WHERE (outcome = 'accepted' OR starts_with(outcome, 'skipped:')) AND priority) AS matched_allow_filter,
  count(*) FILTER (WHERE outcome = 'blocked_host') AS filtered_total FROM crawl GROUP BY job_id"""


@query("crawl_metrics", f"WITH {R.CRAWL} {COUNTERS_SQL}")
def crawl_metrics(spark, d):
    return metrics.crawl_counters(R.crawl_events(spark, d))


@query("job_rates", f"""
WITH {R.CRAWL}, n AS (SELECT max(ts) + INTERVAL 5 SECOND AS now FROM crawl), k AS ({COUNTERS_SQL}),
j AS (SELECT job_id, min(ts) AS started_at, max(ts) AS updated_at, count(*) * 2 AS total_results,
        CASE WHEN bool_or(outcome = 'failed_fetch' AND priority) THEN 'failed' ELSE 'running' END AS status FROM crawl GROUP BY job_id),
v AS (SELECT j.*, k.processed_results, k.saved_docs, k.accepted_valid_pages, now,
        (epoch_us(now) - epoch_us(started_at)) // 1000 / 1000.0 AS e, (epoch_us(now) - epoch_us(updated_at)) // 1000 AS f FROM j JOIN k USING (job_id), n)
SELECT job_id, status, round(e * 1000 / 10.0) / 100 AS elapsed_seconds, f::BIGINT AS freshness_ms, status = 'running' AND f > 12000 AS is_stale,
  status = 'running' AND processed_results = 0 AS in_discovery, round(processed_results / e, 3) AS processed_per_sec,
  round(saved_docs / e, 3) AS saved_per_sec, round(accepted_valid_pages / e, 3) AS valid_per_sec,
  CASE WHEN e >= 3 AND processed_results >= 3 THEN least(floor((total_results - processed_results) / (processed_results / e))::BIGINT, 3600) END AS eta_seconds FROM v""")
def job_rates(spark, d):
    c = R.crawl_events(spark, d)
    bad = F.max(((F.col("outcome") == "failed_fetch") & F.col("priority")).cast("int"))
    spans = c.groupBy("job_id").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("updated_at"), (F.count(F.lit(1)) * 2).alias("total_results"),
        F.when(bad == 1, "failed").otherwise("running").alias("status"))
    jobs = spans.join(metrics.crawl_counters(c), "job_id").withColumn(
        "now", c.agg((F.max("ts") + F.expr("INTERVAL 5 SECOND")).alias("n")).scalar())
    return metrics.job_rates(jobs).select(
        "job_id", "status", "elapsed_seconds", "freshness_ms", "is_stale", "in_discovery", "processed_per_sec",
        "saved_per_sec", "valid_per_sec", "eta_seconds")


@query("word_first_seen", f"""
WITH t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM
  (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}0-9]+'), lambda x: x <> '') AS ws FROM documents)),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY doc_id, pos) AS rn, count(*) OVER (PARTITION BY word) AS times FROM t)
SELECT word, doc_id AS first_doc_id, pos AS first_pos, times FROM r WHERE rn = 1""")
def word_first_seen(spark, d):
    from foliant.functions.text import tokens

    t = R.text_table(spark, d, "documents").select("doc_id", F.posexplode(tokens("text")).alias("pos", "word"))
    return links.first_occurrences(t.withColumn("pos", F.col("pos").cast("bigint")), "word", ["doc_id", "pos"])
