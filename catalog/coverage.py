"""Queries for single operators that the larger ones do not exercise."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import roles as R
from catalog.registry import query
from catalog.roles import sql_any
from foliant import rules as RULES
from foliant.functions import answers as A
from foliant.functions import chunking as C
from foliant.functions import html as H
from foliant.functions import urls
from foliant.operators import access, classify, cleaning, evaluate, ingest, links
from foliant.operators import chunks as CH
from foliant.operators.conversation import merge_state
from foliant.plans.lineage import new_dir
from foliant.schemas import read_table
from foliant.sources import captures

FILE_URL = "https://files.example.org/20"


@query("url_years", f"""
WITH u AS (SELECT event_id, '{FILE_URL}' || lpad((event_id % 40)::VARCHAR, 2, '0') || '/v' || (user_id + 1990) || '.pdf' AS url FROM events)
SELECT event_id, url, len(list_filter(regexp_extract_all(url, '20[0-9][0-9]'), lambda y: y::INT BETWEEN 2012 AND 2017)) > 0 AS recent FROM u""")
def url_years(spark, d):
    part = F.lpad((F.col("event_id") % 40).cast("string"), 2, "0")
    url = F.concat(F.lit(FILE_URL), part, F.lit("/v"), (F.col("user_id") + 1990).cast("string"), F.lit(".pdf"))
    return read_table(spark, d, "events").select("event_id", url.alias("url")).withColumn(
        "recent", urls.is_recent_document("url", 2017, 5))


PDF_RULES = ((("the", "und"), 0.9), (("de", "/en/"), 0.7), (("1",), 0.6))


@query("pdf_authority", f"""
SELECT page_id, CASE {" ".join(f"WHEN {sql_any('hay', tokens)} THEN {score}" for tokens, score in PDF_RULES)} ELSE {RULES.PDF_DEFAULT_AUTHORITY} END::DOUBLE AS authority
FROM (SELECT page_id, lower(url) || ' ' || lower({R.sql_title('html')}) AS hay FROM pages)""")
def pdf_authority(spark, d):
    from dataclasses import replace

    rules = replace(R.SAMPLE_RULES, pdf_rules=PDF_RULES)
    p = R.raw_pages(spark, d).select("page_id", "url", H.title("html").alias("title"))
    return p.select("page_id", classify.pdf_authority(F.col("url"), F.col("title"), rules).cast("double").alias("authority"))


@query("document_links", """
WITH b AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') AS root FROM pages)
SELECT page_id, root || '/f/' || page_id || '.pdf?v=1 ' || root || '/m/' || page_id || '.PDF' AS found FROM b""")
def document_links(spark, d):
    """Anchors first, then Markdown links; the same file with another query counts once."""
    n = F.col("page_id").cast("string")
    extra = F.concat(F.lit("<a href='/f/"), n, F.lit(".pdf?v=1'>a</a> [b](/f/"), n, F.lit(".pdf?v=2) [c](/m/"), n,
                     F.lit(".PDF) <a href=/f/"), n, F.lit(".pdf#p2>d</a>"))
    p = R.raw_pages(spark, d).select("page_id", "url", F.concat("html", extra).alias("html"))
    return p.select("page_id", F.array_join(links.document_links(F.col("html"), F.col("url")), " ").alias("found"))


@query("unlink_sources", """
WITH g AS (SELECT user_id, 'src' || (event_id % 20) AS source_id, min(ts) AS created_at FROM events WHERE event_type = 'signup' GROUP BY 1, 2),
r AS (SELECT DISTINCT user_id, 'src' || (event_id % 20) AS source_id FROM events WHERE event_type = 'purchase')
SELECT user_id, source_id, created_at FROM g ANTI JOIN r USING (user_id, source_id)""")
def unlink_sources(spark, d):
    e = read_table(spark, d, "events").withColumn("source_id", F.concat(F.lit("src"), (F.col("event_id") % 20).cast("string")))
    grants = e.filter("event_type = 'signup'").groupBy("user_id", "source_id").agg(F.min("ts").alias("created_at"))
    external = F.concat(F.lit("ext-"), F.col("user_id").cast("string"))
    users = e.select("user_id").distinct().withColumn("external_id", external)
    revoked = e.filter("event_type = 'purchase'").select(external.alias("external_id"), "source_id")
    return access.unlink_sources(grants, revoked, users)


@query("chunk_counts", """
SELECT doc_id, CASE WHEN length(text) <= 1500 THEN 1 ELSE ceil((length(text) - 200) / 1300.0)::BIGINT END AS n_chunks
FROM documents WHERE length(text) > 0""")
def chunk_counts(spark, d):
    docs = R.documents(spark, d).select("doc_id", F.explode(C.fixed_chunks("text", 1500, 200)).alias("chunk"))
    return ingest.chunk_counts(docs)


@query("verify_context", rf"""
SELECT doc_id, length(c) AS n_chars, md5(c) AS context_md5 FROM (SELECT doc_id,
  CASE WHEN trim(t, {R.BL}) = '' THEN '{RULES.EMPTY_CONTEXT}' WHEN length(t) <= 900 THEN t ELSE substring(t, 1, 900) || '
[…]' END AS c FROM (SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), '

---

') AS t FROM documents))""")
def verify_context(spark, d):
    c = A.verify_context(F.split("text", "\n"), 900)
    return read_table(spark, d, "documents").select("doc_id", c.alias("c")).select(
        "doc_id", F.length("c").cast("bigint").alias("n_chars"), F.md5(F.col("c").cast("binary")).alias("context_md5"))


@query("state_merge", """
SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'old' END AS step,
       CASE WHEN event_id % 3 = 0 THEN 'u' || user_id END AS who FROM events""")
def state_merge(spark, d):
    """Updates override single keys of a session state and leave the others."""
    old = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), F.lit("old").alias("step")))
    new = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(
        F.col("event_type").alias("step"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("who"))))
    e = read_table(spark, d, "events").select("event_id", old.alias("state"), new.alias("patch"))
    get = lambda k: F.get_json_object("merged", f"$.{k}").alias(k)
    return e.withColumn("merged", merge_state("state", "patch")).select("event_id", get("k"), get("step"), get("who"))


@query("primary_email", """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'main' || user_id || '@example.org' WHEN event_id % 4 IN (1, 2) THEN 'first' || event_id || '@example.org' END AS email FROM events""")
def primary_email(spark, d):
    n = F.col("event_id") % 4
    first = F.struct(F.lit("a").alias("id"), F.when(n == 3, "  ").otherwise(
        F.concat(F.lit("First"), F.col("event_id").cast("string"), F.lit("@example.org "))).alias("email_address"))
    main = F.struct(F.lit("p").alias("id"), F.when(n == 0, F.concat(F.lit("Main"), F.col("user_id").cast("string"), F.lit("@example.org")))
                    .otherwise("").alias("email_address"))
    primary = F.when(n == 0, "p").when(n == 1, "").otherwise("gone")
    return read_table(spark, d, "events").select("event_id", A.primary_email(primary, F.array(first, main)).alias("email"))


@query("default_context", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 't' || source || ' - h' || lang ELSE 't' || source END AS context FROM documents""")
def default_context(spark, d):
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("h"), "lang")).otherwise("")
    return read_table(spark, d, "documents").select("doc_id", CH.default_context(F.concat(F.lit("t"), "source"), head).alias("context"))


@query("sitemap_pages", f"""
WITH u AS (SELECT DISTINCT url, {R.sql_host('url')} AS h FROM pages WHERE starts_with(url, 'https:'))
SELECT url FROM u WHERE h = (SELECT min(h) FROM u)""")
def sitemap_pages(spark, d):
    """Sitemaps rendered from the page URLs, fifty ids to a file, under a tree of nested indexes read from its root."""
    pages = R.raw_pages(spark, d).withColumn("n", F.floor(F.col("page_id") / 50))
    loc = F.concat(F.lit("<url><loc> "), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>"))
    sets = pages.groupBy("n").agg(F.array_join(F.collect_list(loc), "").alias("body")).select(
        F.concat(F.lit("set"), F.col("n").cast("string")).alias("sitemap_url"), F.concat(F.lit("<urlset>"), "body", F.lit("</urlset>")).alias("xml"))
    part = lambda x: F.concat(F.lit("<sitemap><loc>"), x, F.lit("</loc></sitemap>"))
    n = F.col("n").cast("string")
    index = pages.select("n").distinct().select(
        F.concat(F.lit("index"), n).alias("sitemap_url"),
        F.concat(F.lit("<sitemapindex>"), part(F.concat(F.lit("set"), n)), part(F.concat(F.lit("index"), (F.col("n") * 2 + 1).cast("string"))),
                 part(F.concat(F.lit("index"), (F.col("n") * 2 + 2).cast("string"))), F.lit("</sitemapindex>")).alias("xml"))
    host = pages.filter(urls.scheme("url") == "https").agg(F.min(urls.host_exact("url")).alias("h")).scalar()
    roots = spark.range(1).select(F.lit("index0").alias("sitemap_url"))
    return captures.expand_sitemaps(sets.unionByName(index), host, roots).select("url")


@query("span_lines", """
WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM documents),
l AS (SELECT doc_id, i // 8 AS line, string_agg(trim(word, ' \t\n'), ' ' ORDER BY i) FILTER (trim(word, ' \t\n') <> '') AS t FROM w GROUP BY ALL)
SELECT doc_id, line, md5(CASE line % 4 WHEN 0 THEN '## ' || t WHEN 1 THEN '### ' || t
  WHEN 2 THEN CASE WHEN length(t) < 120 AND NOT ends_with(t, '.') THEN '**' || t || '**' ELSE t END ELSE t END) AS line_md5
FROM l WHERE t IS NOT NULL""")
def span_lines(spark, d):
    """Words of the documents as spans of eight to a line; the line decides size and weight."""
    w = read_table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "text"))
    line = F.floor(F.col("i") / 8)
    kind = line % 4
    spans = w.select(
        "doc_id", F.lit(0).alias("page"), F.lit(0).alias("block"), F.lit(0).alias("block_type"), line.alias("line"),
        (F.col("i") % 8).alias("span"), F.trim("text", F.lit(" \t\n")).alias("text"),
        F.when(kind == 0, 18.0).when(kind == 1, 14.0).otherwise(10.0).alias("size"), F.when(kind == 2, 16).otherwise(0).alias("flags"))
    return cleaning.spans_to_lines(spans).select("doc_id", "line", F.md5(F.col("text").cast("binary")).alias("line_md5"))


@query("failed_probes", """
SELECT doc_id AS id, 'answer ' || source AS answer FROM labels JOIN documents USING (doc_id) WHERE quality = 0""")
def failed_probes(spark, d):
    """Failed probe results written as JSON lines and read back."""
    j = read_table(spark, d, "labels").join(read_table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    rows = j.select(F.col("doc_id").alias("id"), F.col("source").alias("category"), F.lit("q").alias("q"), F.lit(False).alias("expects_decline"),
                    F.concat(F.lit("answer "), "source").alias("answer"), F.lit(0.5).alias("groundedness"), F.lit(False).alias("decline"),
                    (F.col("quality") == 1).alias("ok"), F.lit(None).cast("string").alias("error"))
    path = f"{new_dir(spark, 'probes')}/failures"
    evaluate.probe_failures(rows).write.json(path)
    return captures.read_jsonl(spark, path).select("id", "answer")
