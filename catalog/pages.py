"""Page scan, URL, filter and classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import roles as R
from catalog.registry import query
from catalog.roles import BL, PAGES, SAMPLE_RULES, sql_any, sql_domain, sql_first, sql_host, sql_part
from foliant import rules as RULES
from foliant.functions import html as H
from foliant.functions import urls
from foliant.functions.text import slug
from foliant.operators import classify, cleaning, ingest, links, metrics
from foliant.plans import corpus
from foliant.plans.lineage import new_dir
from foliant.schemas import read_table
from foliant.sources import markdown_files

WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"


@query("page_scan", f"""
WITH {PAGES}
SELECT page_id, url, success, title, length(html) AS html_chars, length(text) AS text_chars FROM p""")
def page_scan(spark, d):
    return R.pages(spark, d).select(
        "page_id", "url", "success", "title", F.length("html").cast("bigint").alias("html_chars"),
        F.length("text").cast("bigint").alias("text_chars"))


@query("html_title", f"SELECT page_id, {R.sql_title('html')} AS title FROM pages")
def html_title(spark, d):
    return R.raw_pages(spark, d).select("page_id", H.title("html").alias("title"))


@query("html_text_sql", f"WITH {PAGES} SELECT page_id, length(text) AS n_chars, md5(text) AS text_md5 FROM p")
def html_text_sql(spark, d):
    t = H.text_from_html("html")
    return R.raw_pages(spark, d, heavy=True).select("page_id", t.alias("t")).select(
        "page_id", F.length("t").cast("bigint").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("text_md5"))


@query("html_text")
def html_text(spark, d):
    return cleaning.html_to_text(R.raw_pages(spark, d, heavy=True)).select(
        "page_id", "title", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("text_hash"))


def _sql_blocks() -> str:
    """Blocks between block ends with enough words and little link text."""
    h = f"regexp_replace(regexp_replace(html, '{H.HIDDEN}', ' ', 'g'), '{H.NOISE}', chr(10), 'g')"
    plain = R.sql_decoded(f"regexp_replace(b, '{H.ANY_TAG}', '', 'g')")
    anchors = "array_to_string(regexp_extract_all(b, '(?is)<a\\b[^>]*>(.*?)</a>', 1), '')"
    return f"""
    WITH b AS (SELECT page_id, url, unnest(string_split_regex({h}, '{H.BLOCK_END}')) AS b, generate_subscripts(string_split_regex({h}, '{H.BLOCK_END}'), 1) AS i FROM pages),
    t AS (SELECT page_id, i, contains(lower(url), '/fr/') AS easy, trim(regexp_replace({plain}, '\\s+', ' ', 'g'), {BL}) AS t,
                 length(regexp_replace({anchors}, '{H.ANY_TAG}', '', 'g')) AS links FROM b),
    k AS (SELECT * FROM t WHERE t <> '' AND len(string_split(t, ' ')) >= CASE WHEN easy THEN 1 ELSE 8 END AND 1.0 - links / length(t) >= CASE WHEN easy THEN 0.08 ELSE 0.25 END)
    SELECT page_id, coalesce((SELECT string_agg(t, chr(10) ORDER BY i) FROM k WHERE k.page_id = pages.page_id), '') AS text FROM pages"""


@query("prune_blocks", _sql_blocks())
def prune_blocks(spark, d):
    return R.raw_pages(spark, d, heavy=True).select(
        "page_id", cleaning.pruned_text("url", "html", ("/fr/",)).alias("text"))


@query("url_parts", f"""
SELECT page_id, lower({sql_part('url', 1)}) AS scheme, {sql_host('url')} AS host, {sql_domain('url')} AS domain,
       {sql_part('url', 3)} AS path, {sql_part('url', 4)} AS query FROM pages""")
def url_parts(spark, d):
    return R.raw_pages(spark, d).select(
        "page_id", urls.scheme("url").alias("scheme"), urls.host_exact("url").alias("host"),
        urls.registered_domain("url").alias("domain"), urls.path("url").alias("path"), urls.query("url").alias("query"))


@query("domain_match", f"""
WITH s AS (SELECT DISTINCT {sql_domain('url')} AS domain FROM pages WHERE starts_with(url, 'https')),
v AS (SELECT domain, unnest([domain, 'www.' || domain]) AS host FROM s)
SELECT page_id, v.domain AS domain, v.host AS host,
       'https://' || v.domain || ' https://www.' || v.domain || ' https://test.example.org' AS origins
FROM pages JOIN v ON {sql_host('url')} = v.host""")
def domain_match(spark, d):
    p = R.raw_pages(spark, d)
    known = p.filter(urls.scheme("url") == "https").select(urls.registered_domain("url").alias("domain")).distinct()
    known = known.select("domain", F.explode(urls.domain_variants("domain")).alias("host"))
    return p.select("page_id", urls.host_exact("url").alias("host")).join(known, "host").select(
        "page_id", "domain", "host",
        F.array_join(urls.allowed_origins("domain", "https://test.example.org"), " ").alias("origins"))


def _sql_canonical(u: str) -> str:
    def dec(x: str) -> str:
        return f"url_decode(replace({x}, '+', ' '))"

    def enc(x: str) -> str:
        return f"replace(url_encode({x}), '%20', '+')"

    drop = ", ".join(f"'{t}'" for t in RULES.TRACKING_PARAMS)
    kv = (f"list_transform(list_filter(string_split({sql_part(u, 4)}, '&'), lambda p: p <> ''), lambda p: "
          f"{{'lk': lower({dec("string_split(p, '=')[1]")}), 'v': {dec("regexp_extract(p, '(?s)=(.*)$', 1)")}, "
          f"'k': {dec("string_split(p, '=')[1]")}}})")
    kept = f"list_sort(list_filter({kv}, lambda x: NOT (starts_with(x.lk, 'utm_') OR x.lk IN ({drop}))))"
    q = f"array_to_string(list_transform({kept}, lambda x: {enc('x.k')} || '=' || {enc('x.v')}), '&')"
    path = f"regexp_replace({sql_part(u, 3)}, '/{{2,}}', '/', 'g')"
    path = f"CASE WHEN {path} IN ('', '/') THEN '/' ELSE regexp_replace({path}, '/$', '') END"
    scheme = f"CASE WHEN {sql_part(u, 1)} = '' THEN 'https' ELSE lower({sql_part(u, 1)}) END"
    return (f"({scheme}) || '://' || {sql_domain(sql_part(u, 2))} || ({path}) || "
            f"CASE WHEN {q} = '' THEN '' ELSE '?' || {q} END")


@query("canonical_url", f"SELECT page_id, {_sql_canonical('url')} AS canonical_url FROM pages")
def canonical_url(spark, d):
    return R.raw_pages(spark, d).select("page_id", urls.canonical_url("url").alias("canonical_url"))


ALLOWED_SQL = f"regexp_replace({sql_host('url')}, '^m\\.', '')"


def allowed_host():
    """One crawl per host; the mobile host belongs to its parent's crawl and is rejected there."""
    return F.regexp_replace(urls.host_exact("url"), r"^m\.", "")


@query("host_filter", f"""
SELECT page_id, url, lower({sql_part('url', 1)}) = 'https' AND {sql_host('url')} = {ALLOWED_SQL} AS allowed FROM pages""")
def host_filter(spark, d):
    ok, bad = classify.split_by_host(R.raw_pages(spark, d), allowed_host())
    return ok.select("page_id", "url", F.lit(True).alias("allowed")).unionByName(
        bad.select("page_id", "url", F.lit(False).alias("allowed")))


SAMPLE_GLOBS = R.SAMPLE_GLOBS


SQL_BLOCKED = "(" + " OR ".join(f"lower(url) GLOB '{g}'" for g in SAMPLE_GLOBS) + ")"


@query("block_filter", f"SELECT page_id, url, {SQL_BLOCKED} AS blocked FROM pages")
def block_filter(spark, d):
    return R.raw_pages(spark, d).select("page_id", "url", urls.url_blocked("url", SAMPLE_GLOBS).alias("blocked"))


def sql_news(url: str, title: str, content: str, r=SAMPLE_RULES) -> str:
    u, t, c = f"lower(trim({url}, {BL}))", f"lower({title})", f"substring(lower(trim({content}, {BL})), 1, 1000)"
    return (f"(NOT {sql_any(u, r.news_exempt)} AND ({sql_any(u, r.news_url_tokens)} OR {sql_any(t, r.news_hints)} "
            f"OR {sql_any(c, r.news_hints)}))")


@query("news_filter", f"WITH {PAGES} SELECT page_id, {sql_news('url', 'title', 'text')} AS is_news FROM p")
def news_filter(spark, d):
    return R.pages(spark, d).select(
        "page_id", classify.is_news(F.col("url"), F.col("title"), F.col("text"), SAMPLE_RULES).alias("is_news"))


def _sql_pdf(url: str, title: str) -> str:
    hay = f"lower({url}) || ' ' || lower({title})"
    cases = " ".join(f"WHEN {sql_any(hay, tokens)} THEN {score}" for tokens, score in RULES.PDF_RULES)
    return f"CASE {cases} ELSE {RULES.PDF_DEFAULT_AUTHORITY} END"


def _sql_class(r=SAMPLE_RULES) -> str:
    """SELECT page_id, page_type, authority_score, should_block, reason FROM p."""
    u = f"lower(trim(url, {BL}))"
    phases = [
        (sql_any(u, r.block_tokens), "utility_noise", "0.0", "true", f"'blocked:' || {sql_first(u, r.block_tokens)}"),
        (f"{sql_part(u, 3)} IN ('', '/')", "homepage", "0.15", "true", "'root_path'"),
        (sql_any(u, r.news_tokens), "news_blocked", "0.0", "true", f"'news_blocked:' || {sql_first(u, r.news_tokens)}"),
        (f"(ends_with({u}, '.pdf') OR contains({u}, '.pdf?'))", "pdf_document", _sql_pdf("url", "title"), "false", "''"),
    ] + [(sql_any(u, tokens), name, str(score), "false", "''") for name, tokens, score in r.class_rules]
    name, score = r.default_class
    cols = []
    for i, alias, default in ((1, "page_type", f"'{name}'"), (2, "authority_score", str(score)),
                              (3, "should_block", "false"), (4, "reason", "''")):
        whens = " ".join(f"WHEN {ph[0]} THEN " + (f"'{ph[i]}'" if i == 1 else str(ph[i])) for ph in phases)
        cast = "::DOUBLE" if i == 2 else ""
        cols.append(f"(CASE {whens} ELSE {default} END){cast} AS {alias}")
    return "SELECT *, " + ", ".join(cols) + " FROM p"


@query("page_classify", f"""
WITH {PAGES} SELECT page_id, page_type, authority_score, should_block, reason FROM ({_sql_class()})""")
def page_classify(spark, d):
    c = classify.classify(F.col("url"), F.col("title"), SAMPLE_RULES)
    return R.pages(spark, d, with_text=False).select("page_id", c.alias("c")).select("page_id", "c.*")


def _sql_upgraded(r=SAMPLE_RULES) -> str:
    hay = "lower(url) || ' ' || lower(title) || ' ' || substring(lower(text), 1, 3000)"
    career = " + ".join(f"contains(hay, '{t}')::INT" for t in r.career_signals)
    proc = " + ".join(f"contains(hay, '{t}')::INT" for t in r.procedure_signals)
    return f"""SELECT * EXCLUDE (page_type, authority_score, reason, hay, up), page_type AS base_type, reason AS base_reason,
      CASE up WHEN 1 THEN 'career_canonical' WHEN 2 THEN 'procedure' ELSE page_type END AS page_type,
      CASE up WHEN 1 THEN 0.92 WHEN 2 THEN greatest(authority_score, 0.85) ELSE authority_score END AS authority_score,
      CASE up WHEN 1 THEN 'content_upgrade:career_signals' WHEN 2 THEN 'content_upgrade:procedure_signals' ELSE reason END AS reason
    FROM (SELECT *, CASE WHEN should_block THEN 0
        WHEN page_type NOT IN ('career_canonical', 'offer_canonical') AND ({career}) >= 2 THEN 1
        WHEN page_type <> 'procedure' AND ({proc}) >= 2 THEN 2 ELSE 0 END AS up
      FROM (SELECT *, {hay} AS hay FROM ({_sql_class(r)})))"""


@query("content_upgrade", f"""
WITH {PAGES} SELECT page_id, page_type, authority_score, should_block, reason FROM ({_sql_upgraded()})""")
def content_upgrade(spark, d):
    return classify.classify_pages(R.pages(spark, d), SAMPLE_RULES).select(
        "page_id", "page_type", "authority_score", "should_block", "reason")


def _sql_outcome(r=SAMPLE_RULES) -> str:
    norm = f"lower(trim(text, {BL}))"
    words = f"len(list_filter(string_split_regex({norm}, '{WS}'), lambda t: t <> ''))"
    return f"""SELECT page_id, url, title, content, CASE
      WHEN NOT (lower({sql_part('url', 1)}) = 'https' AND {sql_host('url')} = {ALLOWED_SQL}) THEN 'blocked_host'
      WHEN {SQL_BLOCKED} THEN 'blocked_pattern'
      WHEN NOT success THEN 'failed_fetch'
      WHEN text = '' THEN 'invalid:empty_content'
      WHEN {norm} = '' THEN 'invalid:blank_content'
      WHEN {sql_part('lower(url)', 3)} IN ('', '/') THEN 'invalid:root_path'
      WHEN {sql_any(norm, r.not_found)} THEN 'invalid:not_found_page'
      WHEN {words} < {r.min_words} THEN 'invalid:too_short'
      WHEN base_type = 'news_blocked' THEN 'invalid:classifier_blocked:' || base_reason
      WHEN {sql_news('url', 'title', norm, r)} THEN 'invalid:news_blocked'
      WHEN content = '' THEN 'skipped:empty_content'
      WHEN {sql_any('lower(content)', r.not_found)} THEN 'skipped:not_found_content'
      WHEN {sql_news('url', 'title', 'content', r)} THEN 'skipped:news_blocked'
      ELSE 'accepted' END AS outcome,
      {sql_any("(lower(url) || ' ' || lower(title))", r.priority_tokens)} AS priority,
      page_type, CASE WHEN authority_score = 0 THEN 0.5 ELSE authority_score END AS authority_score
    FROM ({_sql_upgraded(r)})"""


@query("page_outcome", f"WITH {PAGES} SELECT * EXCLUDE (title, content) FROM ({_sql_outcome()})")
def page_outcome(spark, d):
    return classify.page_outcomes(R.pages(spark, d), SAMPLE_RULES, allowed_host()).select(
        "page_id", "url", "outcome", "priority", "page_type", "authority_score")


@query("crawl_report", f"""
WITH {PAGES}, o AS ({_sql_outcome()}),
e AS (SELECT CASE WHEN outcome = 'blocked_host' THEN 'blocked_by_host_filter' WHEN outcome = 'blocked_pattern' THEN 'blocked_by_block_filter' WHEN outcome = 'failed_fetch' THEN 'failed_fetch_or_scrape'
             WHEN starts_with(outcome, 'invalid:') THEN 'skipped_invalid_content' WHEN starts_with(outcome, 'skipped:') THEN 'skipped_ingestion' END AS list,
             {sql_domain('url')} || CASE WHEN outcome LIKE 'invalid:%' OR outcome LIKE 'skipped:%'
               THEN '\t' || regexp_replace(outcome, '^(invalid|skipped):', '') ELSE '' END AS entry, page_id FROM o)
SELECT list, entry, min(page_id) AS first_position, count(*) AS times FROM e WHERE list IS NOT NULL GROUP BY 1, 2""")
def crawl_report(spark, d):
    o = classify.page_outcomes(R.pages(spark, d), SAMPLE_RULES, allowed_host())
    o = o.withColumn("host", urls.registered_domain("url"))
    return metrics.report_lists(o, "host", "page_id")


BUILT = f"""{PAGES}, o AS ({_sql_outcome()}),
a AS (SELECT *, {sql_domain('url')} AS source_id, {_sql_canonical('url')} AS canonical_url, sha256(content) AS h FROM o WHERE outcome = 'accepted'),
w AS (SELECT *, min(page_id) OVER (PARTITION BY source_id, h) AS win,
             first_value(canonical_url) OVER (PARTITION BY source_id, h ORDER BY page_id) AS win_url FROM a),
b AS (SELECT *, CASE WHEN win = page_id THEN 'accepted' WHEN win_url = canonical_url THEN 'skipped:duplicate_content'
                ELSE 'skipped:duplicate_content_other_url' END AS final FROM w)"""


def built(spark, d):
    return corpus.build_corpus(R.pages(spark, d), SAMPLE_RULES, allowed_host())


@query("corpus_outcomes", f"""
WITH {BUILT} SELECT o.page_id, o.url, coalesce(final, o.outcome) AS outcome, o.priority FROM o LEFT JOIN b USING (page_id)""")
def corpus_outcomes(spark, d):
    return built(spark, d).outcomes.select("page_id", "url", "outcome", "priority")


@query("corpus_documents", f"""
WITH {BUILT}, last AS (SELECT max(page_id) AS page_id FROM b WHERE final = 'accepted' GROUP BY canonical_url)
SELECT page_id AS doc_id, source_id, canonical_url, title, page_type, authority_score, length(content) AS n_chars, h AS content_hash
FROM b SEMI JOIN last USING (page_id)""")
def corpus_documents(spark, d):
    return built(spark, d).documents.select(
        "doc_id", "source_id", "canonical_url", "title", "page_type", "authority_score",
        F.length("content").cast("bigint").alias("n_chars"), "content_hash")


@query("corpus_counters", f"""
WITH {BUILT}, f AS (SELECT o.page_id % 5 AS job_id, coalesce(final, o.outcome) AS outcome, o.priority FROM o LEFT JOIN b USING (page_id))
SELECT job_id, count(*) AS processed_results, count(*) FILTER (outcome = 'blocked_host') AS blocked_by_host_filter,
  count(*) FILTER (outcome = 'blocked_pattern') AS blocked_by_block_filter, count(*) FILTER (starts_with(outcome, 'invalid:')) AS skipped_invalid_content,
  count(*) FILTER (starts_with(outcome, 'skipped:')) AS skipped_ingestion, count(*) FILTER (outcome = 'accepted') AS saved_docs FROM f GROUP BY 1""")
def corpus_counters(spark, d):
    rows = built(spark, d).outcomes.withColumn("job_id", F.col("page_id") % 5)
    return metrics.crawl_counters(rows).select(
        "job_id", "processed_results", "blocked_by_host_filter", "blocked_by_block_filter", "skipped_invalid_content",
        "skipped_ingestion", "saved_docs")


@query("export_names", f"""
SELECT page_id, substring(CASE WHEN s = '' THEN 'page' ELSE s END, 1, 80) || '-' || substring(sha1(url), 1, 10) || '.md' AS file_name
FROM (SELECT page_id, url, trim(regexp_replace(lower(trim(CASE WHEN t = '' THEN url ELSE t END, {BL})), '[^a-z0-9]+', '-', 'g'), '-') AS s
      FROM (SELECT page_id, url, {R.sql_title('html')} AS t FROM pages))""")
def export_names(spark, d):
    return R.raw_pages(spark, d).select("page_id", urls.export_name("url", H.title("html")).alias("file_name"))


@query("file_titles", f"""
WITH f AS (SELECT page_id, CASE WHEN contains(pa, '/') THEN string_split(url_decode(pa), '/')[-1] ELSE '' END AS file_name
           FROM (SELECT page_id, {sql_part('url', 3)} AS pa FROM pages)),
g AS (SELECT *, trim(regexp_replace(translate(regexp_replace(file_name, '\\.[^.]*$', ''), '-_', '  '), '\\s+', ' ', 'g'), {BL}) AS s FROM f)
SELECT page_id, file_name, array_to_string(list_transform(string_split(s, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS title FROM g""")
def file_titles(spark, d):
    return R.raw_pages(spark, d).select("page_id", urls.file_name("url").alias("file_name")).withColumn(
        "title", urls.document_title(F.lit("Untitled"), "file_name"))


ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>][^\s>]*)"""
UNQUOTED = R.sql_decoded("""trim(unnest(found), '"''')""")

HREFS_SQL = f"""
raw AS (SELECT page_id, url, regexp_extract_all(html, '{ANCHOR}', 1) AS found FROM pages),
hr AS (SELECT page_id, url, {UNQUOTED} AS href, generate_subscripts(found, 1) - 1 AS position FROM raw),
lk AS (SELECT page_id, url AS src_url, position, CASE
    WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h
    WHEN starts_with(h, '//') THEN {sql_part('url', 1)} || ':' || h
    WHEN starts_with(h, '/') THEN {sql_part('url', 1)} || '://' || {sql_part('url', 2)} || h
    WHEN starts_with(h, '?') THEN {sql_part('url', 1)} || '://' || {sql_part('url', 2)} || {sql_part('url', 3)} || h
    WHEN starts_with(h, '#') THEN regexp_replace(url, '#.*$', '') || h
    ELSE {sql_part('url', 1)} || '://' || {sql_part('url', 2)} || regexp_replace({sql_part('url', 3)}, '[^/]*$', '') || h END AS dst_url
  FROM (SELECT *, trim(href, {BL}) AS h FROM hr) WHERE h <> '')"""


@query("link_table", f"""
WITH {HREFS_SQL} SELECT page_id, src_url, position, dst_url FROM lk WHERE {sql_host('dst_url')} = {sql_host('src_url')}""")
def link_table(spark, d):
    return links.page_links(R.raw_pages(spark, d, heavy=True))


@query("link_dedup", f"""
WITH {HREFS_SQL}, f AS (SELECT dst_url, page_id, position, row_number() OVER (PARTITION BY dst_url ORDER BY page_id, position) AS rn,
                             count(*) OVER (PARTITION BY dst_url) AS times FROM lk)
SELECT dst_url, page_id AS first_page_id, position AS first_position, times FROM f WHERE rn = 1""")
def link_dedup(spark, d):
    return links.first_occurrences(links.page_links(R.raw_pages(spark, d, heavy=True), internal_only=False), "dst_url", ["page_id", "position"])


@query("bfs_depth", f"""
WITH RECURSIVE {HREFS_SQL.lstrip()},
e AS (SELECT DISTINCT src_url AS src, dst_url AS dst FROM lk WHERE {sql_host('dst_url')} = {sql_host('src_url')}),
w(node, depth) AS (SELECT url, 0::BIGINT FROM pages UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 6),
o AS (SELECT node, min(depth) AS depth FROM w GROUP BY node)
SELECT node, depth FROM o ORDER BY depth, node LIMIT (SELECT count(*) + 500 FROM pages)""")
def bfs_depth(spark, d):
    """From all captured pages along their own links, with the page budget of a crawl."""
    pages = R.raw_pages(spark, d)
    edges = links.page_links(pages).select(F.col("src_url").alias("src"), F.col("dst_url").alias("dst"))
    seeds = pages.select(F.col("url").alias("node"))
    return links.frontier(seeds, edges, 6, budget=pages.count() + 500)


@query("source_registry", f"""
WITH old AS (SELECT DISTINCT 'www.' || {sql_domain('url')} AS domain FROM pages WHERE starts_with(url, 'http:')),
seen AS (SELECT {sql_domain('url')} AS domain, min(page_id) AS first_page FROM pages GROUP BY 1),
new AS (SELECT seen.*, sha256(domain) AS h FROM seen WHERE domain <> '' AND 'www.' || domain NOT IN (SELECT domain FROM old))
SELECT 'old-' || domain AS source_id, domain, -1::BIGINT AS created_at FROM old
UNION ALL SELECT concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]), domain, first_page FROM new""")
def source_registry(spark, d):
    p = R.raw_pages(spark, d)
    old = p.filter(urls.scheme("url") == "http").select(F.concat(F.lit("www."), urls.registered_domain("url")).alias("domain")).distinct()
    old = old.select(F.concat(F.lit("old-"), "domain").alias("source_id"), "domain", F.lit(-1).cast("bigint").alias("created_at"))
    return ingest.register_sources(old, p, "url", "page_id")


@query("slug_lengths", f"""
SELECT page_id, length(CASE WHEN s = '' THEN 'page' ELSE s END) AS slug_chars FROM
 (SELECT page_id, trim(regexp_replace(lower(trim({R.sql_title('html')}, {BL})), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM pages)""")
def slug_lengths(spark, d):
    return R.raw_pages(spark, d).select("page_id", F.length(slug(H.title("html"))).cast("bigint").alias("slug_chars"))


@query("markdown_export", """
SELECT doc_id, sha1('https://h.example.org/' || doc_id)[1:10] AS short_hash, length(text) AS n_chars, md5(text) AS text_md5 FROM documents WHERE length(text) > 0""")
def markdown_export(spark, d):
    """Every document as a Markdown file, in two appends, and what is read back from the committed files."""
    path = f"{new_dir(spark, 'markdown')}/files"
    docs = read_table(spark, d, "documents").filter("length(text) > 0")
    url = F.concat(F.lit("https://h.example.org/"), F.col("doc_id").cast("string"))
    named = docs.select((F.col("doc_id") % 2).alias("half"), urls.export_name(url, F.lit("d")).alias("file_name"), "text", "doc_id")
    for half in (0, 1):
        markdown_files.write_markdown(named.filter(F.col("half") == half), path)
    back = markdown_files.read_markdown(spark, path)
    return named.select("doc_id", "file_name").join(back, "file_name").select(
        "doc_id", F.regexp_extract("file_name", r"-([0-9a-f]{10})\.md$", 1).alias("short_hash"),
        F.length("text").cast("bigint").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))
