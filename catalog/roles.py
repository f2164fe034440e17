"""The sample tables in the roles the operators expect, as DataFrames and as SQL text.

``sql_*`` functions build SQL expressions for the twins; they are written
independently of the Column helpers wherever the engines allow it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant import rules as RULES
from foliant.functions import html as H
from foliant.functions import urls as U
from foliant.functions.text import BLANKS, LINE_BREAK
from foliant.rules import PageRules
from foliant.schemas import read_table
from foliant.sources.captures import scan_pages

BL = "'" + BLANKS + "'"
NL = "'\n'"


def ts(base: str, minutes) -> F.Column:
    return F.timestamp_add("MINUTE", minutes.cast("bigint"), F.lit(base).cast("timestamp_ntz"))


# --- DataFrames -----------------------------------------------------------------


def text_table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_table(spark, d, name)


def pages(spark: SparkSession, d: str, with_text: bool = True) -> DataFrame:
    return scan_pages(text_table(spark, d, "pages") if with_text else read_table(spark, d, "pages"), with_text)


def raw_pages(spark: SparkSession, d: str, heavy: bool = False) -> DataFrame:
    return text_table(spark, d, "pages") if heavy else read_table(spark, d, "pages")


def documents(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source_id, url, title, text, lang, fetched_at."""
    t = text_table(spark, d, "documents")
    return t.select(
        "doc_id", F.col("source").alias("source_id"), doc_url().alias("url"),
        F.substring(F.split("text", "\n")[0], 1, 60).alias("title"), "text", "lang",
        ts("2024-01-01 00:00:00", F.col("doc_id")).alias("fetched_at"),
    )


def doc_url():
    """Even documents live under /carreras/, so the scoped search has something to find."""
    part = F.when(F.col("doc_id") % 2 == 0, F.lit("/carreras/")).otherwise(F.lit("/doc/"))
    return F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org"), part, F.col("doc_id").cast("string"))


def sources(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "documents")
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("bigint")
    return t.select("source").distinct().select(
        F.col("source").alias("source_id"), F.concat("source", F.lit(".example.org")).alias("domain"),
        ts("2023-06-01 00:00:00", n * 1440).alias("created_at"),
    )


def messages(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "conversations")
    return t.select(
        F.col("conv_id").alias("session_id"), "turn", "role", "text",
        F.concat(F.lit("src"), (F.col("conv_id") % 5).cast("string")).alias("source_id"),
        ts("2024-02-01 00:00:00", F.col("conv_id") * 600 + F.col("turn")).alias("created_at"),
    )


def crawl_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as labelled page results: job_id, position, outcome, priority, ts."""
    t = read_table(spark, d, "events")
    return crawl_columns(t)


def crawl_columns(t: DataFrame) -> DataFrame:
    e = F.col("event_type")
    outcome = (
        F.when(e == "error", "failed_fetch").when(e == "click", "accepted").when(e == "view", "blocked_host")
        .when(e == "signup", "invalid:too_short").otherwise("skipped:duplicate_content")
    )
    return t.select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("position"), outcome.alias("outcome"),
        (F.col("value") > 20).alias("priority"), "ts",
    )


# --- SQL --------------------------------------------------------------------------

DOCS = """docs AS (
  SELECT doc_id, source AS source_id,
         'https://' || source || '.example.org' || CASE WHEN doc_id % 2 = 0 THEN '/carreras/' ELSE '/doc/' END || doc_id AS url,
         substring(string_split(text, '
')[1], 1, 60) AS title, text, lang,
         TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS fetched_at
  FROM documents)"""
SOURCES = """srcs AS (
  SELECT source AS source_id, source || '.example.org' AS domain,
         TIMESTAMP '2023-06-01' + (regexp_extract(source, '(\\d+)$', 1)::BIGINT * 1440) * INTERVAL 1 MINUTE AS created_at
  FROM (SELECT DISTINCT source FROM documents))"""
MESSAGES = """msgs AS (
  SELECT conv_id AS session_id, turn, role, text, 'src' || (conv_id % 5) AS source_id,
         TIMESTAMP '2024-02-01' + (conv_id * 600 + turn) * INTERVAL 1 MINUTE AS created_at
  FROM conversations)"""
CRAWL = """crawl AS (
  SELECT user_id AS job_id, event_id AS position,
         CASE event_type WHEN 'error' THEN 'failed_fetch' WHEN 'click' THEN 'accepted' WHEN 'view' THEN 'blocked_host'
              WHEN 'signup' THEN 'invalid:too_short' ELSE 'skipped:duplicate_content' END AS outcome,
         value > 20 AS priority, ts
  FROM events)"""


def sql_any(x: str, tokens) -> str:
    return "(" + " OR ".join(f"contains({x}, '{t}')" for t in tokens) + ")" if tokens else "false"


def sql_first(x: str, tokens) -> str:
    listed = ", ".join(f"'{t}'" for t in tokens)
    return f"list_filter([{listed}], lambda t: contains({x}, t))[1]"


def sql_part(x: str, n: int) -> str:
    return f"regexp_extract(trim({x}, {BL}), '{U.URL_PATTERN}', {n})"


def sql_host(x: str) -> str:
    """Exact host of a URL or bare host."""
    raw = f"lower(trim({x}, {BL}))"
    url = (f"regexp_replace(regexp_replace(regexp_extract({raw}, '^[^:]*://([^/?#]*)', 1), '^.*@', ''), ':.*$', '')")
    return f"trim(CASE WHEN contains({raw}, '://') THEN {url} ELSE string_split({raw}, ':')[1] END, '.')"


def sql_domain(x: str) -> str:
    return f"regexp_replace({sql_host(x)}, '^www\\.', '')"


def sql_decoded(h: str) -> str:
    """The character references that the sample pages use; the ampersand comes last, so each is decoded once."""
    for name, value in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        h = f"replace({h}, '&{name};', '{value}')"
    return h


def sql_title(h: str) -> str:
    found = sql_decoded(f"regexp_extract({h}, '(?is)<title[^>]*>(.*?)</title>', 1)")
    return f"trim({found}, {BL})"


def sql_html_text(table: str, key: str, html: str) -> str:
    """SELECT key, text: the pattern form of HTML to text."""
    h = html
    steps = [
        (H.HIDDEN, " "), (H.NOISE, "\n"), (r"(?i)<h1\b[^>]*>", "\n# "), (r"(?i)<h2\b[^>]*>", "\n## "),
        (r"(?i)<h3\b[^>]*>", "\n### "), (r"(?i)<h[456]\b[^>]*>", "\n#### "), (r"(?i)<li\b[^>]*>", "\n- "),
        (H.BLOCK_END, "\n"), (H.ANY_TAG, ""),
    ]
    for pattern, repl in steps:
        h = f"regexp_replace({h}, '{pattern}', '{repl}', 'g')"
    h = sql_decoded(h)
    xs = (f"list_filter(list_transform(string_split_regex({h}, '{LINE_BREAK}'), "
          f"lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'), {BL})), "
          f"lambda x: x <> '' AND x <> '-' AND NOT regexp_matches(x, '^#{{1,4}}$'))")
    return (f"SELECT {key}, array_to_string(list_filter(xs, lambda x, i: i = 1 OR x <> xs[i - 1]), {NL}) AS text "
            f"FROM (SELECT {key}, {xs} AS xs FROM {table})")


def _sql_repeats() -> str:
    labels = ", ".join("'" + x.replace("'", "''") + "'" for x in RULES.STRUCTURAL_LABELS)
    free = f"k IN ({labels}) OR seen <= 2" if labels else "seen <= 2"
    return f"CASE WHEN contains(k, '{RULES.PRESS_MARK}') THEN seen <= 1 ELSE {free} END" if RULES.PRESS_MARK else free


PAGES = f"""ptext AS ({sql_html_text('pages', 'page_id', 'html')}),
pline AS (SELECT page_id, unnest(xs) AS line, generate_subscripts(xs, 1) AS pos
          FROM (SELECT page_id, list_transform(string_split_regex(text, '{LINE_BREAK}'), lambda x: trim(x, {BL})) AS xs FROM ptext)),
pseen AS (SELECT *, lower(line) AS k, row_number() OVER (PARTITION BY page_id, lower(line) ORDER BY pos) AS seen
          FROM pline WHERE line <> '' AND NOT regexp_matches(line, '^\\[?!\\[[^\\]]*\\]\\([^)]+\\)(\\]\\([^)]+\\))?$')),
pclean AS (SELECT page_id, trim(string_agg(line, {NL} ORDER BY pos), {BL}) AS content FROM pseen
           WHERE {_sql_repeats()} GROUP BY page_id),
p AS (SELECT page_id, url, html <> '' AS success, {sql_title('html')} AS title, html, text, coalesce(content, '') AS content
      FROM pages JOIN ptext USING (page_id) LEFT JOIN pclean USING (page_id))"""

# --- rules fitted to the invented sample text --------------------------------------

SAMPLE_GLOBS = RULES.BLOCK_GLOBS + ("*/es/*", "*utm_source=*", "*/en/9??", "https://m.*")

SAMPLE_RULES = PageRules(
    block_globs=SAMPLE_GLOBS,
    block_tokens=("utm_source=", "/es/9"),
    news_tokens=("/de/2", "/fr/3"),
    class_rules=(
        ("career_canonical", ("/en/1", "/en/2"), 1.0),
        ("procedure", ("/en/",), 0.90),
        ("regulation", ("/fr/", "/de/"), 0.85),
    ),
    career_signals=("ontion", "hethe", "inges", "tha the", "er the"),
    procedure_signals=("euxai", "tionle", "de la", "ndas", "der "),
    priority_tokens=("/en/", "page=2"),
    news_hints=("tion the", "de la que"),
    min_words=60,
)
