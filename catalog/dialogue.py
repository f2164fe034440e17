"""Conversation, access, evaluation and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import pages as P
from catalog import roles as R
from catalog.registry import query
from catalog.roles import BL, CRAWL, MESSAGES, SOURCES, sql_any
from catalog.documents import COUNTERS_SQL
from foliant import rules as RULES
from foliant.functions import answers as A
from foliant.operators import access, conversation, evaluate, metrics, sketches
from foliant.plans.lineage import new_dir
from foliant.schemas import EVAL_ITEM, read_table
from foliant.sources import captures
from foliant.streaming import ingest as stream
from foliant.streaming import keyed, sessions

LINE = "upper(role) || ': ' || text"


# --- history --------------------------------------------------------------------------


@query("history", f"""
WITH {MESSAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id, source_id ORDER BY created_at DESC) AS back FROM msgs WHERE role IN ('user', 'assistant'))
SELECT session_id, source_id, turn, row_number() OVER (PARTITION BY session_id, source_id ORDER BY created_at) AS position, md5({LINE}) AS line_md5 FROM r WHERE back <= 4""")
def history(spark, d):
    h = conversation.recent_history(R.messages(spark, d), 4, roles=("user", "assistant"))
    return h.select("session_id", "source_id", "turn", "position", F.md5(F.col("line").cast("binary")).alias("line_md5"))


@query("transcript", f"""
WITH {MESSAGES} SELECT * FROM (SELECT session_id, turn, role, created_at, row_number() OVER (PARTITION BY session_id, source_id ORDER BY created_at) AS position FROM msgs) WHERE position <= 3""")
def transcript(spark, d):
    return conversation.transcript(R.messages(spark, d), 3).select("session_id", "turn", "role", "created_at", "position")


@query("history_pack", f"""
WITH {MESSAGES}, r AS (SELECT *, {LINE} AS line, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC) AS back FROM msgs),
c AS (SELECT *, CASE WHEN length(line) <= 500 THEN line ELSE rtrim(substring(line, 1, 499), {BL}) || '…' END AS l FROM r WHERE back <= 12),
u AS (SELECT *, sum(length(l) + 1) OVER (PARTITION BY session_id ORDER BY created_at)::BIGINT AS used_chars FROM c)
SELECT session_id, turn, used_chars, md5(l) AS line_md5 FROM u WHERE used_chars <= 5000""")
def history_pack(spark, d):
    p = conversation.pack_history(R.messages(spark, d))
    return p.select("session_id", "turn", "used_chars", F.md5(F.col("line").cast("binary")).alias("line_md5"))


@query("latest_session", f"""
WITH {MESSAGES}, g AS (SELECT source_id, session_id, max(created_at) AS last_at FROM msgs WHERE role = 'user' GROUP BY 1, 2)
SELECT source_id, session_id, last_at FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY last_at DESC, session_id DESC) AS rn FROM g) WHERE rn = 1""")
def latest_session(spark, d):
    return conversation.latest_session(R.messages(spark, d))


@query("first_turn", f"""
WITH {MESSAGES}, g AS (SELECT DISTINCT session_id FROM msgs WHERE role = 'system')
SELECT session_id, turn, (row_number() OVER (PARTITION BY session_id, source_id ORDER BY created_at) = 1) AND session_id NOT IN (SELECT session_id FROM g) AS is_first_turn FROM msgs""")
def first_turn(spark, d):
    m = R.messages(spark, d)
    return conversation.first_turns(m, m.filter("role = 'system'")).select("session_id", "turn", "is_first_turn")


@query("rewrite_input", f"""
WITH {MESSAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC) AS back FROM msgs),
j AS (SELECT session_id, string_agg({LINE}, '\n' ORDER BY created_at) AS t FROM r WHERE back <= 6 GROUP BY 1)
SELECT session_id, length(right(t, 1500)) AS n_chars, md5(right(t, 1500)) AS input_md5 FROM j""")
def rewrite_input(spark, d):
    h = conversation.history_arrays(conversation.recent_history(R.messages(spark, d), 12), ["session_id"])
    t = h.select("session_id", A.rewrite_input(F.col("history")).alias("t"))
    return t.select("session_id", F.length("t").cast("bigint").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("input_md5"))


ANSWERED = """CASE WHEN (conv_id + turn) % 3 = 0 THEN 'Hola, ' || lower(text) WHEN (conv_id + turn) % 3 = 1 THEN text || '\n\nFuente: ' || role ELSE text END"""


def answered(spark, d):
    n = (F.col("conv_id") + F.col("turn")) % 3
    t = F.when(n == 0, F.concat(F.lit("Hola, "), F.lower("text"))).when(
        n == 1, F.concat("text", F.lit("\n\nFuente: "), "role")).otherwise(F.col("text"))
    return read_table(spark, d, "conversations").select("conv_id", "turn", "role", t.alias("answer"))


@query("answer_format", f"""
WITH a AS (SELECT conv_id, turn, trim({ANSWERED}, {BL}) AS t FROM conversations),
g AS (SELECT *, trim(regexp_replace(t, '^(?i:(hola|buenas|buen\\s+d[ií]a|buenas\\s+tardes|buenas\\s+noches))([,.:]|\\s)+', ''), {BL}) AS rest FROM a),
f AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN CASE WHEN t = '' THEN '{RULES.GREETING_EMPTY}' WHEN starts_with(lower(t), 'hola') OR starts_with(lower(t), 'buenas')
        OR starts_with(lower(t), 'buen dia') OR starts_with(lower(t), 'buen día') THEN t ELSE '{RULES.GREETING_LEAD}' || t END
      WHEN t = '' THEN '' WHEN rest = '' THEN t ELSE upper(rest[1:1]) || rest[2:] END AS x FROM g),
h AS (SELECT conv_id, turn, trim(x, {BL}) AS x, trim(regexp_replace(trim(x, {BL}), '{RULES.SOURCES_TAIL}', ''), {BL}) AS cut FROM f)
SELECT conv_id, turn, md5(CASE WHEN cut = '' THEN x ELSE cut END) AS answer_md5 FROM h""")
def answer_format(spark, d):
    out = A.hide_sources(A.conversational("answer", F.col("turn") == 0))
    return answered(spark, d).select("conv_id", "turn", F.md5(out.cast("binary")).alias("answer_md5"))


MARKS = ("de la que", "ontion the", "der ")


@query("decline_flags", f"""
SELECT conv_id, turn, text = '' OR {sql_any('lower(text)', RULES.DECLINE_MARKERS)} AS declined, text = '' OR {sql_any('lower(text)', RULES.PROBE_DECLINE_MARKERS)} AS probe_declined,
       text = '' OR {sql_any('lower(text)', MARKS)} AS marked FROM conversations""")
def decline_flags(spark, d):
    return read_table(spark, d, "conversations").select(
        "conv_id", "turn", A.looks_declined("text").alias("declined"), A.probe_declined("text").alias("probe_declined"),
        A.looks_declined("text", MARKS).alias("marked"))


@query("verify_gate", f"""
WITH p AS (SELECT conv_id, turn, text AS a, (conv_id + turn) % 12 AS n FROM conversations),
s AS (SELECT *, CASE WHEN n = 11 THEN 1.0 WHEN a = '' OR {sql_any('lower(a)', RULES.DECLINE_MARKERS)} THEN 1.0 ELSE least(greatest(n / 8.0 - 0.1, 0.0), 1.0) END AS g FROM p)
SELECT conv_id, turn, round(g, 6) AS groundedness, CASE WHEN n = 11 THEN 0 ELSE least(n, 5) END::BIGINT AS n_claims,
       md5(CASE WHEN g < {RULES.GROUNDED_MIN} THEN '{RULES.NO_EVIDENCE_RESPONSE}' ELSE a END) AS response_md5 FROM s""")
def verify_gate(spark, d):
    n = (F.col("conv_id") + F.col("turn")) % 12
    claims = F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), lambda i: F.col("text")))
    reply = F.when(n == 11, F.lit("{broken")).otherwise(F.to_json(F.struct(
        (n / 8.0 - 0.1).alias("groundedness"), claims.alias("unsupported_claims"))))
    g = A.groundedness_gate("text", reply)
    return read_table(spark, d, "conversations").select("conv_id", "turn", g.alias("g")).select(
        "conv_id", "turn", F.round("g.groundedness", 6).alias("groundedness"), F.size("g.unsupported_claims").cast("bigint").alias("n_claims"),
        F.md5(F.col("g.response").cast("binary")).alias("response_md5"))


@query("conv_groups", """
WITH i AS (SELECT conv_id * 1000 + turn AS item_id, CASE WHEN conv_id % 3 <> 0 THEN conv_id END AS c, turn FROM conversations),
k AS (SELECT *, coalesce(c::VARCHAR, '_single_' || item_id) AS group_key FROM i)
SELECT item_id, group_key, turn AS turn_order, min(item_id) OVER (PARTITION BY group_key) AS group_pos, count(*) OVER (PARTITION BY group_key) AS group_size FROM k""")
def conv_groups(spark, d):
    items = read_table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), F.when(F.col("conv_id") % 3 != 0, F.col("conv_id")).alias("conversation_id"),
        F.col("turn").alias("turn_number"), (F.col("conv_id") * 1000 + F.col("turn")).alias("position"))
    return conversation.group_items(items).select("item_id", "group_key", "turn_order", "group_pos", "group_size")


# --- access ------------------------------------------------------------------------------


@query("access_filter", f"""
WITH {SOURCES}, q AS (SELECT event_id, 'k' || user_id AS api_key, 'src' || (event_id % 20) AS source_id,
    CASE event_id % 7 WHEN 0 THEN 'http://localhost:3000' WHEN 1 THEN '' ELSE 'https://www.src' || (user_id % 25) || '.example.org/x' END AS origin FROM events WHERE event_type <> 'signup'),
g AS (SELECT DISTINCT 'k' || user_id AS api_key, 'src' || (event_id % 20) AS source_id FROM events WHERE event_type = 'signup')
SELECT q.event_id, q.origin = 'http://localhost:3000' OR regexp_extract(q.origin, '^https://www\\.([^/]*)', 1) IN (SELECT domain FROM srcs) AS allowed,
       EXISTS (SELECT 1 FROM g WHERE g.api_key = q.api_key AND g.source_id = q.source_id) AS granted FROM q""")
def access_filter(spark, d):
    e = read_table(spark, d, "events")
    key, src = F.concat(F.lit("k"), F.col("user_id").cast("string")), F.concat(F.lit("src"), (F.col("event_id") % 20).cast("string"))
    n = F.col("event_id") % 7
    req = e.filter("event_type <> 'signup'").select("event_id", key.alias("api_key"), src.alias("source_id"), F.when(
        n == 0, "http://localhost:3000").when(n == 1, "").otherwise(F.concat(F.lit("https://www.src"), (F.col("user_id") % 25).cast("string"), F.lit(".example.org/x"))).alias("origin"))
    users = e.select("user_id", key.alias("api_key")).distinct()
    grants = e.filter("event_type = 'signup'").select("user_id", src.alias("source_id")).distinct()
    ok = access.granted(req, users, grants).select("event_id", F.lit(True).alias("granted"))
    return access.allowed_requests(req, R.sources(spark, d), "origin").join(ok, "event_id", "left").select(
        "event_id", "allowed", F.coalesce("granted", F.lit(False)).alias("granted"))


UUID = "concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32])"


@query("source_lookup", f"""
WITH {SOURCES}, s AS (SELECT {UUID} AS source_id, domain FROM (SELECT domain, sha256(domain) AS h FROM srcs)),
q AS (SELECT event_id, user_id, sha256('src' || (user_id % 25) || '.example.org') AS h FROM events),
r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN upper({UUID}) WHEN 1 THEN 'www.src' || (user_id % 25) || '.example.org' WHEN 2 THEN '' ELSE 'nowhere.example.org' END AS ref,
        CASE WHEN event_id % 8 = 2 THEN 'https://src' || (user_id % 25) || '.example.org' ELSE '' END AS origin, 'https://www.src3.example.org/page' AS referer FROM q),
k AS (SELECT *, CASE WHEN event_id % 4 = 1 THEN ref[5:] WHEN event_id % 4 = 2 THEN CASE WHEN origin <> '' THEN origin[9:] ELSE 'src3.example.org' END ELSE ref END AS dom FROM r)
SELECT event_id, coalesce(a.source_id, b.source_id) AS source_id FROM k LEFT JOIN s a ON a.source_id = lower(k.ref) LEFT JOIN s b ON b.domain = k.dom""")
def source_lookup(spark, d):
    def as_uuid(c):
        h = F.sha2(c.cast("binary"), 256)
        return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])

    srcs = R.sources(spark, d).select(as_uuid(F.col("domain")).alias("source_id"), "domain", "created_at")
    dom = F.concat(F.lit("src"), (F.col("user_id") % 25).cast("string"), F.lit(".example.org"))
    n = F.col("event_id") % 4
    ref = F.when(n == 0, F.upper(as_uuid(dom))).when(n == 1, F.concat(F.lit("www."), dom)).when(n == 2, "").otherwise("nowhere.example.org")
    req = read_table(spark, d, "events").select(
        "event_id", ref.alias("ref"), F.when(F.col("event_id") % 8 == 2, F.concat(F.lit("https://"), dom)).otherwise("").alias("origin"),
        F.lit("https://www.src3.example.org/page").alias("referer"))
    return access.resolve_references(req, srcs).select("event_id", "source_id")


@query("user_sources", f"""
WITH {SOURCES}, w AS (SELECT user_id, 'src' || (event_id % 20) AS source_id, event_id, ts FROM events WHERE event_type = 'signup'),
g AS (SELECT user_id, source_id, coalesce(max(ts) FILTER (event_id % 3 = 0), min(ts)) AS linked_at FROM w GROUP BY 1, 2)
SELECT user_id, source_id, domain, linked_at FROM g LEFT JOIN srcs USING (source_id)""")
def user_sources(spark, d):
    e = read_table(spark, d, "events")
    wanted = e.filter("event_type = 'signup'").select(
        "user_id", F.concat(F.lit("src"), (F.col("event_id") % 20).cast("string")).alias("source_id"), F.col("ts").alias("created_at"), "event_id")
    # Grants that exist already stay as they are, although all of them are wanted again.
    stored = wanted.filter("event_id % 3 = 0").groupBy("user_id", "source_id").agg(F.max("created_at").alias("created_at"))
    grants = access.link_sources(stored, wanted)
    return access.user_sources(e.select("user_id").distinct(), grants, R.sources(spark, d))


@query("user_latest", """
WITH e AS (SELECT user_id, ts, CASE WHEN event_type = 'signup' THEN 'u' || json_extract_string(props, '$.k') || '@example.org' END AS email,
   CASE WHEN event_type = 'click' THEN epoch_ms(1700000000000 + event_id * 1001) END AS last_sign_in_at FROM events)
SELECT user_id, max_by(email, ts) FILTER (WHERE email IS NOT NULL) AS email, max_by(last_sign_in_at, ts) FILTER (WHERE last_sign_in_at IS NOT NULL) AS last_sign_in_at,
   max(ts) AS updated_at, min(ts) AS created_at FROM e GROUP BY user_id""")
def user_latest(spark, d):
    k = F.get_json_object("props", "$.k")
    e = read_table(spark, d, "events").select(
        "user_id", "ts", F.when(F.col("event_type") == "signup", F.concat(F.lit("u"), k, F.lit("@example.org"))).alias("email"),
        F.when(F.col("event_type") == "click", A.from_epoch_millis((F.lit(1700000000000) + F.col("event_id") * 1001).cast("string"))).alias("last_sign_in_at"))
    return access.latest_profiles(e, "user_id", "ts", ["email", "last_sign_in_at"])


# --- evaluation ------------------------------------------------------------------------------


def asked_documents(spark, d):
    """Every document with one of the benchmark's questions, dealt by id."""
    b = read_table(spark, d, "benchmark").select("item_id", F.col("text").alias("question"))
    docs = read_table(spark, d, "documents").withColumn("item_id", F.col("doc_id") % b.agg((F.max("item_id") + 1).alias("n")).scalar())
    return docs.join(b, "item_id")


@query("eval_prompts", f"""
WITH i AS (SELECT d.doc_id AS item_id, b.text AS q, string_split(b.text, ' ') AS facts, d.text AS ctx, d.text AS a
           FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT max(item_id) + 1 FROM benchmark)),
j AS (SELECT *, CASE WHEN length(ctx) <= {RULES.JUDGE_CONTEXT_CHARS} THEN ctx ELSE substring(ctx, 1, {RULES.JUDGE_CONTEXT_CHARS}) || '\n[…truncado…]' END AS c FROM i)
SELECT item_id, length(p) AS prompt_chars, md5(p) AS prompt_md5 FROM (SELECT item_id, 'Q: ' || trim(q, {BL}) || ' F: ' || to_json(facts)::VARCHAR || ' C: ' || c || ' A: ' || trim(a, {BL}) AS p FROM j)""")
def eval_prompts(spark, d):
    items = asked_documents(spark, d).select(
        F.col("doc_id").alias("item_id"), F.array("text").alias("context_chunks"), F.col("text").alias("answer"), "question",
        F.split("question", " ").alias("expected_facts"))
    p = evaluate.eval_prompts(items, "Q: {question} F: {expected_facts} C: {context} A: {answer}")
    return p.select("item_id", F.length("prompt").cast("bigint").alias("prompt_chars"), F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


@query("eval_scores", """
WITH s AS (SELECT source AS category, CASE WHEN lang <> 'es' THEN quality::DOUBLE END AS correctness, CASE WHEN lang <> 'es' THEN (n_chars % 9) / 8.0 END AS faithfulness,
   toxic = 1 AS hallucinated, CASE WHEN lang = 'es' THEN quality = 1 END AS refusal_correct, n_chars > 5000 AS err FROM labels JOIN documents USING (doc_id))
SELECT category, grouping(category)::BIGINT AS is_global, count(*) AS n, round(avg(correctness), 3) AS correctness_avg, round(avg(faithfulness), 3) AS faithfulness_avg,
  round(avg(CASE WHEN hallucinated THEN 1.0 ELSE 0.0 END), 3) AS hallucination_rate, round(avg(CASE WHEN refusal_correct THEN 1.0 WHEN NOT refusal_correct THEN 0.0 END), 3) AS refusal_correct_rate,
  count(*) FILTER (WHERE err) AS errors FROM s GROUP BY GROUPING SETS ((category), ())""")
def eval_scores(spark, d):
    j = read_table(spark, d, "labels").join(read_table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), "doc_id")
    judged = F.col("lang") != "es"
    s = j.select(
        F.col("source").alias("category"), F.when(judged, F.col("quality").cast("double")).alias("correctness"),
        F.when(judged, (F.col("n_chars") % 9) / 8.0).alias("faithfulness"), (F.col("toxic") == 1).alias("hallucinated"),
        F.when(~judged, F.col("quality") == 1).alias("refusal_correct"), F.when(F.col("n_chars") > 5000, "timeout").alias("error"))
    return evaluate.eval_metrics(s)


PROBE = """p AS (SELECT doc_id AS id, source AS category, quality = 1 AS ok, n_chars / 1000.0 AS duration_s, CASE WHEN toxic = 0 THEN (doc_id % 10) / 10.0 END AS groundedness
  FROM labels JOIN documents USING (doc_id)),
su AS (SELECT category, grouping(category)::BIGINT AS is_global, count(*) AS total, count(*) FILTER (WHERE ok) AS ok, round(avg(duration_s), 2)::DOUBLE AS avg_duration_s,
  round(coalesce(avg(groundedness), 0.0), 3)::DOUBLE AS avg_groundedness FROM p GROUP BY GROUPING SETS ((category), ()))"""


def probe_rows(spark, d):
    j = read_table(spark, d, "labels").join(read_table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return j.select(F.col("doc_id").alias("id"), F.col("source").alias("category"), (F.col("quality") == 1).alias("ok"), (F.col("n_chars") / 1000.0).alias("duration_s"),
                    F.when(F.col("toxic") == 0, (F.col("doc_id") % 10) / 10.0).alias("groundedness"))


@query("probe_summary", f"""
WITH {PROBE} SELECT *, total - ok AS fail, CASE WHEN is_global = 1 THEN round(ok * 100.0::DOUBLE / total, 2) ELSE round(ok * 100.0::DOUBLE / total, 1) END AS ok_pct FROM su""")
def probe_summary(spark, d):
    return evaluate.probe_summary(probe_rows(spark, d))


@query("probe_worst", f"""
WITH {PROBE} SELECT category, total, ok, total - ok AS fail, round((total - ok)::DOUBLE / total, 6) AS fail_rate FROM su WHERE is_global = 0
ORDER BY fail_rate DESC, total, category LIMIT 15""")
def probe_worst(spark, d):
    return evaluate.worst_categories(evaluate.probe_summary(probe_rows(spark, d))).select("category", "total", "ok", "fail", "fail_rate")


@query("run_compare", """
WITH m AS (SELECT doc_id % 6 AS stage, round(avg(quality), 6) AS correctness, round(avg(toxic), 6) AS hallucination FROM labels GROUP BY 1),
x AS (SELECT *, round(correctness - lag(correctness) OVER (ORDER BY stage), 6) AS correctness_delta, round(hallucination - lag(hallucination) OVER (ORDER BY stage), 6) AS hallucination_delta FROM m)
SELECT *, NOT (coalesce(correctness_delta, 0) < -0.05 OR coalesce(hallucination_delta, 0) > 0) AS gate_passed FROM x""")
def run_compare(spark, d):
    m = read_table(spark, d, "labels").groupBy((F.col("doc_id") % 6).alias("stage")).agg(
        F.round(F.avg("quality"), 6).alias("correctness"), F.round(F.avg("toxic"), 6).alias("hallucination"))
    return evaluate.compare_runs(m)


@query("resume_anti", """
SELECT doc_id, 'remaining' AS state FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'failed' FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def resume_anti(spark, d):
    items = read_table(spark, d, "documents").select("doc_id")
    done = read_table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("ok"))
    return evaluate.remaining(items, done, "doc_id").withColumn("state", F.lit("remaining")).unionByName(
        evaluate.failed_only(items, done, "doc_id").withColumn("state", F.lit("failed")))


@query("latency_p95", "SELECT round(quantile_cont(value, 0.95), 6) AS p95 FROM events")
def latency_p95(spark, d):
    return evaluate.latency_p95(read_table(spark, d, "events"), "value")


@query("default_judge", f"""
WITH i AS (SELECT d.doc_id, d.lang = 'es' AS refusal, list_distinct(list_filter(string_split_regex(lower(b.text), '[^\\p{{L}}0-9]+'), lambda x: x <> '')) AS ws,
     string_split_regex(lower(d.text), '[^\\p{{L}}0-9]+') AS cs, string_split(d.text, ' ')[1:20] AS fs, lower(trim(b.text, {BL})) AS a
     FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT max(item_id) + 1 FROM benchmark))
SELECT doc_id, CASE WHEN NOT refusal THEN round(len(list_filter(fs, lambda f: contains(a, lower(f))))::DOUBLE / len(fs), 6) END AS correctness,
       CASE WHEN NOT refusal THEN round(len(list_intersect(ws, cs))::DOUBLE / len(ws), 6) END AS faithfulness, contains(a, lower(fs[1])) AS hallucinated,
       CASE WHEN NOT refusal THEN 'not asked' WHEN {sql_any("a", RULES.DECLINE_MARKERS)} THEN 'true' ELSE 'false' END AS refusal_correct FROM i""")
def default_judge(spark, d):
    first = F.slice(F.split("text", " "), 1, 20)
    items = asked_documents(spark, d).select(
        F.col("doc_id").alias("id"), F.when(F.col("lang") == "es", "out_of_scope").otherwise("factual").alias("category"),
        F.lit("easy").alias("difficulty"), F.lit(False).alias("expects_clarification"),
        F.col("question").alias("answer"), F.lit("").alias("error"), F.lit(0.0).alias("elapsed_ms"), F.array("text").alias("context_chunks"),
        first.alias("expected_facts"), F.array(first[0]).alias("must_not_contain"))
    return evaluate.score_items(items).select(
        F.col("id").alias("doc_id"), F.round("correctness", 6).alias("correctness"), F.round("faithfulness", 6).alias("faithfulness"),
        "hallucinated", F.coalesce(F.col("refusal_correct").cast("string"), F.lit("not asked")).alias("refusal_correct"))


@query("citation_hits", """
SELECT doc_id AS query_id, CASE doc_id % 3 WHEN 2 THEN 1 ELSE 2 END::BIGINT AS n_cited, CASE doc_id % 3 WHEN 2 THEN 0 ELSE 1 END::BIGINT AS n_hits,
       doc_id % 3 < 2 AS hit, CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END::BIGINT AS first_hit FROM documents WHERE doc_id % 7 > 0""")
def citation_hits(spark, d):
    """Answers citing the right page first, second or not at all; tracking parameters and slashes do not matter."""
    n, k = F.col("doc_id").cast("string"), F.col("doc_id") % 3
    right, noisy = F.concat(F.lit("https://h.example.org/a/"), n), F.concat(F.lit("HTTPS://h.example.org/a/"), n, F.lit("/?utm_source=x#top"))
    other = F.concat(F.lit("https://h.example.org/b/"), n)
    rows = read_table(spark, d, "documents").select(
        F.col("doc_id").alias("query_id"), F.when(k == 0, F.array(noisy, other, right)).when(k == 1, F.array(other, noisy)).otherwise(F.array(other, other)).alias("urls"),
        F.when(F.col("doc_id") % 7 > 0, F.array(right, F.lit("https://h.example.org/c"))).alias("ground_truth_urls"))
    return evaluate.citation_hits(rows.select("query_id", "urls"), rows.select("query_id", "ground_truth_urls"))


@query("probe_policy", f"""
WITH p AS (SELECT doc_id, doc_id % 2 = 0 AS expects, text AS a FROM documents),
j AS (SELECT doc_id, expects, a = '' OR {sql_any("lower(a)", RULES.PROBE_DECLINE_MARKERS)} OR doc_id % 3 = 0 AS declined FROM p)
SELECT doc_id, declined AS decline, expects = declined AS ok FROM j""")
def probe_policy(spark, d):
    """A decline is right exactly when it was expected; every third answer opens with one."""
    opening = F.when(F.col("doc_id") % 3 == 0, F.lit(RULES.PROBE_DECLINE_MARKERS[0] + " ")).otherwise("")
    rows = read_table(spark, d, "documents").select("doc_id", F.concat(opening, "text").alias("answer"), (F.col("doc_id") % 2 == 0).alias("expects_decline"))
    return evaluate.judge_probe(rows).select("doc_id", "decline", "ok")


@query("eval_items", """
SELECT item_id AS id, text AS question, len(string_split(text, ' ')) AS n_facts FROM benchmark WHERE item_id % 3 = 0 ORDER BY item_id::VARCHAR LIMIT 30""")
def eval_items(spark, d):
    """The evaluation set written as JSON lines, read back, and cut to wanted ids and a first number of items."""
    path = f"{new_dir(spark, 'eval')}/items"
    b = read_table(spark, d, "benchmark")
    b.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), F.split("text", " ").alias("expected_facts")).write.json(path)
    items = captures.read_jsonl(spark, path, EVAL_ITEM)
    ids = [str(r.item_id) for r in b.filter("item_id % 3 = 0").select("item_id").collect()]  # the ids a user names
    return evaluate.select_items(items, ids, 30).select(F.col("id").cast("bigint").alias("id"), "question", F.size("expected_facts").cast("bigint").alias("n_facts"))


@query("crawl_summary", f"""
WITH {CRAWL}, x AS (SELECT *, position % 5 = 0 AS doc, position % 4 AS links FROM crawl),
p AS (SELECT job_id, count(*) FILTER (NOT doc AND (outcome = 'accepted' OR starts_with(outcome, 'skipped:'))) AS accepted_valid_pages,
  coalesce(sum(links) FILTER (NOT doc), 0)::BIGINT AS document_links_found, count(*) FILTER (doc) AS documents_processed, count(*) FILTER (doc AND outcome = 'accepted') AS documents_saved,
  count(*) FILTER (doc AND (starts_with(outcome, 'skipped:') OR starts_with(outcome, 'invalid:'))) AS documents_skipped,
  count(*) FILTER (doc AND outcome = 'failed_fetch') AS document_errors, round((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 / 1000.0, 3) AS wall_seconds FROM x GROUP BY job_id)
SELECT *, CASE WHEN accepted_valid_pages >= 20 THEN 'target_reached' ELSE 'completed' END AS finished_reason FROM p""")
def crawl_summary(spark, d):
    rows = R.crawl_events(spark, d).withColumns({"is_document": F.col("position") % 5 == 0, "document_links": F.col("position") % 4})
    return metrics.crawl_summary(rows, 20).select(
        "job_id", F.coalesce("accepted_valid_pages", F.lit(0)).alias("accepted_valid_pages"), "document_links_found", "documents_processed", "documents_saved",
        "documents_skipped", "document_errors", "wall_seconds", "finished_reason")


@query("document_gate", """
SELECT doc_id, doc_id % 4 < 2 AND n_chars <= 2000 AS kept FROM documents""")
def document_gate(spark, d):
    """PDF by type or by name, and not too large; rejected captures stay visible."""
    k = F.col("doc_id") % 4
    rows = read_table(spark, d, "documents").select(
        "doc_id", F.when(k == 0, "https://h.example.org/a.PDF").otherwise("https://h.example.org/a").alias("url"),
        F.when(k == 1, "application/pdf; charset=x").when(k == 2, "text/html").alias("content_type"), F.col("n_chars").alias("size"))
    kept = captures.document_gate(rows, max_bytes=2000).select("doc_id", F.lit(True).alias("kept"))
    return rows.join(kept, "doc_id", "left").select("doc_id", F.coalesce("kept", F.lit(False)).alias("kept"))


@query("sketch_ranges", """
WITH e AS (SELECT *, value IS NOT NULL AND value > 0 AS timed FROM events WHERE ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20')
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS exact_sessions, true AS sessions_close, true AS p50_close, true AS p95_close FROM e GROUP BY 1""")
def sketch_ranges(spark, d):
    """Daily sketches merged for a range of days, held against the exact numbers of that range."""
    e = read_table(spark, d, "events")
    asked = sketches.merged(sketches.daily(e, ["event_type"], "ts", "user_id", "value"), ["event_type"], F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date"))
    guess = sketches.estimates(asked)
    rows = e.filter(F.to_date("ts").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date")))
    both = rows.join(guess, "event_type")
    share = lambda q: F.avg((F.col("value") <= F.col(q)).cast("double"))
    near = lambda q, p: (F.abs(share(q) - p) <= sketches.RANK_ERROR + 1 / F.count("value"))
    exact = F.count_distinct("user_id")
    return both.groupBy("event_type").agg(
        F.first("n").alias("n"), exact.alias("exact_sessions"), (F.abs(F.first("n_sessions") - exact) <= sketches.COUNT_ERROR * exact).alias("sessions_close"),
        near("q50", 0.5).alias("p50_close"), near("q95", 0.95).alias("p95_close"))


# --- streaming --------------------------------------------------------------------------------


@query("stream_metrics", f"WITH {CRAWL} {COUNTERS_SQL}")
def stream_metrics(spark, d):
    """Counters kept by a streaming aggregate over the event files, read back after the last trigger."""
    schema = read_table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")  # a file or a folder of files
    base = new_dir(spark, "counters")
    done = stream.write_counters(stream.running_counters(R.crawl_columns(raw)), f"{base}/table", f"{base}/checkpoint")
    done.awaitTermination()
    return stream.read_counters(spark, f"{base}/table").drop("update_seq")


@query("stream_sessions", f"""
WITH {MESSAGES} SELECT session_id, min(created_at) AS created_at, max(created_at) AS last_activity_at, count(*) AS turns, bool_or(role = 'assistant') AS greeting_sent FROM msgs GROUP BY 1""")
def stream_sessions(spark, d):
    """Session states kept by a streaming aggregate over the conversation table."""
    schema = read_table(spark, d, "conversations").schema
    raw = spark.readStream.schema(schema).parquet(f"{d}/conversations.parquet*")  # a file or a folder of files
    msgs = raw.select(
        F.col("conv_id").alias("session_id"), R.ts("2024-02-01 00:00:00", F.col("conv_id") * 600 + F.col("turn")).alias("created_at"), "role")
    base = new_dir(spark, "sessions")
    stream.write_counters(sessions.session_states(msgs), f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return stream.read_counters(spark, f"{base}/table").drop("update_seq")


def slices(spark, d, table, order, n=2):
    """The sample table written in ``n`` steps, as files that arrive one after the other; yields the folder after each."""
    rows = read_table(spark, d, table)
    inbox = f"{new_dir(spark, 'inbox')}/in"
    low, high = rows.agg(F.min(order), F.max(order)).first()
    for k in range(n):
        edge = lambda i: low + (high - low) * i / n
        part = rows.filter(F.col(order) >= edge(k)) if k else rows
        (part.filter(F.col(order) < edge(k + 1)) if k < n - 1 else part).write.parquet(f"{inbox}/p{k}")
        yield rows.schema, f"{inbox}/*"


@query("stream_ingest", f"""
WITH {P.BUILT} SELECT page_id AS doc_id, canonical_url, CASE WHEN final <> 'accepted' THEN replace(final, 'skipped:', '')
  WHEN page_id = min(page_id) OVER (PARTITION BY canonical_url) THEN 'saved' ELSE 'updated' END AS decision FROM b""")
def stream_ingest(spark, d):
    """Pages arriving in two steps, decided by the state of their hashes and URLs."""
    return ingested(spark, d)[1].select("doc_id", "canonical_url", "decision")


def ingested(spark, d):
    base = new_dir(spark, "ingested")
    host = P.allowed_host()
    for schema, inbox in slices(spark, d, "pages", "page_id"):
        keyed.ingest(stream.read_capture_stream(spark, inbox, schema), f"{base}/out", f"{base}/checkpoint", R.SAMPLE_RULES, host).awaitTermination()
    return f"{base}/out", spark.read.parquet(f"{base}/out/decisions").drop("batch")


@query("stream_documents", f"""
WITH {P.BUILT}, last AS (SELECT max(page_id) AS page_id FROM b WHERE final = 'accepted' GROUP BY canonical_url)
SELECT page_id AS doc_id, canonical_url, h AS content_hash, length(content) AS n_chars, true AS has_chunks FROM b SEMI JOIN last USING (page_id)""")
def stream_documents(spark, d):
    """What the stream has stored in the end: the newest version of every URL, with its chunks."""
    path, _ = ingested(spark, d)
    chunked = keyed.current_children(spark, path, "chunks").select("doc_id").distinct().withColumn("has_chunks", F.lit(True))
    docs = keyed.current_documents(spark, path).join(chunked, "doc_id", "left")
    return docs.select("doc_id", "canonical_url", "content_hash", F.length("content").cast("bigint").alias("n_chars"),
                       F.coalesce("has_chunks", F.lit(False)).alias("has_chunks"))


@query("stream_links", f"""
WITH {P.HREFS_SQL} SELECT dst_url, min({{'p': page_id, 'n': position}}).p AS first_page_id, min({{'p': page_id, 'n': position}}).n AS first_position FROM lk GROUP BY 1""")
def stream_links(spark, d):
    """Link targets of pages arriving in two steps, each passed on once."""
    base = new_dir(spark, "links")
    for schema, inbox in slices(spark, d, "pages", "page_id"):
        found = keyed.first_links(stream.read_capture_stream(spark, inbox, schema))
        found.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(
            availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("stream_periods", """
WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR AS new FROM events WHERE ts IS NOT NULL),
p AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT 'u' || user_id AS session_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS turns FROM p GROUP BY user_id, k""")
def stream_periods(spark, d):
    """Periods of activity, closed by the next event or by the timer; one late event of another session moves the clock on."""
    base = new_dir(spark, "periods")
    last = None
    for schema, inbox in slices(spark, d, "events", "ts"):
        last = schema, inbox
        _periods(spark, schema, inbox, base)
    end = read_table(spark, d, "events").agg(F.max("ts").alias("m")).select(
        F.lit(-1).cast("bigint").alias("user_id"), (F.col("m") + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in last[0] if f.name not in ("user_id", "ts")]
    end.select("*", *missing).select(*last[0].names).write.parquet(last[1].replace("*", "end"))
    _periods(spark, *last, base)
    out = spark.read.parquet(f"{base}/out").filter("session_id <> 'u-1'")
    return out.select("session_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("started_at", "ended_at")], "turns")


def _periods(spark, schema, inbox, base):
    raw = spark.readStream.schema(schema).parquet(inbox)
    rows = raw.filter(F.col("ts").isNotNull()).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), F.col("ts").cast("timestamp").alias("created_at"))
    closed = keyed.closed_sessions(rows, 6 * 3_600_000)
    closed.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(
        availableNow=True).start().awaitTermination()
