"""Page filters, classes and outcomes (row-local: one pass, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant import rules as R
from foliant.functions import urls
from foliant.functions.text import (
    col, contains_any, count_contained, first_contained, strip, text_or_empty, word_count,
)
from foliant.operators.cleaning import clean_lines
from foliant.plans.once import with_columns_once
from foliant.rules import PageRules


def is_news(url, title, content, rules: PageRules = PageRules()) -> Column:
    u = F.lower(strip(text_or_empty(url)))
    t = F.lower(text_or_empty(title))
    head = F.substring(F.lower(strip(text_or_empty(content))), 1, rules.news_chars)
    hit = (
        contains_any(u, rules.news_url_tokens)
        | contains_any(t, rules.news_hints)
        | contains_any(head, rules.news_hints)
    )
    return ~contains_any(u, rules.news_exempt) & hit


def pdf_authority(url, title, rules: PageRules = PageRules()) -> Column:
    hay = F.concat_ws(" ", F.lower(text_or_empty(url)), F.lower(text_or_empty(title)))
    out = None
    for tokens, score in rules.pdf_rules:
        hit = contains_any(hay, tokens)
        out = F.when(hit, F.lit(score)) if out is None else out.when(hit, F.lit(score))
    default = F.lit(R.PDF_DEFAULT_AUTHORITY)
    return default if out is None else out.otherwise(default)


def _result(page_type, score, blocked, reason) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_col(page_type).alias("page_type"), as_col(score).cast("double").alias("authority_score"),
        as_col(blocked).alias("should_block"), as_col(reason).alias("reason"),
    )


def classify(url, title, rules: PageRules = PageRules()) -> Column:
    """Struct(page_type, authority_score, should_block, reason); first matching phase wins."""
    u = F.lower(strip(text_or_empty(url)))
    out = (
        F.when(
            contains_any(u, rules.block_tokens),
            _result("utility_noise", 0.0, True,
                    F.concat(F.lit("blocked:"), first_contained(u, rules.block_tokens))),
        )
        .when(urls.path(u).isin("", "/"), _result("homepage", 0.15, True, "root_path"))
        .when(
            contains_any(u, rules.news_tokens),
            _result("news_blocked", 0.0, True,
                    F.concat(F.lit("news_blocked:"), first_contained(u, rules.news_tokens))),
        )
        .when(urls.is_document_link(u), _result("pdf_document", pdf_authority(u, title, rules), False, ""))
    )
    for page_type, tokens, score in rules.class_rules:
        out = out.when(contains_any(u, tokens), _result(page_type, score, False, ""))
    name, score = rules.default_class
    return out.otherwise(_result(name, score, False, ""))


def upgrade_by_content(base: Column, url, title, content, rules: PageRules = PageRules()) -> Column:
    """Raise the class when the text carries at least two career or procedure phrases."""
    body = F.substring(F.lower(text_or_empty(content)), 1, rules.upgrade_chars)
    hay = F.concat_ws(" ", F.lower(text_or_empty(url)), F.lower(text_or_empty(title)), body)
    career = count_contained(hay, rules.career_signals) >= 2
    procedure = count_contained(hay, rules.procedure_signals) >= 2
    return (
        F.when(base["should_block"], base)
        .when(
            ~base["page_type"].isin("career_canonical", "offer_canonical") & career,
            _result("career_canonical", 0.92, False, "content_upgrade:career_signals"),
        )
        .when(
            (base["page_type"] != "procedure") & procedure,
            _result("procedure", F.greatest(base["authority_score"], F.lit(0.85)), False,
                    "content_upgrade:procedure_signals"),
        )
        .otherwise(base)
    )


def invalid_reason(url, title, content, base: Column, rules: PageRules = PageRules()) -> Column:
    """Why a page is unusable (null when it is fine); checks apply in this order."""
    body = text_or_empty(content)
    norm = F.lower(strip(body))
    return (
        F.when(body == "", F.lit("empty_content"))
        .when(norm == "", F.lit("blank_content"))
        .when(urls.path(F.lower(text_or_empty(url))).isin("", "/"), F.lit("root_path"))
        .when(contains_any(norm, rules.not_found), F.lit("not_found_page"))
        .when(word_count(norm) < max(1, rules.min_words), F.lit("too_short"))
        .when(
            base["should_block"] & (base["page_type"] == "news_blocked"),
            F.concat(F.lit("classifier_blocked:"), base["reason"]),
        )
        .when(is_news(url, title, norm, rules), F.lit("news_blocked"))
    )


def ingest_reason(url, title, clean, allowed_host, rules: PageRules = PageRules()) -> Column:
    """Second gate, on cleaned text (null = go on)."""
    expected = urls.host_exact(allowed_host if isinstance(allowed_host, Column) else F.lit(allowed_host))
    actual = urls.host_exact(urls.netloc(url))
    text = text_or_empty(clean)
    return (
        F.when((expected != "") & (actual != expected), F.lit("host_mismatch"))
        .when(text == "", F.lit("empty_content"))
        .when(contains_any(F.lower(text), rules.not_found), F.lit("not_found_content"))
        .when(is_news(url, title, text, rules), F.lit("news_blocked"))
    )


def classify_pages(pages: DataFrame, rules: PageRules = PageRules(), content: str = "text") -> DataFrame:
    """Adds page_type, authority_score, should_block and reason (content upgrade included)."""
    with_base = pages.withColumn("_base", classify(F.col("url"), F.col("title"), rules))
    final = with_base.withColumn(
        "_class", upgrade_by_content(F.col("_base"), F.col("url"), F.col("title"), F.col(content), rules)
    )
    return final.select(
        *pages.columns,
        *[F.col("_class")[f].alias(f) for f in ("page_type", "authority_score", "should_block", "reason")],
    )


def page_outcomes(
    pages: DataFrame, rules: PageRules, allowed_host: Column | str, content: str = "text",
) -> DataFrame:
    """Label every captured page with what the crawl and ingest gates decide about it.

    Outcomes: ``blocked_host``, ``blocked_pattern``, ``failed_fetch``, ``invalid:<reason>``,
    ``skipped:<reason>`` (the ingest gate, on the cleaned text, which comes as ``content``) or ``accepted``.  ``allowed_host`` may be a column (one
    crawl per host) or a literal.
    """
    host = allowed_host if isinstance(allowed_host, Column) else F.lit(allowed_host)
    # The folded and the cleaned text are used by several checks; as own columns they are computed once.
    df = with_columns_once(pages, {"content": clean_lines(content)}).withColumns({
        "_base": classify(F.col("url"), F.col("title"), rules), "_norm": F.lower(strip(text_or_empty(content))),
    })
    body = F.when(F.col(content) == "", F.lit("")).otherwise(
        F.when(F.col("_norm") == "", F.lit(" ")).otherwise(F.col("_norm")))
    invalid = invalid_reason(F.col("url"), F.col("title"), body, F.col("_base"), rules)
    gate = ingest_reason(F.col("url"), F.col("title"), F.col("content"), host, rules)
    df = df.withColumns({
        "_host_ok": urls.host_allowed(F.col("url"), host),
        "_invalid": invalid,
        "_gate": gate,
        "_class": upgrade_by_content(F.col("_base"), F.col("url"), F.col("title"), F.col(content), rules),
    })
    outcome = (
        F.when(~F.col("_host_ok"), F.lit("blocked_host"))
        .when(urls.url_blocked("url", rules.block_globs), F.lit("blocked_pattern"))
        .when(~F.col("success"), F.lit("failed_fetch"))
        .when(F.col("_invalid").isNotNull(), F.concat(F.lit("invalid:"), F.col("_invalid")))
        .when(F.col("_gate").isNotNull(), F.concat(F.lit("skipped:"), F.col("_gate")))
        .otherwise(F.lit("accepted"))
    )
    score = F.col("_class")["authority_score"]
    return with_columns_once(df, {
        "outcome": outcome,
        "priority": urls.matches_priority(F.col("url"), F.col("title"), rules.priority_tokens),
        "page_type": F.col("_class")["page_type"],
        # A stored score of zero falls back to one half.
        "authority_score": F.when(score == 0.0, F.lit(0.5)).otherwise(score),
    }).select(*pages.columns, "content", "outcome", "priority", "page_type", "authority_score")


def split_by_host(pages: DataFrame, allowed_host: Column | str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of the exact-host filter."""
    ok = urls.host_allowed(F.col("url"), allowed_host)
    return pages.filter(ok), pages.filter(~ok)


def program_page_gates(df: DataFrame) -> DataFrame:
    """Adds the fact-extraction gates; needs url, title, content, page_type, program_name."""
    from foliant.functions import facts as FX

    return df.withColumns({
        "is_canonical": FX.is_canonical(col("url")),
        "is_program_page": FX.is_program_page(col("page_type"), col("url")),
        "is_fact_source": FX.is_fact_source(col("page_type"), col("url")),
        "is_year_source": FX.is_year_source(col("page_type"), col("url")),
        "has_signals": FX.has_signals(col("url"), col("title"), col("content"), col("program_name")),
    })
