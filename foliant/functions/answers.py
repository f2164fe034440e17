"""Column rules for answers: decline detection, greeting, source hiding, prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant import rules
from foliant.functions.text import (
    clip, clip_at_space, contains_any, cut_marked, rstrip, strip, text_or_empty,
)


def looks_declined(answer: Column | str, markers: Sequence[str] = rules.DECLINE_MARKERS) -> Column:
    a = text_or_empty(answer)
    return (a == "") | contains_any(F.lower(a), markers)


def probe_declined(answer: Column | str) -> Column:
    return looks_declined(answer, rules.PROBE_DECLINE_MARKERS)


def hide_sources(answer: Column | str) -> Column:
    a = strip(text_or_empty(answer))
    cut = strip(F.regexp_replace(a, rules.SOURCES_TAIL, ""))
    return F.when(cut == "", a).otherwise(cut)


def add_greeting(answer: Column | str) -> Column:
    a = strip(text_or_empty(answer))
    low = F.lower(a)
    greeted = F.lit(False)
    for g in rules.GREETING_STARTS:
        greeted = greeted | low.startswith(g)
    return (
        F.when(a == "", F.lit(rules.GREETING_EMPTY))
        .when(greeted, a)
        .otherwise(F.concat(F.lit(rules.GREETING_LEAD), a))
    )


def strip_greeting(answer: Column | str) -> Column:
    a = strip(text_or_empty(answer))
    rest = strip(F.regexp_replace(a, rules.GREETING_STRIP, ""))
    return (
        F.when(rest == "", a)
        .otherwise(F.concat(F.upper(F.substring(rest, 1, 1)), F.substr(rest, F.lit(2))))
    )


def conversational(answer: Column | str, first_turn: Column | str) -> Column:
    """First turn gets a greeting; later turns lose a repeated one."""
    from foliant.functions.text import col

    a = strip(text_or_empty(answer))
    return F.when(col(first_turn), add_greeting(a)).when(a == "", F.lit("")).otherwise(strip_greeting(a))


def context_block(url, title, fetched_at, context, chunk) -> Column:
    ctx, body = strip(text_or_empty(context)), strip(text_or_empty(chunk))
    content = F.when(ctx == "", body).otherwise(F.concat(ctx, F.lit("\n\n"), body))
    fetched = F.coalesce(F.date_format(fetched_at, "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    return F.concat(
        F.lit("URL: "), strip(text_or_empty(url)), F.lit("\nTitulo: "), strip(text_or_empty(title)),
        F.lit("\nFetchedAt: "), fetched, F.lit("\nContenido: "), content,
    )


def rewrite_input(history: Column, items: int = rules.REWRITE_ITEMS, chars: int = rules.REWRITE_CHARS) -> Column:
    """Last turns joined by line, last ``chars`` characters kept."""
    joined = F.array_join(F.slice(history, -F.least(F.size(history), F.lit(items)), F.lit(items)), "\n")
    joined = F.when(F.size(history) == 0, F.lit("")).otherwise(joined)
    return F.when(F.length(joined) > chars, F.right(joined, F.lit(chars))).otherwise(joined)


def resolved_query(query: Column | str, rewritten: Column | str) -> Column:
    r = strip(text_or_empty(rewritten))
    return F.when(r == "", strip(text_or_empty(query))).otherwise(
        clip_at_space(r, rules.REWRITE_OUTPUT_CHARS)
    )


def build_prompt(system: str, history_text: Column, context_text: Column, query: Column,
                 max_chars: int = rules.PROMPT_CHARS) -> Column:
    """System text, history, context and question; only the context is ever trimmed."""
    prefix = F.concat(
        F.lit(system + "\n\nHistorial reciente:\n"), history_text, F.lit("\n\nContexto recuperado:\n")
    )
    tail = F.concat(F.lit("\n\nPregunta del usuario:\n"), query)
    budget = F.greatest(F.lit(max_chars) - F.length(prefix) - F.length(tail), F.lit(rules.PROMPT_MIN_CONTEXT))
    fitted = F.when(F.length(context_text) <= budget, context_text).otherwise(
        F.concat(rstrip(F.substr(context_text, F.lit(1), budget - 1)), F.lit("…"))
    )
    return F.concat(prefix, fitted, tail)


def verify_context(blocks: Column, max_chars: int = rules.CONTEXT_CHARS) -> Column:
    joined = F.array_join(F.filter(blocks, lambda b: b != ""), rules.BLOCK_JOIN)
    cut = cut_marked(joined, max_chars, "\n[…]")
    return F.when(strip(cut) == "", F.lit(rules.EMPTY_CONTEXT)).otherwise(cut)


def judge_context(blocks: Column, max_chars: int = rules.JUDGE_CONTEXT_CHARS) -> Column:
    joined = F.array_join(blocks, rules.BLOCK_JOIN)
    return F.when(F.size(blocks) == 0, F.lit(rules.EMPTY_CONTEXT)).otherwise(
        cut_marked(joined, max_chars, "\n[…truncado…]")
    )


def groundedness_gate(answer: Column | str, payload: Column | str,
                      minimum: float = rules.GROUNDED_MIN) -> Column:
    """Struct(response, groundedness, unsupported_claims) from a scorer's JSON reply."""
    a = text_or_empty(answer)
    v = F.try_parse_json(text_or_empty(payload))
    raw = F.coalesce(
        F.try_variant_get(v, "$.groundedness", "double"), F.lit(1.0)
    )
    score = F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))
    claims = F.coalesce(
        F.try_variant_get(v, "$.unsupported_claims", "array<string>"), F.array().cast("array<string>")
    )
    claims = F.transform(F.slice(claims, 1, 5), lambda c: F.substring(c, 1, 200))
    declined = looks_declined(a)
    score = F.when(declined, F.lit(1.0)).otherwise(score)
    return F.struct(
        F.when(score < minimum, F.lit(rules.NO_EVIDENCE_RESPONSE)).otherwise(a).alias("response"),
        score.alias("groundedness"),
        F.when(declined, F.array().cast("array<string>")).otherwise(claims).alias("unsupported_claims"),
    )


def history_line(role: Column | str, text: Column | str) -> Column:
    from foliant.functions.text import col

    return F.concat(F.upper(col(role)), F.lit(": "), text_or_empty(text))


def clip_history(block: Column | str) -> Column:
    return clip(block, rules.HISTORY_ITEM_CHARS)


def primary_email(primary_id: Column, emails: Column) -> Column:
    """Address with the primary id (blank means none), else the first non-empty one."""
    wanted = strip(text_or_empty(primary_id))
    match = F.filter(emails, lambda e: strip(text_or_empty(e["id"])) == wanted)
    usable = F.filter(emails, lambda e: strip(text_or_empty(e["email_address"])) != "")
    value = F.when(F.size(match) > 0, F.get(match, F.lit(0))["email_address"]).otherwise(
        F.get(usable, F.lit(0))["email_address"]
    )
    value = F.lower(strip(value))
    return F.when(value != "", value)


def from_epoch_millis(c: Column | str) -> Column:
    """Naive UTC timestamp of epoch milliseconds; anything unreadable is null."""
    from foliant.functions.text import col

    millis = col(c).cast("string").try_cast("double")
    whole = F.floor(millis).cast("bigint")
    return F.when(
        millis.isNotNull(),
        F.timestamp_add("SECOND", F.floor(whole / 1000).cast("int"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
        + F.make_dt_interval(secs=(F.pmod(whole, F.lit(1000)) / 1000).cast("decimal(18,6)")),
    )
