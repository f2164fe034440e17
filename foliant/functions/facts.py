"""Columns for curriculum and staff facts; every rule runs inside the page row."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant import rules as R
from foliant.functions import urls
from foliant.functions.text import (
    FACT_TRIM, contains_any, distinct_first, let, lines, literal_pattern, squeeze, strip, text_or_empty,
)

FACT = "struct<fact_key:string,fact_value:string,evidence_text:string,confidence:double>"


def is_canonical(url: Column) -> Column:
    return contains_any(F.lower(text_or_empty(url)), R.PROGRAM_CANONICAL_TOKENS)


def is_program_page(page_type: Column, url: Column) -> Column:
    return F.lower(strip(text_or_empty(page_type))).isin(*R.PROGRAM_PAGE_TYPES) | F.lower(
        text_or_empty(url)
    ).contains("/carreras/")


def is_fact_source(page_type: Column, url: Column) -> Column:
    return F.lower(strip(text_or_empty(page_type))).isin(*R.PROGRAM_PAGE_TYPES) | contains_any(
        F.lower(text_or_empty(url)), R.FACT_SOURCE_TOKENS
    )


def is_year_source(page_type: Column, url: Column) -> Column:
    u = F.lower(text_or_empty(url))
    never = (u == "") | u.contains("/wp-content/uploads/") | urls.is_document_link(u)
    return ~never & (
        (F.lower(strip(text_or_empty(page_type))) == "career_canonical") | u.contains("/carreras/")
    )


def has_signals(url: Column, title: Column, content: Column, program: Column) -> Column:
    hay = F.concat_ws(
        " ", F.lower(text_or_empty(url)), F.lower(text_or_empty(title)),
        F.substring(F.lower(text_or_empty(content)), 1, 3500),
    )
    named = ~F.coalesce(program, F.lit("")).isin("", R.GENERAL_PROGRAM)
    return named & contains_any(hay, R.PROGRAM_PAGE_SIGNALS)


def duration_plausible(value: Column) -> Column:
    years = F.regexp_extract(squeeze(F.lower(text_or_empty(value))), R.DURATION_YEARS, 1)
    return F.coalesce(F.nullif(years, F.lit("")).cast("int").between(1, 12), F.lit(False))


def pattern_matches(text: Column, patterns: Sequence[str], max_len: int = 120) -> Column:
    """First groups of all matches, pattern by pattern, tidied; case-insensitive first occurrence."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit("(?iu)" + p), 1) for p in patterns])
    tidy = F.transform(found, lambda v: strip(squeeze(strip(v, FACT_TRIM))))
    usable = F.filter(tidy, lambda v: (v != "") & (F.length(v) <= max_len))
    return distinct_first(usable, F.lower)


def slug_to_name(slug: Column) -> Column:
    words = F.split(strip(squeeze(F.translate(F.btrim(strip(slug), F.lit("/")), "-", " "))), " ")

    def word(w: Column) -> Column:
        low = F.lower(w)
        return (
            F.when(low.isin(*R.LOWER_WORDS), low)
            .when(low.isin(*R.DEGREE_WORDS), F.lit("Licenciatura"))
            .otherwise(F.initcap(low))
        )

    return strip(F.array_join(F.transform(words, word), " "))


def normalize_name(name: Column) -> Column:
    return strip(squeeze(F.regexp_replace(strip(text_or_empty(name)), r"(?iu)^\s*lic\.?\s+en\s+", "Licenciatura en ")))


def name_plausible(name: Column) -> Column:
    n = squeeze(strip(text_or_empty(name)))
    low = F.lower(n)
    return (
        F.length(n).between(4, 90)
        & ~contains_any(low, R.PROGRAM_NAME_BLOCKED)
        & contains_any(low, R.PROGRAM_NAME_REQUIRED)
    )


def program_name(url: Column, title: Column) -> Column:
    """Program named by the URL slug, else by the title, else an empty string."""
    p = F.lower(urls.path(url))
    slug = F.regexp_extract(p, r"/carreras/([^/]*)", 1)
    from_slug = normalize_name(slug_to_name(slug))
    low_title = squeeze(F.lower(strip(text_or_empty(title))))
    from_title = normalize_name(F.regexp_extract(low_title, R.PROGRAM_TITLE_PATTERN, 1))
    return (
        F.when((slug != "") & name_plausible(from_slug), from_slug)
        .when(contains_any(low_title, R.PROGRAM_TITLE_BLOCKED), F.lit(""))
        .when(name_plausible(from_title), from_title)
        .otherwise(F.lit(""))
    )


def person_plausible(value: Column) -> Column:
    raw = squeeze(strip(text_or_empty(value)))
    parts = F.filter(F.split(F.regexp_replace(raw, R.PERSON_TITLE_PREFIX, ""), r"\s+"), lambda p: p != "")
    good = F.filter(parts, lambda p: p.rlike(R.PERSON_WORD))
    return (raw != "") & ~contains_any(F.lower(raw), R.PERSON_BLOCKED) & (F.size(parts) >= 2) & (F.size(good) >= 2)


def subject_plausible(value: Column) -> Column:
    raw = F.lower(squeeze(strip(text_or_empty(value), FACT_TRIM)))
    words = F.regexp_extract_all(raw, F.lit(r"([a-záéíóúñü]{2,})"), 1)
    rich = (F.size(words) >= 2) | ((F.size(words) == 1) & (F.length(F.get(words, F.lit(0))) >= 8))
    return F.length(raw).between(4, 120) & ~contains_any(raw, R.SUBJECT_BLOCKED) & rich


def titled_people(content: Column) -> Column:
    """Distinct lines carrying an academic title and a plausible name, in page order."""

    def tidy(x: Column) -> Column:
        x = F.regexp_replace(strip(x), r"^\s*[-*>\d.)#\s_`]+", "")
        x = F.regexp_replace(x, r"\[([^\]]+)\]\([^)]+\)", "$1")
        return strip(squeeze(F.regexp_replace(x, r"[*_`]+", "")), FACT_TRIM)

    candidates = F.filter(
        F.transform(lines(text_or_empty(content)), tidy),
        lambda x: (x != "") & (F.length(x) <= 120)
        & ~contains_any(F.lower(x), R.PERSON_LINE_BLOCKED)
        & x.rlike(R.PERSON_LINE_TITLE) & person_plausible(x),
    )
    return distinct_first(candidates, F.lower)


# --- year blocks ---------------------------------------------------------------


YearLabels = Sequence[tuple[int, Sequence[str]]]


def _year_of(piece: Column, years: YearLabels) -> Column:
    longest = max(len(label) for _, labels in years for label in labels)
    low = F.lower(F.substring(piece, 1, longest))
    out = F.when(low.rlike("^" + literal_pattern(years[0][1])), F.lit(years[0][0]))
    for year, labels in years[1:]:
        out = out.when(low.rlike("^" + literal_pattern(labels)), F.lit(year))
    return out


def year_pieces(content: Column, years: YearLabels = R.YEAR_LABELS) -> Column:
    """Text cut before every year label: array of struct(year, text); year null before the first.

    ``years``: numbers with their labels, in lower case and without pattern characters.
    """
    every = [label for _, labels in years for label in labels]
    cut = F.split(text_or_empty(content), "(?iu)(?=" + "|".join(every) + ")")
    return F.transform(cut, lambda p: F.struct(_year_of(p, years).alias("year"), p.alias("text")))


def _block_score(block: Column) -> Column:
    def n(pattern: str) -> Column:
        return F.size(F.regexp_extract_all(block, F.lit(pattern), 0))

    return (
        n(r"(?iu)(?:^|\n)\s*(?:materia|asignatura)\s*:") * 7
        + n(r"(?iuU)\b(?:semestre|cuatrimestre)\b") * 2
        + n(r"(?:^|\n)\s*(?:[-*]\s+|\d{1,2}[.)]\s+)")
        + F.least(F.floor(F.length(block) / 500), F.lit(4)).cast("int")
    )


#: What a score may find at the very start of a block, where ``^`` or a word boundary needs no text before it.
BLOCK_OPENING = r"(?iu)^\s*(?:$|(?:materia|asignatura)\s*(?::|$)|semestre|cuatrimestre|[-*](?:\s|$)|\d{1,2}(?:$|[.)](?:\s|$)))"


def _may_open(label: str) -> bool:
    """Whether a block that begins with ``label`` may score there more than the same text within a longer block."""
    low = label.lower().lstrip()
    return re.search(BLOCK_OPENING, low) is not None or any(
        w.startswith(low) for w in ("materia", "asignatura", "semestre", "cuatrimestre"))


def best_year_block(pieces: Column, year: int, years: YearLabels = R.YEAR_LABELS) -> Column:
    """Best-scoring stretch from a label of ``year`` to the next later-year label.

    Of the labels that share their next later-year label the first opens the longest block, which holds all
    the others and scores no less; so one block per later-year label is put together, each character once.
    Labels a score may count at the start of a block (``_may_open``) all open a block of their own.
    """
    opening = any(_may_open(label) for y, labels in years for label in labels if y == year)

    def candidates(ps: Column) -> Column:
        marks = F.filter(
            F.transform(ps, lambda q, j: F.when(q["year"] >= year, F.struct((q["year"] > year).alias("later"), j.alias("j")))),
            lambda m: m.isNotNull(),
        )

        def turns(ms: Column) -> Column:
            return F.filter(ms, lambda m, k: (k == 0) | (F.get(ms, k - 1)["later"] != m["later"]))

        def ends(ms: Column) -> Column:
            later = F.filter(ms, lambda m: m["later"])["j"]
            return F.filter(F.transform(ms, lambda m: F.when(~m["later"], F.struct(
                m["j"].alias("j"), F.get(F.filter(later, lambda x: x > m["j"]), F.lit(0)).alias("end")))), lambda x: x.isNotNull())

        def stretches(ms: Column) -> Column:
            return F.filter(F.transform(ms, lambda m, k: F.when(~m["later"], F.struct(
                m["j"].alias("j"), F.get(ms, k + 1)["j"].alias("end")))), lambda x: x.isNotNull())

        def one(x: Column) -> Column:
            block = F.array_join(F.slice(ps, x["j"] + 1, F.coalesce(x["end"], F.size(ps)) - x["j"])["text"], "")
            return let(block, lambda b: F.struct(
                _block_score(F.lower(b)).alias("s"), F.length(b).alias("n"), (-x["j"]).alias("i"), b.alias("b")))

        return F.transform(let(marks, ends) if opening else let(let(marks, turns), stretches), one)

    return F.array_max(let(pieces, candidates))["b"]


def _facts(values: Column, key: str, confidence: Column) -> Column:
    return F.transform(
        values,
        lambda v: F.struct(F.lit(key).alias("fact_key"), v.alias("fact_value"), v.alias("evidence_text"),
                           confidence.alias("confidence")),
    )


def year_subject_facts(url: Column, content: Column) -> Column:
    in_careers = F.lower(text_or_empty(url)).contains("/carreras/")
    confidence = F.when(in_careers, F.lit(0.9)).otherwise(F.lit(0.75))

    def all_years(pieces: Column) -> Column:
        parts = []
        for year, _ in R.YEAR_LABELS:
            subjects = F.filter(
                pattern_matches(text_or_empty(best_year_block(pieces, year)), R.SUBJECT_PATTERNS),
                subject_plausible,
            )
            parts.append(_facts(subjects, f"year_{year}_subject", confidence))
            if year == 1:
                parts.append(_facts(subjects, "first_year_subject", confidence))
        return F.concat(*parts)

    return let(year_pieces(content), all_years)


def program_facts(url: Column, title: Column, content: Column, page_type: Column, name: Column) -> Column:
    """Array of facts of one page: name, director, secretary, duration, subjects per year.

    ``name`` is the program name or an empty string; computing it once outside
    keeps the expression small.
    """
    u, body = F.lower(text_or_empty(url)), text_or_empty(content)
    careers = u.contains("/carreras/")
    on_page = is_program_page(page_type, url) | has_signals(url, title, body, name)
    root = u.rlike(r"/carreras/[^/]+/?$") | u.rlike(r"/oferta-academica/[^/]+/?$")
    none = F.array().cast(f"array<{FACT}>")

    def pick(careers_value: float, other: float) -> Column:
        return F.when(careers, F.lit(careers_value)).otherwise(F.lit(other))

    evidence = F.when(text_or_empty(title) != "", F.substring(title, 1, 200)).otherwise(name)
    named = F.when(
        name != "",
        F.array(F.struct(F.lit("program_name").alias("fact_key"), name.alias("fact_value"),
                         evidence.alias("evidence_text"), pick(0.95, 0.85).alias("confidence"))),
    ).otherwise(none)

    def staff(people: Column) -> Column:
        def directors(high: Column) -> Column:
            high_keys = F.transform(high, F.lower)
            loose = F.filter(
                pattern_matches(body, R.DIRECTOR_PATTERNS_LOOSE),
                lambda v: ~F.array_contains(high_keys, F.lower(v)),
            )

            def both(low: Column) -> Column:
                fallback = (F.size(high) == 0) & (F.size(low) == 0) & root
                top = F.when(fallback, F.slice(people, 1, 1)).otherwise(high)
                return F.concat(
                    _facts(F.filter(top, person_plausible), "director", pick(0.95, 0.82)),
                    _facts(F.filter(low, person_plausible), "director", pick(0.75, 0.6)),
                )

            return let(loose, both)

        def secretaries(found: Column) -> Column:
            use = F.when((F.size(found) == 0) & root & (F.size(people) >= 2), F.slice(people, 2, 1)).otherwise(found)
            return _facts(F.filter(use, person_plausible), "secretary_academic", pick(0.85, 0.7))

        return F.concat(
            let(pattern_matches(body, R.DIRECTOR_PATTERNS), directors),
            let(pattern_matches(body, R.SECRETARY_PATTERNS), secretaries),
        )

    durations = _facts(
        F.filter(pattern_matches(body, R.DURATION_PATTERNS, 80), duration_plausible), "duration", pick(0.88, 0.72)
    )
    page_facts = F.concat(let(titled_people(body), staff), durations)
    subjects = F.when(is_year_source(page_type, url), year_subject_facts(url, body)).otherwise(none)
    return F.concat(named, F.when(on_page, F.concat(page_facts, subjects)).otherwise(none))


def profile_facts(url: Column, title: Column, content: Column) -> Column:
    """Facts telling which audience a page serves, plus procedures and admissions pages."""
    u, t = F.lower(text_or_empty(url)), F.lower(text_or_empty(title))
    hay = F.concat_ws(" ", u, t, F.substring(F.lower(text_or_empty(content)), 1, 3000))
    evidence = F.substring(strip(text_or_empty(title)), 1, 200)

    def fact(when: Column, key: str, confidence: Column) -> Column:
        return F.when(when, F.struct(F.lit(key).alias("fact_key"), url.alias("fact_value"),
                                     evidence.alias("evidence_text"), confidence.alias("confidence")))

    found = [
        fact(contains_any(hay, hints), f"profile_{name}_page",
             F.when(contains_any(u, hints), F.lit(0.86)).otherwise(F.lit(0.72)))
        for name, hints in R.PROFILE_HINTS
    ]
    found.append(fact(contains_any(hay, R.PROCEDURE_PAGE_HINTS), "tramites_page",
                      F.when(contains_any(u, R.PROCEDURE_URL_HINTS), F.lit(0.9)).otherwise(F.lit(0.74))))
    found.append(fact(contains_any(hay, R.ADMISSION_HINTS) & contains_any(u, R.ADMISSION_URL_HINTS),
                      "admissions_page", F.lit(0.88)))
    kept = F.filter(F.array(*found), lambda x: x.isNotNull())
    return F.when(contains_any(u, R.PROFILE_SKIP_URLS), F.array().cast(f"array<{FACT}>")).otherwise(kept)
