"""Curriculum and staff facts: pages composed from the words of the sample documents, and what must be found in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from foliant.functions import facts as FX
from foliant.operators import facts
from foliant.plans.once import explode_once
from foliant.schemas import read_table

NL = "chr(10)"

#: Plain words of a document, at least sixteen of them, and the same capitalised.
WORDS = r"""w AS (SELECT doc_id, ws, list_transform(ws, lambda x: upper(x[1:1]) || x[2:]) AS cs FROM (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-zà-ÿ]+'), lambda x: regexp_full_match(x, '[a-z]{3,}')
    AND x NOT IN ('del', 'las', 'los', 'lic', 'jef')) AS ws FROM documents) WHERE len(ws) >= 16)"""


def worded(spark, d):
    ws = F.filter(F.split(F.lower("text"), "[^a-zà-ÿ]+"), lambda x: x.rlike("^[a-z]{3,}$") & ~x.isin("del", "las", "los", "lic", "jef"))
    rows = read_table(spark, d, "documents").select("doc_id", ws.alias("ws")).filter(F.size("ws") >= 16)
    return rows.withColumn("cs", F.transform("ws", F.initcap))


def w(i):
    return F.get("ws", F.lit(i - 1))


def c(i):
    return F.get("cs", F.lit(i - 1))


def joined(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def plausible_sql(name: str) -> str:
    from foliant import rules as R

    blocked = ", ".join(f"'{b}'" for b in R.PROGRAM_NAME_BLOCKED)
    return f"(length({name}) BETWEEN 4 AND 90 AND NOT list_bool_or(list_transform([{blocked}], lambda b: contains(lower({name}), b))))"


@query("program_names", f"""
WITH {WORDS}, n AS (SELECT doc_id, 'Licenciatura en ' || cs[1] || ' de ' || cs[2] AS slugged, 'tecnicatura en ' || ws[3] || ' ' || ws[4] AS titled FROM w)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CASE WHEN {plausible_sql('slugged')} THEN slugged ELSE '' END
  WHEN 1 THEN CASE WHEN {plausible_sql('titled')} THEN titled ELSE '' END ELSE '' END AS program FROM n""")
def program_names(spark, d):
    """By the slug of the URL, else by the title, else none."""
    kind = F.col("doc_id") % 3
    url = F.when(kind == 0, joined("https://h.example.org/carreras/lic-en-", w(1), "-de-", w(2), "/")).otherwise("https://h.example.org/x")
    title = F.when(kind == 1, joined("Tecnicatura  en ", c(3), " ", c(4), " | H")).otherwise(joined("Programa de ", c(5)))
    return worded(spark, d).select("doc_id", FX.program_name(url, title).alias("program"))


@query("people", f"""
WITH {WORDS} SELECT doc_id, len(ws[1]) >= 2 AS titled, false AS blocked, false AS single, false AS marked FROM w""")
def people(spark, d):
    """A title and two names is a person; a programme, a single name or a name with digits is none."""
    ok = lambda v, n: FX.person_plausible(v).alias(n)
    return worded(spark, d).select("doc_id", ok(joined("Dra. ", c(1), " ", c(2)), "titled"), ok(joined("Carrera ", c(1), " ", c(2)), "blocked"),
                                   ok(joined("Lic. ", c(3)), "single"), ok(joined(c(1), " 4", c(2)), "marked"))


def _subject_sql(value: str) -> str:
    from foliant import rules as R

    blocked = ", ".join(f"'{b}'" for b in R.SUBJECT_BLOCKED)
    return f"(length({value}) BETWEEN 4 AND 120 AND NOT list_bool_or(list_transform([{blocked}], lambda b: contains(lower({value}), b))))"


@query("subjects", f"""
WITH {WORDS}, v AS (SELECT doc_id, ws[1] || ' ' || ws[2] AS two, ws[3] AS one, 'clave ' || ws[4] AS key FROM w)
SELECT doc_id, {_subject_sql('two')} AS two, {_subject_sql('one')} AND length(one) >= 8 AS one, false AS key, false AS short FROM v""")
def subjects(spark, d):
    ok = lambda v, n: FX.subject_plausible(v).alias(n)
    return worded(spark, d).select("doc_id", ok(joined(" - ", c(1), " ", c(2), ". "), "two"), ok(c(3), "one"), ok(joined("Clave ", c(4)), "key"),
                                   ok(F.lit("x1"), "short"))


@query("titled_lines", f"""
WITH {WORDS} SELECT doc_id, 'Dra. ' || cs[1] || ' ' || cs[2] || ';Prof. ' || cs[3] || ' ' || cs[4] || ' ' || cs[5] AS people FROM w""")
def titled_lines(spark, d):
    """Marks, links and repeated lines go; lines with addresses, blocked words or a single name are no people."""
    one, two = joined("Dra. ", c(1), " ", c(2)), joined("Prof. ", c(3), " ", c(4), " ", c(5))
    body = F.concat_ws("\n", joined("- **", one, "**"), joined("12) [", two, "](https://h.example.org/p)"), F.upper(one), joined("Dr. ", c(6)),
                       joined("Lic. ", c(7), " ", c(8), " a@b.example"), joined("Esp. en plan de estudios ", c(9)), joined(c(1), " ", c(2)))
    return worded(spark, d).select("doc_id", F.array_join(FX.titled_people(body), ";").alias("people"))


#: Words of the sample text as stand-ins for the labels of three years.
SAMPLE_YEARS = ((1, (" the", " der")), (2, (" of", " die", " la")), (3, (" and", " und", " que", " des")))


def _year_sql() -> str:
    every = "|".join(label for _, labels in SAMPLE_YEARS for label in labels)
    year = " ".join(f"WHEN regexp_matches(lower(t), '^(?:{'|'.join(labels)})') THEN {y}" for y, labels in SAMPLE_YEARS)
    return rf"""
    WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '(?i)({every})', chr(1) || '\1', 'g'), chr(1)) AS ps FROM documents),
    p AS (SELECT doc_id, i, ps[i] AS t, ps FROM s, unnest(range(1, len(ps) + 1)) AS u(i)),
    y AS (SELECT doc_id, i, t, ps, CASE {year} END AS year FROM p),
    e AS (SELECT a.doc_id, a.year, a.i, a.ps, min(b.i) AS stop FROM y a LEFT JOIN y b ON b.doc_id = a.doc_id AND b.i > a.i AND b.year > a.year
          WHERE a.year IS NOT NULL GROUP BY ALL),
    k AS (SELECT doc_id, year, i, array_to_string(ps[i : coalesce(stop - 1, len(ps))], '') AS b FROM e),
    r AS (SELECT *, len(regexp_extract_all(lower(b), '(?:^|\n)\s*(?:materia|asignatura)\s*:')) * 7 + len(regexp_extract_all(lower(b), '\b(?:semestre|cuatrimestre)\b')) * 2
               + len(regexp_extract_all(lower(b), '(?:^|\n)\s*(?:[-*]\s+|\d{{1,2}}[.)]\s+)')) + least(length(b) // 500, 4) AS s FROM k)
    SELECT doc_id, year, length(b) AS n_chars, md5(b) AS block_md5 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, year ORDER BY s DESC, length(b) DESC, i) AS n FROM r) WHERE n = 1"""


@query("year_blocks", _year_sql())
def year_blocks(spark, d):
    """The best stretch of each year, with stand-in labels: from a label to the next one of a later year."""
    rows = read_table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", FX.year_pieces(F.col("text"), SAMPLE_YEARS).alias("ps"))
    blocks = F.filter(F.array(*[F.struct(F.lit(y).alias("year"), FX.best_year_block(F.col("ps"), y, SAMPLE_YEARS).alias("b")) for y, _ in SAMPLE_YEARS]),
                      lambda x: x["b"].isNotNull())
    found = explode_once(rows, ["doc_id"], blocks, "f")
    return found.select("doc_id", "f.year", F.length("f.b").cast("bigint").alias("n_chars"), F.md5(F.col("f.b").cast("binary")).alias("block_md5"))


@query("fact_gates", """
SELECT doc_id, k IN (0, 1) AS canonical, k = 0 OR t = 'curriculum' AS program_page, k IN (0, 2) OR t = 'curriculum' AS fact_source, k = 0 AS year_source
FROM (SELECT doc_id, doc_id % 4 AS k, CASE WHEN doc_id % 5 = 0 THEN 'curriculum' ELSE 'other' END AS t FROM documents)""")
def fact_gates(spark, d):
    k = F.col("doc_id") % 4
    part = F.when(k == 0, "/carreras/x").when(k == 1, "/Oferta-Academica/x").when(k == 2, "/a/plan-de-estudios").otherwise("/wp-content/uploads/carreras.pdf")
    url, kind = F.concat(F.lit("https://h.example.org"), part), F.when(F.col("doc_id") % 5 == 0, " Curriculum ").otherwise("other")
    return read_table(spark, d, "documents").select(
        "doc_id", FX.is_canonical(url).alias("canonical"), FX.is_program_page(kind, url).alias("program_page"),
        FX.is_fact_source(kind, url).alias("fact_source"), FX.is_year_source(kind, url).alias("year_source"))


@query("program_facts", f"""
WITH {WORDS}, n AS (SELECT *, 'Licenciatura en ' || cs[1] || ' de ' || cs[2] AS p, doc_id % 2 = 0 AS staffed FROM w),
f AS (SELECT doc_id, 'program_name' AS fact_key, p AS fact_value, 0.95 AS confidence FROM n UNION ALL
  SELECT doc_id, 'director', CASE WHEN staffed THEN 'Dra. ' || cs[3] || ' ' || cs[4] ELSE 'Mg. ' || cs[9] || ' ' || cs[10] END, 0.95 FROM n UNION ALL
  SELECT doc_id, 'director', 'Lic. ' || cs[5] || ' ' || cs[6], 0.75 FROM n WHERE staffed UNION ALL
  SELECT doc_id, 'secretary_academic', CASE WHEN staffed THEN 'Esp. ' || cs[7] || ' ' || cs[8] ELSE 'Esp. ' || cs[11] || ' ' || cs[12] END, 0.85 FROM n UNION ALL
  SELECT doc_id, 'duration', (doc_id % 6 + 1) || ' años', 0.88 FROM n)
SELECT doc_id, fact_key, fact_value, confidence::DOUBLE AS confidence FROM f JOIN n USING (doc_id) WHERE {plausible_sql('p')}""")
def program_facts(spark, d):
    """Named staff with high and low confidence (the low one without the names of the high one), or the first titled people of the page."""
    staffed = F.concat_ws("\n", joined("Director de carrera: Dra. ", c(3), " ", c(4)), F.lit("Horario: 8"),
                          joined("Coordinadora: Lic. ", c(5), " ", c(6)), F.lit("Horario: 9"), joined("Secretaria Académica: Esp. ", c(7), " ", c(8)))
    listed = F.concat_ws("\n", joined("- Mg. ", c(9), " ", c(10)), joined("- Esp. ", c(11), " ", c(12)))
    years = (F.col("doc_id") % 6 + 1).cast("string")
    body = F.concat_ws("\n", F.when(F.col("doc_id") % 2 == 0, staffed).otherwise(listed), joined("Duración: ", years, " años"), F.lit("Duración: 40 años"))
    pages = worded(spark, d).select(
        F.col("doc_id").cast("string").alias("source_id"), joined("https://h.example.org/carreras/licenciatura-en-", w(1), "-de-", w(2)).alias("canonical_url"),
        F.lit("T").alias("title"), body.alias("content"), F.lit("career_canonical").alias("page_type"), "doc_id")
    name = FX.program_name(F.col("canonical_url"), F.col("title"))
    out = facts.program_fact_rows(pages.filter(name != ""))
    return out.select(F.col("source_id").cast("bigint").alias("doc_id"), "fact_key", "fact_value", "confidence")


@query("year_subjects", f"""
WITH {WORDS}, v AS (SELECT doc_id, [ws[1] || ' ' || ws[2], ws[3] || ' ' || ws[4]] AS a, ws[5] || ' ' || ws[6] AS b FROM w),
s AS (SELECT doc_id, unnest(['year_1_subject', 'first_year_subject']) AS fact_key, unnest(a) AS fact_value FROM v),
f AS (SELECT doc_id, k AS fact_key, x AS fact_value FROM v, unnest(['year_1_subject', 'first_year_subject']) AS t(k), unnest(a) AS u(x)
      UNION ALL SELECT doc_id, 'year_2_subject', b FROM v)
SELECT DISTINCT doc_id, fact_key, fact_value FROM f WHERE {_subject_sql('fact_value')}""")
def year_subjects(spark, d):
    body = F.concat_ws("\n", F.lit("Primer año de la carrera"), joined("Materia: ", w(1), " ", w(2)), joined("Asignatura: ", w(3), " ", w(4)), F.lit("Asignatura: clave x"),
                       F.lit("Segundo año"), joined("Materia: ", w(5), " ", w(6)))
    found = FX.year_subject_facts(F.lit("https://h.example.org/carreras/x"), body)
    return worded(spark, d).select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.fact_key", "f.fact_value")


@query("profile_facts", """
SELECT doc_id, key AS fact_key, confidence::DOUBLE AS confidence FROM documents, (VALUES
  (0, 'profile_ingresantes_page', 0.86), (0, 'admissions_page', 0.88), (1, 'profile_docentes_page', 0.72), (2, 'tramites_page', 0.9),
  (3, 'profile_estudiantes_page', 0.86), (3, 'tramites_page', 0.74)) AS v(k, key, confidence) WHERE doc_id % 5 = k""")
def profile_facts(spark, d):
    """Audiences and procedures by URL (surer) or by title and text; skipped addresses give none."""
    k = F.col("doc_id") % 5
    pick = lambda *vs: F.when(k == 0, vs[0]).when(k == 1, vs[1]).when(k == 2, vs[2]).when(k == 3, vs[3]).otherwise(vs[4])
    url = joined("https://h.example.org", pick("/ingresantes/", "/a/", "/tramite/", "/alumnos/", "/oferta-academica/docentes/"), F.col("doc_id").cast("string"))
    pages = read_table(spark, d, "documents").select(
        "doc_id", url.alias("url"), pick("A", "Para docentes", "B", "C", "D").alias("title"), pick("x", "y", "z", "Mesa de entradas", "w").alias("content"))
    out = facts.profile_fact_rows(pages)
    return out.select(F.regexp_extract("url", r"(\d+)$", 1).cast("bigint").alias("doc_id"), "fact_key", "confidence")
