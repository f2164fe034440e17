"""Column rules on hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from foliant import rules as R
from foliant.functions import answers as A
from foliant.functions import chunking as C
from foliant.functions import facts as FX
from foliant.functions import html as H
from foliant.functions import text as T
from foliant.functions import urls as U
from foliant.operators import classify, cleaning, links


@pytest.mark.parametrize("raw, want", [
    ("HTTPS://WWW.Site.edu:8443//a//b/?b=2&a=1&utm_source=x#top", "https://site.edu/a/b?a=1&b=2"),
    ("http://site.edu", "http://site.edu/"),
    ("https://site.edu/x/?q=&REF=1", "https://site.edu/x?q="),
    ("https://site.edu/p?q=a%20b~*&Q=1", "https://site.edu/p?Q=1&q=a+b~%2A"),
    ("https://site.edu/p?k=2&k=1&fbclid=z", "https://site.edu/p?k=1&k=2"),
])
def test_canonical_url(one, raw, want):
    assert one(U.canonical_url("u"), u=raw) == want


@pytest.mark.parametrize("raw, want", [
    ("https://User@WWW.Site.edu:8080/x", "www.site.edu"), ("Site.edu:443", "site.edu"), (".site.edu.", "site.edu"), ("", ""),
])
def test_host(one, raw, want):
    assert one(U.host_exact("u"), u=raw) == want


def test_domains(one):
    assert one(U.domain_variants("u"), u="https://www.a.org/x") == ["a.org", "www.a.org"]
    assert one(U.domains_equivalent(F.lit("WWW.a.org"), F.lit("https://a.org/")), u="") is True
    assert one(U.domains_equivalent(F.lit(""), F.lit("")), u="") is False
    assert one(U.allowed_origins("u", "https://a.org"), u="a.org") == ["https://a.org", "https://www.a.org"]


@pytest.mark.parametrize("href, want", [
    ("/a/b", "https://h.org/a/b"), ("c.html", "https://h.org/x/c.html"), ("../c", "https://h.org/c"), ("?q=1", "https://h.org/x/y?q=1"),
    ("//o.org/z", "https://o.org/z"), ("https://o.org/z", "https://o.org/z"), ("#f", "https://h.org/x/y?p=2#f"), ("./c/./d", "https://h.org/x/c/d"),
])
def test_resolve(one, href, want):
    assert one(U.resolve_link("b", "h"), b="https://h.org/x/y?p=2", h=href) == want


def test_recent_documents(one):
    assert one(U.is_recent_document("u", 2026), u="https://h.org/2019/2022/a.pdf") is True
    assert one(U.is_recent_document("u", 2026), u="https://h.org/2019/a.pdf") is False
    assert one(U.is_recent_document("u", 2026), u="https://h.org/a.pdf") is False


def test_file_titles(one):
    assert one(U.document_title(F.lit(" "), U.file_name("u")), u="https://h.org/d/plan-de_estudios%20x.v2.pdf") == "Plan De Estudios X.V2"
    assert one(U.document_title(F.lit("Real"), U.file_name("u")), u="https://h.org/d/a.pdf") == "Real"


def test_globs(one):
    blocked = U.url_blocked("u")
    assert one(blocked, u="https://h.org/x/Photo.JPG") is True
    assert one(blocked, u="https://h.org/?s=abc") is True
    assert one(blocked, u="https://h.org/blog") is False
    assert one(U.url_blocked("u", ("*/a?c/*", "https://x.*")), u="https://h.org/abc/1") is True
    assert one(U.url_blocked("u", ("*/a?c/*", "https://x.*")), u="https://h.org/ac/1") is False


@pytest.mark.parametrize("url, page_type, score, blocked, reason", [
    ("https://h.org/revista/1", "utility_noise", 0.0, True, "blocked:/revista/"),
    ("https://h.org/", "homepage", 0.15, True, "root_path"),
    ("https://h.org/noticias/1", "news_blocked", 0.0, True, "news_blocked:/noticias/"),
    ("https://h.org/x/plan-de-estudio-1.pdf", "pdf_document", 0.95, False, ""),
    ("https://h.org/x/otro.pdf?x=1", "pdf_document", 0.75, False, ""),
    ("https://h.org/carreras/x", "career_canonical", 1.0, False, ""),
    ("https://h.org/trámites/x", "procedure", 0.9, False, ""),
    ("https://h.org/algo", "institutional_info", 0.55, False, ""),
])
def test_classify(one, url, page_type, score, blocked, reason):
    got = one(classify.classify(F.col("u"), F.lit("")), u=url)
    assert (got.page_type, got.authority_score, got.should_block, got.reason) == (page_type, score, blocked, reason)


def test_content_upgrade(one):
    base = classify.classify(F.col("u"), F.lit(""))
    up = classify.upgrade_by_content(base, F.col("u"), F.lit(""), F.col("c"))
    assert one(up, u="https://h.org/x", c="PLAN DE ESTUDIOS y campo ocupacional").page_type == "career_canonical"
    got = one(up, u="https://h.org/x", c="Formulario en Mesa de Entradas")
    assert (got.page_type, got.authority_score) == ("procedure", 0.85)
    assert one(up, u="https://h.org/carreras/x", c="plan de estudios incumbencias").authority_score == 1.0


def test_clean_lines_matches_plain_loop(spark):
    """Mini-oracle on random lines."""
    rnd = random.Random(3)
    pool = ["a", "A", "b ", "", "Materia:", "materia:", "Área de Prensa hoy", "![x](y)", "[![x](y)](z)", " c", "d\te"]
    texts = ["\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40))) for _ in range(200)]

    def loop(t):
        seen, out = {}, []
        for line in t.splitlines():
            line = line.strip()
            if not line or line in ("![x](y)", "[![x](y)](z)"):
                continue
            k = line.lower()
            if k not in R.STRUCTURAL_LABELS:
                if seen.get(k, 0) >= (1 if "área de prensa" in k else 2):
                    continue
                seen[k] = seen.get(k, 0) + 1
            out.append(line)
        return "\n".join(out).strip()

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", cleaning.clean_lines("t").alias("c"))
    assert {r.i: r.c for r in got.collect()} == {i: loop(t) for i, t in enumerate(texts)}


def test_document_lines(one):
    raw = "Título\n\n\n12\nPágina 1 de 9\n-----\ntexto\n\n\nfin\n"
    assert one(cleaning.clean_document_lines("t"), t=raw) == "Título\n\ntexto\n\nfin"


def test_boundary_chunks_contract(spark):
    rnd = random.Random(5)
    words = ["uno", "dos.", "tres", "cuatro\n", "cinco\n\n", "x" * 40]
    texts = ["".join(rnd.choice(words) + " " for _ in range(rnd.randint(0, 300))) for _ in range(60)] + ["y" * 1234, "", "  "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", C.boundary_chunks("t").alias("c"))
    for r in df.collect():
        assert all(0 < len(c) <= 500 and c == c.strip() for c in r.c)
        if len(r.t) <= 500:
            assert r.c == ([r.t.strip()] if r.t.strip() else [])
        # Nothing is lost: every word of the text occurs in the chunks.
        assert set(r.t.split()) <= set(" ".join(r.c).split()) or "y" * 40 in r.t
        assert sum(map(len, r.c)) >= len(r.t.strip()) * 0.9


def test_fixed_chunks_and_offsets(spark):
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("ab c\n") for _ in range(n)) for n in (0, 1, 99, 100, 101, 180, 181, 999)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    cut = C.fixed_chunks("t", 100, 20)
    for r in df.select("t", cut.alias("c"), C.chunk_offsets("t", cut).alias("o")).collect():
        want, at = [], 0
        while at < len(r.t):
            want.append(r.t[at:at + 100])
            if at + 100 >= len(r.t):
                break
            at += 80
        assert r.c == want
        cursor, offs = 0, []
        for c in want:
            i = r.t.find(c, cursor)
            i = max(0, cursor) if i < 0 else i
            offs.append(i)
            cursor = i + len(c)
        assert r.o == offs


def test_document_window(one):
    doc = "a" * 3000 + "b" * 3000 + "c" * 6000
    w = one(C.document_window("d", F.lit(6500), F.lit(500)), d=doc)
    assert w == doc[:2000] + "\n[…]\n[…]\n" + doc[5500:8000] + "\n[…]"
    assert one(C.document_window("d", F.lit(1), F.lit(5)), d="short") == "short"


def test_clip(one):
    assert one(T.clip("t", 5), t="abc  defg") == "abc…"
    assert one(T.clip_at_space("t", 9), t="hola mundo feliz") == "hola"
    assert one(T.slug("t"), t="  ¡Árbol, Niño!  ") == "rbol-ni-o"
    assert one(T.slug("t"), t="¡!") == "page"


def test_html_tree():
    page = ("<html><head><title> T </title></head><body><nav>no</nav><main><h1>Uno</h1><div class='sharedaddy'>x</div>"
            "<div><p>dos</p><ul><li>tres</li></ul></div></main><p>fuera</p></body></html>")
    title, text = H.parse_page(page)
    assert title == "T"
    assert text == "# Uno\n\ndostres\n\ndos\n\n- tres"


def test_html_patterns(one):
    page = "<body><script>x</script><h2>Uno</h2><p>a &amp; b</p><p>a &amp; b</p><ul><li>c</li></ul><footer>no</footer></body>"
    assert one(H.text_from_html("h"), h=page) == "## Uno\na & b\n- c"


def test_document_links(one):
    html = ("<a href='/d/a.pdf#p'>1</a><a href=\"/d/a.pdf?x=1\">2</a><a href='/d/b.html'>3</a> [m](c.PDF?v=2) [again](/d/a.pdf)")
    got = one(links.document_links(F.col("h"), F.col("b")), h=html, b="https://h.org/x/y")
    assert got == ["https://h.org/d/a.pdf?x=1", "https://h.org/x/c.PDF?v=2"]


def test_greetings(one):
    later, first = A.conversational("a", F.lit(False)), A.conversational("a", F.lit(True))
    assert one(later, a="El vicedecano es Prof. Dr. Juan Perez.") == "El vicedecano es Prof. Dr. Juan Perez."
    assert one(first, a="Carreras detectadas: 3.").startswith("Hola, te ayudo con eso.")
    assert one(later, a="Hola, las materias son dos.") == "Las materias son dos."
    assert one(first, a="Buenas, sí") == "Buenas, sí"
    assert one(first, a="") == R.GREETING_EMPTY
    assert one(A.hide_sources("a"), a="Texto.\n\nFuentes: https://x") == "Texto."
    assert one(A.hide_sources("a"), a="Fuente: x") == "Fuente: x"


def test_decline(one):
    assert one(A.looks_declined("a"), a="Lo siento, pero NO puedo") is True
    assert one(A.looks_declined("a"), a="") is True
    assert one(A.probe_declined("a"), a="No encontré nada") is False


@pytest.mark.parametrize("reply, score, claims", [
    ('{"groundedness": 1.7, "unsupported_claims": ["a"]}', 1.0, ["a"]), ('{"groundedness": "x"}', 1.0, []), ("broken", 1.0, []),
    ('{"groundedness": 0.1, "unsupported_claims": ["1","2","3","4","5","6"]}', 0.1, ["1", "2", "3", "4", "5"]),
])
def test_groundedness(one, reply, score, claims):
    got = one(A.groundedness_gate("a", "p"), a="respuesta", p=reply)
    assert (got.groundedness, got.unsupported_claims) == (score, claims)
    assert (got.response == R.NO_EVIDENCE_RESPONSE) == (score < 0.4)


def test_epoch(one):
    assert str(one(A.from_epoch_millis("v"), v="1700000000123")) == "2023-11-14 22:13:20.123000"
    assert one(A.from_epoch_millis("v"), v="x") is None
    assert one(A.from_epoch_millis("v"), v="") is None


def test_primary_email(spark):
    rows = [("1", "b", [("a", "A@x.org"), ("b", " B@X.org ")]), ("2", "z", [("a", ""), ("b", "C@x.org")]), ("3", "z", [])]
    df = spark.createDataFrame(rows, "i string, p string, e array<struct<id:string,email_address:string>>")
    got = {r.i: r.m for r in df.select("i", A.primary_email(F.col("p"), F.col("e")).alias("m")).collect()}
    assert got == {"1": "b@x.org", "2": "c@x.org", "3": None}


# --- facts ---------------------------------------------------------------------------

CURRICULUM = """
Indice rapido
Primer Año
Segundo Año
Tercer Año
Cuarto Año

Tercer Año
PRIMER SEMESTRE
Materia:
Medicina I
SEGUNDO SEMESTRE
Materia:
Emergentología
Materia:
DIAGNÓSTICO POR IMÁGENES
Cuarto Año
"""


def test_year_block(one):
    got = one(FX.year_subject_facts(F.lit("https://h.org/carreras/medicina"), F.col("c")), c=CURRICULUM)
    third = [f.fact_value.lower() for f in got if f.fact_key == "year_3_subject"]
    assert {"medicina i", "emergentología", "diagnóstico por imágenes"} <= set(third)
    assert all(f.confidence == 0.9 for f in got)


def test_no_year_facts_from_documents(one):
    url = "https://h.org/wp-content/uploads/2024/02/programa.pdf"
    text = "Primer Año\nMateria:\nMedicina, Hombre y Sociedad\nSegundo Año\nMateria:\nFISIOLOGÍA HUMANA\n"
    got = one(FX.program_facts(F.lit(url), F.lit("Programa"), F.col("c"), F.lit("curriculum"), F.lit("")), c=text)
    assert not [f for f in got if f.fact_key.startswith("year_")]


def test_program_facts(one):
    url = "https://h.org/carreras/lic-en-enfermeria"
    name = FX.program_name(F.lit(url), F.lit("x"))
    assert one(name, c="") == "Licenciatura en Enfermeria"
    text = ("Director de carrera: Dra. Ana Pérez\nSecretario académico: Lic. Juan Gómez\nDuración de la carrera: 5 años\n"
            "Duración: 40 años\nPrimer año\n- ANATOMÍA HUMANA\nSegundo año\nMateria: Farmacología General\n")
    got = one(FX.program_facts(F.lit(url), F.lit("Enfermería"), F.col("c"), F.lit("career_canonical"), name), c=text)
    facts = {}
    for f in got:
        facts.setdefault(f.fact_key, []).append((f.fact_value, f.confidence))
    assert facts["program_name"] == [("Licenciatura en Enfermeria", 0.95)]
    assert ("Dra. Ana Pérez", 0.95) in facts["director"]
    assert facts["secretary_academic"] == [("Lic. Juan Gómez", 0.85)]
    assert [v for v, _ in facts["duration"]][0] == "5 años" and "40 años" not in [v for v, _ in facts["duration"]]
    assert ("ANATOMÍA HUMANA", 0.9) in facts["year_1_subject"] and ("ANATOMÍA HUMANA", 0.9) in facts["first_year_subject"]
    assert ("Farmacología General", 0.9) in facts["year_2_subject"]


def test_titled_people_fallback(one):
    text = "# Equipo\n* **Dra. Ana Pérez**\nmail@x.org Dr. No\n- Lic. Juan Gómez\nDra. Ana Pérez\n"
    assert one(FX.titled_people(F.col("c")), c=text) == ["Dra. Ana Pérez", "Lic. Juan Gómez"]
    got = one(FX.program_facts(F.lit("https://h.org/carreras/medicina"), F.lit(""), F.col("c"), F.lit("career_canonical"), F.lit("Medicina")), c=text)
    pairs = [(f.fact_key, f.fact_value) for f in got]
    assert ("director", "Dra. Ana Pérez") in pairs and ("secretary_academic", "Lic. Juan Gómez") in pairs


@pytest.mark.parametrize("rule, value, want", [
    (FX.person_plausible, "Dr. Ana Pérez", True), (FX.person_plausible, "Ana", False), (FX.person_plausible, "Licenciatura en Algo", False),
    (FX.subject_plausible, "Anatomía", True), (FX.subject_plausible, "Arte", False), (FX.subject_plausible, "Período lectivo largo", False),
    (FX.name_plausible, "Medicina", True), (FX.name_plausible, "Curso de medicina", False), (FX.duration_plausible, "6 años", True),
    (FX.duration_plausible, "13 años", False),
])
def test_plausibility(one, rule, value, want):
    assert one(rule(F.col("v")), v=value) is want


def test_profile_facts(one):
    got = one(FX.profile_facts(F.col("u"), F.lit("Ingreso 2025"), F.lit("requisitos y diploma")), u="https://h.org/ingreso/x")
    assert {f.fact_key: f.confidence for f in got} == {"profile_ingresantes_page": 0.86, "tramites_page": 0.74, "admissions_page": 0.88}
    assert one(FX.profile_facts(F.col("u"), F.lit("Ingreso"), F.lit("")), u="https://h.org/oferta-academica/x") == []


def test_pdf_authority_and_gates(one):
    assert one(classify.pdf_authority(F.col("u"), F.lit("Guía")), u="https://h.org/x.pdf") == 0.8
    assert one(FX.is_fact_source(F.lit("x"), F.col("u")), u="https://h.org/plan-de-estudios/1") is True
    assert one(FX.is_year_source(F.lit("career_canonical"), F.col("u")), u="https://h.org/a.pdf") is False
    assert one(FX.has_signals(F.col("u"), F.lit(""), F.lit("Carga horaria"), F.lit("Medicina")), u="https://h.org/") is True
    assert one(FX.has_signals(F.col("u"), F.lit(""), F.lit("Carga horaria"), F.lit("__general__")), u="https://h.org/") is False


@pytest.mark.parametrize(("text", "want"), [
    ("Educaci&oacute;n &#8211; t&iacute;tulo", "Educación – título"), ("a &amp;lt; b", "a &lt; b"), ("&#x1F600;&#65;&#x41;", "😀AA"),
    ("&nope; & &; &#xD800; &#1114112; 1&2", "&nope; & &; &#xD800; &#1114112; 1&2"), ("x&nbsp;y&#160;z", "x y z"), ("&", "&"), ("", ""), (None, ""),
])
def test_entities(one, text, want):
    from foliant.functions import html

    assert one(html.decode_entities("h"), h=text) == want


def test_links_without_quotes(one):
    from foliant.functions import html

    page = """<a href=/a/b>x</a> <A class='k' HREF="/p?a=1&amp;b=2">y</A><a href='/q"r'>z</a><a href="">e</a><a name=top>n</a>"""
    assert one(html.hrefs("h"), h=page) == ["/a/b", "/p?a=1&b=2", '/q"r', ""]
    assert one(html.title("h"), h="<title>Admisi&oacute;n </title>") == "Admisión"
