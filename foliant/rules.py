"""Rule data used by the classifiers, filters and extractors.

Everything here is data: callers can pass their own lists to any operator.  The
defaults below are FIXED VALUES - they decide which page ends up in which
class, so they are stated plainly and in the order in which they apply.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values: page classification ---------------------------------------

BLOCK_TOKENS = (
    "/wp-admin/", "/wp-login.php", "/xmlrpc.php", "/wp-json/", "/feed/",
    "/tag/", "/author/", "/category/", "/attachment/", "attachment_id=",
    "/?s=", "/search/", "?fluentcrm=", "/cvm-prop-form/",
    "/sitemap", "/archives/", "/revista/", "/revistas/", "/viaje/", "/viajes/",
    "/publicacion/", "/publicaciones/", "/simposio/", "/simposios/",
    "/jornada/", "/jornadas/", "/congreso/", "/congresos/",
    "/intercambio/", "/convocatoria/", "/cuaderno-urbano",
)

NEWS_BLOCK_TOKENS = (
    "/notimed/", "/noticia/", "/noticias/", "/novedad/", "/novedades/",
    "/prensa/", "/comunicado/", "/comunicados/", "/blog/", "/news/",
    "/eventos/", "/evento/", "/agenda/", "/actualidad/", "/actualidades/",
    "/boletin/", "/newsletter/", "/gacetilla/", "/efemeride/", "/efemerides/",
    "/revista/", "/revistas/", "/viaje/", "/viajes/",
    "/simposio/", "/simposios/", "/jornada/", "/jornadas/",
    "/congreso/", "/congresos/", "/intercambio/", "/convocatoria/",
    "/publicacion/", "/publicaciones/", "/cuaderno-urbano",
)

# (page type, URL tokens, authority); the first group that matches wins.
CLASS_RULES = (
    ("career_canonical", ("/carreras/",), 1.0),
    ("offer_canonical", ("/oferta-academica/", "/ofertas-acad/", "/ofertas-academicas/"), 0.95),
    ("curriculum", ("/plan-de-estudios/", "/planes-de-estudio/", "/correlatividades/",
                    "/plan-estudios/"), 0.95),
    ("procedure", ("/tramites/", "/trámites/", "/ingreso/", "/ingresos/", "/inscripcion/",
                   "/inscripciones/", "/admision/", "/admisiones/", "/ingresantes/",
                   "/requisitos/"), 0.90),
    ("regulation", ("/resolucion/", "/resoluciones/", "/reglamento/", "/reglamentos/",
                    "/normativa/", "/normativas/", "/disposicion/", "/disposiciones/",
                    "/ordenanza/", "/ordenanzas/"), 0.85),
    ("authority", ("/autoridades/", "/secretaria/", "/secretarias/", "/decanato/",
                   "/consejo-directivo/", "/consejo-superior/", "/gobierno/", "/decano/",
                   "/vicedecano/"), 0.85),
    ("academic_unit", ("/catedra/", "/catedras/", "/departamento/", "/departamentos/",
                       "/instituto/", "/institutos/", "/area/", "/areas/"), 0.80),
    ("student_service", ("/bienestar/", "/becas/", "/biblioteca/", "/comedor/", "/deportes/",
                         "/extension/", "/extensión/", "/pasantias/", "/pasantías/",
                         "/voluntariado/", "/tutoria/", "/tutorias/", "/egresados/",
                         "/graduados/", "/posgrado/", "/posgrados/", "/doctorado/",
                         "/maestria/", "/maestría/", "/especializacion/",
                         "/especialización/"), 0.80),
    ("calendar", ("/calendario/", "/cronograma/", "/fechas/", "/agenda-academica/",
                  "/calendario-academico/"), 0.80),
    ("research", ("/investigacion/", "/investigación/", "/ciencia/", "/publicaciones/",
                  "/proyectos/", "/laboratorio/", "/laboratorios/"), 0.75),
    ("staff", ("/docentes/", "/profesores/", "/personal/", "/nodocentes/", "/no-docentes/",
               "/concurso/", "/concursos/", "/convocatoria/"), 0.75),
    ("procurement", ("/licitaciones/", "/compras/", "/licitaciones-y-compr/"), 0.30),
)

PDF_RULES = (
    (("plan-de-estudio", "plan_de_estudio", "plan de estudio", "correlatividades",
      "curriculum", "malla-curricular"), 0.95),
    (("resolucion", "resolución", "reglamento", "normativa", "ordenanza", "disposicion"), 0.90),
    (("calendario", "cronograma", "agenda-academica"), 0.85),
    (("programa", "syllabus", "catedra", "materia"), 0.85),
    (("ingreso", "admision", "inscripcion", "requisito", "beca"), 0.85),
    (("guia", "guía", "manual", "instructivo", "tutorial"), 0.80),
)
PDF_DEFAULT_AUTHORITY = 0.75
DEFAULT_CLASS = ("institutional_info", 0.55)

CAREER_SIGNALS = (
    "plan de estudios", "duración de la carrera", "duracion de la carrera",
    "perfil del egresado", "alcances del título", "alcances del titulo",
    "campo ocupacional", "incumbencias",
)
PROCEDURE_SIGNALS = (
    "paso a paso", "siu guaraní", "siu guarani", "mesa de entradas", "formulario",
    "documentación requerida", "documentacion requerida",
)

# --- Fixed values: crawl filters ---------------------------------------------

PRIORITY_TOKENS = (
    "/admision", "/admisiones", "/ingreso", "/ingresantes", "/inscripcion",
    "/inscripciones", "/carreras", "/oferta-academica", "/ofertas-academicas",
    "/programas", "/plan-de-estudios", "/planes-de-estudio", "/requisitos",
    "/tramites", "/trámites",
)

BLOCK_GLOBS = (
    "*/attachment/*", "*attachment_id=*", "*/feed/*", "*/wp-json/*", "*/wp-admin/*",
    "*/wp-login.php*", "*/xmlrpc.php*", "*/?s=*", "*?fluentcrm=*", "*/search/*",
    "*/siga*", "*/cvm-prop-form/*",
    "*.jpg*", "*.jpeg*", "*.png*", "*.gif*", "*.webp*", "*.svg*",
    "*.mp3*", "*.wav*", "*.ogg*", "*.m4a*", "*.aac*",
    "*.mp4*", "*.webm*", "*.avi*", "*.mov*", "*.mkv*",
    "*.pdf*", "*.doc*", "*.docx*", "*.xls*", "*.xlsx*", "*.ppt*", "*.pptx*",
    "*/wp-content/uploads/*",
    "*.zip*", "*.rar*", "*.7z*",
    "*/noticia/*", "*/noticias/*", "*/notimed/*", "*/novedad/*", "*/novedades/*",
    "*/prensa/*", "*/comunicado/*", "*/comunicados/*", "*/blog/*", "*/news/*",
    "*/evento/*", "*/eventos/*", "*/agenda/*", "*/actualidad/*", "*/actualidades/*",
    "*/boletin/*", "*/newsletter/*", "*/gacetilla/*", "*/efemeride/*", "*/efemerides/*",
)

NEWS_EXEMPT_TOKENS = ("/carreras/", "/category/carreras", "/oferta-academica/", "/ofertas-academicas/")
NEWS_URL_TOKENS = (
    "/notimed", "/noticia", "/noticias", "/novedad", "/novedades",
    "/prensa", "/comunicado", "/comunicados", "/blog", "/news", "/agenda",
    "/evento", "/eventos", "/boletin", "/newsletter", "/actualidad", "/actualidades",
    "/gacetilla", "/efemeride", "/efemerides",
)
NEWS_TEXT_HINTS = (
    "área de prensa", "sala de prensa", "novedades", "comunicados", "felicitamos",
    "efemérides", "día mundial", "saludo institucional", "gacetilla",
    "nota de prensa", "comunicado de prensa",
)
NOT_FOUND_PHRASES = ("página no encontrada", "pagina no encontrada")

TRACKING_PREFIX = "utm_"
TRACKING_PARAMS = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src")

# --- Fixed values: cleaning ---------------------------------------------------

STRUCTURAL_LABELS = ("materia:", "asignatura:", "carga horaria:", "programa:", "plan de estudios")
PRESS_MARK = "área de prensa"
NOISE_TAGS = ("header", "footer", "nav", "aside", "form")
NOISE_CLASSES = ("post-navigation", "sharedaddy", "comments-area")
CONTENT_CANDIDATES = (
    "main", ".entry-content", ".elementor-widget-theme-post-content",
    ".elementor-tab-content", ".e-n-tabs-content", "article", "body",
)
RELAXED_URL_TOKENS = ("/carreras/", "/plan-de-estudios", "/distribucion-de-asignaturas")

# --- Fixed values: answers ----------------------------------------------------

NO_INFO_RESPONSE = "No tengo información referente a eso."
NO_EVIDENCE_RESPONSE = (
    "No encontré evidencia suficiente en el sitio para responder con seguridad. "
    "¿Podés reformular la pregunta o ser más específico (carrera, año, trámite)?"
)
DECLINE_MARKERS = (
    "no tengo información", "no tengo informacion", "no encontré", "no encontre",
    "no llegué a", "no llegue a", "para responder bien", "decime la carrera",
    "decime primero la carrera", "podés reformular", "podes reformular",
    "podrías especificar", "podrias especificar", "podrías indicar", "podrias indicar",
    "necesito más detalles", "necesito mas detalles", "necesitaría que aclares",
    "necesitaria que aclares", "no puedo brindar información",
    "no puedo brindar informacion", "no puedo proporcionar", "lamentablemente no",
    "lo siento, pero no", NO_INFO_RESPONSE.lower(),
)
PROBE_DECLINE_MARKERS = (
    "no encontré evidencia", "no encontre evidencia", "no tengo información",
    "no tengo informacion", "no llegué a resolverlo", "no llegue a resolverlo",
    "no es algo que yo pueda responder",
)
GREETING_EMPTY = "Hola, estoy para ayudarte con lo que necesites."
GREETING_LEAD = "Hola, te ayudo con eso. "
GREETING_STARTS = ("hola", "buenas", "buen dia", "buen día")
GREETING_STRIP = r"^(?iu:(hola|buenas|buen\s+d[ií]a|buenas\s+tardes|buenas\s+noches))([,.:]|\s)+"
SOURCES_TAIL = r"(?is)\n*\s*fuentes?\s*:\s*.*$"
REFUSAL_CATEGORIES = ("ambiguous", "out_of_scope")

# --- Fixed values: curriculum and staff facts ----------------------------------

YEAR_LABELS = (
    (1, ("primer año", "primer anio", "1er año", "1er anio", "año 1", "anio 1")),
    (2, ("segundo año", "segundo anio", "2do año", "2do anio", "año 2", "anio 2")),
    (3, ("tercer año", "tercer anio", "3er año", "3er anio", "año 3", "anio 3")),
    (4, ("cuarto año", "cuarto anio", "4to año", "4to anio", "año 4", "anio 4")),
    (5, ("quinto año", "quinto anio", "5to año", "5to anio", "año 5", "anio 5")),
    (6, ("sexto año", "sexto anio", "6to año", "6to anio", "año 6", "anio 6")),
)
PROFILE_HINTS = (
    ("ingresantes", ("ingresantes", "ingreso", "admis", "inscrip")),
    ("estudiantes", ("estudiantes", "alumnos", "vida estudiantil")),
    ("docentes", ("docentes", "profesores", "cátedra", "catedra")),
    ("nodocentes", ("nodocentes", "no docentes", "personal")),
    ("directivos", ("directivos", "gestión", "gestion", "autoridades")),
)
PROFILE_SKIP_URLS = ("/ofertas-acad/", "/ofertas-academicas/", "/oferta-academica/")
PROCEDURE_PAGE_HINTS = ("tramite", "trámite", "mesa de entradas", "diploma", "titulo", "título")
PROCEDURE_URL_HINTS = ("tramite", "trámite", "diploma", "titulo")
ADMISSION_HINTS = ("admis", "ingres", "inscrip", "requisito")
ADMISSION_URL_HINTS = ("/ingreso", "/ingresantes", "/admis", "/inscrip", "/requisitos", "/aspirantes")

PROGRAM_CANONICAL_TOKENS = ("/carreras/", "/oferta-academica/", "/ofertas-academicas/")
PROGRAM_PAGE_TYPES = ("career_canonical", "curriculum")
FACT_SOURCE_TOKENS = ("/carreras/", "/plan-de-estudios", "/distribucion-de-asignaturas")
PROGRAM_PAGE_SIGNALS = (
    "duración de la carrera", "duracion de la carrera", "director de carrera",
    "dirección de carrera", "direccion de carrera", "coordinador de carrera",
    "responsable de carrera", "plan de estudios", "perfil del egresado",
    "alcances del título", "alcances del titulo", "incumbencias", "carga horaria",
    "materia:", "asignatura:",
)
PROGRAM_NAME_BLOCKED = (
    "programa", "analitico", "examen", "cohorte", "curso", "jornada", "congreso",
    "semillero", "residencia", "departamento", "resolucion",
)
PROGRAM_NAME_REQUIRED = (
    "medicina", "licenciatura en", "tecnicatura en", "doctorado en", "especializacion en",
)
PROGRAM_TITLE_BLOCKED = (
    "programa", "analitico", "cohorte", "curso", "jornada", "semillero", "ofertas acad",
)
PROGRAM_TITLE_PATTERN = (
    r"(?iu)\b(medicina|"
    r"lic\.?\s+en\s+[a-záéíóúñü\s]+|"
    r"licenciatura\s+en\s+[a-záéíóúñü\s]+|"
    r"tecnicatura\s+en\s+[a-záéíóúñü\s]+|"
    r"doctorado\s+en\s+[a-záéíóúñü\s]+|"
    r"especializaci[oó]n\s+en\s+[a-záéíóúñü\s]+)\b"
)
LOWER_WORDS = ("de", "del", "la", "las", "los", "y", "en")
DEGREE_WORDS = ("lic", "lic.", "licenciatura")
GENERAL_PROGRAM = "__general__"

PERSON_BLOCKED = (
    "licenciatura", "tecnicatura", "doctorado", "especializacion", "especialización",
    "enfermer", "kinesiolog", "medicina", "carrera", "plan de estudios", "oferta",
    "programa", "materia", "asignatura",
)
PERSON_TITLE_PREFIX = r"(?iu)^(dr\.?|dra\.?|lic\.?|mg\.?|msc\.?|prof\.?)\s+"
PERSON_WORD = r"^[A-Za-zÁÉÍÓÚÑÜáéíóúñü'`-]{2,}$"
PERSON_LINE_TITLE = r"(?iuU)\b(?:prof\.?|dr\.?|dra\.?|lic\.?|mgter\.?|mgtr\.?|mg\.?|esp\.?|msc\.?)\b"
PERSON_LINE_BLOCKED = ("@", "http://", "https://", "cuerpo docente", "plan de estudios")

SUBJECT_BLOCKED = (
    "periodo", "período", "matricul", "clave", "aula virtual", "inscrip", "resoluci",
    "descargar", "hacer clic", "link", "pdf", "www.", "http", "siu", "calendario",
    "cronograma", "lunes", "martes", "miercoles", "miércoles", "jueves", "viernes",
    "sabado", "sábado", "domingo",
    "primer año", "primer anio", "segundo año", "segundo anio", "tercer año",
    "tercer anio", "cuarto año", "cuarto anio", "quinto año", "quinto anio",
    "sexto año", "sexto anio",
)
SUBJECT_PATTERNS = (
    r"(?:^|\n)\s*materia\s*:\s*([^\n]{3,120})",
    r"(?:^|\n)\s*materia\s*:\s*\n+\s*([^\n]{3,120})",
    r"(?:^|\n)\s*asignatura\s*:\s*([^\n]{3,120})",
    r"(?:^|\n)\s*asignatura\s*:\s*\n+\s*([^\n]{3,120})",
    r"(?:^|\n)\s*-\s*([A-ZÁÉÍÓÚÑÜ][A-ZÁÉÍÓÚÑÜ0-9\s\-/]{3,120})\s*(?:\n|$)",
    r"(?:^|\n)\s*([A-ZÁÉÍÓÚÑÜ][A-Za-zÁÉÍÓÚÑÜáéíóúñü0-9\s().,\-/]{3,120})\s*\|",
)
DIRECTOR_PATTERNS = (
    r"(?:director(?:a)?\s+de\s+carrera|direcci[oó]n\s+de\s+carrera|coordinador(?:a)?\s+de\s+carrera|responsable\s+de\s+carrera)\s*[:\-]\s*([^\n|]{3,120})",
    r"(?:director(?:a)?\s+de\s+(?:la\s+)?carrera(?:\s+de)?[^\n:|]{0,90}?)\s+(?:es\s+)?([A-ZÁÉÍÓÚÑ][^\n|]{3,120})",
    r"\|\s*(?:director(?:a)?\s+de\s+carrera|direcci[oó]n\s+de\s+carrera|coordinador(?:a)?\s+de\s+carrera)\s*\|\s*([^\|\n]{3,120})\|",
    r"(?:^|\n)\s*#{1,6}\s*(?:director(?:a)?|direcci[oó]n)(?:\s+de\s+carrera)[^\n]*\n+\s*([^\n|]{3,120})",
    r"(?:^|\n)\s*(?:director(?:a)?|direcci[oó]n)(?:\s+de\s+carrera)[^\n]*\n+\s*([^\n|]{3,120})",
)
DIRECTOR_PATTERNS_LOOSE = (
    r"(?:director(?:a)?|coordinador(?:a)?|jef(?:e|a)\s+de\s+carrera)\s*[:\-]\s*([^\n|]{3,120})",
    r"\|\s*(?:director(?:a)?|coordinador(?:a)?)\s*\|\s*([^\|\n]{3,120})\|",
    r"(?:^|\n)\s*#{1,6}\s*(?:director(?:a)?|coordinador(?:a)?)[^\n]*\n+\s*([^\n|]{3,120})",
    r"(?:^|\n)\s*(?:director(?:a)?|coordinador(?:a)?)[^\n]*\n+\s*([^\n|]{3,120})",
)
SECRETARY_PATTERNS = (
    r"(?:secretario(?:a)?\s+acad[eé]mic[oa])\s*[:\-]\s*([^\n|]{3,120})",
    r"(?:secretar[ií]a\s+acad[eé]mica|coordinaci[oó]n\s+acad[eé]mica)\s*[:\-]\s*([^\n|]{3,120})",
    r"\|\s*(?:secretario(?:a)?\s+acad[eé]mic[oa])\s*\|\s*([^\|\n]{3,120})\|",
    r"(?:^|\n)\s*#{1,6}\s*(?:secretario(?:a)?\s+acad[eé]mic[oa])\s*\n+\s*([^\n|]{3,120})",
    r"(?:^|\n)\s*(?:secretario(?:a)?\s+acad[eé]mic[oa])\s*\n+\s*([^\n|]{3,120})",
)
DURATION_PATTERNS = (
    r"(?:duraci[oó]n(?:\s+de\s+la\s+carrera)?|duraci[oó]n)\s*[:\-]\s*([^\n]{2,80})",
    r"(?:duraci[oó]n[^\n]{0,30})(\d+\s*(?:a[nñ]os|años)(?:\s+y\s+\d+\s*(?:meses|mes))?)",
)
DURATION_YEARS = r"(?iuU)(\d{1,2})\s*(?:a[nñ]os|años)\b"

# --- Fixed values: sizes and limits --------------------------------------------

CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
FIXED_CHUNK_SIZE = 1500
FIXED_CHUNK_OVERLAP = 200
WINDOW_DOC_BUDGET = 8000
WINDOW_HEAD = 2000
WINDOW_HALF = 1000
CONTEXT_CLIP = 600
TOP_K_DENSE = 40
TOP_K_LEXICAL = 40
TOP_K_SCOPED = 18
RRF_C = 60
RRF_TOP = 60
FINAL_TOP = 14
NEIGHBOR_RADIUS = 3
NEIGHBOR_TOP = 4
SCOPED_KEEP = 6
SCOPED_URL_PATTERN = r"/carreras/[^/]+$"
CONTEXT_CHARS = 22000
PROMPT_CHARS = 32000
PROMPT_MIN_CONTEXT = 1000
HISTORY_ITEMS = 12
HISTORY_ITEM_CHARS = 500
HISTORY_TOTAL_CHARS = 5000
REWRITE_ITEMS = 6
REWRITE_CHARS = 1500
REWRITE_OUTPUT_CHARS = 400
GROUNDED_MIN = 0.4
JUDGE_CONTEXT_CHARS = 12000
EMPTY_CONTEXT = "(sin contexto recuperado)"
BLOCK_JOIN = "\n\n---\n\n"


@dataclass(frozen=True)
class PageRules:
    """Rule set for page classification and page validity; override any field."""

    block_tokens: tuple = BLOCK_TOKENS
    news_tokens: tuple = NEWS_BLOCK_TOKENS
    class_rules: tuple = CLASS_RULES
    pdf_rules: tuple = PDF_RULES
    default_class: tuple = DEFAULT_CLASS
    career_signals: tuple = CAREER_SIGNALS
    procedure_signals: tuple = PROCEDURE_SIGNALS
    priority_tokens: tuple = PRIORITY_TOKENS
    news_exempt: tuple = NEWS_EXEMPT_TOKENS
    news_url_tokens: tuple = NEWS_URL_TOKENS
    news_hints: tuple = NEWS_TEXT_HINTS
    not_found: tuple = NOT_FOUND_PHRASES
    min_words: int = 5
    news_chars: int = 1000  # of the text, looked at for news hints
    upgrade_chars: int = 3000  # of the text, looked at for class signals
    block_globs: tuple = field(default=BLOCK_GLOBS)
