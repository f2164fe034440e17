"""HTML columns: regex forms that stay in the JVM, and one small parser helper.

The regex form is the default for large corpora.  The parser (`parse_page`)
follows the element tree and is used by ``operators.cleaning.html_to_text``.
"""

from __future__ import annotations

from html.entities import name2codepoint
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant import rules
from foliant.functions.text import drop_repeats, lines, strip, text_or_empty

TITLE = r"(?is)<title[^>]*>(.*?)</title>"
HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<title\b.*?</title\s*>|<!--.*?-->"
NOISE = "(?is)" + "|".join(rf"<{t}\b.*?</{t}\s*>" for t in rules.NOISE_TAGS)
BLOCK_END = r"(?is)</?(?:p|div|section|article|main|body|html|head|table|tr|td|th|ul|ol|h[1-6]|li|br)\b[^>]*>"
ANY_TAG = r"(?s)<[^>]*>"
HREF = r"""(?is)<a\b[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
MARKDOWN_DOC_LINK = r"(?i)\[[^\]]+\]\(([^)]+\.pdf(?:\?[^)]*)?)\)"
ENTITY = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def decode_entities(c: Column | str) -> Column:
    """Named, decimal and hexadecimal character references as their characters; each is decoded once.

    A no-break space becomes a plain one.  Unknown names and numbers that are no
    character stay as they are.
    """
    s = text_or_empty(c)
    names = F.create_map(*[F.lit(x) for k, v in name2codepoint.items() for x in (k, 32 if v == 160 else v)])

    def piece(p: Column) -> Column:
        name = F.regexp_extract(p, ENTITY, 1)
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 8), 16, 10)).when(
            name.startswith("#"), F.substring(name, 2, 8)).cast("int")
        code = F.coalesce(F.when(number == 160, F.lit(32)).otherwise(number), F.try_element_at(names, name))
        valid = F.coalesce(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), F.lit(False))
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(F.lit(32))), 8, "0")), "UTF-32")
        return F.when(valid, F.concat(char, F.regexp_replace(p, ENTITY, ""))).otherwise(F.concat(F.lit("&"), p))

    parts = F.split(s, "&", -1)
    tail = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), piece)
    return F.when(s.contains("&"), F.concat(parts[0], F.array_join(tail, ""))).otherwise(s)


def title(html: Column | str) -> Column:
    return strip(decode_entities(F.regexp_extract(text_or_empty(html), TITLE, 1)))


def hrefs(html: Column | str) -> Column:
    """All anchor targets in page order: quoted either way or not at all, references decoded."""
    found = F.regexp_extract_all(text_or_empty(html), F.lit(HREF), 1)
    return F.transform(found, lambda v: decode_entities(F.regexp_replace(v, r"""^["']|["']$""", "")))


def text_from_html(html: Column | str) -> Column:
    """Readable text with ``#`` headings and ``-`` items, by patterns only."""
    h = text_or_empty(html)
    h = F.regexp_replace(h, HIDDEN, " ")
    h = F.regexp_replace(h, NOISE, "\n")
    h = F.regexp_replace(h, r"(?i)<h1\b[^>]*>", "\n# ")
    h = F.regexp_replace(h, r"(?i)<h2\b[^>]*>", "\n## ")
    h = F.regexp_replace(h, r"(?i)<h3\b[^>]*>", "\n### ")
    h = F.regexp_replace(h, r"(?i)<h[456]\b[^>]*>", "\n#### ")
    h = F.regexp_replace(h, r"(?i)<li\b[^>]*>", "\n- ")
    h = F.regexp_replace(h, BLOCK_END, "\n")
    h = F.regexp_replace(h, ANY_TAG, "")
    h = decode_entities(h)
    kept = F.filter(
        F.transform(lines(h), lambda x: strip(F.regexp_replace(x, r"\s+", " "))),
        lambda x: (x != "") & (x != "-") & ~x.rlike(r"^#{1,4}$"),
    )
    return F.array_join(drop_repeats(kept), "\n")


def blocks_from_html(html: Column | str) -> Column:
    """Array of struct(text, link_chars): block-level pieces with the size of their link text."""
    h = F.regexp_replace(text_or_empty(html), HIDDEN, " ")
    h = F.regexp_replace(h, NOISE, "\n")
    raw = F.split(h, BLOCK_END)

    def measure(b: Column) -> Column:
        link_text = F.array_join(F.regexp_extract_all(b, F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), 1), "")
        return F.struct(
            strip(F.regexp_replace(decode_entities(F.regexp_replace(b, ANY_TAG, "")), r"\s+", " ")).alias("text"),
            F.length(F.regexp_replace(link_text, ANY_TAG, "")).alias("link_chars"),
        )

    return F.filter(F.transform(raw, measure), lambda x: x["text"] != "")


# --- element tree, used once per page inside an Arrow batch -------------------

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_LEAD = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "h5": "#### ", "h6": "#### ", "li": "- "}
_PLAIN = {"p", "div", "section", "td", "th"}


class _Element:
    __slots__ = ("name", "classes", "items")

    def __init__(self, name: str, classes: tuple = ()):
        self.name, self.classes, self.items = name, classes, []

    def walk(self):
        stack = list(reversed(self.items))
        while stack:
            node = stack.pop()
            if isinstance(node, _Element):
                yield node
                stack.extend(reversed(node.items))

    def text(self) -> str:
        parts, stack = [], list(reversed(self.items))
        while stack:
            node = stack.pop()
            if isinstance(node, _Element):
                stack.extend(reversed(node.items))
            else:
                parts.append(node.strip())
        return "".join(parts)


class _TreeReader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Element("[root]")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        classes = tuple((dict(attrs).get("class") or "").split())
        el = _Element(tag, classes)
        self.open[-1].items.append(el)
        if tag not in _VOID:
            self.open.append(el)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].items.append(_Element(tag))

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].name == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        self.open[-1].items.append(data)


def parse_page(html: str) -> tuple[str, str]:
    """(title, text) of one page: noise removed, best content element, one line per block."""
    reader = _TreeReader()
    reader.feed(html or "")
    reader.close()
    root = reader.root
    titles = [e for e in root.walk() if e.name == "title"]
    page_title = titles[0].text() if titles else ""
    for parent in [root, *root.walk()]:
        parent.items = [
            n for n in parent.items
            if not (isinstance(n, _Element)
                    and (n.name in rules.NOISE_TAGS or set(n.classes) & set(rules.NOISE_CLASSES)))
        ]
    target = None
    for want in rules.CONTENT_CANDIDATES:
        target = next((e for e in root.walk()
                       if (want[1:] in e.classes if want[0] == "." else e.name == want)), None)
        if target is not None:
            break
    if target is None:
        return page_title, ""
    out: list[str] = []
    for el in target.walk():
        if el.name not in _LEAD and el.name not in _PLAIN:
            continue
        body = el.text()
        if not body:
            continue
        line = _LEAD.get(el.name, "") + body
        if not out or out[-1] != line:
            out.append(line)
    return page_title, "\n\n".join(out)
