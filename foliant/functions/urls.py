"""URL columns built on one lenient pattern (engine URL parsers reject too much)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant import rules
from foliant.functions.text import col, contains_any, glob_pattern, strip, text_or_empty

URL_PATTERN = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
UUID_PATTERN = r"(?i)^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$"


def _part(c: Column | str, group: int) -> Column:
    return F.regexp_extract(strip(text_or_empty(c)), URL_PATTERN, group)


def scheme(c: Column | str) -> Column:
    return F.lower(_part(c, 1))


def netloc(c: Column | str) -> Column:
    return _part(c, 2)


def path(c: Column | str) -> Column:
    return _part(c, 3)


def query(c: Column | str) -> Column:
    return _part(c, 4)


def host_exact(c: Column | str) -> Column:
    """Lower-case host of a URL or of a bare host, without port and outer dots."""
    raw = F.lower(strip(text_or_empty(c)))
    from_url = F.regexp_replace(
        F.regexp_replace(F.regexp_extract(raw, r"^[^:]*://([^/?#]*)", 1), r"^.*@", ""), r":.*$", ""
    )
    host = F.when(raw.contains("://"), from_url).otherwise(F.substring_index(raw, ":", 1))
    return F.btrim(strip(host), F.lit("."))


def registered_domain(c: Column | str) -> Column:
    """Exact host without a leading ``www.``."""
    return F.regexp_replace(host_exact(c), r"^www\.", "")


def domain_variants(c: Column | str) -> Column:
    """``[d, www.d]`` for a domain, an empty array for a blank one."""
    d = registered_domain(c)
    return F.when(d == "", F.array().cast("array<string>")).otherwise(
        F.array(d, F.concat(F.lit("www."), d))
    )


def domains_equivalent(left: Column | str, right: Column | str) -> Column:
    a, b = registered_domain(left), registered_domain(right)
    return (a != "") & (a == b)


def origin_of(c: Column | str) -> Column:
    """``scheme://netloc`` in lower case, empty when either part is missing."""
    s, n = scheme(c), F.lower(netloc(c))
    return F.when((s == "") | (n == ""), F.lit("")).otherwise(F.concat(s, F.lit("://"), n))


def allowed_origins(domain: Column | str, test_origin: str = "") -> Column:
    variants = F.transform(domain_variants(domain), lambda h: F.concat(F.lit("https://"), h))
    if not test_origin:
        return F.array_distinct(variants)
    extra = F.when(F.size(variants) > 0, F.array(F.lit(test_origin)))
    return F.array_distinct(F.concat(variants, F.coalesce(extra, F.array().cast("array<string>"))))


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def canonical_query(q: Column, tracking: Sequence[str] = rules.TRACKING_PARAMS) -> Column:
    """Drop tracking parameters, keep blanks, order by (lower key, value)."""
    pairs = F.filter(F.split(q, "&"), lambda p: p != "")
    fields = F.transform(
        pairs,
        lambda p, i: F.struct(
            F.lower(_decode(F.substring_index(p, "=", 1))).alias("lk"),
            _decode(F.regexp_extract(p, "(?s)=(.*)$", 1)).alias("v"),
            i.alias("i"),
            _decode(F.substring_index(p, "=", 1)).alias("k"),
        ),
    )
    kept = F.filter(
        fields,
        lambda x: ~(x["lk"].startswith(rules.TRACKING_PREFIX) | x["lk"].isin(list(tracking))),
    )
    return F.array_join(
        F.transform(F.sort_array(kept), lambda x: F.concat(_encode(x["k"]), F.lit("="), _encode(x["v"]))),
        "&",
    )


def canonical_url(c: Column | str) -> Column:
    """One spelling per page: lower scheme and host, tidy path, sorted useful parameters."""
    raw = strip(text_or_empty(c))
    s = F.when(scheme(raw) == "", F.lit("https")).otherwise(scheme(raw))
    tidy = F.regexp_replace(path(raw), "/{2,}", "/")
    tidy = F.when(tidy == "", F.lit("/")).otherwise(tidy)
    tidy = F.when(tidy == "/", tidy).otherwise(F.regexp_replace(tidy, "/$", ""))
    q = canonical_query(query(raw))
    return F.concat(
        s, F.lit("://"), registered_domain(netloc(raw)), tidy,
        F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)),
    )


def host_allowed(c: Column | str, host: Column | str) -> Column:
    """HTTPS and exactly the allowed host."""
    allowed = host_exact(host if isinstance(host, Column) else F.lit(host))
    return (scheme(c) == "https") & (allowed != "") & (host_exact(netloc(c)) == allowed)


def url_blocked(c: Column | str, globs: Sequence[str] = rules.BLOCK_GLOBS) -> Column:
    if not globs:
        return F.lit(False)
    return F.lower(text_or_empty(c)).rlike(glob_pattern(globs))


def is_document_link(c: Column | str) -> Column:
    low = F.lower(col(c))
    return low.endswith(".pdf") | low.contains(".pdf?")


def is_recent_document(c: Column | str, year: int, lookback: int = 5) -> Column:
    """A year ``20dd`` in the URL within ``[year - lookback, year]``; no year means no."""
    years = F.transform(F.regexp_extract_all(text_or_empty(c), F.lit(r"(20\d{2})"), 1), lambda y: y.cast("int"))
    return F.exists(years, lambda y: y.between(year - max(0, lookback), year))


def matches_priority(url: Column | str, title: Column | str, tokens: Sequence[str] = rules.PRIORITY_TOKENS) -> Column:
    hay = F.concat_ws(" ", F.lower(text_or_empty(url)), F.lower(text_or_empty(title)))
    return contains_any(hay, tokens)


def looks_like_uuid(c: Column | str) -> Column:
    return strip(text_or_empty(c)).rlike(UUID_PATTERN)


def file_name(c: Column | str) -> Column:
    """Last path part, percent-decoded."""
    p = path(c)
    decoded = F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p)
    return F.when(decoded.contains("/"), F.substring_index(decoded, "/", -1)).otherwise(F.lit(""))


def title_from_file_name(name: Column | str) -> Column:
    n = col(name)
    stem = F.when(n.contains("."), F.regexp_replace(n, r"\.[^.]*$", "")).otherwise(n)
    spaced = strip(F.regexp_replace(F.translate(stem, "-_", "  "), r"(?U)\s+", " "))
    # A capital after every non-letter, not only after blanks.
    runs = F.regexp_extract_all(F.lower(spaced), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), "")


def document_title(meta_title: Column | str, name: Column | str) -> Column:
    t = strip(text_or_empty(meta_title))
    empty = F.lower(t).isin("", "untitled", "microsoft word")
    return F.when(empty, title_from_file_name(name)).otherwise(t)


def export_name(url: Column | str, title: Column | str) -> Column:
    """``<slug up to 80>-<first 10 of sha1(url)>.md``."""
    from foliant.functions.text import slug

    base = F.when(text_or_empty(title) == "", text_or_empty(url)).otherwise(text_or_empty(title))
    return F.concat(
        F.substring(slug(base), 1, 80), F.lit("-"), F.substring(F.sha1(text_or_empty(url)), 1, 10), F.lit(".md")
    )


def resolve_link(base: Column | str, href: Column | str) -> Column:
    """Absolute form of ``href`` seen on page ``base``, dot segments removed."""
    h, b = strip(text_or_empty(href)), col(base)
    root = F.concat(scheme(b), F.lit("://"), netloc(b))
    folder = F.regexp_replace(path(b), "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    own = F.regexp_replace(strip(text_or_empty(b)), "#.*$", "")
    own_path = F.when(path(b) == "", F.lit("")).otherwise(path(b))
    joined = (
        F.when(h == "", own)
        .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme(b), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(root, _undot(h)))
        .when(h.startswith("?"), F.concat(root, own_path, h))
        .when(h.startswith("#"), F.concat(own, h))
        .otherwise(F.concat(root, _undot(F.concat(folder, h))))
    )
    return joined


def _undot(p: Column) -> Column:
    """Remove ``.`` and ``..`` segments of an absolute path (query and fragment untouched)."""
    pure = F.regexp_extract(p, r"^([^?#]*)", 1)
    tail = F.regexp_extract(p, r"^[^?#]*(.*)$", 1)
    segs = F.split(pure, "/")
    walked = F.aggregate(
        segs,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    closing = F.when(pure.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    plain = F.when(pure.rlike(r"/\.{1,2}(?:/|$)"), F.concat(F.array_join(walked, "/"), closing)).otherwise(pure)
    return F.concat(plain, tail)
