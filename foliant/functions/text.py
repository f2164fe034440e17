"""Column helpers for text: trimming, token lists, in-row ordered de-duplication.

All helpers stay inside the row, so none of them causes a shuffle.  Arrays are
handled with a sort (n log n) instead of membership scans, which keeps very
long documents cheap.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as blank at the ends of a string.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
FACT_TRIM = " .:-\t"
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\x85\u2028\u2029]"
TOKEN_BREAK = r"[^\p{L}0-9]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str, chars: str = BLANKS) -> Column:
    return F.btrim(col(c), F.lit(chars))


def rstrip(c: Column | str, chars: str = BLANKS) -> Column:
    return F.rtrim(col(c), F.lit(chars))


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def squeeze(c: Column | str) -> Column:
    """Collapse every run of blanks to one space."""
    return F.regexp_replace(col(c), r"(?U)\s+", " ")


def literal_pattern(tokens: Sequence[str]) -> str:
    """Regex matching any of the literal ``tokens``; a shared head is factored out."""
    head = _shared_head(tokens)
    if len(tokens) == 1:
        return re.escape(tokens[0])
    return re.escape(head) + "(?:" + "|".join(re.escape(t[len(head):]) for t in tokens) + ")"


def _shared_head(tokens: Sequence[str]) -> str:
    low, high = min(tokens), max(tokens)
    n = 0
    while n < min(len(low), len(high)) and low[n] == high[n]:
        n += 1
    return low[:n]


def contains_any(c: Column, tokens: Sequence[str]) -> Column:
    """True when any literal token occurs; one compiled pattern, whatever the list size."""
    if not tokens:
        return F.lit(False)
    return c.rlike(literal_pattern(tokens))


def first_contained(c: Column, tokens: Sequence[str]) -> Column:
    """First token, in list order, that occurs in ``c`` (null when none does)."""
    hits = F.filter(F.array(*[F.lit(t) for t in tokens]), lambda t: F.instr(c, t) > 0)
    return F.get(hits, F.lit(0))


def count_contained(c: Column, tokens: Sequence[str]) -> Column:
    total = F.lit(0)
    for t in tokens:
        total = total + c.contains(t).cast("int")
    return total


def glob_pattern(globs: Sequence[str]) -> str:
    """Regex for shell-style globs (``*`` any run, ``?`` one character), matched whole.

    Globs of the form ``*literal*`` - the usual case - become one literal
    alternation; the others are anchored one by one.
    """
    inner, anchored = [], []
    for g in globs:
        body = g[1:-1]
        if len(g) > 2 and g[0] == g[-1] == "*" and not set(body) & set("*?["):
            inner.append(body)
        elif len(g) > 2 and g[0] == g[-1] == "*":
            inner.append(None)
            anchored.append(_glob_body(body))
        else:
            anchored.append("^" + _glob_body(g) + "$")
    parts = [re.escape(b) for b in inner if b is not None] + anchored
    return "(?s)" + "|".join(f"(?:{p})" for p in parts)


def _glob_body(g: str) -> str:
    return "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in g)


def lines(c: Column | str) -> Column:
    return F.split(col(c), LINE_BREAK)


def tokens(c: Column | str) -> Column:
    """Lower-case words: maximal runs of letters and digits."""
    return F.filter(F.split(F.lower(col(c)), TOKEN_BREAK), lambda t: t != "")


def word_count(c: Column | str) -> Column:
    return F.size(F.filter(F.split(col(c), r"(?U)\s+"), lambda t: t != ""))


def drop_repeats(items: Column) -> Column:
    """Drop an item equal to the one before it."""
    return let(
        items,
        lambda xs: F.filter(xs, lambda x, i: (i == 0) | (x != F.get(xs, i - 1))),
    )


def limit_repeats(items: Column, key: Callable[[Column], Column], allowed: Callable[[Column], Column]) -> Column:
    """Keep the first ``allowed(key)`` items of every key, in the original order.

    ``allowed`` returns null for "no limit".  The array is sorted by (key,
    position); item ``i`` is one too many exactly when item ``i - allowed`` still
    has the same key.
    """
    keyed = F.sort_array(
        F.transform(items, lambda v, i: F.struct(key(v).alias("k"), i.alias("i"), v.alias("v")))
    )

    def kept(xs: Column) -> Column:
        def ok(x: Column, i: Column) -> Column:
            n = allowed(x["k"])
            back = F.get(xs, F.when(i >= n, i - n).otherwise(F.lit(-1)))["k"]
            return n.isNull() | back.isNull() | (back != x["k"])

        return F.filter(xs, ok)

    back_in_order = F.sort_array(
        F.transform(let(keyed, kept), lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v")))
    )
    return F.transform(back_in_order, lambda x: x["v"])


def distinct_first(items: Column, key: Callable[[Column], Column] = lambda v: v) -> Column:
    """Order-preserving de-duplication by ``key``: the first item of each key stays."""
    return limit_repeats(items, key, lambda k: F.lit(1))


def clip(c: Column | str, max_chars: int) -> Column:
    """Cut to ``max_chars`` with a closing ellipsis."""
    c = text_or_empty(c)
    return F.when(F.length(c) <= max_chars, c).otherwise(
        F.concat(rstrip(F.substring(c, 1, max(0, max_chars - 1))), F.lit("…"))
    )


def clip_at_space(c: Column | str, max_chars: int) -> Column:
    """Cut to ``max_chars`` and back to the last space, when there is one."""
    c = col(c)
    cut = F.substring(c, 1, max_chars)
    return F.when(F.length(c) <= max_chars, c).otherwise(F.regexp_replace(cut, " [^ ]*$", ""))


def cut_marked(c: Column, max_chars: int, mark: str) -> Column:
    return F.when(F.length(c) <= max_chars, c).otherwise(
        F.concat(F.substring(c, 1, max_chars), F.lit(mark))
    )


def slug(c: Column | str) -> Column:
    s = F.btrim(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(s == "", F.lit("page")).otherwise(s)
