"""Predicates, globs and patterns as columns. Nothing here sees data: each builder returns an expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang.statement import Predicate, QueryError

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def integer(text: Column) -> Column:
    """The integer that a string spells, null for anything else (blanks, fractions, too many digits)."""
    return F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("bigint"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def like(text: Column, pattern: str) -> Column:
    """``%`` and ``_`` over the whole string, ASCII letters in either case, no escape character."""
    folded = pattern.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\")
    return ascii_lower(text).like(folded)


def regex(pattern: str) -> str:
    """A pattern in the JVM's dialect: Unicode classes, ``.`` that only stops at line feeds, ``$`` only at the end."""
    if re.search(r"\(\?<?[=!]", pattern) or re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern):
        raise QueryError(f"look-around and back-references are not supported: {pattern!r}")
    try:
        re.compile(pattern)
    except re.error as e:
        raise QueryError(f"invalid pattern {pattern!r}: {e}") from None
    out, at, inside = [], 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            out.append(pattern[at : at + 2])
            at += 2
            continue
        inside = (inside or c == "[") and c != "]"
        out.append(r"\z" if c == "$" and not inside and "(?m" not in pattern else c)
        at += 1
    return "(?Ud)" + "".join(out)


def matches(text: Column, pattern: str) -> Column:
    """Unanchored search; ``.{N,}`` alone asks for at least N bytes."""
    if m := re.fullmatch(r"\.\{([0-9]+),\}", pattern):
        return F.octet_length(text) >= int(m[1])
    return text.rlike(regex(pattern))


def glob_of(glob: str) -> str:
    """Without wildcards, a path that ends with a slash or has no dot in its last segment is a directory: all below it."""
    bare = glob.rstrip("/")
    if "*" in glob or "?" in glob or not (glob.endswith("/") or "." not in bare.rpartition("/")[2]):
        return glob
    return bare + "/**"


def glob_regex(glob: str) -> str:
    """``**`` spans any number of segments, ``*`` and ``?`` stay inside one; the glob may match from any segment on."""
    parts, out = glob_of(glob).split("/"), ""
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += "(?:[^/]+(?:/[^/]+)*)?" if last else "(?:[^/]+/)*"
            continue
        out += "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in part)
        out += "" if last else "/"
    return f"^(?:.*/)?{out}\\z"


def within(path: Column, glob: str) -> Column:
    return path.rlike(glob_regex(glob))


def outside(path: Column, glob: str) -> Column:
    return F.coalesce(~path.rlike(glob_regex(glob)), F.lit(True))


def compiled(p: Predicate, text: Column | None, number: Column | None, batch: bool) -> Column:
    """A filter over a field's text and number. A missing field makes it null, which a filter drops; only NOT MATCHES in
    WHERE (``batch``) keeps it. Nothing wraps a comparison, so that it can be pushed into the scan."""
    no = F.lit(False)
    missing = F.lit(None).cast("string")
    text = missing if text is None else text
    number = integer(text) if number is None else number
    if p.op in ("MATCHES", "NOT MATCHES"):
        hit = matches(text, str(p.value))
        return hit if p.op == "MATCHES" else F.coalesce(~hit, F.lit(True)) if batch else ~hit
    if p.op in ("LIKE", "NOT LIKE"):
        hit = like(text, str(p.value))
        return hit if p.op == "LIKE" else ~hit
    if isinstance(p.value, bool):
        return no
    if p.op in ("=", "!="):
        side = number if isinstance(p.value, int) else text
        return side == F.lit(p.value) if p.op == "=" else side != F.lit(p.value)
    if not isinstance(p.value, int):
        return no
    return {">": number > p.value, ">=": number >= p.value, "<": number < p.value, "<=": number <= p.value}[p.op]
