"""Derived fields of names, numbers, comments and conditions, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TODO_TAGS = ("TODO", "FIXME", "HACK", "XXX")


def naming_style(name: Column) -> Column:
    """ASCII tests in a fixed order: UPPER_SNAKE, snake_case, kebab-case, PascalCase, camelCase, flatcase, mixed."""
    upper, lower, bar = name.rlike("[A-Z]"), name.rlike("[a-z]"), F.contains(name, F.lit("_"))
    return (
        F.when(bar & upper & ~lower, "UPPER_SNAKE")
        .when(bar & lower, "snake_case")
        .when(F.contains(name, F.lit("-")), "kebab-case")
        .when(name.rlike("^[A-Z]") & lower, "PascalCase")
        .when(name.rlike("^[a-z]") & upper, "camelCase")
        .when(lower & ~upper, "flatcase")
        .otherwise("mixed")
    )


def name_length(name: Column) -> Column:
    return F.octet_length(name)


def comment_style(comment: Column) -> Column:
    """The kind of a comment by its longest known prefix."""
    return (
        F.when(comment.rlike(r"^(/\*\*|/\*!)"), "doc_block")
        .when(comment.rlike(r"^(///|//!)"), "doc_line")
        .when(comment.startswith("/*"), "block")
        .otherwise("line")
    )


def number_body(literal: Column) -> Column:
    """The literal without separators, sign and suffix; hexadecimal digits are no suffix."""
    plain = F.regexp_replace(F.regexp_replace(literal, "[_']", ""), "^[+-]", "")
    bare = lambda p: F.when(p.rlike("^0[xX]"), F.regexp_replace(p, "[uUlL]+$", "")).otherwise(
        F.regexp_replace(p, "([0-9.])(?:[uUlLfF]+|[iu](?:8|16|32|64|128|size)|f(?:32|64))$", "$1")
    )
    return let(plain, bare)


def number_suffix(literal: Column) -> Column:
    plain = F.regexp_replace(literal, "[_']", "")
    return F.when(plain.rlike("^[+-]?0[xX]"), F.regexp_extract(plain, "([uUlL]*)$", 1)).otherwise(
        F.regexp_extract(plain, "[0-9.]((?:[uUlLfF]+|[iu](?:8|16|32|64|128|size)|f(?:32|64))?)$", 1)
    )


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` a value that is computed once, however often ``of`` names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _format_of(body: Column) -> Column:
    return (
        F.when(body.rlike("^0[xX]"), "hex")
        .when(body.rlike("^0[bB]"), "bin")
        .when(body.rlike("^0[oO]?[0-7]+$"), "oct")
        .when(body.rlike("[eE]"), "scientific")
        .when(F.contains(body, F.lit(".")), "float")
        .otherwise("dec")
    )


def _value_of(body: Column, kind: Column, negative: Column) -> Column:
    based = lambda prefix, base, most: F.when(
        F.length(F.regexp_replace(body, prefix, "")).between(1, most), F.conv(F.regexp_replace(body, prefix, ""), base, 10).try_cast("bigint")
    )
    value = (
        F.when(kind == "hex", based("^0[xX]0*(?=.)", 16, 15))
        .when(kind == "bin", based("^0[bB]0*(?=.)", 2, 62))
        .when(kind == "oct", based("^0[oO]?0*(?=.)", 8, 20))
        .when(kind.isin("scientific", "float"), F.when(F.abs(body.try_cast("double")) < 9e18, body.try_cast("double")).cast("bigint"))
        .otherwise(body.try_cast("bigint"))
    )
    return let(value, lambda v: F.coalesce(F.when(negative, -v).otherwise(v), F.lit(0)).cast("bigint"))


def number_format(literal: Column) -> Column:
    """hex, bin, oct, scientific, float, dec: the first that fits, so 0xE1 is hex and 0 is dec."""
    return let(number_body(literal), _format_of)


def number_value(literal: Column) -> Column:
    """The value as a whole number: fractions are cut off, what doesn't fit or parse is 0."""
    return let(number_body(literal), lambda body: let(_format_of(body), lambda kind: _value_of(body, kind, literal.startswith("-"))))


def has_separator(literal: Column) -> Column:
    return literal.rlike("[_']")


def paren_depth(text: Column) -> Column:
    """The deepest nesting of parentheses, in one fold over the parentheses alone."""
    marks = F.split(F.regexp_replace(text, "[^()]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, c: Column) -> Column:
        now = F.when(c == "(", a["now"] + 1).when(c == ")", F.greatest(a["now"] - 1, F.lit(0))).otherwise(a["now"])
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.aggregate(marks, start, step, lambda a: a["most"])


def condition_tests(text: Column) -> Column:
    """Logical operators and one."""
    return F.regexp_count(text, F.lit(r"&&|\|\||\band\b|\bor\b")) + 1


def mixed_logic(text: Column) -> Column:
    """``&&`` and ``||`` both outside parentheses, once outer parentheses are off: both at the least depth of what is not a
    parenthesis, or of a place between two groups."""
    marks = F.regexp_extract_all(text, F.lit(r"&&|\|\||\)\s*\(|[()]|[^()\s]"), F.lit(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(2**31 - 1).alias("low"), F.lit(False).alias("all"), F.lit(False).alias("any"))

    def step(a: Column, c: Column) -> Column:
        joint = c.startswith(")") & (F.length(c) > 1)
        now = F.when(c == "(", a["now"] + 1).when(c == ")", F.greatest(a["now"] - 1, F.lit(0))).otherwise(a["now"])
        at = F.when(joint, F.greatest(a["now"] - 1, F.lit(0))).when(~c.isin("(", ")"), a["now"]).otherwise(F.lit(2**31 - 1))
        seen = lambda field, op: F.when(at < a["low"], c == op).otherwise(a[field] | ((at == a["low"]) & (c == op)))
        return F.struct(now.alias("now"), F.least(a["low"], at).alias("low"), seen("all", "&&").alias("all"), seen("any", "||").alias("any"))

    return F.aggregate(marks, start, step, lambda a: a["all"] & a["any"])


def has_assignment(text: Column) -> Column:
    return text.rlike(r"(?<![=!<>+\-*/%&|^])=(?![=])")


def todo_count(text: Column) -> Column:
    return sum((F.regexp_count(text, F.lit(f"(?i)(?<![A-Za-z0-9]){t}(?![A-Za-z0-9])")) for t in TODO_TAGS[1:]), F.regexp_count(text, F.lit(f"(?i)(?<![A-Za-z0-9]){TODO_TAGS[0]}(?![A-Za-z0-9])")))


def todo_tags(text: Column) -> Column:
    """The markers that a text holds, sorted and comma-joined."""
    return F.array_join(F.array_compact(F.array(*[F.when(text.rlike(f"(?i)(?<![A-Za-z0-9]){t}(?![A-Za-z0-9])"), F.lit(t)) for t in sorted(TODO_TAGS)])), ",")


def tokens(line: Column) -> Column:
    """Identifiers of a line, of two characters and more."""
    return F.filter(F.regexp_extract_all(line, F.lit("[A-Za-z_][A-Za-z0-9_]*"), 0), lambda t: F.length(t) > 1)


def word_match(text: Column, needle: str) -> Column:
    """The needle between characters that are neither letters, digits nor underscores, in any script."""
    quoted = needle.replace("\\E", "\\E\\\\E\\Q")
    return text.rlike(f"(?U)(?<![\\p{{L}}\\p{{N}}_])\\Q{quoted}\\E(?![\\p{{L}}\\p{{N}}_])")


def extension(path: Column) -> Column:
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"\.([^.]+)$", 1)


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))
