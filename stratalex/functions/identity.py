"""Handles and revisions: names of files, nodes and states by content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_handle(path: Column) -> Column:
    return F.concat(F.lit("n"), F.substring(F.sha2(path.cast("binary"), 256), 1, 12))


def node_id(path: Column, ordinal: Column) -> Column:
    return F.concat(path_handle(path), F.lit("."), F.format_string("%04d", ordinal))


def span_rev(text: Column) -> Column:
    """The first eight bytes of the SHA-256, as the digits of a little-endian number."""
    pairs = F.regexp_extract_all(F.substring(F.sha2(text.cast("binary"), 256), 1, 16), F.lit("[0-9a-f]{2}"), 0)
    return F.concat(F.lit("h"), F.array_join(F.reverse(pairs), ""))


def master_rev(rows, key: str, rev: str, position: str):
    """One digest of (key, rev) pairs in the order of ``position``: of a found set, whose rows are a page, or of a table as small."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.concat(F.col(key), F.lit("\0"), F.col(rev), F.lit("\n")).alias("s"))))
    return rows.agg(F.sha2(F.array_join(F.transform(parts, lambda x: x["s"]), "").cast("binary"), 256).alias("master_rev"))


def dir_rev(path: Column) -> Column:
    """An aggregate over the files below a directory: the XOR of the first eight bytes of the SHA-256 of each path, read as a
    little-endian number. It moves with the files there are, not with what is in them."""
    first = F.substring(F.sha2(path.cast("binary"), 256), 1, 16)
    turned = F.array_join(F.reverse(F.regexp_extract_all(first, F.lit("[0-9a-f]{2}"), 0)), "")
    half = lambda at: F.conv(F.substring(turned, at, 8), 16, 10).cast("bigint")
    return F.concat(F.lit("h"), F.lower(F.lpad(F.hex(F.bit_xor(half(1))), 8, "0")), F.lower(F.lpad(F.hex(F.bit_xor(half(9))), 8, "0")))
