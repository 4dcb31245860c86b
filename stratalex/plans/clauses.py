"""The clause pipeline: a fixed order of steps that turns clauses over a row shape into one DataFrame plan.

IN, EXCLUDE, WHERE, GROUP BY, HAVING, ORDER BY, OFFSET, LIMIT. Filters come before anything that shuffles, so Catalyst
pushes them into the scan; ORDER BY with LIMIT becomes one top-k operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lang.statement import Clauses, QueryError
from ..store import numbered
from . import predicates as P
from .shapes import Shape

# rows that one task may put in order
TOP = 100_000
TIES = ("name", "line", "path", "fql_kind")


def refused(clauses: Clauses, shape: Shape, depth: bool = False, shaping: bool = True, globs: bool = True) -> None:
    """Raises for a clause that the rows cannot answer: a clause changes the result or is refused."""
    grouped = clauses.group_by is not None
    for p in clauses.where:
        shape.check(p.field)
    for p in clauses.having:
        shape.check(p.field, grouped=True)
    if clauses.group_by:
        shape.check(clauses.group_by)
    if clauses.order_by:
        shape.check(clauses.order_by[0], grouped)
    if clauses.depth is not None and not depth:
        raise QueryError("DEPTH only applies to body, context and files")
    if not shaping and (clauses.group_by or clauses.order_by or clauses.having):
        raise QueryError("these rows keep their order: no ORDER BY, GROUP BY or HAVING")
    if not globs and (clauses.within or clauses.exclude):
        raise QueryError("IN and EXCLUDE have nothing to select here")


def filtered(df: DataFrame, clauses: Clauses, shape: Shape) -> DataFrame:
    if clauses.within is not None:
        df = df.filter(P.within(F.col("path"), clauses.within))
    for glob in clauses.exclude:
        df = df.filter(P.outside(F.col("path"), glob))
    for p in clauses.where:
        df = df.filter(P.compiled(p, shape.text(p.field), shape.number(p.field), batch=True))
    return df


def tie_keys(df: DataFrame) -> list[Column]:
    """Ascending tie-breakers, whatever the direction of the order; a missing one sorts as the empty string or 0."""
    return [F.coalesce(F.col(c), F.lit(0 if c == "line" else "")).asc() for c in TIES if c in df.columns]


def order_keys(df: DataFrame, clauses: Clauses, shape: Shape) -> list[Column]:
    """Numbers before text of the chosen field, then the tie-breakers; no direction means descending."""
    if clauses.order_by is None:
        return tie_keys(df)
    name, up = clauses.order_by
    keys = [shape.number(name)]
    if name not in shape.numbers and name != "count":
        keys.append(F.coalesce(shape.text(name), F.lit("")))
    return [*(k.asc_nulls_first() if up else k.desc_nulls_last() for k in keys), *tie_keys(df)]


def grouped(df: DataFrame, field: str, shape: Shape, storage_order: list[str], keyed: bool = False) -> DataFrame:
    """The first row of each group in storage order, with the group's count; a missing key is the group ''. Rows are put
    together before they are shuffled, so a group of any size is one row a partition. If no two rows share their place in
    storage order (``keyed``), places alone are compared, and only columns that a result takes are read."""
    if keyed:
        key = F.coalesce(shape.text(field), F.lit("")).alias("__key")
        heads = df.groupBy(key).agg(F.min(F.struct(*storage_order)).alias("__at"), F.count(F.lit(1)).alias("count")).select("__at.*", "count")
        return df.join(heads, storage_order).select(*df.columns, "count")
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*storage_order)).alias("__row")
    rows = df.groupBy(F.coalesce(shape.text(field), F.lit("")).alias("__key")).agg(first, F.count(F.lit(1)).alias("__count"))
    return rows.select("__row.*", F.col("__count").alias("count"))


def counted(df: DataFrame, field: str, shape: Shape) -> DataFrame:
    """Only key and count of each group: partial aggregation instead of a window."""
    return df.groupBy(F.coalesce(shape.text(field), F.lit("")).alias(field)).agg(F.count(F.lit(1)).alias("count"))


def having(df: DataFrame, clauses: Clauses, shape: Shape) -> DataFrame:
    for p in clauses.having:
        df = df.filter(P.compiled(p, shape.text(p.field), shape.number(p.field), batch=False))
    return df


def paged(df: DataFrame, clauses: Clauses, shape: Shape, default: int | None = None, keep_order: list[Column] | None = None) -> DataFrame:
    """ORDER BY, OFFSET and LIMIT; ``default`` is the page of a query that names none."""
    keys = keep_order if keep_order is not None and clauses.order_by is None else order_keys(df, clauses, shape)
    limit = clauses.limit if clauses.limit is not None else default
    if keys and limit is not None and limit + (clauses.offset or 0) > TOP and (n := df.count()) > TOP:
        return long_page(df, keys if clauses.order_by else [], keys, limit, clauses.offset or 0, n)
    if keys and (clauses.order_by or clauses.offset or clauses.limit is not None or default is not None):
        df = df.orderBy(*keys)  # a whole result that names no order is left unsorted: it is a set until it is rendered
    if clauses.offset:
        df = df.offset(clauses.offset)
    return df if limit is None else df.limit(limit)


def long_page(df: DataFrame, named: list[Column], keys: list[Column], limit: int, offset: int, n: int) -> DataFrame:
    """A page of more rows than one task should hold: rows are ranked by range, and not at all if the page is the whole."""
    if offset or n > limit:
        ranked = numbered(df, keys, "__rank")
        df = ranked.filter((F.col("__rank") > offset) & (F.col("__rank") <= offset + limit)).drop("__rank")
    return df.orderBy(*named) if named else df


def applied(df: DataFrame, clauses: Clauses, shape: Shape, storage_order: list[str] | None = None, default: int | None = None, total: bool = False, keyed: bool = False) -> DataFrame:
    """The whole pipeline; ``total`` adds the number of rows before paging as column ``total``, ``keyed`` is as in ``grouped``."""
    df = filtered(df, clauses, shape)
    if clauses.group_by:
        df = grouped(df, clauses.group_by, shape, storage_order or [c for c in TIES if c in df.columns] or df.columns[:1], keyed)
        default = None
    df = having(df, clauses, shape)
    if total:
        df = df.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total"))))  # one row
    return paged(df, clauses, shape, None if clauses.having else default)


def file_pages(df: DataFrame, limit: int | None, offset: int = 0, ceiling: int | None = None) -> DataFrame:
    """Usage rows by whole files: LIMIT and OFFSET count files in their order, and the page ends before the file that
    would lift its sites above ``ceiling``, if there is one; its first file is always complete. Counts a file, not rows, are
    ranked."""
    files = df.groupBy("path").agg(F.count(F.lit(1)).alias("__sites"))
    ranked = numbered(files, [F.asc("path")], "__rank").filter(F.col("__rank") > offset)
    if ceiling is None:
        return df.join(ranked.filter(F.lit(True) if limit is None else F.col("__rank") <= offset + limit).select("path"), "path", "left_semi")
    # every file has a site, so a page has no more than ``ceiling`` files: those are summed up in one task
    most = ceiling + 1 if limit is None else min(limit, ceiling + 1)
    upto = Window.orderBy("__rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    page = ranked.filter(F.col("__rank") <= offset + most).withColumn("__sum", F.sum("__sites").over(upto))
    page = page.filter((F.col("__sum") <= ceiling) | (F.col("__rank") == offset + 1)).select("path")
    return df.join(page, "path", "left_semi")


def metric_field(clauses: Clauses, shape: Shape) -> str | None:
    """The one derived field that a result shows: of a numeric WHERE, else ORDER BY, else any other WHERE."""
    known = shape.strings | shape.numbers
    numeric = [p.field for p in clauses.where if isinstance(p.value, int) and not isinstance(p.value, bool)]
    ordered = [clauses.order_by[0]] if clauses.order_by else []
    for name in [*numeric, *ordered, *(p.field for p in clauses.where)]:
        if name not in known and name != "count":
            return name
    return None
