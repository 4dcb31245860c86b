"""Results as text: JSON rows, and a compact two-column layout per kind of row. Only rendering brings rows to the driver."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lang.statement import QueryError
from . import relations


def page_of(df: DataFrame, most: int) -> DataFrame:
    """``df``, refused if it has more than ``most`` rows: what is rendered is a page, and a part of it would look like all."""
    if df.limit(most + 1).count() > most:
        raise QueryError(f"more than {most} rows to render: ask with a LIMIT")
    return df


def json_lines(df: DataFrame, to: str = "json") -> DataFrame:
    """``df`` with each row as a JSON object."""
    return df.withColumn(to, F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))


def as_json(df: DataFrame, most: int = 1000) -> str:
    """A page of rows as a JSON array."""
    return "[" + ",".join(r[0] for r in json_lines(page_of(df, most), "__json").select("__json").collect()) + "]"


def _csv(rows: list[list]) -> str:
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_NONNUMERIC, lineterminator="\n").writerows(rows)
    return out.getvalue()


def compact(df: DataFrame, verb: str, most: int = 1000, metric: str | None = None) -> str:
    """Symbols grouped by kind, usages by file and role, outlines in order with their depth, members by type, callees by file,
    files and lines in rows of their own, counts as they are."""
    page = page_of(df, most)
    if "count" in df.columns:
        key = [c for c in ("path", "fql_kind", "extension", "name") if c in df.columns][:1]
        return _csv([["key", "count"], *([r[k] for k in [*key, "count"]] for r in page.select(*key, "count").collect())])
    if verb == "find symbols":
        item = F.struct("name", "path", "line", *([F.col("fields")[metric].alias(metric)] if metric else [F.col("usages")]))
        rows = relations.compact(page, ["fql_kind"], item, "rows").orderBy("fql_kind").collect()
        return _csv([["fql_kind", "rows"], *([r["fql_kind"], json.dumps([list(x) for x in r["rows"]], ensure_ascii=False)] for r in rows)])
    if verb == "find usages":
        rows = relations.compact(page, ["path", "role", "node_id", "rev"], F.col("line"), "lines").orderBy("path", "role").collect()
        return _csv([["file", "role", "node_id", "rev", "lines"], *([r["path"], r["role"], r["node_id"], r["rev"], json.dumps(r["lines"])] for r in rows)])
    if verb == "show outline":
        rows = page.orderBy("path", "pos").collect()
        return _csv([["depth", "[fql_kind,name,line,node_id]"], *([r["depth"], json.dumps([r["fql_kind"], r["name"], r["line"], r["node_id"]], ensure_ascii=False)] for r in rows)])
    if verb in ("show members", "show callees", "find callees"):
        key, items = ("fql_kind", ["text", "line", "node_id"]) if verb == "show members" else ("path", ["name", "line"])
        rows = relations.compact(page, [key], F.struct(*sorted(items, key=lambda i: i != "line")), "rows").orderBy(key).collect()
        return _csv([["type" if key == "fql_kind" else "file", f"[{','.join(items)}]"], *([r[key], json.dumps([[x[i] for i in items] for x in r["rows"]], ensure_ascii=False)] for r in rows)])
    if verb == "find files":
        shown = [c for c in ("path", "size", "node_id", "rev", "error_count", "parse_coverage") if c in df.columns]
        return _csv([shown, *([r[c] for c in shown] for r in page.collect())])
    if "line" in df.columns and "text" in df.columns:
        shown = ["line", "text", *[c for c in ("marker",) if c in df.columns]]
        return _csv([shown, *([r[c] for c in shown] for r in page.orderBy("line").collect())])
    plain = [c for c, kind in df.dtypes if kind not in ("map<string,string>",) and c != "content"]
    return _csv([plain, *([r[c] for c in plain] for r in page.collect())])
