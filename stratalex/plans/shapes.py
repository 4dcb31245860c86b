"""Row shapes: which fields a clause may name, and how they are read from a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang.statement import QueryError
from .predicates import integer


@dataclass(frozen=True)
class Shape:
    name: str
    strings: frozenset[str] = frozenset()
    numbers: frozenset[str] = frozenset()
    open_map: str | None = None
    refused: frozenset[str] = frozenset()
    derived: dict[str, str] = field(default_factory=dict)

    def check(self, name: str, grouped: bool = False) -> None:
        if name in self.refused or (name == "count" and not grouped and self.name == "symbol"):
            raise QueryError(f"{name} cannot be asked of {self.name} rows")
        if name not in self.strings | self.numbers and name != "count" and not self.open_map:
            raise QueryError(f"{self.name} rows have no field {name}; they have {', '.join(sorted(self.strings | self.numbers))}")

    def text(self, name: str) -> Column | None:
        if name in self.derived:
            return F.expr(self.derived[name])
        if name in self.strings:
            return F.nullif(F.col(name), F.lit("")) if self.name == "symbol" and name in ("fql_kind", "language") else F.col(name)
        if name in self.numbers or name == "count":
            return F.col(name).cast("string")
        return F.col(self.open_map)[name] if self.open_map else None

    def number(self, name: str) -> Column | None:
        if name in self.numbers or name == "count":
            return F.col(name).cast("bigint")
        text = self.text(name)
        return None if text is None else integer(text)


# fixed values: the fields of each kind of row
_SYMBOL_REFUSED = frozenset(["node_kind", "text", "byte_start", "byte_end", "size", "depth", "extension", "signature", "marker", "declaration"])
SHAPES = {
    s.name: s
    for s in (
        Shape("symbol", frozenset(["name", "fql_kind", "language", "path", "node_id", "body", "role", "value", "type"]), frozenset(["usages", "line"]), "fields", _SYMBOL_REFUSED),
        Shape("usage", frozenset(["name", "path", "role", "node_id", "rev"]), frozenset(["line"])),
        Shape("file", frozenset(["path", "extension", "name", "has_error", "node_id", "rev"]), frozenset(["size", "depth", "error_count", "parse_coverage"]), None, frozenset(),
              {"has_error": "CASE WHEN error_count IS NULL THEN NULL WHEN error_count > 0 THEN 'true' ELSE 'false' END"}),
        Shape("diff", frozenset(["path", "name", "status"]), frozenset(["added", "removed", "changed"])),
        Shape("outline", frozenset(["name", "fql_kind", "path"]), frozenset(["line", "depth"])),
        Shape("member", frozenset(["fql_kind", "type", "text", "declaration", "name"]), frozenset(["line"]), None, frozenset(),
              {"type": "fql_kind", "declaration": "text", "name": "text"}),
        Shape("line", frozenset(["text", "marker", "node_id", "rev"]), frozenset(["line"])),
        Shape("callee", frozenset(["name", "path"]), frozenset(["line"])),
        Shape("commit", frozenset(["hash", "subject"])),
    )
}


def shape_of(df: DataFrame, name: str = "row") -> Shape:
    """A shape for any table: integers are numbers, all else is read as text."""
    numbers = {f.name for f in df.schema if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))}
    texts = {f.name for f in df.schema if f.name not in numbers and not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))}
    derived = {f.name: f"cast(`{f.name}` as string)" for f in df.schema if f.name in texts and not isinstance(f.dataType, T.StringType)}
    return Shape(name, frozenset(texts), frozenset(numbers), None, frozenset(), derived)
