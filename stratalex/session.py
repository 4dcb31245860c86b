"""A session over one corpus: statements in, DataFrames out. Versions of the corpus are tables; nothing is changed in place."""

from __future__ import annotations

import difflib
import re
import uuid
from copy import copy
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import identity, text
from .lang.parser import parse
from .lang.statement import Clauses, QueryError, Statement
from .operators import edits, relations, render
from .plans import clauses as C
from .plans import predicates as P
from .plans.shapes import SHAPES
from .sources import corpus, formats, index, trees
from .store import bounded, numbered, shared_dir

VERSION = "0.1"
PAGE, SHOWN, CONTEXT = 20, 40, 5
UNDO, OUTPUTS = 10, 5


@dataclass(frozen=True)
class Found:
    """What the last FIND answered with, of which kind, and the same without a page."""

    rows: DataFrame
    of: str
    whole: DataFrame


@dataclass(frozen=True)
class Version:
    """What differs from the files that a session began with: ``dirty`` (path, content; null is gone) and the index rows of
    those files. Both are tables of the files that were edited, however large the corpus is."""

    dirty: DataFrame | None = None
    rows: DataFrame | None = None


class Session:
    """Runs statements over ``files`` (path, content). ``store`` is a folder that driver and executors share; it defaults to
    the session's checkpoint folder."""

    def __init__(self, spark: SparkSession, files: DataFrame, name: str = "corpus", store: str | None = None):
        self.spark, self.name = spark, name
        self.store = store or shared_dir(spark)
        self.commits: list[tuple[str, str]] = []
        self.trees: dict[str, tuple[Version, Version]] = {}
        self.outputs: list[DataFrame] = []
        self.reset(files)

    # versions

    def reset(self, files: DataFrame) -> None:
        """Begins again with ``files``: the only time that a whole corpus is written and indexed."""
        self.origin = self.kept(files.select("path", "content"), "version")
        self._first: dict[str, DataFrame] = {}
        self.undo: list[Version] = []
        self.marks: list[tuple[str, Version]] = []
        self.base = Version()
        self.set_version(Version())

    def kept(self, df: DataFrame, tag: str) -> DataFrame:
        path = f"{self.store}/{tag}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def set_version(self, version: Version) -> None:
        self.version = version
        self.files = self.files_of(version)
        self.found = None
        self._symbols: dict[tuple[bool, bool], DataFrame] = {}

    def files_of(self, version: Version) -> DataFrame:
        return self.origin if version.dirty is None else relations.shadowed(self.origin, version.dirty).filter("content is not null")

    @property
    def lines(self) -> DataFrame:
        return corpus.lines(self.files)

    def first(self, what: str) -> DataFrame:
        """The ``raw`` rows, the rows of their ``expanded`` macro calls and the usage ``counts`` of the files that the session
        began with, each built when first asked for: rows alone answer what needs no counts."""
        if what not in self._first:
            make = {
                "raw": lambda: index.joined_parts(self.kept(index.part_symbols(self.origin), "raw"), lambda df: self.kept(df, "parts")),
                "expanded": lambda: index.macro_calls(self.first("raw"), self.first("raw"), self.kept),
                "counts": lambda: index.code_counts(self.origin, self.first("raw")),
            }
            self._first[what] = make[what]() if what == "raw" else self.kept(make[what](), what)
        return self._first[what]

    def forked(self) -> Session:
        """Another session over the same first version, whose tables it shares: they never change, edits lie beside them."""
        other = copy(self)
        other.commits, other.trees, other.outputs, other.undo, other.marks = [], {}, [], [], []
        other.base = Version()
        other.set_version(Version())
        return other

    @property
    def raw(self) -> DataFrame:
        """The index rows of the current version: only edited files were read again."""
        version = self.version
        if version.dirty is None:
            return self.first("raw")
        if version.rows is None:
            self.version = version = self.indexed(version.dirty, version.dirty, self.first("raw"), None)
        return self.first("raw").join(version.dirty.select("path"), "path", "left_anti").select(*version.rows.columns).unionByName(version.rows)

    def indexed(self, dirty: DataFrame, edited: DataFrame, old: DataFrame, rows: DataFrame | None) -> Version:
        """A version whose ``edited`` files are read again, their ordinals those of the ``old`` rows that go on."""
        mine = index.read_again(edited.filter("content is not null"), old.join(edited.select("path"), "path", "left_semi"))
        if rows is not None:
            mine = mine.unionByName(rows.join(edited.select("path"), "path", "left_anti"))
        return Version(dirty, self.kept(mine, "dirty-rows"))

    @property
    def symbols(self) -> DataFrame:
        """The symbols of the current version, as a plan over its rows: a statement reads the columns and kinds that it asks for.
        Usages are counted only where a result takes them."""
        return self.symbols_by(False)

    def symbols_by(self, ranked: bool) -> DataFrame:
        """``symbols``; if they are ``ranked`` by usages, or filtered or grouped, counts are a table that later statements share."""
        if ranked:
            self.first("counts")
        view = known, _ = "counts" in self._first, ranked
        if view not in self._symbols:
            counts = relations.one_each(self._first["counts"]) if known else index.code_counts(self.origin, self.first("raw"))
            raw = self.raw
            table = index.symbols(self.first("raw"), counts, self.first("expanded"), ranked)
            self._symbols[view] = table if self.version.dirty is None else self.merged(self.version, raw, counts, table)
        return self._symbols[view]

    def merged(self, version: Version, raw: DataFrame, counts: DataFrame, table: DataFrame) -> DataFrame:
        """Those of the first version are ``table``; the rows of edited files, and calls of the macros that they define or
        defined, are a small table beside it, and so are the changes of usage counts."""
        paths, first = version.dirty.select("path"), self.first("raw")
        had = first.join(paths, "path", "left_semi")
        sides = lambda old, new: old.withColumn("path", F.concat(F.lit("-"), "path")).unionByName(new.withColumn("path", F.concat(F.lit("+"), "path")))
        sites = index.roles(corpus.lines(sides(self.origin.join(paths, "path", "left_semi"), version.dirty.filter("content is not null"))), sides(had, version.rows))
        change = F.sum(F.when(F.col("path").startswith("+"), 1).otherwise(-1))
        delta = self.kept(sites.filter("role = 'code'").groupBy("name").agg(change.alias("__more")).filter("__more <> 0"), "delta")
        macros = self.kept(had.unionByName(version.rows).filter("fql_kind = 'macro'").select("name").distinct(), "macros")
        calls, others = version.rows, table.join(paths, "path", "left_anti").select(*table.columns)
        if not macros.isEmpty():
            calls = calls.unionByName(first.filter("fql_kind = 'call'").join(macros, "name", "left_semi").join(paths, "path", "left_anti"))
            others = others.join(macros.withColumn("fql_kind", F.lit("macro_call")), ["name", "fql_kind"], "left_anti").select(*table.columns)
        some = index.symbols(version.rows, None, index.macro_calls(calls, raw)).drop("usages")
        mine = self.kept(some, "dirty-symbols").join(counts, "name", "left")
        now = F.coalesce("usages", F.lit(0)) + F.coalesce("__more", F.lit(0))
        return others.unionByName(mine.select(*others.columns)).join(relations.one_each(delta, "__more"), "name", "left").withColumn("usages", now).select(*table.columns)

    def reachable(self) -> set[str]:
        """Names of the tables in ``store`` that this session may still read."""
        versions = [self.version, self.base, *self.undo, *(v for _, v in self.marks), *(v for pair in self.trees.values() for v in pair)]
        held = [self.origin, *self._first.values(), *self.outputs, *(t for v in versions for t in (v.dirty, v.rows) if t is not None)]
        held += [self.found.rows] if self.found else []
        return {f.split("/")[-2] for t in held for f in t.inputFiles()}

    # statements

    def run(self, statement: str) -> DataFrame:
        """The rows that a statement answers with; refused statements raise QueryError before anything runs."""
        return self.execute(parse(statement))

    def execute(self, s: Statement) -> DataFrame:
        for p in (*s.clauses.where, *s.clauses.having):
            if p.op.endswith("MATCHES"):
                P.regex(str(p.value))
        if s.clauses != Clauses() and s.verb.split()[0] in ("change", "insert", "delete", "move", "copy"):
            raise QueryError("an edit takes no clauses")
        act = getattr(self, "_" + s.verb.replace(" ", "_"), None)
        if act is None:
            raise QueryError(f"{s.verb} is asked of a catalog, not of a session")
        out = act(s)
        if s.verb.startswith("show ") and s.verb != "show more":
            self.outputs = [*self.outputs, out][-OUTPUTS:]
        return out

    def rendered(self, statement: str, how: str = "compact") -> str:
        s = parse(statement)
        if s.verb == "find symbols":
            self.first("counts")  # a rendered row shows its usages
        df = self.execute(s)
        if hint := self.hint(s, df):
            return hint
        return render.as_json(df) if how == "json" else render.compact(df, s.verb, metric=C.metric_field(s.clauses, SHAPES["symbol"]))

    def hint(self, s: Statement, rows: DataFrame) -> str | None:
        """Where to look when FIND symbols finds no symbol of a name that the corpus uses all the same."""
        name = next((str(p.value) for p in s.clauses.where if (p.field, p.op) == ("name", "=")), None)
        if s.verb != "find symbols" or name is None or not rows.isEmpty():
            return None
        n = self.lines.filter(text.word_match(F.col("text"), name)).count()
        return f"0 symbols, but {n} lines use the name without a declaration here: FIND usages OF '{name}'" if n else None

    def _find_symbols(self, s: Statement) -> DataFrame:
        shape = SHAPES["symbol"]
        C.refused(s.clauses, shape)
        c = s.clauses
        ranked = "usages" in (*(p.field for p in (*c.where, *c.having)), c.group_by, *(c.order_by or ()))
        rows = self.symbols_by(ranked).filter("first")
        out = C.applied(rows, s.clauses, shape, storage_order=["path", "pos"], default=PAGE, keyed=True)
        self.arm(out, "symbols", C.applied(rows, replace(s.clauses, order_by=None, limit=None, offset=None), shape, storage_order=["path", "pos"], keyed=True))
        return out.drop("first")

    def _find_files(self, s: Statement) -> DataFrame:
        C.refused(s.clauses, SHAPES["file"], depth=True)
        files = corpus.stamped(corpus.with_paths(self.files))
        if s.clauses.depth is not None and not {p.field for p in s.clauses.where} & {"error_count", "parse_coverage", "has_error"}:
            return self.collapsed(files, s.clauses)  # sums of sizes need no index
        files = relations.with_errors(files, self.raw, "path", F.col("fql_kind") == "error", F.col("byte_end") - F.col("byte_start"))
        cover = corpus.coverage(F.col("size"), F.col("error_bytes")).cast("int")
        files = files.withColumns({"error_count": F.col("error_count").cast("int"), "parse_coverage": cover}).drop("content", "error_bytes")
        if s.clauses.depth is not None:
            return self.collapsed(files, s.clauses)
        out = C.applied(files, s.clauses, SHAPES["file"], default=PAGE)
        self.arm(out, "files", C.applied(files, replace(s.clauses, order_by=None, limit=None, offset=None), SHAPES["file"]))
        return out

    def collapsed(self, files: DataFrame, c: Clauses) -> DataFrame:
        """The rows of FIND files with DEPTH: what lies deeper is summed up in its directory."""
        rows = corpus.collapsed(C.filtered(files, c, SHAPES["file"]), c.depth)
        rows = rows.withColumns({"name": F.element_at(F.split(F.rtrim(F.col("path"), F.lit("/")), "/"), -1), "extension": text.extension(F.col("path"))})
        return C.paged(rows, Clauses(order_by=c.order_by, limit=c.limit, offset=c.offset), SHAPES["file"], PAGE)

    def _find_usages(self, s: Statement) -> DataFrame:
        """Every line that holds the needle as a word, labelled by the index; LIMIT and OFFSET count files."""
        shape, c, needle = SHAPES["usage"], s.clauses, s.args["of"]
        C.refused(c, shape)
        word = re.fullmatch(r"[\w]+", needle) is not None
        near = C.filtered(self.lines.filter(F.contains("text", F.lit(needle))), Clauses(within=c.within, exclude=c.exclude), shape)
        hit = near.filter(text.word_match(F.col("text"), needle)) if word else near
        posted = index.roles(near, self.raw).filter(F.col("name") == needle).groupBy("path", "line").agg(F.min("role").alias("role")).withColumn("was_read", F.lit(True))
        rows = relations.reconciled(hit.select("path", "line"), posted).withColumn("name", F.lit(needle))
        stamps = self.files.select("path", identity.path_handle(F.col("path")).alias("node_id"), identity.span_rev(F.col("content")).alias("rev"))
        rows = rows.join(stamps, "path", "left")
        if c.group_by or c.having:
            return C.applied(rows, c, shape)
        rows = self.kept(C.filtered(rows, c, shape), "usages")
        page = C.file_pages(rows, c.limit if c.limit is not None else PAGE, c.offset or 0)
        self.arm(page, "usages", rows)
        return C.paged(page, Clauses(order_by=c.order_by), shape)

    def _find_callees(self, s: Statement) -> DataFrame:
        return self._show_callees(s)

    def _find_node(self, s: Statement) -> DataFrame:
        return self._show_node(Statement("show node", {**s.args, "mode": "metadata"}, s.clauses))

    def resolved(self, name: str, c: Clauses, preferred: str = "function") -> dict:
        """The one symbol that a name means."""
        rows = relations.qualified(self.symbols.drop("usages"), name)
        rows = C.filtered(rows, Clauses(where=tuple(p for p in c.where if p.field not in ("text", "marker", "line")), within=c.within, exclude=c.exclude), SHAPES["symbol"])
        got = rows.orderBy(*relations.resolve_order(preferred)).limit(1).collect()
        if not got:
            raise QueryError(f"no symbol {name!r}")
        return got[0].asDict()

    def _shown(self, rows: DataFrame, c: Clauses, shape: str = "line", order: tuple[str, ...] = ("line",), paged: bool = True) -> DataFrame:
        own = Clauses(where=tuple(p for p in c.where if p.field in SHAPES[shape].strings | SHAPES[shape].numbers), limit=c.limit, offset=c.offset)
        return C.paged(C.filtered(rows, own, SHAPES[shape]), own, SHAPES[shape], SHOWN if paged else None, [F.asc(o) for o in order])

    def _of(self, row: dict, first: int, last: int) -> DataFrame:
        return edits.line_range(self.lines.filter(F.col("path") == row["path"]), first, last)

    def _show_body(self, s: Statement) -> DataFrame:
        """The lines of a symbol; DEPTH n folds blocks nested deeper than n, and 0 (the default) leaves the signature."""
        C.refused(s.clauses, SHAPES["symbol"] if not any(p.field == "text" for p in s.clauses.where) else SHAPES["line"], depth=True, shaping=False)
        row = self.resolved(s.args["of"], s.clauses)
        body = self.files.filter(F.col("path") == row["path"]).select(F.substring("content", row["char_start"] + 1, row["char_end"] - row["char_start"]).alias("body")).first()["body"]
        folded = formats.folded(row["language"], body, s.clauses.depth or 0)
        rows = self.spark.createDataFrame([(row["path"], row["line"] + i, t) for i, t in folded], "path string, line int, text string")
        return self._shown(rows, s.clauses, paged=s.clauses.limit is None)

    def _show_signature(self, s: Statement) -> DataFrame:
        C.refused(s.clauses, SHAPES["symbol"], shaping=False)
        row = self.resolved(s.args["of"], s.clauses)
        sign = row["fields"].get("signature") or row["name"]
        return self.spark.createDataFrame([(row["name"], row["path"], row["line"], sign)], "name string, path string, line int, signature string")

    def _show_context(self, s: Statement) -> DataFrame:
        C.refused(s.clauses, SHAPES["symbol"] if not any(p.field == "text" for p in s.clauses.where) else SHAPES["line"], depth=True, shaping=False)
        row = self.resolved(s.args["of"], s.clauses)
        around = s.clauses.lines if s.clauses.lines is not None else s.clauses.depth if s.clauses.depth is not None else CONTEXT
        return self._shown(self.placed(edits.context(self.lines.filter(F.col("path") == row["path"]), row["line"], around), row["path"]), s.clauses)

    def placed(self, lines: DataFrame, path: str) -> DataFrame:
        """Lines of a file with the innermost node that each lies in, and their place in it from 1."""
        nodes = self.symbols.filter((F.col("path") == path) & F.col("node_id").isNotNull()).select("path", F.col("line").alias("__from"), "end_line", "node_id")
        inner = relations.innermost(lines.select("path", "line").distinct(), nodes, ["path"], "line", "__from", "end_line", "node_id", 256)
        first = nodes.select(F.col("node_id").alias("innermost"), "__from")
        found = inner.join(first, "innermost").select("path", "line", F.col("innermost").alias("node_id"), (F.col("line") - F.col("__from") + 1).alias("offset"))
        return lines.join(found, ["path", "line"], "left")

    def _paths(self, of: str) -> DataFrame:
        if re.fullmatch(r"n[0-9a-f]{12}", of):
            return self.symbols.filter(identity.path_handle(F.col("path")) == of)
        return self.symbols.filter(P.within(F.col("path"), of))

    def _show_outline(self, s: Statement) -> DataFrame:
        C.refused(s.clauses, SHAPES["outline"])
        rows = index.outline(self._paths(s.args["of"]), s.args["all"])
        return C.applied(rows, s.clauses, SHAPES["outline"]) if s.clauses.order_by or s.clauses.group_by else C.paged(C.filtered(rows, s.clauses, SHAPES["outline"]), s.clauses, SHAPES["outline"], None, [F.asc("path"), F.asc("pos")])

    def _show_members(self, s: Statement) -> DataFrame:
        C.refused(s.clauses, SHAPES["member"], shaping=False)
        return self._shown(index.members(self.symbols, s.args["of"]), s.clauses, "member", ("path", "line", "text"), False)

    def _show_callees(self, s: Statement) -> DataFrame:
        C.refused(s.clauses, SHAPES["callee"], shaping=False)
        rows = index.callees(self.raw).filter(F.col("caller") == s.args["of"]).select("name", "path", "line")
        return self._shown(rows, s.clauses, "callee", ("line", "name", "path"), False)

    def _show_lines(self, s: Statement) -> DataFrame:
        C.refused(s.clauses, SHAPES["line"], shaping=False, globs=False)
        first, last = s.args["span"]
        rows = self.lines.filter(F.col("path") == s.args["of"])
        got = edits.line_range(rows, first, last)
        if got.isEmpty():
            raise QueryError(f"{s.args['of']} has no line {first}")
        return self._shown(self.placed(got, s.args["of"]), s.clauses, paged=False)

    def node(self, handle: str) -> tuple[dict, tuple[int, int] | None]:
        """A symbol by its id, and the lines that a suffix (n) or (n-m) picks from it."""
        m = re.fullmatch(r"(n[0-9a-f]{12,64}\.[0-9]{4,})(?:\((\d+)(?:-(\d+))?\))?", handle)
        if not m:
            raise QueryError(f"no node id: {handle!r}")
        number = F.col("ordinal") == F.lit(m[1].rpartition(".")[2]).try_cast("int")  # few rows have it, so few paths are hashed
        got = self.symbols.drop("usages").filter(number & (F.col("node_id") == m[1])).limit(1).collect()
        if not got:
            raise QueryError(f"no node {m[1]}")
        part = (int(m[2]), int(m[3] or m[2])) if m[2] else None
        row = got[0].asDict()
        if part and part[1] > row["end_line"] - row["line"] + 1:
            raise QueryError(f"{m[1]} has no line {part[1]}")
        return row, part

    def _show_node(self, s: Statement) -> DataFrame:
        handle = s.args["id"]
        if re.fullmatch(r"n[0-9a-f]{12}", handle):
            got = corpus.stamped(corpus.with_paths(self.files)).filter(F.col("node_id") == handle).drop("content")
            return got if not got.isEmpty() else self.directory(handle)
        row, part = self.node(handle)
        if s.args["mode"] == "metadata":
            near = self.symbols_by(True).filter((F.col("path") == row["path"]) & F.col("node_id").isNotNull())
            nav = relations.siblings(near, ["path", "parent_pos"], [F.asc("pos")], "node_id")
            first = near.filter(F.col("parent_pos") == row["pos"]).agg(F.min_by("node_id", "pos").alias("first_child"))
            parent = near.filter(F.col("pos") == row["parent_pos"]).select(F.col("node_id").alias("parent"))
            one = nav.filter(F.col("node_id") == row["node_id"])
            return one.join(F.broadcast(first)).join(F.broadcast(parent), how="left")  # one row on either side
        first = row["line"] + (part[0] - 1 if part else 0)
        last = row["line"] + part[1] - 1 if part else row["end_line"]
        return self._shown(self._of(row, first, last), s.clauses)

    def directory(self, handle: str) -> DataFrame:
        """The record of a directory by its handle: what lies below it and the revision of its membership."""
        found = corpus.directories(corpus.with_paths(self.files)).withColumn("node_id", identity.path_handle(F.col("dir"))).filter(F.col("node_id") == handle)
        if found.isEmpty():
            raise QueryError(f"no file or folder {handle}")
        return found.withColumnRenamed("dir", "path")

    def _show_more(self, s: Statement) -> DataFrame:
        """A window of an earlier output, its rows numbered from 1."""
        if s.args["last"] >= len(self.outputs):
            raise QueryError("no such output")
        df = self.outputs[-1 - s.args["last"]]
        keys = [c for c in ("path", "line", "pos") if c in df.columns] or df.columns[:1]
        rows = numbered(df, [F.asc(k) for k in keys], "output_line")
        kind, n = s.args["window"] or ("all", 0)
        if kind == "head":
            rows = rows.filter(F.col("output_line") <= n)
        elif kind == "tail":
            rows = rows.filter(F.col("output_line") > rows.count() - n)
        elif kind == "range":
            rows = rows.filter(F.col("output_line").between(*n))
        return C.paged(C.filtered(rows, s.clauses, SHAPES["line"]), s.clauses, SHAPES["line"], None, [F.asc("output_line")])

    def _show_diff(self, s: Statement) -> DataFrame:
        """Files that differ from the last commit (or, with OF, in one commit from the one before), with lines added and
        removed; without STAT the hunks of the files that the clauses keep."""
        of_text = tuple(p for p in s.clauses.where if p.field == "text")
        of_rows = replace(s.clauses, where=tuple(p for p in s.clauses.where if p.field != "text"))
        C.refused(of_rows, SHAPES["diff"])
        versions = self.base, self.version
        if s.args["of"] is not None:
            known = [h for h in self.trees if h.startswith(s.args["of"])]
            if len(known) != 1:
                raise QueryError(f"no commit {s.args['of']}")
            versions = self.trees[known[0]]
        pairs = self.kept(edits.paired(*self.edited(*versions)), "diff")
        rows = pairs.select("path", "status").join(edits.line_changes(pairs), "path").select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "status", "added", "removed")
        rows = rows.withColumn("changed", F.col("added") + F.col("removed"))
        rows = C.applied(rows, of_rows, SHAPES["diff"])
        if s.args["stat"]:
            return rows

        def hunks(parts):
            import pandas as pd

            for p in parts:
                out = []
                for path, a, b in zip(p.path, p.a, p.b):
                    diff = difflib.unified_diff(edits.split_lines(a), edits.split_lines(b), path, path, lineterm="")
                    out += [(path, i, t) for i, t in enumerate(diff, 1)]
                yield pd.DataFrame(out, columns=["path", "line", "text"])

        picked = bounded(pairs.join(rows.select("path"), "path", "left_semi").select("path", "a", "b"))
        return self._shown(picked.mapInPandas(hunks, "path string, line int, text string"), Clauses(where=of_text), "line", ("path", "line"), False)

    def edited(self, before: Version, after: Version) -> tuple[DataFrame, DataFrame]:
        """The files of two versions that either of them has edited: all others are the same in both."""
        paths = [v.dirty.select("path") for v in (before, after) if v.dirty is not None]
        if not paths:
            return self.origin.limit(0), self.origin.limit(0)
        every = paths[0] if len(paths) == 1 else paths[0].unionByName(paths[1]).distinct()
        return tuple(self.files_of(v).join(every, "path", "left_semi") for v in (before, after))

    def _show_commits(self, s: Statement) -> DataFrame:
        C.refused(s.clauses, SHAPES["commit"])
        return C.applied(self.spark.createDataFrame(self.commits, "hash string, subject string"), s.clauses, SHAPES["commit"])

    def _one(self, **values) -> DataFrame:
        return self.spark.createDataFrame([tuple(values.values())], list(values))

    def _show_sources(self, s: Statement) -> DataFrame:
        return self._one(source=self.name)

    def _show_branches(self, s: Statement) -> DataFrame:
        return self._one(branch="main")

    def _show_version(self, s: Statement) -> DataFrame:
        return self._one(version=VERSION)

    def _show_stats(self, s: Statement) -> DataFrame:
        if s.args["of"] not in (None, self.name):
            raise QueryError(f"no session {s.args['of']}")
        return self.symbols.groupBy("language", "fql_kind").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("path").alias("files"))

    # edits

    def apply(self, changed: DataFrame) -> DataFrame:
        """Makes a next version, with ``changed`` (path, content; null is gone) in place of what was there; answers with the
        files that differ and the lines that came and went. Nothing but edited files is written or read again."""
        before = self.version
        changed = self.kept(changed.select("path", "content"), "changed")
        dirty = changed if before.dirty is None else self.kept(relations.shadowed(before.dirty, changed), "dirty")
        known = before.rows is not None or (before.dirty is None and "raw" in self._first)
        after = self.indexed(dirty, changed, self.raw, before.rows) if known else Version(dirty)
        pairs = edits.paired(self.files.join(changed.select("path"), "path", "left_semi"), changed.filter("content is not null"))
        count = edits.line_changes(pairs).withColumnsRenamed({"added": "lines_written", "removed": "lines_removed"})
        out = pairs.select("path", "status").join(count, "path")
        self.undo = [*self.undo, before][-UNDO:]
        self.set_version(after)
        return out

    def gate(self, want: str | None, content: str) -> None:
        have = self.spark.range(1).select(identity.span_rev(F.lit(content))).first()[0]
        if want is not None and want != have:
            raise QueryError(f"stale revision: {want}, now {have}; the node is now {content!r}")

    def file(self, path: str) -> DataFrame:
        return self.files.filter(F.col("path") == path)

    def spliced(self, path: str, start: int, end: int, new: str) -> DataFrame:
        return self.file(path).withColumn("content", edits.spliced(F.col("content"), F.lit(start), F.lit(end), F.lit(new)))

    def content(self, row: dict) -> str:
        part = F.substring("content", row["char_start"] + 1, row["char_end"] - row["char_start"])
        return self.file(row["path"]).select(part).first()[0]

    def rows_of(self, *pairs: tuple[str, str | None]) -> DataFrame:
        return self.spark.createDataFrame(list(pairs), "path string, content string")

    def _change_files(self, s: Statement) -> DataFrame:
        paths = [corpus.safe_path(p) for p in s.args["paths"]]
        picked = self.files.filter(F.col("path").isin(*paths))
        if s.args["mode"] == "whole":
            return self.apply(self.rows_of(*[(p, s.args["new"]) for p in dict.fromkeys(paths)]))
        if missing := sorted(set(paths) - {r["path"] for r in picked.select("path").collect()}):
            raise QueryError(f"no file {missing[0]}")
        if s.args["mode"] == "matching":
            done = edits.replaced(picked, s.args["old"], s.args["new"], s.args["word"])
            if done.agg(F.sum("hits")).first()[0] in (None, 0):
                raise QueryError("nothing matches")
        elif s.args["mode"] == "delete":
            done = picked.withColumn("content", F.lit(None).cast("string"))
        else:
            first, last = s.args["span"]
            self.within_lines(picked, first, last)
            done = picked.withColumn("content", edits.lines_changed(F.col("content"), first, last, s.args["new"]))
        return self.apply(done)

    def within_lines(self, files: DataFrame, first: int, last: int) -> None:
        """Refuses a range that some file does not have; line 1 of an empty file is where its first content goes."""
        if first < 1 or last < first:
            raise QueryError(f"no lines {first}-{last}")
        count = F.when(F.col("content") == "", 1).otherwise(F.length("content") - F.length(F.replace("content", F.lit("\n"))) + (~F.col("content").endswith("\n")).cast("int"))
        short = files.select("path", count.alias("n")).filter(F.col("n") < last).orderBy("path").first()
        if short:
            raise QueryError(f"{short['path']} has {short['n']} lines")

    def _change_node(self, s: Statement) -> DataFrame:
        if s.args["mode"] not in ("matching", "whole"):
            raise QueryError("a node is changed by MATCHING or WITH its new text")
        row, part = self.node(s.args["id"])
        row = self.part_of(row, part)
        body = self.content(row)
        self.gate(s.args["rev"], body)
        new = s.args["new"]
        if s.args["mode"] == "matching":
            change = edits.replaced_text(F.lit(body), s.args["old"], new, s.args["word"])
            new = self.spark.range(1).select(change).first()[0]
            if new == body:
                raise QueryError("nothing matches")
        return self.apply(self.spliced(row["path"], row["char_start"], row["char_end"], new))

    def part_of(self, row: dict, part: tuple[int, int] | None) -> dict:
        """A node, or some of its lines without the last line end, as a span of characters."""
        if part is None:
            return row
        body = self.content(row).split("\n")
        start = row["char_start"] + sum(len(x) + 1 for x in body[: part[0] - 1])
        return {**row, "char_start": start, "char_end": start + len("\n".join(body[part[0] - 1 : part[1]]))}

    def _insert_node(self, s: Statement) -> DataFrame:
        row, _ = self.node(s.args["id"])
        self.gate(s.args["rev"], self.content(row))
        at = row["char_start"] if s.args["side"] == "before" else row["char_end"]
        new = s.args["content"] + "\n" if s.args["side"] == "before" else "\n" + s.args["content"]
        return self.apply(self.spliced(row["path"], at, at, new))

    def _insert_path(self, s: Statement) -> DataFrame:
        path = corpus.safe_path(s.args["path"])
        if not self.file(path).isEmpty():
            raise QueryError(f"{path} exists")
        return self.apply(self.rows_of((path, s.args["content"])))

    def _delete_node(self, s: Statement) -> DataFrame:
        if re.fullmatch(r"n[0-9a-f]{12}", s.args["id"]):
            return self.apply(self.files.filter(identity.path_handle(F.col("path")) == s.args["id"]).withColumn("content", F.lit(None).cast("string")))
        row, part = self.node(s.args["id"])
        row = self.part_of(row, part)
        self.gate(s.args["rev"], self.content(row))
        start, end = row["char_start"], row["char_end"]
        if row["language"] == "json" and part is None:
            start, end = trees.json_member_span(self.file(row["path"]).first()["content"], start, end)
        return self.apply(self.spliced(row["path"], start, end, ""))

    def _move_node(self, s: Statement, keep: bool = False) -> DataFrame:
        row, _ = self.node(s.args["id"])
        anchor, _ = self.node(s.args["anchor"])
        body = self.content(row)
        self.gate(s.args["rev"], body)
        at = anchor["char_start"] if s.args["side"] == "before" else anchor["char_end"]
        put = F.lit(body + "\n" if s.args["side"] == "before" else "\n" + body)
        same, c = row["path"] == anchor["path"], F.col("content")
        if same and row["char_start"] < at < row["char_end"]:
            raise QueryError("a node cannot move into itself")
        insert = lambda x: edits.spliced(x, F.lit(at), F.lit(at), put)
        cut = lambda x: x if keep else edits.spliced(x, F.lit(row["char_start"]), F.lit(row["char_end"]), F.lit(""))
        if same:  # the later place first, so that the other one stays where it is
            return self.apply(self.file(row["path"]).withColumn("content", cut(insert(c)) if at >= row["char_end"] else insert(cut(c))))
        files = self.files.filter(F.col("path").isin(row["path"], anchor["path"]))
        return self.apply(files.withColumn("content", F.when(F.col("path") == anchor["path"], insert(c)).otherwise(cut(c))))

    def _copy_node(self, s: Statement) -> DataFrame:
        return self._move_node(s, True)

    def _move_node_to(self, s: Statement, keep: bool = False) -> DataFrame:
        """A file to another path, or a symbol to the end of a file."""
        target = corpus.safe_path(s.args["to"])
        if re.fullmatch(r"n[0-9a-f]{12}", s.args["id"]):
            mine = self.files.filter(identity.path_handle(F.col("path")) == s.args["id"])
            moved = mine.withColumn("path", F.lit(target))
            gone = mine.filter(F.col("path") != target).withColumn("content", F.lit(None).cast("string"))
            return self.apply(moved if keep else moved.unionByName(gone))
        row, _ = self.node(s.args["id"])
        body = self.content(row)
        self.gate(s.args["rev"], body)
        c, path = F.col("content"), F.col("path")
        cut = lambda x: x if keep else edits.spliced(x, F.lit(row["char_start"]), F.lit(row["char_end"]), F.lit(""))
        files = self.files.filter(path.isin(row["path"], target))
        there = files.withColumn("content", F.when(path == row["path"], cut(c)).otherwise(c)).withColumn("content", F.when(path == target, F.concat(c, F.lit("\n" + body + "\n"))).otherwise(c))
        return self.apply(there.unionByName(self.rows_of((target, body + "\n"))) if self.file(target).isEmpty() else there)

    def _copy_node_to(self, s: Statement) -> DataFrame:
        return self._move_node_to(s, True)

    def _copy_lines(self, s: Statement, keep: bool = True) -> DataFrame:
        first, last = s.args["span"]
        after = None if s.args["line"] is None else s.args["line"] - 1
        a, b = corpus.safe_path(s.args["of"]), corpus.safe_path(s.args["to"])
        for path in (a, b):
            if self.file(path).isEmpty():
                raise QueryError(f"no file {path}")
        self.within_lines(self.file(a), first, last)
        block = self.file(a).select(edits.lines_of(F.col("content"), first, last)).first()[0]
        return self.apply(edits.lines_moved(self.files.filter(F.col("path").isin(a, b)), a, first, last, block, b, after, keep))

    def _move_lines(self, s: Statement) -> DataFrame:
        return self._copy_lines(s, False)

    # found sets

    def arm(self, rows: DataFrame, of: str, whole: DataFrame) -> None:
        """Remembers what a FIND answered with; ``whole`` is its result without a page. Its digest is computed when asked for."""
        self.found = Found(rows, of, whole) if "path" in rows.columns and "count" not in rows.columns else None

    def found_set(self, rev: str | None) -> Found:
        if self.found is None:
            raise QueryError("no FIND to act on, or the corpus changed since")
        if self.found.rows.count() < self.found.whole.count():
            raise QueryError("the last FIND showed a part of its result: ask again with a LIMIT that covers it")
        have = self.master_rev() if rev is not None else None
        if rev != have:
            raise QueryError(f"stale set: {rev}; find it again")
        return self.found

    def spans(self) -> DataFrame:
        """(path, node_id, start, end) of what was found: whole files, the spans of nodes, or the lines of the others."""
        rows = self.found.rows
        if self.found.of == "files":
            return self.files.join(rows.select("path"), "path", "left_semi").select("path", identity.path_handle(F.col("path")).alias("node_id"), F.lit(0).alias("start"), F.length("content").alias("end"))
        if self.found.of == "usages":
            lines = rows.select("path", "line").distinct()
            spans = edits.line_spans(self.files.join(lines.select("path"), "path", "left_semi"))
            return spans.join(lines, ["path", "line"]).select("path", F.concat(identity.path_handle(F.col("path")), F.lit(":"), "line").alias("node_id"), "start", "end")
        nodes = rows.filter("node_id is not null").select("path", "node_id", F.col("char_start").alias("start"), F.col("char_end").alias("end"))
        others = rows.filter("node_id is null").select("path", F.concat("path", F.lit(":"), F.col("char_start").cast("string")).alias("node_id"), F.col("char_start").alias("start"), F.col("char_end").alias("end"))
        return nodes.unionByName(others)

    def master_rev(self) -> str:
        """One digest over the handles and texts of a found set, whose rows are a page."""
        text_ = F.expr("substring(content, start + 1, end - start)")
        rows = self.spans().join(self.files, "path").select("node_id", identity.span_rev(text_).alias("rev"))
        return identity.master_rev(rows, "node_id", "rev", "node_id").first()["master_rev"]

    def _change_found(self, s: Statement) -> DataFrame:
        if s.args["mode"] != "matching":
            raise QueryError("a set is changed by MATCHING")
        self.found_set(s.args["rev"])
        return self.apply(edits.spans_changed(self.files, self.spans(), lambda x: edits.replaced_text(x, s.args["old"], s.args["new"], s.args["word"])))

    def _delete_found(self, s: Statement) -> DataFrame:
        """Found files go; found nodes and lines go out of their files."""
        found = self.found_set(s.args["rev"])
        if found.of == "files":
            return self.apply(found.rows.select("path", F.lit(None).cast("string").alias("content")))
        return self.apply(edits.spans_changed(self.files, self.spans(), lambda x: F.lit("")))

    def _move_found(self, s: Statement, keep: bool = False) -> DataFrame:
        """Found files go into a folder; the texts of found nodes, in order, to the end of a file."""
        to = corpus.safe_path(s.args["to"])
        found = self.found_set(s.args["rev"])
        if found.of == "files":
            picked = self.files.join(found.rows.select("path"), "path", "left_semi")
            moved = picked.withColumn("path", F.concat(F.lit(to + "/"), F.element_at(F.split("path", "/"), -1)))
            gone = picked.join(moved.select("path"), "path", "left_anti").withColumn("content", F.lit(None).cast("string"))
            return self.apply(moved if keep else moved.unionByName(gone))
        spans = edits.disjoint(self.spans())
        if not spans.filter(F.col("path") == to).isEmpty():
            raise QueryError(f"{to} holds what was found")
        parts = F.array_sort(F.collect_list(F.struct("path", "start", F.expr("substring(content, start + 1, end - start)").alias("text"))))
        block = spans.join(self.files, "path").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n")).first()[0] + "\n"  # a page of nodes
        there = self.file(to).withColumn("content", edits.lines_inserted(F.col("content"), F.lit(block), None))
        put = self.rows_of((to, block)) if self.file(to).isEmpty() else there
        return self.apply(put if keep else put.unionByName(edits.spans_changed(self.files, spans, lambda x: F.lit(""))))

    def _copy_found(self, s: Statement) -> DataFrame:
        return self._move_found(s, True)

    # history

    def back_to(self, target: Version) -> DataFrame:
        before = self.version
        self.set_version(target)
        return edits.changed_files(*self.edited(before, target))

    def _undo(self, s: Statement) -> DataFrame:
        n = s.args["last"] + 1
        if n > len(self.undo):
            raise QueryError("nothing to undo")
        target = self.undo[-n]
        self.undo = self.undo[:-n]
        return self.back_to(target)

    def _begin(self, s: Statement) -> DataFrame:
        self.marks.append((s.args["name"], self.version))
        return self._one(transaction=s.args["name"])

    def _commit(self, s: Statement) -> DataFrame:
        rows = corpus.stamped(corpus.with_paths(self.files)).select("node_id", "rev", "path")
        rev = rows.agg(F.sha2(F.bit_xor(F.xxhash64("node_id", "rev")).cast("string"), 256).alias("r")).first()["r"]
        self.commits.insert(0, (rev, s.args["message"]))
        self.trees[rev] = (self.base, self.version)
        self.marks, self.base = [], self.version
        return self._one(hash=rev, subject=s.args["message"])

    def _rollback(self, s: Statement) -> DataFrame:
        want = s.args["name"]
        at = next((i for i in range(len(self.marks) - 1, -1, -1) if want in (None, self.marks[i][0])), None)
        if at is None:
            raise QueryError("no such transaction")
        target = self.marks[at][1]
        self.marks = self.marks[:at]
        return self.back_to(target)
