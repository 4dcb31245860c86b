"""The index of a corpus: symbols from per-file readers, occurrences by role, and the fields that joins add."""

from __future__ import annotations

import gc
import json
from collections import deque
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity, text
from ..operators import edits, relations
from ..store import bounded
from . import clike, corpus, formats

RAW = "path string, language string, pos int, name string, fql_kind string, line int, end_line int, byte_start int, byte_end int, char_start int, char_end int, parent_pos int, ordinal int, first boolean, fields map<string,string>"
_BRACED = "(^|/)(?!Kconfig)[^/]*[.](" + "|".join(e for e, language in formats.LANGUAGES.items() if language in ("c", "cpp")) + ")$"
_NAME, _KIND, _ORDINAL = (RAW.split(", ").index(c) for c in ("name string", "fql_kind string", "ordinal int"))
# decimal literals that are their own value
PLAIN = r"\A(?:0|[1-9][0-9]{0,17})\z"
# bytes of a file that has a task for itself
LONG = 1 << 18
# least characters of a part of a long file
PART = 1 << 19
ADDRESSABLE = ("function", "class", "struct", "interface", "enum", "field", "variable", "macro", "type_alias", "namespace", "import", "object", "array", "pair", "section", "heading", "paragraph", "table", "code_block", "list_item", "block_quote", "call_statement", "macro_call", "comment_block", "include_block", "import_block", "macro_block", "type_alias_block", "array_block", "if", "while", "for", "switch", "do")
_NUMBERED = frozenset(ADDRESSABLE)


# fixed values: runs of siblings that count as one block, by language: kind, block, least run, field that splits runs
_C_BLOCKS = [("comment", "comment_block", 2, "comment_style"), ("import", "include_block", 2, ""), ("macro", "macro_block", 2, "")]
_BLOCKS = {
    "c": _C_BLOCKS, "cpp": [*_C_BLOCKS, ("type_alias", "type_alias_block", 2, "")], "json": [("array", "array_block", 8, "")], "yaml": [("comment", "comment_block", 2, "")],
    "python": [("comment", "comment_block", 2, ""), ("import", "import_block", 2, "")], "rust": [("comment", "comment_block", 2, "comment_style"), ("import", "import_block", 2, "")],
}
_SUFFIXES = {
    "ull": "unsigned_long_long", "ul": "unsigned_long", "ll": "long_long", "uz": "unsigned_size", "u": "unsigned", "l": "long", "z": "size", "f": "float",
    "u8": "unsigned_8", "u16": "unsigned_16", "u32": "unsigned_32", "u64": "unsigned_64", "u128": "unsigned_128", "usize": "unsigned_size",
    "i8": "signed_8", "i16": "signed_16", "i32": "signed_32", "i64": "signed_64", "i128": "signed_128", "isize": "signed_size", "f32": "float_32", "f64": "float_64",
}


def with_blocks(language: str, rows: list[formats.Row], content: str) -> list[formats.Row]:
    """``rows`` with one more row before each run of adjacent siblings of a kind that makes blocks. Members stay as they are,
    tagged with their place in the block; the block is their sibling."""
    specs = {s[0]: s[1:] for s in _BLOCKS.get(language, ())}
    if not specs:
        return rows
    runs: list[list[int]] = []
    last: dict[int, list[int]] = {}
    key = lambda r: (r.fql_kind, r.fields.get(specs[r.fql_kind][2], ""))
    for i, r in enumerate(rows):
        if r.fql_kind in ("call", "number"):
            continue
        run = last.get(r.parent)
        if r.fql_kind not in specs:
            last.pop(r.parent, None)
        elif run and key(rows[run[-1]]) == key(r) and not content[rows[run[-1]].end : r.start].strip(" \t\r\n,;"):
            run.append(i)
        else:
            last[r.parent] = run = [i]
            runs.append(run)
    heads = {run[0]: run for run in runs if len(run) >= specs[rows[run[0]].fql_kind][1]}
    if not heads:
        return rows
    out, place = [], {-1: -1}
    for i, r in enumerate(rows):
        if run := heads.get(i):
            end = rows[run[-1]]
            kind = specs[r.fql_kind][0]
            head = content[r.start : r.end].split("\n")[0][:60]
            out.append(formats.Row(kind, kind, r.start, end.end, r.line, end.end_line, r.parent, {"block_label": f"{head} ({len(run)})"}))
            for k in run:
                a, b = rows[k].line - r.line + 1, rows[k].end_line - r.line + 1
                rows[k].fields |= {"block_ord": str(len(out) - 1), "block_off": str(a) if a == b else f"{a}-{b}"}
        place[i] = len(out)
        out.append(r)
    blocks = {id(r) for r in out} - {id(r) for r in rows}
    for r in out:
        r.parent = place[r.parent] if id(r) not in blocks else r.parent
    for r in out:
        if id(r) in blocks and r.parent >= 0:
            r.parent = place[r.parent]
    return out


def byte_offsets(content: str) -> Callable[[int], int]:
    """Character offsets of a text to offsets of its UTF-8 bytes."""
    if content.isascii():
        return lambda i: i
    points = np.frombuffer(content.encode("utf-32-le"), np.uint32)
    upto = np.r_[0, np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))]
    return lambda i: int(upto[i])


def rows_of_file(path: str, content: str, part: clike.Part | None = None, before: int = 0) -> Iterator[list[tuple]]:
    """The rows of one file in the columns of RAW, piece by piece. ``first`` marks the first row of a name and kind in a line. A
    ``part`` of a file has its own text as ``content`` and ``before`` bytes before it; its rows stand where they do in the file,
    but for positions and ordinals, which count from the part's first row."""
    part = part or clike.Part(0, len(content), 0, [], 0)
    start, lines = part.start, part.line
    language, pieces = formats.read_pieces(path, content, part.frames, part.group)
    at, base, last, seen = byte_offsets(content), 0, 0, set()
    plain = content.encode() if content.isascii() else None
    for rows in pieces:
        rows = with_blocks(language, rows, content)
        ordinals, out = [], []
        for r in rows:
            last += r.fql_kind in _NUMBERED
            ordinals.append(last)
        for i, r in enumerate(rows):
            piece = plain[r.start : r.end] if plain is not None else content[r.start : r.end].encode("utf-8", "replace")
            if r.fql_kind != "call":
                r.fields["content_hash"] = sha256(piece).hexdigest()[:16]
            if r.fql_kind == "error":
                r.fields["error_bytes"] = str(len(piece))
            if "block_ord" in r.fields:
                r.fields["block_ord"] = f"{ordinals[int(r.fields['block_ord'])]:04d}"
            number = ordinals[i] if r.fql_kind in _NUMBERED else None
            a, b = (r.start, r.end) if plain is not None else (at(r.start), at(r.end))
            key = (r.name, r.fql_kind, r.line)
            first = key not in seen
            seen.add(key)
            parent = r.parent + base if r.parent >= 0 else r.parent
            if start and "body_start" in r.fields:
                r.fields["body_start"] = str(int(r.fields["body_start"]) + start)
            out.append((path, language, base + i, r.name, r.fql_kind, r.line + lines, r.end_line + lines, a + before, b + before, r.start + start, r.end + start, parent, number, first, r.fields))
        if rows:
            base += len(rows)
            seen = {s for s in seen if s[2] >= rows[-1].line}  # the next piece may begin in the line that this one ends in
            yield out


def batches(rows: list[tuple], most: int = 5000) -> Iterator[pa.RecordBatch]:
    """Rows in the columns of RAW as batches of Arrow."""
    names = [c.split()[0] for c in RAW.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    for k in range(0, len(rows), most):
        *plain, fields = zip(*rows[k : k + most])
        columns = [pa.array(values, types[c.split()[1]]) for values, c in zip(plain, RAW.split(", "))]
        offsets = np.r_[0, np.cumsum([len(f) for f in fields])].astype(np.int32)
        keys, values = [x for f in fields for x in f], [x for f in fields for x in f.values()]
        columns.append(pa.MapArray.from_arrays(pa.array(offsets), pa.array(keys, pa.string()), pa.array(values, pa.string())))
        yield pa.RecordBatch.from_arrays(columns, names)


def spread(files: DataFrame) -> DataFrame:
    """``files`` with the long ones dealt out by path: those that a folder or a table holds together would meet in one task."""
    long = F.coalesce(F.octet_length("content"), F.lit(0)) >= LONG
    parts = max(64, 8 * files.sparkSession.sparkContext.defaultParallelism)
    return files.filter(~long).unionByName(files.filter(long).repartition(parts, "path"))


def part_symbols(files: DataFrame) -> DataFrame:
    """Rows of every file (path, content) with their ``part``. Long files of C and C++ are cut into parts that tasks share, so the
    longest file sets no pace; all else is read where it lies or, if it is long, by path."""
    least = PART

    def cut(batch: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batch:
            for path, content in zip(p.column("path").to_pylist(), p.column("content")):
                text_, before = content.as_py(), 0
                for n, x in enumerate(clike.parts(text_, least)):
                    body = text_[x.start : x.end]
                    row = {"path": path, "content": body, "part": n, "at": json.dumps([x.start, x.end, x.line, x.frames, x.group, before])}
                    yield pa.RecordBatch.from_pylist([row], pa.schema([("path", pa.string()), ("content", pa.string()), ("part", pa.int32()), ("at", pa.string())]))
                    before += len(body.encode("utf-8", "replace"))

    def run(batch: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(100_000)  # readers make many small objects and few cycles
        for p in batch:
            for path, content, n, at in zip(*(p.column(c) for c in ("path", "content", "part", "at"))):
                *place, before = json.loads(at.as_py()) if at.is_valid else (None, 0)
                part = clike.Part(*place) if at.is_valid else None
                for rows in rows_of_file(path.as_py(), content.as_py() or "", part, before):
                    for b in batches(rows):
                        yield b.append_column("part", pa.array([n.as_py()] * b.num_rows, pa.int32()))

    long = (F.coalesce(F.octet_length("content"), F.lit(0)) >= LONG) & F.regexp_like("path", F.lit(_BRACED))
    whole = spread(files.filter(~long)).select("path", "content", F.lit(0).alias("part"), F.lit(None).cast("string").alias("at"))
    many = bounded(spread(files.filter(long).select("path", "content"))).mapInArrow(cut, "path string, content string, part int, at string")
    tasks = max(64, 8 * files.sparkSession.sparkContext.defaultParallelism)
    return bounded(whole.unionByName(many.repartition(tasks, "path", "part"))).mapInArrow(run, RAW + ", part int")


def joined_parts(rows: DataFrame, kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``part_symbols``, read from a table, with positions and ordinals that count on through a file's parts. What the parts before
    held is a number or two a part, which ``kept`` makes a table of and every task gets whole."""
    sizes = rows.groupBy("path", "part").agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.max("ordinal"), F.lit(0)).alias("numbers"))
    earlier = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    upto = kept(sizes.select("path", "part", F.sum("rows").over(earlier).cast("int").alias("__rows"), F.sum("numbers").over(earlier).cast("int").alias("__numbers")).filter("part > 0"))
    if upto.isEmpty():
        return rows.drop("part")
    more = F.coalesce("__numbers", F.lit(0))
    fields = F.when(
        (more > 0) & F.col("fields")["block_ord"].isNotNull(),
        F.transform_values("fields", lambda k, v: F.when(k == "block_ord", F.format_string("%04d", v.cast("int") + more)).otherwise(v)),
    ).otherwise(F.col("fields"))
    moved = {
        "pos": F.col("pos") + F.coalesce("__rows", F.lit(0)), "ordinal": F.col("ordinal") + more, "fields": fields,
        "parent_pos": F.when(F.col("parent_pos") >= 0, F.col("parent_pos") + F.coalesce("__rows", F.lit(0))).otherwise(F.col("parent_pos")),
    }
    return rows.join(F.broadcast(upto), ["path", "part"], "left").withColumns(moved).select(*[c for c in rows.columns if c != "part"])  # a row a part of 512 KB


def read_again(files: DataFrame, old: DataFrame) -> DataFrame:
    """Rows of new versions of files with the ordinals of the ``old`` rows that they continue: equal in kind, name and text,
    else in kind and name, in order; what is new is numbered beyond the largest. Files without old rows keep what their
    reader gave them; a block's members follow its number. A file of many pieces is read twice: for its keys, then for its
    rows."""
    one = F.struct("pos", "ordinal", "fql_kind", "name", F.col("fields")["content_hash"].alias("hash"))
    before = old.filter("ordinal is not null").groupBy("path").agg(F.array_sort(F.collect_list(one)).alias("had"))

    def numbers(had: pa.StructArray, keys: Iterator[tuple]) -> list[int]:
        """The ordinals of rows with ``keys`` (kind, name, text)."""
        keys = [*keys]
        given: dict[int, int] = {}
        left = [*zip(had.field("ordinal").to_pylist(), zip(*(had.field(c).to_pylist() for c in ("fql_kind", "name", "hash"))))]
        top = max(n for n, _ in left)
        for parts in (3, 2):
            waiting: dict[tuple, deque[int]] = {}
            for n, key in left:
                waiting.setdefault(key[:parts], deque()).append(n)
            for i, key in enumerate(keys):
                if i not in given and (same := waiting.get(key[:parts])):
                    given[i] = same.popleft()
            taken = set(given.values())
            left = [(n, key) for n, key in left if n not in taken]
        for i in range(len(keys)):
            if i not in given:
                top = given[i] = top + 1
        return [given[i] for i in range(len(keys))]

    def again(path: str, content: str, had: pa.StructArray | None) -> Iterator[list[tuple]]:
        if had is None or not len(had):
            yield from rows_of_file(path, content)
            return
        held: list[list[tuple]] = []  # the first piece, which is most often all

        def keys() -> Iterator[tuple]:
            for n, rows in enumerate(rows_of_file(path, content)):
                held[:] = [rows] if n == 0 else []
                yield from ((r[_KIND], r[_NAME], r[-1].get("content_hash")) for r in rows if r[_ORDINAL] is not None)

        given, at = numbers(had, keys()), 0
        for rows in held or rows_of_file(path, content):
            out, moved = [], {}
            for r in rows:
                if (n := r[_ORDINAL]) is not None:
                    moved[f"{n:04d}"] = f"{given[at]:04d}"
                    r = (*r[:_ORDINAL], given[at], *r[_ORDINAL + 1 :])
                    at += 1
                out.append(r)
            for r in out:
                if "block_ord" in r[-1]:
                    r[-1]["block_ord"] = moved[r[-1]["block_ord"]]
            yield out

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            for path, content, had in zip(p.column("path"), p.column("content"), p.column("had")):
                for rows in again(path.as_py(), content.as_py() or "", had.values):
                    yield from batches(rows)

    both = files.select("path", "content").join(before, "path", "left")
    return bounded(both).mapInArrow(run, RAW)


def code_counts(files: DataFrame, raw: DataFrame) -> DataFrame:
    """(name, usages): how often identifiers occur in code."""
    return relations.usage_counts(roles(corpus.lines(files), raw))


def symbols(raw: DataFrame, counts: DataFrame | None, expanded: DataFrame, apart: bool = False) -> DataFrame:
    """Symbol rows of ``part_symbols`` with handles, derived fields of names and numbers, the rows of ``macro_calls`` and usages
    of names, which cost nothing where nobody reads them: ``counts`` has one row a name by its plan. Rows that are
    all wanted are taken ``apart``: numbers, conditions and comments are no identifiers, so they move nowhere."""
    rows = raw.filter("fql_kind <> 'call'").unionByName(expanded)
    name, kind, fields = F.col("name"), F.col("fql_kind"), F.col("fields")
    of_names = F.map_from_arrays(F.array(F.lit("naming"), F.lit("name_length")), F.array(text.naming_style(name), text.name_length(name).cast("string")))
    meaning = F.create_map(*[F.lit(x) for pair in _SUFFIXES.items() for x in pair])[F.lower(text.number_suffix(name))]
    keys = F.array(*map(F.lit, ("num_format", "num_value", "num_suffix", "suffix_meaning")))
    of_numbers = F.map_from_arrays(keys, F.array(text.number_format(name), text.number_value(name).cast("string"), text.number_suffix(name), meaning))
    of_plain = F.map_from_arrays(F.array(*map(F.lit, ("num_format", "num_value", "num_suffix"))), F.array(F.lit("dec"), name, F.lit("")))
    of_numbers = F.when(name.rlike(PLAIN), of_plain).otherwise(of_numbers)  # nearly all numbers, by one pattern
    declared = kind.isin("function", "class", "struct", "interface", "enum", "field", "variable", "macro", "type_alias", "namespace")
    none = F.create_map().cast("map<string,string>")
    fields = F.map_concat(fields, F.when(declared, of_names).otherwise(none), F.when(kind == "number", of_numbers).otherwise(none))
    rows = rows.withColumn("fields", F.map_filter(fields, lambda k, v: v.isNotNull()))
    rows = rows.withColumn("node_id", F.when(F.col("ordinal").isNotNull(), identity.node_id(F.col("path"), F.col("ordinal"))))
    for field in ("body", "role", "value", "type"):
        rows = rows.withColumn(field, F.col("fields")[field])
    unused = F.lit(0).cast("bigint").alias("usages")
    if counts is None:
        return rows.select("*", unused)
    counted = name.rlike("^[A-Za-z_][A-Za-z0-9_]+$")
    some = relations.with_usages(rows.filter(counted) if apart else rows, counts)
    return some.unionByName(rows.filter(~counted).select("*", unused)) if apart else some


def roles(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Occurrences of identifiers with the role of their line: comment, doc or config by the symbols there, else code."""
    of_line = found.filter(F.col("fql_kind").isin("comment", "pair", "paragraph", "heading", "list_item")).select(
        "path", F.explode(F.sequence("line", "end_line")).alias("line"), F.when(F.col("fql_kind") == "comment", "comment").when(F.col("fql_kind") == "pair", "config").otherwise("doc").alias("role")
    )
    best = of_line.groupBy("path", "line").agg(F.min("role").alias("role"))
    sites = lines.join(best, ["path", "line"], "left").select("path", "line", "text", F.coalesce("role", F.lit("code")).alias("role"))
    return sites.select("path", "line", "role", F.posexplode(text.tokens(F.col("text"))).alias("pos", "name")).select("name", "path", "line", "pos", "role")


def callees(raw: DataFrame) -> DataFrame:
    """(caller, name, path, line) of the calls that functions make."""
    f = raw.filter("fql_kind = 'function'").select("path", F.col("pos").alias("parent_pos"), F.col("name").alias("caller"))
    return raw.filter("fql_kind in ('call', 'macro_call')").join(f, ["path", "parent_pos"]).select("caller", "name", "path", "line").distinct()


def macro_calls(raw: DataFrame, rows: DataFrame, kept: Callable[[DataFrame, str], DataFrame] = lambda df, tag: df) -> DataFrame:
    """Calls in ``raw`` whose name some file of ``rows`` defines as a macro, as ``macro_call`` rows with their expansion by one
    level. The first definition of a name and arity, by path and line, stands for all, so a call meets one row an arity.
    Definitions that ``kept`` makes a table of have a known size, so calls need not be shuffled to meet few of them; the calls
    that meet one are a table too, so all calls are read once."""
    field = F.col("fields")
    define = F.struct(F.col("path").alias("file"), "line", F.coalesce(field["value"], F.lit("")).alias("body"), F.coalesce(field["parameters"], F.lit("")).alias("parameters"))
    defs = rows.filter("fql_kind = 'macro' and language <> 'rust'").groupBy("name", field["macro_arity"].cast("int").alias("arity")).agg(F.min(define).alias("def_pos"))
    defs = kept(defs, "definitions")
    calls = raw.filter("fql_kind = 'call'").withColumns({"call_id": F.struct("path", "pos"), "args": F.coalesce(field["argument_count"].cast("int"), F.lit(0))})
    known = kept(calls.join(defs.select("name").distinct(), "name", "left_semi"), "calls")
    best = relations.macro_matches(known.select("call_id", "name", "args"), defs).select("call_id", "def_pos", "arity")
    d = F.col("def_pos")
    pairs = F.arrays_zip(F.split(d["parameters"], r"\s*,\s*").alias("p"), F.split(field["arguments"], "\x1f").alias("a"))
    put = lambda acc, x: F.regexp_replace(acc, F.concat(F.lit("\\b\\Q"), x["p"], F.lit("\\E\\b")), F.regexp_replace(x["a"], r"([\\$])", r"\\$1"))
    text_ = F.when(F.coalesce("arity", F.lit(0)) > 0, F.aggregate(pairs, d["body"], put)).otherwise(d["body"])
    reads = F.regexp_extract_all("__text", F.lit("(?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9_]+"), 0)
    found = {
        "macro_def_file": d["file"], "macro_def_line": d["line"].cast("string"), "macro_arity": F.coalesce("arity", F.lit(0)).cast("string"), "macro_expansion": F.col("__text"), "expansion_depth": F.lit("0"),
        "expanded_reads": F.when(F.size(reads) > 0, F.array_join(reads, ",")), "expanded_has_escape": F.when(F.contains("__text", F.lit("&")), "true"),
    }
    lost = {"expansion_failed": F.lit("true"), "expansion_failure_reason": F.lit("budget_exhausted")}
    as_map = lambda m: F.map_from_arrays(F.array(*map(F.lit, m)), F.array(*m.values()))
    rows = known.join(best, "call_id", "left").withColumn("__text", text_)
    more = F.map_filter(F.when(d.isNotNull(), as_map(found)).otherwise(as_map(lost)), lambda k, v: v.isNotNull())
    return rows.withColumns({"fields": F.map_concat(field, more), "fql_kind": F.lit("macro_call")}).select(*raw.columns)


def members(found: DataFrame, owner: str) -> DataFrame:
    """Rows directly inside the types of a name."""
    types = found.filter((F.col("name") == owner) & F.col("fql_kind").isin("class", "struct", "interface", "enum", "namespace")).select("path", F.col("pos").alias("parent_pos"))
    inside = found.join(types, ["path", "parent_pos"])
    return inside.select(F.coalesce(F.col("fields")["member_kind"], F.when(F.col("fql_kind") == "function", "method").otherwise("field")).alias("fql_kind"), F.col("name").alias("text"), "line", "path", "node_id")


def outline(found: DataFrame, everything: bool = False) -> DataFrame:
    """Rows of files in order with the depth of their ancestors that are listed too."""
    kinds = ("function", "class", "struct", "interface", "enum", "variable", "field", "import", "macro", "type_alias", "namespace", "object", "section", "array")
    rows = found if everything else found.filter(F.col("fql_kind").isin(*kinds) & (F.coalesce(F.col("fields")["scope"], F.lit("")) != "local"))
    return _with_depth(rows.select("path", "pos", "name", "fql_kind", "line", "parent_pos", "node_id"))


def _with_depth(rows: DataFrame) -> DataFrame:
    """``rows`` with the number of their listed ancestors."""
    key = F.struct("path", "pos")
    up = rows.select("path", F.col("pos").alias("parent_pos"), F.lit(True).alias("__listed"))
    nodes = rows.join(up, ["path", "parent_pos"], "left").select(key.alias("node"), F.when(F.col("__listed"), F.struct("path", F.col("parent_pos").alias("pos"))).alias("parent"))
    found = edits.depths(nodes).select(F.col("node.path").alias("path"), F.col("node.pos").alias("pos"), "depth")
    return rows.join(found, ["path", "pos"])
