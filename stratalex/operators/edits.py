"""Lines, ranges and edits: a corpus is never changed in place; every edit is a plan for its next version."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lang.statement import QueryError
from ..store import bounded, saved


def line_range(lines: DataFrame, first: int, last: int) -> DataFrame:
    if first < 1 or last < first:
        raise QueryError(f"no lines {first}-{last}")
    return lines.filter(F.col("line").between(first, last))


def context(lines: DataFrame, centre: int, around: int) -> DataFrame:
    return line_range(lines, max(1, centre - around), centre + around).withColumn("marker", F.when(F.col("line") == centre, ">>>"))


def tail(lines: DataFrame, n: int) -> DataFrame:
    last = lines.groupBy("path").agg(F.max("line").alias("__last"))
    return lines.join(last, "path").filter(F.col("line") > F.col("__last") - n).drop("__last")


def depths(nodes: DataFrame) -> DataFrame:
    """(node, depth) of the nodes of trees (node, parent). Each round doubles how far up a node points, so a tree of depth d
    takes log2(d) joins, and every round is a table. Nodes that no root is above (under a missing parent, or in a ring) have
    no depth and no row."""
    now = saved(nodes.select("node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth")), "depths")
    before = None
    while (left := now.filter("up is not null").count()) not in (0, before):
        before = left
        above = now.select(F.col("node").alias("up"), F.col("up").alias("__up"), F.col("depth").alias("__more"))
        climbed = now.filter("up is not null").join(above, "up").select("node", F.col("__up").alias("up"), (F.col("depth") + F.col("__more")).alias("depth"))
        now = saved(now.filter("up is null").unionByName(climbed), "depths")
    return now.filter("up is null").select("node", "depth")


def pattern_of(old: str, word: bool) -> str:
    """A literal as a pattern, between the sides of words if asked: ``\\b`` takes another view of marks and letters in every
    version of Java."""
    if not old:
        raise QueryError("nothing to match")
    pattern = "\\Q" + old.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    edge = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
    return f"(?U){edge}{pattern}{edge}" if word else pattern


def replaced_text(content: Column, old: str, new: str, word: bool) -> Column:
    """``content`` with every occurrence of a literal replaced, as a whole word if asked."""
    pattern = pattern_of(old, word)
    return F.regexp_replace(content, pattern, re.sub(r"([\\$])", r"\\\1", new)) if word else F.replace(content, F.lit(old), F.lit(new))


def replaced(files: DataFrame, old: str, new: str, word: bool) -> DataFrame:
    """Files with every occurrence of a literal replaced, and the number of ``hits``."""
    hits = F.regexp_count("content", F.lit(pattern_of(old, word))).cast("bigint")
    return files.withColumns({"hits": hits, "content": replaced_text(F.col("content"), old, new, word)})


def spans_changed(files: DataFrame, spans: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    """(path, content) of the files that ``spans`` (path, start, end; characters) lie in, each span replaced by ``change`` of
    its text, from the last to the first. Spans inside others go with them; spans that cross are refused."""
    merged = disjoint(spans)
    if not overlaps(merged, ["path"], ["end"]).filter("overlaps").isEmpty():
        raise QueryError("edits cross each other")
    listed = merged.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__spans"))
    cut = files.join(listed, "path").select("path", "content", F.col("__spans.start").alias("starts"), F.col("__spans.end").alias("ends"))
    parts = pieces(cut).withColumn("text", F.when(F.col("inside"), change(F.col("text"))).otherwise(F.col("text")))
    whole = F.array_sort(F.collect_list(F.struct("nth", "text")))
    return parts.groupBy("path").agg(F.array_join(whole["text"], "").alias("content"))


def pieces(files: DataFrame) -> DataFrame:
    """(path, nth, inside, text) of files (path, content, starts, ends; sorted spans that don't cross): a text is cut in one
    walk, however many spans it has."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for path, content, starts, ends in zip(p.path, p.content, p.starts, p.ends):
                at, out = 0, []
                for a, b in zip(starts, ends):
                    out += [(path, len(out), False, content[at:a]), (path, len(out) + 1, True, content[a:b])]
                    at = b
                yield pd.DataFrame([*out, (path, len(out), False, content[at:])], columns=["path", "nth", "inside", "text"])

    return bounded(files).mapInPandas(run, "path string, nth int, inside boolean, text string")


def disjoint(spans: DataFrame) -> DataFrame:
    """The spans that no other one of their file holds."""
    before = Window.partitionBy("path").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return spans.select("path", "start", "end").distinct().withColumn("__end", F.max("end").over(before)).filter("__end is null or end > __end").drop("__end")


def line_spans(files: DataFrame) -> DataFrame:
    """(path, line, start, end) of every line of files: its characters with its line end. Lengths are summed up in order, so a
    file is read once; only lengths are shuffled."""
    sizes = F.transform(F.split("content", "\n", -1), lambda x: F.length(x) + 1)
    known = files.select("path", F.length("content").alias("__length"), sizes.alias("__sizes"))  # before rows are made: a line must not carry its file
    each = known.select("path", "__length", F.posexplode("__sizes").alias("__pos", "__size"))
    upto = Window.partitionBy("path").orderBy("__pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done = each.withColumn("__upto", F.sum("__size").over(upto))
    return done.select("path", (F.col("__pos") + 1).alias("line"), (F.col("__upto") - F.col("__size")).cast("int").alias("start"), F.least("__upto", "__length").cast("int").alias("end"))


def line_start(content: Column, line: int) -> Column:
    """How many characters come before a line, counted from 1; all of them where the text has no such line."""
    return F.lit(0) if line <= 1 else F.least(F.length(content), F.length(F.substring_index(content, "\n", line - 1)) + 1)


def spliced(content: Column, start: Column, end: Column, new: Column) -> Column:
    """``content`` with the characters from ``start`` to ``end`` replaced: every other character stays as it is."""
    return F.concat(F.substring(content, F.lit(1), start), new, F.substring(content, end + 1, F.length(content)))


def _whole_lines(text: Column) -> Column:
    return F.when((text == "") | text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))


def lines_changed(content: Column, first: int, last: int, new: str) -> Column:
    """Lines ``first`` to ``last`` with their line ends replaced by ``new``, which is given a line end if it has none;
    nothing takes the lines away. A text that ends before ``first`` takes the new lines at its end."""
    start = line_start(content, first)
    return spliced(content, start, line_start(content, last + 1), F.concat(_lead(content, start, F.lit(new)), _whole_lines(F.lit(new))))


def _lead(content: Column, at: Column, new: Column) -> Column:
    """The line end that new lines need before them at the end of a text without one."""
    open_ = (at > 0) & (at == F.length(content)) & ~content.endswith("\n")
    return F.when(open_ & (new != ""), F.lit("\n")).otherwise(F.lit(""))


def lines_of(content: Column, first: int, last: int) -> Column:
    """The text of lines, with their line ends."""
    start = line_start(content, first)
    return F.substring(content, start + 1, line_start(content, last + 1) - start)


def lines_inserted(content: Column, block: Column, after: int | None) -> Column:
    """``block`` as whole lines behind line ``after``, or at the end."""
    at = F.length(content) if after is None else line_start(content, after + 1)
    return spliced(content, at, at, F.concat(_lead(content, at, block), _whole_lines(block)))


def lines_moved(files: DataFrame, source: str, first: int, last: int, block: str, target: str, after: int | None, keep: bool) -> DataFrame:
    """``files`` with ``block``, lines ``first`` to ``last`` of ``source``, put behind line ``after`` of ``target``; gone from
    where they were unless ``keep``. The later of two places in one file is changed first."""
    path, c = F.col("path"), F.col("content")
    if source == target and not keep and after is not None and first <= after < last:
        raise QueryError("lines cannot move into themselves")
    put = lambda x: lines_inserted(x, F.lit(block), after)
    cut = lambda x: x if keep else spliced(x, line_start(x, first), line_start(x, last + 1), F.lit(""))
    if source == target:
        both = cut(put(c)) if after is None or after >= last else put(cut(c))
        return files.withColumn("content", F.when(path == source, both).otherwise(c))
    return files.withColumn("content", F.when(path == source, cut(c)).when(path == target, put(c)).otherwise(c))


def overlaps(edits: DataFrame, by: list[str], ties: list[str]) -> DataFrame:
    """Edits (start, end) of each file in order, and whether one begins before the last one ends."""
    w = Window.partitionBy(*by).orderBy("start", *ties)
    return edits.withColumn("overlaps", F.coalesce(F.lag("end").over(w) > F.col("start"), F.lit(False)))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status) of files added, deleted and modified between two versions (path, content)."""
    a, b = before.select("path", F.col("content").alias("__a")), after.select("path", F.col("content").alias("__b"))
    both = a.withColumn("__ina", F.lit(True)).join(b.withColumn("__inb", F.lit(True)), "path", "full_outer")
    status = F.when(F.col("__ina").isNull(), "A").when(F.col("__inb").isNull(), "D").otherwise("M")
    return both.filter(~F.col("__a").eqNullSafe(F.col("__b"))).select("path", status.alias("status"))


def paired(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status, a, b): ``changed_files`` with both contents."""
    a, b = before.select("path", F.col("content").alias("a")), after.select("path", F.col("content").alias("b"))
    return changed_files(before, after).join(a, "path", "left").join(b, "path", "left")


def line_changes(pairs: DataFrame) -> DataFrame:
    """(path, added, removed) of pairs of versions (path, a, b; null is no file): lines that a longest common subsequence of
    lines leaves over. A file's lines take one task; pairs are independent."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([(path, *changed_lines(split_lines(a), split_lines(b))) for path, a, b in zip(p.path, p.a, p.b)], columns=["path", "added", "removed"])

    kind = pairs.schema["path"].dataType.simpleString()
    return bounded(pairs.select("path", "a", "b")).mapInPandas(run, f"path {kind}, added bigint, removed bigint")


def split_lines(text: str | None) -> list[str]:
    """Lines without their line ends; what follows the last line end is a line if it is not empty."""
    lines = (text or "").split("\n")
    return lines if lines[-1] else lines[:-1]


def changed_lines(a: list[str], b: list[str]) -> tuple[int, int]:
    """How many lines of ``b`` and of ``a`` are outside a longest common subsequence, found with one row of bits."""
    gone = [0, 0]
    while True:
        at = 0
        while at < min(len(a), len(b)) and a[at] == b[at]:
            at += 1
        end = 0
        while end < min(len(a), len(b)) - at and a[-1 - end] == b[-1 - end]:
            end += 1
        a, b = a[at : len(a) - end], b[at : len(b) - end]
        of_a, of_b = set(a), set(b)
        if of_a == of_b:
            break
        # a line that the other side doesn't have is in no common subsequence, and what is left may begin alike
        sizes = len(a), len(b)
        a, b = [x for x in a if x in of_b], [x for x in b if x in of_a]
        gone = [gone[0] + sizes[0] - len(a), gone[1] + sizes[1] - len(b)]
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        if mask := places.get(x, 0):
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    common = len(a) - row.bit_count()
    return gone[1] + len(b) - common, gone[0] + len(a) - common
