"""The joins, matches and groups that queries over a corpus rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usage_counts(occurrences: DataFrame, role: str | None = "code") -> DataFrame:
    rows = occurrences if role is None else occurrences.filter(F.col("role") == role)
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("usages"))


def one_each(counts: DataFrame, of: str = "usages") -> DataFrame:
    """A table of one row a name, said in its plan: the optimizer leaves out a join to it whose columns nobody takes."""
    return counts.groupBy("name").agg(F.max(of).alias(of))


def with_usages(symbols: DataFrame, counts: DataFrame) -> DataFrame:
    """Symbols with the number of sites of their name, 0 where there are none. AQE picks the join by size."""
    return symbols.drop("usages").join(counts, "name", "left").withColumn("usages", F.coalesce("usages", F.lit(0)))


def shadowed(base: DataFrame, newer: DataFrame, key: str = "path") -> DataFrame:
    """Rows of ``base`` but for the keys that ``newer`` has, and the rows of ``newer``."""
    return base.join(newer.select(key).distinct(), key, "left_anti").unionByName(newer)


def enclosing(rows: DataFrame, spans: DataFrame, by: list[str], at: str, end: str, span_start: str, span_end: str, span_id: str) -> DataFrame:
    """``rows`` with the id of the last span that starts at or before them and holds their end, else null: an as-of match
    by one window over both sides, not a range join."""
    both = rows.select("*", F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(spans.schema[span_id].dataType).alias("__id"), F.lit(None).cast(spans.schema[span_end].dataType).alias("__end"))
    opened = spans.select(*by, F.col(span_start).alias("__at"), F.lit(0).alias("__kind"), F.col(span_id).alias("__id"), F.col(span_end).alias("__end"))
    w = Window.partitionBy(*by).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("__kind") == 0, F.struct("__id", "__end")), ignorenulls=True).over(w)
    out = both.unionByName(opened, allowMissingColumns=True).withColumn("__span", last).filter("__kind = 1")
    return out.withColumn("enclosing", F.when(F.col(end) <= F.col("__span.__end"), F.col("__span.__id"))).drop("__at", "__kind", "__id", "__end", "__span")


def duplicates_in(rows: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    return rows.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter(F.col("copies") >= least)


def innermost(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, span_id: str, bucket: int) -> DataFrame:
    """Each point with the shortest span that holds it. Spans are cut into buckets of ``bucket`` positions, so that the join is
    an equi-join whose rows grow with the spans' lengths."""
    cut = spans.select(*by, start, end, span_id, F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))).alias("__b"))
    found = points.withColumn("__b", F.floor(F.col(at) / bucket)).join(cut, [*by, "__b"]).filter(F.col(at).between(F.col(start), F.col(end)))
    best = F.min_by(span_id, F.struct((F.col(end) - F.col(start)).alias("length"), span_id))
    return found.groupBy(*by, at).agg(best.alias("innermost"))


def best_candidate(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row a key: the first by ``order``."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")


def resolve_order(preferred: str) -> list[Column]:
    """The order in which symbols of one name are taken: of a preferred kind, of any kind, the last by path and position."""
    return [(F.col("fql_kind") == preferred).desc_nulls_last(), (F.coalesce(F.col("fql_kind"), F.lit("")) != "").desc(), F.desc("path"), F.desc("line")]


def qualified(symbols: DataFrame, name: str) -> DataFrame:
    """Symbols of a plain name, or of ``Owner::member`` and ``Owner.member`` inside their owner."""
    for mark in ("::", "."):
        owner, found, member = name.rpartition(mark)
        if found and owner:
            inside = F.col("fields")["enclosing_type"] == owner.rpartition(mark)[2]
            return symbols.filter((F.col("name") == member) & inside)
    return symbols.filter(F.col("name") == name)


def deduplicated(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first of the rows that agree in ``keys``; deterministic, as ``order`` is total."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def reconciled(read: DataFrame, posted: DataFrame) -> DataFrame:
    """Sites read from text and sites from an index, by (path, line): a posted site of a file that was read counts only if its
    line was confirmed; roles come from the index, else ``text``. ``posted`` has ``was_read``."""
    both = read.withColumn("__read", F.lit(True)).join(posted, ["path", "line"], "full_outer")
    return both.filter(F.col("__read") | ~F.coalesce("was_read", F.lit(False))).select("path", "line", F.coalesce("role", F.lit("text")).alias("role"))


def macro_matches(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """Calls with the first definition of their name and arity; a call without arguments else takes the first that has no
    parameter list (arity null). ``calls``: call_id, name, args; ``definitions``: name, arity, def_pos."""
    fit = (F.col("arity") == F.col("args")) | ((F.col("args") == 0) & F.col("arity").isNull())
    rank = F.row_number().over(Window.partitionBy("call_id").orderBy(F.col("arity").isNull(), "def_pos"))
    return calls.join(definitions, "name").filter(fit).withColumn("__n", rank).filter("__n = 1").drop("__n")


def remapped(old: DataFrame, new: DataFrame, tiers: list[list[str]]) -> DataFrame:
    """New rows with the ordinal of the old row they continue: tier by tier, rows equal in the tier's columns are paired by
    position, and what is paired leaves both sides; the rest gets numbers beyond the largest. ``old``: ordinal, pos;
    ``new``: pos; both have the tiers' columns. Ordinals are per file: ``path`` is part of every tier."""
    columns = list(dict.fromkeys(c for tier in tiers for c in tier))
    sides = old.select("path", "pos", *columns, "ordinal", F.lit(True).alias("__old")).unionByName(new.select("path", "pos", *columns, F.lit(None).cast(old.schema["ordinal"].dataType).alias("ordinal"), F.lit(False).alias("__old")))
    # dealt out by path once: every window below is over parts of a file, so nothing is moved again
    rows = sides.filter("path is not null").repartition("path").withColumns({"__given": F.lit(None).cast("int"), "__open": F.lit(True)})
    is_old = F.col("__old")
    for tier in tiers:
        nth = F.row_number().over(Window.partitionBy("path", *tier, "__open", "__old").orderBy("pos"))
        pair = Window.partitionBy("path", *tier, "__open", "__n")
        known = F.lit(True)
        for c in tier:
            known &= F.col(c).isNotNull()  # a missing value equals nothing
        rows = rows.withColumn("__n", nth).withColumns({"__of_old": F.max(F.when(is_old, F.col("ordinal"))).over(pair), "__both": F.min("__old").over(pair) != F.max("__old").over(pair)})
        met = F.col("__open") & F.col("__both") & known
        rows = rows.withColumns({"__given": F.when(met, F.col("__of_old")).otherwise(F.col("__given")), "__open": F.col("__open") & ~met}).drop("__n", "__of_old", "__both")
    top = F.coalesce(F.max(F.when(is_old, F.col("ordinal"))).over(Window.partitionBy("path")), F.lit(-1))
    fresh = F.row_number().over(Window.partitionBy("path", "__open", "__old").orderBy("pos"))
    done = rows.withColumns({"__top": top, "__fresh": fresh}).filter(~is_old)
    found = F.coalesce("__given", F.col("__top") + F.col("__fresh")).cast("int").alias("ordinal")
    if set(new.columns) <= {"path", "pos", *columns}:
        return done.select("path", "pos", *[c for c in new.columns if c not in ("path", "pos")], found)
    return new.join(done.select("path", "pos", found), ["path", "pos"])


def siblings(rows: DataFrame, by: list[str], order: list[Column], id_: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumns({"prev_sibling": F.lag(id_).over(w), "next_sibling": F.lead(id_).over(w)})


def sibling_runs(rows: DataFrame, by: list[str], order: list[Column], kind: str, least: int = 2) -> DataFrame:
    """Runs of ``least`` and more neighbours of one kind: their first and last place and their number."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = F.coalesce((F.lag(kind).over(w) != F.col(kind)).cast("int"), F.lit(1))
    marked = rows.withColumn("__pos", F.row_number().over(w)).withColumn("__change", change)
    runs = marked.withColumn("run", F.sum("__change").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy(*by, "run", kind).agg(F.min("__pos").alias("first_pos"), F.max("__pos").alias("last_pos"), F.count(F.lit(1)).alias("members")).filter(F.col("members") >= least)


def compact(rows: DataFrame, keys: list[str], item: Column, to: str) -> DataFrame:
    """Rows of one key as one row with a sorted list, the layout of compact results."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias(to))


def children(nodes: DataFrame, parents: DataFrame, on: Column, order: list[Column], to: str = "place") -> DataFrame:
    """Each parent's nodes with their place under it, from 1."""
    both = parents.join(nodes, on)
    return both.withColumn(to, F.row_number().over(Window.partitionBy(*parents.columns).orderBy(*order)))


def distinct_counts(rows: DataFrame, by: str, of: list[str], to: str) -> DataFrame:
    return rows.groupBy(by).agg(F.countDistinct(*of).alias(to))


def with_errors(files: DataFrame, errors: DataFrame, key: str, bad: Column, extent: Column) -> DataFrame:
    """``files`` with the number of their error rows and the extent of them, 0 where there are none."""
    sums = errors.filter(bad).groupBy(key).agg(F.count(F.lit(1)).alias("error_count"), F.sum(extent).alias("error_bytes"))
    return files.join(sums, key, "left").withColumns({"error_count": F.coalesce("error_count", F.lit(0)), "error_bytes": F.coalesce("error_bytes", F.lit(0))})


def maxima(rows: DataFrame, by: str, of: str, most: str, count: str) -> DataFrame:
    """The largest value and the number of the rows inside each owner."""
    return rows.groupBy(by).agg(F.max(of).alias(most), F.count(F.lit(1)).alias(count))
