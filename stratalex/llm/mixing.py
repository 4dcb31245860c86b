"""Mixing sources to target weights: Pareto order sampling, with DataFrame functions only.

Each source has a target in words. A document's expected number of copies is its source's target over its size (times
a relative weight, if one is given); the whole part is certain. For the rest, documents are ranked by random odds
over inclusion odds, (U / (1 - U)) / (p / (1 - p)), and the smallest ranks are taken until the source's words are
filled: a sample of fixed size, here in words (the last gap goes to the document after the cut that fits it best). U
is a hash of the document, so reruns agree.

Ranks are cut without sorting a source: their odds fall into ``BINS`` ordered bins, sums by source and bin find the
bin that holds the cut, and only the rows of that bin are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, saved, words_in

BINS = 4096


def targets(sizes: DataFrame, weights: list[float], repeats: float) -> DataFrame:
    """(source, total, tilted) with ``target``: sources by code point, null last, take ``weights`` in turn and share all
    sizes; a target stops at ``repeats`` times its source's size, and the excess is shared again by weight until none
    is above. Every round is one aggregate over the sources."""
    turn = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.col("__rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = saved(numbered(sizes, [F.asc_nulls_last("source")], "__rank").select("*", turn.alias("__weight")), "sources")
    cap = F.col("total") * repeats
    words = rows.agg(F.sum("total")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        above = cap <= F.col("__weight") * level
        r = rows.agg(F.sum(F.when(above, cap)).alias("capped"), F.sum(F.when(~above, F.col("__weight"))).alias("open"), F.count_if(above).alias("n")).first()
        if r["n"] == full or not r["open"]:
            level = level if r["open"] else float("inf")
            break
        full, level = r["n"], (words - (r["capped"] or 0)) / r["open"]
    share = F.col("__weight") * F.lit(level) if level != float("inf") else cap
    return rows.select("source", "total", "tilted", F.least(cap, share).cast("double").alias("target"))


def uniform(key: Column) -> Column:
    """A number inside (0, 1) from a 64-bit hash."""
    return (F.shiftrightunsigned(key, 11).cast("double") + 0.5) / F.lit(2.0**53)


def _ranked(rows: DataFrame, plan: DataFrame, repeats: int) -> DataFrame:
    """Rows (source, size, key, weight, ...) with certain copies and the place of their rank."""
    ratio = F.when(F.col("tilted") > 0, F.col("weight") * F.col("target") / F.col("tilted")).otherwise(F.lit(0.0))
    p, u = F.col("__copies") - F.col("__sure"), uniform(F.col("key"))
    odds = F.when(p > 0, u / (1 - u) * (1 - p) / p)
    return (
        rows.join(plan.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")), "left")
        .drop("__source")
        .withColumn("__copies", F.least(F.coalesce(ratio, F.lit(0.0)), F.lit(float(repeats))))
        .withColumn("__sure", F.floor("__copies"))
        .withColumn("__open", F.col("__sure") < repeats)
        .withColumn("__at", F.coalesce(odds / (1 + odds), F.lit(1.0)))
        .withColumn("__bin", F.least(F.floor(F.col("__at") * BINS), F.lit(BINS - 1)).cast("int"))
    )


def plan_mix(thin: DataFrame, weights: list[float], repeats: int = 3) -> DataFrame:
    """One row a source: total, tilted (the sum of weight times size), target, the rank (__cut, __key) up to which documents get one copy more, and the one document beyond it that
    does."""
    sums = thin.groupBy("source").agg(F.sum("size").alias("total"), F.sum(F.col("weight") * F.col("size")).alias("tilted"))
    goal = saved(targets(sums, weights, repeats), "targets")
    ranked = _ranked(thin, goal, repeats)
    bins = ranked.groupBy("source", "target", "__bin").agg(F.sum(F.when(F.col("__open"), F.col("size")).otherwise(0)).alias("words"), F.sum(F.col("__sure") * F.col("size")).alias("sure"))
    whole, upto = Window.partitionBy("source"), Window.partitionBy("source").orderBy("__bin")
    at = (
        bins.withColumn("rest", F.col("target") - F.sum("sure").over(whole))
        .withColumn("upto", F.sum("words").over(upto))
        .filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")) & (F.col("words") > 0))
        .groupBy("source")
        .agg(F.min_by(F.struct("__bin", (F.col("upto") - F.col("words")).alias("before"), "rest"), "__bin").alias("c"))
        .select(F.col("source").alias("__source"), F.col("c.__bin").alias("__cutbin"), "c.before", "c.rest")
    )
    at = saved(at, "bins")
    inside = ranked.filter("__open").join(at, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__bin") == F.col("__cutbin")))
    run = F.sum("size").over(Window.partitionBy("source").orderBy("__at", "key").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    last = (
        inside.withColumn("__run", F.col("before") + run)
        .filter(F.col("__run") <= F.col("rest"))
        .groupBy("source")
        .agg(F.max(F.struct("__at", "key")).alias("m"))
        .select(F.col("source").alias("__s"), F.col("m.__at").alias("__cut"), F.col("m.key").alias("__key"))
    )
    # a source without a bin to cut takes all open documents; one whose first document there overshoots takes those before
    cut = saved(
        goal.join(at.select("__source", "__cutbin"), F.col("source").eqNullSafe(F.col("__source")), "left")
        .join(last, F.col("source").eqNullSafe(F.col("__s")), "left")
        .select(
            "source", "total", "tilted", "target",
            F.when(F.col("__cut").isNotNull(), F.col("__cut")).when(F.col("__cutbin").isNotNull(), F.col("__cutbin") / F.lit(float(BINS))).otherwise(F.lit(2.0)).alias("__cut"),
            F.coalesce("__key", F.lit(-(2**63))).alias("__key"),
        ),
        "cuts",
    )
    # what is still missing goes to the one document after the cut that fits best
    after = _ranked(thin, cut, repeats).withColumn("__more", F.col("__open") & _within())
    gap = F.col("target") - F.col("filled")
    filled = after.groupBy("source").agg(F.sum((F.col("__sure") + F.col("__more").cast("int")) * F.col("size")).alias("filled"))
    spare = (
        after.filter("__open and not __more and size > 0")
        .join(filled.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")))
        .groupBy("source")
        .agg(F.min(F.when(F.abs(F.col("size") - gap) < gap, F.struct(F.abs(F.col("size") - gap).alias("d"), "__at", "key"))).alias("m"))
        .select(F.col("source").alias("__s"), F.col("m.__at").alias("__spare"), F.col("m.key").alias("__sparekey"))
    )
    return saved(cut.join(spare, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s"), "mix")


def _within() -> Column:
    return (F.col("__at") < F.col("__cut")) | ((F.col("__at") == F.col("__cut")) & (F.col("key") <= F.col("__key")))


def copies(rows: DataFrame, plan: DataFrame, repeats: int = 3) -> DataFrame:
    """``rows`` with ``source_size``, ``target`` and ``copies``, by a plan of the same rows."""
    more = _within() | F.coalesce((F.col("__at") == F.col("__spare")) & (F.col("key") == F.col("__sparekey")), F.lit(False))
    return (
        _ranked(rows, plan, repeats)
        .withColumn("copies", (F.col("__sure") + (F.col("__open") & more).cast("int")).cast("int"))
        .withColumnRenamed("total", "source_size")
        .drop("tilted", "__copies", "__sure", "__open", "__at", "__bin", "__cut", "__key", "__spare", "__sparekey")
    )


def sized(docs: DataFrame, weight: str | None = None, seed: int = 29) -> DataFrame:
    """``docs`` with ``size`` (words), ``key`` (the hash behind U) and ``weight`` (1 unless a column is named; null and
    negative weights count as 0)."""
    w = F.lit(1.0) if weight is None else F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    return docs.withColumns({"size": words_in(F.col("text")), "key": F.xxhash64(F.col("doc_id"), F.xxhash64("text"), F.lit(seed)), "weight": w})


def mix_sizes(docs: DataFrame, weights: list[float], repeats: int = 3, weight: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of ``docs``: how many of its words the mix takes.

    A null text has size 0; null sources are one source, ordered last. Rows that repeat a doc_id and its text share
    their rank and are taken alike. Sources without words have target 0. Other columns are not read; an empty table
    gives no rows."""
    thin = saved(sized(docs.select("doc_id", "text", "source", *([weight] if weight else [])), weight).select("doc_id", "source", "size", "key", "weight"), "sizes")
    out = copies(thin, plan_mix(thin, weights, repeats), repeats)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: list[float], repeats: int = 3, weight: str | None = None) -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as the mix takes it, with the columns of ``docs``."""
    names = docs.columns
    given = docs.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in names]).alias("__row"), "doc_id", "text", "source", *([weight] if weight else []))
    thin = saved(sized(given, weight).select("source", "size", "key", "weight"), "sizes")
    rows = copies(sized(given, weight).select("__row", "source", "size", "key", "weight"), plan_mix(thin, weights, repeats), repeats)
    return rows.filter("copies > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__row.*")
