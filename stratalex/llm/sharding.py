"""Sharding: a uniform shuffle with exact shard sizes through a hypergeometric communication matrix.

Rows lie in blocks by a hash. How many rows of each block go to each part of each shard is drawn exactly: row after row
of a matrix with given margins, from the multivariate hypergeometric law. Within its block a row's place in a random
order then says where it goes; the rows are exchanged, and ordered at random once more within their part. Parts have
exact sizes too, so slots are known without counting anything after the exchange.

Only the matrix is made on the driver, from one count a block; rows see nothing but DataFrame functions.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stirling_rest(n: int) -> float:
    """log(n!) less Stirling's sqrt(2 pi n) (n / e)^n, without the cancellation of large numbers."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - math.log(2 * math.pi) / 2 if n else 0.0
    x = 1 / (n * n)
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - x / 1188) * x) * x) * x) / n


def deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, by a series where the two are close."""
    if abs(x - mean) < 0.1 * (x + mean):
        v = (x - mean) / (x + mean)
        total, term, j = (x - mean) * v, 2 * x * v, 1
        while True:
            term *= v * v
            more = total + term / (2 * j + 1)
            if more == total:
                return total
            total, j = more, j + 1
    return x * math.log(x / mean) + mean - x


def log_binomial(x: int, n: int, p: float) -> float:
    """The log of a binomial probability by its saddle point: as exact for 10^12 rows as for ten."""
    if x == 0 or x == n:
        return n * (math.log1p(-p) if x == 0 else math.log(p))
    q = 1 - p
    rest = stirling_rest(n) - stirling_rest(x) - stirling_rest(n - x) - deviance(x, n * p) - deviance(n - x, n * q)
    return rest + 0.5 * math.log(n / (2 * math.pi * x * (n - x)))


def hypergeometric(good: int, bad: int, drawn: int, r: random.Random) -> int:
    """How many of ``drawn`` rows are good ones: inversion outward from the mode, whose cost is a few standard
    deviations of the draw; sizes have no bound."""
    lo, hi = max(0, drawn - bad), min(drawn, good)
    if lo == hi:
        return lo
    mode = min(hi, max(lo, (drawn + 1) * (good + 1) // (good + bad + 2)))
    share = drawn / (good + bad)
    p = math.exp(log_binomial(mode, good, share) + log_binomial(drawn - mode, bad, share) - log_binomial(drawn, good + bad, share)) if share < 1 else 1.0
    u = r.random() - p
    a, pa, b, pb = mode, p, mode, p
    while u > 0:
        if a == lo and b == hi:
            return mode  # what rounding leaves over
        if b < hi:
            pb *= (good - b) * (drawn - b) / ((b + 1) * (bad - drawn + b + 1))
            b += 1
            u -= pb
            if u <= 0:
                return b
        if a > lo:
            pa *= a * (bad - drawn + a) / ((good - a + 1) * (drawn - a + 1))
            a -= 1
            u -= pa
            if u <= 0:
                return a
        if pa < 1e-18 and pb < 1e-18:
            return mode
    return mode


def communication(blocks: list[int], parts: list[int], r: random.Random) -> list[list[int]]:
    """A random matrix with row sums ``blocks`` and column sums ``parts``, as a uniform shuffle would give it."""
    left, out = list(parts), []
    for n in blocks:
        total, need, row = sum(left), n, []
        for c in left:
            x = hypergeometric(c, total - c, need, r)
            row.append(x)
            total -= c
            need -= x
        left = [c - x for c, x in zip(left, row)]
        out.append(row)
    return out


def placed(rows: DataFrame, key: str, order: Column, subs: int, to: str) -> DataFrame:
    """``rows`` with their places from 1 by the hash ``order`` within ``key``. The hash cuts each key into ``subs`` ranges,
    whose counts, added up, say where each begins: a task orders one range, not one key. Ties go by doc_id."""
    at = F.least(F.floor((order.cast("double") + F.lit(2.0**63)) / F.lit(2.0**64 / subs)), F.lit(subs - 1)).cast("int")
    cut = rows.withColumns({"__order": order, "__sub": at})
    inner = F.row_number().over(Window.partitionBy(key, "__sub").orderBy("__order", "doc_id"))
    ranked = cut.withColumn(to, inner.cast("long"))
    if subs > 1:
        upto = Window.partitionBy(key).orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
        starts = cut.groupBy(key, "__sub").agg(F.count(F.lit(1)).alias("__n")).select(key, "__sub", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__start"))
        ranked = ranked.join(starts, [key, "__sub"]).withColumn(to, F.col(to) + F.col("__start")).drop("__start")
    return ranked.drop("__order", "__sub")


def shuffled(docs: DataFrame, shards: int = 16, seed: int = 41, block_rows: int = 250_000, most: int = 256) -> DataFrame:
    """``docs`` with shard, slot, law, size, text_crc32 and grown_shard (columns of these names are replaced).

    The law is ``rows``: shard sizes differ by one at most, and every assignment of rows to slots is equally likely up to
    the hash; so equal texts are dealt independently, and no shard is grown. The matrix has at most ``most`` blocks and
    ``most`` parts (or one a shard, if there are more shards), so it is bounded; beyond that a block or part is ordered in
    ranges, so that a task orders about ``block_rows`` rows whatever the table's size. Nulls are hashed like values; rows
    that repeat all of doc_id and text are interchangeable; very long texts are only hashed. Empty tables give no rows."""
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    body = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    rows = docs.drop(*new).withColumns({"size": (F.octet_length(body) + 1).cast("long"), "text_crc32": F.crc32(body)})
    rows = rows.withColumn("__h", F.xxhash64("doc_id", "text_crc32", "size", F.lit(seed)))
    spark = docs.sparkSession
    block = F.pmod(F.shiftright("__h", 20), F.lit(most)).cast("int")
    counted = {x["b"]: x["n"] for x in rows.groupBy(block.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = [counted.get(b, 0) for b in range(most)]
    total = sum(sizes)
    fold = max(1, min(most, total // block_rows + 64))  # fewer, larger blocks where the table is small
    folded = [sum(sizes[b::fold]) for b in range(fold)]
    split = max(1, min(most // shards, -(-total // (shards * block_rows)) + 1))
    shard_ends = [(total * s) // shards for s in range(shards + 1)]
    # parts cut each shard's exact range of slots evenly
    parts, base = [], []
    for s in range(shards):
        a, b = shard_ends[s], shard_ends[s + 1]
        cuts = [a + (b - a) * j // split for j in range(split + 1)]
        parts += [y - x for x, y in zip(cuts, cuts[1:])]
        base += [x - a for x in cuts[:-1]]
    matrix = communication(folded, parts, random.Random(seed))
    plan = []
    for b, row in enumerate(matrix):
        run, by_shard, by_part = 0, [], []
        for s in range(shards):
            inner = []
            for x in row[s * split : (s + 1) * split]:
                run += x
                inner.append(run)
            by_shard.append(run)
            by_part.append(inner)
        plan.append({"b": b, "s": by_shard, "p": by_part})
    lookup = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(plan)), "array<struct<b:int,s:array<bigint>,p:array<array<bigint>>>>")))
    start = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([{"k": k, "base": x} for k, x in enumerate(base)])), "array<struct<k:int,base:bigint>>")))
    again = lambda k: F.xxhash64("__h", "doc_id", F.lit(seed + k))
    subs = lambda keys: max(1, -(-total // (keys * block_rows)))
    sent = (
        placed(rows.withColumn("__block", F.pmod(block, F.lit(fold))), "__block", again(1), subs(fold), "__place")
        .join(F.broadcast(lookup), F.col("__block") == F.col("b"))  # at most ``most`` rows of ``most`` numbers
        .withColumn("shard", F.size(F.filter("s", lambda x: x < F.col("__place"))))
        .withColumn("__part", F.size(F.filter(F.element_at("p", F.col("shard") + 1), lambda x: x < F.col("__place"))))
        .withColumn("__k", F.col("shard") * split + F.col("__part"))
        .drop("b", "s", "p", "__place", "__block", "__part")
    )
    return (
        placed(sent, "__k", again(2), subs(shards * split), "__slot")
        .join(F.broadcast(start), F.col("__k") == F.col("k"))
        .withColumns({"slot": (F.col("__slot") - 1 + F.col("base")).cast("long"), "law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})
        .drop("__h", "__k", "k", "base", "__slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 41) -> None:
    """The shards as folders ``shard=N`` of Parquet files whose rows lie in slot order."""
    shuffled(docs, shards, seed).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
