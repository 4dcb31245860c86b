"""Connected components of an edge table, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved

#: Shares of all edges above which a node is a hub: 1 / HUBS.
HUBS = 1000


#: Edges up to which one task finds the components (16 bytes each): beyond, every step is a join. The result is the same.
SMALL = 1_000_000


def components(edges: DataFrame, rounds: int = 60, small: int = SMALL) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: longs); component is the smallest node reachable.

    A step pre-aggregates each node's smallest neighbour and joins it back; nothing gathers a node's neighbours, the
    edges of a hub aren't shuffled by it, and every step's edges are a table in the shared folder. It ends when the edges
    are stars around smallest nodes. Loops and repeated edges do no harm; no edges give no rows."""
    given = saved(edges.filter("u != v").select("u", "v"), "edges")
    if given.count() <= small:
        return given.repartition(1).mapInPandas(found_in, "node long, component long")
    now = saved(_pairs(given), "edges")
    dropped(given)
    for _ in range(rounds):
        if settled(now):
            break
        n = now.count()
        large = saved(_star(now, n, True), "edges")
        stars = saved(_star(large, n, False), "edges")
        dropped(now)
        dropped(large)
        now = stars
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def found_in(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The components of all edges that one task is given: greater roots are hooked to smaller ones, and labels follow."""
    frames = [(p.u.to_numpy(), p.v.to_numpy()) for p in parts]
    if not frames:
        return
    nodes, places = np.unique(np.concatenate([x for pair in zip(*frames) for x in pair]), return_inverse=True)
    a, b = places[: len(places) // 2], places[len(places) // 2 :]
    root = np.arange(len(nodes))
    while not np.array_equal(x := root[a], y := root[b]):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    yield pd.DataFrame({"node": nodes, "component": nodes[root]})


def settled(edges: DataFrame) -> bool:
    """Whether each greater node has one edge and is no one's smaller node: then the smaller nodes are the components."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(edges.select(F.col("v").alias("x"), F.lit(0).alias("up")))
    nodes = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return nodes.filter("ups > 1 or (ups = 1 and least = 0)").isEmpty()


def _pairs(edges: DataFrame) -> DataFrame:
    """Each edge once, from the greater node to the smaller one."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _star(edges: DataFrame, n: int, large: bool) -> DataFrame:
    """Large star: each node hands its smallest neighbour (itself included) to its greater neighbours. Small star: to
    its smaller neighbours and itself. Edges come as (greater, smaller); ``n`` is their number."""
    if large:
        ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("degree"))
        return _pairs(_handed(ends.filter("v > u"), least, n).filter("u != v"))
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    return _pairs(_handed(edges, least, n).unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v"))


def _handed(ends: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """(v, m) for each row (u, v), m being what ``least`` has for u. Nodes of a degree above n / ``HUBS`` are at most
    2 * ``HUBS``: they are broadcast, so that the edges of a hub stay where they lie."""
    hub = F.col("degree") > max(16, n // HUBS)
    hubs = F.broadcast(least.filter(hub).select("u", "m"))
    near, far = least.filter(~hub).select("u", "m"), ends.join(hubs.select("u"), "u", "left_anti")
    return ends.join(hubs, "u").unionByName(far.join(near, "u").select("u", "v", "m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
