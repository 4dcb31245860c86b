"""Near-duplicates: fast similarity sketching, banding, and exact verification of shingle sets.

1. A text's words give a set of shingle hashes. Rounds of bin placement sketch it: in round i every element falls in
   one hashed bin with value i plus a hash, and a bin keeps its smallest value; after T such rounds round T + j puts
   every element in bin j, so every coordinate fills, while sets of some size fill all of them in a round or two with
   values that concentrate as those of independent permutations do. Two sets agree in a coordinate with probability
   of their similarity.
2. Texts of equal sets are one class, numbered in the order of its smallest row. Classes that share a band of coordinates
   are candidates; a bucket only emits edges to its smallest class, never its pairs, and the components of these edges
   are candidate groups.
3. The texts of each candidate group are read once more and compared exactly, by products of membership matrices. A large
   group is dealt by size (sets whose sizes differ too much cannot link) into small blocks, each compared with itself and
   with the smallest class of its sizes: as a rule that joins nearly all of the group. Only classes that are then not in
   the group's largest component are compared with the rest of it, block by block. A pair inside that component needs
   no comparison, and every other pair has gone through one, so no link between components is lost.
4. Links are emitted as spanning forests, so they grow with rows, not with pairs; their components are the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, mixed, numbered, released, saved
from .components import components


@dataclass(frozen=True)
class Near:
    """Shingles of ``words`` words; a link takes 100 * intersection >= ``percent`` * union. ``rows`` coordinates a band
    and ``bands`` bands let a pair at the threshold slip with probability (1 - (percent / 100)^rows)^bands: 2e-7 for the
    settings below, while of pairs of similarity 0.5 one in four (CONTRACT: one in fifteen) becomes a candidate. ``block``
    is the number of shingles that a block of a candidate group holds at about most, ``few`` the number of classes in the
    blocks that a large group is first dealt into, and a fourth of those that its rest is compared in."""

    words: int = 5
    percent: int = 80
    rows: int = 8
    bands: int = 84
    block: int = 1_000_000
    few: int = 256


CONTRACT = Near(words=3, percent=85, rows=10, bands=70)


class Shingler:
    """Shingle sets of lower-cased texts; words are hashed once and remembered."""

    def __init__(self, words: int):
        self.words = words
        self.memo = _Hashes()

    def set_of(self, text: bytes) -> np.ndarray:
        """Sorted distinct 64-bit hashes of a text's shingles: all words as one shingle where they are too few."""
        words = text.lower().split()
        if len(self.memo) > 300_000:
            self.memo.clear()
        h = np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))
        k = min(self.words, len(h))
        if not k:
            return h
        out = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            out = mixed(out * np.uint64(0x9FB21C651E98DF25) + h[j : len(h) - k + 1 + j])
        return np.unique(out + np.uint64(k))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def sketch(s: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates of a set of hashes by rounds of bin placement."""
    out = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    low = np.uint64((1 << 48) - 1)
    i, n = 0, len(s)
    while i < size:
        rounds = min(size - i, max(1, int(np.ceil(size * 1.2 * np.log(size) / n)) if i == 0 else 2 + i // 2))
        rounds = min(rounds, max(1, 200_000 // n))
        seed = mixed(np.arange(i + 1, i + rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        h = mixed(s[None, :] ^ seed[:, None])
        bins = ((h >> np.uint64(48)) * np.uint64(size)) >> np.uint64(16)
        np.minimum.at(out, bins.ravel().astype(np.int64), ((np.arange(i, i + rounds, dtype=np.uint64) << np.uint64(48))[:, None] | (h & low)).ravel())
        i += rounds
        if out.max() >> np.uint64(48) < size:
            return out
    for j in np.flatnonzero(out >> np.uint64(48) >= size):  # what T rounds left empty
        h = mixed(s ^ mixed(np.array([size + j + 1], np.uint64)))
        out[j] = (np.uint64(size + j) << np.uint64(48)) | (h & low).min()
    return out


def band_hashes(coordinates: np.ndarray, near: Near) -> np.ndarray:
    x = coordinates.reshape(near.bands, near.rows)
    h = np.arange(near.bands, dtype=np.uint64) + np.uint64(1)
    for j in range(near.rows):
        h = mixed(h * np.uint64(0xD6E8FEB86659FD93) + x[:, j])
    return h.view(np.int64)


def signatures(docs: DataFrame, near: Near) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key (128 bits of the whole set), bands; texts without words have no key."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, size = Shingler(near.words), near.rows * near.bands
        for p in parts:
            n, keys, bands = [], [], []
            for t in p.bytes:
                s = shingler.set_of(t)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(band_hashes(sketch(s, size), near) if len(s) else None)
            yield pd.DataFrame({"doc_id": p.doc_id, "text_hash": p.text_hash, "n_shingles": n, "set_key": keys, "bands": bands})
        del shingler
        released()

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bytes"))
    return lean(rows).mapInPandas(run, "doc_id long, text_hash long, n_shingles long, set_key binary, bands array<long>")


class Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def links_between(left: list[np.ndarray], right: list[np.ndarray], percent: int, same: bool) -> Iterator[tuple[int, int]]:
    """Index pairs (i, j) of a spanning forest of the links between the sets of two blocks (or of one, if ``same``)."""
    sets = left if same else [*left, *right]
    n, m = len(left), len(sets)
    if m == 2:
        a, b = sets
        both = len(np.intersect1d(a, b, assume_unique=True))
        if 100 * both >= percent * (len(a) + len(b) - both):
            yield 0, 1 if same else 0
        return
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], column[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    dense = np.cumsum(np.r_[False, column[1:] != column[:-1]]) if len(column) else column
    forest, off = Forest(m), 0 if same else n
    other = np.arange(off, m)
    for a in range(0, n, 512):  # rows of the left block at a time
        b = min(n, a + 512)
        inter = np.zeros((b - a, m - off), np.float32)
        width = max(1, 4_000_000 // m)
        at = 0
        while at < len(dense):
            to = np.searchsorted(dense, dense[at] + width)
            mine = np.zeros((m, int(dense[to - 1] - dense[at]) + 1), np.float32)
            mine[owner[at:to], dense[at:to] - dense[at]] = 1
            inter += mine[a:b] @ mine[off:].T
            at = to
        union = sizes[a:b, None] + sizes[off:][None, :] - inter
        hit = 100 * inter.astype(np.int64) >= percent * union.astype(np.int64)
        if same:
            hit &= other[None, :] > np.arange(a, b)[:, None]
        for i, j in zip(*np.nonzero(hit)):
            if forest.join(a + int(i), off + int(j)):
                yield a + int(i), int(j)


def verified(groups: DataFrame, near: Near) -> DataFrame:
    """Links (u, v) within groups of rows (grp, i, j, block, node, bytes), sorted by (grp, i, j)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(near.words)
        key: tuple | None = None
        held: list[tuple[int, int, np.ndarray]] = []
        found: list[tuple[int, int]] = []

        def close() -> None:
            if key is None or len(held) < 2:
                return
            left = [x for x in held if x[0] == key[1]]
            right = left if key[1] == key[2] else [x for x in held if x[0] == key[2]]
            if left and right:
                for i, j in links_between([x[2] for x in left], [x[2] for x in right], near.percent, left is right):
                    found.append((left[i][1], right[j][1]))

        for p in parts:
            for grp, i, j, block, node, text in zip(p.grp, p.i, p.j, p.block, p.node, p.bytes):
                if (grp, i, j) != key:
                    close()
                    key, held = (grp, i, j), []
                held.append((block, node, shingler.set_of(text)))
            if len(found) > 10_000:
                yield pd.DataFrame(found, columns=["u", "v"])
                found = []
        close()
        if found:
            yield pd.DataFrame(found, columns=["u", "v"])
        held = []
        del shingler
        released()

    return lean(groups).mapInPandas(run, "u long, v long")


def maybe_among(rows: DataFrame, wanted: DataFrame, keys: list[str], bits: int = 1 << 24) -> DataFrame:
    """``rows`` without most of those whose keys are not in ``wanted``, so that a join behind it shuffles little: a
    bitmap of hashed keys of ``bits`` bits at most (2 MB) is broadcast. It saves nothing once ``wanted`` fills it."""
    place = F.pmod(F.xxhash64(*keys), F.lit(bits))
    at = F.bitmap_bit_position(place)
    map_ = wanted.groupBy(F.bitmap_bucket_number(place).alias("__map")).agg(F.bitmap_construct_agg(at).alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, (at % 8).cast("int")) == 1
    return rows.join(F.broadcast(map_), F.bitmap_bucket_number(place) == F.col("__map")).filter(hit).drop("__map", "__bits")


#: Blocks of one size of a group.
DEAL = 1_000_000


def size_bin(near: Near) -> Column:
    """Sets whose bins differ by two or more differ too much in size to link."""
    step = -math.log(near.percent / 100) * (1 + 1e-9)
    return F.floor(F.log(F.col("n_shingles").cast("double")) / step).cast("long")


def dealt(members: DataFrame, near: Near, few: int) -> DataFrame:
    """``members`` with ``block``: those of one group and size in as many blocks as bounds ask for, ``few`` classes in each."""
    blocks = F.greatest(F.ceil(F.sum("n_shingles") / near.block), F.ceil(F.count(F.lit(1)) / few))
    counts = members.groupBy("grp", "bin").agg(F.least(blocks, F.lit(DEAL)).alias("blocks"), F.min("node").alias("pivot"))
    return members.join(counts, ["grp", "bin"]).withColumn("block", F.col("bin") * DEAL + F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")))


def grouped_within(members: DataFrame, texts: DataFrame, near: Near) -> DataFrame:
    """(node, component) of the linked ones of ``members`` (grp, node, doc_id, text_hash, n_shingles)."""
    place = ["grp", "i", "j", "block", "node", "doc_id", "text_hash"]
    check = lambda rows: saved(verified(_with_texts(rows.select(place), texts).repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j"), near), "links")
    sums = members.groupBy("grp").agg((F.sum("n_shingles") > near.block).alias("heavy"), (F.count(F.lit(1)) > near.few).alias("many"))
    known = members.join(sums, "grp").withColumn("large", F.col("heavy") | F.col("many")).withColumn("bin", F.when(F.col("large"), size_bin(near)).otherwise(0).cast("long"))
    known = saved(known, "members")
    small = known.filter("not large").withColumn("block", F.lit(0).cast("long"))
    together = lambda x: x.withColumns({"i": F.col("block"), "j": F.col("block")}).select(place)
    if known.filter("large").isEmpty():
        return components(check(together(small)))
    large = saved(dealt(known.filter("large"), near, near.few), "dealt")
    # the smallest class of a size stands in every block of that size
    first = large.filter("node = pivot and blocks > 1").withColumn("own", F.col("block"))
    first = first.withColumn("block", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.col("bin") * DEAL + k))).filter("block <> own")
    links = check(together(small).unionByName(together(large)).unionByName(together(first)))
    found = saved(components(links), "found")
    joined = large.select("grp", "bin", "node", "doc_id", "text_hash", "n_shingles").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    joined = saved(joined, "joined")
    main = joined.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("grp").agg(F.max(F.struct("n", "component")).alias("m"))
    left = saved(joined.join(main.select("grp", F.col("m.component").alias("main")), "grp").filter("component <> main").drop("component", "main"), "left")
    if left.isEmpty():
        return found
    # what is left, against all of its group: their blocks are numbered below zero
    all_ = dealt(joined.drop("component"), near, 4 * near.few)
    asked = dealt(left, near, 4 * near.few).withColumn("block", -1 - F.col("block"))
    beside = lambda rows: rows.select("grp", "block", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin")).distinct()
    right = all_.join(beside(asked).withColumnRenamed("block", "i"), ["grp", "bin"]).withColumn("j", F.col("block"))
    mine = asked.withColumn("i", F.col("block")).join(beside(all_).withColumnRenamed("block", "j"), ["grp", "bin"])
    return components(links.unionByName(check(mine.select(place).unionByName(right.select(place)))))


def _with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    wanted = rows.select("doc_id", "text_hash")
    # an inner join, as a semi-join would be pushed below the bitmap and shuffle every text
    one = maybe_among(texts, wanted, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    return rows.join(one, ["doc_id", "text_hash"]).select("grp", "i", "j", "block", "node", "bytes")


def near_duplicates(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), n_shingles, component_id, kept, first for each row of ``docs``.

    A row's component_id is the smallest doc_id of the rows reachable by links, its own included; ``kept`` marks the rows
    whose doc_id that is. ``first`` marks the rows of one text of each component: of the smallest doc_id, and of the smallest
    hash among its texts. Links are between texts: rows that share a doc_id, but not the text, are judged apart. Null texts
    and texts without words have no shingles and no links. Rows with a null doc_id link nothing: their component_id is
    null and they are kept. Very long texts are read whole, a text at a time. Other columns are not read; an empty table gives
    no rows."""
    sig = saved(signatures(docs, near), "signatures")
    live = sig.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    rep = live.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep")).select("set_key", "rep.doc_id", "rep.text_hash")
    classes = numbered(rep, [F.col("doc_id").asc(), F.col("text_hash").asc()], "node")
    classes = saved(classes, "classes")
    reps = live.drop("set_key").join(classes.select("doc_id", "text_hash", "node"), ["doc_id", "text_hash"])
    bucketed = reps.select(F.explode("bands").alias("bucket"), "node")
    shared = bucketed.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least != most").select("bucket", "least")
    candidates = components(bucketed.join(shared, "bucket").filter("node != least").select(F.col("node").alias("u"), F.col("least").alias("v")))
    thin = reps.select("node", "doc_id", "text_hash", "n_shingles").dropDuplicates(["node"])
    members = saved(candidates.join(thin, "node").withColumnRenamed("component", "grp"), "members")
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("bytes"))
    grouped = grouped_within(members, texts, near)
    heads = classes.select(F.col("node").alias("head"), F.col("doc_id").alias("component_id"), F.col("text_hash").alias("head_hash"))
    rest = classes.select("set_key", "node").join(grouped, "node", "left").select("set_key", F.coalesce("component", "node").alias("head")).join(heads, "head")
    least = F.coalesce("component_id", "doc_id")
    return (
        sig.select("doc_id", "text_hash", "n_shingles", "set_key")
        .join(rest, "set_key", "left")
        .select(
            "doc_id",
            "text_hash",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), least).alias("component_id"),
            F.coalesce(F.col("doc_id") == least, F.lit(True)).alias("kept"),
            F.coalesce((F.col("doc_id") == least) & (F.col("text_hash") == F.coalesce("head_hash", "text_hash")), F.lit(True)).alias("first"),
        )
    )
