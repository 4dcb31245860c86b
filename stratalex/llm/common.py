"""What the operators of this package share: samples, hashes, counts of words; and, from the library, saved tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import bounded as lean
from ..store import dropped, numbered, saved, shared_dir

__all__ = ["dropped", "held_out", "labelled_sample", "lean", "mixed", "numbered", "released", "saved", "shared_dir", "table", "words_in"]

#: The bytes that separate words: space and 0x09 to 0x0D, exactly what ``bytes.split()`` splits on.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most ``rows`` (doc_id, label) pairs outside the held-out fold, chosen by a hash of the id: the documented
    bound of what a classifier is fitted on. Null ids and labels other than 0 and 1 are left out."""
    return (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64(F.col("doc_id"), F.lit(17)), "doc_id")
        .limit(rows)
    )


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer of 64-bit hashes (the constants are those of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_in(text: Column) -> Column:
    """The number of words of a text, 0 for null: each word becomes one character and what separates words goes, which
    leaves far less garbage than a list of the words."""
    marks = F.translate(F.regexp_replace(text, WORD, "x"), " \t\n\x0b\f\r", "")
    return F.coalesce(F.length(marks).cast("long"), F.lit(0).cast("long"))


def released() -> None:
    """Gives memory that a finished task has freed back to the system, as Python workers live on between tasks."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
