"""The folder that driver and executors share, tables written into it, and ranks that no single task makes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session may do without it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="stratalex-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def saved(df: DataFrame, tag: str, folder: str | None = None) -> DataFrame:
    """``df`` as a table written to the shared folder (or ``folder``) and read again: its lineage is cut, and a lost executor
    costs nothing that was written. The table goes when the application ends."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that ``saved`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/part-" not in name and name.startswith(("file:", "hdfs:", "s3", "/", "viewfs:")):
            where = jvm.org.apache.hadoop.fs.Path(name)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def bounded(df: DataFrame) -> DataFrame:
    """``df``, its session set to hand Python at most 1,000 rows and 4 MB at a time: texts may be long, and both
    sides hold a whole batch. Settings that ask for less are left alone."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 4 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(re.sub(r"\D", "", conf.get(key)) or 0) <= most:
            conf.set(key, str(most))
    return df


def numbered(df: DataFrame, order: list[Column], to: str) -> DataFrame:
    """``df`` with ranks from 1 by ``order`` in column ``to``: rows are dealt out by range, ranked within their range,
    and shifted by the counts of the ranges before (one number a partition reaches the driver)."""
    ranged = saved(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranked")
    shift, at = [], 0
    for r in sorted(ranged.groupBy("__range").count().collect(), key=lambda r: r["__range"]):
        shift += [F.lit(r["__range"]), F.lit(at)]
        at += r["count"]
    inner = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    offset = F.element_at(F.create_map(*shift), F.col("__range")) if shift else F.lit(0)
    return ranged.withColumn(to, (inner + offset).cast("long")).drop("__range")
