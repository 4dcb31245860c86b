"""The corpus as DataFrames: files, lines and occurrences, from tables or from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, text

WALK_SKIP = r"(^|/)(\.git|target|node_modules|\.stratalex[^/]*)(/|$)"


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-16 by its mark, nothing for UTF-32 or for a zero byte in the first 8000, else UTF-8 with
    replacement of what is broken."""
    head = F.hex(F.substring(content, 1, 4))
    binary = F.position(F.lit(b"\0"), F.substring(content, 1, 8000)) > 0
    return (
        F.when(head.startswith("0000FEFF") | head.startswith("FFFE0000"), F.lit(None))
        .when(head.startswith("FFFE") | head.startswith("FEFF"), F.decode(content, "UTF-16"))
        .when(binary, F.lit(None))
        .otherwise(F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^\\uFEFF", ""))
    )


def with_paths(files: DataFrame) -> DataFrame:
    """File rows from (path, content)."""
    path = F.col("path")
    return files.select(
        "path",
        F.element_at(F.split(path, "/"), -1).alias("name"),
        text.extension(path).alias("extension"),
        F.octet_length("content").cast("bigint").alias("size"),
        text.depth(path).alias("depth"),
        "content",
    )


def from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return with_paths(docs.select(path.alias("path"), F.col("text").alias("content")))


def from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = F.concat(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "/+$", ""), F.lit("/"), F.col("page_id").cast("string"), F.lit(".html"))
    return with_paths(pages.select(path.alias("path"), F.col("html").alias("content")))


def from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    path = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit("."), F.col("role"))
    return with_paths(rows.select(path.alias("path"), F.col("text").alias("content")))


def from_directory(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Every text file below ``root``, read by Spark's executors; paths are relative to it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/").removeprefix("file:")
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), f"^\\Q{base}\\E/", "")
    rows = raw.select(path.alias("path"), decoded(F.col("content")).alias("content"))
    return with_paths(rows.filter(F.col("content").isNotNull() & ~F.col("path").rlike(WALK_SKIP)))


def lines(files: DataFrame) -> DataFrame:
    """(path, line, text), numbered from 1; the empty piece after a last line end is no line."""
    body = F.regexp_replace("content", "\\n\\z", "")
    return files.select("path", F.posexplode(F.split(body, "\n", -1)).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("line"), F.regexp_replace("text", "\\r$", "").alias("text"))


def occurrences(of_lines: DataFrame, role: Column | str = "text") -> DataFrame:
    """(name, path, line, pos, role) of every identifier."""
    kind = F.lit(role) if isinstance(role, str) else role
    return of_lines.select("path", "line", F.posexplode(text.tokens(F.col("text"))).alias("pos", "name"), kind.alias("role")).select("name", "path", "line", "pos", "role")


def stamped(files: DataFrame) -> DataFrame:
    """Files with their handle and revision."""
    return files.withColumns({"node_id": identity.path_handle(F.col("path")), "rev": identity.span_rev(F.col("content"))})


def directories(files: DataFrame) -> DataFrame:
    """Every ancestor directory with the size and number of the files below it, and the revision of its membership."""
    parts = F.split("path", "/")
    each = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    deep = files.filter(F.size(parts) > 1)
    return deep.select(each.alias("dir"), "path", "size").groupBy("dir").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("files"), identity.dir_rev(F.col("path")).alias("rev"))


def collapsed(files: DataFrame, depth: int) -> DataFrame:
    """Files no deeper than ``depth`` as they are; deeper ones summed up in their directory at that depth."""
    parts = F.split("path", "/")
    deep = F.size(parts) > depth
    at = F.when(deep, F.concat(F.array_join(F.slice(parts, 1, depth), "/"), F.lit("/"))).otherwise(F.col("path"))
    return files.groupBy(at.alias("path")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("count"))


def coverage(size: Column, bad: Column) -> Column:
    """The share of a file's bytes outside of errors, in whole percent; an empty file is covered."""
    return F.when(size == 0, 100).otherwise(F.floor(100 * F.greatest(F.lit(0), size - bad) / size))


def totals(files: DataFrame) -> DataFrame:
    """One row: files, bytes, lines and extensions of a corpus."""
    one = files.agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.countDistinct("extension").alias("extensions"))
    return one.crossJoin(F.broadcast(lines(files).agg(F.count(F.lit(1)).alias("lines")))).select("files", "bytes", "lines", "extensions")  # one row on either side


def safe_path(path: str) -> str:
    """A relative path that stays below its root, or an error."""
    from ..lang.statement import QueryError

    out: list[str] = []
    for part in path.split("/"):
        if part == "..":
            if not out:
                raise QueryError(f"{path!r} leaves the corpus")
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    if path.startswith("/") or not out:
        raise QueryError(f"{path!r} is not a path of the corpus")
    return "/".join(out)
