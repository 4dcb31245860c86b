"""The registered queries of the engine, each with SQL that says the same over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import identity, text
from .lang.parser import parse
from .operators import edits, relations, render
from .plans import clauses as C
from .plans.shapes import SHAPES, Shape, shape_of
from .sources import corpus, index

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

FILES = """files AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, doc_id || '.txt' AS name, 'txt' AS extension,
  CAST(strlen(text) AS BIGINT) AS size, CAST(3 AS INTEGER) AS depth, text AS content FROM documents)"""
LINES = FILES + """, lines AS (SELECT path, CAST(unnest(range(1, len(parts) + 1)) AS INTEGER) AS line, regexp_replace(unnest(parts), '\\r$', '') AS text
  FROM (SELECT path, string_split(regexp_replace(content, '\\n\\z', ''), chr(10)) AS parts FROM files))"""
SITES = LINES + """, found AS (SELECT path, line, list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: length(x) > 1) AS names FROM lines),
 sites AS (SELECT path, line, unnest(names) AS name, CAST(unnest(range(0, len(names))) AS INTEGER) AS pos FROM found)"""


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        _SQL[name] = sql
        return f

    return add


def asked(df: DataFrame, statement: str, shape: Shape, **how) -> DataFrame:
    """``df`` under the clauses of a statement, checked first."""
    c = parse(statement).clauses
    C.refused(c, shape)
    return C.applied(df, c, shape, **how)


def _table(name: str) -> Query:
    return lambda spark, d: spark.read.parquet(f"{d}/{name}.parquet")


files, lines = corpus.from_documents, lambda s, d: corpus.lines(corpus.from_documents(s, d))
sites = lambda s, d: corpus.occurrences(lines(s, d), "doc")
part, orders, nation, lineitem, customer, events = map(_table, ("part", "orders", "nation", "lineitem", "customer", "events"))


# --- files and the clause pipeline ---------------------------------------------------------------------------------


@query("find_files", f"WITH {FILES} SELECT path, size FROM files WHERE extension = 'txt' AND size > 1000 AND regexp_matches(path, '^src[^/]*/en/') ORDER BY size DESC, name, path LIMIT 10")
def find_files(spark: SparkSession, d: str) -> DataFrame:
    return asked(files(spark, d), "FIND files WHERE extension = 'txt' WHERE size > 1000 IN 'src*/en/**' ORDER BY size DESC LIMIT 10", SHAPES["file"]).select("path", "size")


@query("find_files_grouped", f"WITH {FILES} SELECT extension, count(*) AS count FROM files WHERE size > 1000 GROUP BY extension HAVING count(*) >= 2")
def find_files_grouped(spark: SparkSession, d: str) -> DataFrame:
    c = parse("FIND files WHERE size > 1000 GROUP BY extension HAVING count >= 2 ORDER BY count DESC").clauses
    return C.having(C.counted(C.filtered(files(spark, d), c, SHAPES["file"]), "extension", SHAPES["file"]), c, SHAPES["file"])


@query("files_default_page", f"WITH {FILES} SELECT path, name, size FROM files ORDER BY name, path LIMIT 20")
def files_default_page(spark: SparkSession, d: str) -> DataFrame:
    return asked(files(spark, d), "FIND files", SHAPES["file"], default=20).select("path", "name", "size")


@query("pages_as_files", """SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/+$', '') || '/' || page_id || '.html' AS path, CAST(strlen(html) AS BIGINT) AS size, 'html' AS extension FROM pages WHERE strlen(html) > 2000""")
def pages_as_files(spark: SparkSession, d: str) -> DataFrame:
    return asked(corpus.from_pages(spark, d), "FIND files WHERE ext = html WHERE size > 2000", SHAPES["file"]).select("path", "size", "extension")


@query("conversations_as_files", "SELECT conv_id || '/' || turn || '.' || role AS path, role AS extension, CAST(strlen(text) AS BIGINT) AS size FROM conversations WHERE role LIKE 'as%'")
def conversations_as_files(spark: SparkSession, d: str) -> DataFrame:
    return asked(corpus.from_conversations(spark, d), "FIND files WHERE extension LIKE 'AS%'", SHAPES["file"]).select("path", "extension", "size")


def _rows(name: str, statement: str, table: Query, columns: list[str], sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = table(spark, d)
        return asked(df, statement, shape_of(df)).select(*columns)

    run.__name__ = name
    query(name, sql)(run)


_P = ["p_partkey", "p_name"]
_rows("where_eq_string", "FIND files WHERE p_brand = 'Brand#11'", part, _P, "SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#11'")
_rows("where_ne_string", "FIND files WHERE p_brand != 'Brand#11'", part, _P, "SELECT p_partkey, p_name FROM part WHERE p_brand <> 'Brand#11'")
_rows("where_eq_number", "FIND files WHERE p_size = 15", part, _P, "SELECT p_partkey, p_name FROM part WHERE p_size = 15")
_rows("where_numeric_range", "FIND files WHERE p_size >= 10 AND p_size < 20", part, [*_P, "p_size"], "SELECT p_partkey, p_name, p_size FROM part WHERE p_size >= 10 AND p_size < 20")
_rows("where_text_as_number", "FIND files WHERE size_text > 30", lambda s, d: part(s, d).withColumn("size_text", F.col("p_size").cast("string")), _P,
      "SELECT p_partkey, p_name FROM part WHERE try_cast(CAST(p_size AS VARCHAR) AS BIGINT) > 30")
_rows("where_like_ascii_ci", "FIND files WHERE p_type LIKE '%oMY_' WHERE p_name LIKE '%A%'", lambda s, d: part(s, d).withColumn("p_type", F.concat("p_type", F.lit("x"))), _P,
      "SELECT p_partkey, p_name FROM part WHERE lower(p_type || 'x') LIKE '%omy_' AND lower(p_name) LIKE '%a%'")
_rows("where_not_like", "FIND files WHERE p_type NOT LIKE '%steel%'", part, _P, "SELECT p_partkey, p_name FROM part WHERE lower(p_type) NOT LIKE '%steel%'")
_rows("where_matches", "FIND files WHERE p_name MATCHES 'o.*[gt]$'", part, _P, "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'o.*[gt]$')")
_rows("where_not_matches", "FIND files WHERE p_name NOT MATCHES '^[a-m].*t'", part, _P, "SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(p_name, '^[a-m].*t')")
_rows("where_bool_never", "FIND files WHERE o_orderstatus != true", orders, ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE false")
_rows("where_alias", "FIND files WHERE path = 'f'", lambda s, d: orders(s, d).withColumn("path", F.lower("o_orderstatus")), ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE lower(o_orderstatus) = 'f'")
_rows("order_topk_tiebreak", "FIND files ORDER BY p_size DESC LIMIT 25", lambda s, d: part(s, d).withColumnRenamed("p_name", "name").withColumn("path", F.col("p_partkey").cast("string")),
      ["p_partkey", "name", "p_size"], "SELECT p_partkey, p_name AS name, p_size FROM part ORDER BY p_size DESC, p_name, CAST(p_partkey AS VARCHAR) LIMIT 25")
_rows("order_default_desc", "FIND files ORDER BY o_custkey LIMIT 30", lambda s, d: orders(s, d).withColumn("line", F.col("o_orderkey")), ["o_orderkey", "o_custkey"],
      "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 30")
_rows("order_string_asc", "FIND files ORDER BY c_name ASC LIMIT 15", customer, ["c_custkey", "c_name"], "SELECT c_custkey, c_name FROM customer ORDER BY c_name LIMIT 15")
_rows("offset_limit", "FIND files ORDER BY o_orderkey ASC OFFSET 40 LIMIT 20", orders, ["o_orderkey"], "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
_rows("default_order_ties", "FIND files LIMIT 12", lambda s, d: customer(s, d).withColumnRenamed("c_mktsegment", "name").withColumn("line", F.col("c_custkey")), ["c_custkey", "name"],
      "SELECT c_custkey, c_mktsegment AS name FROM customer ORDER BY c_mktsegment, c_custkey LIMIT 12")


@query("where_missing_field", "SELECT doc_id, CAST(1 AS INTEGER) AS how FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND quality <> 0 UNION ALL SELECT doc_id, 2 FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR NOT regexp_matches(CAST(quality AS VARCHAR), '0') UNION ALL SELECT doc_id, 3 FROM documents JOIN labels USING (doc_id) WHERE NOT regexp_matches(CAST(quality AS VARCHAR), '0')")
def where_missing_field(spark: SparkSession, d: str) -> DataFrame:
    """A missing field fails ``!=``; NOT MATCHES keeps it in WHERE and drops it in HAVING."""
    docs = _table("documents")(spark, d).join(_table("labels")(spark, d), "doc_id", "left").select("doc_id", "quality")
    shape = shape_of(docs)
    ask = lambda said: C.having(C.filtered(docs, parse(said).clauses, shape), parse(said).clauses, shape)
    out = [ask(f"FIND files {q}").select("doc_id", F.lit(i).alias("how")) for i, q in ((1, "WHERE quality != 0"), (2, "WHERE quality NOT MATCHES '0'"), (3, "HAVING quality NOT MATCHES '0'"))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("where_dot_brace_len", "SELECT doc_id FROM documents WHERE strlen(text) >= 3000")
def where_dot_brace_len(spark: SparkSession, d: str) -> DataFrame:
    docs = _table("documents")(spark, d)
    return asked(docs, "FIND files WHERE text MATCHES '.{3000,}'", shape_of(docs)).select("doc_id")


@query("where_set_membership", "SELECT conv_id, roles FROM (SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM conversations GROUP BY 1) WHERE regexp_matches(roles, '(^|,)system(,|$)')")
def where_set_membership(spark: SparkSession, d: str) -> DataFrame:
    sets = _table("conversations")(spark, d).groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))
    return asked(sets, "FIND files WHERE roles MATCHES '(^|,)system(,|$)'", shape_of(sets))


@query("in_glob", f"WITH {FILES} SELECT path FROM files WHERE regexp_matches(path, '^src1[^/]?/(?:[^/]+/)*[^/]*5\\.txt$')")
def in_glob(spark: SparkSession, d: str) -> DataFrame:
    return asked(files(spark, d), "FIND files IN 'src1*/**/*5.txt'", SHAPES["file"]).select("path")


@query("exclude_globs", f"WITH {FILES} SELECT path FROM files WHERE NOT regexp_matches(path, '^src0/') AND NOT regexp_matches(path, '^[^/]+/de/[^/]+$')")
def exclude_globs(spark: SparkSession, d: str) -> DataFrame:
    return asked(files(spark, d), "FIND files EXCLUDE src0 EXCLUDE '*/de/*.txt'", SHAPES["file"]).select("path")


@query("in_dir_expansion", f"WITH {FILES} SELECT path, size FROM files WHERE starts_with(path, 'src3/en/')")
def in_dir_expansion(spark: SparkSession, d: str) -> DataFrame:
    return asked(files(spark, d), "FIND files IN 'src9' IN 'src3/en/'", SHAPES["file"]).select("path", "size")


# --- grouping, counting, paging ------------------------------------------------------------------------------------


@query("group_count", "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1")
def group_count(spark: SparkSession, d: str) -> DataFrame:
    df = orders(spark, d)
    return C.counted(df, "o_orderpriority", shape_of(df))


@query("group_having", "SELECT o_custkey, count(*) AS count FROM orders GROUP BY 1 HAVING count(*) >= 15")
def group_having(spark: SparkSession, d: str) -> DataFrame:
    df = orders(spark, d)
    c = parse("FIND files GROUP BY o_custkey HAVING count >= 15").clauses
    return C.having(C.counted(df, "o_custkey", shape_of(df)).withColumn("o_custkey", F.col("o_custkey").cast("bigint")), c, shape_of(df))


@query("group_first_row", "SELECT o_orderpriority, o_orderkey, count FROM (SELECT *, count(*) OVER (PARTITION BY o_orderpriority) AS count, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1")
def group_first_row(spark: SparkSession, d: str) -> DataFrame:
    return asked(orders(spark, d), "FIND files GROUP BY o_orderpriority ORDER BY count DESC", shape_of(orders(spark, d)), storage_order=["o_orderkey"]).select("o_orderpriority", "o_orderkey", "count")


@query("group_missing_key", "SELECT coalesce(CAST(quality AS VARCHAR), '') AS quality, count(*) AS count FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def group_missing_key(spark: SparkSession, d: str) -> DataFrame:
    df = _table("documents")(spark, d).join(_table("labels")(spark, d), "doc_id", "left")
    return C.counted(df, "quality", shape_of(df))


@query("total_before_page", "SELECT p_partkey, total FROM (SELECT p_partkey, p_size, count(*) OVER () AS total FROM part WHERE p_size > 20) ORDER BY p_size DESC, p_partkey LIMIT 10")
def total_before_page(spark: SparkSession, d: str) -> DataFrame:
    df = part(spark, d).withColumn("line", F.col("p_partkey"))
    return asked(df, "FIND files WHERE p_size > 20 ORDER BY p_size DESC LIMIT 10", shape_of(df), total=True).select("p_partkey", "total")


@query("dedupe_identity", "SELECT p_brand, p_type, p_size, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type, p_size ORDER BY p_partkey) = 1")
def dedupe_identity(spark: SparkSession, d: str) -> DataFrame:
    return relations.deduplicated(part(spark, d), ["p_brand", "p_type", "p_size"], [F.asc("p_partkey")]).select("p_brand", "p_type", "p_size", "p_partkey")


@query("distinct_rows_per_file", f"WITH {SITES} SELECT path, count(DISTINCT (name, line)) AS distinct_rows FROM sites GROUP BY path")
def distinct_rows_per_file(spark: SparkSession, d: str) -> DataFrame:
    """A path that is one file counts its lines' names where they are read; only files that share a path are compared."""
    every = files(spark, d).select("path", "content")
    shared = every.groupBy("path").agg(F.count(F.lit(1)).alias("__files")).filter("__files > 1").select("path")

    def alone(some: DataFrame) -> DataFrame:
        names = F.size(F.array_distinct(text.tokens(F.col("text"))))
        return corpus.lines(some).select("path", names.alias("__names")).filter("__names > 0").groupBy("path").agg(F.sum("__names").alias("distinct_rows"))

    if shared.isEmpty():  # reads no text
        return alone(every)
    rest = relations.distinct_counts(corpus.occurrences(corpus.lines(every.join(shared, "path", "left_semi")), "doc"), "path", ["name", "line"], "distinct_rows")
    return alone(every.join(shared, "path", "left_anti")).unionByName(rest)


@query("corpus_stats", f"WITH {LINES} SELECT (SELECT count(*) FROM files) AS files, (SELECT CAST(sum(size) AS BIGINT) FROM files) AS bytes, (SELECT count(*) FROM lines) AS lines, (SELECT count(DISTINCT extension) FROM files) AS extensions")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return corpus.totals(files(spark, d))


@query("enclosing_maxima", "SELECT l_orderkey, CAST(max(l_quantity) AS DOUBLE) AS most, count(*) AS branches FROM lineitem GROUP BY 1")
def enclosing_maxima(spark: SparkSession, d: str) -> DataFrame:
    return relations.maxima(lineitem(spark, d), "l_orderkey", "l_quantity", "most", "branches")


@query("parse_coverage", "SELECT page_id, CASE WHEN strlen(html) = 0 THEN 100 ELSE CAST(100 * (strlen(html) - bad) // strlen(html) AS BIGINT) END AS parse_coverage FROM (SELECT page_id, html, coalesce(list_sum(list_transform(regexp_extract_all(html, '<br>|<p>'), lambda x: strlen(x))), 0) AS bad FROM pages)")
def parse_coverage(spark: SparkSession, d: str) -> DataFrame:
    pages = _table("pages")(spark, d)
    bad = F.aggregate(F.regexp_extract_all("html", F.lit("<br>|<p>"), 0), F.lit(0), lambda a, x: a + F.octet_length(x))
    return pages.select("page_id", corpus.coverage(F.octet_length("html"), bad).cast("bigint").alias("parse_coverage"))


# --- occurrence search ---------------------------------------------------------------------------------------------


@query("usages_word_match", f"WITH {LINES} SELECT path, line, text FROM lines WHERE regexp_matches(text, '(^|[^\\pL\\pN_])the($|[^\\pL\\pN_])')")
def usages_word_match(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).filter(text.word_match(F.col("text"), "the")).select("path", "line", "text")


@query("usages_substring", f"WITH {LINES} SELECT path, line FROM lines WHERE contains(text, 'token = \"')")
def usages_substring(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).filter(F.contains("text", F.lit('token = "'))).select("path", "line")


@query("usage_counts", f"WITH {SITES} SELECT name, count(*) AS usages FROM sites GROUP BY name HAVING count(*) >= 20")
def usage_counts(spark: SparkSession, d: str) -> DataFrame:
    return relations.usage_counts(sites(spark, d), None).filter("usages >= 20")


@query("usages_by_role", "SELECT role, name, count(*) AS usages FROM (SELECT CASE WHEN role = 'user' THEN 'doc' ELSE 'text' END AS role, unnest(list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: length(x) > 1)) AS name FROM conversations) GROUP BY 1, 2")
def usages_by_role(spark: SparkSession, d: str) -> DataFrame:
    found = corpus.lines(corpus.from_conversations(spark, d))
    role = F.when(F.col("path").endswith(".user"), "doc").otherwise("text")
    return corpus.occurrences(found, role).groupBy("role", "name").agg(F.count(F.lit(1)).alias("usages"))


@query("usages_file_groups", f"WITH {LINES}, hit AS (SELECT path, line FROM lines WHERE regexp_matches(text, '(^|[^\\pL\\pN_])of($|[^\\pL\\pN_])')), ranked AS (SELECT *, dense_rank() OVER (ORDER BY path) AS r FROM hit) SELECT path, line FROM ranked WHERE r > 2 AND r <= 12")
def usages_file_groups(spark: SparkSession, d: str) -> DataFrame:
    hit = lines(spark, d).filter(text.word_match(F.col("text"), "of")).select("path", "line")
    return C.file_pages(hit, limit=10, offset=2, ceiling=10**9)


@query("usages_site_ceiling", f"WITH {SITES}, hit AS (SELECT path, line, pos FROM sites WHERE name = 'the'), per AS (SELECT path, count(*) AS n FROM hit GROUP BY path), run AS (SELECT path, sum(n) OVER (ORDER BY path) AS s, row_number() OVER (ORDER BY path) AS r FROM per) SELECT path, line, pos FROM hit WHERE path IN (SELECT path FROM run WHERE s <= 300 OR r = 1)")
def usages_site_ceiling(spark: SparkSession, d: str) -> DataFrame:
    return C.file_pages(sites(spark, d).filter("name = 'the'").select("path", "line", "pos"), limit=None, ceiling=300)


@query("zero_hit_hint", f"WITH {SITES} SELECT n.n_name AS name, coalesce(u.usages, 0) AS usages FROM nation n LEFT JOIN (SELECT upper(name) AS name, count(*) AS usages FROM sites GROUP BY 1) u ON u.name = n.n_name")
def zero_hit_hint(spark: SparkSession, d: str) -> DataFrame:
    counts = relations.usage_counts(sites(spark, d).withColumn("name", F.upper("name")), None)
    return relations.with_usages(nation(spark, d).select(F.col("n_name").alias("name")), counts)


@query("token_extract", f"WITH {SITES} SELECT path, count(*) AS tokens FROM sites GROUP BY path")
def token_extract(spark: SparkSession, d: str) -> DataFrame:
    return sites(spark, d).groupBy("path").agg(F.count(F.lit(1)).alias("tokens"))


@query("token_line_positions", f"WITH {SITES} SELECT name, path, line, pos FROM sites")
def token_line_positions(spark: SparkSession, d: str) -> DataFrame:
    return sites(spark, d).select("name", "path", "line", "pos")


# --- implicit joins ------------------------------------------------------------------------------------------------


@query("usage_counts_join", "SELECT c_custkey, c_name, coalesce(u.usages, 0) AS usages FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS usages FROM orders GROUP BY 1) u ON c_custkey = o_custkey")
def usage_counts_join(spark: SparkSession, d: str) -> DataFrame:
    counts = relations.usage_counts(orders(spark, d).select(F.col("o_custkey").alias("name")), None)
    return relations.with_usages(customer(spark, d).withColumn("name", F.col("c_custkey")), counts).select("c_custkey", "c_name", "usages")


@query("overlay_shadow_union", "SELECT doc_id, text FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id) UNION ALL SELECT doc_id, 'dirty' FROM labels")
def overlay_shadow_union(spark: SparkSession, d: str) -> DataFrame:
    newer = _table("labels")(spark, d).select("doc_id", F.lit("dirty").alias("text"))
    return relations.shadowed(_table("documents")(spark, d).select("doc_id", "text"), newer, "doc_id")


@query("usage_counts_overlay", "SELECT name, count(*) AS usages FROM (SELECT o_orderpriority AS name, o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT 'dirty', o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def usage_counts_overlay(spark: SparkSession, d: str) -> DataFrame:
    base = orders(spark, d).select(F.col("o_orderkey").alias("path"), F.col("o_orderpriority").alias("name"))
    newer = orders(spark, d).filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("path"), F.lit("dirty").alias("name"))
    return relations.usage_counts(relations.shadowed(base, newer), None)


_EVENTS = "e AS (SELECT event_id, user_id, event_type, epoch_us(ts) * 1000 + event_id % 1000 AS moment, epoch_us(ts) + 60000000 AS finish, epoch_us(ts) + 3600000000 AS reach FROM events)"


@query("enclosing_interval", f"WITH {_EVENTS}, w AS (SELECT *, last_value(CASE WHEN event_type = 'signup' OR event_type = 'view' THEN event_id END IGNORE NULLS) OVER v AS fn, last_value(CASE WHEN event_type = 'signup' OR event_type = 'view' THEN reach END IGNORE NULLS) OVER v AS fn_end FROM e WINDOW v AS (PARTITION BY user_id ORDER BY moment ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT event_id, CASE WHEN finish <= fn_end THEN fn END AS enclosing FROM w")
def enclosing_interval(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_micros(F.to_timestamp_ltz("ts")) * 1000 + F.col("event_id") % 1000
    e = events(spark, d).select("event_id", "user_id", "event_type", at.alias("at"), (F.unix_micros(F.to_timestamp_ltz("ts")) + 60_000_000).alias("finish"), (F.unix_micros(F.to_timestamp_ltz("ts")) + 3_600_000_000).alias("reach"))
    spans = e.filter(F.col("event_type").isin("signup", "view")).select("user_id", "event_id", "at", "reach")
    return relations.enclosing(e.select("event_id", "user_id", "at", "finish"), spans, ["user_id"], "at", "finish", "at", "reach", "event_id").select("event_id", "enclosing")


@query("duplicate_in_group", "SELECT l_orderkey, l_linenumber, l_suppkey, copies FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_suppkey) AS copies FROM lineitem) WHERE copies >= 2")
def duplicate_in_group(spark: SparkSession, d: str) -> DataFrame:
    return relations.duplicates_in(lineitem(spark, d), ["l_orderkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_suppkey", "copies")


@query("innermost_span", """WITH f AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents), spans AS (SELECT doc_id, 1 AS start, n AS finish, 0 AS id FROM f UNION ALL SELECT doc_id, 2, n // 2 + 1, 1 FROM f UNION ALL SELECT doc_id, 3, 5, 2 FROM f), points AS (SELECT doc_id, unnest(range(1, n + 1)) AS line FROM f)
SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(arg_min(id, (finish - start) * 10 + id) AS INTEGER) AS innermost FROM points JOIN spans USING (doc_id) WHERE line BETWEEN start AND finish GROUP BY 1, 2""")
def innermost_span(spark: SparkSession, d: str) -> DataFrame:
    f = _table("documents")(spark, d).select("doc_id", F.size(F.split("text", "\n")).alias("n"))
    span = lambda a, b, i: F.struct(F.lit(a).alias("start"), b.cast("int").alias("finish"), F.lit(i).alias("id"))
    spans = f.select("doc_id", F.inline(F.array(span(1, F.col("n"), 0), span(2, F.floor(F.col("n") / 2) + 1, 1), span(3, F.lit(5), 2)))).filter("start <= finish")
    points = f.select("doc_id", F.explode(F.sequence(F.lit(1), "n")).alias("line"))
    return relations.innermost(points, spans, ["doc_id"], "line", "start", "finish", "id", 256)


@query("file_error_left_join", "SELECT c_custkey, coalesce(e.n, 0) AS error_count, coalesce(e.s, 0) AS error_bytes FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_orderkey) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) e ON o_custkey = c_custkey")
def file_error_left_join(spark: SparkSession, d: str) -> DataFrame:
    errors = orders(spark, d).withColumnRenamed("o_custkey", "c_custkey")
    return relations.with_errors(customer(spark, d), errors, "c_custkey", F.col("o_orderstatus") == "F", F.col("o_orderkey")).select("c_custkey", "error_count", "error_bytes")


@query("usage_file_stamp", f"WITH {LINES} SELECT l.path, l.line, 'n' || substr(sha256(l.path), 1, 12) AS node_id FROM lines l JOIN files f ON f.path = l.path WHERE contains(l.text, 'tion')")
def usage_file_stamp(spark: SparkSession, d: str) -> DataFrame:
    hit = lines(spark, d).filter(F.contains("text", F.lit("tion"))).select("path", "line")
    return hit.join(files(spark, d).select("path", identity.path_handle(F.col("path")).alias("node_id")), "path")


@query("macro_match", "WITH calls AS (SELECT l_orderkey * 10 + l_linenumber AS call_id, l_suppkey AS name, l_linenumber % 3 AS args FROM lineitem), defs AS (SELECT s_suppkey AS name, CASE WHEN s_nationkey % 4 = 3 THEN NULL ELSE s_nationkey % 4 END AS arity, s_suppkey AS def_pos FROM supplier) SELECT call_id, calls.name, def_pos FROM calls JOIN defs ON calls.name = defs.name AND (arity = args OR (args = 0 AND arity IS NULL)) QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY arity IS NULL, def_pos) = 1")
def macro_match(spark: SparkSession, d: str) -> DataFrame:
    calls = lineitem(spark, d).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_id"), F.col("l_suppkey").alias("name"), (F.col("l_linenumber") % 3).alias("args"))
    key = F.col("s_nationkey") % 4
    defs = _table("supplier")(spark, d).select(F.col("s_suppkey").alias("name"), F.when(key != 3, key).alias("arity"), F.col("s_suppkey").alias("def_pos"))
    return relations.macro_matches(calls, defs).select("call_id", "name", "def_pos")


@query("best_candidate_resolve", "SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_mktsegment = 'BUILDING') DESC, c_name DESC, c_custkey DESC) = 1")
def best_candidate_resolve(spark: SparkSession, d: str) -> DataFrame:
    rows = customer(spark, d).select("c_nationkey", "c_custkey", F.col("c_mktsegment").alias("fql_kind"), F.col("c_name").alias("path"), F.col("c_custkey").alias("line"))
    return relations.best_candidate(rows, "c_nationkey", relations.resolve_order("BUILDING")).select("c_nationkey", "c_custkey")


@query("qualified_lookup", "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'MACHINERY' AND n_name = (SELECT min(n_name) FROM nation WHERE n_nationkey = 7)")
def qualified_lookup(spark: SparkSession, d: str) -> DataFrame:
    owner = nation(spark, d).filter("n_nationkey = 7").first()["n_name"]
    rows = customer(spark, d).join(nation(spark, d), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_mktsegment").alias("name"), F.create_map(F.lit("enclosing_type"), "n_name").alias("fields"))
    return relations.qualified(rows, f"{owner}::MACHINERY").select("c_custkey")


@query("full_outer_reconcile", "WITH r AS (SELECT o_orderkey AS path, 1 AS line FROM orders WHERE o_orderstatus = 'F'), p AS (SELECT o_orderkey AS path, 1 AS line, lower(o_orderpriority) AS role, o_orderkey % 2 = 0 AS was_read FROM orders WHERE o_custkey % 3 = 0) SELECT coalesce(r.path, p.path) AS path, coalesce(role, 'text') AS role FROM r FULL JOIN p ON r.path = p.path AND r.line = p.line WHERE r.path IS NOT NULL OR NOT coalesce(was_read, false)")
def full_outer_reconcile(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).select(F.col("o_orderkey").alias("path"), F.lit(1).alias("line"), "o_orderstatus", "o_custkey", "o_orderpriority")
    posted = o.filter("o_custkey % 3 = 0").select("path", "line", F.lower("o_orderpriority").alias("role"), (F.col("path") % 2 == 0).alias("was_read"))
    return relations.reconciled(o.filter("o_orderstatus = 'F'").select("path", "line"), posted).select("path", "role")


@query("ordinal_remap", """WITH li AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2), o AS (SELECT l_orderkey AS path, l_linenumber AS pos, l_linenumber - 1 AS ordinal, l_suppkey AS name, l_returnflag AS kind FROM li WHERE l_linenumber <> 2),
n AS (SELECT l_orderkey AS path, l_linenumber AS pos, CASE WHEN l_linenumber = 3 THEN -1 ELSE l_suppkey END AS name, l_returnflag AS kind FROM li WHERE l_linenumber <> 1),
o1 AS (SELECT *, row_number() OVER (PARTITION BY path, name, kind ORDER BY pos) AS k FROM o), n1 AS (SELECT *, row_number() OVER (PARTITION BY path, name, kind ORDER BY pos) AS k FROM n),
m1 AS (SELECT n1.path, n1.pos, o1.ordinal FROM n1 JOIN o1 USING (path, name, kind, k)),
o2 AS (SELECT *, row_number() OVER (PARTITION BY path, kind ORDER BY pos) AS k FROM o WHERE (path, ordinal) NOT IN (SELECT (path, ordinal) FROM m1)), n2 AS (SELECT *, row_number() OVER (PARTITION BY path, kind ORDER BY pos) AS k FROM n WHERE (path, pos) NOT IN (SELECT (path, pos) FROM m1)),
m2 AS (SELECT n2.path, n2.pos, o2.ordinal FROM n2 JOIN o2 USING (path, kind, k)),
m AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2), rest AS (SELECT path, pos, row_number() OVER (PARTITION BY path ORDER BY pos) AS k FROM n WHERE (path, pos) NOT IN (SELECT (path, pos) FROM m))
SELECT path, pos, CAST(ordinal AS INTEGER) AS ordinal FROM m UNION ALL SELECT path, pos, CAST(coalesce((SELECT max(ordinal) FROM o WHERE o.path = rest.path), -1) + k AS INTEGER) FROM rest""")
def ordinal_remap(spark: SparkSession, d: str) -> DataFrame:
    items = lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag").repartition("l_orderkey")
    rows = items.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_returnflag").alias("l_returnflag"))
    base = rows.select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("pos"), F.col("l_suppkey").alias("name"), F.col("l_returnflag").alias("kind"))
    old = base.filter("pos <> 2").withColumn("ordinal", F.col("pos") - 1)
    new = base.filter("pos <> 1").withColumn("name", F.when(F.col("pos") == 3, F.lit(-1).cast("bigint")).otherwise(F.col("name")))
    return relations.remapped(old, new, [["name", "kind"], ["kind"]]).select("path", "pos", "ordinal")


@query("children_of_node", "SELECT r_name AS parent, n_name AS child, CAST(row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS INTEGER) AS place FROM region JOIN nation ON n_regionkey = r_regionkey")
def children_of_node(spark: SparkSession, d: str) -> DataFrame:
    found = relations.children(nation(spark, d), _table("region")(spark, d), F.col("n_regionkey") == F.col("r_regionkey"), [F.asc("n_nationkey")])
    return found.select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"), "place")


@query("dir_rollup", f"WITH {FILES} SELECT dir, CAST(sum(size) AS BIGINT) AS size, count(*) AS files FROM (SELECT source AS dir, strlen(text) AS size FROM documents UNION ALL SELECT source || '/' || lang, strlen(text) FROM documents) GROUP BY 1")
def dir_rollup(spark: SparkSession, d: str) -> DataFrame:
    return corpus.directories(files(spark, d)).select("dir", "size", "files")


@query("depth_grouping", "SELECT source || '/' AS path, CAST(sum(strlen(text)) AS BIGINT) AS size, count(*) AS count FROM documents GROUP BY 1")
def depth_grouping(spark: SparkSession, d: str) -> DataFrame:
    return corpus.collapsed(files(spark, d), 1)


@query("path_extension", f"WITH {FILES} SELECT path, regexp_extract(path, '\\.([^./]+)$', 1) AS ext, CAST(len(string_split(path, '/')) AS INTEGER) AS depth, string_split(path, '/')[-1] AS name FROM files")
def path_extension(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("path")
    return files(spark, d).select("path", text.extension(path).alias("ext"), text.depth(path).alias("depth"), F.element_at(F.split(path, "/"), -1).alias("name"))


# --- derived fields ------------------------------------------------------------------------------------------------

_NAMES = "SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_-]*')) AS name FROM documents UNION SELECT o_orderpriority FROM orders UNION SELECT c_name FROM customer UNION SELECT upper(replace(n_name, ' ', '_')) || '_X' FROM nation UNION SELECT lower(replace(n_name, ' ', '_')) || '_x' FROM nation"
_NAMING = "CASE WHEN contains(name, '_') AND regexp_matches(name, '[A-Z]') AND NOT regexp_matches(name, '[a-z]') THEN 'UPPER_SNAKE' WHEN contains(name, '_') AND regexp_matches(name, '[a-z]') THEN 'snake_case' WHEN contains(name, '-') THEN 'kebab-case' WHEN regexp_matches(name, '^[A-Z]') AND regexp_matches(name, '[a-z]') THEN 'PascalCase' WHEN regexp_matches(name, '^[a-z]') AND regexp_matches(name, '[A-Z]') THEN 'camelCase' WHEN regexp_matches(name, '[a-z]') AND NOT regexp_matches(name, '[A-Z]') THEN 'flatcase' ELSE 'mixed' END"


@query("naming_style", f"SELECT name, {_NAMING} AS naming, CAST(strlen(name) AS INTEGER) AS name_length FROM ({_NAMES})")
def naming_style(spark: SparkSession, d: str) -> DataFrame:
    docs = _table("documents")(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_-]*"), 0)).alias("name"))
    flat = F.replace("n_name", F.lit(" "), F.lit("_"))
    more = [orders(spark, d).select("o_orderpriority"), customer(spark, d).select("c_name"), nation(spark, d).select(F.concat(F.upper(flat), F.lit("_X"))), nation(spark, d).select(F.concat(F.lower(flat), F.lit("_x")))]
    for m in more:
        docs = docs.union(m)
    return docs.distinct().select("name", text.naming_style(F.col("name")).alias("naming"), text.name_length(F.col("name")).alias("name_length"))


_LITERALS = """SELECT k, CASE CAST(k % 8 AS INTEGER) WHEN 0 THEN CAST(k AS VARCHAR) WHEN 1 THEN '0x' || upper(to_hex(k)) || 'UL' WHEN 2 THEN '0b' || bin(k) WHEN 3 THEN '0' || printf('%o', k) WHEN 4 THEN k || '.5f' WHEN 5 THEN k || 'e2' WHEN 6 THEN '-' || k || '_000u32' ELSE '0xE1' END AS literal FROM (SELECT p_partkey AS k FROM part)"""


@query("number_format", f"""WITH l AS ({_LITERALS}) SELECT literal, CASE CAST(k % 8 AS INTEGER) WHEN 0 THEN 'dec' WHEN 1 THEN 'hex' WHEN 2 THEN 'bin' WHEN 3 THEN 'oct' WHEN 4 THEN 'float' WHEN 5 THEN 'scientific' WHEN 6 THEN 'dec' ELSE 'hex' END AS num_format,
CAST(CASE CAST(k % 8 AS INTEGER) WHEN 5 THEN k * 100 WHEN 6 THEN -k * 1000 WHEN 7 THEN 225 ELSE k END AS BIGINT) AS num_value, CASE CAST(k % 8 AS INTEGER) WHEN 1 THEN 'UL' WHEN 4 THEN 'f' WHEN 6 THEN 'u32' ELSE '' END AS num_suffix, contains(literal, '_') AS has_separator FROM l""")
def number_format(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    kinds = [k.cast("string"), F.concat(F.lit("0x"), F.hex(k), F.lit("UL")), F.concat(F.lit("0b"), F.bin(k)), F.concat(F.lit("0"), F.conv(k.cast("string"), 10, 8)), F.concat(k.cast("string"), F.lit(".5f")), F.concat(k.cast("string"), F.lit("e2")), F.concat(F.lit("-"), k.cast("string"), F.lit("_000u32")), F.lit("0xE1")]
    x = part(spark, d).select(F.element_at(F.array(*kinds), (k % 8 + 1).cast("int")).alias("literal"))
    c = F.col("literal")
    return x.select("literal", text.number_format(c).alias("num_format"), text.number_value(c).alias("num_value"), text.number_suffix(c).alias("num_suffix"), text.has_separator(c).alias("has_separator"))


@query("numbers_in_props", "SELECT event_id, CAST(regexp_extract(props, '-?[0-9]+', 0) AS BIGINT) AS num_value FROM events WHERE regexp_matches(props, '[0-9]')")
def numbers_in_props(spark: SparkSession, d: str) -> DataFrame:
    literal = F.regexp_extract("props", "-?[0-9]+", 0)
    return events(spark, d).filter(F.col("props").rlike("[0-9]")).select("event_id", text.number_value(literal).alias("num_value"))


@query("condition_tests", "SELECT o_orderkey, CAST(1 + (o_orderkey % 3) AS INTEGER) AS tests, o_orderkey % 3 = 2 AS mixed, CAST(1 + o_orderkey % 3 AS INTEGER) AS deep, o_orderkey % 2 = 0 AS assigns FROM orders")
def condition_tests(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    a = F.when(key % 2 == 0, F.lit("x = f")).otherwise(F.lit("x == f"))
    body = F.when(key % 3 == 0, a).when(key % 3 == 1, F.concat(a, F.lit(" && (y > 1)"))).otherwise(F.concat(a, F.lit(" && (y) || ((z != 2))")))
    c = F.concat(F.lit("("), body, F.lit(")"))
    return orders(spark, d).select("o_orderkey", text.condition_tests(c).cast("int").alias("tests"), text.mixed_logic(c).alias("mixed"), text.paren_depth(c).alias("deep"), text.has_assignment(c).alias("assigns"))


@query("paren_depth", "SELECT doc_id, CAST(CASE WHEN regexp_matches(text, '\\(') THEN 1 ELSE 0 END AS INTEGER) AS nested FROM documents")
def paren_depth(spark: SparkSession, d: str) -> DataFrame:
    return _table("documents")(spark, d).select("doc_id", text.paren_depth(F.col("text")).alias("nested"))


@query("todo_markers", "SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS INTEGER) AS todo_count, CASE p_partkey % 4 WHEN 1 THEN 'TODO' WHEN 2 THEN 'FIXME,TODO' ELSE '' END AS todo_tags FROM part")
def todo_markers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    c = F.concat("p_name", F.when(k == 1, F.lit(" // todo: x")).when(k == 2, F.lit(" /* FIXME_ and TODO */")).when(k == 3, F.lit(" methodTODOx")).otherwise(F.lit("")))
    return part(spark, d).select("p_partkey", text.todo_count(c).cast("int").alias("todo_count"), text.todo_tags(c).alias("todo_tags"))


@query("comment_style", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'doc_block' WHEN 1 THEN 'doc_line' WHEN 2 THEN 'block' ELSE 'line' END AS comment_style FROM part")
def comment_style(spark: SparkSession, d: str) -> DataFrame:
    heads = F.array(*map(F.lit, ("/** ", "/// ", "/* ", "// ", "# ")))
    return part(spark, d).select("p_partkey", text.comment_style(F.concat(F.element_at(heads, (F.col("p_partkey") % 5 + 1).cast("int")), "p_name")).alias("comment_style"))


# --- display -------------------------------------------------------------------------------------------------------


@query("context_window_lines", f"WITH {LINES} SELECT path, line, text, CASE WHEN line = 4 THEN '>>>' END AS marker FROM lines WHERE line BETWEEN 2 AND 6")
def context_window_lines(spark: SparkSession, d: str) -> DataFrame:
    return edits.context(lines(spark, d), 4, 2)


@query("line_range", f"WITH {LINES} SELECT path, line, text FROM lines WHERE line BETWEEN 3 AND 8")
def line_range(spark: SparkSession, d: str) -> DataFrame:
    return edits.line_range(lines(spark, d), 3, 8)


@query("buffer_tail", f"WITH {LINES} SELECT l.path, line, text FROM lines l JOIN (SELECT path, max(line) AS n FROM lines GROUP BY 1) m ON m.path = l.path WHERE line > n - 3")
def buffer_tail(spark: SparkSession, d: str) -> DataFrame:
    return edits.tail(lines(spark, d), 3)


@query("line_filter", f"WITH {LINES} SELECT path, line, text FROM lines WHERE regexp_matches(text, '!!') ORDER BY path, line LIMIT 40")
def line_filter(spark: SparkSession, d: str) -> DataFrame:
    c = parse("SHOW LINES 1-9 OF x WHERE text MATCHES '!!' LIMIT 40").clauses
    C.refused(c, SHAPES["line"], shaping=False, globs=False)
    return C.paged(C.filtered(lines(spark, d), c, SHAPES["line"]), c, SHAPES["line"], keep_order=[F.asc("path"), F.asc("line")])


@query("sibling_runs", "WITH t AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders), g AS (SELECT *, p - row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY p) AS grp FROM t) SELECT o_custkey, o_orderstatus, CAST(min(p) AS INTEGER) AS first_pos, CAST(max(p) AS INTEGER) AS last_pos, count(*) AS members FROM g GROUP BY o_custkey, o_orderstatus, grp HAVING count(*) >= 2")
def sibling_runs(spark: SparkSession, d: str) -> DataFrame:
    return relations.sibling_runs(orders(spark, d), ["o_custkey"], [F.asc("o_orderkey")], "o_orderstatus").drop("run")


@query("sibling_nav", "SELECT l_orderkey, l_linenumber, lag(l_linenumber) OVER w AS prev_sibling, lead(l_linenumber) OVER w AS next_sibling FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)")
def sibling_nav(spark: SparkSession, d: str) -> DataFrame:
    order = [F.asc(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    return relations.siblings(lineitem(spark, d), ["l_orderkey"], order, "l_linenumber").select("l_orderkey", "l_linenumber", "prev_sibling", "next_sibling")


@query("outline_depth", "SELECT 'r' || r_regionkey AS node, CAST(0 AS INTEGER) AS depth FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT 'c' || c_custkey, 2 FROM customer")
def outline_depth(spark: SparkSession, d: str) -> DataFrame:
    named = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    nodes = _table("region")(spark, d).select(named("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    nodes = nodes.unionByName(nation(spark, d).select(named("n", "n_nationkey").alias("node"), named("r", "n_regionkey").alias("parent")))
    nodes = nodes.unionByName(customer(spark, d).select(named("c", "c_custkey").alias("node"), named("n", "c_nationkey").alias("parent")))
    return edits.depths(nodes)


@query("callees", "SELECT DISTINCT o_orderkey AS caller, l_suppkey AS callee, l_linenumber AS line FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def callees(spark: SparkSession, d: str) -> DataFrame:
    """The operator over all of lineitem: an order is a function and its items are the calls that it makes."""
    of_order = orders(spark, d).select(F.col("o_orderkey").alias("path"), F.lit(0).alias("pos"), F.lit(None).cast("int").alias("parent_pos"), F.col("o_orderkey").alias("name"), F.lit("function").alias("fql_kind"), F.lit(0).alias("line"))
    calls = lineitem(spark, d).select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("pos"), F.lit(0).alias("parent_pos"), F.col("l_suppkey").alias("name"), F.lit("call").alias("fql_kind"), F.col("l_linenumber").alias("line"))
    return index.callees(of_order.unionByName(calls)).select("caller", F.col("name").alias("callee"), "line")


@query("compact_group_lists", f"WITH {SITES} SELECT path, array_to_string(list(line ORDER BY line), ',') AS lines FROM (SELECT DISTINCT path, line FROM sites WHERE name = 'that') GROUP BY path")
def compact_group_lists(spark: SparkSession, d: str) -> DataFrame:
    rows = relations.compact(sites(spark, d).filter("name = 'that'").select("path", "line").distinct(), ["path"], F.col("line"), "lines")
    return rows.select("path", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


@query("compact_symbols_by_kind", "SELECT p_type AS fql_kind, string_agg(p_name || ':' || p_size, ';' ORDER BY p_name, p_size) AS rows FROM part GROUP BY 1")
def compact_symbols_by_kind(spark: SparkSession, d: str) -> DataFrame:
    rows = relations.compact(part(spark, d), ["p_type"], F.struct("p_name", "p_size"), "items")
    return rows.select(F.col("p_type").alias("fql_kind"), F.array_join(F.transform("items", lambda x: F.concat(x["p_name"], F.lit(":"), x["p_size"].cast("string"))), ";").alias("rows"))


@query("json_rows", """SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS json FROM nation""")
def json_rows(spark: SparkSession, d: str) -> DataFrame:
    return render.json_lines(nation(spark, d).select("n_nationkey", "n_name", "n_regionkey")).select("n_nationkey", "json")


# --- identity and edits --------------------------------------------------------------------------------------------

_REV = "'h' || list_aggregate(list_reverse(regexp_extract_all(substr(sha256({0}), 1, 16), '..')), 'string_agg', '')"


@query("path_handle", f"WITH {FILES} SELECT path, 'n' || substr(sha256(path), 1, 12) AS node_id, {_REV.format('content')} AS rev FROM files")
def path_handle(spark: SparkSession, d: str) -> DataFrame:
    return corpus.stamped(files(spark, d)).select("path", "node_id", "rev")


@query("node_ids", f"WITH {LINES} SELECT path, line, 'n' || substr(sha256(path), 1, 12) || '.' || lpad(CAST(line AS VARCHAR), CAST(greatest(4, length(CAST(line AS VARCHAR))) AS INTEGER), '0') AS node_id, {_REV.format('text')} AS rev FROM lines")
def node_ids(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("path", "line", identity.node_id(F.col("path"), F.col("line")).alias("node_id"), identity.span_rev(F.col("text")).alias("rev"))


@query("master_rev", "SELECT sha256(string_agg(n_name || chr(0) || n_regionkey || chr(10), '' ORDER BY n_nationkey)) AS master_rev FROM nation")
def master_rev(spark: SparkSession, d: str) -> DataFrame:
    return identity.master_rev(nation(spark, d).withColumn("rev", F.col("n_regionkey").cast("string")), "n_name", "rev", "n_nationkey")


@query("dir_rev", f"WITH {FILES}, marks AS (SELECT source AS dir, path FROM documents JOIN files ON path = source || '/' || lang || '/' || doc_id || '.txt' UNION ALL SELECT source || '/' || lang, path FROM documents JOIN files ON path = source || '/' || lang || '/' || doc_id || '.txt') SELECT dir, 'h' || printf('%016x', bit_xor(CAST('0x' || list_aggregate(list_reverse(regexp_extract_all(substr(sha256(path), 1, 16), '..')), 'string_agg', '') AS UBIGINT))) AS rev FROM marks GROUP BY 1")
def dir_rev(spark: SparkSession, d: str) -> DataFrame:
    return corpus.directories(files(spark, d)).select("dir", "rev")


@query("matching_replace", "SELECT doc_id, sha256(replace(text, 'the', '<T>')) AS rev, CAST((strlen(text) - strlen(replace(text, 'the', ''))) // 3 AS BIGINT) AS hits FROM documents")
def matching_replace(spark: SparkSession, d: str) -> DataFrame:
    out = edits.replaced(_table("documents")(spark, d).withColumnRenamed("text", "content"), "the", "<T>", word=False)
    return out.select("doc_id", F.sha2("content", 256).alias("rev"), "hits")


_EDGED = "'(^|[^\\pL\\pM\\p{Nd}\\p{Nl}\\p{Pc}])the($|[^\\pL\\pM\\p{Nd}\\p{Nl}\\p{Pc}])', '\\1THE\\2', 'g'"


# words next to each other share the character between them, so the SQL replaces twice
@query("matching_word_replace", f"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, {_EDGED}), {_EDGED})) AS rev FROM documents")
def matching_word_replace(spark: SparkSession, d: str) -> DataFrame:
    docs = _table("documents")(spark, d).withColumnRenamed("text", "content")
    return edits.replaced(docs, "the", "THE", word=True).select("doc_id", F.sha2("content", 256).alias("rev"))


_PARTS = "p AS (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM documents)"


@query("change_lines", f"WITH {_PARTS} SELECT doc_id, sha256(CASE WHEN len(x) < 2 THEN text || CASE WHEN text = '' THEN '' ELSE chr(10) END || 'NEW' || chr(10) ELSE x[1] || chr(10) || 'NEW' || chr(10) || array_to_string(x[4:], chr(10)) END) AS rev FROM p")
def change_lines(spark: SparkSession, d: str) -> DataFrame:
    return _table("documents")(spark, d).select("doc_id", F.sha2(edits.lines_changed(F.col("text"), 2, 3, "NEW"), 256).alias("rev"))


@query("copy_lines", f"WITH {_PARTS} SELECT doc_id, sha256(text || CASE WHEN text = '' OR suffix(text, chr(10)) THEN '' ELSE chr(10) END || CASE WHEN text = '' THEN '' WHEN len(x) > 2 THEN x[1] || chr(10) || x[2] || chr(10) WHEN suffix(text, chr(10)) THEN text ELSE text || chr(10) END) AS rev FROM p")
def copy_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first two lines of each text once more at its end."""
    c = F.col("text")
    return _table("documents")(spark, d).select("doc_id", F.sha2(edits.lines_inserted(c, edits.lines_of(c, 1, 2), None), 256).alias("rev"))


@query("delete_lines", f"WITH {_PARTS} SELECT doc_id, sha256(CASE WHEN len(x) <= 2 THEN '' ELSE array_to_string(x[3:], chr(10)) END) AS rev FROM p")
def delete_lines(spark: SparkSession, d: str) -> DataFrame:
    return _table("documents")(spark, d).select("doc_id", F.sha2(edits.lines_changed(F.col("text"), 1, 2, ""), 256).alias("rev"))


@query("merge_edits_overlap", "SELECT l_orderkey, l_linenumber, coalesce(lag(l_partkey + 3) OVER w > l_partkey, false) AS overlaps FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey)")
def merge_edits_overlap(spark: SparkSession, d: str) -> DataFrame:
    e = lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey").alias("start"), (F.col("l_partkey") + 3).alias("end"))
    return edits.overlaps(e, ["l_orderkey"], ["l_linenumber", "l_suppkey"]).select("l_orderkey", "l_linenumber", "overlaps")


@query("snapshot_diff_rows", "WITH a AS (SELECT doc_id, text FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || chr(10) || 'x' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0) SELECT coalesce(a.doc_id, b.doc_id) AS path, CASE WHEN a.doc_id IS NULL THEN 'A' WHEN b.doc_id IS NULL THEN 'D' ELSE 'M' END AS status FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.text IS DISTINCT FROM b.text")
def snapshot_diff_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = _table("documents")(spark, d).select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    after = docs.filter("path % 11 <> 0").withColumn("content", F.when(F.col("path") % 5 == 0, F.concat("content", F.lit("\nx"))).otherwise(F.col("content")))
    return edits.changed_files(docs.filter("path % 7 <> 0"), after).select("path", "status")


# every third line gets a mark that no line has, so the lines left alone are the longest common subsequence
@query("diff_line_counts", f"WITH {LINES} SELECT path, CAST(count(*) FILTER (WHERE line % 3 = 0) AS BIGINT) AS added, CAST(count(*) FILTER (WHERE line % 3 = 0) AS BIGINT) AS removed FROM lines GROUP BY path")
def diff_line_counts(spark: SparkSession, d: str) -> DataFrame:
    marked = F.array_join(F.transform(F.split("content", "\n", -1), lambda x, i: F.when(i % 3 == 2, F.concat(x, F.lit("\x01"))).otherwise(x)), "\n")
    ends = F.col("content").endswith("\n") & (F.size(F.split("content", "\n", -1)) % 3 == 0)
    after = F.when(ends, F.regexp_replace(marked, "\x01\\z", "")).otherwise(marked)
    return edits.line_changes(files(spark, d).select("path", F.col("content").alias("a"), after.alias("b")))


def queries() -> dict[str, Query]:
    from . import engine_queries  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: _SQL[name] for name in queries() if name in _SQL}
