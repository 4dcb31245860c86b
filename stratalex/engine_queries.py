"""Registered queries that run whole sessions: a corpus of C, JSON and Markdown is written from the tables by template, read
and indexed like any other, and asked by statements. What they must answer follows from the tables, so SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .queries import query
from .session import Session

#: Sessions that no statement edits, by application and folder: others begin as their forks, so a corpus is read once.
_READ_ONLY: dict[tuple[str, str], Session] = {}


def code_files(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): a C file a nation with a function a customer, their helpers, and a JSON and a Markdown file a region."""
    table = lambda name: spark.read.parquet(f"{d}/{name}.parquet")
    flat = lambda c: F.lower(F.replace(c, F.lit(" "), F.lit("_")))
    key = F.col("c_custkey")
    function = F.format_string(
        "/** %s */\nint cust_%d(int first, int unused) {\n    if (first > %d && first != 0) {\n        return helper_%d(first + cust_%d(1, 2));\n    }\n    return first;\n}\n",
        F.col("c_name"), key, key % 100 + 3, key % 7, key,
    )
    nation = table("nation").join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    bodies = table("customer").groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, function.alias("f")))), lambda x: x["f"]), "").alias("body"))
    head = F.format_string("// TODO: %s\n#define LIMIT_%d %d\n#ifdef REGION_%d\nstatic int flag_%d = 0x%s;\n#endif\n\n", "n_name", "n_nationkey", F.col("n_nationkey") * 10 + 1, "n_regionkey", "n_nationkey", F.hex(F.col("n_nationkey") + 16))
    sources = nation.join(bodies, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    sources = sources.select(F.concat(F.lit("code/"), flat("r_name"), F.lit("/"), flat("n_name"), F.lit(".c")).alias("path"), F.concat(head, F.coalesce("body", F.lit(""))).alias("content"))
    helpers = spark.range(1).select(F.lit("lib/helpers.c").alias("path"), F.lit("".join(f"int helper_{k}(int x) {{ return x; }}\n" for k in range(7))).alias("content"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), c)
    member = lambda x: F.format_string('    "%s": {"key": %d, "tags": ["a", %d]}', x["n_name"], x["n_nationkey"], x["n_nationkey"])
    section = lambda x: F.format_string("## %s\nsee helper_1\n", x["n_name"])
    of_region = nation.groupBy("r_name").agg(F.array_join(listed(member), ",\n").alias("members"), F.array_join(listed(section), "\n").alias("sections"))
    conf = of_region.select(F.concat(F.lit("conf/"), flat("r_name"), F.lit(".json")).alias("path"), F.format_string('{"region": "%s",\n "nations": {\n%s\n }\n}\n', "r_name", "members").alias("content"))
    docs = of_region.select(F.concat(F.lit("docs/"), flat("r_name"), F.lit(".md")).alias("path"), F.format_string("# %s\n\n%s", "r_name", "sections").alias("content"))
    return sources.unionByName(helpers).unionByName(conf).unionByName(docs)


def _session(spark: SparkSession, d: str) -> Session:
    place = (spark.sparkContext.applicationId, d)
    if place not in _READ_ONLY:
        _READ_ONLY[place] = Session(spark, code_files(spark, d))
    return _READ_ONLY[place]


def _edited(spark: SparkSession, d: str, *statements: str) -> Session:
    s = _session(spark, d).forked()
    for statement in statements:
        s.run(statement)
    return s


_FLAT = "lower(replace({0}, ' ', '_'))"
NATIONS = f"nations AS (SELECT n_nationkey AS n, n_name, r_name, n_regionkey AS r, 'code/' || {_FLAT.format('r_name')} || '/' || {_FLAT.format('n_name')} || '.c' AS path FROM nation JOIN region ON r_regionkey = n_regionkey)"
FUNCTIONS = NATIONS + """, functions AS (SELECT c_custkey AS k, c_name, n, path, 'cust_' || c_custkey AS name, CAST(1 + 7 * row_number() OVER (PARTITION BY n ORDER BY c_custkey) AS INTEGER) AS line
  FROM customer JOIN nations ON c_nationkey = n)"""
ALL = 10_000_000


def _asked(name: str, statement: str, columns: dict[str, str], sql: str) -> None:
    """A query that answers one statement over the corpus; ``columns`` are expressions over its rows."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return _session(spark, d).run(statement).selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))

    run.__name__ = name
    query(name, sql)(run)


def _field(*names: str) -> dict[str, str]:
    return {n: f"fields['{n}']" for n in names}


_PLACE = {"name": "name", "path": "path", "line": "line"}
_asked("session_find_functions", f"FIND symbols WHERE kind = 'function' WHERE name LIKE 'CUST%' IN 'code' LIMIT {ALL}", {**_PLACE, "end_line": "end_line", "usages": "usages"},
       f"WITH {FUNCTIONS} SELECT name, path, line, line + 5 AS end_line, 2 AS usages FROM functions")
_asked("session_find_by_field", f"FIND symbols WHERE param_count >= 2 WHERE name MATCHES '_[0-9]*7$' LIMIT {ALL}", _PLACE, f"WITH {FUNCTIONS} SELECT name, path, line FROM functions WHERE k % 10 = 7")
_asked("session_group_symbols", "FIND symbols WHERE kind = 'function' GROUP BY path HAVING count >= 2", {"path": "path", "count": "count"},
       f"WITH {FUNCTIONS} SELECT path, count(*) AS count FROM functions GROUP BY path HAVING count(*) >= 2 UNION ALL SELECT 'lib/helpers.c', 7")
_asked("session_group_kinds", "FIND symbols WHERE language = 'c' GROUP BY kind", {"kind": "fql_kind", "count": "count"},
       f"""WITH {FUNCTIONS}, c AS (SELECT count(*) AS f FROM functions), n AS (SELECT count(*) AS n FROM nations) SELECT 'function' AS kind, f + 7 AS count FROM c UNION ALL SELECT 'comment', f + n FROM c, n
UNION ALL SELECT 'if', f FROM c UNION ALL SELECT 'number', 3 * f + n + (SELECT count(*) FROM functions WHERE k % 100 + 3 <> 0) FROM c, n UNION ALL SELECT 'macro', n FROM n UNION ALL SELECT 'variable', n FROM n""")  # fmt: skip
_asked("session_top_usages", "FIND symbols WHERE name LIKE 'helper%' ORDER BY usages DESC LIMIT 3", {"name": "name", "usages": "usages"},
       f"WITH {FUNCTIONS}, h AS (SELECT 'helper_' || h AS name, (SELECT count(*) FROM functions WHERE k % 7 = h) + 1 AS usages FROM range(7) t(h)) SELECT * FROM h ORDER BY usages DESC, name LIMIT 3")
_asked("session_find_usages", f"FIND usages OF helper_1 LIMIT {ALL}", {"path": "path", "line": "line", "role": "role"},
       f"""WITH {FUNCTIONS}, d AS (SELECT 'docs/' || {_FLAT.format('r_name')} || '.md' AS path, CAST(1 + 3 * row_number() OVER (PARTITION BY r ORDER BY n) AS INTEGER) AS line FROM nations)
SELECT path, line + 2 AS line, 'code' AS role FROM functions WHERE k % 7 = 1 UNION ALL SELECT 'lib/helpers.c', 2, 'code' UNION ALL SELECT path, line, 'doc' FROM d""")  # fmt: skip
_asked("session_usages_by_file", "FIND usages OF helper_2 WHERE role = 'code' GROUP BY path", {"path": "path", "count": "count"},
       f"WITH {FUNCTIONS} SELECT path, count(*) AS count FROM functions WHERE k % 7 = 2 GROUP BY path UNION ALL SELECT 'lib/helpers.c', 1")
_asked("session_naming_fields", f"FIND symbols WHERE naming = 'snake_case' WHERE kind = 'function' LIMIT {ALL}", {"name": "name", **_field("name_length")},
       f"WITH {FUNCTIONS} SELECT name, CAST(length(name) AS VARCHAR) AS name_length FROM functions UNION ALL SELECT 'helper_' || h, '8' FROM range(7) t(h)")
_asked("session_metric_fields", f"FIND symbols WHERE kind = 'function' WHERE name LIKE 'cust%' LIMIT {ALL}", {"name": "name", **_field("param_count", "lines", "return_count", "goto_count", "throw_count", "string_count", "branch_count", "has_doc")},
       f"WITH {FUNCTIONS} SELECT name, '2' AS param_count, '6' AS lines, '2' AS return_count, '0' AS goto_count, '0' AS throw_count, '0' AS string_count, '1' AS branch_count, 'true' AS has_doc FROM functions")
_asked("session_flow_fields", f"FIND symbols WHERE kind = 'function' WHERE name LIKE 'cust%' LIMIT {ALL}", {"name": "name", **_field("max_condition_tests", "max_paren_depth", "null_check_count", "is_recursive", "recursion_count", "unused_params", "unused_param_count", "has_shadow", "has_escape", "has_cast")},
       f"WITH {FUNCTIONS} SELECT name, '2' AS max_condition_tests, '0' AS max_paren_depth, '0' AS null_check_count, 'true' AS is_recursive, '1' AS recursion_count, 'unused' AS unused_params, '1' AS unused_param_count, CAST(NULL AS VARCHAR) AS has_shadow, CAST(NULL AS VARCHAR) AS has_escape, 'false' AS has_cast FROM functions")
_asked("session_condition_fields", f"FIND symbols WHERE kind = 'if' LIMIT {ALL}", {"name": "name", "path": "path", "line": "line", "end_line": "end_line", **_field("condition_tests", "condition_text", "enclosing_fn", "paren_depth", "mixed_logic")},
       f"WITH {FUNCTIONS} SELECT 'a > b && a != c' AS name, path, line + 1 AS line, line + 3 AS end_line, '2' AS condition_tests, 'first > ' || (k % 100 + 3) || ' && first != 0' AS condition_text, name AS enclosing_fn, '0' AS paren_depth, CAST(NULL AS VARCHAR) AS mixed_logic FROM functions")
_asked("session_number_fields", f"FIND symbols WHERE kind = 'number' WHERE num_value > 2 LIMIT {ALL}", {"path": "path", "line": "line", **_field("num_format", "num_value", "num_sign", "has_separator", "is_magic")},
       f"""WITH {FUNCTIONS} SELECT path, line + 1 AS line, 'dec' AS num_format, CAST(k % 100 + 3 AS VARCHAR) AS num_value, 'positive' AS num_sign, 'false' AS has_separator, 'true' AS is_magic FROM functions
UNION ALL SELECT path, 4, 'hex', CAST(n + 16 AS VARCHAR), 'positive', 'false', 'false' FROM nations""")  # fmt: skip
_asked("session_guard_fields", f"FIND globals WHERE guard_kind = 'preprocessor' LIMIT {ALL}", {"name": "name", "path": "path", "line": "line", **_field("guard", "guard_defines", "guard_mentions", "guard_branch", "scope", "storage", "value", "type")},
       f"WITH {NATIONS} SELECT 'flag_' || n AS name, path, 4 AS line, 'defined(REGION_' || r || ')' AS guard, 'REGION_' || r AS guard_defines, 'REGION_' || r AS guard_mentions, '0' AS guard_branch, 'file' AS scope, 'static' AS storage, '0x' || to_hex(n + 16) AS value, 'int' AS type FROM nations")
_asked("session_macros", f"FIND symbols WHERE kind = 'macro' LIMIT {ALL}", {"name": "name", "path": "path", "line": "line", **_field("value")},
       f"WITH {NATIONS} SELECT 'LIMIT_' || n AS name, path, 2 AS line, CAST(n * 10 + 1 AS VARCHAR) AS value FROM nations")
_asked("session_comments", f"FIND symbols WHERE kind = 'comment' WHERE comment_style = 'doc_block' LIMIT {ALL}", {"name": "name", "path": "path", "line": "line"},
       f"WITH {FUNCTIONS} SELECT '/** ' || c_name || ' */' AS name, path, line - 1 AS line FROM functions")
_asked("session_key_paths", f"FIND symbols WHERE key_path MATCHES '^nations[.][^.]+[.]key$' LIMIT {ALL}", {"path": "path", "line": "line", **_field("key_path", "value")},
       f"WITH {NATIONS} SELECT 'conf/' || {_FLAT.format('r_name')} || '.json' AS path, CAST(2 + row_number() OVER (PARTITION BY r ORDER BY n) AS INTEGER) AS line, 'nations.' || n_name || '.key' AS key_path, CAST(n AS VARCHAR) AS value FROM nations")
_asked("session_sections", f"FIND symbols WHERE kind = 'section' LIMIT {ALL}", {"name": "name", "path": "path", "line": "line", "end_line": "end_line", **_field("level")},
       f"""WITH {NATIONS}, d AS (SELECT n_name AS name, r, 'docs/' || {_FLAT.format('r_name')} || '.md' AS path, r_name, CAST(3 * row_number() OVER (PARTITION BY r ORDER BY n) AS INTEGER) AS line FROM nations)
SELECT name, path, line, line + 1 AS end_line, '2' AS level FROM d UNION ALL SELECT r_name, path, 1, max(line) + 1, '1' FROM d GROUP BY r_name, path""")  # fmt: skip
_asked("session_find_files", f"FIND files WHERE extension = 'c' IN 'code' LIMIT {ALL}", {"path": "path", "size": "size", "error_count": "error_count", "parse_coverage": "parse_coverage"},
       f"""WITH {FUNCTIONS}, body AS (SELECT n, sum(strlen('/** ' || c_name || ' */' || 'int cust_' || k || '(int first, int unused) {{' || '    if (first > ' || (k % 100 + 3) || ' && first != 0) {{' || '        return helper_' || (k % 7)
  || '(first + cust_' || k || '(1, 2));' || '    }}' || '    return first;' || '}}') + 7) AS size FROM functions GROUP BY n)
SELECT path, CAST(strlen('// TODO: ' || n_name || '#define LIMIT_' || n || ' ' || (n * 10 + 1) || '#ifdef REGION_' || r || 'static int flag_' || n || ' = 0x' || to_hex(n + 16) || ';' || '#endif') + 6 + coalesce(size, 0) AS BIGINT) AS size,
  0 AS error_count, 100 AS parse_coverage FROM nations LEFT JOIN body USING (n)""")  # fmt: skip
_asked("session_files_by_depth", "FIND files DEPTH 1 LIMIT 1000", {"path": "path", "count": "count"},
       "SELECT 'code/' AS path, count(*) AS count FROM nation UNION ALL SELECT 'conf/', count(*) FROM region UNION ALL SELECT 'docs/', count(*) FROM region UNION ALL SELECT 'lib/', 1")
_asked("session_outline", "SHOW outline OF 'code'", {"name": "name", "path": "path", "line": "line", "depth": "depth"},
       f"WITH {FUNCTIONS} SELECT name, path, line, 0 AS depth FROM functions UNION ALL SELECT 'flag_' || n, path, 4, 0 FROM nations UNION ALL SELECT 'LIMIT_' || n, path, 2, 0 FROM nations")
_asked("session_outline_of_trees", "SHOW outline OF 'conf'", {"name": "name", "path": "path", "line": "line", "depth": "depth"},
       f"""WITH {NATIONS}, j AS (SELECT n_name, n, r, 'conf/' || {_FLAT.format('r_name')} || '.json' AS path, CAST(2 + row_number() OVER (PARTITION BY r ORDER BY n) AS INTEGER) AS line FROM nations)
SELECT n_name AS name, path, line, 1 AS depth FROM j UNION ALL SELECT 'tags', path, line, 2 FROM j UNION ALL SELECT DISTINCT 'nations', path, 2, 0 FROM j""")  # fmt: skip
_asked("session_callees", "SHOW callees OF cust_1", {"name": "name", "path": "path", "line": "line"},
       f"WITH {FUNCTIONS} SELECT unnest(['helper_1', 'cust_1']) AS name, path, line + 2 AS line FROM functions WHERE k = 1")
_asked("session_body", "SHOW body OF cust_2 DEPTH 9", {"path": "path", "line": "line", "text": "text"},
       f"""WITH {FUNCTIONS} SELECT path, CAST(line + i AS INTEGER) AS line, ['int cust_2(int first, int unused) {{', '    if (first > 5 && first != 0) {{', '        return helper_2(first + cust_2(1, 2));', '    }}', '    return first;', '}}'][i + 1] AS text FROM functions, range(6) t(i) WHERE k = 2""")
_asked("session_folded_body", "SHOW body OF cust_2 DEPTH 1", {"line": "line", "text": "text"},
       f"WITH {FUNCTIONS} SELECT CAST(line + [0, 1, 4, 5][i + 1] AS INTEGER) AS line, ['int cust_2(int first, int unused) {{', '    if (first > 5 && first != 0) {{ }}', '    return first;', '}}'][i + 1] AS text FROM functions, range(4) t(i) WHERE k = 2")
_asked("session_signature", "SHOW signature OF cust_3", {"name": "name", "path": "path", "line": "line", "signature": "signature"},
       f"WITH {FUNCTIONS} SELECT name, path, line, 'int cust_3(int first, int unused)' AS signature FROM functions WHERE k = 3")
_asked("session_context", "SHOW context OF cust_4 LINES 1", {"line": "line", "marker": "marker"},
       f"WITH {FUNCTIONS} SELECT CAST(line + i AS INTEGER) AS line, CASE WHEN i = 0 THEN '>>>' END AS marker FROM functions, range(-1, 2) t(i) WHERE k = 4")
_asked("session_lines", "SHOW LINES 3-6 OF 'lib/helpers.c'", {"line": "line", "text": "text"}, "SELECT CAST(h AS INTEGER) AS line, 'int helper_' || (h - 1) || '(int x) { return x; }' AS text FROM range(3, 7) t(h)")
_asked("session_stats", "SHOW STATS", {"language": "language", "kind": "fql_kind", "files": "files"},
       f"""WITH {FUNCTIONS}, n AS (SELECT count(*) AS n FROM nations), f AS (SELECT count(DISTINCT n) AS f FROM functions), r AS (SELECT count(DISTINCT r) AS r FROM nations)
SELECT 'c' AS language, 'comment' AS kind, n AS files FROM n UNION ALL SELECT 'c', 'macro', n FROM n UNION ALL SELECT 'c', 'variable', n FROM n UNION ALL SELECT 'c', 'number', n FROM n UNION ALL SELECT 'c', 'function', f + 1 FROM f UNION ALL SELECT 'c', 'if', f FROM f
UNION ALL SELECT 'json', unnest(['pair', 'object', 'array']), r FROM r UNION ALL SELECT 'markdown', unnest(['section', 'heading', 'paragraph']), r FROM r""")  # fmt: skip
_asked("session_directory_nodes", "FIND symbols WHERE kind = 'function' IN 'lib'", {"name": "name", "node_id": "node_id"},
       "SELECT 'helper_' || h AS name, 'n' || substr(sha256('lib/helpers.c'), 1, 12) || '.' || printf('%04d', h + 1) AS node_id FROM range(7) t(h)")


@query("session_change_matching", f"WITH {FUNCTIONS} SELECT 'renamed_3' AS name, 1 AS usages, 'lib/helpers.c' AS path, 4 AS line")
def session_change_matching(spark: SparkSession, d: str) -> DataFrame:
    s = _edited(spark, d, "CHANGE FILE 'lib/helpers.c' MATCHING WORD 'helper_3' WITH 'renamed_3'")
    return s.run("FIND symbols WHERE name = 'renamed_3'").select("name", "usages", "path", "line")


@query("session_usages_after_edit", f"WITH {FUNCTIONS} SELECT 'helper_' || h AS name, CAST((SELECT count(*) FROM functions WHERE k % 7 = h) + CASE h WHEN 5 THEN 3 WHEN 0 THEN 0 ELSE 1 END AS BIGINT) AS usages FROM range(1, 7) t(h)")
def session_usages_after_edit(spark: SparkSession, d: str) -> DataFrame:
    """Counts over a corpus of which one file is new and one has lost a line."""
    s = _edited(spark, d, "INSERT NODE FOR 'lib/more.c' WITH 'int twice(int x) { return helper_5(helper_5(x)); }'", "CHANGE FILE 'lib/helpers.c' LINES 1-1 WITH NOTHING")
    return s.run("FIND symbols WHERE name LIKE 'helper%' LIMIT 100").select("name", "usages")


@query("session_diff_stat", "SELECT 'lib/helpers.c' AS path, 'M' AS status, 1 AS added, 2 AS removed UNION ALL SELECT 'lib/more.c', 'A', 2, 0 UNION ALL SELECT 'conf/asia.json', 'D', 0, CAST(4 + (SELECT count(*) FROM nation WHERE n_regionkey = (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')) AS INTEGER)")
def session_diff_stat(spark: SparkSession, d: str) -> DataFrame:
    s = _edited(spark, d, "INSERT NODE FOR 'lib/more.c' WITH 'int a;\nint b;\n'", "CHANGE FILE 'lib/helpers.c' LINES 2-3 WITH 'int z;'", "CHANGE FILE 'conf/asia.json' WITH NOTHING")
    return s.run("SHOW DIFF STAT").select("path", "status", F.col("added").cast("int").alias("added"), F.col("removed").cast("int").alias("removed"))


@query("session_delete_member", "SELECT 'conf/' || lower(replace(r_name, ' ', '_')) || '.json' AS path, sha256('{' || chr(10) || ' \"nations\": {' || chr(10) || string_agg('    \"' || n_name || '\": {\"key\": ' || n_nationkey || ', \"tags\": [\"a\", ' || n_nationkey || ']}', ',' || chr(10) ORDER BY n_nationkey) || chr(10) || ' }' || chr(10) || '}' || chr(10)) AS rev FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'EUROPE' GROUP BY r_name")
def session_delete_member(spark: SparkSession, d: str) -> DataFrame:
    """A member of a JSON object goes with its comma; no other byte changes."""
    s = _session(spark, d).forked()
    handle = s.run("FIND symbols WHERE key_path = 'region' IN 'conf/europe.json'").select("node_id").first()["node_id"]
    s.run(f"DELETE NODE {handle}")
    return s.file("conf/europe.json").select("path", F.sha2(F.replace("content", F.lit('{"nations"'), F.lit('{\n "nations"')), 256).alias("rev"))


@query("session_change_found", f"WITH {FUNCTIONS} SELECT path, count(*) AS files FROM functions WHERE k % 7 = 6 GROUP BY path")
def session_change_found(spark: SparkSession, d: str) -> DataFrame:
    """The lines that a FIND showed are changed, in whatever files they are."""
    s = _session(spark, d).forked()
    s.run(f"FIND usages OF helper_6 IN 'code' LIMIT {ALL}")
    s.run("CHANGE NODES FOUND MATCHING 'helper_6' WITH 'other_6'")
    return s.run(f"FIND usages OF other_6 LIMIT {ALL}").groupBy("path").agg(F.count(F.lit(1)).alias("files"))


@query("session_ids_after_edit", f"WITH {FUNCTIONS}, o AS (SELECT 'helper_' || h AS name, 'n' || substr(sha256('lib/helpers.c'), 1, 12) || '.' || printf('%04d', h + 1) AS node_id FROM range(7) t(h)) SELECT * FROM o UNION ALL SELECT 'early', 'n' || substr(sha256('lib/helpers.c'), 1, 12) || '.0008'")
def session_ids_after_edit(spark: SparkSession, d: str) -> DataFrame:
    """Handles of nodes behind an insertion stay; the new node takes the next number."""
    s = _session(spark, d).forked()
    handle = s.run("FIND symbols WHERE name = 'helper_0'").select("node_id").first()["node_id"]
    s.run(f"INSERT BEFORE NODE {handle} WITH 'int early(void) {{ return 1; }}'")
    return s.run("FIND symbols WHERE kind = 'function' IN 'lib'").select("name", "node_id")
