"""Every registered query of the engine against its SQL on the smallest tables."""

import glob
import hashlib
import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stratalex import queries as engine
from stratalex.functions import text as functions
from stratalex.operators import edits
from stratalex.sources import clike


@pytest.fixture(scope="module")
def sql(data):
    c = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(engine.queries()))
def test_query_equals_sql(spark, sql, data, name):
    df = engine.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = sql.execute(engine.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall()), key=repr)


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["path", "size"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_push_down_and_prune(spark, data):
    plan = engine.queries()["where_numeric_range"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(p_size)" in plan or "GreaterThanOrEqual(p_size,10)" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string,p_size:int>" in plan
    first = engine.queries()["group_first_row"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in first and "partial_min_by" in first  # rows are put together before they are shuffled
    assert "TakeOrderedAndProject" in engine.queries()["offset_limit"](spark, data)._jdf.queryExecution().executedPlan().toString()


DOCS = "doc_id long, text string, lang string, source string"


def test_words_of_every_script_are_replaced(spark, tmp_path):
    texts = {
        "": "", "the": "THE", "the the\nthe": "THE THE\nTHE", "the été the_ thé éthe theé (the)": "THE été the_ thé éthe theé (THE)",
        "ü the, the\u203f the\u0301 中the 9the the9 —the—": "ü THE, the\u203f the\u0301 中the 9the the9 —THE—", "other lathe then": "other lathe then",
    }
    spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.rev for r in engine.queries()["matching_word_replace"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts.values())}


def test_callees_of_every_order(spark, tmp_path):
    spark.createDataFrame([(k, 1) for k in (3, 499, 501, 10**10)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    items = [(3, 7, 1), (3, 7, 1), (3, 7, 2), (499, 8, 1), (501, 7, 1), (501, 9, 2), (10**10, 3, 1)]
    spark.createDataFrame(items, "l_orderkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = engine.queries()["callees"](spark, str(tmp_path)).select("caller", "callee", "line").collect()
    assert sorted(map(tuple, got)) == sorted(set(items))


def test_whole_tables_of_documents_and_parts(spark, tmp_path):
    text = "".join(f"word{i} x yy\n" for i in range(1, 11))
    places = [(5, "src100"), (15, "src1"), (25, "src2"), (7, "src3")]
    spark.createDataFrame([(i, text, "en", s) for i, s in places], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("a", "t", 46), ("b", "t", 3), ("c", "u", 1)], "p_name string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    run = lambda name: engine.queries()[name](spark, str(tmp_path))
    paths = {f"{s}/en/{i}.txt" for i, s in places}
    assert {r.path for r in run("in_glob").collect()} == {"src100/en/5.txt", "src1/en/15.txt"}
    got = run("token_line_positions").select("name", "path", "line", "pos").collect()
    assert sorted(map(tuple, got)) == sorted((n, p, i, k) for p in paths for i in range(1, 11) for k, n in enumerate((f"word{i}", "yy")))
    got = run("context_window_lines").select("path", "line", "text", "marker").collect()
    assert {tuple(r) for r in got} == {(p, i, f"word{i} x yy", ">>>" if i == 4 else None) for p in paths for i in range(2, 7)}
    got = run("line_range").select("path", "line", "text").collect()
    assert {tuple(r) for r in got} == {(p, i, f"word{i} x yy") for p in paths for i in range(3, 9)}
    assert {(r.fql_kind, r.rows) for r in run("compact_symbols_by_kind").collect()} == {("t", "a:46;b:3"), ("u", "c:1")}


def test_paren_depth_equals_brute_force(spark, tmp_path):
    r = random.Random(3)
    texts = ["", "()", "((a)(b(c)))", ")(", "(" * 300 + ")" * 300, *("".join(r.choice("(()) aé\n") for _ in range(r.randint(0, 60))) for _ in range(200))]
    spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")

    def depth(t):
        now = most = 0
        for c in t:
            now = now + 1 if c == "(" else max(now - 1, 0) if c == ")" else now
            most = max(most, now)
        return most

    got = {x.doc_id: x.nested for x in engine.queries()["paren_depth"](spark, str(tmp_path)).collect()}
    assert got == {i: depth(t) for i, t in enumerate(texts)} and max(got.values()) == 300


def test_depths_beyond_64_levels(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None) for i in range(70)], "node long, parent long").coalesce(1)
    assert {(r.node, r.depth) for r in edits.depths(nodes).collect()} == {(i, i) for i in range(70)}


def test_mixed_logic_of_any_nesting(spark):
    r = random.Random(4)

    def condition(n):
        if n == 0 or r.random() < 0.1:
            return r.choice(("a", "f()", "(b)", "g(x)(y)"))
        ops = f" {r.choice(('&&', '||'))} ".join(condition(n - 1) for _ in range(r.randint(1, 2)))
        return f"({ops})" if r.random() < 0.8 else ops

    deep = "(" * 9 + "p || q" + ")" * 9 + " && r"
    texts = [deep, f"({deep})", "(a && b) || (c && d)", "a && b || c", "((a && b || c))", "(a && b)(c || d)", *(condition(8) for _ in range(200))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(functions.mixed_logic(functions.F.col("t"))).collect()
    want = [all(op in clike.top_level(t) for op in ("&&", "||")) for t in texts]
    assert [x[0] for x in got] == want and set(want) == {True, False} and want[:2] == [False, False]


def test_distinct_rows_of_shared_paths(spark, tmp_path):
    texts = [(1, "ab cd ab\nab"), (2, "xx\n\nyy xx xx"), (2, "xx zz\nqq"), (3, "a"), (4, None)]
    spark.createDataFrame([(i, t, "en", "s") for i, t in texts], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.path: r.distinct_rows for r in engine.queries()["distinct_rows_per_file"](spark, str(tmp_path)).collect()}
    assert got == {"s/en/1.txt": 3, "s/en/2.txt": 5}
    spark.createDataFrame([(i, t, "en", "s") for i, t in texts[:2]], DOCS).write.parquet(f"{tmp_path}/one/documents.parquet")
    df = engine.queries()["distinct_rows_per_file"](spark, f"{tmp_path}/one")
    assert {r.path: r.distinct_rows for r in df.collect()} == {"s/en/1.txt": 3, "s/en/2.txt": 3}
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "partial_sum" in plan and "name#" not in plan  # names are counted where they are read, none is shuffled


def test_ordinals_go_on_by_tiers(spark, data):
    from stratalex.operators import relations

    r = random.Random(5)
    pick = lambda: r.choice(["a", "b", None])
    old = [(p, k, n, pick(), pick()) for p in range(40) for k, n in zip(r.sample(range(20), 6), r.sample(range(50), 6)) if r.random() < 0.8]
    new = [(p, k, pick(), pick()) for p in range(42) for k in r.sample(range(20), 6)]
    want = {}
    for p in {x[0] for x in new}:
        a, b = sorted((x for x in old if x[0] == p), key=lambda x: x[1]), sorted((x for x in new if x[0] == p), key=lambda x: x[1])
        top = max((x[2] for x in a), default=-1)
        for keys in (lambda x: x[-2:], lambda x: x[-1:]):
            waiting = {}
            for x in a:
                waiting.setdefault(keys(x), []).append(x)
            for x in [*b]:
                if None not in keys(x) and waiting.get(keys(x)):
                    y = waiting[keys(x)].pop(0)
                    want[x[:2]] = y[2]
                    a.remove(y)
                    b.remove(x)
        for i, x in enumerate(b, 1):
            want[x[:2]] = top + i
    olds = spark.createDataFrame(old, "path long, pos int, ordinal int, name string, kind string")
    for more in ([], [F.lit("z").alias("other")]):
        news = spark.createDataFrame(new, "path long, pos int, name string, kind string").select("*", *more)
        got = relations.remapped(olds, news, [["name", "kind"], ["kind"]])
        assert {(x.path, x.pos): x.ordinal for x in got.collect()} == want and len(got.columns) == 5 + len(more)
    plan = engine.queries()["ordinal_remap"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and "Join" not in plan
