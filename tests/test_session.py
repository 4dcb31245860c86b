import hashlib
import json
import os
import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from stratalex.lang.statement import Clauses, QueryError
from stratalex.plans import clauses as C
from stratalex.plans import predicates as P
from stratalex.lang.statement import Predicate
from stratalex.operators import edits, render
from stratalex.plans.shapes import SHAPES
from stratalex.session import Session
from stratalex.sources import clike, corpus, formats, index
from stratalex.streaming import ingest

PUMP = '''// controls
#include <stdio.h>
#define MAX(a, b) ((a) > (b) ? (a) : (b))
/** A pump. */
struct Pump { int rate; void start(); };
static int counter = 0;
#ifdef FAST
int speed = 0xE1;
#else
int speed = 2;
#endif
int run(int n, int unused) {
    // TODO: é tidy, FIXME
    if (n <= 1 && n > 0 || n == 7) return 1;
    int x = MAX(n, 5);

    x += 1 << 3;
    for (int i = 0; i < n; i++) { int x = (int) n; }
    switch (n) { case 1: x = 2; case 2: break; default: x = 1; }
    if (n == 1) { x++; }
    if (n == 1) { x--; }
    return n * run(n - 1, 0);
}
int *leak() { int local = 3; return &local; }
'''
FILES = {
    "src/pump.cpp": PUMP, "src/area.rs": "pub struct P { pub x: i32, y: u8 }\nimpl P { pub fn area(&self, k: i32) -> i32 { self.x as i32 * k } }\n",
    "tools/gen.py": "import os\n\nclass Gen:\n    size = 4\n\n    def emit(self, a, b):\n        return self.emit(a, run(2))\n", "conf/a.json": '{"a": {"b": [1, 2]},\n "run": "x"}\n',
    "conf/b.yaml": "a:\n  b: 1\nc: [x]\n", "conf/c.toml": "[t]\nk = 1\n", "conf/d.ini": "; c\n[s]\nk = v\n", "conf/e.xml": "<A><SHORT-NAME>nm</SHORT-NAME>\n<B name='q'/></A>\n",
    "docs/g.md": "# Run\nhow to run it\n\n## Stop\n- a run\n```c\nx\n```\n", "docs/h.rst": "Title\n=====\n\ntext\n", "CMakeLists.txt": "set(A b)\nfunction(f)\nadd_x(y)\n", "bad.py": "def (:\n",
    "x.dbc": "BO_ 5 Msg: 8 X\n SG_ Sig : 0|8@1+\n", "Makefile": "CC = gcc\nall: x\n", "Kconfig": "config FOO\n", "justfile": "a := 'b'\nbuild:\n", "notes.txt": "run k_sleep my_k_sleep ék_sleep\n",
}


@pytest.fixture()
def session(spark):
    return Session(spark, spark.createDataFrame(list(FILES.items()), "path string, content string"))


def names(df, column="name"):
    return [r[column] for r in df.collect()]


def test_find_symbols_and_fields(session):
    run = session.run
    assert names(run("FIND symbols WHERE fql_kind = 'function' IN 'src' ORDER BY name ASC")) == ["area", "leak", "run"]
    row = run("FIND symbols WHERE name = 'run' WHERE fql_kind = 'function'").first()
    f = row["fields"]
    assert f["param_count"] == "2" and f["unused_params"] == "unused" and f["is_recursive"] == "true" and f["todo_tags"] == "FIXME,TODO"
    assert f["has_fallthrough"] == "true" and f["shadow_vars"] == "x" and f["naming"] == "flatcase" and f["max_condition_tests"] == "3" and row["usages"] >= 3
    assert names(run("FIND symbols WHERE has_escape = 'true'")) == ["leak"]
    assert run("FIND symbols WHERE guard_defines = 'FAST' WHERE name = 'speed'").count() == 1
    assert run("FIND symbols WHERE mixed_logic = 'true'").first()["name"] == "a <= b && a > c || a == d"
    assert run("FIND symbols WHERE duplicate_condition = 'true'").count() == 2
    assert run("FIND symbols WHERE fql_kind = 'number' WHERE num_value = 225 LIMIT 5").first()["fields"]["is_magic"] == "false"
    assert run("FIND symbols WHERE cast_style = 'c_style'").first()["name"] == "c_style<int>"
    assert set(names(run("FIND globals LIMIT 50"))) >= {"counter", "speed"}
    assert names(run("FIND symbols WHERE fql_kind = 'struct' ORDER BY name ASC")) == ["P", "Pump"]
    assert run("FIND symbols WHERE key_path = 'a.b' ORDER BY path").count() == 2
    assert run("FIND symbols WHERE fql_kind = 'error'").first()["path"] == "bad.py"
    by = {r["fql_kind"]: r["count"] for r in run("FIND symbols GROUP BY kind").collect()}
    assert by["section"] == 3 and by["class"] == 2
    assert run("FIND symbols").count() == 20


def test_usages_read_text_and_label_roles(session):
    rows = {(r["path"], r["line"]): r["role"] for r in session.run("FIND usages OF 'run'").collect()}
    assert rows[("src/pump.cpp", 12)] == "code" and rows[("docs/g.md", 2)] == "doc" and rows[("conf/a.json", 2)] == "config"
    assert [r["line"] for r in session.run("FIND usages OF k_sleep").collect()] == [1]
    assert session.run("FIND usages OF 'run' LIMIT 1").select("path").distinct().count() == 1
    assert session.run("FIND usages OF 'run' GROUP BY path").count() == len({p for p, _ in rows})


def test_files_and_nodes(session):
    run = session.run
    assert names(run("FIND files WHERE extension = 'py' ORDER BY size ASC"), "path") == ["bad.py", "tools/gen.py"]
    assert names(run("FIND files WHERE has_error = 'true'"), "path") == ["bad.py"]
    assert {r["path"]: r["count"] for r in run("FIND files DEPTH 1 LIMIT 50").collect()}["conf/"] == 5
    node = run("FIND symbols WHERE name = 'leak'").first()["node_id"]
    assert names(run(f"SHOW NODE {node}"), "text") == ["int *leak() { int local = 3; return &local; }"]
    assert run(f"FIND NODE {node}").first()["prev_sibling"] is not None
    with pytest.raises(QueryError):
        run(f"SHOW NODE '{node}(5)'")


def test_show(session):
    run = session.run
    assert names(run("SHOW LINES 1-2 OF 'src/pump.cpp'"), "text") == ["// controls", "#include <stdio.h>"]
    assert run("SHOW signature OF run").first()["signature"] == "int run(int n, int unused)"
    assert "{ }" in run("SHOW body OF run").first()["text"] and run("SHOW body OF run DEPTH 9 WHERE text MATCHES 'return'").count() == 2
    assert [r["marker"] for r in run("SHOW context OF leak LINES 1").collect()] == [None, ">>>"]
    assert set(names(run("SHOW members OF Pump"), "text")) == {"rate", "start"}
    assert set(names(run("SHOW callees OF run"))) >= {"MAX", "run"}
    depth = {r["name"]: r["depth"] for r in run("SHOW outline OF 'src'").collect()}
    assert depth["Pump"] == 0 and depth["rate"] == 1 and depth["area"] == 1
    run("SHOW LINES 1-9 OF 'src/pump.cpp'")
    assert run("SHOW MORE TAIL 2").count() == 2 and run("SHOW MORE 2-4 WHERE text MATCHES 'define'").count() == 1
    assert run("SHOW STATS").count() > 5 and run("SHOW VERSION").count() == 1
    for bad in ("SHOW LINES 900-901 OF 'src/pump.cpp'", "SHOW body OF nobody", "FIND symbols WHERE name MATCHES '('", "SHOW LINES 1-2 OF 'x' ORDER BY line"):
        with pytest.raises(QueryError):
            run(bad)


def test_edits_undo_and_transactions(session):
    run, text = session.run, lambda p: session.files.filter(F.col("path") == p).first()["content"]
    assert [tuple(r) for r in run("CHANGE FILE 'src/pump.cpp' MATCHING WORD 'counter' WITH 'ticks'").collect()] == [("src/pump.cpp", "M", 1, 1)]
    assert "int ticks = 0" in text("src/pump.cpp")
    run("CHANGE FILE 'conf/b.yaml' LINES 1-2 WITH 'z: 1'")
    assert text("conf/b.yaml") == "z: 1\nc: [x]\n"
    assert run("SHOW DIFF STAT").count() == 2 and run("SHOW DIFF WHERE text MATCHES 'ticks'").count() == 1
    run("UNDO")
    assert text("conf/b.yaml") == FILES["conf/b.yaml"]
    run("BEGIN TRANSACTION 't'")
    run("INSERT NODE FOR 'new/n.txt' WITH 'hello'")
    run("COPY LINES 1-1 OF 'conf/c.toml' TO 'new/n.txt' AT LINE 1")
    assert text("new/n.txt") == "[t]\nhello"
    run("MOVE LINES 1-1 OF 'new/n.txt' TO 'conf/d.ini'")
    assert text("new/n.txt") == "hello" and text("conf/d.ini") == FILES["conf/d.ini"] + "[t]\n"
    run("ROLLBACK")
    assert session.files.filter("path = 'new/n.txt'").isEmpty() and "ticks" in text("src/pump.cpp")
    node = run("FIND symbols WHERE name = 'leak'").first()["node_id"]
    with pytest.raises(QueryError):
        run(f"CHANGE NODE {node} IF REV 'h0' WITH 'x'")
    run(f"CHANGE NODE {node} MATCHING 'local' WITH 'mine'")
    assert "return &mine;" in text("src/pump.cpp")
    node = run("FIND symbols WHERE name = 'leak'").first()["node_id"]
    run(f"INSERT BEFORE NODE {node} WITH '// é note'")
    assert "// é note\nint *leak()" in text("src/pump.cpp")
    node = run("FIND symbols WHERE name = 'leak'").first()["node_id"]
    other = run("FIND symbols WHERE name = 'Pump' WHERE kind = 'struct'").first()["node_id"]
    run(f"MOVE NODE {node} BEFORE NODE {other}")
    assert text("src/pump.cpp").index("*leak()") < text("src/pump.cpp").index("struct Pump") and text("src/pump.cpp").count("*leak()") == 1
    node = run("FIND symbols WHERE name = 'leak'").first()["node_id"]
    run(f"MOVE NODE {node} TO 'src/leak.c'")
    assert "leak" not in text("src/pump.cpp") and text("src/leak.c").startswith("int *leak()")
    run("COMMIT MESSAGE 'moved'")
    assert run("SHOW COMMITS").first()["subject"] == "moved" and run("SHOW DIFF STAT").count() == 0
    with pytest.raises(QueryError):
        run("CHANGE FILE '../x' WITH 'y'")


def test_found_sets(session):
    run = session.run
    with pytest.raises(QueryError):
        run("DELETE NODES FOUND")
    run("FIND files IN 'docs'")
    rev = session.master_rev()
    run(f"CHANGE NODES FOUND IF REV '{rev}' MATCHING 'run' WITH 'go'")
    assert "how to go it" in session.files.filter("path = 'docs/g.md'").first()["content"]
    run("FIND files IN 'docs'")
    with pytest.raises(QueryError):
        run(f"DELETE NODES FOUND IF REV '{rev}'")
    run("MOVE NODES FOUND TO 'old'")
    assert session.files.filter("path like 'old/%'").count() == 2 and session.files.filter("path like 'docs/%'").isEmpty()
    assert "leak" in session.rendered("FIND symbols WHERE kind = 'function'") and session.rendered("FIND files LIMIT 1", "json").startswith("[{")
    assert session.rendered("FIND usages OF run").startswith('"file"')


def test_null_rules(spark):
    df = spark.createDataFrame([("a", "007"), ("b", "+5"), ("c", " 5"), ("d", "1.5"), ("e", "9" * 20), ("f", None), ("g", "É_x")], "path string, v string")
    from stratalex.plans.shapes import shape_of

    shape = shape_of(df)
    ask = lambda op, value, batch=True: {r["path"] for r in df.filter(P.compiled(Predicate("v", op, value), shape.text("v"), shape.number("v"), batch)).collect()}
    assert ask("=", 5) == {"b"} and ask(">=", 5) == {"a", "b"} and ask("!=", 5) == {"a"} and ask("=", True) == set() == ask("!=", True)
    assert ask("!=", "007") == set("bcdeg") and ask("LIKE", "É\\_X") == set() and ask("LIKE", "É_X") == {"g"} and ask("LIKE", "é%") == set()
    assert ask("NOT MATCHES", "5") == {"a", "e", "f", "g"} and ask("NOT MATCHES", "5", False) == {"a", "e", "g"}
    assert ask("MATCHES", ".{4,}") == {"e", "g"} and ask("MATCHES", r"^\w_x$") == {"g"}


def test_decoding_and_directory(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.txt").write_bytes("héllo\nké".encode())
    (tmp_path / "a/u16.txt").write_bytes("hi".encode("utf-16"))
    (tmp_path / "bin.dat").write_bytes(b"a\0b")
    (tmp_path / "u32.txt").write_bytes("hi".encode("utf-32"))
    (tmp_path / "latin.txt").write_bytes(b"caf\xe9")
    got = {r["path"]: r["content"] for r in corpus.from_directory(spark, str(tmp_path)).collect()}
    assert got == {"a/x.txt": "héllo\nké", "a/u16.txt": "hi", "latin.txt": "caf�"}


def test_folding_and_readers():
    assert formats.folded("c", "int f() {\n  if (x) {\n    y;\n  }\n}", 1)[1][1] == "  if (x) { }"
    assert formats.folded("c", "int f() {\n  y;\n}", 0) == [(0, "int f() { }")]
    for path, content in FILES.items():
        language, rows = formats.read(path, content)
        assert rows or language == "text"
        assert all(-1 <= r.parent < len(rows) for r in rows)


def test_file_pages_keep_whole_files(spark):
    df = spark.createDataFrame([(p, i) for p, n in (("a", 5), ("b", 3), ("c", 9), ("d", 1)) for i in range(n)], "path string, line int")
    page = lambda *a, **k: {r["path"] for r in C.file_pages(df, *a, **k).collect()}
    assert page(2) == {"a", "b"} and page(2, 1) == {"b", "c"} and page(None, 0, 4) == {"a"} and page(None, 0, 8) == {"a", "b"}
    assert SHAPES["usage"].strings


def test_stream_of_versions(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    schema = "path string, content string, version long"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    put([("a", "1", 1), ("b", "1", 1), ("a", "2", 2)])
    for expect, rows in (({"a": "2", "b": "1"}, None), ({"a": "2", "b": "3", "c": "1"}, [("b", "3", 3), ("c", "1", 1), ("a", "0", 1)])):
        if rows:
            put(rows)
        ingest.upserted(spark, spark.readStream.schema(schema).parquet(source), store, str(tmp_path / "check")).awaitTermination(120)
        last = max(tmp_path.joinpath("store").glob("v*"), key=lambda p: int(p.name[1:]))
        assert {r["path"]: r["content"] for r in spark.read.parquet(str(last)).collect()} == expect


def test_macros_blocks_and_declared_fields(spark):
    c = """#include <a.h>
#include <b.h>
#define SQ(x) ((x) * (x) + xx)
#define ADDR &global
#define SQ(x, y) (x)
// one
// two
/* three */
static const int limit = 10u;
int proto(int a);
int f(int n) {
    int far = n;

    if (n) {
        n = SQ(n + $1);
        return far + SQ(1, 2, 3) + ADDR() + plain(n);
    }
    return 0;
}
"""
    cpp = "class A {\n  int hidden;\npublic:\n  void go(int);\n};\n"
    s = Session(spark, spark.createDataFrame([("a.c", c), ("b.cpp", cpp), ("j.json", "[" + ",\n".join(["[1]"] * 9) + "]"), ("e.py", "def (:\n")], "path string, content string"))
    rows = s.symbols.collect()
    one = lambda name, kind, k=0: [r for r in rows if r["name"] == name and r["fql_kind"] == kind][k]
    calls = {(r["name"], r["fields"]["argument_count"]): r["fields"] for r in rows if r["fql_kind"] == "macro_call"}
    assert set(calls) == {("SQ", "1"), ("SQ", "3"), ("ADDR", "0")}
    sq = calls["SQ", "1"]
    assert sq["macro_expansion"] == "((n + $1) * (n + $1) + xx)" and sq["macro_def_line"] == "3" and sq["macro_arity"] == "1" and sq["expanded_reads"] == "xx"
    assert calls["ADDR", "0"]["expanded_has_escape"] == "true" and calls["ADDR", "0"]["expansion_depth"] == "0"
    assert calls["SQ", "3"]["expansion_failed"] == "true" and calls["SQ", "3"]["expansion_failure_reason"] == "budget_exhausted"
    assert {(r["line"], r["name"]) for r in s.run("SHOW callees OF f").collect()} >= {(16, "plain"), (15, "SQ")}
    block = one("comment_block", "comment_block")
    assert block["line"] == 6 and block["end_line"] == 7 and block["node_id"].endswith(one("// two", "comment")["fields"]["block_ord"]) and one("// two", "comment")["fields"]["block_off"] == "2"
    assert one("include_block", "include_block")["end_line"] == 2 and one("macro_block", "macro_block")["fields"]["block_label"].endswith("(3)")
    assert [r["name"] for r in rows if r["fql_kind"] == "array_block"] == ["array_block"]
    f = one("limit", "variable")["fields"]
    assert f["storage"] == "static" and f["binding_kind"] == "variable" and "is_exported" not in f and one("proto", "variable")["fields"]["binding_kind"] == "function"
    f = one("f", "function")["fields"]
    assert f["decl_far_conditional"] == "true" and f["has_unused_reassign"] == "false" and len(f["content_hash"]) == 16 == len(f["first_body_statement_fingerprint"])
    assert one("hidden", "field")["fields"]["visibility"] == "private" and one("go", "field")["fields"]["visibility"] == "public"
    assert one("go", "field")["fields"]["body_symbol"] == "A::go" and one("go", "field")["fields"]["owner_kind"] == "class_specifier"
    assert int(one("def (:", "error")["fields"]["error_bytes"]) == 6
    assert {r["name"]: r["depth"] for r in s.run("SHOW outline OF 'b.cpp'").collect()} == {"A": 0, "hidden": 1, "go": 1}


def test_line_edits_leave_all_other_bytes_alone(spark):
    r = random.Random(4)
    texts = ["", "one", "one\n", "one\r\ntwo\r\nthree", "a\n\n\nb", "\n", "\r\n\r\n", *("".join(r.choice(["a", "é", "\n", "\r\n", " "]) for _ in range(r.randint(0, 30))) for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string").coalesce(1)
    c = F.col("content")

    def pieces(t):
        return [x for x in re.split(r"(?<=\n)", t) if x]

    def whole(t):
        return t if not t or t.endswith("\n") else t + "\n"

    for first, last, new in ((1, 1, "N"), (2, 3, "x\ny\n"), (1, 2, ""), (4, 4, "z")):
        got = {x.id: (x.a, x.b) for x in df.select("id", edits.lines_changed(c, first, last, new).alias("a"), edits.lines_inserted(c, edits.lines_of(c, first, last), first).alias("b")).collect()}
        for i, t in enumerate(texts):
            p = pieces(t)
            head, tail = "".join(p[: first - 1]), "".join(p[last:])
            lead = "\n" if first > 1 and len(p) < first and new and t and not t.endswith("\n") else ""
            assert got[i][0] == head + lead + whole(new) + tail
            block, at = "".join(p[first - 1 : last]), "".join(p[:first])
            lead = "\n" if block and at == t and t and not t.endswith("\n") else ""
            assert got[i][1] == at + lead + whole(block) + t[len(at) :]


def test_every_edit_replaces_one_range(spark):
    files = {"w.txt": "one\r\ntwo\r\nthree", "j.json": '{"a": {"x": [1, 2]},\n "b": 1,\n "c": "q"}\n', "y.yaml": "a:\n  b: 1\n# n\nc: [x]\n", "t.toml": "[t]\nk = [1,\n 2]\n\n[u]\nz = 1\n", "m.md": "# A\r\ntext\r\n\r\n# B\r\nx\r\n", "i.ini": "[s]\nk=1\n\n[t]\nz=2\n", "p.py": "def f():\n    return 1\n\ndef g():\n    return 2\n"}
    s = Session(spark, spark.createDataFrame(list(files.items()), "path string, content string"))
    text = lambda p: s.files.filter(F.col("path") == p).first()["content"]
    s.run("CHANGE FILE 'w.txt' LINES 1-1 WITH 'ONE'")
    assert text("w.txt") == "ONE\ntwo\r\nthree"
    with pytest.raises(QueryError):
        s.run("CHANGE FILE 'w.txt' LINES 4-4 WITH 'x'")
    with pytest.raises(QueryError):
        s.run("MOVE LINES 1-2 OF 'w.txt' TO 'w.txt' AT LINE 2")
    s.run("MOVE LINES 2-2 OF 'w.txt' TO 'w.txt' AT LINE 1")
    assert text("w.txt") == "two\r\nONE\nthree"
    ids = {(r.path, r.name): r.node_id for r in sorted(s.symbols.filter("node_id is not null").collect(), key=lambda r: -r.pos)}  # a section, not its heading
    assert [r["text"] for r in s.run(f"SHOW NODE {ids['t.toml', 'k']}").collect()] == ["k = [1,", " 2]"]
    s.run(f"DELETE NODE {ids['j.json', 'a']}")
    s.run(f"DELETE NODE {ids['j.json', 'c']}")  # ids outlive the edits before them
    assert text("j.json") == '{"b": 1}\n'
    for path, name, left in (("y.yaml", "a", "\n# n\nc: [x]\n"), ("t.toml", "t", "\n\n[u]\nz = 1\n"), ("m.md", "A", "\r\n\r\n# B\r\nx\r\n"), ("i.ini", "t", "[s]\nk=1\n\n\n"), ("p.py", "f", "\n\ndef g():\n    return 2\n")):
        row = next(r for r in formats.read(path, files[path])[1] if r.name == name)
        assert (files[path][: row.start] + files[path][row.end :]).replace("\r", "") == left.replace("\r", "")
    s.run(f"CHANGE NODE '{ids['p.py', 'g']}(2)' WITH '    return 3'")
    assert text("p.py") == "def f():\n    return 1\n\ndef g():\n    return 3\n"


def test_an_edit_writes_and_reads_one_file(spark, tmp_path):
    body = "int shared_name(int a) { return shared_name(a); }\n"
    files = spark.createDataFrame([(f"d{i % 3}/f{i}.c", f"int only{i};\n" + body) for i in range(30)], "path string, content string")
    s = Session(spark, files, store=str(tmp_path))
    before = {(r.path, r.name, r.fql_kind): (r.node_id, r.usages) for r in s.symbols.collect()}
    had = set(os.listdir(tmp_path))
    s.run("CHANGE FILE 'd1/f4.c' MATCHING 'only4' WITH 'other'")
    rows = s.symbols.collect()
    for name in set(os.listdir(tmp_path)) - had:
        new = spark.read.parquet(f"{tmp_path}/{name}")
        assert new.count() <= 12 and ("path" not in new.columns or new.select("path").distinct().count() <= 1)
    after = {(r.path, r.name, r.fql_kind): (r.node_id, r.usages) for r in rows}
    same = set(before) & set(after)
    assert len(same) == len(before) - 1 and all(before[k] == after[k] for k in same) and ("d1/f4.c", "other", "variable") in after
    s.run("INSERT NODE FOR 'd1/new.c' WITH 'int shared_name;'")
    assert {r.usages for r in s.symbols.filter("name = 'shared_name'").collect()} == {61}
    s.run("CHANGE FILE 'd0/f0.c' WITH NOTHING")
    assert {r.usages for r in s.symbols.filter("name = 'shared_name'").collect()} == {59} and s.files.count() == 30
    s.run("UNDO LAST-2")
    assert {(r.path, r.name, r.fql_kind): (r.node_id, r.usages) for r in s.symbols.collect()} == before
    first = s.run("FIND symbols WHERE path = 'd1/f4.c' WHERE kind = 'function'").first()
    s.run(f"INSERT BEFORE NODE {first['node_id']} WITH 'int early; // é'")
    assert s.run("FIND symbols WHERE path = 'd1/f4.c' WHERE kind = 'function'").first()["node_id"] == first["node_id"]


def test_found_nodes_and_lines(spark):
    code = "int keep(int a) { return a; }\nint drop_a(int b) { return b; }\nint drop_b(int b) { return drop_a(b); }\n"
    s = Session(spark, spark.createDataFrame([("x.c", code), ("y.c", code), ("z.txt", "drop_a here\nand drop_a\n")], "path string, content string"))
    text = lambda p: s.files.filter(F.col("path") == p).first()["content"]
    s.run("FIND symbols WHERE name LIKE 'drop%' WHERE kind = 'function' LIMIT 1")
    with pytest.raises(QueryError):
        s.run("DELETE NODES FOUND")  # three more were not shown
    s.run("FIND symbols WHERE name LIKE 'drop%' WHERE kind = 'function'")
    rev = s.master_rev()
    s.run(f"CHANGE NODES FOUND IF REV '{rev}' MATCHING WORD 'b' WITH 'c'")
    assert text("x.c") == code.replace("int b", "int c").replace("return b", "return c").replace("(b)", "(c)")
    s.run("FIND symbols WHERE name = 'drop_b' IN 'x.c'")
    with pytest.raises(QueryError):
        s.run(f"DELETE NODES FOUND IF REV '{rev}'")
    s.run("MOVE NODES FOUND TO 'w.c'")
    assert "drop_b" not in text("x.c") and text("w.c") == "int drop_b(int c) { return drop_a(c); }\n"
    s.run("FIND usages OF drop_a IN 'z.txt'")
    s.run("DELETE NODES FOUND")
    assert text("z.txt") == "" and "drop_a" in text("y.c")
    s.run("FIND files IN '*.txt'")
    s.run("DELETE NODES FOUND")
    assert s.files.filter("path = 'z.txt'").isEmpty()


def test_found_lines_of_any_number(spark):
    """More sites than any page of 2,000 and spans behind characters of several bytes: all are shown and changed."""
    code = "".join(f"int é_{i}() {{ return old_name({i}); }}\n" for i in range(1500)) + "old_name"
    s = Session(spark, spark.createDataFrame([("a.c", code), ("b.c", code), ("c.c", "int x;\n")], "path string, content string"))
    assert s.run("FIND usages OF old_name").count() == 3002
    assert s.run("FIND usages OF old_name LIMIT 1").count() == 1501 and s.run("FIND usages OF old_name LIMIT 5 OFFSET 1").count() == 1501
    s.run("FIND usages OF old_name LIMIT 10")
    s.run("CHANGE NODES FOUND MATCHING 'old_name' WITH 'new'")
    assert {r.path: r.content for r in s.files.collect()} == {"a.c": code.replace("old_name", "new"), "b.c": code.replace("old_name", "new"), "c.c": "int x;\n"}


def test_line_spans_equal_their_definition(spark):
    texts = ["", "\n", "a", "a\n", "é\n\nbc", "x\r\n\r\ny\n"]
    got = edits.line_spans(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string")).collect()
    for i, t in enumerate(texts):
        mine = sorted((r.line, r.start, r.end) for r in got if r.path == str(i))
        parts = [p + "\n" for p in t.split("\n")]
        assert [t[a:b] for _, a, b in mine] == [*parts[:-1], parts[-1][:-1]] and [n for n, _, _ in mine] == [*range(1, len(parts) + 1)]


def test_diff_of_many_changed_lines_takes_little():
    a = [f"line {i // 2}" if i % 2 else f"old {i}" for i in range(200_000)]
    b = [f"line {i // 2}" if i % 2 else f"new {i}" for i in range(200_000)]
    assert edits.changed_lines(a, b) == (100_000, 100_000)


def test_directories_have_records(spark):
    s = Session(spark, spark.createDataFrame([("a/b/x.c", "int x;\n"), ("a/y.c", "int y;\n")], "path string, content string"))
    handle = "n" + hashlib.sha256(b"a").hexdigest()[:12]
    row = s.run(f"SHOW NODE {handle}").first()
    mark = 0
    for p in (b"a/b/x.c", b"a/y.c"):
        mark ^= int.from_bytes(hashlib.sha256(p).digest()[:8], "little")
    assert (row["path"], row["files"], row["size"], row["rev"]) == ("a", 2, 14, f"h{mark:016x}")
    s.run("CHANGE FILE 'a/y.c' WITH 'int z;'")
    assert s.run(f"SHOW NODE {handle}").first()["rev"] == row["rev"]
    with pytest.raises(QueryError):
        s.run("SHOW NODE n000000000000")


def test_diff_counts_are_those_of_a_longest_common_subsequence(spark):
    r = random.Random(7)

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for _ in range(300):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 12))] for _ in "ab")
        n = common(a, b)
        assert edits.changed_lines(a, b) == (len(b) - n, len(a) - n)
    s = Session(spark, spark.createDataFrame([("a.txt", "x\ny\nz\n")], "path string, content string"))
    s.run("CHANGE FILE 'a.txt' WITH 'z\ny\nx\n'")
    assert [tuple(x) for x in s.run("SHOW DIFF STAT").select("status", "added", "removed").collect()] == [("M", 2, 2)]


def test_readers_by_token():
    rows = formats.read("a.py", 'A = "#no"  # yes\nif A:\n    # in\n    x = 1\n')[1]
    assert [(r.fql_kind, r.name) for r in rows] == [("variable", "A"), ("comment", "# yes"), ("if", "A"), ("comment", "# in"), ("variable", "x"), ("number", "1")]
    assert [r.start for r in rows] == sorted(r.start for r in rows)
    rows = formats.read("a.c", "enum { A = 3 };\nint y = 7;\nint f(int *p) { int k = 9; k = 8; return p[0] + p[1]; }\nint g = make(5);\nint bad( {\n}}\n")[1]
    assert [(r.name, r.fields["is_magic"]) for r in rows if r.fql_kind == "number"] == [("3", "false"), ("7", "false"), ("9", "false"), ("8", "true"), ("0", "false"), ("1", "true"), ("5", "true")]
    assert [(r.name, r.fields["error_scope"]) for r in rows if r.fql_kind == "error"] == [("( {", "nested"), ("}", "file")]
    assert "make" in [r.name for r in rows if r.fql_kind == "call"]
    assert formats.folded("c", "int f() { char c = '{'; char *s = \"}\"; if (x) { y; } return 0; }", 1) == [(0, "int f() { char c = '{'; char *s = \"}\"; if (x) { } return 0; }")]
    python = "    def f(self):\n        if a:\n            return 1\n        return [\n  2]\n"
    assert [t for _, t in formats.folded("python", python, 1)] == ["    def f(self):", "        if a: ...", "        return [", "  2]", ""]
    assert formats.folded("python", python, 0) == [(0, "    def f(self): ...")]


def test_pieces_of_a_text_are_what_the_whole_is():
    """Whatever stands at a cut: conditions, comments, brackets without a partner, types, lines that two functions share."""
    r = random.Random(11)
    parts = [
        "int f{0}(int a, int b) {{ if (a > {0} && b) {{ return f{0}(-a, 2); }} // n\n return x[0]; }}\n", "/** doc */\nint g{0}() {{ return 1; }} int g{0}() {{ int k = 3; k = 4; return k; }}",
        "#ifdef A{0}\n", "#else\n", "#endif\n", "#define M{0}(x) (x + {0})\n#define N{0} {0}\n", "// one\n;\n// two\n", "struct S{0} {{ int a; void m(); }};\n", "struct T{0} {{ int a; }} t{0};\n",
        "int v{0} = -{0}, w[2] = {{ 1, 2 }};\n", "}}\n", "namespace q {{ int h{0}() {{ return 2; }} }}\n", 'extern "C" {{ int e{0}() {{ return 3; }} }}\n', ";", "#include <a.h>\n", "enum E{0} {{ P{0} = 1, Q }};\n", "typedef int I{0};\n", "- 5;\n",
    ]
    for n in range(150):
        text = "".join(r.choice(parts if r.random() < 0.5 else parts[:2]).format(r.randint(0, 9)) for _ in range(r.randint(1, 25))) + ("( [" if n % 5 == 0 else "")
        language = r.choice(["c", "cpp"])
        want = clike.Reader(text, language).scan()
        cut = [*clike.scanned(text, language, r.choice([1, 20, 60]))]
        at, got = 0, []
        for rows in cut:
            got += [replace(x, parent=x.parent + at if x.parent >= 0 else -1) for x in rows]
            at += len(rows)
        assert got == want
        blocks = [(x.fql_kind, x.start, x.end, x.fields.get("block_off")) for x in index.with_blocks(language, want, text)]
        assert blocks == [(x.fql_kind, x.start, x.end, x.fields.get("block_off")) for rows in cut for x in index.with_blocks(language, rows, text)]
    text = "\n".join(f"int f{i}() {{ return {i}; }}" for i in range(200))
    assert len([*clike.scanned(text, "c", 100)]) > 10 and len([*clike.scanned(text, "c")]) == 1


def test_a_long_file_is_read_in_pieces(spark, monkeypatch):
    code = "".join(f"// é {i}\n// two\nint f{i}(int a) {{ return f{i}(a + {i}); }}\n" for i in range(300))
    one = [r for rows in index.rows_of_file("a.c", code) for r in rows]
    monkeypatch.setattr(formats, "scanned", lambda text, language: clike.scanned(text, language, 50))
    many = [*index.rows_of_file("a.c", code)]
    assert len(many) > 50 and [r for rows in many for r in rows] == one
    assert [r[8] for r in one] == [len(code[: r[10]].encode()) for r in one]  # ends in bytes and in characters


def test_long_pages_meet_in_no_task(spark, monkeypatch):
    monkeypatch.setattr(C, "TOP", 50)
    rows = [(f"n{i * 7919 % 300:03d}", i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "name string, line int")
    shape = SHAPES["symbol"]
    for limit, offset, order in ((300, None, None), (1000, None, ("line", True)), (60, None, ("line", False)), (200, 40, ("name", True)), (70, 250, None)):
        got = C.paged(df, Clauses(limit=limit, offset=offset, order_by=order), shape)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrdered" not in plan and "GlobalLimit" not in plan
        key = {None: lambda r: r, "name": lambda r: r, "line": lambda r: (r[1] if order[1] else -r[1], r[0])}[order and order[0]]
        want = sorted(rows, key=key)[offset or 0 :][:limit]
        got = [tuple(r) for r in got.collect()]
        assert (got if order else sorted(got)) == want


def test_values_of_numbers_are_computed_once(spark):
    from stratalex.functions import text

    plan = spark.range(1).select(text.number_value(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rlike") + plan.count("RLIKE") + plan.count("regexp_replace") < 40  # 1,252 when every use read the literal again


def test_trees_of_data_formats_cover_their_text():
    r = random.Random(3)

    def value(depth):
        kind = r.randint(0, 5 if depth else 3)
        if kind == 4:
            return {f"k{i}": value(depth - 1) for i in range(r.randint(0, 3))}
        if kind == 5:
            return [value(depth - 1) for _ in range(r.randint(0, 3))]
        return [r.randint(-9, 9), 'a "]} é', r.random() < 0.5, 1.5][kind]

    def expect(v, path, out):
        for k, x in v.items() if isinstance(v, dict) else enumerate(v):
            here = [*path, str(k)]
            out.append((".".join(here), "object" if isinstance(x, dict) else "array" if isinstance(x, list) else "pair"))
            if isinstance(x, (dict, list)):
                expect(x, here, out)
        return out

    import yaml

    for _ in range(60):
        v = {f"r{i}": value(3) for i in range(3)}
        for indent in (None, 1):
            text = json.dumps(v, indent=indent, ensure_ascii=False)
            rows = formats.read("a.json", text)[1]
            assert [(x.fields["key_path"], x.fql_kind) for x in rows] == expect(v, [], [])
            for x in rows:
                piece = text[x.start : x.end]
                in_array = x.parent >= 0 and rows[x.parent].fql_kind == "array"
                got = json.loads(piece if in_array else "{" + piece + "}")
                want = v
                for k in x.fields["key_path"].split("."):
                    want = want[int(k) if isinstance(want, list) else k]
                assert (got if in_array else got[x.name]) == want
        for style in (True, False, None):
            text = yaml.safe_dump(v, default_flow_style=style, allow_unicode=True, sort_keys=False)
            rows = formats.read("a.yaml", text)[1]
            assert [(x.fields["key_path"], x.fql_kind) for x in rows] == expect(v, [], [])
            assert all(x.start < x.end and (x.parent < 0 or rows[x.parent].end >= x.end) for x in rows)
    toml = 'x = 1 # c\n[t]\ns = """a\nb"""\n\n[t.u]\nz.y = [1,\n  {q = 2, r.s = "}"}, # no\n]\n[[p]]\nn = 1\n[[p]]\nn = \'a]\'\n'
    assert [x.fields["key_path"] for x in formats.read("a.toml", toml)[1]] == ["x", "t", "t.s", "t.u", "t.u.z", "t.u.z.y", "t.u.z.y.0", "t.u.z.y.1", "t.u.z.y.1.q", "t.u.z.y.1.r", "t.u.z.y.1.r.s", "p", "p.0", "p.0.n", "p.1", "p.1.n"]


def test_layouts_hints_and_places_of_lines(spark):
    c = "struct P { int a; void m(); };\nint f(int x) {\n  if (x) { g(x); }\n  return h();\n}\nint k = missing;\n"
    s = Session(spark, spark.createDataFrame([("a.c", c)], "path string, content string"))
    assert s.rendered("FIND symbols WHERE name = 'missing'").startswith("0 symbols, but 1 lines use the name")
    assert "0 symbols" not in s.rendered("FIND symbols WHERE name = 'nowhere'")
    assert s.rendered("SHOW outline OF 'a.c'").split("\n")[:3] == ['"depth","[fql_kind,name,line,node_id]"', f'0,"[""struct"", ""P"", 1, ""{s.symbols.filter("name = \'P\'").first()["node_id"]}""]"'] + [s.rendered("SHOW outline OF 'a.c'").split("\n")[2]]
    assert s.rendered("SHOW callees OF f").split("\n")[1] == '"a.c","[[""g"", 3], [""h"", 4]]"'
    assert s.rendered("SHOW members OF P").startswith('"type","[text,line,node_id]"\n"field",') and s.rendered("FIND files").startswith('"path","size","node_id","rev","error_count","parse_coverage"')
    assert s.rendered("SHOW LINES 5-6 OF 'a.c'") == '"line","text"\n5,"}"\n6,"int k = missing;"\n'
    ids = {r.name: r.node_id for r in s.symbols.filter("node_id is not null").collect()}
    assert [(r["node_id"], r["offset"]) for r in s.run("SHOW LINES 3-6 OF 'a.c'").orderBy("line").collect()] == [(ids["a"], 1), (ids["f"], 3), (ids["f"], 4), (ids["k"], 1)]
    with pytest.raises(QueryError):
        render.as_json(spark.range(1001))


def test_cfg_guards():
    rust = '#[cfg(feature = "x")]\nmod a {\n    #[cfg(not(test))]\n    fn f() {}\n}\n#[cfg(any(unix, windows))]\nfn g() {}\n#[cfg(all(p, q = "1"))]\nfn h() {}\nfn i() {}\n'
    rows = {r.name: r.fields for r in formats.read("a.rs", rust)[1]}
    pick = lambda n: tuple(rows[n].get(k) for k in ("guard", "guard_defines", "guard_negates", "guard_mentions", "guard_kind"))
    assert pick("a") == ('feature = "x"', "feature", None, "feature", "attribute")
    assert pick("f") == ('feature = "x" && !test', "feature", "test", "feature,test", "attribute")
    assert pick("g") == ("any(unix, windows)", None, None, "unix,windows", "attribute") and pick("h")[1] == "p,q" and pick("i")[0] is None


def test_usages_are_counted_only_where_they_are_taken(spark):
    """A statement that names no usages reads index rows alone; a result still has them when they are taken from it."""
    files = [("a.c", "#define TWICE(x) (x + x)\nint ff(int a) { return TWICE(a); }\nint gg(int a) { return ff(ff(a)); }\n"), ("b.c", "int hh() { return gg(1); }\n")]
    s = Session(spark, spark.createDataFrame(files, "path string, content string"))
    out = s.run("FIND symbols WHERE kind = 'function'")
    assert "Join" not in out.select("name", "node_id")._jdf.queryExecution().optimizedPlan().toString()
    assert {r["name"] for r in out.select("name").collect()} == {"ff", "gg", "hh"} and "counts" not in s._first
    want = {"ff": 3, "gg": 2, "hh": 1}
    assert {r["name"]: r["usages"] for r in out.collect()} == want and "counts" not in s._first
    assert [r["name"] for r in s.run("FIND symbols WHERE usages >= 1 WHERE kind = 'function' ORDER BY usages DESC").collect()] == ["ff", "gg", "hh"] and "counts" in s._first
    assert {r["name"]: r["usages"] for r in s.run("FIND symbols WHERE kind = 'function'").collect()} == want
    s.run("CHANGE FILE 'b.c' WITH 'int hh() { return ff(1); }'")
    for statement in ("FIND symbols WHERE kind = 'function'", "FIND symbols WHERE kind = 'function' WHERE usages > 0"):
        assert {r["name"]: r["usages"] for r in s.run(statement).collect()} == {"ff": 4, "gg": 1, "hh": 1}


def test_parts_of_a_file_are_what_the_whole_is():
    """Parts are found by brackets alone and read apart; whatever stands around a cut, their rows are those of the file."""
    r, cuts = random.Random(5), 0
    pieces = [
        "int f{0}(int a, int b) {{ if (a > {0} && b) {{ return f{0}(-a, 2); }} // n\n return x[0]; }}\n", "/** doc é */\nint g{0}() {{ return 1; }} int g{0}() {{ int k = 3; return k; }}", "#ifdef A{0}\n", "#else\n", "#endif\n",
        "#define M{0}(x) (x + {0})\n#define N{0} {0}\n", "// one\n;\n// two\n// {{ three\n", "struct S{0} {{ int a; void m(); }};\n", "struct T{0} {{ int a; }} t{0};\n", "struct U{0} {{ int a; }} u{0}() {{ return 1; }}\n",
        "int v{0} = -{0}, w[2] = {{ 1, 2 }};\n", "int y[] = {{ 1 }}\n", "}}\n", "namespace q {{ int h{0}() {{ return 2; }} }}\n", 'extern "C" {{ int e{0}() {{ return 3; }} }}\n', "for (;;) {{ }}\n", "char *s = \"}} {{\"; char c = '{{';\n", "enum E{0} {{ P{0} = 1'0, Q }};\n",
        "# define B {{ \\\n {{\n", "template <class X> int z{0}(X x) {{ return {0}; }}\n", "int A::m{0}() {{ return 1; }}\n", "int (*p{0})(int);\n", "/* }} */ int i{0}(void) {{ char d = '\"'; return d; }}\r\n",
    ]
    for n in range(300):
        text = "".join(r.choice(pieces if r.random() < 0.5 else pieces[:3]).format(r.randint(0, 9)) for _ in range(r.randint(1, 25))) + ("( [" if n % 7 == 0 else "")
        path = r.choice(["a.c", "a.cpp"])
        want = [x for rows in index.rows_of_file(path, text) for x in rows]
        got, numbers, before, parts = [], 0, 0, [*clike.parts(text, r.choice([1, 60]))]
        assert "".join(text[x.start : x.end] for x in parts) == text
        for part in parts:
            mine = [x for rows in index.rows_of_file(path, text[part.start : part.end], part, before) for x in rows]
            base, top = len(got), numbers
            for x in mine:
                numbers = max(numbers, top + (x[12] or 0))
                fields = {k: f"{int(v) + top:04d}" if k == "block_ord" else v for k, v in x[14].items()}
                got.append((*x[:2], x[2] + base, *x[3:11], x[11] + base if x[11] >= 0 else x[11], x[12] and x[12] + top, x[13], fields))
            before += len(text[part.start : part.end].encode())
        assert got == want
        cuts += len(parts) - 1
    assert cuts > 300


def test_a_corpus_of_long_files_is_read_in_parts(spark, monkeypatch):
    code = "#ifdef A\n" + "".join(f"// é {i}\n// two\nint f{i}(int a) {{ return f{i}(a + {i}); }}\n" for i in range(60)) + "#endif\n"
    files = spark.createDataFrame([("x/a.c", code), ("x/b.json", '{"k": [1, 2]}'), ("Kconfig.c", code)], "path string, content string")
    order = lambda s: sorted(map(str, s.raw.collect()))
    whole = order(Session(spark, files))
    monkeypatch.setattr(index, "LONG", 100)
    monkeypatch.setattr(index, "PART", 200)
    assert index.part_symbols(files).select("path", "part").distinct().count() > 12
    assert order(Session(spark, files)) == whole


def test_groups_of_symbols_read_what_is_taken(spark):
    """A group is its first place and its count; other columns of its first row, and usages, are read only where they are taken."""
    files = [("b.c", "int ff(int a) { return 1; }\n#define M 2\n"), ("a.c", "// c\nint gg(int a) { return ff(M); }\nint ff() { return 3; }\n")]
    s = Session(spark, spark.createDataFrame(files, "path string, content string"))
    out = s.run("FIND symbols GROUP BY kind")
    plan = out.select("fql_kind", "count")._jdf.queryExecution().executedPlan().toString()
    assert "usages" not in plan and "fields#" not in plan
    got = {r["fql_kind"]: (r["path"], r["name"], r["count"], r["usages"], r["fields"].get("lines")) for r in out.collect()}
    assert got == {"comment": ("a.c", "// c", 1, 0, None), "function": ("a.c", "gg", 3, 1, "1"), "number": ("a.c", "3", 2, 0, None), "macro": ("b.c", "M", 1, 0, None)}
    by_name = {r["name"]: (r["path"], r["count"], r["usages"]) for r in s.run("FIND symbols WHERE kind = 'function' GROUP BY name").collect()}
    assert by_name == {"ff": ("a.c", 2, 3), "gg": ("a.c", 1, 1)}


def test_a_reader_looks_up_few_lines(monkeypatch):
    """Tokens know their lines, so rows do not search for them."""
    calls, line = [], clike.Reader.line
    monkeypatch.setattr(clike.Reader, "line", lambda self, at: calls.append(at) or line(self, at))
    code = "".join(f"/** d */\nint f{i}(int a, int b) {{\n  if (a > 3 && b != {i}) {{ return g(a + f{i}(1, 2)); }}\n  return a;\n}}\n" for i in range(50))
    rows = [x for piece in clike.scanned(code, "c") for x in piece]
    assert len(rows) == 50 * 9 and len(calls) <= 50 * 4
    assert [(t.line, t.end) for t in clike.lexed('a\n"b\\\nc" /* d\n*/ e\n')] == [(1, 1), (2, 8), (3, 16), (4, 18)]


def test_plain_numbers_are_what_all_patterns_say(spark):
    from stratalex.functions import text

    r = random.Random(3)
    some = ["0", "00", "08", "7", "10", "123456789012345678", "1234567890123456789", "9" * 19, "1_0", "1'0", "5u", "5UL", "1f", "1e3", "1.5", "0x1F", "0b1", "1\n", "-3", "12i8"]
    some += ["".join(r.choice("0123456789xXuUlLfeE._'") for _ in range(r.randint(1, 6))) for _ in range(300)] + [str(r.randrange(10 ** r.randint(1, 20))) for _ in range(100)]
    given = [("a.c", "c", i, n, "number", 1, 1, 0, 1, 0, 1, -1, None, True, {}) for i, n in enumerate(some)]
    raw = spark.createDataFrame(given, index.RAW)
    n = F.col("name")
    rows = index.symbols(raw, None, raw.limit(0)).select("pos", "name", "fields", text.number_format(n).alias("f"), text.number_value(n).cast("string").alias("v"), text.number_suffix(n).alias("s")).collect()
    plain = 0
    for x in rows:
        assert [x["fields"].get(k) for k in ("num_format", "num_value", "num_suffix")] == [x["f"], x["v"], x["s"]], x
        plain += re.fullmatch(index.PLAIN.replace(r"\z", ""), x["name"]) is not None
    assert len(rows) == len(some) and plain > 60


def test_folders_with_their_sums_need_no_index(spark):
    files = [("a/x.c", "int f() { return 1; }\n"), ("a/b/y.c", "int g( { return 2; }\n"), ("z.md", "# t\n")]
    s = Session(spark, spark.createDataFrame(files, "path string, content string"))
    assert {(r["path"], r["count"], r["size"]) for r in s.run("FIND files DEPTH 1 LIMIT 10").collect()} == {("a/", 2, 43), ("z.md", 1, 4)} and "raw" not in s._first
    assert [(r["path"], r["count"]) for r in s.run("FIND files WHERE error_count > 0 DEPTH 1").collect()] == [("a/", 1)] and "raw" in s._first


def test_macro_definitions_are_a_small_table(spark, tmp_path):
    c = "#define TWICE(x) (x + x)\n" + "".join(f"int f{i}(int a) {{ return TWICE(a) + g(a); }}\n" for i in range(20))
    s = Session(spark, spark.createDataFrame([("a.c", c)], "path string, content string"), store=str(tmp_path))
    assert s.run("FIND symbols WHERE kind = 'macro_call' LIMIT 50").count() == 20
    assert [p.name.split("-")[0] for p in tmp_path.iterdir() if p.name.startswith("definitions")] == ["definitions"]


def test_macro_calls_are_sought_once(spark, tmp_path):
    """What expands them reads the calls that meet a macro, not all rows again."""
    c = "#define TWICE(x) (x + x)\nint f(int a) { return TWICE(a) + g(a); }\n"
    s = Session(spark, spark.createDataFrame([("a.c", c)], "path string, content string"), store=str(tmp_path))
    rows = index.macro_calls(s.first("raw"), s.first("raw"), s.kept)
    assert [(r["name"], r["fields"]["macro_expansion"]) for r in rows.collect()] == [("TWICE", "(a + a)")]
    assert {f.split("/")[-2].split("-")[0] for f in rows.inputFiles()} == {"definitions", "calls"}


def test_tokens_behind_blanks():
    """Blanks go with the token behind them, but an indented preprocessor line keeps its own, and only at the start of a line."""
    text = '  # a\nx  # y\n\t #b\\\n c\r\n \tLimit r"s" r u8"é" .5;\n\n  #'
    got = clike.lexed(text)
    assert [(t.kind, t.text, t.line) for t in got] == [
        ("pre", "  # a", 1), ("name", "x", 2), ("op", "#", 2), ("name", "y", 2), ("pre", "\t #b\\\n c\r", 3),
        ("name", "Limit", 5), ("string", 'r"s"', 5), ("name", "r", 5), ("name", "u8", 5), ("string", '"é"', 5), ("number", ".5", 5), ("op", ";", 5), ("pre", "  #", 7),
    ]
    assert all(text[t.at : t.end] == t.text for t in got)
