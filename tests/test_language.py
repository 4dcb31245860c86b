import pytest

from stratalex.lang.parser import parse, program
from stratalex.lang.statement import Predicate, QueryError
from stratalex.plans import clauses as C
from stratalex.plans.predicates import glob_regex, regex
from stratalex.plans.shapes import SHAPES


def test_clauses_and_aliases():
    s = parse("FIND symbols WHERE kind = 'function' AND lines >= 20 IN 'src/**' EXCLUDE 'tests' GROUP BY file HAVING count > 2 ORDER BY usages LIMIT 5 OFFSET 2")
    c = s.clauses
    assert s.verb == "find symbols" and c.where == (Predicate("fql_kind", "=", "function"), Predicate("lines", ">=", 20))
    assert (c.within, c.exclude, c.group_by, c.order_by, c.limit, c.offset) == ("src/**", ("tests",), "path", ("usages", False), 5, 2)
    assert parse("FIND files IN 'a' IN 'b'").clauses.within == "b"
    assert parse("FIND globals").clauses.where[1] == Predicate("scope", "=", "file")


def test_literals_are_numbers_then_booleans_then_text():
    value = lambda x: parse(f"FIND symbols WHERE a = {x}").clauses.where[0].value
    assert value("-7") == -7 and value("true") is True and value("'7'") == "7" and value("a/b.c") == "a/b.c" and value("<<T\nx\ny\nT") == "x\ny"
    for bad in ("7x", "trueish"):
        with pytest.raises(QueryError):
            value(bad)


@pytest.mark.parametrize("statement", ["", "FIND", "FIND things", "FIND files WHERE a ~ 1", "FIND files LIMIT x", "SHOW LINES 3 OF a", "FIND files ORDER size", "FIND files WHERE a = 'x"])
def test_bad_statements_are_refused(statement):
    with pytest.raises(QueryError):
        parse(statement)


@pytest.mark.parametrize(
    "statement, shape, how",
    [
        ("FIND symbols WHERE node_kind = 'x'", "symbol", {}), ("FIND symbols WHERE count > 1", "symbol", {}), ("FIND files WHERE lines > 1", "file", {}),
        ("FIND files ORDER BY nothing", "file", {}), ("FIND symbols DEPTH 2", "symbol", {}), ("SHOW LINES 1-2 OF a ORDER BY line", "line", {"shaping": False}),
        ("SHOW LINES 1-2 OF a IN 'b'", "line", {"globs": False}),
    ],
)
def test_unanswerable_clauses_are_refused(statement, shape, how):
    with pytest.raises(QueryError):
        C.refused(parse(statement).clauses, SHAPES[shape], **how)


def test_globs():
    import re

    hit = lambda g, p: bool(re.search(glob_regex(g).replace("\\z", "\\Z"), p))
    assert hit("src", "src/a/b.c") and not hit("src", "src2/a.c") and hit("src/", "src/a.c") and hit("src/*.c", "src/a.c") and not hit("src/*.c", "src/x/a.c")
    assert hit("**/x.c", "x.c") and hit("**/x.c", "a/b/x.c") and not hit("a?c", "abc/d") and hit("README.md", "x/README.md") and hit("*.c", "a/b.c") and not hit("a/*.c", "a/x/b.c")


def test_patterns():
    assert regex("a$") == "(?Ud)a\\z" and regex(r"[$]\$") == r"(?Ud)[$]\$"
    for bad in ("(?=a)", r"(a)\1", "(", "(?<!x)y"):
        with pytest.raises(QueryError):
            regex(bad)


def test_metric_field():
    shape = SHAPES["symbol"]
    field = lambda q: C.metric_field(parse(q).clauses, shape)
    assert field("FIND symbols WHERE naming = 'x' WHERE param_count > 3") == "param_count"
    assert field("FIND symbols WHERE naming = 'x' ORDER BY lines") == "lines" and field("FIND symbols WHERE name = 'x'") is None


def test_forms_of_the_grammar():
    assert [s.verb for s in program("-- two\nFIND files LIMIT 1 SHOW LINES 2 - 4 OF a -- end")] == ["find files", "show lines"]
    assert parse("SHOW LINES 2 - 4 OF a").args["span"] == (2, 4) and parse("SHOW LINES 2-4 OF a").args["span"] == (2, 4)
    s = parse("INSERT AFTER NODE n1 IF REV h2 WITH 'x'")
    assert (s.verb, s.args["side"], s.args["rev"]) == ("insert node", "after", "h2")
    assert parse("MOVE NODE a IF REV h BEFORE NODE b").args == {"id": "a", "side": "before", "anchor": "b", "rev": "h"}
    assert parse("MOVE NODES FOUND IF REV 'r' TO d").args == {"to": "d", "rev": "r"} and parse("COPY NODE a TO b").verb == "copy node to"
    assert parse("CHANGE FILES 'a', 'b' WITH NOTHING").args["mode"] == "delete" and parse("CHANGE FILE 'a' LINES 1-2 NOTHING").args["new"] == ""
    assert parse("VACUUM SOURCE 's' KEEP 2 ALL APPLY").args == {"source": "s", "keep": 2, "all": True, "apply": True}
    assert parse("USE src.main AS 'w'").args == {"source": "src", "branch": "main", "alias": "w"}
    for bad in ("COMMIT 'x'", "USE src AS w", "RUN 'make'", "VERIFY build 'x'", "EXPORT PATCH", "JOB LIST", "UNDO 3", "FIND files FIND", "INSERT NODE BEFORE a WITH 'x'"):
        with pytest.raises(QueryError):
            program(bad)
