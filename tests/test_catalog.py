import pytest

from stratalex.catalog import Catalog
from stratalex.lang.statement import QueryError


def test_sources_sessions_and_vacuum(spark, tmp_path):
    root = tmp_path / "src"
    (root / "v2").mkdir(parents=True)
    (root / "a.c").write_text("int one(void) { return 1; }\n")
    (root / "v2/b.c").write_text("int two(void) { return 2; }\n")
    cat = Catalog(spark, str(tmp_path / "store"))
    with pytest.raises(QueryError):
        cat.run("FIND files")
    rows = cat.run(f"CREATE SOURCE 'p' FROM '{root}' USE p.main AS 'w' FIND symbols WHERE kind = 'function' ORDER BY name ASC")
    assert [r["name"] for r in rows[2].collect()] == ["one", "two"]
    assert {r["branch"] for r in cat.run("SHOW BRANCHES")[0].collect()} == {"main", "v2"}
    assert cat.run("USE p.v2 AS 'x' FIND files")[1].count() == 1 and cat.run("SHOW STATS FOR x")[0].first()["rows"] > 0
    cat.run("CHANGE FILE 'b.c' MATCHING 'two' WITH 'deux' COMMIT MESSAGE 'm1'")
    head = cat.run("SHOW COMMITS")[0].first()["hash"]
    assert [r["path"] for r in cat.run(f"SHOW DIFF STAT OF '{head}'")[0].collect()] == ["b.c"] and cat.run("SHOW DIFF STAT")[0].isEmpty()
    assert cat.run(f"SHOW DIFF OF {head} WHERE text MATCHES 'deux'")[0].count() == 1
    (root / "c.c").write_text("x")
    assert {r["session"]: r["refreshed"] for r in cat.run("REFRESH SOURCE 'p'")[0].collect()} == {"w": True, "x": False}
    assert cat.run("USE p.main AS w FIND files")[1].count() == 3
    old = [r for r in cat.run("VACUUM")[0].collect() if r["action"] == "delete"]
    assert old and [r for r in cat.run("VACUUM APPLY")[0].collect() if r["action"] == "delete"] == old
    assert not [r for r in cat.run("VACUUM")[0].collect() if r["action"] == "delete"] and cat.run("FIND files")[0].count() == 3
    cat.run("CHANGE FILE 'c.c' WITH NOTHING")
    assert cat.run("FIND files ORDER BY path ASC")[0].count() == 2
    for bad in ("USE q.main AS z", "USE p.v9 AS z", "CREATE SOURCE 'p' FROM '/'", "SHOW DIFF OF 'zzz'", "SHOW STATS FOR nobody", "VACUUM SOURCE 'q'"):
        with pytest.raises(QueryError):
            cat.run(bad)
