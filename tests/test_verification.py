"""Facts from Python sources, JSON repair, HTML controls, flows and topology on small cases."""

from gneiss.operators import facts as A
from gneiss.operators import verification as V

SOURCE = '''
import os.path as p, sys
from a import b as c
class Base(dict):
    """Docs."""
class Plain: pass
def _helper(x): return x
def run(a, *, size=1, **rest): return run(a, size=2, other=3)
def strict(a, b=1):
    try:
        strict(1, c=2)
    except ValueError:
        pass
    except:
        raise
'''


def test_facts(spark):
    df = spark.createDataFrame([(1, "x.py", SOURCE), (2, "y.py", "def broken(:\n  pass\nclass K:"), (3, "z.go", "def f(): pass"), (4, "w.py", None), (1, "x.py", SOURCE)], "file_id bigint, file_path string, raw_content string")
    f = A.python_facts(df)
    got = {(r["kind"], r["name"]) for r in f.where("file_id = 1").collect()}
    assert {("class", "Base"), ("function", "_helper"), ("import", "a"), ("call", "strict"), ("handler", "ValueError"), ("handler", "")} <= got
    assert {(r["kind"], r["name"]) for r in f.where("file_id = 2").collect()} == {("function", "broken"), ("class", "K")}
    assert {r["keyword"] for r in A.unknown_keywords(f).collect()} == {"c"}
    assert {r["name"] for r in A.unused_helpers(f).collect()} == {"_helper"}
    assert {r["name"] for r in A.undocumented_classes(f).where("file_id = 1").collect()} == {"Plain"}
    assert A.silent_handlers(f).count() == 1
    assert f.select("file_id").distinct().count() == 2


def test_json_repair():
    assert A.repair_json('x {"a": [1, 2, {"b": "c') == '{"a": [1, 2, {}]}' or A.repair_json('x {"a": [1, 2, {"b": "c').startswith('{"a": [1, 2')
    assert A.repair_json('[1, 2, 3') in ("[1, 2, 3]", "[1, 2]")
    assert A.repair_json('say {"a": 1} end') == '{"a": 1}'
    assert A.repair_json("none") is None and A.repair_json(None) is None and A.repair_json('{"a"') in (None, "{}")


def test_controls(spark):
    df = spark.createDataFrame([(1, '<button onclick="f()">Go</button><button>Dead</button><a href="#">x</a><a href="/y">Y</a>'), (2, None)], "page_id bigint, html string")
    assert [(r["tag"], r["label"], r["handled"]) for r in A.html_controls(df).collect()] == [("button", "Go", True), ("button", "Dead", False), ("a", "x", False), ("a", "Y", True)]


def graph(spark, calls, names):
    e = spark.createDataFrame([(a, b, "CALLS", None) for a, b in calls], "source string, target string, type string, props string")
    n = spark.createDataFrame([(i, "function", name, "r/f.py", 1, 2, "{}") for i, name in names.items()], "id string, type string, name string, file_path string, start_line int, end_line int, props string")
    return n, e


def test_flow(spark):
    n, e = graph(spark, [("1", "2"), ("2", "3"), ("1", "4")], {"1": "main", "2": "load", "3": "check", "4": "save", "5": "other"})
    got = V.verify_flow(n, e, "main", [V.Step(s) for s in ("load", "check", "save", "other", "nothing")]).orderBy("step_no").collect()
    assert [r["status"] for r in got] == ["ordered", "ordered", "in_pipeline", "outside", "missing"]


def test_topology(spark):
    arcs = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("z", "x"), ("c", "c")], "a string, b string")
    assert {(r["id"], r["depth"]) for r in V.topological_layers(arcs, local=0).collect()} == {(r["id"], r["depth"]) for r in V.topological_layers(arcs).collect()}
    assert {(r["id"], r["depth"]) for r in V.topological_layers(arcs).collect()} == {("c", 0), ("b", 1), ("a", 2), ("x", None), ("y", None), ("z", None)}


def test_topology_of_a_long_chain(spark):
    """No number of rounds is too many: only cycles have no depth."""
    n = 103
    arcs = spark.createDataFrame([(f"v{i + 1:03d}", f"v{i:03d}") for i in range(n)] + [("x", "y"), ("y", "x")], "a string, b string").coalesce(1)
    assert {r["id"]: r["depth"] for r in V.topological_layers(arcs).collect()} == {**{f"v{i:03d}": i for i in range(n + 1)}, "x": None, "y": None}


def test_orphan_tests(spark):
    df = spark.createDataFrame([("r", "r/test_a.py"), ("r", "r/a.py"), ("r", "r/b_test.go"), ("q", "q/b.go")], "repo string, file_path string")
    assert [(r["file_path"], r["subject"]) for r in V.orphan_tests(df).collect()] == [("r/b_test.go", "b")]
