"""Operators on small hand-made cases, against brute force where there is no SQL."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.functions import versions as V
from gneiss.operators import dependencies as D
from gneiss.operators import files as H
from gneiss.operators import findings as O
from gneiss.operators import graph as G
from gneiss.operators import lines as L
from gneiss.operators import prompts as P
from gneiss.operators import search as S
from gneiss.operators import snapshots as N
from gneiss.sources import code
from gneiss.streaming import sync


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def edges(spark, pairs, kind="CALLS"):
    return frame(spark, [(a, b, kind, None) for a, b in pairs], "source string, target string, type string, props string")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_strong_components_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"v{rng.randrange(12):02d}", f"v{rng.randrange(12):02d}") for _ in range(18)]
    reach = {v: {v} for p in pairs for v in p}
    for _ in range(12):
        for a, b in pairs:
            for r in reach.values():
                if a in r:
                    r.add(b)
    want = {v: min(w for w in reach if w in reach[v] and v in reach[w]) for v in reach}
    got = {r["id"]: r["scc"] for r in G.strong_components(frame(spark, pairs, "a string, b string")).collect()}
    for local in (0, 5):  # the distributed way alone, and finished in one task
        assert {r["id"]: r["scc"] for r in G.strong_components(frame(spark, pairs, "a string, b string"), local=local).collect()} == got
    assert got == want


@pytest.mark.parametrize("block", [2, 200])
def test_similar_heads(spark, block):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh (=)\n") for _ in range(300)) for _ in range(3)]
    texts = [b[:at] + "#" * cut + b[at + cut :] for b in base for at, cut in ((0, 0), (40, 3), (200, 10), (100, 60))]
    rows = [(f"f{i:02d}", f"p/{i:02d}.py", t) for i, t in enumerate([*texts, texts[0], texts[0] + "x", " " * 300])]
    got = {(r["first_path"], r["path"]): r["ratio"] for r in H.similar_heads(frame(spark, rows, "file_id string, file_path string, raw_content string"), block=block).collect()}
    want = {}
    for i, x in enumerate(texts):
        for j in range(i + 1, len(texts)):
            if (ratio := difflib.SequenceMatcher(None, x, texts[j], autojunk=False).ratio()) > 0.9:
                want[f"p/{i:02d}.py", f"p/{j:02d}.py"] = ratio
    assert got == want and ("p/00.py", "p/01.py") in want and ("p/00.py", "p/03.py") not in want


def test_components(spark):
    pairs = [("a", "b"), ("b", "c"), ("x", "y"), ("z", "z"), ("d", "c")]
    got = {r["id"]: r["component"] for r in G.components(frame(spark, pairs, "a string, b string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x", "z": "z"}


def test_closure_depths_and_stop(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("b", "b"), ("a", "b")])
    start = frame(spark, [("a",)], "id string")
    assert {(r["id"], r["depth"]) for r in G.closure(e, start, 8).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert {r["id"] for r in G.closure(e, start, 0).collect()} == {"a"}
    assert {r["id"] for r in G.closure(e, start, 8, stop_above=1).collect()} == {"a", "b"}
    assert G.closure(e, frame(spark, [], "id string"), 3).count() == 0
    assert {r["id"] for r in G.closure(e, frame(spark, [("d",)], "id string"), 1, backward=True).collect()} == {"c", "d"}


def test_merge_adjacent_is_anchored(spark):
    schema = "id bigint, tool string, category string, severity string, file_path string, line int, title string, detail string, tier string, line_end int, count int"
    row = lambda i, line, cat="x": (i, "td", cat, "low", "f", line, "", "", "low", line, 1)
    got = O.merge_adjacent(frame(spark, [row(1, 1), row(2, 5), row(3, 9), row(4, 14), row(5, 20), row(6, 6, "y")], schema)).collect()
    assert sorted((r["category"], r["line_start"], r["line_end"], r["n"]) for r in got) == [("x", 1, 5, 2), ("x", 9, 14, 2), ("x", 20, 20, 1), ("y", 6, 6, 1)]


def test_bursts_keep_counts(spark):
    schema = "id bigint, tool string, category string, severity string, file_path string, line int, tier string, count int"
    eight = [(i, "a", "c", "low", f"f{i}", i, "low", 2) for i in range(8)]
    nine = [(100 + i, "b", "c", "low", "f", i, "high" if i == 3 else "low", None) for i in range(9)]
    got = O.merge_bursts(frame(spark, eight + nine, schema)).collect()
    assert len(got) == 9 and sum(r["n"] for r in got) == 16 + 9
    burst = [r for r in got if r["tool"] == "b"]
    assert [(r["n_rows"], r["tier"], r["first_id"], r["n_files"]) for r in burst] == [(9, "high", 100, 1)]


def test_health_score_is_exact(spark):
    rows = [(i, "r/f", t) for i, t in enumerate(["low"] * 5)] + [(9, "s/f", "high")] * 30
    got = {r["repo"]: r["score"] for r in O.health_scores(frame(spark, rows, "id bigint, file_path string, tier string")).collect()}
    assert got == {"r": 99, "s": 0}


def test_versions(spark):
    cases = [("1.10", "<", "1.9", False), ("1.10", ">", "1.9", True), ("latest", ">", "0", False), ("2.0.0-rc1", "<", "2.0.0", True), ("2.0", "==", "2.0.0", True), ("x", "<", "2", False), ("1", "~", "2", False)]
    df = frame(spark, cases, "v string, o string, b string, want boolean")
    assert df.where(V.satisfies(F.col("v"), F.col("o"), F.col("b")) != F.col("want")).count() == 0
    r = frame(spark, [("1.5", ">=1.2,<2", True), ("2.0", ">=1.2,<2", False), ("1.0", "", False)], "v string, r string, want boolean")
    assert r.where(V.in_range(F.col("v"), F.col("r")) != F.col("want")).count() == 0


def test_classify_and_strategy(spark):
    s = "path string, mtime double, size bigint"
    before = frame(spark, [("a", 1.0, 5), ("b", 1.0, 5), ("c", 1.0, 5), ("e", 1.0, None)], s)
    after = frame(spark, [("a", 1.1, 5), ("b", 1.2, 5), ("d", 1.0, 1), ("e", 1.0, None)], s)
    got = N.classify(before, after)
    assert {(r["path"], r["change"]) for r in got.collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "deleted"), ("d", "added"), ("e", "unchanged")}
    pick = lambda **k: N.strategy(got, **{"baseline_exists": True, "fresh": True, "closure_size": 10} | k).first()["strategy"]
    assert (pick(), pick(baseline_exists=False), pick(fresh=False), pick(closure_size=151), pick(closure_size=61)) == ("incremental", "full", "full", "full", "full")
    same = N.classify(after, after)
    assert N.strategy(same, True, True, 0).first()["strategy"] == "no_change" and N.strategy(same, True, False, 0).first()["strategy"] == "full"


def test_diffs(spark):
    text = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,3 @@\n a\n-if retry:\n+b\n c\n@@ -9 +9,2 @@\n+timeout = 3\n d"
    got = N.parse_diffs(frame(spark, [(1, text), (2, None), (3, "")], "id bigint, t string"), "id", "t")
    assert [(r["hunk"], r["new_line"], r["kind"]) for r in got.collect()] == [(1, 1, "context"), (1, None, "remove"), (1, 2, "add"), (1, 3, "context"), (2, 9, "add"), (2, 10, "context")]
    assert {(r["file"], r["rule"]) for r in N.guard(got).collect()} == {("x.py", "validation"), ("x.py", "retry")}


def test_reroutes(spark):
    e = "source string, target string, type string"
    got = N.edge_diff(frame(spark, [("a", "b", "C"), ("a", "c", "D")], e), frame(spark, [("a", "x", "C"), ("z", "y", "C")], e))
    assert {(r["source"], r["target"], r["change"], r["other"]) for r in got.collect()} == {("a", "b", "rerouted", "x"), ("a", "c", "removed", None), ("z", "y", "added", None)}


def test_search_with_zero_vectors_and_blocks(spark):
    rows = [(i, [float(i % 3), float(i % 5), 1.0]) for i in range(40)] + [(99, [0.0, 0.0, 0.0])]
    df = frame(spark, rows, "id bigint, v array<float>")
    one, many = (S.similar(df, "id", "v", df.where("id % 10 = 0"), block=b).orderBy("id", "rank").collect() for b in (1000, 7))
    assert one == many and all(r["rank"] <= 5 for r in one) and len(one) == 4 * 5
    assert S.by_vector(df, "id", "v", [1.0, 0.0, 0.0], 3).count() == 3


def test_rules_fire_and_spare(spark):
    lines = [("python", "eval(x)", "eval"), ("python", "# eval(x)", ""), ("python", 'db_password = "Abc12345x"', "secret_name"), ("python", 'password = "changeme1"', ""), ("go", "pickle.loads(x)", ""), ("python", "pickle.loads(x)", "pickle"), ("python", "-----BEGIN RSA PRIVATE KEY-----", "private_key")]
    rows = frame(spark, [(i, "f", lang, 1, text, want) for i, (lang, text, want) in enumerate(lines)], "file_id bigint, file_path string, language string, line_no int, line string, want string")
    got = {r["file_id"]: r["rule"] for r in L.hits(rows, L.SECURITY).collect()}
    assert all(got.get(i, "") == want for i, (_, _, want) in enumerate(lines))


def test_dependencies(spark):
    files = frame(spark, [("r/requirements.txt", "a==1.0\nb>=2 # x\n-r other\n\nC[x] ~= 3", 1), ("r/go.mod", "require x.y/z v1.2.3\nmodule m", 2)], "file_path string, raw_content string, file_id bigint")
    req = D.requirements(files)
    assert {(r["package"], r["constraint"]) for r in req.collect()} == {("a", "==1.0"), ("b", ">=2"), ("c", "~=3")}
    assert {r["package"] for r in D.unpinned(req, frame(spark, [], "folder string")).collect()} == {"b", "c"}
    assert D.unpinned(req, frame(spark, [("r",)], "folder string")).count() == 0
    assert [(r["package"], r["version"]) for r in D.go_modules(files).collect()] == [("x.y/z", "1.2.3")]


def test_prompt_winners(spark):
    v = frame(spark, [("p", "A", 1.0), ("p", "B", 1.0), ("q", "A", 1.0), ("q", "B", 2.0), ("r", "B", 0.5)], "asset string, group string, score double")
    assert {(r["asset"], r["winner"]) for r in P.winners(v).collect()} == {("p", "A"), ("q", "B"), ("r", "B")}


def test_paths_and_names(spark):
    df = frame(spark, [(".\\a\\b.PY", "HTTPServerName")], "p string, n string")
    r = df.select(T.clean_path(F.col("p")).alias("c"), T.language(F.col("p")).alias("l"), T.snake_case(F.col("n")).alias("s"), T.stem(T.clean_path(F.col("p"))).alias("t")).first()
    assert (r["c"], r["l"], r["s"], r["t"]) == ("a/b.PY", "python", "http_server_name", "b")


def test_sources_and_reports(spark, tmp_path, data):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("import os\n")
    (tmp_path / "src" / "node_modules").mkdir()
    (tmp_path / "src" / "node_modules" / "b.js").write_text("x")
    (tmp_path / "src" / ".env").write_text("export A='1'\n#B=2\nC = 3")
    got = code.scan_directory(spark, str(tmp_path / "src")).collect()
    assert [(r["language"], r["raw_content"]) for r in got] == [("python", "import os\n")]
    (tmp_path / "r.csv").write_text("source,target,type\na,b,CALLS\nc,d,\n")
    assert {(r["source"], r["type"]) for r in code.read_relations(spark, str(tmp_path / "r.csv")).collect()} == {("a", "CALLS"), ("c", "RELATES")}
    env = code.read_env(spark.createDataFrame([("x/.env", "export A='1'\n#B=2\nC = 3")], "file_path string, raw_content string"))
    assert {(r["key"], r["value"]) for r in env.collect()} == {("A", "1"), ("C", "3")}
    findings = spark.read.parquet(data + "/findings.parquet")
    code.write_findings(findings, str(tmp_path / "f"))
    back = code.read_findings(spark, str(tmp_path / "f"), findings.schema)
    assert back.count() == findings.count() and set(back.columns) == set(findings.columns)
    assert code.markdown_report(findings).startswith("# Findings")
    arcs = G.module_arcs(spark.read.parquet(data + "/nodes.parquet"), spark.read.parquet(data + "/edges.parquet"))
    assert code.mermaid(arcs).startswith("graph LR")


def test_stream_sync_is_repeatable(spark, tmp_path):
    s = "path string, digest string, seen_at timestamp"
    import datetime as dt

    t = lambda n: dt.datetime(2025, 1, n)
    first = frame(spark, [("a", "1", t(1)), ("b", "1", t(1))], s)
    state = sync.merge(None, first)
    second = frame(spark, [("a", "2", t(2)), ("a", "3", t(3)), ("b", "9", dt.datetime(2024, 1, 1)), ("c", "1", t(2))], s)
    got = {(r["path"], r["digest"], r["change"]) for r in sync.merge(state, second).collect()}
    assert got == {("a", "3", "changed"), ("b", "1", "late"), ("c", "1", "added")}
    (tmp_path / "in").mkdir()
    first.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        sync.run(spark, spark.readStream.schema(s).parquet(str(tmp_path / "in")), str(tmp_path / "out")).awaitTermination()
    assert sync.current(spark, str(tmp_path / "out")).count() == 2


def test_empty_tables(spark):
    e = edges(spark, [])
    n = frame(spark, [], "id string, type string, name string, file_path string, start_line int, end_line int, props string")
    for df in (G.callers(n, e), G.impact(n, e), G.fan_stats(G.module_arcs(n, e)), G.isolated(n, e), G.strong_components(frame(spark, [], "a string, b string")), G.components(frame(spark, [], "a string, b string"))):
        assert df.count() == 0
