"""Checks whose cases the tables hold few of, on small planted ones."""

import json

from gneiss.operators import dependencies as D
from gneiss.operators import detectors as X
from gneiss.operators import facts as A
from gneiss.operators import lines as L


def files_of(spark, *rows):
    full = [(i, r.get("repo", "r"), r.get("path", f"r/f{i}.py"), r.get("imports", []), r.get("functions", []), r.get("text"), r.get("n", 1)) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "file_id bigint, repo string, file_path string, imports array<string>, functions array<struct<name:string,start_line:int,end_line:int>>, raw_content string, n_lines int")


def chunks_of(spark, *rows):
    return spark.createDataFrame([(f"c{i}", r.get("kind", "function"), r.get("name", f"n{i}"), r.get("code", ""), r.get("a", 1), r.get("b", 1)) for i, r in enumerate(rows)], "chunk_id string, chunk_type string, name string, code string, start_line int, end_line int")


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_simplification(spark):
    chunks = chunks_of(
        spark, {"kind": "Class", "name": "Big", "b": 900}, {"kind": "class", "name": "Edge", "b": 500}, {"kind": "class", "name": "BaseRow", "code": "class BaseRow(Row):\n    pass", "b": 2}, {"kind": "class", "name": "AbstractRow", "code": "class AbstractRow:\n    pass", "b": 2},
        {"name": "f", "code": "def f(a):\n    # only\n    return g(a)\n"}, {"name": "h", "code": "def h(a):\n    b = a\n    return g(b)\n"}, {"name": "k", "code": "def k(a):\n    return a\n"}, {"name": "m", "code": None},
    )
    assert got(X.large_classes(chunks), "name", "severity", "savings") == [("Big", "high", 700)]
    assert got(X.thin_abstractions(chunks), "name") == [("BaseRow",)]
    assert got(X.thin_wrappers(chunks), "name") == [("f",)]
    files = files_of(spark, {"text": "class Big:\n pass\nBig()"}, {"text": "class Edge: pass"}, {"text": None})
    assert got(X.dead_classes(files, chunks), "name", "n_references") == [("AbstractRow", 0), ("BaseRow", 0), ("Edge", 1)]
    assert got(X.replaceable_imports(files_of(spark, {"imports": ["requests.auth", "os"]}, {"imports": ["requests"]}, {"imports": None})), "library", "n_files") == [("requests", 2)]


def test_supply_chain(spark):
    lock = json.dumps({"packages": {"dgrijalva/jwt-go/v4": {"version": "4.0.1"}, "x/dgrijalva/jwt-go": {"version": "1.0.0"}, "other": {"version": "1.0.0"}}})
    files = files_of(
        spark, {"path": "r/a-lock.json", "text": lock}, {"path": "r/b.py", "imports": ["other.x", "absent", "os", "b"], "text": "import other\nos.system('pip install x')\nsubprocess.run(['pip', 'install'])\n"}, {"repo": "q", "path": "q/c.py", "imports": ["absent", "c"], "text": "SitemapLoader()"},
        {"repo": "p", "path": "p/requirements.txt", "text": "x"}, {"repo": "p", "path": "p/d.py", "imports": ["absent"], "text": ""},
    )
    packages = D.lock_packages(files)
    assert got(X.deprecated(packages.select("repo", "package")), "package") == [("dgrijalva/jwt-go/v4",), ("x/dgrijalva/jwt-go",)]
    assert got(X.unpinned_imports(files), "repo", "package") == [("q", "absent"), ("r", "absent"), ("r", "other")]
    assert got(X.runtime_installs(L.lines(files)), "file_id", "line_no") == [(1, 2)]
    assert ("absent", "imported") in got(X.dependency_drift(files, packages), "package", "side") and ("other", "imported") not in got(X.dependency_drift(files, packages), "package", "side")
    found = spark.createDataFrame([("r", "A", "high"), ("q", "A", "high"), ("none", "A", "high"), ("r", "B", "high")], "repo string, advisory string, severity string")
    assert got(X.gated(found, files, {"A": "(?i)sitemaploader"}), "repo", "advisory", "severity") == [("none", "A", "low"), ("q", "A", "high"), ("r", "A", "low"), ("r", "B", "high")]
    answer = {"vulns": [{"id": "G-1", "aliases": ["CVE-1"], "summary": "s", "database_specific": {"severity": "CRITICAL"}, "affected": [{"ranges": [{"events": [{"introduced": "0"}, {"fixed": "2.1"}, {"fixed": "3"}]}]}]}, {"id": "G-1b", "aliases": ["CVE-1"], "database_specific": {"severity": "odd"}}, {"id": "G-2"}]}
    osv = X.osv_advisories(spark.createDataFrame([("p", json.dumps(answer)), ("q", None), ("s", "{}"), ("t", "no json")], "package string, answer string"))
    assert got(osv, "package", "advisory", "severity", "fixed") == [("p", "CVE-1", "critical", "2.1"), ("p", "G-2", "medium", None)]


def test_governance(spark):
    files = files_of(
        spark, {"path": "r/a.yaml", "text": "password: hunter22xx\ntoken: <your token>\nname: x"}, {"path": "r/b.py", "text": "password: hunter22xx"},
        {"path": "r/c.py", "text": "def save_env(x):\n    y = 1\n    z = {'api_key': x}\n\ndef save_env_2(x):\n    pass\nfh.write(f'K={api_key}')"}, {"path": "r/d.py", "text": "import sys\nsys.path.insert(0, '../lib')\nsys.path.append('gone/away')\n"}, {"path": "r/lib/e.py", "text": ""},
    )
    assert got(X.settings_secrets(files), "file_id", "line_no") == [(0, 1)]
    assert got(X.secrets_written(L.arrays(files)), "file_id", "line_no") == [(2, 1), (2, 5), (2, 7)]
    assert got(X.missing_paths(L.lines(files), files), "path") == [("gone/away",)]
    docs = spark.createDataFrame([(1, "api_key = abcdefgh12\nplain", "s"), (2, "You may skip the review here.", "s"), (3, None, "s"), (4, "It grew 12% in 2021 here.", "t"), (5, "It fell 3% by 2023", "t"), (6, "It fell 3% (as of 2024)", "u"), (7, "4% in 2020", "u")], "doc_id bigint, text string, source string")
    assert got(X.document_secrets(docs), "doc_id", "n_secrets", "n_bypass") == [(1, 1, 0), (2, 0, 1)]
    assert got(X.undated_statistics(docs), "source", "n_years") == [("t", 2)]
    assert got(X.prompt_governance(docs), "doc_id", "label") == [(1, "plain credentials"), (2, "bypassing review")]
    lines = ["password = r'secret.*'", "def f(token=1):", "token = os.environ['T']", "pwd = cfg.pw", "# password: x", "password: Optional[str]", "secret = other", "secret = a.b", "api_key = 'your_key'", "token = 'abcdef'", "token = 'a1B2c3D4'"]
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    want = ["pattern", "parameter", "environment", "settings", "comment", "annotation", "variable", "attribute", "placeholder", "plain value", ""]
    assert got(X.credential_lines(rows), "reason", "n") == sorted((w, 1) for w in want)


def test_folders_and_findings(spark):
    files = files_of(spark, {"path": "r/billing/a.py", "text": "x\n\ny", "functions": [("f", 1, 2)]}, {"path": "r/billing/b.py", "text": ""}, {"path": "r/rules/a.py", "text": ""}, {"path": "r/rules/b.py", "text": ""}, {"path": "r/one/a.py"})
    docs = spark.createDataFrame([("docs/the-rules.md",), (None,)], "file_path string")
    assert got(X.undocumented_folders(files, docs), "folder", "severity") == [("r/billing", "medium")]
    assert got(X.unindexed(files, spark.createDataFrame([("./r/other.py",), (None,)], "file_path string")), "file_path") == [("r/billing/a.py",)]
    findings = spark.createDataFrame([(1, "r/billing/a.py", 1), (1, "r/billing/a.py", 1), (2, "r/billing/a.py", 2), (3, "r/billing/a.py", 4), (4, "none", 1), (5, "r/billing/a.py", None)], "id bigint, file_path string, line int")
    assert got(X.reverified(findings, files), "status", "n") == [("beyond", 2), ("blank", 1), ("missing", 1), ("present", 1)]
    kept = X.typed_whitelist(findings.select("file_path").distinct(), "file_path", [("suffix", "A.PY")])
    assert got(kept, "file_path") == [("none",)]


def test_neighbouring_lines(spark):
    text = "# a = 1\n# b = 2\n# c()\nx = 1\n# d = 1\n# e = 2\ntry:\n    load_it()\nexcept E:\n    pass\ndef f():\n    '''One.\n    Two.'''\n    \"\"\"x\"\"\"\n    for i in y:\n        a = 1\n        open(i)\n"
    texts = L.arrays(files_of(spark, {"text": text}, {"text": ""}, {"text": None}, {"text": "# return 1\n" * 3 + "load_it()"}))
    assert got(L.commented_code(texts), "file_id", "first_line", "n") == [(0, 1, 3), (3, 1, 3)]
    assert got(L.docstring_lines(texts), "line_no") == [(12,), (13,), (14,)]
    assert got(L.io_in_loops(texts), "line_no") == [(15,)] and got(L.silent_except(texts), "line_no") == [(9,)]
    from gneiss.operators import verification as V

    assert got(V.in_try(texts, r"\bload\w*\("), "file_id", "guarded") == [(0, True), (3, False)]


def test_no_text_is_shuffled(spark, data):
    """Where nothing came twice but a few, the plans of line checks move no text."""
    from gneiss.plans import registry

    for name in ("lines_deep_nesting", "lines_io_in_loops", "lines_silent_except", "lines_commented_code", "lines_docstrings", "files_complexity", "files_blank"):
        plan = registry.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        moved = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
        assert len(moved) <= 4, (name, plan)


def test_latest(spark):
    rows = [(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (2, 1, None), (None, 1, "x"), (None, 3, "y"), (3, 1, "z"), (3, 1, "z")]
    df = spark.createDataFrame(rows, "file_id int, ingested_at int, raw_content string")
    want = [("None", "y"), ("1", "c"), ("2", "None"), ("3", "z")]
    few, L.FEW = L.FEW, L.FEW
    for L.FEW in (few, 0):
        assert sorted((str(r["file_id"]), str(r["raw_content"])) for r in L.latest(df).collect()) == sorted(want)
    L.FEW = few


def test_facts_have_cases(spark):
    files = files_of(spark, {"text": "def f(a, b=1):\n    return a\nf(1, c=2)\nf(1, b=2)\ndef _helper():\n    pass\ntry:\n    f(1)\nexcept ValueError:\n    pass\n"})
    facts = A.python_facts(files)
    assert got(A.unknown_keywords(facts), "name", "keyword") == [("f", "c")]
    assert got(A.unused_helpers(facts), "name") == [("_helper",)] and got(A.silent_handlers(facts), "line") == [(9,)]


def test_parsed_facts(spark):
    text = "class low:\n    pass\nasync def go(p):\n    time.sleep(1)\n    requests.get(p)\n    return p\ndef cut(row, width, limit=3):\n    q = config.limit\n    return row[:width] + q\ncut(row=1, limit=2)\ncut(row=1, width=2, limit=4)\ndef _own():\n    a = 1\n    b = 2\n    return a\n"
    facts = A.python_facts(files_of(spark, {"text": text}, {"text": "def broken(:\n"}, {"text": None}))
    assert got(A.class_names(facts), "name", "suggestion") == [("low", "Low")]
    assert got(A.blocking_calls(facts), "name", "inside") == [("requests.get", "go"), ("time.sleep", "go")]
    assert got(A.shadowed_parameters(facts), "name", "parameter") == [("cut", "limit")]
    assert got(A.undocumented_functions(facts), "name") == [("go",)]
    assert got(A.single_letters(facts), "name") == [("a",), ("b",), ("q",)]
    assert got(A.missing_arguments(facts), "line", "parameter") == [(10, "width")]


def test_functions_with_thresholds(spark):
    from gneiss.operators import files as O

    code = "def f(a, b, c, d, e, f, g, h, i):\n" + "    if a:\n        return 1\n" * 4 + "    return 2\n"
    fs = spark.createDataFrame([(1, "f", 1, code), (2, "g", 1, "def g(a, b, c, d, e, f, g, h):\n    return 1")], "file_id bigint, name string, start_line int, code string")
    assert got(O.parameters(fs), "file_id", "n") == [(1, 9)]
    # branches weigh 1, 2, 3 and 4; of five returns all but the last count
    assert got(O.cognitive(fs, at_least=1), "file_id", "load") == [(1, 14)]
    sig = spark.createDataFrame([(0b100011111,), (0b110011111,), (0b1,), (0b111001110,)], "signature int")
    from gneiss.operators.graph import components

    ids = components(O.signature_pairs(sig.withColumn("file_id", sig.signature))).where("id >= 0").collect()
    assert len({r["component"] for r in ids if r["id"] in (0b100011111, 0b110011111)}) == 1 and 0b1 not in {r["id"] for r in ids}


def test_maturity(spark):
    from gneiss.operators import maturity as M

    files = files_of(
        spark, {"path": "r/README.md", "text": "x" * 501}, {"path": "r/.gitignore", "text": ".env"}, {"path": "r/tests/test_a.py", "text": "import pytest"}, {"path": "r/a.py", "text": "@app.errorhandler(500)\npassword = 'abcdefghijk'"},
        {"repo": "q", "path": "q/readme.txt", "text": "x"}, {"repo": "q", "path": "q/.gitignore", "text": ".env\n__pycache__"}, {"repo": "q", "path": None, "text": None},
    )
    found = M.checks(files)
    status = {(r["repo"], r["name"]): r["status"] for r in found.collect()}
    assert len(status) == 42
    assert [status["r", f"MAT-{n}"] for n in ("DOC-01", "CFG-04", "TEST-01", "TEST-02", "TEST-03", "ERR-01", "CFG-03", "CI-01")] == ["pass", "warn", "pass", "pass", "warn", "pass", "fail", "fail"]
    assert [status["q", f"MAT-{n}"] for n in ("DOC-01", "CFG-04", "CFG-03")] == ["warn", "pass", "pass"]
    got_ = {r["repo"]: (r["n_passed"], r["n_half"], r["n_failed"], r["score"], r["grade"]) for r in M.scores(found).collect()}
    assert got_["r"] == (4, 11, 6, 45, "D") and sum(got_["q"][:3]) == 21


def test_signature_changes(spark):
    from gneiss.operators import snapshots as S

    one = lambda text, *fs: {"path": "r/a.py", "text": text, "functions": [(n, i, i) for n, i in fs]}
    before = S.signatures(files_of(spark, one("def f(a):\n  x\ndef g(a, b):\ndef h(a):", ("f", 1), ("g", 3), ("h", 4))))
    after = S.signatures(files_of(spark, one("def f(a, b=1):\ndef g(b, a):\ndef k():", ("f", 1), ("g", 2), ("k", 3))))
    assert got(S.signature_changes(before, after), "name", "change", "breaking") == [("f", "changed", False), ("g", "changed", True), ("h", "removed", True), ("k", "added", False)]
