"""Hits of agent rules in context: one case for each reason to drop or lower one."""

import pytest

from gneiss.operators import agentscan as A
from gneiss.operators import lines as L


def of(text, language="python"):
    return {(n, r.removeprefix("AGENT-SEC-")): (s, why) for n, r, _, s, why in A.scan(text.split("\n"), language)}


@pytest.mark.parametrize(
    ("text", "rule", "want"),
    [
        ("prompt = f'do {user_input}'", (1, "01"), ("medium", "words only")),
        ("prompt = f'do {clean_text(user_input)}'", (1, "01"), None),
        ("prompt = sanitize(f'{x}') + f'{user}'", (1, "01"), None),
        ("prompt = f'{USER_LIMIT}'", (1, "01"), ("", "constant")),
        ("prompt = f'https://{user_host}/x'", (1, "01"), ("", "address")),
        ("r = requests.get(u)", (1, "25"), ("medium", "")),
        ("r = requests.get(u,\n    headers=h,\n    timeout=3)", (1, "25"), ("", "timeout")),
        ("@app.post('/x', dependencies=[D])", (1, "AUTH"), ("", "guarded")),
        ("@app.post('/x')", (1, "AUTH"), ("high", "")),
        ("cur.execute('SELECT 1')", (1, "08"), ("low", "reading")),
        ("q = '''select a\nfrom b'''\ncur.execute(q)", (3, "08"), ("low", "reading")),
        ("cur.execute('CREATE TABLE t (a int)')", (1, "08"), ("low", "creating")),
        ("cur.execute('DELETE FROM t')", (1, "08"), ("high", "")),
        ("proc.stdin.write(x)", (1, "08"), ("", "pipe")),
        ("with open(args.out, 'w') as fh:\n    fh.write(x)", (2, "08"), ("low", "argument")),
        ("p = os.path.join(cache_dir, 'a')\nwith open(p, 'w') as fh:\n    fh.write(x)", (3, "08"), ("low", "own")),
        ("def _path():\n    return make('.cache', 'x.db')\np = _path()\nconn = connect(p)\nconn.commit()", (5, "08"), ("low", "own")),
        ("with open(target, 'w') as fh:\n    fh.write(x)", (2, "08"), ("high", "")),
        ("d = tempfile.mkdtemp()\nshutil.rmtree(d)", (2, "06"), ("medium", "own")),
        ("shutil.rmtree(folder)", (1, "06"), ("blocker", "")),
        ("logger.info(requests.get(u))", (1, "25"), ("", "log")),
        ("logger.info('to %s', email)", (1, "18"), ("high", "")),
        ("report.append('| a | {user.email} |')\nlines.append(f'# {user.email}')", (2, "21"), ("", "report")),
        ("x = json.load(fh)", (1, "58"), ("", "unconfirmed")),
        ("x = json.load(fh)\ny = graph.query(x)", (1, "58"), ("high", "")),
        ("while not task.done:\n    pass", (1, "70"), ("high", "")),
        ("while not task.done:\n    if now() > deadline: break", (1, "70"), ("", "deadline")),
        ("p = realpath(x)\nfh = open(request.args)", (2, "PT"), ("medium", "checked")),
        ("fetch(url, x)", (1, "SSRF"), ("high", "")),
        ("if urlparse(url).netloc in allowed_hosts:\n    fetch(url, x)", (2, "SSRF"), ("medium", "checked")),
        ("save_env(k)\nos.chmod(p, 0o600)", (1, "SECRET"), ("medium", "kept safe")),
        ("p = re.compile('requests.get(')", (1, "25"), ("", "pattern")),
        ("# os.system(x)", (1, "07"), None),
        ('"""Doc.\nos.system(x)\n"""\ny = 1', (2, "07"), None),
        ('x = """a\nb"""\nos.system(x)', (3, "07"), ("blocker", "")),
        ("print(f'a',\n  prompt_text)\nraise E(\n  f'{a}')\n", (1, "01"), None),
    ],
)
def test_fates(text, rule, want):
    assert of(text).get(rule) == want


def test_one_per_line_and_category():
    got = of("os.system('rm -rf x')")
    assert got[1, "06"][0] == "blocker" and got[1, "07"] == ("", "same line")


def test_rows(spark):
    df = spark.createDataFrame([(1, "a/x.py", "os.system(x)\n"), (2, "a/y.txt", "os.system(x)"), (3, "a/z.py", None), (4, "a/w.go", 'exec.Command("sudo", x)')], "file_id bigint, file_path string, raw_content string")
    texts = L.arrays(df)
    assert {(r["file_id"], r["rule"], r["severity"]) for r in A.findings(texts).collect()} >= {(1, "AGENT-SEC-07", "blocker"), (4, "AGENT-SEC-31", "blocker")}
    assert A.judged(texts.where("false")).count() == 0 and A.fates(texts).count() >= 2
