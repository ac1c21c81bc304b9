"""Every rule fires on a line made for it, and none on plain lines."""

import re

from gneiss.operators import lines as L

LINES = {
    "python": [
        'db_password = "s3cretvalue"', "t = 'ghp_abcdefgh'", 'cur.execute(f"select * from t where a = {x}")', "os.system(cmd)", "pickle.loads(b)", 'host = "10.1.2.3:80"', "eval(text)", "subprocess.run(c, shell=True)", "open(request.args)", 'logger.info("x", token)', "DES.new(k)", "requests.get(url)", "el.innerHTML = x", "random.random()", "hashlib.md5(b)", "get(u, verify=False)", "while True:", "ProcessBuilder(x)", "# fully tested and completely safe", "except:", "def f(a=[]):", "f = open(p)", "if os.path.exists(p):", "    global x", "r = urlopen(u)", "prompt = f'x {user_input}'", "shutil.rmtree(d)", "conn.execute('DELETE FROM t')", "while true: agent.step()", "max_tokens = None", "DEBUG = True", "allow_origins = ['*']", "traceback.print_exc()", "sys.path.append(p)", "importlib.import_module(n)", "x = 1  # noqa", "print(x)", "y = 2 ", "z" * 130, "<<<<<<< HEAD", "raise ValueError(1)", "q = 'SELECT a FROM b '", "u = 'http://x.y'", "r = 'redis://a:b@h'", "-----BEGIN EC PRIVATE KEY-----", "p = '../../x'", "sha1(b)", "localhost",
        "m = {'role': 'system', 'content': f'{user_input}'}", "context += page_text", "memory.add(response)", "prompt = '\\n'.join(parts)", "history.append(m)", "logger.info(prompt)", 'u = base + "?token=" + t', "session.post(u, data=password)", "for attempt in range(3):", "fh.write(x, 'config.json')", "print(email)", "print(user.phone)", "print(id_card)", "s = f'{user.email}'", "client.chat.create(m)", "if name in blacklist: contains(x)",
        "g = json.load(open(graph_path))", "kg.search(q)", "a = [Image.open(p) for p in ps]", "while not task.done:", "q = '/api/v1/query' + x", "if not users: return True", "@router.post('/x')", "open(request.args['p'])", "opts = '--no-sandbox'", "ShellTool()", "save_env(k)", "yaml.load(f)",
        "    except E: return 1", "Thread(target=f).start()", "t = fh.read()", "jwt.decode(t, verify=False)", "# no review needed", "# the best in the world",
    ],
    "go": ['exec.Command("sh", "-c", x)', 'exec.Command("sudo", x)', 'fmt.Sprintf("proxy_pass %s", x)', 'filepath.Join(d, r.URL.Path)', 'u := "https://h/x?q=" + q', 'http.HandleFunc("/admin/x", h)', "t := time.NewTicker(d)", "go func() { os.WriteFile(p, b) }()", "os.WriteFile(p, body, 0)", 'className := req.Query("c")', "http.Get(url)"],
    "javascript": ["eval(x)", "require('child_process')", "e.innerHTML = y", 'f("/x?token=" + t)', "app.post('/admin/x', f)"],
    "typescript": ["let x: any = 1"],
    "php": ["system($x)", "eval($x)", "'app_debug' => true", "new $cls", "call_user_func($f)", "file_get_contents($u)"],
    "java": ["Runtime.getRuntime().exec(x)", "new ObjectInputStream(i)", 'executeQuery("a" + b)', "} catch (Exception e) {", '@PostMapping("/admin")', 'new File(d + name)', "HttpClient.send(url)", 'String apiKey = "abcdefgh12"'],
}


def hits(rule, line, language):
    return (not rule.languages or language in rule.languages) and re.search(rule.pattern, line) and not (rule.but and re.search(rule.but, line))


def test_every_rule_fires():
    quiet = [(pack, r.name, r.pattern) for pack, rules in L.PACKS.items() for r in rules if not any(hits(r, line, language) for language, lines in LINES.items() for line in lines)]
    assert quiet == []


def test_plain_lines_are_spared():
    plain = ["x = 1", "def f(a, b):", "return count_rows(item)", 'api_key = "changeme"', "for item in rows:", "# a plain comment", "max_tokens = 512", "const total = a.length;", "token_budget = load(x, 3)"]
    loud = [(r.name, line) for rules in (L.SECURITY, L.GOVERNANCE, L.AGENT) for r in rules for line in plain if hits(r, line, "python")]
    assert loud == []


def test_resilience_signals():
    assert re.search(L.RESILIENCE["AGENT-RESILIENCE-01"], "f(timeout=3)") and not re.search(L.RESILIENCE["AGENT-RESILIENCE-01"], "f(3)")
