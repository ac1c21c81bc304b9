"""Rules over the lines of source files.

Files become lines with their numbers, lines are tested against rule packs as one expression per rule, and hits are rows.
Rules are data: a name, a severity, a pattern that must match, patterns that must not, the languages it applies to.
Nearly everything stays in the JVM; a file is exploded within its own task, neighbouring lines are compared in the array
they come in, and no text is shuffled but those of files that were delivered more than once.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.functions import text as T


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    pattern: str
    but: str = ""
    languages: tuple[str, ...] = ()


#: Rules for risky code. Patterns hold to what both Java and RE2 understand.
SECURITY = (
    Rule("eval", "high", r"\b(eval|exec)\(", r"^\s*(#|//)"),
    Rule("shell", "high", r"shell\s*=\s*True|os\.system\(|child_process|Runtime\.getRuntime\(\)\.exec"),
    Rule("sql_text", "medium", r"(SELECT|INSERT|UPDATE|DELETE) .*(FROM|INTO|SET) ", r"^\s*(#|//|\*)"),
    Rule("weak_hash", "low", r"\b(md5|sha1)\b", r"^\s*(#|//|\*)|file_md5|fileMd5"),
    Rule("plain_http", "low", r"http://[a-z]", r"localhost|127\.0\.0\.1"),
    Rule("secret_name", "high", r"(?i)(password|secret|token|api_?key)\w*\s*[:=]+\s*[\"'][^\"'$<{ ]{8,}[\"']", r"(?i)changeme|example|dummy|placeholder|environ|token_?budget"),
    Rule("url_password", "high", r"://[^/\s:@\"']+:[^/\s:@\"'${]+@"),
    Rule("private_key", "critical", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("path_climb", "medium", r"\.\./\.\./"),
    Rule("pickle", "medium", r"pickle\.loads?\(|yaml\.load\(", r"SafeLoader", ("python",)),
    Rule("inner_html", "medium", r"innerHTML\s*=|dangerouslySetInnerHTML", "", ("javascript", "typescript")),
    Rule("tls_off", "high", r"verify\s*=\s*False|InsecureSkipVerify|rejectUnauthorized:\s*false"),
)
QUALITY = (
    Rule("bare_except", "medium", r"^\s*except\s*:", "", ("python",)),
    Rule("broad_catch", "low", r"catch \((RuntimeException|Exception|Throwable) ", "", ("java",)),
    Rule("print", "info", r"^\s*(print\(|console\.log\(|System\.out\.print|fmt\.Print)"),
    Rule("noqa", "info", r"(#\s*noqa|#\s*type:\s*ignore|//\s*eslint-disable|//nolint)"),
    Rule("long_line", "low", r"^.{121,}$"),
    Rule("localhost", "low", r"localhost|127\.0\.0\.1"),
    Rule("sys_path", "medium", r"sys\.path\.(append|insert)\(", "", ("python",)),
    Rule("dynamic_import", "low", r"importlib\.import_module\(|__import__\("),
    Rule("any_type", "info", r":\s*any\b", "", ("typescript",)),
    Rule("trailing_space", "info", r"[ \t]+$"),
    Rule("conflict_mark", "high", r"^(<<<<<<< |>>>>>>> |=======$)"),
    Rule("throw_error", "info", r"^\s*(throw new |raise |return fmt\.Errorf)"),
)
#: Governance and agent rules. Their ids are fixed values, the patterns are this project's own; several rules may share an id.
GOVERNANCE = (
    Rule("IRON-SEC-01", "critical", r"(?i)\b\w*(password|passwd|secret|api_?key|token)\w*\s*[:=]+\s*[\"'][^\"'\s$<{]{8,}[\"']", r"(?i)changeme|example|dummy|placeholder|your[_-]|environ|getenv|process\.env|token_?budget|x-auth|\*{4}|x{6}"),
    Rule("IRON-SEC-01", "critical", r"\b(ghp_|gho_|ghs_|glpat-|xox[bap]-|AKIA[0-9A-Z]{12}|sk-(live|proj)-)"),
    Rule("IRON-SEC-02", "critical", r"(?i)\b(execute|query|raw)\(\s*(f[\"']|[\"'][^\"']*(select|insert|update|delete)\b[^\"']*[\"']\s*(%|\+|\.format))"),
    Rule("IRON-SEC-03", "high", r"\bos\.(system|popen)\(|\bcommands\.getoutput\("),
    Rule("IRON-SEC-04", "high", r"\b(pickle|marshal|shelve)\.(loads?|open)\(|\byaml\.load\(", r"SafeLoader|safe_load"),
    Rule("IRON-SEC-05", "medium", r"[\"'](\d{1,3}\.){3}\d{1,3}(:\d+)?[\"']|[\"']https?://localhost", r"127\.0\.0\.1|0\.0\.0\.0"),
    Rule("IRON-SEC-06", "critical", r"\b(eval|exec|compile)\(", r"^\s*(#|//)|\.compile\(|re\.compile"),
    Rule("IRON-SEC-07", "high", r"subprocess\.\w+\(.*shell\s*=\s*True"),
    Rule("IRON-SEC-08", "high", r"\bopen\(\s*(request|input|argv|params|sys\.argv)|\.\./\.\./"),
    Rule("IRON-SEC-09", "medium", r"(?i)\b(log|logger|print|console)\b.*\b(password|secret|token|api_?key)\b\s*[,)%+]"),
    Rule("IRON-SEC-10", "high", r"\b(DES|RC4|ECB|Blowfish)\b|\bdill\.loads?\(|jsonpickle\.decode\("),
    Rule("IRON-SEC-11", "high", r"\b(requests|urllib|httpx|http)\.(get|post|urlopen|request)\(\s*(url|request|params|user)"),
    Rule("IRON-SEC-12", "high", r"innerHTML\s*=|document\.write\(|\|\s*safe\b|Markup\("),
    Rule("IRON-SEC-13", "medium", r"\brandom\.(random|randint|choice)\(|Math\.random\(|new Random\("),
    Rule("IRON-SEC-14", "medium", r"\b(hashlib\.)?(md5|sha1)\(|MessageDigest\.getInstance\(.(MD5|SHA-1)"),
    Rule("IRON-SEC-15", "medium", r"verify\s*=\s*False|CERT_NONE|rejectUnauthorized\s*:\s*false|InsecureSkipVerify:\s*true"),
    Rule("IRON-SEC-16", "low", r"while\s+True\s*:|for\s*\(\s*;\s*;\s*\)|\.read\(\)\s*$"),
    Rule("IRON-SEC-17", "high", r"\bexec\.Command\(|child_process|Runtime\.getRuntime\(\)\.exec|ProcessBuilder\("),
    Rule("IRON-GOV-02", "medium", r"(?i)\b(100\s?%|fully|completely|guaranteed)\b.*\b(safe|secure|tested|accurate)\b"),
    Rule("PITFALL-01", "high", r"^\s*except(\s+\w+)?\s*:\s*(pass)?\s*$", "", ("python",)),
    Rule("PITFALL-02", "medium", r"\bdef\s+\w+\([^)]*=\s*(\[\]|\{\}|set\(\))", "", ("python",)),
    Rule("PITFALL-03", "medium", r"^\s*\w+\s*=\s*open\(", r"\bwith\b", ("python",)),
    Rule("PITFALL-05", "medium", r"os\.path\.exists\(.*\).*open\(|if\s+os\.path\.exists\("),
    Rule("PITFALL-04", "medium", r"\bexcept\b.*:\s*(return|continue)\b", "", ("python",)),
    Rule("PITFALL-06", "medium", r"\bThread\(.*\)\.start\(\)", r"daemon", ("python",)),
    Rule("PITFALL-07", "low", r"=\s*\w+\.(read|readlines)\(\)", "", ("python",)),
    Rule("IRON-SEC-18", "high", r"(?i)\b(jwt\.decode|decode_token)\(.*verify\w*\s*[=:]\s*(False|false)"),
    Rule("IRON-GOV-01", "medium", r"(?i)\b(no|without any) (risk|review) (is )?(needed|required)\b"),
    Rule("IRON-GOV-03", "medium", r"(?i)\b(best|only|first) in the (world|industry)\b"),
    Rule("IRON-QUAL-01", "low", r"^\s*print\(", "", ("python",)),
)
#: Risks of programs that act on a model's word; ids and severities are fixed values, the patterns hold to one line each.
AGENT = (
    # what reaches a prompt
    Rule("AGENT-SEC-01", "critical", r"(?i)(prompt|system_message|instructions?)\s*(=|\+=)\s*f[\"'].*\{\s*(user|input|query|question|request|message|content)"),
    Rule("AGENT-SEC-02", "high", r"(?i)[\"']?role[\"']?\s*[:=]\s*[\"']system[\"'].*(\{|\+|format\().*(user|input|query)"),
    Rule("AGENT-SEC-03", "high", r"(?i)(prompt|context|messages?)\s*(\+=|=|\.append\(|\.extend\()\s*.*\b(page|html|body|document|web|remote|external)_?(text|content)\b"),
    Rule("AGENT-SEC-04", "medium", r"(?i)(knowledge|memory|vector_?store|kb)\w*\.(add|insert|upsert|save)\w*\(.*\b(user|input|response|answer)"),
    Rule("AGENT-SEC-05", "medium", r"(?i)\b(prompt|context)\b\s*(=|\+=).*\b(join|read)\("),
    # tools
    Rule("AGENT-SEC-06", "blocker", r"shutil\.rmtree\(|os\.(remove|unlink)\(|\brm -rf\b|unlinkSync\(|os\.RemoveAll\("),
    Rule("AGENT-SEC-07", "blocker", r"\bos\.(system|popen)\(|subprocess\.(run|call|Popen|check_output)\("),
    Rule("AGENT-SEC-08", "high", r"\.(execute|executemany|commit|write|save)\("),
    Rule("AGENT-SEC-09", "medium", r"(?i)\b(requests|httpx|aiohttp|session)\.(get|post|put|delete|patch|request)\(|\burlopen\("),
    Rule("AGENT-SEC-10", "blocker", r"(?i)while\s*\(?\s*(true|1)\b.*\b(llm|model|agent|complete|chat)"),
    Rule("AGENT-SEC-11", "high", r"(?i)max_?tokens\s*[:=]+\s*(None|null|nil|-1)\b"),
    Rule("AGENT-SEC-12", "medium", r"(?i)\b(messages|history|context|conversation)\.(append|extend|push)\("),
    # what leaves
    Rule("AGENT-SEC-13", "high", r"(?i)\b(log|logger|logging|print|console)\w*[.(].*\b(prompt|messages|system_message)\b"),
    Rule("AGENT-SEC-14", "medium", r"(?i)[?&](api_?key|token|access_?key)=|headers?\[.?(authorization|x-api-key).?\]\s*=\s*[\"'][A-Za-z0-9]"),
    Rule("AGENT-SEC-15", "medium", r"(?i)(post|put|send|upload)\w*\(.*\b(password|secret|credential|private_?key|personal)"),
    Rule("AGENT-SEC-16", "medium", r"(?i)\b(auto_?)?retry\w*\s*[:=]+\s*true|for\s+\w*(attempt|retry)\w*\s+in\s+range"),
    Rule("AGENT-SEC-17", "high", r"(?i)(write|dump|save)\w*\(.*\b(config|settings|policy|rules)\.(json|ya?ml|toml|py)"),
    Rule("AGENT-SEC-18", "high", r"(?i)\b(log|logger|logging|print|console)\w*[.(].*\be?mail\b"),
    Rule("AGENT-SEC-19", "high", r"(?i)\b(log|logger|logging|print|console)\w*[.(].*\b(phone|mobile)\w*"),
    Rule("AGENT-SEC-20", "blocker", r"(?i)\b(log|logger|logging|print|console)\w*[.(].*\b(id_?card|ssn|passport)\w*"),
    Rule("AGENT-SEC-21", "high", r"(?i)f[\"'].*\{\s*\w*\.?(phone|id_?card|email|ssn|address)\w*\s*\}"),
    # settings
    Rule("AGENT-SEC-22", "high", r"(?i)\bdebug\s*[:=]+\s*true\b"),
    Rule("AGENT-SEC-23", "medium", r"\b(pickle|marshal|shelve|dill)\.(loads?|open)\(|yaml\.load\(", r"SafeLoader"),
    Rule("AGENT-SEC-24", "high", r"(?i)access-control-allow-origin.*\*|allow_origins\s*=\s*\[\s*[\"']\*|cors\(\s*\)|AllowAllOrigins"),
    Rule("AGENT-SEC-25", "medium", r"\b(requests|httpx)\.(get|post|put|delete|patch|head)\(|\burlopen\("),
    Rule("AGENT-SEC-26", "medium", r"(?i)\b(chat|completions?|messages)\.create\(|\.generate_content\("),
    # Go
    Rule("AGENT-SEC-30", "blocker", r"exec\.Command\(\s*[\"'](sh|bash|/bin/sh|/bin/bash)[\"']", "", ("go",)),
    Rule("AGENT-SEC-31", "blocker", r"exec\.Command\(\s*[\"']sudo[\"']", "", ("go",)),
    Rule("AGENT-SEC-32", "high", r"exec\.Command\w*\(", "", ("go",)),
    Rule("AGENT-SEC-33", "high", r"(?i)(Sprintf|template)\w*\(.*(server_name|proxy_pass|location\s)", "", ("go",)),
    Rule("AGENT-SEC-34", "high", r"(filepath|path)\.Join\(.*(Query|Param|FormValue|req\.|r\.URL)", "", ("go",)),
    Rule("AGENT-SEC-35", "medium", r"[\"']https?://[^\"']*[?=/][\"']\s*\+\s*\w+", r"QueryEscape|PathEscape", ("go",)),
    Rule("AGENT-SEC-40", "high", r"(?i)HandleFunc\(\s*[\"'][^\"']*(admin|delete|exec|config|user)", r"(?i)auth", ("go",)),
    Rule("AGENT-SEC-41", "high", r"(?i)(blacklist|denylist|forbidden)\w*.*(contains|strings\.|in )"),
    Rule("AGENT-SEC-51", "medium", r"time\.NewTicker\(", r"Stop", ("go",)),
    Rule("AGENT-SEC-52", "medium", r"go func\(.*(WriteFile|\.Write\()", "", ("go",)),
    Rule("AGENT-SEC-53", "high", r"(os\.WriteFile|ioutil\.WriteFile|os\.Create)\(.*(req\.|r\.|body|param)", "", ("go",)),
    Rule("AGENT-SEC-55", "high", r"(?i)(class|plugin)_?name\w*\s*[:=]+.*(req\.|Query|Param|FormValue)", "", ("go",)),
    Rule("AGENT-SEC-56", "high", r"http\.(Get|Post|NewRequest)\w*\(.*(url|target|addr|endpoint)\w*", "", ("go",)),
    # scripts of the web
    Rule("AGENT-SEC-36", "blocker", r"child_process|\bexecSync\(|\bspawn\(", "", ("javascript", "typescript")),
    Rule("AGENT-SEC-37", "high", r"\beval\(|new Function\(", "", ("javascript", "typescript")),
    Rule("AGENT-SEC-66", "high", r"v-html\s*=|dangerouslySetInnerHTML|innerHTML\s*=", "", ("javascript", "typescript")),
    Rule("AGENT-SEC-67", "high", r"(?i)[\"'`][^\"'`]*[?&]token=", "", ("javascript", "typescript")),
    Rule("AGENT-SEC-68", "high", r"(?i)(app|router)\.(get|post|put|delete)\(\s*[\"'][^\"']*(admin|delete|exec|config)", r"(?i)auth", ("javascript", "typescript")),
    # PHP
    Rule("AGENT-SEC-38", "blocker", r"\b(shell_exec|system|passthru|proc_open|exec)\s*\(", "", ("php",)),
    Rule("AGENT-SEC-39", "high", r"\b(eval|assert|create_function)\s*\(", "", ("php",)),
    Rule("AGENT-SEC-44", "high", r"(?i)(display_errors|app_debug)[\"']?\s*(=>|=|,)\s*[\"']?(on|true|1)", "", ("php",)),
    Rule("AGENT-SEC-45", "high", r"new\s+\$\w+|class_exists\(\s*\$", "", ("php",)),
    Rule("AGENT-SEC-46", "high", r"\$this->\{?\$\w+|call_user_func(_array)?\(\s*\$", "", ("php",)),
    Rule("AGENT-SEC-57", "high", r"(curl_setopt\(.*CURLOPT_URL|file_get_contents\()\s*.*\$", "", ("php",)),
    # Java
    Rule("AGENT-SEC-60", "high", r"(?i)(executeQuery|executeUpdate|prepareStatement|createQuery)\(\s*\"[^\"]*\"\s*\+", "", ("java",)),
    Rule("AGENT-SEC-61", "high", r"(?i)@(Get|Post|Put|Delete|Request)Mapping\(.*(admin|delete|exec|config)", "", ("java",)),
    Rule("AGENT-SEC-62", "blocker", r"ObjectInputStream\(|\breadObject\(\)", "", ("java",)),
    Rule("AGENT-SEC-63", "high", r"(new File|Paths\.get)\(.*\+\s*\w*(name|path|file|param)", "", ("java",)),
    Rule("AGENT-SEC-64", "high", r"(?i)(HttpClient|RestTemplate|URL\()\w*.*\b(url|target|endpoint)\w*\b", "", ("java",)),
    Rule("AGENT-SEC-65", "high", r"(?i)String\s+\w*(password|secret|token|api_?key)\w*\s*=\s*\"[^\"]{8,}\"", r"(?i)token_?budget|changeme|example", ("java",)),
    # data and graphs
    Rule("AGENT-SEC-54", "medium", r"(?i)\b(json|pickle|yaml)\.loads?\(.*(knowledge|graph)"),
    Rule("AGENT-SEC-58", "high", r"\b(json|yaml|pickle)\.(load|safe_load)\("),
    Rule("AGENT-SEC-59", "high", r"(?i)\b(kg|graph|knowledge)\w*\.(search|query|from_dict|load)\w*\("),
    Rule("AGENT-SEC-69", "medium", r"\[[^\n]*Image\.open\([^)]*\)\s*for\s"),
    Rule("AGENT-SEC-70", "high", r"(?i)while\s+not\s+\w+\.(done|status|ready|complete|finished)\b"),
    Rule("AGENT-SEC-42", "high", r"(?i)(promql|query_range|/api/v1/query)\w*.*(\{\w+\}|\+|format\()"),
    Rule("AGENT-SEC-43", "high", r"(?i)if\s+not\s+\w*(users|keys|accounts)\b.*:\s*return\s+true|not\s+\w+\.get\(\s*[\"']authenticated"),
    Rule("AGENT-SEC-AUTH", "high", r"@(router|app)\.(get|post|put|delete)\(", "", ("python",)),
    Rule("AGENT-SEC-PT", "high", r"(?i)(open|join|Path)\(.*\b(request|args|params|user)\w*[.\[]\w*"),
    Rule("AGENT-SEC-DESER", "blocker", r"\b(pickle|dill|jsonpickle)\.(loads?|decode)\("),
    Rule("AGENT-SEC-SANDBOX", "medium", r"--no-sandbox|--disable-web-security|sandbox\s*[:=]\s*(false|False)"),
    Rule("AGENT-SEC-LEAK", "high", r"(?i)traceback\.(print_exc|format_exc)\(|printStackTrace\(|err\.stack"),
    Rule("AGENT-SEC-LMEXEC", "blocker", r"ShellTool\(|PythonREPL|SQLDatabaseChain|db_chain\.(run|invoke)\("),
    Rule("AGENT-SEC-SECRET", "high", r"(?i)\bsave_env\(|open\([^)]*\.env[^)]*[\"']w|write_text\(.*(api_?key|secret|token)"),
    Rule("AGENT-SEC-SSRF", "high", r"(?i)(get|post|fetch|urlopen|download)\w*\(\s*(url|target|address|endpoint)\w*\s*[,)]"),
)
#: What a robust project shows somewhere; AGENT-RESILIENCE checks report what no line of it shows.
RESILIENCE = {
    "AGENT-RESILIENCE-01": r"(?i)\btimeout\b", "AGENT-RESILIENCE-02": r"(?i)\bretr(y|ies)\b|\bbackoff\b", "AGENT-RESILIENCE-03": r"(?i)\bfallback\b|\bdefault_model\b", "AGENT-RESILIENCE-04": r"(?i)rate_?limit|throttl",
    "AGENT-RESILIENCE-05": r"(?i)circuit_?breaker", "AGENT-RESILIENCE-06": r"(?i)health_?check|/healthz?\b", "AGENT-RESILIENCE-07": r"(?i)\bpool(_?size)?\b", "AGENT-RESILIENCE-08": r"(?i)\bcache\w*\b",
    "AGENT-RESILIENCE-09": r"(?i)\b(validate|sanitize)\w*\b", "AGENT-RESILIENCE-10": r"(?i)\b(metrics?|counter|histogram)\b",
}
PACKS = {"security": SECURITY, "quality": QUALITY, "governance": GOVERNANCE, "agent": AGENT}


#: Ids with several deliveries, as the most that are broadcast; beyond, they are joined.
FEW = 1_000_000


def latest(files: DataFrame) -> DataFrame:
    """One row per file_id: the delivery that came in last; among equal times the largest content.

    Which ids came more than once is told by the ids alone; only those files' texts are shuffled, all others stay where
    they are read."""
    again = files.groupBy("file_id").agg(F.count("*").alias("n_")).where("n_ > 1").select(F.col("file_id").alias("again_"))
    if again.count() <= FEW:
        again = F.broadcast(again)
    same = files["file_id"].eqNullSafe(again["again_"])
    first = [c for c in ("ingested_at", "raw_content") if c in files.columns]
    rest = [c for c in files.columns if c not in ("file_id", *first)]
    top = files.join(again, same, "left_semi").groupBy("file_id").agg(F.max(F.struct(*first, *rest)).alias("r"))  # every column once in the shuffle
    columns = ["file_id", *rest, *first]
    return files.join(again, same, "left_anti").select(columns).unionByName(top.select("file_id", *[F.col(f"r.{c}").alias(c) for c in (*rest, *first)]))


def arrays(files: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, file_path, language, all_ array of lines) of every file with content; files: one row per file, as latest gives."""
    own = files.where(F.col("raw_content").isNotNull())
    return own.select(key, "file_path", T.language(F.col("file_path")).alias("language"), T.lines(F.col("raw_content")).alias("all_"))


def lines(files: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, file_path, language, line_no from 1, line) of every line of every file with content; files: one row per file."""
    return arrays(files, key).select(key, "file_path", "language", F.posexplode("all_").alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def hits(rows: DataFrame, rules: tuple[Rule, ...], skip_comments: bool = False) -> DataFrame:
    """rows + (rule, severity): one row per line and rule that applies."""
    tests = []
    for r in rules:
        test = F.col("line").rlike(r.pattern)
        if r.but:
            test = test & ~F.col("line").rlike(r.but)
        if r.languages:
            test = test & F.col("language").isin(*r.languages)
        tests.append(F.when(test, F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"))))
    if skip_comments:
        rows = rows.where(~is_comment(F.col("line"), F.col("language")))
    found = rows.withColumn("hit", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())))
    return found.select("*", "hit.rule", "hit.severity").drop("hit")


def is_comment(line: Column, language: Column) -> Column:
    s = F.ltrim(line)
    return F.when(language == "python", F.startswith(s, F.lit("#"))).otherwise(F.startswith(s, F.lit("//")) | F.startswith(s, F.lit("*")) | F.startswith(s, F.lit("/*")))


def first_per_file(found: DataFrame, n: int = 1) -> DataFrame:
    """The first n hits of every rule in every file."""
    order = W.partitionBy("file_id", "rule").orderBy("line_no")
    return found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).drop("k")


def confirmed(found: DataFrame, rows: DataFrame, pattern: str) -> DataFrame:
    """Hits in files where some line holds a second signal."""
    signal = rows.where(F.col("line").rlike(pattern)).select("file_id").distinct()
    return found.join(signal, "file_id", "left_semi")


#: Tags of comments, and how severe they are.
TAGS = {"BUG": "high", "FIXME": "high", "HACK": "medium", "TODO": "medium", "XXX": "low"}


def todo_tags(rows: DataFrame) -> DataFrame:
    """(file_id, line_no, tag, severity): comments that begin with a tag."""
    tag = F.regexp_extract("line", r"^\s*(?:#+|//+|/?\*+)\s*(" + "|".join(TAGS) + r")\b", 1)
    names = F.create_map(*[F.lit(x) for pair in TAGS.items() for x in pair])
    return rows.withColumn("tag", tag).where("tag <> ''").select("file_id", "line_no", "tag", names[F.col("tag")].alias("severity"))


def commented_code(texts: DataFrame, least: int = 3) -> DataFrame:
    """(file_id, first_line, n): runs of neighbouring comment lines that look like code, within the lines of each file."""
    code = r"^\s*(#|//)\s*[\w.]+\s*(=|:=|\()|^\s*(#|//)\s*(return|if|for|while)\b.*"
    flags = F.array_join(F.transform("all_", lambda x: F.when(x.rlike(code), "1").otherwise("0")), "")
    runs = texts.select("file_id", flags.alias("flags")).where(F.col("flags").contains("1" * least))
    # the pieces from one run to the next: noughts, then ones
    pieces = runs.select("file_id", F.posexplode(F.regexp_extract_all("flags", F.lit("0*1+"), F.lit(0))).alias("i", "piece"), F.regexp_extract_all("flags", F.lit("0*1+"), F.lit(0)).alias("ps"))
    before = F.coalesce(F.aggregate(F.slice("ps", 1, F.col("i")), F.lit(0), lambda acc, x: acc + F.length(x)), F.lit(0))
    zeros = F.length(F.regexp_extract("piece", "^0*", 0))
    n = F.length("piece") - zeros
    return pieces.select("file_id", (before + zeros + 1).alias("first_line"), n.alias("n")).where(F.col("n") >= least)


def deep_nesting(texts: DataFrame, above: int = 4, per_file: int = 5) -> DataFrame:
    """(file_id, line_no, depth): lines nested deeper than allowed, by their leading indent; the first of each file."""
    unit = F.when(F.col("language").isin("javascript", "typescript"), 2).otherwise(4)

    def deep(x, i):
        lead = F.regexp_replace(F.regexp_extract(x, r"^([ \t]*)", 1), "\t", "    ")
        return F.struct((i + 1).alias("line_no"), F.when(F.length(F.trim(x)) > 0, F.floor(F.length(lead) / unit).cast("int")).alias("depth"))

    found = F.slice(F.filter(F.transform("all_", deep), lambda s: s["depth"] > above), 1, per_file)
    return texts.select("file_id", F.explode(found).alias("s")).select("file_id", "s.line_no", "s.depth")


def magic_numbers(rows: DataFrame) -> DataFrame:
    """(file_id, value, n): numbers of three digits or more in code, but round ones, powers of two and HTTP codes."""
    code = rows.where(~is_comment(F.col("line"), F.col("language")) & ~F.col("line").rlike("[\"'`]"))
    numbers = code.select("file_id", F.explode(F.regexp_extract_all("line", F.lit(r"(?:^|[^\w.])(\d{3,9})(?:$|[^\w.])"), F.lit(1))).alias("text")).select("file_id", F.col("text").cast("bigint").alias("value"))
    fine = (F.col("value") % 100 == 0) | F.col("value").isin(128, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768, 65536, 201, 204, 301, 302, 304, 401, 403, 404, 409, 422, 429, 502, 503)
    return numbers.where(~fine).groupBy("file_id", "value").agg(F.count("*").alias("n"))


def _where(texts: DataFrame, test) -> DataFrame:
    """(file_id, line_no): the lines for which test(line, index) holds, told within the lines of each file."""
    found = F.filter(F.transform("all_", lambda x, i: F.when(test(x, i), i + 1)), lambda n: n.isNotNull())
    return texts.select("file_id", F.explode(found).alias("line_no"))


def io_in_loops(texts: DataFrame, window: int = 10) -> DataFrame:
    """(file_id, line_no): loops with an opening of a file or a call to a service in their next lines."""
    opens = lambda y: y.rlike(r"\b(open|fetch|publish|load)\w*\(")
    return _where(texts, lambda x, i: x.rlike(r"^\s*(for|while)\b") & F.exists(F.slice("all_", i + 2, window), opens))


def docstring_lines(texts: DataFrame) -> DataFrame:
    """(file_id, line_no): lines of Python files inside or on the border of a triple-quoted text of either kind of quotes.

    A text that is open ends on the line where its own mark stands an odd number of times; one folds over the lines once."""
    marks = ('"""', "'''")

    def run(batches):
        for b in batches:
            keys, numbers = [], []
            for key, lines in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                inside = ""
                for i, line in enumerate(lines, 1):
                    first = inside or min((m for m in marks if m in line), key=line.find, default="")
                    if first:
                        keys.append(key)
                        numbers.append(i)
                        if line.count(first) % 2:
                            inside = "" if inside else first
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(numbers, pa.int32())], names=["file_id", "line_no"])

    return texts.where("language = 'python'").select("file_id", "all_").mapInArrow(run, "file_id bigint, line_no int")


def silent_except(texts: DataFrame) -> DataFrame:
    """(file_id, line_no): handlers whose first statement neither logs nor raises."""
    handler = r"^\s*except\b.*:\s*$|catch\s*(\([^)]*\))?\s*\{\s*$"
    loud = lambda y: y.rlike(r"(?i)log|warn|error|raise|throw")
    return _where(texts, lambda x, i: x.rlike(handler) & ~F.coalesce(loud(F.get("all_", i + 1)), F.lit(True)))


def absent_signals(rows: DataFrame, signals: dict[str, str]) -> DataFrame:
    """(repo, signal): signals that no line of a repository shows."""
    repo = F.split("file_path", "/")[0]
    seen = rows.select(repo.alias("repo"), *[F.col("line").rlike(p).alias(n) for n, p in signals.items()]).groupBy("repo").agg(*[F.max(F.col(n).cast("int")).alias(n) for n in signals])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), F.col(n).alias("seen")) for n in signals]))
    return seen.select("repo", pairs.alias("p")).where("p.seen = 0").select("repo", "p.signal")
