"""Checks that join files, chunks, packages and documents: simplification, supply chain, governance, blind spots, junk.

files: one row per file, as lines.latest gives; chunks: any rows, an id counts once. Names are joined, never collected; what is
written into an expression is a table of fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.operators import files as O
from gneiss.operators import lines as L


def _graded(n: Column, low: int, high: int, critical: int) -> Column:
    return F.when(n > critical, "critical").when(n > high, "high").when(n > low, "medium")


def _once(chunks: DataFrame, *kinds: str) -> DataFrame:
    """Chunks of some types, a chunk_id once: repeated rows are equal, so only ids and spans are shuffled where that is enough."""
    return chunks.where(F.lower(F.trim("chunk_type")).isin(*kinds))


# simplification


def large_functions(fs: DataFrame) -> DataFrame:
    """(file_id, name, start_line, n_lines, severity, savings): functions above 80 lines; half as long would do."""
    return fs.where("n_lines > 80").select("file_id", "name", "start_line", "n_lines", _graded(F.col("n_lines"), 80, 120, 200).alias("severity"), (F.col("n_lines") - 40).alias("savings"))


def large_classes(chunks: DataFrame) -> DataFrame:
    """(chunk_id, name, n_lines, severity, savings): classes above 500 lines."""
    n = F.col("end_line") - F.col("start_line") + 1
    spans = _once(chunks, "class").select("chunk_id", "name", n.alias("n_lines")).distinct()
    return spans.where("n_lines > 500").select("chunk_id", "name", "n_lines", _graded(F.col("n_lines"), 500, 800, 1000).alias("severity"), (F.col("n_lines") - 200).alias("savings"))


def dead_classes(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(name, n_references): classes that no text names but once, where they are defined."""
    names = _once(chunks, "class").select("name").distinct()
    words = F.explode(F.regexp_extract_all("raw_content", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))
    counts = files.where("raw_content is not null").select(words.alias("name")).where(F.col("name").rlike("[A-Z]")).groupBy("name").agg(F.count("*").alias("n"))
    return names.join(counts, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n_references")).where("n_references <= 1")


#: Libraries that the standard library can stand in for, fixed values.
REPLACEABLE = {
    "dateutil": "datetime", "arrow": "datetime", "pendulum": "datetime", "orjson": "json", "ujson": "json", "toolz": "functools", "typing_extensions": "typing", "loguru": "logging",
    "requests": "urllib.request", "regex": "re", "pytest": "unittest", "click": "argparse", "typer": "argparse", "celery": "concurrent.futures", "SQLAlchemy": "sqlite3", "pandas": "csv", "lxml": "xml.etree",
}


def replaceable_imports(files: DataFrame, table: dict[str, str] = REPLACEABLE) -> DataFrame:
    """(repo, library, standard, n_files): imports that contain the name of a library the standard one can replace."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("library"), F.lit(v).alias("standard")) for k, v in table.items()]))
    each = files.select("file_id", "repo", F.explode("imports").alias("i")).withColumn("t", rows).where(F.col("i").contains(F.col("t.library")))
    return each.groupBy("repo", F.col("t.library").alias("library"), F.col("t.standard").alias("standard")).agg(F.countDistinct("file_id").alias("n_files"))


def thin_abstractions(chunks: DataFrame, below: int = 30) -> DataFrame:
    """(chunk_id, name, n_lines): classes with a base that are called abstract, base, interface or protocol and hold little."""
    n = F.col("end_line") - F.col("start_line") + 1
    based = F.col("code").rlike(r"(?m)^\s*(?:export\s+|public\s+|abstract\s+)*class\s+\w+\s*(?:\(\s*\w|extends\b|implements\b)")
    rows = _once(chunks, "class").where(based & F.lower("name").rlike("base|abstract|interface|protocol"))
    return rows.select("chunk_id", "name", n.alias("n_lines")).distinct().where(F.col("n_lines") < below)


def thin_wrappers(chunks: DataFrame) -> DataFrame:
    """(chunk_id, name): functions of at most three lines of code of which the last only returns what a call gives."""
    full = F.filter(F.transform(T.lines(F.col("code")), lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    rows = _once(chunks, "function", "method").select("chunk_id", "name", full.alias("s")).where((F.size("s") <= 3) & (F.size("s") > 0))
    last = F.get("s", F.size("s") - 1)
    plain = F.forall("s", lambda x: x.rlike(r'^(return|def |""")'))
    return rows.where(F.startswith(last, F.lit("return ")) & F.contains(last, F.lit("(")) & plain).select("chunk_id", "name").distinct()


def by_savings(fs: DataFrame, chunks: DataFrame, most: int = 50) -> DataFrame:
    """(kind, name, savings): what simplifying could save, the largest first; a top-k report."""
    items = large_functions(fs).select(F.lit("function").alias("kind"), "name", "savings").unionByName(large_classes(chunks).select(F.lit("class").alias("kind"), "name", "savings"))
    return items.orderBy(F.desc("savings"), "kind", "name").limit(most)


# supply chain


def unpinned_imports(files: DataFrame, manifests: str = r"(^|/)(requirements[\w.-]*\.txt|pyproject\.toml|package\.json|go\.mod|setup\.py)$") -> DataFrame:
    """(repo, package, first_file): roots that Python files import, neither standard nor local, in repositories without a manifest."""
    bare = files.select("repo").distinct().join(files.where(F.col("file_path").rlike(manifests)).select("repo").distinct(), "repo", "left_anti")
    paths = files.select("repo", "file_path").distinct()
    local = paths.select("repo", F.explode(F.split("file_path", "/")).alias("root")).union(paths.select("repo", T.stem(F.col("file_path")).alias("root"))).distinct()
    roots = O.import_roots(files.where(T.language(F.col("file_path")) == "python")).where(~F.col("root").isin(*O.STANDARD) & ~F.startswith("root", F.lit("_")))
    return roots.join(bare, "repo", "left_semi").join(local, ["repo", "root"], "left_anti").groupBy("repo", F.col("root").alias("package")).agg(F.min("file_path").alias("first_file"))


#: Packages that their maintainers gave up, and what follows them; fixed values.
DEPRECATED = {"dgrijalva/jwt-go": "github.com/golang-jwt/jwt"}


def deprecated(packages: DataFrame, table: dict[str, str] = DEPRECATED) -> DataFrame:
    """packages (with package) + migration: those that are, or end in, a deprecated name; a version suffix /vN doesn't count."""
    bare = F.regexp_replace("package", r"/v\d+$", "")
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("migration")) for k, v in table.items()]))
    return packages.withColumn("t", rows).where((bare == F.col("t.k")) | F.endswith(bare, F.concat(F.lit("/"), F.col("t.k")))).select(*packages.columns, "t.migration")


def runtime_installs(rows: DataFrame) -> DataFrame:
    """(file_id, line_no): the first line of each file that installs packages while running."""
    hit = F.col("line").rlike(r"(?:os\.system|subprocess\.\w+|Popen|check_call)\(.*\bpip[3]?\b.*\binstall\b|pip\.main\(|exec\w*\(.*\bnpm (?:install|i)\b")
    return rows.where(hit).groupBy("file_id").agg(F.min("line_no").alias("line_no"))


def gated(found: DataFrame, files: DataFrame, gates: dict[str, str]) -> DataFrame:
    """found (repo, advisory, severity) with severity low where the part that an advisory needs occurs in no file of the repository."""
    tests = [F.max(F.col("raw_content").rlike(p).cast("int")).alias(f"g{i}") for i, p in enumerate(gates.values())]
    seen = files.where("raw_content is not null").groupBy("repo").agg(*tests)
    gate = F.lit(1)
    for i, name in enumerate(gates):
        gate = F.when(F.col("advisory") == name, F.coalesce(f"g{i}", F.lit(0))).otherwise(gate)
    return found.join(seen, "repo", "left").withColumn("severity", F.when(gate == 0, "low").otherwise(F.col("severity"))).select(*found.columns)


_OSV = "struct<vulns:array<struct<id:string,aliases:array<string>,summary:string,database_specific:struct<severity:string>,affected:array<struct<ranges:array<struct<events:array<struct<introduced:string,fixed:string>>>>>>>>>"


def osv_advisories(answers: DataFrame) -> DataFrame:
    """(package, advisory, severity, summary, fixed) from the JSON answers (package, answer) of an advisory service.

    A CVE among the aliases names an advisory, else its own id; one that came under several ids counts once."""
    v = answers.select("package", F.explode(F.from_json("answer", _OSV)["vulns"]).alias("v"))
    cve = F.get(F.filter("v.aliases", lambda a: F.startswith(a, F.lit("CVE-"))), 0)
    word = F.lower(F.coalesce("v.database_specific.severity", F.lit("medium")))
    severity = F.when(word == "moderate", "medium").when(word.isin("critical", "high", "medium", "low"), word).otherwise("medium")
    events = F.flatten(F.flatten(F.transform("v.affected", lambda a: F.transform(a["ranges"], lambda r: r["events"]))))
    fixed = F.get(F.filter(F.transform(events, lambda e: e["fixed"]), lambda x: x.isNotNull()), 0)
    rows = v.select("package", F.coalesce(cve, "v.id").alias("advisory"), severity.alias("severity"), F.col("v.summary").alias("summary"), fixed.alias("fixed"))
    return rows.groupBy("package", "advisory").agg(F.min(F.struct("severity", "summary", "fixed")).alias("m")).select("package", "advisory", "m.severity", "m.summary", "m.fixed")


def dependency_drift(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(repo, package, side): what is declared but not imported, or imported but not declared, by repository."""
    root = F.lower(F.regexp_extract("package", r"([A-Za-z][\w-]*?)(?:-[a-z_]+\d*)?$", 1))
    declared = packages.select("repo", root.alias("package")).distinct()
    used = O.import_roots(files).where(~F.col("root").isin(*O.STANDARD)).select("repo", F.lower("root").alias("package")).distinct()
    used = used.join(declared.select("repo").distinct(), "repo", "left_semi")
    only = lambda a, b, name: a.join(b, ["repo", "package"], "left_anti").withColumn("side", F.lit(name))
    return only(declared, used, "declared").unionByName(only(used, declared, "imported"))


# governance

#: Files of settings, which are scanned for secrets apart from source.
SETTINGS = r"\.(env|ya?ml|json|toml|cfg|ini|conf)$"
_SET = r"(?i)(password|passwd|secret|token|api_?key)\w*[\"']?\s*[:=]\s*[\"']?([^\s\"'#,{}$<]{8,})"
_GUIDE = r"(?i)changeme|your[_-]|example|placeholder|dummy|\*{3,}|<[a-z_ ]+>|token_?budget"


def settings_secrets(files: DataFrame) -> DataFrame:
    """(file_id, line_no): values given to names of secrets in files of settings, but placeholders."""
    rows = L.lines(files.where(F.lower("file_path").rlike(SETTINGS)))
    return rows.where(F.col("line").rlike(_SET) & ~F.col("line").rlike(_GUIDE)).select("file_id", "line_no")


def document_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_secrets, n_bypass): lines of documents that give a secret away, or tell how to get around a check."""
    line = F.explode(T.lines(F.col("text")))
    rows = docs.where("text is not null").select("doc_id", line.alias("line"))
    secret = (F.col("line").rlike(_SET) & ~F.col("line").rlike(_GUIDE)).cast("int")
    bypass = F.col("line").rlike(r"(?i)\b(skip|disable|bypass|ignore)\b.{0,40}\b(check|review|scan|gate|whitelist|verification)").cast("int")
    return rows.groupBy("doc_id").agg(F.sum(secret).alias("n_secrets"), F.sum(bypass).alias("n_bypass")).where("n_secrets + n_bypass > 0")


def secrets_written(texts: DataFrame) -> DataFrame:
    """(file_id, line_no): lines that write a secret's name into a file, or functions that save an environment file with one."""
    secret = r"\b(api_key|API_KEY|secret|SECRET_KEY|token|password)\b"
    return L._where(texts, lambda x, i: (x.rlike(r"f[\"'].*\{[^}]*(key|secret|token|password)[^}]*\}") & x.rlike(r"write|\.env|dump")) | (x.rlike(r"^\s*(async )?def\s+\w*(save|write)\w*(env|key|secret|credential)") & F.exists(F.slice("all_", i + 2, 15), lambda y: y.rlike(secret))))


#: What modules of a layer may depend on, besides their own layer.
ALLOWED = {"interface": ("logic", "data", "support"), "logic": ("data", "support"), "data": ("support",), "support": ()}


def disallowed(arcs: DataFrame, layer, allowed: dict[str, tuple[str, ...]] = ALLOWED) -> DataFrame:
    """(a, b, from_layer, to_layer): dependencies of a module on a layer that its own may not depend on. layer: module -> column."""
    pairs = [f"{x}>{y}" for x, ys in allowed.items() for y in (x, *ys)]
    rows = arcs.select("a", "b", layer(F.col("a")).alias("from_layer"), layer(F.col("b")).alias("to_layer"))
    known = F.col("from_layer").isin(*allowed) & F.col("to_layer").isin(*allowed)
    return rows.where((F.col("a") != F.col("b")) & known & ~F.concat_ws(">", "from_layer", "to_layer").isin(*pairs)).distinct()


def mutual(arcs: DataFrame) -> DataFrame:
    """(a, b; a < b): modules that depend on each other."""
    one = arcs.where("a <> b").select("a", "b").distinct()
    return one.where("a < b").join(one.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi")


def credential_exclusion(line: Column) -> Column:
    """Why a line that looks like a hard-coded credential is none; null where it may be one. The first reason counts."""
    words = "password|passwd|pwd|secret|token|api_?key|access_key|private_key"
    value = F.regexp_extract(line, rf"(?i)(?:{words})\w*[\"']?\s*[:=]+\s*[\"'`]([^\"'`]*)[\"'`]", 1)
    s = F.ltrim(line)
    return (
        F.when(line.rlike(rf"(?i)\br[\"'].*({words})"), "pattern")
        .when(line.rlike(r"\bdef\s+\w+\s*\(|\blambda\s"), "parameter")
        .when(line.rlike(r"environ|getenv|process\.env"), "environment")
        .when(line.rlike(r"\b(cfg|config|settings)\.\w+"), "settings")
        .when(line.rlike(r"\b(api_key|token|secret|password|pwd)\s*=\s*(api_key|token|secret|password|pwd)\b"), "passed on")
        .when(F.startswith(s, F.lit("#")) | F.startswith(s, F.lit("//")), "comment")
        .when(line.rlike(r"^\s*\w+\s*:\s*(Optional|str|Dict|List|Tuple|Any|Union)\b[^\"'`]*$"), "annotation")
        .when(F.startswith(s, F.lit('"""')), "docstring")
        .when(line.rlike(rf"(?i)\b({words})\s*=\s*[A-Za-z_]\w*\s*[,)]?\s*$"), "variable")
        .when(line.rlike(rf"(?i)\b({words})\s*=\s*\w+\.\w+"), "attribute")
        .when(value.rlike(r"(?i)your[_-]|xxx+|changeme|replace|example|placeholder|dummy|sample|todo|fixme|demo|fake|mock"), "placeholder")
        .when(value.rlike(r"^([a-z]+|[A-Z]+|\d+)$"), "plain value")
    )


def credential_lines(rows: DataFrame) -> DataFrame:
    """(reason, n): lines that give something to the name of a secret, by why they are no credential ('' where they may be one)."""
    named = rows.where(F.col("line").rlike(r"(?i)(password|passwd|pwd|secret|token|api_?key|access_key|private_key)\w*[\"']?\s*[:=]"))
    return named.groupBy(F.coalesce(credential_exclusion(F.col("line")), F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


def undated_statistics(docs: DataFrame, near: int = 40) -> DataFrame:
    """(source, n_years, n_claims): sources whose documents give percentages for several years without a word on their date nearby."""
    hit = F.regexp_extract("text", rf"(?s)(\d%.{{0,{near}}}?\b(?:19|20)\d\d\b)", 1)
    year = F.regexp_extract(hit, r"\b((?:19|20)\d\d)\b", 1)
    rows = docs.where(F.col("text").contains("%")).select("source", "doc_id", hit.alias("claim"), year.alias("year")).where((F.col("year") != "") & ~F.col("claim").rlike(r"(?i)as of|retrieved|source"))
    return rows.groupBy("source").agg(F.countDistinct("year").alias("n_years"), F.count("*").alias("n_claims")).where("n_years >= 2")


# blind spots and junk


def undocumented_folders(files: DataFrame, docs: DataFrame) -> DataFrame:
    """(folder, n_files, severity): folders of at least two files whose name no document's path or stem holds as a word."""
    folders = files.select(T.directory(F.col("file_path")).alias("folder"), "file_path").distinct().groupBy("folder").agg(F.count("*").alias("n_files")).where("n_files >= 2")
    words = docs.where("file_path is not null").select(F.explode(F.split(F.lower(F.regexp_replace("file_path", r"\.[A-Za-z0-9]+$", "")), r"[/_. -]+")).alias("word")).distinct()
    name = F.lower(T.base_name(F.col("folder")))
    return folders.withColumn("word", name).join(words, "word", "left_anti").select("folder", "n_files", F.when(F.col("n_files") >= 5, "high").otherwise("medium").alias("severity"))


def unindexed(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file_path, n_functions): files that define functions and no node of the graph lies in."""
    known = nodes.select(T.clean_path(F.col("file_path")).alias("file_path")).distinct()
    return files.where(F.size("functions") > 0).select("file_path", F.size("functions").alias("n_functions")).join(known, "file_path", "left_anti")


def orphans(files: DataFrame, days: int = 30) -> DataFrame:
    """(file_path, age_days): source files older than the newest by so many days, that no import of their repository names, and
    that are no entry."""
    newest = files.agg(F.max("scanned_at").alias("now_"))
    code = files.where((T.language(F.col("file_path")) != "") & ~T.stem(F.col("file_path")).isin("__init__", "main", "index", "setup")).where(~F.coalesce("raw_content", F.lit("")).rlike(r"__main__|func main\(|static void main"))
    aged = code.crossJoin(newest).withColumn("age_days", F.datediff("now_", "scanned_at")).where(F.col("age_days") > days)  # one row on the right
    named = files.select("repo", F.explode("imports").alias("i")).select("repo", F.regexp_extract("i", r"([\w-]+)$", 1).alias("stem")).distinct()
    return aged.withColumn("stem", T.stem(F.col("file_path"))).join(named, ["repo", "stem"], "left_anti").select("file_path", "age_days")


def missing_paths(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, line_no, path): literal folders put on the module path that no file lies in."""
    p = F.regexp_extract("line", r"sys\.path\.(?:insert|append)\(\s*(?:\d+\s*,\s*)?[\"']([^\"']+)[\"']", 1)
    asked = rows.select("file_id", "line_no", p.alias("path")).where("path <> ''").withColumn("folder", F.regexp_replace("path", r"^(?:\.{1,2}/)+|/+$", ""))
    there = files.select(T.directory(F.col("file_path")).alias("d")).distinct().select(F.explode(F.split("d", "/")).alias("folder")).union(files.select(T.directory(F.col("file_path")))).distinct()
    return asked.join(there, "folder", "left_anti").select("file_id", "line_no", "path")


def reverified(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(status, n): findings by whether their line is there: missing file, beyond the file's end, blank or present."""
    f = findings.select("id", "file_path", "line").distinct()
    texts = files.select(F.col("file_path").alias("p_"), T.lines(F.coalesce("raw_content", F.lit(""))).alias("all_"))
    both = f.join(texts, f.file_path == texts.p_, "left")
    line = F.get("all_", F.col("line") - 1)
    status = F.when(F.col("p_").isNull(), "missing").when(F.col("line").isNull() | (F.col("line") < 1) | (F.col("line") > F.size("all_")), "beyond").when(F.trim(line) == "", "blank").otherwise("present")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def broken_contracts(rows: DataFrame) -> DataFrame:
    """(path, n_files): paths of services that scripts of the front call and no other file names."""
    path = F.regexp_extract("line", r"[\"'`](?:https?://[\w.-]+)?(/[a-z][\w/-]*)[\"'`]", 1)
    named = rows.select("file_id", "language", path.alias("path")).where("path <> ''")
    front = F.col("language").isin("javascript", "typescript")
    return named.where(front).groupBy("path").agg(F.countDistinct("file_id").alias("n_files")).join(named.where(~front).select("path").distinct(), "path", "left_anti")


def go_functions(rows: DataFrame) -> DataFrame:
    """(file_id, line_no, name, receiver): functions and methods of Go files."""
    p = r"^func\s+(?:\(\s*\w*\s*\*?(\w+)[^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\("
    go = rows.where("language = 'go'").where(F.col("line").rlike(p))
    return go.select("file_id", "line_no", F.regexp_extract("line", p, 2).alias("name"), F.regexp_extract("line", p, 1).alias("receiver"))


def projects(files: DataFrame) -> DataFrame:
    """(repo, n_files, n_lines, n_functions, n_languages, n_imports): the summary of every repository."""
    lang = F.when(T.language(F.col("file_path")) != "", T.language(F.col("file_path")))
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return files.groupBy("repo").agg(F.count("*").alias("n_files"), F.sum("n_lines").alias("n_lines"), F.sum(size("functions")).alias("n_functions"), F.countDistinct(lang).alias("n_languages"), F.sum(size("imports")).alias("n_imports"))


#: Ways in which an entry of a typed whitelist matches.
KINDS = ("exact", "prefix", "suffix", "contains")


def typed_whitelist(rows: DataFrame, column: str, entries: list[tuple[str, str]]) -> DataFrame:
    """Rows that no entry (kind, value) of the whitelist covers; values compare in any case."""
    c = F.lower(F.coalesce(F.col(column), F.lit("")))
    test = F.lit(False)
    for kind, value in entries:
        v = F.lit(value.lower())
        test = test | {"exact": c == v, "prefix": F.startswith(c, v), "suffix": F.endswith(c, v), "contains": F.contains(c, v)}[kind]
    return rows.where(~test)


def chunks_of_file(chunks: DataFrame, part: str, most: int = 100) -> DataFrame:
    """Chunks of the files whose path holds a text, in the order of their lines; the first most."""
    rows = chunks.where(F.contains(F.lower("file_path"), F.lit(part.lower()))).select("chunk_id", "file_path", "chunk_type", "name", "start_line", "end_line").distinct()
    return rows.orderBy("file_path", "start_line", "chunk_id").limit(most)


# prompts and models

#: Governance of prompts: label, severity, words.
PROMPT_RULES = {
    "plain credentials": ("critical", r"(?i)(api[_ ]?key|password|token)\s*(is|=|:)\s*\S{8,}"), "bypassing review": ("high", r"(?i)(skip|bypass|without) (the )?(review|approval|gate)"),
    "hiding risks": ("high", r"(?i)(do not|don't|never) (mention|report|flag)|hide the"), "foreign content": ("medium", r"(?i)ignore (all |the )?(previous|above)|as an ai"),
}


def prompt_governance(docs: DataFrame) -> DataFrame:
    """(doc_id, label, severity): documents that hold words of a group, whole texts."""
    hits = F.array(*[F.when(F.col("text").rlike(p), F.struct(F.lit(n).alias("label"), F.lit(s).alias("severity"))) for n, (s, p) in PROMPT_RULES.items()])
    return docs.where("text is not null").select("doc_id", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("h")).select("doc_id", "h.label", "h.severity")


#: Rules on relying on a model's answer and on giving its weights away, and the classes of risk that other rules belong to.
MODEL_RULES = {"LLM09": r"(?i)\b(eval|exec)\(\s*(response|answer|completion|llm\w*)|return\s+(response|answer|completion)\s*$", "LLM10": r"(?i)(model|weights)\w*\.(save|upload|push_to_hub|export)\w*\(|send_file\(.*\.(pt|onnx|safetensors)"}
RISK_CLASSES = {
    "AGENT-SEC-01": "LLM01", "AGENT-SEC-02": "LLM01", "AGENT-SEC-03": "LLM01", "AGENT-SEC-36": "LLM02", "AGENT-SEC-37": "LLM02", "AGENT-SEC-LMEXEC": "LLM02", "AGENT-SEC-66": "LLM02", "AGENT-SEC-04": "LLM03", "AGENT-SEC-54": "LLM03", "AGENT-SEC-58": "LLM03", "AGENT-SEC-59": "LLM03",
    "AGENT-SEC-10": "LLM04", "AGENT-SEC-11": "LLM04", "AGENT-SEC-12": "LLM04", "AGENT-SEC-26": "LLM04", "AGENT-SEC-70": "LLM04", "AGENT-SEC-62": "LLM05", "AGENT-SEC-DESER": "LLM05", "AGENT-SEC-06": "LLM07", "AGENT-SEC-07": "LLM07", "AGENT-SEC-AUTH": "LLM07", "AGENT-SEC-PT": "LLM07", "AGENT-SEC-SSRF": "LLM07",
    "AGENT-SEC-08": "LLM08", "AGENT-SEC-16": "LLM08", "AGENT-SEC-17": "LLM08",
}


def model_risks(rows: DataFrame, rules: tuple) -> DataFrame:
    """(risk, n, n_files): the ten classes of risk with models by the hits of rules and of MODEL_RULES; LLM06 takes what belongs nowhere."""
    names = F.create_map(*[F.lit(x) for pair in RISK_CLASSES.items() for x in pair])
    other = L.hits(rows, rules, skip_comments=True).select("file_id", F.coalesce(names[F.col("rule")], F.lit("LLM06")).alias("risk"))
    code = rows.where(~L.is_comment(F.col("line"), F.col("language")))
    own = code.select("file_id", F.explode(F.array(*[F.when(F.col("line").rlike(p), F.lit(n)) for n, p in MODEL_RULES.items()])).alias("risk")).where("risk is not null")
    counts = other.unionByName(own).groupBy("risk").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("n_files"))
    every = F.explode(F.array(*[F.lit(f"LLM{i:02d}") for i in range(1, 11)]))
    return rows.sparkSession.range(1).select(every.alias("risk")).join(counts, "risk", "left").select("risk", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_files", F.lit(0)).alias("n_files"))
