"""Checks on whole files and sets of files: sizes, duplicates, names, imports, tests, maturity, capabilities."""

from __future__ import annotations

import difflib
from collections import Counter
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.session import cut


def functions(files: DataFrame) -> DataFrame:
    """(file_id, file_path, name, start_line, n_lines, code): the functions of every file, with their text."""
    f = files.where("raw_content is not null")
    rows = f.select("file_id", "file_path", T.lines(F.col("raw_content")).alias("all_"), F.explode("functions").alias("f"))
    code = F.array_join(F.slice("all_", F.greatest(F.lit(1), F.col("f.start_line")), F.greatest(F.lit(1), F.col("f.end_line") - F.col("f.start_line") + 1)), "\n")
    return rows.select("file_id", "file_path", F.col("f.name").alias("name"), F.col("f.start_line").alias("start_line"), (F.col("f.end_line") - F.col("f.start_line") + 1).alias("n_lines"), code.alias("code"))


def grade(n: Column, low: int, medium: int, high: int, critical: int) -> Column:
    return F.when(n > critical, "critical").when(n > high, "high").when(n > medium, "medium").when(n > low, "low")


def long_functions(fs: DataFrame) -> DataFrame:
    return fs.where("n_lines > 100").select("file_id", "name", "start_line", "n_lines", F.when(F.col("n_lines") > 300, "critical").when(F.col("n_lines") > 200, "high").when(F.col("n_lines") > 150, "medium").otherwise("low").alias("severity"))


def complexity(fs: DataFrame, above: int = 10) -> DataFrame:
    """(file_id, name, start_line, branches, severity): 1 and a count of branching words."""
    n = T.count_matches(F.col("code"), r"\b(?:if|elif|for|while|except|case|catch)\b") + 1
    return fs.withColumn("branches", n).where(F.col("branches") > above).select("file_id", "name", "start_line", "branches", F.when(F.col("branches") > 30, "critical").when(F.col("branches") > 20, "high").when(F.col("branches") > 15, "medium").otherwise("low").alias("severity"))


def cognitive(fs: DataFrame, at_least: int = 15) -> DataFrame:
    """(file_id, name, start_line, load): branches weigh more the deeper the words before have nested, which only grows; every return
    but the last weighs one; as one fold over the words."""
    words = F.regexp_extract_all("code", F.lit(r"\b(?:if|for|while|except|catch|else|and|or|return)\b|&&|\|\|"), F.lit(0))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("depth"))
    branch = lambda w: w.isin("if", "for", "while", "except", "catch")
    step = lambda acc, w: F.struct((acc["n"] + F.when(branch(w), 1 + acc["depth"]).otherwise(1)).alias("n"), (acc["depth"] + F.when(branch(w), 1).otherwise(0)).alias("depth"))
    load = F.aggregate(words, zero, step, lambda acc: acc["n"]) - F.array_contains(words, "return").cast("int")
    return fs.withColumn("load", load).where(F.col("load") >= at_least).select("file_id", "name", "start_line", "load")


def parameters(fs: DataFrame, above: int = 8) -> DataFrame:
    """(file_id, name, start_line, n): functions with many parameters, counted by commas at the first bracket."""
    inside = F.regexp_extract("code", r"\(([^()]*)\)", 1)
    n = F.when(F.trim(inside) == "", 0).otherwise(T.count_matches(inside, ",") + 1)
    return fs.withColumn("n", n).where(F.col("n") > above).select("file_id", "name", "start_line", "n")


def naming(fs: DataFrame) -> DataFrame:
    """(file_id, name, suggestion): Python functions with capitals in their names."""
    return fs.where(T.language(F.col("file_path")) == "python").where(F.col("name").rlike("[A-Z]")).select("file_id", "name", T.snake_case(F.col("name")).alias("suggestion")).distinct()


def duplicates(files: DataFrame) -> DataFrame:
    """(digest, n, first_id): contents that several file_ids share; blank ones don't count."""
    f = files.where("trim(raw_content) <> ''").select("file_id", F.md5("raw_content").alias("digest")).distinct()
    return f.groupBy("digest").agg(F.count("*").alias("n"), F.min("file_id").alias("first_id")).where("n > 1")


def same_heads(files: DataFrame, head: int = 100) -> DataFrame:
    """(size, digest, n, first_path): files of one size whose first lines are the same; the smallest path is the one to keep."""
    f = files.where("trim(raw_content) <> ''")
    start = F.md5(F.array_join(F.slice(T.lines(F.col("raw_content")), 1, head), "\n"))
    return f.groupBy(F.length("raw_content").alias("size"), start.alias("digest")).agg(F.count("*").alias("n"), F.min("file_path").alias("first_path")).where("n > 1")


def _common(x: str, y: str) -> int:
    """Length of the longest common subsequence, a row of the table as the bits of one number."""
    places: dict[str, int] = {}
    for i, c in enumerate(x):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(x)) - 1
    v = full
    for c in y:
        u = v & places.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(x) - v.bit_count()


def similar_heads(files: DataFrame, head: int = 100, above: float = 0.9, block: int = 200) -> DataFrame:
    """(size, first_path, path, ratio): pairs of files of one size whose first lines differ but are more similar than above,
    by the ratio of difflib's SequenceMatcher with the smaller path first; of files with the same head only the first counts.

    The matcher leaves out frequent characters by default, which loses near copies; a pair that fails so is matched with all
    of them. Every pair of a size is compared: sizes of more than block files are parted into blocks, and each pair of blocks
    is a group of its own. What can't reach the ratio by its lengths, characters or longest common subsequence (matching
    blocks are one) is dropped before.
    """
    f = files.where("trim(raw_content) <> ''")
    lines = T.lines(F.col("raw_content"))
    text = F.concat(F.array_join(F.slice(lines, 1, head), "\n"), F.when(F.size(lines) > head, "\n").otherwise(""))
    heads = cut(f.groupBy(F.length("raw_content").alias("size"), text.alias("head")).agg(F.min("file_path").alias("path")))
    blocks = heads.groupBy("size").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1")
    own = F.pmod(F.xxhash64("path", "head"), F.col("blocks")).cast("int")
    rows = heads.join(blocks, "size").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("size", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "path", "head")
    a, b = (rows.select("size", "low", "high", *(F.col(c).alias(f"{c}_{side}") for c in ("own", "path", "head"))) for side in "ab")
    la, lb = F.length("head_a"), F.length("head_b")
    pairs = a.join(b, ["size", "low", "high"]).where(
        (F.struct("path_a", "head_a") < F.struct("path_b", "head_b")) & ((F.col("low") == F.col("high")) | (F.col("own_a") != F.col("own_b"))) & (2 * F.least(la, lb) > above * (la + lb))
    )

    def ratios(batches):
        for batch in batches:
            kept, found, counts = [], [], {}
            for i, (x, y) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                cx, cy = (counts[t] if t in counts else counts.setdefault(t, Counter(t)) for t in (x, y))
                least = above * (len(x) + len(y)) / 2
                if sum(min(n, cy[c]) for c, n in cx.items() if c in cy) <= least or _common(x, y) <= least:
                    continue
                for junk in (True, False):
                    if (ratio := difflib.SequenceMatcher(None, x, y, junk).ratio()) > above:
                        kept.append(i)
                        found.append(ratio)
                        break
            part = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(found, pa.float64())], names=["size", "first_path", "path", "ratio"])

    return pairs.select("size", "path_a", "path_b", "head_a", "head_b").mapInArrow(ratios, "size int, first_path string, path string, ratio double")


#: Paths that a repository should not hold.
UNWANTED = {"dependencies": r"(^|/)(node_modules|site-packages|\.venv|venv)/", "products": r"(^|/)(dist|build|target|out)/", "caches": r"(^|/)(__pycache__|\.pytest_cache|\.mypy_cache)/|\.pyc$", "settings": r"(^|/)[^/]*\.env$", "logs": r"\.(log|tmp|bak|swp)$"}


def unwanted(files: DataFrame) -> DataFrame:
    """(repo, kind, n_files, size): files that should have been ignored, the first kind that fits."""
    kind = None
    for name, p in UNWANTED.items():
        test = F.col("file_path").rlike(p)
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    f = files.withColumn("kind", kind).where("kind is not null")
    return f.groupBy("repo", "kind").agg(F.count("*").alias("n_files"), F.sum(F.coalesce(F.length("raw_content"), F.lit(0))).alias("size"))


def same_name_groups(files: DataFrame) -> DataFrame:
    """(name, n): base names that several directories have."""
    return files.select("file_path", T.base_name(F.col("file_path")).alias("name")).distinct().groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


def blank(files: DataFrame) -> DataFrame:
    """(file_id, kind): files of no bytes, of blanks, or of nothing but comments and imports."""
    f = files.where("raw_content is not null")
    meaning = F.exists(T.lines(F.col("raw_content")), lambda x: (F.trim(x) != "") & ~x.rlike(r"^\s*(#|//|\*|/\*|import\b|from\b|package\b)"))
    kind = F.when(F.col("raw_content") == "", "empty").when(F.trim(F.regexp_replace("raw_content", r"\s", "")) == "", "blank").when(~meaning, "shell")
    return f.select("file_id", kind.alias("kind")).where("kind is not null")


def no_final_newline(files: DataFrame) -> DataFrame:
    return files.where("raw_content <> ''").where(~F.endswith("raw_content", F.lit("\n"))).select("file_id").distinct()


def documentation(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(folder, n_functions, n_documented, share): how much of every folder's functions has a docstring."""
    f = chunks.dropDuplicates(["chunk_id"]).where(F.lower("chunk_type").isin("function", "method"))
    has = (F.trim(F.coalesce("docstring", F.lit(""))) != "").cast("int")
    return f.groupBy(T.directory(F.col("file_path")).alias("folder")).agg(F.count("*").alias("n_functions"), F.sum(has).alias("n_documented"), F.round(F.avg(has), 4).alias("share"))


#: Roots that belong to the languages themselves.
STANDARD = ("os", "re", "sys", "json", "typing", "logging", "pathlib", "log", "fmt", "strings", "time", "java", "base64", "errors", "context")


def import_roots(files: DataFrame) -> DataFrame:
    """(file_id, repo, file_path, root): the first segment of every import."""
    rows = files.select("file_id", "repo", "file_path", F.explode("imports").alias("i"))
    return rows.select("file_id", "repo", "file_path", F.regexp_extract("i", r"^(?:\./|\.\./)*([A-Za-z_@][\w-]*)", 1).alias("root")).where("root <> ''").distinct()


def missing_modules(files: DataFrame) -> DataFrame:
    """(root, n_files, first_file): imported roots that are neither standard nor a folder or module of any repository."""
    roots = import_roots(files).where(~F.col("root").isin(*STANDARD))
    paths = files.select("file_path").distinct()
    local = paths.select(F.explode(F.split("file_path", "/")).alias("root")).union(paths.select(T.stem(F.col("file_path")).alias("root"))).distinct()
    return roots.join(local, "root", "left_anti").groupBy("root").agg(F.count("*").alias("n_files"), F.min("file_path").alias("first_file"))


def dead_imports(files: DataFrame) -> DataFrame:
    """(file_id, binding): Python imports whose last segment occurs in no other line of the file."""
    py = files.where("raw_content is not null").where(T.language(F.col("file_path")) == "python")
    names = py.select("file_id", "raw_content", F.explode("imports").alias("i")).select("file_id", "raw_content", F.regexp_extract("i", r"(\w+)$", 1).alias("binding")).where("binding <> ''")
    body = F.regexp_replace("raw_content", r"(?m)^\s*(?:import|from)\b.*$", "")
    words = F.array_distinct(F.regexp_extract_all(body, F.lit(r"\w+"), F.lit(0)))
    return names.withColumn("used", F.array_contains(words, F.col("binding"))).where("not used").select("file_id", "binding").distinct()


def dead_functions(chunks: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, n): names of functions that neither text nor graph calls."""
    from gneiss.operators.search import textual_calls

    own = chunks.where(F.lower("chunk_type") == "function").select("name").distinct()
    called = textual_calls(chunks).select("name")
    linked = edges.where("type in ('CALLS', 'REFERENCES') and source <> target").select(F.col("target").alias("id")).distinct().join(nodes, "id").select("name").distinct()
    return own.join(called, "name", "left_anti").join(linked, "name", "left_anti")


def env_unreferenced(files: DataFrame) -> DataFrame:
    """(repo, variable): variables of .env files that no other file of the repository mentions."""
    f = files.where("raw_content is not null")
    env = f.where(F.col("file_path").rlike(r"\.env$")).select("repo", F.explode(T.lines(F.col("raw_content"))).alias("line"))
    names = env.select("repo", F.regexp_extract("line", r"^\s*(?:export\s+)?([A-Z][A-Z0-9_]*)\s*=", 1).alias("variable")).where("variable <> ''").distinct()
    used = f.where(~F.col("file_path").rlike(r"\.env$")).select("repo", F.explode(F.array_distinct(F.regexp_extract_all("raw_content", F.lit(r"[A-Z][A-Z0-9_]+"), F.lit(0)))).alias("variable")).distinct()
    return names.join(used, ["repo", "variable"], "left_anti")


#: Signals of a mature project, found in paths or texts.
MATURITY = {"tests": r"(^|/)tests?/|_test\.", "logging": r"\blogg(er|ing)\b|\blog\.|LOG\.", "configuration": r"\.(yaml|env|toml)$", "errors": r"\b(try|except|catch)\b", "locks": r"lock\.json$|go\.sum$", "types": r"->|: any\b|: str\b", "documentation": r"(?i)readme|\.md$", "docker": r"(?i)dockerfile"}


def maturity(files: DataFrame) -> DataFrame:
    """(repo, n_passed, score, grade): which signals any file of a repository shows; A to F."""
    f = files.select("repo", F.concat_ws("\n", "file_path", "raw_content").alias("t"))
    n = len(MATURITY)
    by = f.select("repo", *[F.col("t").rlike("(?m)" + p).cast("int").alias(k) for k, p in MATURITY.items()]).groupBy("repo").agg(*[F.max(k).alias(k) for k in MATURITY])
    passed = sum((F.col(k) for k in MATURITY), F.lit(0))
    share = F.col("n_passed") / n
    return by.select("repo", passed.alias("n_passed")).select("repo", "n_passed", F.round(share * 100, 1).alias("score"), F.when(share >= 0.9, "A").when(share >= 0.75, "B").when(share >= 0.6, "C").when(share >= 0.4, "D").otherwise("F").alias("grade"))


#: What a file can do, by its text.
CAPABILITIES = {"async": r"\basync\b", "errors": r"\b(try|catch|except)\b", "logging": r"\blog|console\.", "loops": r"\bfor\b", "sql": r"\bSELECT\b", "http": r"https?://", "classes": r"\bclass\b", "null_checks": r"\b(None|null|nil)\b", "config": r"\b[A-Z]+_[A-Z_]+\b", "format": r"%s|\{0\}", "regex": r"\br\"|/g;", "imports": r"^import|^from|require\(", "raises": r"\b(raise|throw)\b", "main": r"__main__|func main", "types": r": any|->|List<"}


def capabilities(files: DataFrame) -> DataFrame:
    """(file_id, repo, signature): a bit per capability."""
    f = files.where("raw_content is not null")
    bits = sum((F.when(F.col("raw_content").rlike("(?m)" + p), 1 << i).otherwise(0) for i, p in enumerate(CAPABILITIES.values())), F.lit(0))
    return f.select("file_id", "repo", bits.alias("signature"))


def capability_gaps(found: DataFrame, below: float = 0.6) -> DataFrame:
    """(repo, capability, adoption): capabilities that some, but less than a share of a repository's files have."""
    each = found.select("repo", F.posexplode(F.array(*[F.lit(n) for n in CAPABILITIES])).alias("i", "capability"), "signature")
    has = F.expr("shiftright(signature, i) & 1")
    g = each.groupBy("repo", "capability").agg(F.round(F.avg(has), 4).alias("adoption"))
    return g.where((F.col("adoption") > 0) & (F.col("adoption") < below))


#: Capabilities that set a file apart from most others.
SPECIAL = ("async", "sql", "http", "regex", "main")


def signature_pairs(found: DataFrame, shared: int = 5, special: tuple[str, ...] = SPECIAL) -> DataFrame:
    """(a, b): links of each distinct signature with the sets of `shared` capabilities it holds, one of them a special one (b below 0).

    Signatures that share enough capabilities share such a set, so their components are those of these links; no two
    signatures are compared. There are at most 2^15 signatures, however many files."""
    bits = {n: i for i, n in enumerate(CAPABILITIES)}
    sets = [sum(1 << bits[n] for n in c) for c in combinations(CAPABILITIES, shared) if set(c) & set(special)]
    every = F.array(*[F.lit(x) for x in sets])
    held = F.filter(every, lambda x: F.col("signature").bitwiseAND(x) == x)
    return found.select("signature").distinct().select(F.col("signature").alias("a"), F.explode(held).alias("x")).select("a", (-F.col("x")).alias("b"))


#: Architectures by words in paths and text.
ARCHITECTURES = {"layered": r"/(service|domain|storage|adapters)/", "pipeline": r"/(pipeline|jobs|intake|export)/", "web": r"/(web|api|handlers|app)/", "library": r"/(lib|pkg|core|internal)/"}


def architectures(files: DataFrame) -> DataFrame:
    """(repo, architecture, n_hits, confidence): the architecture that most files of a repository speak for."""
    f = files.select("repo", "file_path").distinct()
    hit = F.explode(F.array(*[F.when(F.col("file_path").rlike(p), F.lit(n)) for n, p in ARCHITECTURES.items()]))
    counts = f.select("repo", hit.alias("architecture")).where("architecture is not null").groupBy("repo", "architecture").agg(F.count("*").alias("n"))
    g = counts.groupBy("repo").agg(F.max(F.struct("n", "architecture")).alias("m"), F.sum("n").alias("total"))
    return g.select("repo", F.col("m.architecture").alias("architecture"), F.col("m.n").alias("n_hits"), F.round(F.col("m.n") / F.col("total"), 4).alias("confidence"))
