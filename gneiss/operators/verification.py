"""Checks that join texts, folders and flows with the graph."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.operators import graph as G
from gneiss.session import cut


@dataclass(frozen=True)
class Step:
    """A step of a flow: a text that its function's name contains."""

    name: str


def verify_flow(nodes: DataFrame, edges: DataFrame, entry: str, steps: list[Step], hops: int = 8) -> DataFrame:
    """(step_no, step, symbol, depth, status): missing, outside (not reached from the entry), in_pipeline (reached, but not
    behind the step before), ordered. The entry is resolved like any name; one closure serves all steps."""
    spark = nodes.sparkSession
    functions = G.unique_nodes(nodes).where(F.col("type").isin("function", "method")).select("id", "name")
    start = G.resolve(functions, [entry]).select("id")
    reached = cut(G.closure(edges, start, hops, types=("CALLS",)))
    asked = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("step_no"), F.lit(s.name).alias("step")) for i, s in enumerate(steps)]))
    hits = functions.withColumn("s", asked).where(F.contains(F.lower("name"), F.lower("s.step"))).select("s.step_no", "s.step", "id", "name")
    hits = hits.join(reached, "id", "left")
    best = hits.groupBy("step_no", "step").agg(F.min(F.struct(F.col("depth").isNull().alias("out"), "depth", "name")).alias("m"))
    every = spark.createDataFrame([(i + 1, s.name) for i, s in enumerate(steps)], "step_no int, step string")
    rows = every.join(best, ["step_no", "step"], "left").select("step_no", "step", F.col("m.name").alias("symbol"), F.col("m.depth").alias("depth"))
    before = F.max("depth").over(W.partitionBy(F.lit(0)).orderBy("step_no").rowsBetween(W.unboundedPreceding, -1))  # a few rows: the steps given
    status = F.when(F.col("symbol").isNull(), "missing").when(F.col("depth").isNull(), "outside").when(F.coalesce(before, F.lit(-1)) <= F.col("depth"), "ordered").otherwise("in_pipeline")
    return rows.withColumn("status", status)


def verify_modules(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """(folder, n, n_reached, status): how much of every folder's functions a closure reaches."""
    f = G.unique_nodes(nodes).where(F.col("type").isin("function", "method")).select("id", T.directory(T.clean_path(F.col("file_path"))).alias("folder"))
    g = f.join(reached.select("id", F.lit(1).alias("r")), "id", "left").groupBy("folder").agg(F.count("*").alias("n"), F.count("r").alias("n_reached"))
    return g.withColumn("status", F.when(F.col("n_reached") == 0, "unverified").when(F.col("n_reached") == F.col("n"), "confirmed").otherwise("partial"))


def citations(docs: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, cited, known): paths in backticks, and whether a file's path ends so. Joined by the last two segments."""
    cited = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"`([\w./-]+\.[a-z]+)`"), F.lit(1)))).alias("cited"))
    tail = lambda c: F.array_join(F.slice(F.split(c, "/"), -F.least(F.lit(2), F.size(F.split(c, "/"))), 2), "/")
    known = files.select(tail(F.col("file_path")).alias("t_")).distinct().withColumn("known", F.lit(True))
    return cited.withColumn("t_", tail(F.col("cited"))).join(known, "t_", "left").select("doc_id", "cited", F.coalesce("known", F.lit(False)).alias("known"))


def orphan_tests(files: DataFrame) -> DataFrame:
    """(file_path, subject): tests whose subject has no file in the same repository."""
    f = files.select("repo", "file_path", T.stem(F.col("file_path")).alias("stem")).distinct()
    subject = F.regexp_extract("stem", r"^(?:test_(\w+)|(\w+)_test|(\w+)\.(?:test|spec))$", 0)
    tests = f.where(subject != "").withColumn("subject", F.regexp_replace("stem", r"^test_|_test$|\.(?:test|spec)$", ""))
    return tests.join(f.select("repo", F.col("stem").alias("subject")).distinct(), ["repo", "subject"], "left_anti").select("file_path", "subject")


#: Kinds of folders, the first rule that holds decides.
SCOPES = (("tests", r"(^|/)(tests?|spec)(/|$)"), ("vendor", r"(^|/)(vendor|third_party|node_modules|externals)(/|$)"), ("deployment", r"(^|/)(deploy|docker|helm)(/|$)"), ("tools", r"(^|/)(tools|scripts)(/|$)"), ("generated", r"(^|/)(gen|generated|__generated__|build|dist)(/|$)"), ("interface", r"(^|/)(api|web|handlers)(/|$)"), ("library", r"(^|/)(lib|pkg|core|internal)(/|$)"))


def scopes(files: DataFrame) -> DataFrame:
    """(folder, scope, n_files): folders by the first rule that their path meets."""
    folder = T.directory(F.col("file_path"))
    g = files.select("file_path").distinct().groupBy(folder.alias("folder")).agg(F.count("*").alias("n_files"))
    kind: Column | None = None
    for name, p in SCOPES:
        kind = F.when(F.col("folder").rlike(p), name) if kind is None else kind.when(F.col("folder").rlike(p), name)
    return g.select("folder", kind.otherwise("source").alias("scope"), "n_files")


def confidence(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(module, documented, parsed, confidence, level): half the share of documented chunks, half that of files with chunks."""
    module = lambda c: F.array_join(F.slice(F.split(c, "/"), 1, 2), "/")
    f = files.select("file_path").distinct()
    has = chunks.select("file_path").distinct().withColumn("h", F.lit(1))
    parsed = f.join(has, "file_path", "left").groupBy(module(F.col("file_path")).alias("module")).agg(F.avg(F.coalesce("h", F.lit(0))).alias("parsed"))
    d = chunks.dropDuplicates(["chunk_id"]).where(F.lower("chunk_type").isin("function", "method", "class")).groupBy(module(F.col("file_path")).alias("module")).agg(F.avg((F.trim(F.coalesce("docstring", F.lit(""))) != "").cast("int")).alias("documented"))
    both = parsed.join(d, "module", "left").withColumn("documented", F.coalesce("documented", F.lit(0.0)))
    score = F.round(0.5 * F.col("documented") + 0.5 * F.col("parsed"), 4)
    return both.select("module", F.round("documented", 4).alias("documented"), F.round("parsed", 4).alias("parsed"), score.alias("confidence")).withColumn("level", F.when(F.col("confidence") >= 0.6, "high").when(F.col("confidence") >= 0.3, "medium").otherwise("low"))


def in_try(texts: DataFrame, pattern: str, back: int = 15, ahead: int = 20) -> DataFrame:
    """(file_id, line_no, guarded): lines that hold a pattern, and whether a try stands in the lines before at less indent and
    its handler in the lines after; texts: the lines of files as arrays."""
    lead = lambda x: F.length(F.regexp_extract(x, r"^(\s*)", 1))

    def test(x, i):
        before = F.slice("all_", F.greatest(F.lit(1), i - back + 1), F.least(i, F.lit(back)))
        after = F.slice("all_", i + 2, ahead)
        guarded = F.exists(before, lambda y: y.rlike(r"^\s*try\b") & (lead(y) < lead(x))) & F.exists(after, lambda y: y.rlike(r"^\s*\}?\s*(except|catch|finally)\b"))
        return F.when(x.rlike(pattern), F.struct((i + 1).alias("line_no"), guarded.alias("guarded")))

    found = F.filter(F.transform("all_", test), lambda s: s.isNotNull())
    return texts.select("file_id", F.explode(found).alias("s")).select("file_id", "s.line_no", "s.guarded")


def line_kinds(rows: DataFrame) -> DataFrame:
    """(language, kind, n): blank, comment and code lines."""
    from gneiss.operators.lines import is_comment

    kind = F.when(F.trim("line") == "", "blank").when(is_comment(F.col("line"), F.col("language")), "comment").otherwise("code")
    return rows.groupBy("language", kind.alias("kind")).agg(F.count("*").alias("n"))


def representation(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, layer, n_symbols, n_out, is_entry): modules with what a diagram or a document of the system needs."""
    arcs = G.module_arcs(nodes, edges)
    fan = G.fan_stats(arcs)
    symbols = G.unique_nodes(nodes).where("type <> 'module'").join(G.module_of(nodes), "id").groupBy("module").agg(F.count("*").alias("n_symbols"))
    return symbols.join(fan, "module", "full_outer").select("module", G.layer(F.col("module")).alias("layer"), F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"), F.coalesce("fan_out", F.lit(0)).alias("n_out"), (F.coalesce("fan_in", F.lit(0)) == 0).alias("is_entry"))


def _layers(a: list[str], b: list[str]) -> dict[str, int | None]:
    """Depths of the ids of a bounded number of arcs, round by round."""
    waits, users = {}, {}
    for x, y in zip(a, b):
        waits[x] = waits.get(x, 0) + 1
        waits.setdefault(y, 0)
        users.setdefault(y, []).append(x)
    depth = dict.fromkeys(waits)
    level, n = [x for x, k in waits.items() if not k], 0
    while level:
        following = []
        for y in level:
            depth[y] = n
            for x in users.get(y, ()):
                waits[x] -= 1
                if not waits[x]:
                    following.append(x)
        level, n = following, n + 1
    return depth


def topological_layers(arcs: DataFrame, local: int = G.LOCAL_ARCS) -> DataFrame:
    """(id, depth): ids by the round in which everything they depend on (a -> b: a depends on b) was placed; what lies on a
    cycle, or depends on one, comes last with depth null. At most `local` arcs are walked in one task."""
    left = cut(arcs.where("a <> b").select("a", "b").distinct())
    if left.count() <= local:
        ids = arcs.select(F.col("a").alias("id")).unionByName(arcs.select(F.col("b").alias("id"))).distinct()
        placed = G.in_one_task(left, _layers, "id string, depth int")
        return ids.join(placed.withColumn("in_", F.lit(True)), "id", "left").select("id", F.when(F.col("in_"), F.col("depth")).otherwise(F.lit(0)).alias("depth"))
    ids = cut(arcs.select(F.col("a").alias("id")).unionByName(arcs.select(F.col("b").alias("id"))).distinct())
    placed = None
    for depth in count():
        free = cut(ids.join(left.select(F.col("a").alias("id")), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if free.isEmpty():
            break
        placed = free if placed is None else placed.unionByName(free)
        if depth % 50 == 49:
            placed = cut(placed)
        gone = free.select("id")
        ids = cut(ids.join(gone, "id", "left_anti"))
        left = cut(left.join(gone.select(F.col("id").alias("b")), "b", "left_anti"))
    rest = ids.withColumn("depth", F.lit(None).cast("int"))
    return rest if placed is None else placed.unionByName(rest)


#: Other names of the ledger's categories.
ALIASES = {"secrets": "secret", "vulns": "injection", "deps": "dependency", "dead": "dead_code", "todos": "todo"}


def ledger(findings: DataFrame, category: str | None = None, text: str | None = None, limit: int = 50) -> DataFrame:
    """(id, category, severity, file_path, line): entries of a category or its alias that hold a text; worst first."""
    f = findings
    if category:
        f = f.where(F.lower("category") == ALIASES.get(category.lower(), category.lower()))
    if text:
        f = f.where(F.contains(F.lower(F.concat_ws(" ", "title", "detail", "file_path")), F.lit(text.lower())))
    return f.withColumn("r", T.severity_rank(F.col("severity"))).orderBy("r", "file_path", "line", "id").limit(limit).select("id", "category", "severity", "file_path", "line")
