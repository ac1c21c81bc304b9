"""The algebra of findings: cross-validation, whitelists, noise rules, merging, scores.

A finding is a row (id, tool, category, severity, file_path, line, title, detail, tier, xval_by, ...); repeated rows are
one finding. Groups are aggregated by shuffled keys; only the merge of adjacent lines folds in Python, one file and
category at a time, over a few numbers per row.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.functions.text import severity_rank

SEVERITIES = ("critical", "high", "medium", "low", "info")


def distinct_findings(findings: DataFrame) -> DataFrame:
    """One row per id, severities in lower case, unknown ones as info."""
    f = findings.dropDuplicates(["id"])
    s = F.lower("severity")
    return f.withColumn("severity", F.when(s.isin(*SEVERITIES), s).otherwise("info"))


def cross_validate(findings: DataFrame) -> DataFrame:
    """(id, tier, xval_by): findings that two tools or more report at one place and category become high, with the others' names."""
    place = W.partitionBy("file_path", "line", "category")
    tools = findings.withColumn("tools", F.collect_set("tool").over(place))
    several = F.size("tools") >= 2
    return tools.select("id", F.when(several, "high").otherwise(F.col("tier")).alias("tier"), F.when(several, F.array_sort(F.array_remove("tools", F.col("tool")))).otherwise(F.array().cast("array<string>")).alias("xval_by"))


#: Entries of a whitelist: texts to be found in path, category and title; a null matches everything.
WhiteEntry = tuple[str | None, str | None, str | None]


def whitelisted(findings: DataFrame, entries: list[WhiteEntry]) -> Column:
    """Whether any entry matches, by lower-case substrings; the entries are an argument and become one expression."""
    out = F.lit(False)
    for path, category, title in entries:
        match = F.lit(True)
        for column, text in (("file_path", path), ("category", category), ("title", title)):
            if text is not None:
                match = match & F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(text.lower()))
        out = out | match
    return out


#: (name, tools or (), texts in the title, texts in the path, texts that exclude in the detail, action)
NoiseRule = tuple[str, tuple[str, ...], tuple[str, ...], tuple[str, ...], tuple[str, ...], str]


def denoise(findings: DataFrame, rules: list[NoiseRule]) -> DataFrame:
    """(id, rule, action, severity): the first rule that matches decides; downgraded findings are low, suppressed ones stay listed."""
    any_of = lambda column, texts: F.lit(not texts) | _any(column, texts)
    rule = None
    for name, tools, titles, paths, but, _ in rules:
        hit = (F.col("tool").isin(*tools) if tools else F.lit(True)) & any_of("title", titles) & any_of("file_path", paths)
        if but:
            hit = hit & ~_any("detail", but)
        rule = F.when(hit, name) if rule is None else rule.when(hit, name)
    actions = F.create_map(*[F.lit(x) for r in rules for x in (r[0], r[5])])
    out = findings.withColumn("rule", rule).withColumn("action", F.coalesce(actions[F.col("rule")], F.lit("keep")))
    return out.select("id", "rule", "action", F.when(F.col("action") == "downgrade", "low").otherwise(F.col("severity")).alias("severity"))


def _any(column: str, texts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for t in texts:
        out = out | F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(t.lower()))
    return out


def merge_adjacent(findings: DataFrame, window: int = 5) -> DataFrame:
    """(file_path, category, tool, line_start, line_end, n, first_id): findings of a tool and category are merged while
    their lines lie within a window of the first line of the merged one."""
    keys = ["file_path", "category", "tool"]
    names = [*keys, "line_start", "line_end", "n", "first_id"]
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]

    def fold(batches):
        now = None  # the merged row that is still open: group, first line, last line, count, first id
        for b in batches:
            rows = []
            for path, category, tool, line, end, n, i in zip(*(c.to_pylist() for c in b.columns)):
                group = (path, category, tool)
                if now and now[0] == group and line - now[1] <= window:
                    now[2], now[3] = max(now[2], end), now[3] + n
                else:
                    if now:
                        rows.append((*now[0], *now[1:]))
                    now = [group, line, end, n, i]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*now[0], *now[1:]), types)], names=names)

    slim = findings.select(*keys, "line", F.greatest("line", F.coalesce("line_end", "line")).alias("line_end"), F.coalesce("count", F.lit(1)).alias("count"), "id")
    # groups stream through in order, so a hot one needs no more memory than any other
    ordered = slim.repartition(*keys).sortWithinPartitions(*keys, "line", "id")
    return ordered.mapInArrow(fold, "file_path string, category string, tool string, line_start int, line_end int, n int, first_id bigint")


def merge_bursts(findings: DataFrame, above: int = 8) -> DataFrame:
    """(tool, category, severity, n_rows, n, n_files, tier, first_id): groups of more than `above` rows become one, with the
    summed counts and the highest tier; smaller groups stay rows of their own with n_rows 1."""
    order = F.struct("file_path", "line", "id")
    rank = F.when(F.col("tier") == "high", 3).when(F.col("tier") == "medium", 2).otherwise(1)
    groups = findings.groupBy("tool", "category", "severity").agg(
        F.count("*").alias("n_rows"), F.sum(F.coalesce("count", F.lit(1))).alias("n"), F.countDistinct("file_path").alias("n_files"), F.max(rank).alias("t"), F.min_by("id", order).alias("first_id")
    )
    big = groups.where(F.col("n_rows") > above)
    name = lambda c: F.when(c == 3, "high").when(c == 2, "medium").otherwise("low")
    merged = big.select("tool", "category", "severity", "n_rows", "n", "n_files", name(F.col("t")).alias("tier"), "first_id")
    alone = findings.join(big.select("tool", "category", "severity"), ["tool", "category", "severity"], "left_anti")
    single = alone.select("tool", "category", "severity", F.lit(1).cast("bigint").alias("n_rows"), F.coalesce("count", F.lit(1)).cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("n_files"), name(rank).alias("tier"), F.col("id").alias("first_id"))
    return merged.unionByName(single)


def health_scores(findings: DataFrame, repo: Column | None = None) -> DataFrame:
    """(repo, n_high, n_medium, n_low, score): 100 less 5, 1 and a fifth by tier, cut to a whole number, at least 0."""
    repo = F.split("file_path", "/")[0] if repo is None else repo
    n = lambda t: F.sum((F.col("tier") == t).cast("int"))
    g = findings.groupBy(repo.alias("repo")).agg(n("high").alias("n_high"), n("medium").alias("n_medium"), n("low").alias("n_low"))
    # in fifths, so that the cut is exact
    return g.withColumn("score", F.greatest(F.lit(0), F.floor((F.lit(500) - 25 * F.col("n_high") - 5 * F.col("n_medium") - F.col("n_low")) / 5)).cast("int"))


def penalty_scores(findings: DataFrame, files: DataFrame, weights: dict[str, float], per_file: float = 10.0) -> DataFrame:
    """(repo, score): 100 less the severities' weights per file of the repository, from 0 to 100."""
    w = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    lost = findings.groupBy(F.split("file_path", "/")[0].alias("repo")).agg(F.sum(F.coalesce(w[F.col("severity")], F.lit(0.0))).alias("lost"))
    n = files.groupBy("repo").agg(F.countDistinct("file_id").alias("n_files"))
    return n.join(lost, "repo", "left").select("repo", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - F.coalesce("lost", F.lit(0.0)) / F.col("n_files") * per_file)), 2).alias("score"))


def worst(findings: DataFrame) -> DataFrame:
    """(file_path, severity, n): the worst severity of every file and how many findings it has."""
    g = findings.groupBy("file_path").agg(F.min(severity_rank(F.col("severity"))).alias("r"), F.count("*").alias("n"))
    names = F.array(*[F.lit(s) for s in SEVERITIES])
    return g.select("file_path", names[F.col("r")].alias("severity"), "n")


def top(findings: DataFrame, limit: int = 10) -> DataFrame:
    """The first findings by severity, path, line and id."""
    return findings.withColumn("r", severity_rank(F.col("severity"))).orderBy("r", "file_path", "line", "id").limit(limit).drop("r")


#: Risk categories by the categories of findings; what isn't listed falls under the last.
RISKS = {"injection": "A03", "secret": "A07", "dependency": "A06", "layering": "A04", "complexity": "A04"}
ALL_RISKS = tuple(f"A{i:02d}" for i in range(1, 11))


def risk_rollup(findings: DataFrame) -> DataFrame:
    """(risk, n, worst): all risk categories, those without findings too."""
    spark = findings.sparkSession
    names = F.create_map(*[F.lit(x) for pair in RISKS.items() for x in pair])
    by = findings.groupBy(F.coalesce(names[F.col("category")], F.lit("A05")).alias("risk")).agg(F.count("*").alias("n"), F.min(severity_rank(F.col("severity"))).alias("r"))
    every = spark.createDataFrame([(r,) for r in ALL_RISKS], "risk string")
    return every.join(by, "risk", "left").select("risk", F.coalesce("n", F.lit(0)).alias("n"), F.get(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("r")).alias("worst"))


def verify(claims: DataFrame, names: DataFrame) -> DataFrame:
    """(id, n_symbols, n_known, verdict): whether the names a finding cites exist. claims: id, text; names: name.

    confirmed where all are known, refuted where none is, partial else, unverifiable without any name.
    """
    words = claims.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))).alias("name")).where("length(name) > 3")
    cited = words.where(F.col("name").rlike("[a-z][A-Z]|_")).union(words.where(~F.col("name").rlike("[a-z][A-Z]|_")).join(names.select("name").distinct(), "name", "left_semi").select("id", "name"))
    known = cited.join(names.select("name").distinct().withColumn("k", F.lit(1)), "name", "left")
    tally = known.groupBy("id").agg(F.count("*").alias("n_symbols"), F.count("k").alias("n_known"))
    all_ = claims.select("id").distinct().join(tally, "id", "left").na.fill(0, ["n_symbols", "n_known"])
    verdict = F.when(F.col("n_symbols") == 0, "unverifiable").when(F.col("n_known") == F.col("n_symbols"), "confirmed").when(F.col("n_known") == 0, "refuted").otherwise("partial")
    return all_.withColumn("verdict", verdict)
