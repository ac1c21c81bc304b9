"""Differences between snapshots, what to scan again, and the parsing of unified diffs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def classify(before: DataFrame, after: DataFrame, key: str = "path", tolerance: float = 0.1) -> DataFrame:
    """(key, change): added, deleted, changed or unchanged, from (key, mtime, size) of two snapshots.

    A file is unchanged while its size is the same and its time moved by no more than the tolerance in seconds (less than a
    microsecond more is rounding).
    """
    b = before.select(F.col(key), F.col("mtime").alias("m0"), F.col("size").alias("s0"))
    a = after.select(F.col(key), F.col("mtime").alias("m1"), F.col("size").alias("s1"))
    same = (F.abs(F.col("m1") - F.col("m0")) <= tolerance + 1e-6) & F.col("s0").eqNullSafe(F.col("s1"))
    change = F.when(F.col("m0").isNull(), "added").when(F.col("m1").isNull(), "deleted").when(same, "unchanged").otherwise("changed")
    return b.join(a, key, "full_outer").select(key, change.alias("change"))


def strategy(changes: DataFrame, baseline_exists: bool, fresh: bool, closure_size: int, most_files: int = 30, most_nodes: int = 150, few_files: int = 10, few_nodes: int = 60) -> DataFrame:
    """One row (n_added, n_changed, n_deleted, strategy): full, incremental or no_change."""
    n = lambda c: F.coalesce(F.sum((F.col("change") == c).cast("int")), F.lit(0))
    row = changes.agg(n("added").alias("n_added"), n("changed").alias("n_changed"), n("deleted").alias("n_deleted"))
    touched = F.col("n_added") + F.col("n_changed") + F.col("n_deleted")
    big = (touched > most_files) | F.lit(closure_size > most_nodes)
    small = (touched <= few_files) & F.lit(closure_size <= few_nodes) & F.lit(fresh)
    pick = F.when(F.lit(not baseline_exists), "full").when((touched == 0) & F.lit(fresh), "no_change").when(big, "full").when(small, "incremental").otherwise("full")
    return row.withColumn("strategy", pick)


def graph_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change): nodes added, removed, moved to another file, changed in their lines or name, both, or same."""
    cols = ("name", "file_path", "start_line", "end_line")
    b = before.select("id", F.lit(1).alias("in_b"), *[F.col(c).alias(f"b_{c}") for c in cols])
    a = after.select("id", F.lit(1).alias("in_a"), *[F.col(c).alias(f"a_{c}") for c in cols])
    moved = ~F.col("b_file_path").eqNullSafe(F.col("a_file_path"))
    changed = ~(F.col("b_name").eqNullSafe(F.col("a_name")) & F.col("b_start_line").eqNullSafe(F.col("a_start_line")) & F.col("b_end_line").eqNullSafe(F.col("a_end_line")))
    change = F.when(F.col("in_b").isNull(), "added").when(F.col("in_a").isNull(), "removed").when(moved & changed, "moved and changed").when(moved, "moved").when(changed, "changed").otherwise("same")
    return b.join(a, "id", "full_outer").select("id", change.alias("change"))


def edge_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(source, target, type, change, other): edges added or removed; rerouted where a source lost one target and won
    exactly one other by the same type, with the new target beside the old."""
    keys = ["source", "target", "type"]
    b, a = before.select(keys).distinct(), after.select(keys).distinct()
    gone, new = b.join(a, keys, "left_anti"), a.join(b, keys, "left_anti")
    lost = gone.groupBy("source", "type").agg(F.count("*").alias("n_lost"), F.min("target").alias("target"))
    won = new.groupBy("source", "type").agg(F.count("*").alias("n_won"), F.min("target").alias("other"))
    rerouted = lost.join(won, ["source", "type"]).where("n_lost = 1 and n_won = 1").select("source", "target", "type", F.lit("rerouted").alias("change"), "other")
    taken = rerouted.select("source", "type")
    plain = gone.withColumn("change", F.lit("removed")).unionByName(new.withColumn("change", F.lit("added"))).withColumn("other", F.lit(None).cast("string"))
    return plain.join(taken, ["source", "type"], "left_anti").select("source", "target", "type", "change", "other").unionByName(rerouted)


_FILE = re.compile(r"^\+\+\+ (?:b/)?(\S+)")
_HUNK = re.compile(r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@")


def diff_lines(text: str) -> Iterator[tuple[str, int, int | None, str, str]]:
    """(file, hunk from 1, line in the new file or None, add, remove or context, text) of a unified diff."""
    name, hunk, line = "", 0, 0
    for row in text.split("\n"):
        if m := _FILE.match(row):
            name, hunk, line = m.group(1), 0, 0
        elif row.startswith("--- ") or row.startswith("diff ") or row.startswith("index "):
            line = 0
        elif m := _HUNK.match(row):
            hunk, line = hunk + 1, int(m.group(1))
        elif line:
            sign, body = row[:1], row[1:]
            if sign == "+":
                yield name, hunk, line, "add", body
                line += 1
            elif sign == "-":
                yield name, hunk, None, "remove", body
            elif sign == " ":
                yield name, hunk, line, "context", body
                line += 1


def parse_diffs(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, file, hunk, new_line, kind, text) of unified diffs held in a column."""
    kind = diffs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = [(k, *x) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for x in diff_lines(t)]
            columns = list(zip(*rows)) or [()] * 6
            types = (b.schema.field(0).type, pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[key, "file", "hunk", "new_line", "kind", "text"])

    return diffs.select(key, text).mapInArrow(run, f"`{key}` {kind}, file string, hunk int, new_line int, kind string, text string")


#: Lines whose removal calls for a second look.
GUARDS = {"validation": r"\b(if|assert|validate|check|verify)\w*\b", "retry": r"(?i)\bretr(y|ies)|\battempt", "constraint": r"(?i)\b(max|min|limit|timeout|threshold)\w*\s*[:=]"}


def guard(changes: DataFrame) -> DataFrame:
    """(file, rule, n): removed lines that held a guard of a kind no added line of the file holds again."""
    kinds = F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in GUARDS.items()])
    rows = changes.where("kind <> 'context'").select("file", "kind", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("rule"))
    return rows.groupBy("file", "rule").agg(F.sum((F.col("kind") == "remove").cast("int")).alias("n"), F.sum((F.col("kind") == "add").cast("int")).alias("k")).where("n > 0 and k = 0").select("file", "rule", "n")


def corrected_ends(functions: DataFrame) -> DataFrame:
    """(file_id, name, start_line, end_line): ends that reach into the next function of the file are cut before it."""
    order = W.partitionBy("file_id").orderBy("start_line")
    nxt = F.lead("start_line").over(order)
    end = F.when(nxt.isNotNull() & (F.col("end_line") >= nxt) & (nxt > F.col("start_line")), nxt - 1).otherwise(F.col("end_line"))
    return functions.select("file_id", "name", "start_line", end.alias("end_line"))


def signatures(files: DataFrame) -> DataFrame:
    """(path, name, head): the first line of every function of every file, without spaces around; a name counts once per file."""
    f = files.where("raw_content is not null").select("file_path", F.split(F.regexp_replace("raw_content", "\r", ""), "\n", -1).alias("all_"), F.explode("functions").alias("f"))
    head = F.trim(F.get("all_", F.col("f.start_line") - 1))
    return f.groupBy(F.col("file_path").alias("path"), F.col("f.name").alias("name")).agg(F.min(head).alias("head"))


def signature_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, name, change, breaking): functions added, removed, or with another head; what callers relied on breaks unless parameters
    were only added at the end."""
    both = before.withColumnRenamed("head", "h0").join(after.withColumnRenamed("head", "h1"), ["path", "name"], "full_outer")
    change = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when(F.col("h0") != F.col("h1"), "changed")
    inside = lambda c: F.regexp_replace(F.regexp_extract(c, r"\((.*)\)", 1), r"\s", "")
    longer = F.startswith(inside("h1"), inside("h0"))
    return both.withColumn("change", change).where("change is not null").select("path", "name", "change", ((F.col("change") == "removed") | (F.col("change") == "changed") & ~longer).alias("breaking"))
