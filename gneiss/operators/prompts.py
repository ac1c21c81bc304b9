"""Prompt-like texts: finding, classifying, checking and scoring them by column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.text import count_matches

#: Words of instructions; two of them in a long text make it prompt-like.
WORDS = ("you are", "must", "never", "always", "respond", "output", "format", "json", "task", "role", "instructions", "review", "list", "summar")
TYPES = (("system", r"(?i)\byou are\b|\bact as\b|\bsystem prompt\b"), ("review", r"(?i)\breview|\baudit"), ("report", r"(?i)\breport\b|\bsummar"), ("extraction", r"(?i)\bextract|\blist (all|the)\b"))
INJECTION = {"override": r"(?i)ignore (all |the )?(previous|above)|disregard (all|the)", "leak": r"(?i)system prompt|reveal your", "escape": r"(?i)jailbreak|developer mode", "mark": r"<\|[a-z_]+\|>|\[INST\]"}
FORMATS = {"json": r"(?i)\bjson\b", "table": r"(?m)^\|.*\|$", "list": r"(?m)^\s*([-*]|\d+\.) ", "code": r"(?m)^```"}
#: Characters of a text that the injection scan reads; part of the scan's definition.
SCANNED = 3000


def mined(docs: DataFrame) -> DataFrame:
    """(doc_id, prompt_type, n_words, hash): texts of 100 characters or more with two instruction words, or marked as prompts."""
    t = F.lower(F.coalesce("text", F.lit("")))
    n = sum((F.contains(t, F.lit(w)).cast("int") for w in WORDS), F.lit(0))
    kind = None
    for name, p in TYPES:
        test = F.col("text").rlike(p)
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    found = docs.withColumn("n_words", n).where((F.length("text") >= 100) & (F.col("n_words") >= 2) | (F.col("kind") == "prompt") & F.col("text").isNotNull())
    return found.select("doc_id", kind.otherwise("other").alias("prompt_type"), "n_words", F.substring(F.sha2(F.col("text"), 256), 1, 16).alias("hash"))


def injections(docs: DataFrame) -> DataFrame:
    """(doc_id, group): texts with signs of injection in their scanned part."""
    head = F.substring("text", 1, SCANNED)
    groups = F.array(*[F.when(head.rlike(p), F.lit(n)) for n, p in INJECTION.items()])
    return docs.where("text is not null").select("doc_id", F.explode(F.filter(groups, lambda x: x.isNotNull())).alias("group"))


def formats(docs: DataFrame) -> DataFrame:
    """(source, n_formats, formats, conflict): output formats that a source's texts ask for; several are in conflict."""
    each = F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in FORMATS.items()])
    rows = docs.where("text is not null").select("source", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("f")).distinct()
    g = rows.groupBy("source").agg(F.count("*").alias("n_formats"), F.array_join(F.array_sort(F.collect_list("f")), ",").alias("formats"))
    return g.withColumn("conflict", F.col("n_formats") > 1)


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, clarity, structure, safety, score): 35, 35 and 30 parts of 100."""
    n = F.length("text")
    clarity = F.least(F.lit(1.0), n / 400.0)
    structure = F.least(F.lit(1.0), (count_matches(F.col("text"), r"(?m)^\s*(?:[-*]|\d+\.) ") + 2 * count_matches(F.col("text"), r"(?m)^```")) / 6.0)
    safety = F.when(F.col("text").rlike("|".join(p.replace("(?i)", "") for p in INJECTION.values())), 0.0).otherwise(1.0)
    rows = docs.where("text is not null and kind = 'prompt'").select("doc_id", F.round(clarity, 4).alias("clarity"), F.round(structure, 4).alias("structure"), safety.alias("safety"))
    return rows.withColumn("score", F.floor(35 * F.col("clarity") + 35 * F.col("structure") + 30 * F.col("safety") + 0.5).cast("int"))


def contradictions(docs: DataFrame) -> DataFrame:
    """(source, word, n_must, n_ban): words that a source's texts both demand and forbid."""
    must = F.regexp_extract_all("text", F.lit(r"\b(?:must|always|keeps|confirms) the (\w+)"), F.lit(1))
    ban = F.regexp_extract_all("text", F.lit(r"\b(?:never|rejects|drops|blocks) the (\w+)"), F.lit(1))
    d = docs.where("text is not null")
    count = lambda c, name: d.select("source", F.explode(c).alias("word")).groupBy("source", "word").agg(F.count("*").alias(name))
    return count(must, "n_must").join(count(ban, "n_ban"), ["source", "word"])


def winners(versions: DataFrame) -> DataFrame:
    """(asset, winner): of two groups A and B of scored versions the one with the higher mean; a tie goes to A."""
    g = versions.groupBy("asset").agg(F.avg(F.when(F.col("group") == "A", F.col("score"))).alias("a"), F.avg(F.when(F.col("group") == "B", F.col("score"))).alias("b"))
    return g.select("asset", F.when(F.coalesce("b", F.lit(-1.0)) > F.coalesce("a", F.lit(-1.0)), "B").otherwise("A").alias("winner"))
