"""Search over chunks: by vector, by words, by calls in the text.

The search of many queries against all rows runs in blocks: entries are hashed to blocks of bounded size, every query is
sent to each block, a task compares one block's entries with the queries by one matrix product, and the best of the
blocks are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Added to the product of the lengths, so that a zero vector has cosine 0.
EPSILON = 1e-8
BLOCK = 20_000


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + EPSILON)


def by_vector(rows: DataFrame, key: str, vector: str, query: list[float], k: int = 10) -> DataFrame:
    """(key, score, rank): the k rows most similar to one query vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.where(F.col(vector).isNotNull()).dropDuplicates([key]).select(key, F.round(cosine(F.col(vector), q), 6).alias("score"))
    best = scored.orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), key)))


def similar(rows: DataFrame, key: str, vector: str, queries: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """(key, near, score, rank): for every query row (key, vector) the k most similar other rows, exactly."""
    n = rows.count()
    blocks = max(1, -(-n // block))
    kind = rows.schema[key].dataType.simpleString()
    entries = rows.where(F.col(vector).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("b_"), F.col(key).alias("k_"), F.col(vector).alias("v_"))
    asked = queries.where(F.col(vector).isNotNull()).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b_"), F.col(key).alias("k_"), F.col(vector).alias("v_"))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({key: [], "near": [], "score": []})
        e, q = np.stack(left.v_.values).astype(np.float64), np.stack(right.v_.values).astype(np.float64)
        ids = left.k_.values
        ne, nq = np.sqrt((e * e).sum(1)), np.sqrt((q * q).sum(1))
        out = []
        for at in range(0, len(q), 256):
            s = np.round((q[at : at + 256] @ e.T) / (nq[at : at + 256, None] * ne[None, :] + EPSILON), 6)
            for i, row in enumerate(s):
                me = right.k_.values[at + i]
                row = np.where(ids == me, -np.inf, row)
                m = min(k, len(row))
                edge = np.partition(-row, m - 1)[m - 1]
                found = np.flatnonzero(-row <= edge)  # ties at the edge stay until the merge
                out += [(me, ids[j], row[j]) for j in found if np.isfinite(row[j])]
        return pd.DataFrame(out, columns=[key, "near", "score"])

    found = entries.groupBy("b_").cogroup(asked.groupBy("b_")).applyInPandas(compare, f"`{key}` {kind}, near {kind}, score double")
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "near"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def by_words(chunks: DataFrame, query: str, k: int = 20) -> DataFrame:
    """(chunk_id, score, rank): the share of the query's distinct words found in name, code (500 characters, as defined for
    this score) and docstring."""
    words = sorted(set(query.lower().split()))
    text = F.lower(F.concat_ws(" ", "name", F.substring("code", 1, 500), "docstring"))
    hits = sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))
    scored = chunks.dropDuplicates(["chunk_id"]).select("chunk_id", F.round(hits / len(words), 6).alias("score")).where("score > 0")
    best = scored.orderBy(F.desc("score"), "chunk_id").limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "chunk_id")))


def textual_calls(chunks: DataFrame) -> DataFrame:
    """(name, n_calls, n_chunks): how often each function's name is called in the code of function and method chunks.

    A chunk's own definition isn't a call of it. Names are tokens before a bracket, so the join is on equality.
    """
    own = chunks.dropDuplicates(["chunk_id"]).where(F.lower(F.trim("chunk_type")).isin("function", "method"))
    last = F.regexp_extract("name", r"([^.]*)$", 1)
    names = own.select(last.alias("name")).where("name <> ''").distinct()
    tokens = own.select("chunk_id", last.alias("own"), F.explode(F.regexp_extract_all("code", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), F.lit(1))).alias("name")).where("name <> own")
    per = tokens.groupBy("name", "chunk_id").agg(F.count("*").alias("n"))
    return per.join(names, "name", "left_semi").groupBy("name").agg(F.sum("n").alias("n_calls"), F.count("*").alias("n_chunks"))


def kb_stats(chunks: DataFrame) -> DataFrame:
    """(chunk_type, n, n_files, with_embedding, with_docs) by type in lower case."""
    return chunks.groupBy(F.lower("chunk_type").alias("chunk_type")).agg(
        F.count("*").alias("n"), F.countDistinct("file_path").alias("n_files"), F.round(F.avg(F.col("embedding").isNotNull().cast("double")), 6).alias("with_embedding"),
        F.sum((F.trim(F.coalesce("docstring", F.lit(""))) != "").cast("int")).alias("with_docs"),
    )
