"""Queries of the llm subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import bpe, docpairs, generated, knn, packing, prose, secrets, splitting, truncation
from gneiss.llm.syntax import invalid
from gneiss.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return generated.judged(table(spark, d, "codefile")).where("not by_hand").select("file_id").distinct()


def p1_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of the code graph that lie in files not written by hand."""
    return generated.nodes_judged(table(spark, d, "nodes"), generated.judged(table(spark, d, "codefile"))).where("not by_hand").select("id", "file_id", "why")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return knn.pairs(knn.neighbours(table(spark, d, "chunks")))


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar chunks of every chunk, with their cosines."""
    return knn.neighbours(table(spark, d, "chunks")).select("chunk_id", F.posexplode("near").alias("rank", "e")).select("chunk_id", (F.col("rank") + 1).alias("rank"), F.col("e.id").alias("near_id"), F.col("e.cosine").alias("cosine"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return invalid.judged(table(spark, d, "codefile")).where("not valid").select("file_id").distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Every file that is rejected, where and why, or the dialects that would accept it."""
    return invalid.judged(table(spark, d, "codefile")).where("not valid")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return invalid.rates(invalid.judged(table(spark, d, "codefile")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    return prose.found(chunks, prose.fit(table(spark, d, "documents"), chunks)).select("chunk_id", "lang").distinct()


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    """Natural text of every file by language, and its share."""
    chunks = table(spark, d, "chunks")
    return prose.shares(chunks, prose.fit(table(spark, d, "documents"), chunks))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    files = secrets.find(table(spark, d, "codefile"), "codefile", "file_id", "raw_content")
    return files.unionByName(secrets.find(table(spark, d, "chunks"), "chunks", "chunk_id", "code")).distinct()


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The texts that hold secrets, redacted."""
    files = secrets.redacted(table(spark, d, "codefile"), "codefile", "file_id", "raw_content")
    return files.unionByName(secrets.redacted(table(spark, d, "chunks"), "chunks", "chunk_id", "code")).distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.pairs(table(spark, d, "chunks"), with_code=False).select("chunk_id").distinct()


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.pairs(table(spark, d, "chunks"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that the splitting operator had to cut."""
    return splitting.split(table(spark, d, "chunks")).where("n_pieces > 1").select("chunk_id").distinct()


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split(table(spark, d, "chunks"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Per source: documents, tokens, and documents whose decoded ids differ from their text (0 everywhere)."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    both = bpe.decoded(docs.join(bpe.encode(docs), "doc_id"), out="back")
    return both.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.size("ids")).alias("n_tokens"), F.sum((F.col("back") != F.col("text")).cast("int")).alias("n_differ"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(packing.sizes(table(spark, d, "documents")))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Token proportions of the sources in every window of containers, beside their targets."""
    return packing.mixture(packing.fill(packing.sizes(table(spark, d, "documents"))))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judged(table(spark, d, "documents")).where("cut").select("doc_id").distinct()


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(table(spark, d, "documents"))


def p10_limits(spark: SparkSession, d: str) -> DataFrame:
    """The hidden storage limits: source, encoding and length."""
    names = F.array(*map(F.lit, truncation.ENCODINGS))
    return truncation.limits(truncation.endings(table(spark, d, "documents"))).select("source", names[F.col("encoding")].alias("encoding"), "most")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_nodes, p2_found, p2_neighbours, p3_found, p3_report, p3_rates, p4_found, p4_shares, p5_found, p5_redacted, p6_found, p6_pairs, p7_found, p7_pieces, p8_ids, p8_round_trip, p9_containers, p9_mixture, p10_found, p10_rates, p10_limits)}

SQL: dict[str, str] = {
    "p7_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(code) > 6000",
}
