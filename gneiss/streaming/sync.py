"""Keeping a table of file snapshots in step with a stream of deliveries.

Each micro-batch is reduced to the last delivery of every path and merged with the table: added, changed, unchanged.
The table is parted by a hash of the path. A batch writes, under a folder of its own, only the parts that its paths belong to, so
its cost goes with what it touches; the newest version of each part counts. A batch that runs again after a failure starts
from the versions before it and writes the same result. Versions that no run can need any more are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def merge(known: DataFrame | None, batch: DataFrame) -> DataFrame:
    """(path, digest, seen_at, change) after a batch of (path, digest, seen_at)."""
    last = batch.groupBy("path").agg(F.max_by("digest", F.struct("seen_at", "digest")).alias("digest"), F.max("seen_at").alias("seen_at"))
    if known is None:
        return last.withColumn("change", F.lit("added"))
    old = known.select("path", F.col("digest").alias("d0"), F.col("seen_at").alias("t0"))
    late = F.col("t0").isNotNull() & (F.col("seen_at").isNull() | (F.col("seen_at") < F.col("t0")))
    change = F.when(F.col("seen_at").isNull(), "untouched").when(F.col("t0").isNull(), "added").when(late, "late").when(F.col("d0").eqNullSafe(F.col("digest")), "unchanged").otherwise("changed")
    both = old.join(last, "path", "full_outer")
    return both.select("path", F.when(late, F.col("d0")).otherwise(F.col("digest")).alias("digest"), F.when(late, F.col("t0")).otherwise(F.col("seen_at")).alias("seen_at"), change.alias("change"))


#: Parts of the table.
PARTS = 64


def _part(parts: int):
    return F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int")


def run(spark: SparkSession, stream: DataFrame, folder: str, parts: int = PARTS, **trigger) -> StreamingQuery:
    """Starts the sync of a stream (path, digest, seen_at) into parquet under folder; see current()."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("part", _part(parts))
        touched = sorted(r["part"] for r in batch.select("part").distinct().collect())  # at most `parts` numbers
        # the state a batch starts from is the one before it, also when it runs again
        versions = _versions(spark, folder, number - 1)
        before = _read(spark, folder, {p: versions[p] for p in touched if p in versions})
        merge(before and before.drop("change"), batch.drop("part")).withColumn("part", _part(parts)).write.mode("overwrite").partitionBy("part").parquet(f"{folder}/state/{number}")
        _forget(spark, folder, versions, touched)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def _list(spark: SparkSession, where: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def _versions(spark: SparkSession, folder: str, most: int | None = None) -> dict[int, int]:
    """The newest complete batch that wrote each part, of those up to a number."""
    out: dict[int, int] = {}
    for number in sorted(int(n) for n in _list(spark, f"{folder}/state") if most is None or int(n) <= most):
        names = _list(spark, f"{folder}/state/{number}")
        if "_SUCCESS" in names:
            out.update((int(n.removeprefix("part=")), number) for n in names if n.startswith("part="))
    return out


def _read(spark: SparkSession, folder: str, versions: dict[int, int]) -> DataFrame | None:
    if not versions:
        return None
    return spark.read.parquet(*[f"{folder}/state/{number}/part={part}" for part, number in sorted(versions.items())])


def _forget(spark: SparkSession, folder: str, versions: dict[int, int], touched: list[int]) -> None:
    """Removes what was written of the touched parts before the versions that this batch started from."""
    for number in (int(n) for n in _list(spark, f"{folder}/state")):
        for part in touched:
            if number < versions.get(part, 0):
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state/{number}/part={part}")
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table after the last batch; what that batch did not touch has the change 'untouched'."""
    versions = _versions(spark, folder)
    if not versions:
        return None
    last = max(versions.values())
    new = _read(spark, folder, {p: n for p, n in versions.items() if n == last})
    old = _read(spark, folder, {p: n for p, n in versions.items() if n < last})
    return new if old is None else new.unionByName(old.withColumn("change", F.lit("untouched")))
