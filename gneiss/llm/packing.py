"""Problem 9: filling containers of fixed capacity.

Items (texts sized in tokens) are packed by mixture-controlled packing: deficit round-robin over one queue per source
fills each window of containers to the target token proportions. A round adds to each source's deficit a quantum in proportion
to its target, together one container; a source is served while its deficit covers the head of its queue. What a source
got too much or too little is carried to the next window and, through running totals over all shards, to the next
partition. Within a window items go to the fullest container that still holds them (best fit, largest first); what
fits none goes back to the head of its queue, and its deficit with it.

Every source's items are cut by hash into BUCKETS buckets a shard, and its buckets are dealt to the shards in turn so
that each shard gets the source's target share of its tokens: a source with a third of all rows spreads over all shards,
one short of its target runs out in later shards. One task packs one shard at a time. A shard leaves at most its last
window's slack. Running totals are taken in two steps, within blocks and over blocks, so no task meets them all.

Defined cases: null and empty texts have no tokens and are in no container; an item above the capacity, and only such
a one, is split into pieces of the full capacity and a rest; null sources form a queue of their own; sources without a target
come last; repeated rows are items of their own, told apart by copy_no (0 for rows without repeats), and spread over the
buckets of their source; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.llm import bpe
from gneiss.session import cut

CAPACITY = 2048
#: Containers of a window, tokens a shard aims at, buckets of a source per shard, and rows of a block of running totals.
WINDOW, SHARD_TOKENS, BUCKETS, BLOCK = 64, 4_000_000, 16, 1024


def pack(items: list[tuple[int, str, int]], share: dict[str, float], carried: dict[str, float], capacity: int = CAPACITY, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """items: (number, source, size up to capacity). Gives (number, container, offset) of each.

    share: target proportions of the sources; carried: tokens that a source is owed when the shard begins.
    """
    queues: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for n, source, size in items:
        if not 0 < size <= capacity:
            raise ValueError("sizes must be from 1 to the capacity")
        queues[source].append((size, n))
    left = {s: sum(size for size, _ in q) for s, q in queues.items()}
    for q in queues.values():
        q.sort(key=lambda x: (hash_mix(x[1]), x[1]))  # draws are a mix of sizes; popped from the end
    deficit = {s: float(carried.get(s, 0.0)) for s in queues}
    if deficit and max(deficit.values()) < 0:
        ahead = max(deficit.values())
        deficit = {s: d - ahead for s, d in deficit.items()}
    order, turn = sorted(queues), 0
    out: list[tuple[int, int, int]] = []
    made = 0
    while any(queues.values()):
        room = min(window * capacity, sum(left.values()))
        drawn: list[tuple[int, int, str]] = []
        got = 0
        while got < room:
            if turn % len(order) == 0:  # a round begins
                active = [s for s in order if queues[s]]
                weight = sum(share.get(s, 0.0) for s in active)
                quantum = {s: capacity * (share.get(s, 0.0) / weight if weight > 0 else 1 / len(active)) for s in active}
            s = order[turn % len(order)]
            turn += 1
            q = queues[s]
            if not q:
                continue
            deficit[s] += quantum.get(s, 0.0)
            while q and q[-1][0] <= deficit[s] and got < room:
                size, n = q.pop()
                drawn.append((size, n, s))
                got += size
                deficit[s] -= size
            if got >= room and q and q[-1][0] <= deficit[s]:
                turn -= 1  # its turn goes on in the next window, without another quantum
                deficit[s] -= quantum.get(s, 0.0)
        last = not any(queues.values())
        n_bins = max(1, -(-got // capacity)) if last else max(1, room // capacity)
        free: list[tuple[int, int]] = [(capacity, made + i) for i in range(n_bins)]  # (room, container), sorted
        for size, n, s in sorted(drawn, key=lambda x: (-x[0], x[1])):
            k = bisect_left(free, (size, -1))
            if k == len(free):
                if not last:
                    queues[s].append((size, n))
                    deficit[s] += size
                    continue
                free.append((capacity, made + n_bins))
                n_bins += 1
                k = len(free) - 1
            space, box = free.pop(k)
            out.append((n, box, capacity - space))
            left[s] -= size
            insort(free, (space - size, box))
        made += n_bins
    return out


def hash_mix(n: int) -> int:
    """A fixed shuffle of numbers."""
    n = (n ^ (n >> 31)) * 0x7FB5D329728EA185 & 0xFFFFFFFFFFFFFFFF
    return n ^ (n >> 27)


def sizes(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", path: str = bpe.VOCABULARY) -> DataFrame:
    """(key, source, n_tokens), null sources as ''."""
    rows = df.select(F.col(key).alias(key), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text_"))
    return bpe.count(rows, "text_", path).drop("text_")


def running(df: DataFrame, by: list[str], order: str, value: str, block: int = BLOCK) -> DataFrame:
    """df with before: the sum of value over the rows of the same group (none for one of all) with smaller order, a number from 0.

    Sums are taken within blocks of order, then over the blocks' totals."""
    df = df.withColumn("block_", F.floor(F.col(order) / block))
    totals = df.groupBy(*by, "block_").agg(F.sum(value).alias("total_"))
    upto = W.partitionBy(*by or [F.lit(0)]).orderBy("block_").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.withColumn("start_", F.coalesce(F.sum("total_").over(upto), F.lit(0))).drop("total_")
    within = W.partitionBy(*by, "block_").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    inner = df.withColumn("in_", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return inner.join(starts, [*by, "block_"]).withColumn("before", F.col("in_") + F.col("start_")).drop("block_", "in_", "start_")


def fill(sized: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, targets: dict[str, float] | None = None) -> DataFrame:
    """(container string, shard, window_no, offset, key, copy_no, piece_no, first_token, n_tokens, source) for sized (key, source, n_tokens).

    targets: token proportions by source, default those of the whole corpus.
    """
    sized = cut(sized.where("n_tokens > 0"))
    total = sized.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    spark = sized.sparkSession
    # rows of a repeated key spread as well; their numbers stay, for they are taken from a written table
    repeated = sized.groupBy(key).agg(F.count("*").alias("n_")).where("n_ > 1").select(key, F.lit(True).alias("again_"))
    sized = sized.withColumn("row_", F.monotonically_increasing_id()).join(repeated, key, "left")
    sized = sized.withColumn("copy_no", F.when(F.col("again_"), F.col("row_")).otherwise(F.lit(0).cast("bigint"))).drop("row_", "again_")
    sized = sized.withColumn("bucket", F.pmod(F.when(F.col("copy_no") > 0, F.xxhash64(key, "copy_no")).otherwise(F.xxhash64(key)), F.lit(shards * BUCKETS)).cast("int"))
    per_bucket = sized.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    if targets is None:
        shares = sized.groupBy("source").agg((F.sum("n_tokens") / F.lit(float(max(total, 1)))).alias("share"))
    else:
        shares = spark.createDataFrame(sorted(targets.items()), "source string, share double")
    # the middle of a bucket, in shards' worth of its source; sources without a target go behind all others
    dealt = (
        running(per_bucket, ["source"], "bucket", "tokens")
        .join(shares, "source", "left")
        .withColumn("share", F.coalesce("share", F.lit(0.0)))
        .withColumn("shard", F.when(F.col("share") > 0, F.floor((F.col("before") + F.col("tokens") / 2) / (F.col("share") * (total / shards)))).otherwise(F.lit(shards) + F.floor((F.col("before") + F.col("tokens") / 2) / F.lit(float(shard_tokens)))))
    )
    dealt = cut(dealt.select("source", "bucket", F.col("shard").cast("int").alias("shard"), "share", "tokens"))
    # what each source is owed when a shard begins: its target share of all tokens before, less what it had
    per = dealt.groupBy("shard", "source").agg(F.sum("tokens").alias("tokens"), F.first("share").alias("share"))
    whole = running(per.groupBy("shard").agg(F.sum("tokens").alias("whole")), [], "shard", "whole").select("shard", F.col("before").alias("all_before"))
    owed = running(per, ["source"], "shard", "tokens").join(whole, "shard").select("shard", "source", "share", (F.col("share") * F.col("all_before") - F.col("before")).alias("owed"))
    by = sized.join(dealt.select("source", "bucket", "shard"), ["source", "bucket"])
    rows = by.select("shard", F.col(key).alias("k_"), "copy_no", "source", "n_tokens", F.lit(0.0).alias("share"), F.lit(0.0).alias("owed"))
    plan = owed.select("shard", F.lit(None).cast(sized.schema[key].dataType).alias("k_"), F.lit(0).cast("bigint").alias("copy_no"), "source", F.lit(0).alias("n_tokens"), "share", "owed")
    kind = sized.schema[key].dataType.simpleString()

    def run_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        settings = pdf[pdf.n_tokens == 0]
        share, carried = dict(zip(settings.source, settings.share)), dict(zip(settings.source, settings.owed))
        docs = pdf[pdf.n_tokens > 0].sort_values(["k_", "copy_no", "source", "n_tokens"], kind="stable")
        parts, items = [], []
        for k, c, s, n in zip(docs.k_, docs.copy_no, docs.source, docs.n_tokens):
            for p, first in enumerate(range(0, n, capacity)):
                size = min(capacity, n - first)
                items.append((len(parts), s, size))
                parts.append((k, c, p, first, size, s))
        shard = int(pdf["shard"].iloc[0])
        got = [(f"{shard}-{box}", shard, box // window, offset, *parts[n]) for n, box, offset in pack(items, share, carried, capacity, window)]
        return pd.DataFrame(got, columns=["container", "shard", "window_no", "offset", key, "copy_no", "piece_no", "first_token", "n_tokens", "source"])

    return rows.unionByName(plan).groupBy("shard").applyInPandas(run_shard, f"container string, shard int, window_no int, offset int, `{key}` {kind}, copy_no bigint, piece_no int, first_token int, n_tokens int, source string")


def mixture(filled: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(shard, window_no, source, n_tokens, share, target): how near each window comes to the target proportions.

    targets: (source, target), default the proportions of all that was filled."""
    filled = cut(filled.groupBy("shard", "window_no", "source").agg(F.sum("n_tokens").alias("n_tokens")))
    if targets is None:
        one = filled.agg(F.sum("n_tokens").alias("all_"))
        targets = filled.groupBy("source").agg(F.sum("n_tokens").alias("t_")).crossJoin(one).select("source", (F.col("t_") / F.col("all_")).alias("target"))
    windows = filled.groupBy("shard", "window_no").agg(F.sum("n_tokens").alias("w_"))
    return filled.join(windows, ["shard", "window_no"]).join(targets, "source", "left").select("shard", "window_no", "source", "n_tokens", (F.col("n_tokens") / F.col("w_")).alias("share"), F.coalesce("target", F.lit(0.0)).alias("target"))
