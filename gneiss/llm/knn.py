"""Problem 2: the most similar vectors of every vector, by an inverted multi-index.

Vectors are scaled to length 1, turned to the principal axes and cut into halves; each half is quantised by its own codebook,
and a pair of centroids is a cell. The first half then holds what many vectors share, the second what is left, so cells are
filled evenly. A query visits cells in the order of the summed distances of its halves to the cells' centroids (the first pairs
in bulk, the rest from a heap) until the cells visited hold the candidates wanted; the entries are then ranked by their cosine.
The candidates wanted, and the number of cells, grow with the collection: with as many at every size ever more neighbours are missed.
A query in a crowd, by the probes of the sample, visits the cells of the crowd.

Cells are gathered into groups of neighbouring cells with a bounded number of entries; cells above that are parted into blocks
of their own. A query is sent once to each group it visits, with the distance up to which it visits cells; a task holds one
group's entries and lets the queries stream past, so a cell that many queries visit needs no more memory. A group that more than
VISITS queries for each of its entries are expected at, by the visits of PROBES of the sample, is copied, and its queries are dealt
to the copies, so no task grows with the collection. The best of each group are merged per query. Vectors travel, and are ranked,
as 16-bit integers scaled to the largest value of the vector.

The axes and codebooks are fitted on at most SAMPLE vectors, those with the smallest hashes of their ids; every vector is
indexed and every vector is a query. The number of centroids grows with the root of the number of vectors.

Defined cases: null, all-zero, non-finite and wrongly sized vectors take no part; an id counts once, with its smallest
usable vector should they differ, before anything is counted or searched; fewer than k others give as many as there are; ties go to the smaller id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.session import cut

SAMPLE, ROUNDS = 20_000, 8
#: Entries that a query compares at least among up to WHOLE vectors; among more, they grow with that power of the number.
CANDIDATES, WHOLE, POWER = 10_000, 200_000, 0.4
#: Entries of a group at most, between these bounds, and groups that a collection between them has.
GROUP, GROUPS = (32_000, 128_000), 24
#: Bounds of the number of centroids of a half, and vectors per pair of centroids that the number aims at.
FEWEST, MOST, DENSITY = 8, 1024, 40
#: Pairs of centroids that are looked at in bulk, step by step; the heap takes what needs more.
FIRST_PAIRS = (128, 512, 2048)
#: Queries that one copy of a group is expected to serve at most, for each of its entries, and vectors of the sample that tell how many come.
VISITS, PROBES = 4, 2_000
#: Cosine from which a probe is of a vector's crowd, probes that make one, and candidates in a crowd as a multiple of those wanted.
CLOSE, CROWD, CROWDED = 0.6, 5, 16
#: Queries that a group takes at a time, and what rounding may change a distance by.
SLICE, MARGIN = 10_000, np.float32(1e-4)
#: Entries that a query keeps in a group beyond k: itself, and what the last bits may put in another order.
SPARE = 4
#: Slots of the hashes of ids; those that hold a repeated id are broadcast.
SLOTS = 1 << 20


def centroids(n: int) -> int:
    return int(min(MOST, max(FEWEST, round((n / DENSITY) ** 0.5))))


def wanted(n: int) -> int:
    """The candidates of a query among n vectors."""
    return round(CANDIDATES * max(1.0, n / WHOLE) ** POWER)


def grouped(n: int) -> int:
    """The entries of a group, of n vectors."""
    return int(min(GROUP[1], max(GROUP[0], n // GROUPS)))


def fit(half: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centroids of one half by k-means with spread starting points."""
    rng = np.random.default_rng(seed)
    if len(half) <= k:
        return half.astype(np.float32).copy()
    c = half[rng.choice(len(half), k, replace=False)].astype(np.float32)
    for _ in range(ROUNDS):
        near = _nearest(half, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, half)
        n = np.bincount(near, minlength=k)
        empty = n == 0
        c = np.where(empty[:, None], c, sums / np.maximum(n, 1)[:, None]).astype(np.float32)
        if empty.any():
            c[empty] = half[rng.choice(len(half), int(empty.sum()), replace=False)]
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :], 0)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(x[i : i + 8192], c).argmin(1) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, int)


def axes(sample: np.ndarray) -> np.ndarray:
    """The principal axes of the sample as columns, by falling variance."""
    return np.linalg.eigh(sample.T.astype(np.float64) @ sample)[1][:, ::-1].astype(np.float32)


def _first_pairs(k1: int, k2: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ranks that can be among the first most: (i, j) comes after all (i + 1) * (j + 1) - 1 pairs of smaller ranks."""
    n = np.minimum(most // (np.arange(min(k1, most)) + 1), k2)
    return np.repeat(np.arange(len(n)), n), np.concatenate([np.arange(c) for c in n])


class Index:
    """The axes, the codebooks and what is known of the cells: sizes and groups. Bounded by the number of cells."""

    def __init__(self, turn: np.ndarray, books: tuple[np.ndarray, np.ndarray]):
        self.turn, self.books = turn, books
        self.copies: np.ndarray = np.zeros((0, 2), np.int64)  # of each group: the number of its first copy, and how many there are

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the halves of vectors to the centroids of either book."""
        y, h = x @ self.turn, x.shape[1] // 2
        return _distances(y[:, :h], self.books[0]), _distances(y[:, h:], self.books[1])

    def cells(self, x: np.ndarray) -> np.ndarray:
        h = x.shape[1] // 2
        y = x @ self.turn
        return _nearest(y[:, :h], self.books[0]) * len(self.books[1]) + _nearest(y[:, h:], self.books[1])

    def set_sizes(self, sizes: dict[int, int], group: int) -> None:
        """Gathers cells with near centroids into groups of at most group entries."""
        k1, k2 = len(self.books[0]), len(self.books[1])
        self.sizes = np.zeros(k1 * k2, np.int64)
        self.first, self.blocks = np.full(k1 * k2, -1, np.int32), np.ones(k1 * k2, np.int32)  # first group, number of blocks
        self.sizes[list(sizes)] = list(sizes.values())
        # cells in the order of the first half's centroid along a chain of near ones, then of the second's
        rank1, rank2 = _chain(self.books[0]), _chain(self.books[1])
        number, held = 0, 0
        for cell in sorted(sizes, key=lambda c: (rank1[c // k2], rank2[c % k2])):
            n = sizes[cell]
            if n > group:
                blocks = -(-n // group)
                number += bool(held)
                self.first[cell], self.blocks[cell] = number, blocks
                number, held = number + blocks, 0
                continue
            if held + n > group:
                number, held = number + 1, 0
            self.first[cell] = number
            held += n

    def set_copies(self, probes: np.ndarray, n: int, candidates: int, most: int) -> None:
        """Keeps the probes and copies the groups at which the probes, each for its share of n queries, come more often than most."""
        self.probes, self.probe_cells = probes, self.cells(probes)
        total = 1 + int((self.first + self.blocks - 1).max(initial=-1))
        came = np.bincount(self.visits(probes, candidates)[3], minlength=total) * (n / max(1, len(probes)))
        copies = np.maximum(1, -(-came.astype(np.int64) // most))
        self.copies = np.stack([np.cumsum(copies) - copies, copies], axis=1)

    def visits(self, x: np.ndarray, candidates: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(near, far, who, group): for each vector the summed distances within which cells hold an eighth of the candidates and
        all of them, and the groups, one row each, that have a cell within far.

        Pairs of centroids are taken in the order of their distances. The first of them are picked in bulk from those that can
        be among the first; vectors that need more go on by the heap. A vector in a crowd, of which the probes hold some, goes on to
        the cells of all those: near vectors are hard to tell apart there, so candidates that are fewer than the crowd miss some.
        """
        near, far = np.zeros(len(x), np.float32), np.zeros(len(x), np.float32)
        who, groups = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        k1, k2 = len(self.books[0]), len(self.books[1])
        d1, d2 = self.distances(x)
        o1, o2 = d1.argsort(1, kind="stable"), d2.argsort(1, kind="stable")
        s1, s2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)

        close = x @ self.probes.T >= CLOSE
        crowded = np.flatnonzero(close.sum(1) >= CROWD)
        need = np.zeros(len(x), np.float32)
        for q in crowded:
            c = self.probe_cells[close[q]]
            need[q] = (d1[q, c // k2] + d2[q, c % k2]).max()

        def take(q: np.ndarray, cells: np.ndarray, d: np.ndarray, got: np.ndarray) -> None:
            """Cells of each vector q by rising d, got: entries up to each."""
            last = np.minimum((got < candidates).sum(1), d.shape[1] - 1)
            near[q] = np.take_along_axis(d, np.minimum((got < candidates / 8).sum(1), last)[:, None], 1)[:, 0]
            far[q] = np.take_along_axis(d, last[:, None], 1)[:, 0]
            i, j = np.nonzero((np.arange(d.shape[1]) <= last[:, None]) & (self.sizes[cells] > 0) & (need[q] <= far[q])[:, None])
            send(q[i], cells[i, j])

        def send(q: np.ndarray, c: np.ndarray) -> None:
            n = self.blocks[c].astype(np.int64)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            seen = np.unique(np.repeat(q, n) << 32 | (np.repeat(self.first[c], n) + step))
            who.append(seen >> 32)
            groups.append(seen & 0xFFFFFFFF)

        left = np.arange(len(x))
        for most in FIRST_PAIRS:
            i, j = _first_pairs(k1, k2, most)
            rest = []
            for at in range(0, len(left), rows := max(1, 2_000_000 // len(i))):
                q = left[at : at + rows]
                d = s1[q][:, i] + s2[q][:, j]
                if most < len(i):
                    pick = np.argpartition(d, most - 1, axis=1)[:, :most]
                    d = np.take_along_axis(d, pick, 1)
                else:
                    pick = np.broadcast_to(np.arange(len(i)), d.shape)
                order = d.argsort(1)
                pick, d = np.take_along_axis(pick, order, 1), np.take_along_axis(d, order, 1)
                cells = np.take_along_axis(o1[q], i[pick], 1) * k2 + np.take_along_axis(o2[q], j[pick], 1)
                got = np.cumsum(self.sizes[cells], 1)
                done = (got[:, -1] >= candidates) | (len(i) == k1 * k2 <= most)
                take(q[done], cells[done], d[done], got[done])
                rest.append(q[~done])
            left = np.concatenate(rest) if rest else left
            if not len(left):
                break
        for q in left:
            a, b, i1, i2 = s1[q].tolist(), s2[q].tolist(), o1[q].tolist(), o2[q].tolist()
            heap, got, cells = [(a[0] + b[0], 0, 0)], 0, []
            while heap and got < candidates:
                d, i, j = heapq.heappop(heap)
                cells.append((i1[i] * k2 + i2[j], d, got := got + int(self.sizes[i1[i] * k2 + i2[j]])))
                if j + 1 < k2:
                    heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
                if j == 0 and i + 1 < k1:
                    heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
            cell, d, got = (np.array(c)[None, :] for c in zip(*cells))
            take(np.array([q]), cell, d, got)
        for q in crowded[need[crowded] > far[crowded]]:
            most = need[q] + MARGIN
            i, j = np.flatnonzero(d1[q] <= most - s2[q, 0]), np.flatnonzero(d2[q] <= most - s1[q, 0])
            d, cells = (d1[q, i][:, None] + d2[q, j]).ravel(), (i[:, None] * k2 + j).ravel()
            order = d.argsort()
            order = order[(d[order] <= need[q]) & (self.sizes[cells[order]] > 0)]
            got = np.cumsum(self.sizes[cells[order]])
            order = order[: 1 + int((got < CROWDED * candidates).sum())]
            far[q] = d[order[-1]]
            send(np.full(len(order), q), cells[order])
        return near, far, np.concatenate(who), np.concatenate(groups)


def _chain(c: np.ndarray) -> list[int]:
    """Rank of each centroid on a walk that always goes on to the nearest one left."""
    left, rank, at = set(range(len(c))), [0] * len(c), 0
    for r in range(len(c)):
        rank[at] = r
        left.discard(at)
        if left:
            rest = np.fromiter(left, int)
            at = int(rest[((c[rest] - c[at]) ** 2).sum(1).argmin()])
    return rank


def unit(flat: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of length 1, which of the rows are usable)."""
    x = flat.reshape(-1, dim).astype(np.float32, copy=False)
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    ok = np.isfinite(norm) & (norm > 0)
    return (x[ok] / norm[ok, None].astype(np.float32)).astype(np.float32), ok


def _usable(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(k_, v_): the usable vectors, repeated ids among them."""
    v = F.col(vector).cast("array<float>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(v.isNotNull() & (F.size(v) == dim) & F.col(key).isNotNull() & ~odd & F.exists(v, lambda x: x != 0))
    return rows.select(F.col(key).cast("string").alias("k_"), v.alias("v_"))


def _once(rows: DataFrame) -> tuple[DataFrame, int]:
    """(one row per id, with its smallest vector; their number). Only ids in a slot with a repeated one have their vectors shuffled."""
    counts = rows.groupBy(F.xxhash64("k_").alias("h_")).agg(F.count("*").alias("c_"))
    slots = cut(counts.groupBy(F.pmod("h_", F.lit(SLOTS)).alias("s_")).agg(F.count("*").alias("ids"), F.max("c_").alias("most")))
    n = slots.agg(F.sum("ids")).first()[0] or 0
    repeated = F.broadcast(slots.where("most > 1").select("s_"))  # at most SLOTS numbers
    placed = rows.withColumn("s_", F.pmod(F.xxhash64("k_"), F.lit(SLOTS)))
    single = placed.join(repeated, "s_", "left_anti").select("k_", "v_")
    return single.unionAll(placed.join(repeated, "s_", "left_semi").groupBy("k_").agg(F.min("v_").alias("v_"))), n


def neighbours(df: DataFrame, key: str = "chunk_id", vector: str = "embedding", k: int = 5, candidates: int | None = None, group: int | None = None, visits: int | None = None) -> DataFrame:
    """(key string, near array<struct<id, cosine>> by falling cosine): the k most similar others of every usable vector.

    candidates a query, entries of a group and queries of its copy: by the number of vectors, unless given."""
    spark = df.sparkSession
    schema = "k_ string, near array<struct<id:string,cosine:float>>"
    sizes_seen = df.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("dim")).agg(F.count("*").alias("n")).collect()  # one row per vector size
    if not sizes_seen:
        return spark.createDataFrame([], schema).withColumnRenamed("k_", key)
    top = max(sizes_seen, key=lambda r: (r["n"], r["dim"]))
    dim = top["dim"]
    rows, n = _once(_usable(df, key, vector, dim))
    # the sample: an expected SAMPLE rows by hash, cut to SAMPLE
    share = min(1.0, SAMPLE / max(n, 1))
    slot = F.pmod(F.xxhash64("k_"), F.lit(1 << 20))
    sample = rows.where(slot < int(share * (1 << 20)) + 1).orderBy(slot, "k_").limit(SAMPLE).select("k_", "v_").toArrow()
    if sample.num_rows == 0:
        return spark.createDataFrame([], schema).withColumnRenamed("k_", key)
    order = np.argsort(np.array(sample.column(0).to_pylist()), kind="stable")
    x, _ = unit(_flat(sample.column(1).combine_chunks())[0].reshape(-1, dim)[order].ravel(), dim)
    h = dim // 2
    count, candidates, group = centroids(n), candidates or wanted(n), group or grouped(n)
    turn = axes(x)
    turned = x @ turn
    index = Index(turn, (fit(turned[:, :h], count, 1), fit(turned[:, h:], count, 2)))
    shared = spark.sparkContext.broadcast(index)  # codebooks: at most MOST centroids

    def sizes(batches):
        total: dict[int, int] = {}
        for b in batches:
            v, ok = unit(_flat(b.column(1))[0], dim)
            for cell, c in zip(*np.unique(shared.value.cells(v), return_counts=True)):
                total[int(cell)] = total.get(int(cell), 0) + int(c)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["cell", "n"])

    counted = rows.mapInArrow(sizes, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most the square of the centroids
    index.set_sizes(dict(zip(counted.column(0).to_pylist(), counted.column(1).to_pylist())), group)
    index.set_copies(x[:: max(1, len(x) // PROBES)], n, candidates, visits or VISITS * group)
    known = spark.sparkContext.broadcast(index)

    def spread(batches):
        """Entries (far null) go to their group, queries to every group they visit with the distances up to which they do."""
        ix = known.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                v, ok = unit(_flat(b.column(1))[0], dim)
                ids = b.column(0).filter(pa.array(ok))
                cells = ix.cells(v)
                near, far, who, group_ = ix.visits(v, candidates)
                own, copies, blocks = ix.first[cells].astype(np.int64), ix.copies, ix.blocks[cells]
                hashes = np.zeros(len(v), np.uint64)
                if blocks.max(initial=1) > 1 or copies[:, 1].max(initial=1) > 1:
                    hashes = np.array([hash_of(i) for i in ids.to_pylist()], np.uint64)
                own += (hashes % blocks.astype(np.uint64)).astype(np.int64)
                start, n_copies = copies[own].T
                entry = np.repeat(np.arange(len(v)), n_copies)
                to = start[entry] + np.arange(len(entry)) - np.repeat(np.cumsum(n_copies) - n_copies, n_copies)
                start, n_copies = copies[group_].T
                rows_ = np.concatenate([entry, who])
                groups = np.concatenate([to, start + (hashes[who] // np.uint64(7) % n_copies.astype(np.uint64)).astype(np.int64)])
                query = np.arange(len(rows_)) >= len(entry)
                packed = _packed(v)[rows_]
                offsets = np.arange(len(rows_) + 1, dtype=np.int32) * packed.shape[1] * 2
                columns = [
                    pa.array(groups.astype(np.int32)),
                    pa.array(cells[rows_].astype(np.int32), mask=query),
                    ids.take(pa.array(rows_)),
                    pa.Array.from_buffers(pa.binary(), len(rows_), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]),
                    pa.array(near[rows_], mask=~query),
                    pa.array(far[rows_], mask=~query),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["g_", "own", "k_", "x_", "near", "far"])

    sent = rows.mapInArrow(spread, "g_ int, own int, k_ string, x_ binary, near float, far float")
    # within a partition entries come before the queries of their group
    parts = sent.repartition("g_").sortWithinPartitions("g_", F.col("far").isNotNull())

    def search(batches):
        group_now, entries, ids, store = None, [], [], None
        for b in batches:
            gs = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(gs)) + 1).tolist(), len(gs)]
            for lo, hi in zip(edges, edges[1:]):
                if hi == lo:
                    continue
                part = b.slice(lo, hi - lo)
                if gs[lo] != group_now:
                    group_now, entries, ids, store = int(gs[lo]), [], [], None
                is_query = np.asarray(part.column(5).is_valid())
                start = int(is_query.argmax()) if is_query.any() else len(is_query)
                if start:
                    e = part.slice(0, start)
                    entries.append((e.column(1).to_numpy(), _integers(e.column(3), dim)))
                    ids += e.column(2).to_pylist()
                    store = None
                if start == len(is_query) or not ids:
                    continue
                if store is None:
                    store = _Store(known.value, entries, ids)
                    entries = []
                for at in range(start, len(is_query), SLICE):
                    q = part.slice(at, SLICE)
                    keys = q.column(2).to_pylist()
                    best = store.search(_unpacked(_integers(q.column(3), dim)), keys, q.column(4).to_numpy(), q.column(5).to_numpy(), k)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(best, pa.list_(pa.struct([("id", pa.string()), ("cosine", pa.float32())])))], names=["k_", "near"])

    found = parts.mapInArrow(search, schema)
    merged = found.groupBy("k_").agg(F.flatten(F.collect_list("near")).alias("all_"))  # at most k per visited group
    order = F.array_sort("all_", lambda a, b: F.when(a["cosine"] > b["cosine"], -1).when(a["cosine"] < b["cosine"], 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
    return merged.select(F.col("k_").alias(key), F.slice(order, 1, k).alias("near"))


def hash_of(key: str) -> int:
    n = 1469598103934665603
    for c in key.encode():
        n = ((n ^ c) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return n


def _flat(column) -> tuple[np.ndarray, int]:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float32), len(column)


def _packed(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1 as 16-bit integers; their length is not kept."""
    return np.round(x * (32767 / np.abs(x).max(1, initial=0.0)[:, None])).astype(np.int16)


def _integers(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int16).reshape(-1, dim)


def _unpacked(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float32)
    return y / np.sqrt((y * y).sum(1))[:, None]


class _Store:
    """The entries of one group, by cell."""

    def __init__(self, index: Index, entries, ids):
        cells = np.concatenate([c for c, _ in entries])
        x = np.concatenate([v for _, v in entries])
        names = np.array(ids)
        order = np.lexsort((names, cells))
        self.index, self.ids, cells = index, np.array(ids, dtype=object)[order], cells[order]
        self.x = _unpacked(x[order])
        self.rank = np.argsort(np.argsort(names, kind="stable"), kind="stable")[order]  # by id
        values, starts = np.unique(cells, return_index=True)
        ends = np.append(starts[1:], len(cells))
        k2 = len(index.books[1])
        self.rows = [(int(i), values[at] % k2, starts[at], ends[at]) for i in np.unique(values // k2) for at in [np.flatnonzero(values // k2 == i)]]

    def search(self, q: np.ndarray, keys: list[str], near: np.ndarray, far: np.ndarray, k: int) -> list[list[tuple]]:
        """The k best entries for each query among the cells it visits; a running bar keeps what can't be among them out."""
        d1, d2 = self.index.distances(q)
        d1, d2 = np.ascontiguousarray(d1.T), np.ascontiguousarray(d2.T)
        near, far = near + MARGIN, far + MARGIN
        best = np.full((len(keys), k + SPARE), -2.0, np.float32)
        place = np.full((len(keys), k + SPARE), -1, np.int64)
        # each query's nearest cells come first, so its bar is high early
        for first in (True, False):
            for i, js, starts, ends in self.rows:
                d = d2[js] + d1[i]
                visited = d <= near if first else (d > near) & (d <= far)
                for r in np.flatnonzero(visited.any(1)).tolist():
                    who, a, b = np.flatnonzero(visited[r]), int(starts[r]), int(ends[r])
                    step = max(1, 1_000_000 // (b - a))
                    for at in range(0, len(who), step):
                        self._compare(q, who[at : at + step], a, b, best, place)
        # products of matrices differ in the last bits with their shape, so the best are ranked by products of their own
        for at in range(0, len(q), 1000):
            some = slice(at, at + 1000)
            exact_ = np.einsum("qd,qkd->qk", q[some].astype(np.float64), self.x[place[some]].astype(np.float64))
            best[some] = np.where(place[some] >= 0, exact_, -2.0)
        order = np.lexsort((self.rank[place], -best), axis=1)
        best, place = np.take_along_axis(best, order, 1), np.take_along_axis(place, order, 1)
        ids = self.ids
        return [[(ids[j], v) for j, v in zip(js, vs) if j >= 0 and ids[j] != key][:k] for key, js, vs in zip(keys, place.tolist(), best.tolist())]

    def _compare(self, q: np.ndarray, w: np.ndarray, a: int, b: int, best: np.ndarray, place: np.ndarray) -> None:
        s = q[w] @ self.x[a:b].T
        better = np.flatnonzero(s.max(1) > best[w, -1])
        if not len(better):
            return
        w, s = w[better], s[better]
        m = min(best.shape[1], b - a)
        top = np.argpartition(s, b - a - m, axis=1)[:, b - a - m :] if m < b - a else np.broadcast_to(np.arange(b - a), s.shape)
        score = np.concatenate([best[w], np.take_along_axis(s, top, 1)], axis=1)
        where = np.concatenate([place[w], top + a], axis=1)
        keep = np.lexsort((where, -score), axis=1)[:, : best.shape[1]]
        best[w], place[w] = np.take_along_axis(score, keep, 1), np.take_along_axis(where, keep, 1)


def pairs(near: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(chunk_a, chunk_b; chunk_a < chunk_b), distinct."""
    other = near.select(F.col(key).alias("q_"), F.explode("near").alias("e_")).select("q_", F.col("e_.id").alias("n_"))
    return other.select(F.least("q_", "n_").alias("chunk_a"), F.greatest("q_", "n_").alias("chunk_b")).distinct()


def exact(x: np.ndarray, ids: list[str], k: int) -> list[list[str]]:
    """Brute force, for measuring recall."""
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    return [[ids[j] for j in sorted(range(len(ids)), key=lambda j: (-row[j], ids[j]))[:k] if np.isfinite(row[j])] for row in s]
