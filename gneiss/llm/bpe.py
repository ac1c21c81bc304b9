"""Problem 8: encoding with a public byte-level BPE.

Words of the split pattern are merged with a priority queue of merge ranks over a doubly linked list of symbols;
entries made stale by other merges are skipped when they come up. Decoding concatenates vocabulary strings.

Defined cases: a null and an empty text both give an empty list; strings of special tokens are ordinary text; every
row yields one row, so repeated rows are repeated; only the columns named are read, whatever others are called.
"""

from __future__ import annotations

import base64
import heapq
import os

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Place of the vocabulary, a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept per worker; the cache starts anew beyond that, so memory stays bounded.
CACHE = 200_000
_loaded: dict[str, "ByteBPE"] = {}


class ByteBPE:
    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.strings = {v: k for k, v in self.ranks.items()}
        self.words = regex.compile(PATTERN)
        self.cache: dict[str, list[int]] = {}

    @classmethod
    def load(cls, path: str = VOCABULARY) -> "ByteBPE":
        """One instance per worker process and path."""
        if path not in _loaded:
            sent = None if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
            _loaded[path] = cls(sent or path)
        return _loaded[path]

    def merge(self, word: bytes) -> list[int]:
        ranks = self.ranks
        if (whole := ranks.get(word)) is not None:
            return [whole]
        n = len(word)
        end = list(range(1, n + 1))  # symbol i is word[i:end[i]]
        prev = list(range(-1, n - 1))
        alive = bytearray(b"\1") * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, stop = pop(heap)
            if not alive[i]:
                continue
            j = end[i]
            if j >= n or end[j] != stop:
                continue  # stale: one of the two has been merged since
            alive[j] = 0
            end[i] = stop
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    push(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
                push(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        cache = self.cache
        for word in self.words.findall(text):
            ids = cache.get(word)
            if ids is None:
                ids = self.merge(word.encode())
                if len(word) <= 64:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[word] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode(errors="replace")


def _send(df: DataFrame, path: str) -> None:
    """Executors get the vocabulary from the driver; they may not have its path."""
    df.sparkSession.sparkContext.addFile(path)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>): one row per row of df."""
    _send(df, path)

    def run(batches):
        bpe = ByteBPE.load(path)
        for b in batches:
            ids = [bpe.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, type=pa.list_(pa.int32()))], names=[key, "ids"])

    kind = df.select(F.col(key).alias(key)).schema[key].dataType.simpleString()
    return df.select(F.col(key).alias(key), F.col(text).alias("text_")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count(df: DataFrame, text: str, path: str = VOCABULARY, out: str = "n_tokens") -> DataFrame:
    """df with the number of tokens of its column text; null and empty texts have 0."""
    _send(df, path)

    @F.pandas_udf("int")
    def n(texts):
        bpe = ByteBPE.load(path)
        return texts.map(lambda t: len(bpe.encode(t)))

    column: Column = n(F.coalesce(F.col(text), F.lit("")))
    return df.withColumn(out, column)


def decoded(df: DataFrame, ids: str = "ids", out: str = "text", path: str = VOCABULARY) -> DataFrame:
    _send(df, path)

    @F.pandas_udf("string")
    def text(column):
        bpe = ByteBPE.load(path)
        return column.map(lambda x: bpe.decode(list(x)))

    return df.withColumn(out, text(ids))
