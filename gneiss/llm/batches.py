"""Running plain Python functions over Arrow batches, whole rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[..., Iterable[tuple]]], heavy: bool = False) -> DataFrame:
    """For each row of df, calls the function made by make (once per task) with the row's columns and yields its tuples.

    Rows stream through in Arrow batches; nothing is kept between batches except what make() caches.
    heavy: spreads the rows over all cores first where the input has fewer splits than those.
    """
    out: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        for batch in batches:
            rows: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                rows.extend(call(*row))
                if len(rows) >= 4096:
                    yield _batch(rows, arrow)
                    rows = []
            if rows:
                yield _batch(rows, arrow)

    if heavy and df.rdd.getNumPartitions() < (slots := df.sparkSession.sparkContext.defaultParallelism):
        df = df.repartition(slots)
    return df.mapInArrow(run, out)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


def hashed(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, those with the smallest hashes of a key; no task or driver meets many more.

    A threshold on the hash first leaves about one and a half times as many, whatever the number of rows.
    """
    total = rows.count()
    share = min(1.0, 1.5 * most / max(1, total) + 1e-4)
    h = F.xxhash64(key)
    return rows.where(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30)) + 1).orderBy(F.pmod(h, F.lit(1 << 30)), key).limit(most)
