"""Row numbers without gathering a group, or the table, in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesieve.session import cut


def _local_numbers(keys: Sequence[str], name: str) -> Callable:
    """Number the rows of a sorted partition from 1 within each run of equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, count = None, 0  # keys and number of the row before
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            starts = np.zeros(n, bool)
            for key in keys:
                column = batch.column(key)
                here, before = column.slice(1), column.slice(0, n - 1)
                differs = pc.fill_null(pc.not_equal(here, before), False)
                differs = pc.or_(differs, pc.not_equal(pc.is_null(here), pc.is_null(before)))
                starts[1:] |= differs.to_numpy(zero_copy_only=False)
            first = [batch.column(key)[0].as_py() for key in keys]
            starts[0] = last is None or first != last
            begin = np.maximum.accumulate(np.where(starts, np.arange(n), -count))
            numbers = np.arange(n) - begin + 1
            last, count = [batch.column(key)[n - 1].as_py() for key in keys], int(numbers[-1])
            columns = [*batch.columns, pa.array(numbers, pa.int64()), pa.array(np.full(n, part), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, name, "_part"])

    return run


def numbered_parts(df: DataFrame, order: Sequence[str], name: str, keys: Sequence[str] = ()) -> DataFrame:
    """``df`` range-partitioned by (keys, order), sorted and numbered inside each partition: the one exchange."""
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return ranged.mapInArrow(_local_numbers(keys, name), f"{fields}, `{name}` bigint, _part int")


def number_rows(df: DataFrame, order: Sequence[str], name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Number rows from 1 in ``order``, within ``keys`` if given.

    A key may hold a large share of all rows, so rows are range-partitioned by (keys,
    order) and numbered where they lie. A key that goes on from one partition to the next
    is the first of that one, so one offset for each partition puts the numbers right.
    ``order`` must be unique within a key.
    """
    placed = cut(numbered_parts(df, order, name, keys))
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    # one row for each partition
    ends = placed.groupBy("_part").agg(
        F.min(key).alias("first"), F.max(key).alias("last"), F.max_by(F.col(name), F.struct(key, F.col(name))).alias("n"),
    )
    offsets, before = [], None
    for r in ends.orderBy("_part").collect():
        start = before[1] if before and before[0] == r.first else 0
        offsets.append((r._part, start))
        before = (r.last, r.n + (start if r.first == r.last else 0))
    shift = df.sparkSession.createDataFrame(offsets, "_part int, _start bigint")
    shift = F.broadcast(ends.select("_part", F.col("first").alias("_first")).join(shift, "_part"))
    goes_on = key.eqNullSafe(F.col("_first"))
    return (
        placed.join(shift, "_part")
        .withColumn(name, F.col(name) + F.when(goes_on, F.col("_start")).otherwise(0))
        .drop("_part", "_first", "_start")
    )
