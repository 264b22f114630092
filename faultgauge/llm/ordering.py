"""Global positions in a sort order, without a single task that sees all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from faultgauge.llm.common import written

BASES = StructType([
    StructField("_part", IntegerType()), StructField("_rows", LongType()), StructField("_names", LongType()), StructField("_marks", LongType()),
])


def unlike(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Whether values at the same place differ; nulls are alike."""
    return pc.coalesce(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def placed(df: DataFrame, keys: list[str], tie: list[str], keep: list[str], mark: str | None = None, pieces: int | None = None) -> DataFrame:
    """``keep`` columns with ``place``, ``name`` and, where ``mark`` is a boolean column, ``marked``.

    ``place`` counts rows in the order of ``keys`` and ``tie`` from 0; ``name`` counts distinct keys up to the
    row from 1; ``marked`` counts rows before it for which ``mark`` holds. Rows with equal keys may lie in
    several ranges. Ranges are sorted and numbered on their own and written; a line for each range (its first
    and last key and its counts) then goes to the driver and gives what to add.
    """
    spark = df.sparkSession
    pieces = pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = list(dict.fromkeys([*keep, *keys, *([mark] if mark else [])]))
    source = df.select(*columns, *[t for t in tie if t not in columns])
    dealt = source.repartitionByRange(pieces, *keys, *tie).sortWithinPartitions(*keys, *tie).select(*columns)
    extra = pa.schema([("_part", pa.int32()), ("_row", pa.int64()), ("_name", pa.int64()), ("_mark", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, name, marks, last = TaskContext.get().partitionId(), 0, 0, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            steps = np.zeros(n, np.int64)  # 1 where a row's key is not that of the row before
            steps[0] = last != [c[0].as_py() for c in columns]
            for c in columns:
                steps[1:] |= unlike(c.slice(1), c.slice(0, n - 1))
            names = name + np.cumsum(steps)
            flags = np.zeros(n, np.int64)
            if mark:
                flags += pc.fill_null(batch.column(batch.schema.get_field_index(mark)), False).to_numpy(zero_copy_only=False)
            before = marks + np.cumsum(flags) - flags
            numbers = [pa.array(np.full(n, part, np.int32)), *[pa.array(x) for x in (np.arange(row, row + n), names, before)]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *numbers], schema=pa.schema([*batch.schema, *extra]))
            row, name, marks, last = row + n, int(names[-1]), marks + int(flags.sum()), [c[n - 1].as_py() for c in columns]

    schema = StructType([*dealt.schema.fields, *[StructField(f.name, IntegerType() if f.name == "_part" else LongType()) for f in extra]])
    parts = written(dealt.mapInArrow(run, schema), "order")
    of_row = F.struct("_row", "_name", *[F.col(k).alias(f"k_{k}") for k in keys], "_mark", (F.col(mark) if mark else F.lit(False)).alias("_m"))
    ends = parts.groupBy("_part").agg(F.min(of_row).alias("first"), F.max(of_row).alias("last")).collect()
    bases, rows, names, marks, before = [], 0, 0, 0, None
    for r in sorted(ends, key=lambda r: r["_part"]):
        first, last = r["first"], r["last"]
        # a key that goes on from the range before has its name already
        if before is not None and before == [first[f"k_{k}"] for k in keys]:
            names -= 1
        bases.append((r["_part"], rows, names, marks))
        rows += last["_row"] + 1
        names += last["_name"]
        marks += last["_mark"] + int(bool(last["_m"]))
        before = [last[f"k_{k}"] for k in keys]
    # one row for each range
    added = F.broadcast(spark.createDataFrame(bases, BASES))
    out = parts.join(added, "_part").select(
        *keep, (F.col("_row") + F.col("_rows")).alias("place"), (F.col("_name") + F.col("_names")).alias("name"),
        (F.col("_mark") + F.col("_marks")).alias("marked"),
    )
    return out if mark else out.drop("marked")
