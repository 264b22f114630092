"""Top-k per group, and ranks and running sums that hold for groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from faultgauge.session import materialise


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows of each group. Spark cuts each map task's share to k rows before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def running_sums(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add running sums (whole numbers) of ``sums`` in ``order`` within each group.

    A group may hold any share of the rows. Rows are dealt by ranges of (group, order), sorted, and summed up in one
    walk through each range, where they are; callers pass the columns that they need and no more. The result is
    checkpointed, so that both passes see the same ranges, also after an executor is lost. Only a range's first group
    can have begun before it: a line for each range goes to the driver and comes back as what to add there.
    """
    names = [f"_{n}" for n in sums]
    keyed = df.withColumns({f"_{n}": c.cast("bigint") for n, c in sums.items()})
    ranged = keyed.repartitionByRange(*[F.col(g) for g in group], *order).sortWithinPartitions(*group, *order)
    marks = T.StructType([T.StructField("_piece", T.IntegerType()), T.StructField("_row", T.LongType()), T.StructField("_first", T.BooleanType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, row, first, key, carried = TaskContext.get().partitionId(), 0, True, None, [0] * len(names)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            head, tail = ({g: columns[g][k].as_py() for g in group} for k in (0, n - 1))
            # where a group begins; the first row goes on with the batch before if it has its key
            begins = np.zeros(n, bool)
            begins[0] = row == 0 or head != key
            for g in group:
                before, after = columns[g].slice(0, n - 1), columns[g].slice(1)
                differs = pc.fill_null(pc.not_equal(before, after), False).to_numpy(zero_copy_only=False)
                begins[1:] |= differs | (before.is_null().to_numpy(zero_copy_only=False) != after.is_null().to_numpy(zero_copy_only=False))
            starts = np.flatnonzero(begins)
            of = np.cumsum(begins) - 1  # -1 for rows of the group that goes on
            for i, name in enumerate(names):
                total = np.cumsum(columns[name].fill_null(0).to_numpy())
                base = np.concatenate([total[starts] - columns[name].fill_null(0).to_numpy()[starts], [-carried[i]]])
                columns[name] = pa.array(total - base[of], pa.int64())
                carried[i] = int(columns[name][n - 1].as_py())
            in_first = (of < 0) if row else (of == 0)
            in_first = in_first & first
            first = first and bool(in_first[-1])
            yield pa.RecordBatch.from_arrays(
                [*columns.values(), pa.array(np.full(n, piece, np.int32)), pa.array(np.arange(row, row + n)), pa.array(in_first)],
                names=[*columns, "_piece", "_row", "_first"],
            )
            row, key = row + n, tail

    pieces = materialise(ranged.mapInArrow(walk, T.StructType([*ranged.schema.fields, *marks.fields])))
    so_far = F.struct(F.struct(*group).alias("key"), F.array(*names).alias("sums"))
    ends = pieces.groupBy("_piece").agg(
        F.max_by(so_far, "_row").alias("last"), F.max_by(so_far, F.when(F.col("_first"), F.col("_row"))).alias("first")
    ).collect()
    added, key, carried = [], None, [0] * len(names)
    for end in sorted(ends, key=lambda r: r["_piece"]):
        goes_on = key is not None and end["first"]["key"] == key
        before = carried if goes_on else [0] * len(names)
        added.append((end["_piece"], *before))
        key, carried = end["last"]["key"], list(end["last"]["sums"])
        if end["first"]["key"] == key:
            carried = [x + y for x, y in zip(carried, before)]
    before = df.sparkSession.createDataFrame(added, "_piece int, " + ", ".join(f"{n}_before bigint" for n in names))
    # a row for each range
    moved = pieces.join(F.broadcast(before), "_piece")
    whole = {n: F.col(f"_{n}") + F.when(F.col("_first"), F.col(f"_{n}_before")).otherwise(0) for n in sums}
    return moved.select(*df.columns, *[c.alias(n) for n, c in whole.items()])


def rank_rows(df: DataFrame, group: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """Number all rows of each group, without a limit on its size."""
    return running_sums(df, group, order, {rank: F.lit(1).cast("bigint")})


def hash_ranks(df: DataFrame, group: str, key: str, seed: int, digits: int = 3) -> DataFrame:
    """Number the rows of few, large groups in the order of a seeded hash of a unique key.

    The hash is even, so its leading digits cut every group into even buckets. Only the counts per
    (group, bucket) meet in one place: 16**digits rows for each value of ``group``.
    """
    hash_of = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    place = F.struct(F.col(group).alias("group"), F.substring(hash_of, 1, digits).alias("bucket"))
    counts = df.groupBy(place.alias("_place")).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("_place.group")
    earlier = whole.orderBy("_place.bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_place",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("group_rows"),
    )
    local = Window.partitionBy("_place").orderBy("_hash", key)
    return (
        df.withColumns({"_hash": hash_of, "_place": place})
        .withColumn("_local", F.row_number().over(local))
        .join(offsets, "_place")
        .withColumn("rank", F.col("_local") + F.col("_before"))
        .select(*df.columns, "rank", "group_rows")
    )
