"""Exact duplicates, heavy groups apart: Misra-Gries counters find frequent digests, whose winners go to every task.

Each task keeps a fixed number of counters over the digests of its rows; the counters of all tasks merge into as many.
Every digest above the guaranteed share is among them. Those are counted exactly, and the ones that are verified as
frequent are broadcast with the row that stays: copies in heavy groups are settled where they are read. All other
digests have groups below that share of the rows and take an ordinary shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from faultgauge.llm.common import written

COUNTERS = 1_024  # a digest of more than one in 1,025 rows is always found; the broadcast has at most as many rows

SKETCH = pa.schema([("digest", pa.binary()), ("low", pa.int64())])


def add(held: dict[bytes, int], more: dict[bytes, int], counters: int) -> dict[bytes, int]:
    """Merge two sets of Misra-Gries counters: sums, less the largest sum that finds no room, where positive.

    Each unit taken off is taken off ``counters + 1`` sums, so no count ends more than rows / (counters + 1) too low.
    """
    sums = dict(held)
    for key, n in more.items():
        sums[key] = sums.get(key, 0) + n
    if len(sums) <= counters:
        return sums
    cut = sorted(sums.values(), reverse=True)[counters]
    return {key: n - cut for key, n in sums.items() if n > cut}


def candidates(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``digest`` of at most ``counters`` rows, with every one that has more than rows / (counters + 1) of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            counted = batch.column(0).value_counts()
            held = add(held, dict(zip(counted.field(0).to_pylist(), counted.field(1).to_pylist())), counters)
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], schema=SKETCH)

    sums = digests.select("digest").mapInArrow(run, "digest binary, low long").groupBy("digest").agg(F.sum("low").alias("low"))
    # the merge of all counters: what is beyond the last one's room sets the cut, and whatever equals the cut goes
    best = written(sums.orderBy(F.desc("low"), "digest").limit(counters + 1), "counters")
    cut = best.agg(F.when(F.count("*") > counters, F.min("low")).otherwise(0).alias("cut"))
    return best.join(F.broadcast(cut), F.col("low") > F.col("cut")).select("digest")


def _winners(rows: DataFrame) -> DataFrame:
    """Each digest's row that stays: the largest id, and of rows that repeat it the last written one."""
    return rows.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("best"), F.count("*").alias("n"))


def groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] = lambda c: c, counters: int = COUNTERS
) -> DataFrame:
    """``key, keep_id, group_size, kept, text_sha256`` of every row of ``docs(key, text)``.

    Texts are equal when they are identical after ``normalise`` (no change by default), compared by SHA-256. Of equal
    ones, the row with the largest key stays. A null text is empty; a null key is less than any other. Of rows that
    repeat key and text, exactly one has ``kept``. Other columns, whatever their names, have no part. No rows, no rows.
    """
    content = F.sha2(normalise(F.coalesce(F.col(text), F.lit(""))), 256)
    digests = written(docs.select(F.col(key).alias("id"), F.unhex(content).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    frequent = digests.count() / (counters + 1)
    heavy = written(
        _winners(digests.join(F.broadcast(candidates(digests, counters)), "digest")).filter(F.col("n") > frequent), "heavy"
    )
    # at most `counters` rows: each of them has more than rows / (counters + 1)
    settled = digests.join(F.broadcast(heavy), "digest", "left")
    rest = settled.filter(F.col("n").isNull()).select("id", "digest", "row")
    out = settled.filter(F.col("n").isNotNull()).unionByName(rest.join(_winners(rest), "digest"))
    return out.select(
        F.col("id").alias(key), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """The rows of ``docs``, all columns, whose key and text are those of a row that stays; rows that repeat both stay together."""
    stay = groups(docs, key, text, normalise).filter("kept").select(F.col(key).alias("_id"), F.unhex("text_sha256").alias("_digest"))
    content = F.unhex(F.sha2(normalise(F.coalesce(docs[text], F.lit(""))), 256))
    return docs.join(stay, docs[key].eqNullSafe(stay["_id"]) & (content == stay["_digest"]), "left_semi")
