"""Token counts of documents in flat, unindexed token files, by a scan for separators.

A file is a run of blocks of token ids, cut without regard to documents; an identifier of its own ends each
document. Blocks are searched on their own, all ids at a time. Sums over the blocks before it then give each
block its place in the file and the last separator before it, which stitches documents that cross blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from faultgauge.llm.bpe import Encoder
from faultgauge.llm.common import slices, texts, written

END = 50256  # ends a document; the vocabulary leaves it free
BLOCK = 1 << 16  # tokens

FLAT = pa.schema([("file", pa.int32()), ("number", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])


def flat_files(docs: DataFrame, path: str, pattern: str, block: int = BLOCK) -> DataFrame:
    """Written rows ``file, number, doc_id, ids``: blocks (with ids), and the order of the documents (without), by file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file, rest = Encoder(path, pattern), TaskContext.get().partitionId(), b""
        end, size, place, blocks = np.array([END], "<u4").tobytes(), 4 * block, 0, 0
        for part in slices(batches, "text"):
            rows = []
            for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                rows.append((file, place, doc_id, None))
                place += 1
                rest += ids + end
                whole = len(rest) // size
                rows += [(file, blocks + i, None, rest[i * size : (i + 1) * size]) for i in range(whole)]
                blocks, rest = blocks + whole, rest[whole * size :]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), FLAT)], schema=FLAT)
        if rest:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((file, blocks, None, rest), FLAT)], schema=FLAT)

    return written(texts(docs).mapInArrow(run, "file int, number long, doc_id long, ids binary"), "tokens")


def count(blocks: DataFrame, end: int = END) -> DataFrame:
    """``file, place, start, n_tokens`` of each document in ``blocks(file, number, ids)``, by its place in the file.

    Only documents that a separator ends count; an empty one has no tokens. No blocks, no rows.
    """

    @F.pandas_udf("array<int>")
    def found(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: np.flatnonzero(np.frombuffer(x, "<u4") == end).astype(np.int32))

    before = W.partitionBy("file").orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    scanned = blocks.select("file", "number", (F.octet_length("ids") / 4).cast("long").alias("n"), found("ids").alias("at"))
    based = scanned.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
    last = F.when(F.size("at") > 0, F.col("base") + F.element_at("at", -1))
    stitched = based.withColumn("last", last).withColumns({
        "places": F.coalesce(F.sum(F.size("at")).over(before), F.lit(0).cast("long")),
        "ended": F.coalesce(F.max("last").over(before), F.lit(-1).cast("long")),
    })
    each = stitched.select("file", "base", "places", "ended", "at", F.posexplode("at").alias("i", "stop"))
    start = F.when(F.col("i") == 0, F.col("ended")).otherwise(F.col("base") + F.get("at", F.col("i") - 1)) + 1
    return each.select("file", (F.col("places") + F.col("i")).alias("place"), start.alias("start"), (F.col("base") + F.col("stop") - start).alias("n_tokens"))


def document_counts(docs: DataFrame, path: str, pattern: str, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_tokens`` of every row of ``docs(doc_id, text)``, counted in the flat files of their tokens.

    A null text is empty and has no tokens; repeated rows count each; an empty table gives no rows.
    """
    flat = flat_files(docs, path, pattern, block)
    order = flat.filter(F.col("ids").isNull()).select("file", F.col("number").alias("place"), "doc_id")
    return order.join(count(flat.filter(F.col("ids").isNotNull())), ["file", "place"]).select("doc_id", "n_tokens")
