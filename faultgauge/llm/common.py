"""Shared helpers: reading a table, written intermediate tables, bounded slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultgauge.session import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch: texts are long, and a worker holds a batch or two at a time.
BATCH_ROWS = 1_000


def bounded_batches(spark: SparkSession) -> None:
    """Have the session send tasks smaller Arrow batches than it does for rows of a few numbers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: the lineage ends, and a lost executor recomputes nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made, when everything that was to be read from them has been written itself."""
    for table in tables:
        spark = table.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text alone, in bounded batches; a null text reads as the empty one."""
    bounded_batches(df.sparkSession)
    return df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text))


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut and join batches so that one slice holds about ``limit`` bytes of ``column``, or a single row, or 10,000 rows."""
    parts: list[pa.RecordBatch] = []
    total = rows = 0

    def joined() -> pa.RecordBatch:
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    for batch in batches:
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()
        start = 0
        for i, size in enumerate(sizes):
            if rows and (total + (size or 0) > limit or rows == 10_000):
                if i > start:
                    parts.append(batch.slice(start, i - start))
                yield joined()
                parts, start, total, rows = [], i, 0, 0
            total, rows = total + (size or 0), rows + 1
        if start < batch.num_rows:
            parts.append(batch.slice(start))
    if parts:
        yield joined()
