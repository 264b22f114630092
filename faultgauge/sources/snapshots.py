"""Tables of one folder that change together: data files first, then one small manifest that makes them visible.

A batch is what one job writes, a folder of its own in each table. The manifest of a version lists the live batches,
each with its generation; readers take the latest version and nothing else, so they never see parents without their
children, nor half of a deletion. A batch is never changed in place: a new generation of it is written beside the
old one and a new manifest switches over. Two writers that publish the same version collide, and the second one fails.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

MANIFEST = "batch string, generation int, tables array<string>"


@dataclass(frozen=True)
class Batch:
    name: str
    generation: int
    tables: tuple[str, ...]

    def path(self, folder: str, table: str) -> str:
        return f"{folder}/{table}/batch={self.name}/generation={self.generation}"


def _latest(spark: SparkSession, folder: str) -> tuple[int, list[Batch]]:
    try:
        manifests = spark.read.schema(f"{MANIFEST}, version int").json(f"{folder}/manifest")
    except AnalysisException:  # nothing was published yet
        return 0, []
    version = manifests.agg(F.max("version")).first()[0] or 0
    # a line for each batch
    rows = manifests.filter(F.col("version") == version).filter(F.col("batch").isNotNull()).collect()
    return version, [Batch(r["batch"], r["generation"], tuple(r["tables"])) for r in rows]


def live(spark: SparkSession, folder: str) -> list[Batch]:
    """The batches of the latest version."""
    return _latest(spark, folder)[1]


def write(tables: dict[str, DataFrame], folder: str, batch: Batch) -> None:
    """The files of a batch, which nobody sees before it is published. What an attempt that failed left is replaced."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(batch.path(folder, name))


def publish(spark: SparkSession, folder: str, changed: list[Batch]) -> None:
    """Switch to a version in which the changed batches take the place of those of the same name."""
    version, batches = _latest(spark, folder)
    now = {b.name: b for b in [*batches, *changed]}
    rows = [(b.name, b.generation, list(b.tables)) for b in now.values()]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("error").json(f"{folder}/manifest/version={version + 1}")


def read(spark: SparkSession, folder: str, table: str, batches: list[Batch] | None = None) -> DataFrame:
    """The rows of a table in the live batches, or in some of them: files of other batches are not opened."""
    chosen = [b for b in (live(spark, folder) if batches is None else batches) if table in b.tables]
    if not chosen:
        raise LookupError(f"no published batch of {folder} holds {table}")
    parts = [spark.read.parquet(b.path(folder, table)) for b in chosen]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
