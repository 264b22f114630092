"""Stored analyses: writing, keyed lookup, unique insert and cascading delete."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultgauge.sources import snapshots

ANALYSIS_DEFAULTS = {"overall_risk": 0.0, "risk_level": "LOW"}
FILE_DEFAULTS = {"risk_score": 0.0, "risk_level": "LOW"}


def persist(analyses: DataFrame, files: DataFrame, folder: str, batch: str | None = None, others: dict[str, DataFrame] | None = None) -> str:
    """Store analyses and their files, and other tables of the same job, as one batch; returns its name.

    What is not given gets its default. Each analysis gets an id of its own (``row_id``); its files, given by
    ``analysis_id``, take that id from the written analyses as ``parent_row_id``; files of an analysis that is not
    there are not kept. All tables become visible together; a job that is repeated under the same name before it was
    published replaces what it left, and a published batch is refused.
    """
    spark = analyses.sparkSession
    now = datetime.now(timezone.utc)
    batch = batch or f"{now:%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:12]}"
    if batch in {b.name for b in snapshots.live(spark, folder)}:
        raise ValueError(f"batch {batch!r} is published already")
    one = snapshots.Batch(batch, 1, ("analyses", "analysis_files", *(others or {})))
    snapshots.write({"analyses": _stamp(analyses.fillna(ANALYSIS_DEFAULTS), now)}, folder, one)
    # read back: an id that is drawn again by a repeated task is not the one that was written
    drawn = spark.read.parquet(one.path(folder, "analyses")).select("analysis_id", F.col("row_id").alias("parent_row_id"))
    # stamped after the join: ids are drawn at random, and a shuffle cannot pack them
    children = _stamp(files.join(drawn, "analysis_id").fillna(FILE_DEFAULTS), now)
    snapshots.write({"analysis_files": children, **(others or {})}, folder, one)
    snapshots.publish(spark, folder, [one])
    return batch


def _stamp(rows: DataFrame, now: datetime) -> DataFrame:
    return (
        rows.withColumn("row_id", F.uuid())
        .withColumn("created_at", F.lit(now))
        .withColumn("created_date", F.to_date("created_at"))
    )


def lookup_owned(analyses: DataFrame, analysis_id: int, user_id: int) -> DataFrame:
    """One analysis, if it belongs to the user. Both conditions reach the scan."""
    return analyses.filter((F.col("analysis_id") == analysis_id) & (F.col("user_id") == user_id))


def lookup_many(analyses: DataFrame, wanted: DataFrame) -> DataFrame:
    """Outcome of many lookups (analysis_id, user_id) at once."""
    owners = analyses.select("analysis_id", F.col("user_id").alias("_owner"), "repository_name")
    found = F.col("_owner") == F.col("user_id")
    return wanted.join(owners, "analysis_id", "left").select(
        "analysis_id",
        "user_id",
        F.when(found, "found").otherwise("not found").alias("outcome"),
        F.when(found, F.col("repository_name")).alias("repository_name"),
    )


def unique_insert(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """New rows whose key is not taken; of several new rows with one key, the first by ``order``."""
    first = F.min_by(F.struct(*new.columns), F.col(order))
    return new.groupBy(key).agg(first.alias("_row")).select("_row.*").join(existing.select(key), key, "left_anti")


def cascade_delete(
    users: DataFrame, analyses: DataFrame, files: DataFrame, deleted_users: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left of all three tables when users go, and their analyses and files with them."""
    kept_users = users.join(deleted_users, "user_id", "left_anti")
    kept_analyses = analyses.join(deleted_users, "user_id", "left_anti")
    gone = analyses.join(deleted_users, "user_id", "left_semi").select("analysis_id")
    kept_files = files.join(gone, "analysis_id", "left_anti")
    return kept_users, kept_analyses, kept_files


def delete_users(spark: SparkSession, folder: str, deleted: DataFrame) -> list[str]:
    """Delete ``deleted(user_id)`` with their analyses and files; returns the names of the batches that were rewritten.

    Only batches that hold something to delete are written again, as a new generation; the others keep their files.
    One manifest switches all of them over.
    """
    changed = []
    for batch in snapshots.live(spark, folder):
        of = lambda table: snapshots.read(spark, folder, table, [batch])  # noqa: E731, B023
        tables = {}
        if "users" in batch.tables:
            tables["users"] = of("users").join(deleted, "user_id", "left_anti"), of("users").join(deleted, "user_id", "left_semi")
        if "analyses" in batch.tables:
            gone = of("analyses").join(deleted, "user_id", "left_semi")
            tables["analyses"] = of("analyses").join(deleted, "user_id", "left_anti"), gone
            # the short ids are hashed, so that the wide rows of files are not sorted
            ids = gone.select("analysis_id").hint("shuffle_hash")
            tables["analysis_files"] = of("analysis_files").join(ids, "analysis_id", "left_anti"), gone
        if all(gone.isEmpty() for _, gone in tables.values()):
            continue
        new = snapshots.Batch(batch.name, batch.generation + 1, batch.tables)
        kept = {name: of(name) for name in batch.tables if name not in tables}
        snapshots.write({**kept, **{name: left for name, (left, _) in tables.items()}}, folder, new)
        changed.append(new)
    if changed:
        snapshots.publish(spark, folder, changed)
    return [b.name for b in changed]


def orphans(files: DataFrame, analyses: DataFrame) -> DataFrame:
    """Files whose analysis does not exist."""
    return files.join(analyses.select("analysis_id"), "analysis_id", "left_anti")
