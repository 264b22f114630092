"""Row filters and repository outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultgauge import constants as C
from faultgauge.functions import lexical, paths


def supported_files(files: DataFrame) -> DataFrame:
    return files.filter(paths.is_supported(F.col("path")))


def non_blank(files: DataFrame) -> DataFrame:
    return files.filter(~lexical.is_blank(F.col("content")))


def elevated(files: DataFrame) -> DataFrame:
    return files.filter(F.col("risk_level").isin("HIGH", "MEDIUM"))


def drop_dirty(rows: DataFrame) -> DataFrame:
    """A ``?`` stands for a missing value; rows with any missing value are dropped."""
    return rows.replace("?", None).dropna("any")


def repository_status(files: DataFrame, repo: str = "repo") -> DataFrame:
    """Why a repository yields no result: no supported file, or only blank ones."""
    supported = paths.is_supported(F.col("path"))
    readable = supported & ~lexical.is_blank(F.col("content"))
    counts = files.groupBy(repo).agg(
        F.count_if(supported).alias("supported_files"), F.count_if(readable).alias("readable_files")
    )
    return counts.withColumn(
        "status",
        F.when(F.col("supported_files") == 0, C.NO_SUPPORTED_FILES)
        .when(F.col("readable_files") == 0, C.ALL_FILES_EMPTY)
        .otherwise("ok"),
    )
