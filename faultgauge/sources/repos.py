"""Reading repositories: addresses, listings, contents and commits."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultgauge import constants as C
from faultgauge.functions import paths

TREE_SCHEMA = "repo string, path string, size bigint"


def parse_repo_url(requests: DataFrame, url: str = "url") -> DataFrame:
    """Add ``owner`` and ``repo``, or ``error`` for an address that has not both, or is not there."""
    parts = F.col("_parts")
    ok = F.coalesce(F.size(parts) >= 2, F.lit(False))
    return (
        requests.withColumn("_parts", paths.repository_parts(F.col(url)))
        .withColumn("owner", F.when(ok, F.get(parts, F.lit(0))))
        .withColumn("repo", F.when(ok, F.regexp_replace(F.get(parts, F.lit(1)), r"\.git\z", "")))
        .withColumn("error", F.when(~ok, F.concat(F.lit("Invalid repository address: "), F.coalesce(F.col(url), F.lit("")))))
        .drop("_parts")
    )


def scan_tree(spark: SparkSession, path: str) -> DataFrame:
    """File listings exported as JSON lines."""
    return spark.read.schema(TREE_SCHEMA).json(path)


def _checkout_files(spark: SparkSession, folders: dict[str, str], glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(list(folders.values()))
    # the file's address without its scheme; a root is cut off as a prefix, the longest one that fits
    place = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    repo, inner = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, folder in sorted(folders.items(), key=lambda x: len(x[1])):
        root = "/" + re.sub("^[a-z0-9]+:", "", folder).strip("/") + "/"
        fits = place.startswith(root)
        repo, inner = F.when(fits, name).otherwise(repo), F.when(fits, F.substr(place, F.lit(len(root) + 1))).otherwise(inner)
    return files.withColumns({"repo": repo, "inner": inner})


def checkout_listing(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """All files of checked-out source trees with their sizes, from the listing alone: no file is opened."""
    files = _checkout_files(spark, folders)
    return files.select("repo", F.col("inner").alias("path"), F.col("length").alias("size"))


def scan_checkouts(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """Supported files of checked-out source trees with their text: ``folders`` is repository -> root folder.

    Names reach the file source, so files that are not supported are neither opened nor listed as splits.
    """
    either = lambda c: f"[{c}{c.upper()}]" if c.isalpha() else c
    endings = ",".join("".join(map(either, e)) for e in C.SUPPORTED_EXTENSIONS)
    files = _checkout_files(spark, folders, f"*.{{{endings}}}")
    return files.select(
        "repo", F.col("inner").alias("path"), F.col("length").alias("size"), F.make_valid_utf8(F.col("content").cast("string")).alias("content")
    )


def scan_checkout(spark: SparkSession, folder: str, repo: str) -> DataFrame:
    return scan_checkouts(spark, {repo: folder})


def content_with_fallback(listing: DataFrame, primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """Content from the first place that has it, else an empty text. Keys are unique on every side."""
    first = primary.select(*keys, F.col("content").alias("_first"))
    second = fallback.select(*keys, F.col("content").alias("_second"))
    return (
        listing.join(first, keys, "left")
        .join(second, keys, "left")
        .withColumn("content", F.coalesce("_first", "_second", F.lit("")))
        .drop("_first", "_second")
    )


FILE_KEYS = ["repo", "path"]


def with_author(commits: DataFrame) -> DataFrame:
    """Add ``author``, the email in the nested ``commit``.

    An author without an email is ``unknown``; a commit without an author has none.
    """
    return commits.withColumn("author", F.when(F.col("commit.author").isNotNull(), F.coalesce("commit.author.email", F.lit("unknown"))))


def commit_scan(listing: DataFrame, commits: DataFrame, key: list[str] = FILE_KEYS) -> DataFrame:
    """All commits of the listed files; a file without any keeps one row with nulls.

    Paths of different repositories are different files.

    As in the roll-ups, the many side is joined so that Spark may split a much-changed file.
    """
    matched = commits.join(listing, key)
    bare = listing.join(commits.select(*key).distinct(), key, "left_anti")
    return matched.unionByName(bare, allowMissingColumns=True)
