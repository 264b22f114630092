"""One job from requested addresses to stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultgauge import constants as C
from faultgauge.operators import filters, rollup, shap
from faultgauge.plans import analyze
from faultgauge.session import materialise
from faultgauge.sources import repos, stored


def repository_results(requests: DataFrame, files: DataFrame, analysed: DataFrame) -> DataFrame:
    """Outcome of every ``requests(analysis_id, user_id, url)``: name, mean risk, tier and files, or an error.

    Errors are an address without owner and name, a repository without supported files (also one that is not
    listed), and one whose supported files are all blank. ``files`` and ``analysed`` are named ``owner/name``.
    """
    named = repos.parse_repo_url(requests).withColumn("repository_name", F.concat_ws("/", "owner", "repo")).drop("owner", "repo")
    status = filters.repository_status(files).select(F.col("repo").alias("repository_name"), "status")
    risk = rollup.repository_risk(analysed).withColumnRenamed("repo", "repository_name")
    joined = named.join(status, "repository_name", "left").join(risk, "repository_name", "left")
    found = F.coalesce("status", F.lit(C.NO_SUPPORTED_FILES))
    error = F.coalesce("error", F.when(found != "ok", found))
    return joined.select(
        "analysis_id", "user_id", "url", F.when(F.col("error").isNull(), F.col("repository_name")).alias("repository_name"),
        "overall_risk", "risk_level", F.coalesce("files", F.lit(0).cast("bigint")).alias("files"), error.alias("error"),
    )


def analyze_and_store(
    requests: DataFrame, files: DataFrame, commits: DataFrame, model: analyze.Model, leaves: shap.Leaves | None, folder: str,
    batch: str | None = None, **limits,
) -> str:
    """Analyse the requested repositories and store what comes of it as one batch of ``folder``; returns its name.

    ``requests(analysis_id, user_id, url)``; ``files`` and ``commits`` as in ``analyze.analyze``, with ``owner/name`` as
    repository; ``limits`` go there too. A repository that several requests name is analysed once. Three tables become
    visible together: ``requests`` (all outcomes), ``analyses`` and ``analysis_files`` of those without an error.
    """
    wanted = repos.parse_repo_url(requests).filter(F.col("error").isNull()).select(F.concat_ws("/", "owner", "repo").alias("repo")).distinct()
    asked = files.join(wanted, "repo", "left_semi")
    # read by the roll-up and by the stored files
    analysed = materialise(analyze.analyze(asked, commits, model, leaves, **limits))
    results = materialise(repository_results(requests, asked, analysed))
    good = results.filter(F.col("error").isNull()).drop("error")
    children = analysed.join(good.select("analysis_id", F.col("repository_name").alias("repo")), "repo").drop("repo")
    return stored.persist(
        good.withColumnRenamed("files", "file_count"), children.withColumnRenamed("path", "file_path"), folder, batch, {"requests": results}
    )
