"""Roll-ups of stored analyses: repository, directory, language, history and report tables.

Files are always summed per analysis before anything is joined to them, so a large analysis is
reduced inside the map tasks and joins run one row to one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultgauge import constants as C
from faultgauge.functions import paths
from faultgauge.functions.rounding import clamp01, mean, percent, round_half_up
from faultgauge.operators.scoring import risk_tier
from faultgauge.operators.topk import rank_rows, top_k
from faultgauge.sources.repos import FILE_KEYS, with_author


def by_risk(path: str = "file_path") -> list[Column]:
    return [F.col("risk_score").desc(), F.col(path).asc()]


def newest_first() -> list[Column]:
    return [F.col("created_at").desc(), F.col("analysis_id").asc()]


def repository_risk(files: DataFrame, repo: str = "repo") -> DataFrame:
    """Mean score of a repository's files and its tier."""
    risk = files.groupBy(repo).agg(F.count("*").alias("files"), clamp01(mean(F.col("risk_score"))).alias("overall_risk"))
    return risk.withColumn("risk_level", risk_tier(F.col("overall_risk")))


def file_sums(files: DataFrame) -> DataFrame:
    """Everything the cards, history and report need from an analysis's files, in one pass."""
    level = F.col("risk_level")
    return files.groupBy("analysis_id").agg(
        F.count("*").alias("file_count"),
        F.count_if(level == "HIGH").alias("high_count"),
        F.count_if(level == "MEDIUM").alias("medium_count"),
        F.count_if(level == "LOW").alias("low_count"),
        F.sum(F.coalesce(F.col("metrics.loc"), F.lit(0))).alias("total_loc"),
        mean(F.coalesce(F.col("metrics.cyclomatic_complexity"), F.lit(1.0))).alias("avg_complexity"),
    )


def with_file_sums(analyses: DataFrame, files: DataFrame) -> DataFrame:
    """Analyses with their file sums; an analysis without files counts zero, with complexity 1."""
    zero = ["file_count", "high_count", "medium_count", "low_count", "total_loc"]
    return (
        analyses.join(file_sums(files), "analysis_id", "left")
        .fillna(0, zero)
        .fillna(1.0, ["avg_complexity"])
    )


def tier_counts(analyses: DataFrame, files: DataFrame) -> DataFrame:
    return with_file_sums(analyses, files).select(
        "analysis_id", "file_count", "high_count", "medium_count", "low_count"
    )


def band(x: Column) -> Column:
    return F.when(x >= 70, "good").when(x >= 40, "fair").otherwise("poor")


def scorecard(analyses: DataFrame, files: DataFrame) -> DataFrame:
    """Health, architecture, debt and complexity of each analysis, with their bands."""
    health = percent(1 - F.col("overall_risk"))
    architecture = F.greatest(F.lit(0), round_half_up(100 - (F.col("avg_complexity") - 1) * 4))
    debt = F.col("total_loc") * F.col("avg_complexity")
    complexity = F.col("avg_complexity")
    return with_file_sums(analyses, files).select(
        "analysis_id",
        "file_count",
        "total_loc",
        "avg_complexity",
        health.alias("health"),
        band(health).alias("health_band"),
        architecture.alias("architecture"),
        band(architecture).alias("architecture_band"),
        F.when(debt > 50000, "High").when(debt > 15000, "Moderate").otherwise("Low").alias("technical_debt"),
        F.when(complexity > 10, "poor").when(complexity > 5, "fair").otherwise("good").alias("complexity_band"),
    )


def language_mix(files: DataFrame) -> DataFrame:
    """The five most frequent languages of each analysis, with their share of its files.

    Files are read and summed once; the total is that of an analysis's counts, one for each language.
    """
    counts = files.groupBy("analysis_id", paths.display_language(F.col("file_path")).alias("language")).agg(
        F.count("*").alias("files")
    )
    totals = counts.withColumn("total", F.sum("files").over(Window.partitionBy("analysis_id")))
    top = top_k(totals, ["analysis_id"], [F.col("files").desc(), F.col("language").asc()], C.TOP_LANGUAGES)
    return top.select("analysis_id", "rank", "language", "files", percent(F.col("files") / F.col("total")).alias("share_pct"))


def hot_directories(files: DataFrame) -> DataFrame:
    """The four directories of highest mean risk in each analysis."""
    means = files.groupBy("analysis_id", paths.directory(F.col("file_path")).alias("directory")).agg(
        F.count("*").alias("files"), mean(F.col("risk_score")).alias("avg_risk")
    )
    return top_k(means, ["analysis_id"], [F.col("avg_risk").desc(), F.col("directory").asc()], C.TOP_DIRECTORIES)


def churn_counts(commits: DataFrame, key: list[str] = FILE_KEYS) -> DataFrame:
    """Commits and distinct authors per file, at least 1 each. Summed per author first; no author is nobody."""
    per_author = with_author(commits).groupBy(*key, "author").agg(F.count("*").alias("_n"))
    return per_author.groupBy(*key).agg(
        F.greatest(F.lit(1).cast("bigint"), F.sum("_n")).alias("commit_count"),
        F.greatest(F.lit(1).cast("bigint"), F.count("author")).alias("contributor_count"),
    )


def churn_enrich(ranked: DataFrame, commits: DataFrame, top: int | None = None, key: list[str] = FILE_KEYS) -> DataFrame:
    """Add churn to every file, at least 1 and 1; with ``top``, to the riskiest files of each repository alone.

    Commits are reduced to one row per file before the join.
    """
    joined = ranked.join(churn_counts(commits, key), key, "left")
    one = F.lit(1).cast("bigint")
    chosen = F.lit(True) if top is None else F.col("rank") <= top
    return joined.withColumns(
        {c: F.when(chosen, F.coalesce(F.col(c), one)).otherwise(one) for c in ("commit_count", "contributor_count")}
    )


def latest_analyses(analyses: DataFrame, k: int = C.LATEST_ANALYSES) -> DataFrame:
    return top_k(analyses, ["user_id"], newest_first(), k)


def dashboard_totals(analyses: DataFrame) -> DataFrame:
    """Scans, high-risk scans and mean risk over each user's latest ten analyses."""
    return latest_analyses(analyses).groupBy("user_id").agg(
        F.count("*").alias("total_scans"),
        F.count_if(F.col("risk_level") == "HIGH").alias("critical_risks"),
        mean(F.col("overall_risk")).alias("avg_risk"),
    )


def health_buckets(analyses: DataFrame) -> DataFrame:
    level = F.col("risk_level")
    counts = latest_analyses(analyses).groupBy("user_id").agg(
        F.count("*").alias("n"),
        F.count_if(level == "HIGH").alias("at_risk"),
        F.count_if(level == "MEDIUM").alias("monitor"),
    )

    def line(bucket: str, value: Column) -> Column:
        return F.struct(F.lit(bucket).alias("bucket"), value.alias("analyses"))

    return counts.select(
        "user_id",
        F.inline(
            F.array(
                line("Healthy", F.col("n") - F.col("at_risk") - F.col("monitor")),
                line("Monitor", F.col("monitor")),
                line("At Risk", F.col("at_risk")),
            )
        ),
    )


def risk_by_component(analyses: DataFrame) -> DataFrame:
    return latest_analyses(analyses, C.CHART_ANALYSES).select(
        "user_id", "rank", "analysis_id",
        paths.short_name(F.col("repository_name")).alias("name"),
        percent(F.col("overall_risk")).alias("risk_pct"),
    )


def recent_risky_files(analyses: DataFrame, files: DataFrame) -> DataFrame:
    """Each user's five riskiest files over the latest ten analyses.

    The join takes the files of a large analysis as the side that can be split at run time.
    """
    latest = latest_analyses(analyses).select("analysis_id", "user_id", "repository_name")
    joined = files.select("analysis_id", "file_path", "risk_score", "risk_level").join(latest, "analysis_id")
    order = [F.col("risk_score").desc(), F.col("analysis_id").asc(), F.col("file_path").asc()]
    return top_k(joined, ["user_id"], order, C.RECENT_RISKY_FILES)


def history(analyses: DataFrame, files: DataFrame) -> DataFrame:
    """Every analysis of every user, newest first, with tier counts."""
    placed = rank_rows(analyses, ["user_id"], newest_first(), "position")
    counts = file_sums(files).select("analysis_id", "high_count", "medium_count", "low_count")
    return (
        placed.join(counts, "analysis_id", "left")
        .fillna(0, ["high_count", "medium_count", "low_count"])
        .withColumn("risk_pct", percent(F.col("overall_risk")))
    )


def rank_by_risk(files: DataFrame, group: str = "analysis_id", path: str = "file_path") -> DataFrame:
    return rank_rows(files, [group], by_risk(path))


def analysis_with_files(analyses: DataFrame, files: DataFrame) -> DataFrame:
    """Analyses with their files, one row per file; one row with nulls where there is none.

    Written as an inner join, in which Spark may split the files of a large analysis, plus the
    analyses without files: an outer join could not be split on that side.
    """
    matched = files.join(analyses, "analysis_id")
    bare = analyses.join(files.select("analysis_id").distinct(), "analysis_id", "left_anti")
    return matched.unionByName(bare, allowMissingColumns=True)


def analysis_nested(analyses: DataFrame, files: DataFrame, k: int = C.MAX_FILES_PER_REPO) -> DataFrame:
    """Analyses with ``files``, their ``k`` riskiest files as a list in that order, and ``file_count`` of all of them.

    The list is what a page shows, so it has a bound; ``analysis_with_files`` has every file, in rows. An analysis
    without files has an empty list.
    """
    others = [c for c in files.columns if c != "analysis_id"]
    best = top_k(files, ["analysis_id"], by_risk(), k).groupBy("analysis_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", F.struct(*others).alias("file")))), lambda x: x["file"]).alias("files")
    )
    counts = files.groupBy("analysis_id").agg(F.count("*").alias("file_count"))
    joined = analyses.join(best, "analysis_id", "left").join(counts, "analysis_id", "left")
    nothing = F.array().cast(best.schema["files"].dataType)
    return joined.withColumns({"files": F.coalesce("files", nothing), "file_count": F.coalesce("file_count", F.lit(0).cast("bigint"))})


def report_summary(analyses: DataFrame, files: DataFrame) -> DataFrame:
    """Five rows of metric, value and status for each analysis."""
    health = percent(1 - F.col("overall_risk"))
    health_status = F.when(health >= 70, "Healthy").when(health >= 40, "Moderate").otherwise("At Risk")

    def line(metric: str, value: Column, status: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), value.cast("bigint").alias("value"), status.alias("status"))

    return with_file_sums(analyses, files).select(
        "analysis_id",
        F.inline(
            F.array(
                line("Overall Risk Score", percent(F.col("overall_risk")), F.col("risk_level")),
                line("Project Health", health, health_status),
                line("High Risk Files", F.col("high_count"), F.lit("Requires Attention")),
                line("Medium Risk Files", F.col("medium_count"), F.lit("Monitor")),
                line("Low Risk Files", F.col("low_count"), F.lit("Stable")),
            )
        ),
    )


def _or_default(text: Column, default: str) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", default).otherwise(text)


def report_fix_first(files: DataFrame) -> DataFrame:
    """The HIGH files with their texts, or the standing sentences where there is none."""
    return files.filter(F.col("risk_level") == "HIGH").select(
        "analysis_id", "file_path",
        percent(F.col("risk_score")).alias("risk_pct"),
        _or_default(F.col("ai_explanation"), C.NO_EXPLANATION).alias("why"),
        _or_default(F.col("test_suggestions"), C.NO_ACTION).alias("action"),
    )


def action_texts(files: DataFrame) -> DataFrame:
    """What the detail view says about a file: its explanation and action, or that it is healthy."""
    explained = F.coalesce(F.col("ai_explanation"), F.lit("")) != ""
    return files.select(
        "analysis_id", "file_path",
        F.when(explained, F.col("ai_explanation")).otherwise(C.HEALTHY_FILE).alias("why"),
        F.when(explained, _or_default(F.col("test_suggestions"), C.REVIEW_NEXT_SPRINT)).alias("action"),
    )


def report_all_files(files: DataFrame) -> DataFrame:
    """The technical table: a loc or commit count of 0 and one that is missing both read as 0."""
    return files.select(
        "analysis_id", "file_path", "risk_level",
        percent(F.col("risk_score")).alias("risk_pct"),
        F.coalesce(F.col("metrics.loc"), F.lit(0)).cast("bigint").alias("loc"),
        F.coalesce(round_half_up(F.col("metrics.cyclomatic_complexity") * 10) / 10, F.lit(0.0)).alias("complexity"),
        F.coalesce(F.col("metrics.commit_count"), F.lit(0)).cast("bigint").alias("commits"),
    )
