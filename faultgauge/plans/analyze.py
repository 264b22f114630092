"""The whole analysis of many repositories: listing to ranked, explained files and repository risk."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, functions as F

from faultgauge import constants as C
from faultgauge.functions.lexical import is_blank
from faultgauge.operators import contract, filters, rollup, scoring, shap
from faultgauge.operators.forest import Forest
from faultgauge.operators.metrics import file_metrics
from faultgauge.operators.topk import top_k
from faultgauge.session import materialise
from faultgauge.sources.repos import FILE_KEYS

Model = GBTClassificationModel | Forest | None
#: Scaling bounds by feature, as ``contract.bounds_of`` reads them from a written schema; None for the defaults.
Limits = dict[str, tuple[float, float]] | None


def select_files(files: DataFrame, repo: str = "repo", k: int = C.MAX_FILES_PER_REPO) -> DataFrame:
    """The k largest supported files of each repository. Blank files still take a place."""
    order = [F.coalesce(F.col("size"), F.lit(0)).desc(), F.col("path").asc()]
    return top_k(filters.supported_files(files), [repo], order, k, "size_rank")


def predict(files: DataFrame, model: Model, leaves: shap.Leaves | None, limits: Limits = None) -> DataFrame:
    """Metrics, contract, score, factors and recommendations of every file with content."""
    return predict_metrics(file_metrics(files), model, leaves, limits)


def predict_metrics(metrics: DataFrame, model: Model, leaves: shap.Leaves | None, limits: Limits = None) -> DataFrame:
    """The same from measured files."""
    return _predicted(contract.contract_row(metrics, limits), model, leaves)


def predict_maps(rows: DataFrame, model: Model, leaves: shap.Leaves | None, limits: Limits = None, metrics: str = "metrics") -> DataFrame:
    """The same from a given map of metrics in each row, under any accepted spelling."""
    return _predicted(contract.contract_of_map(rows, metrics, limits), model, leaves)


def _predicted(features: DataFrame, model: Model, leaves: shap.Leaves | None) -> DataFrame:
    """Score, factors and recommendations. A row that fails the contract gets the neutral result."""
    rows = features if isinstance(model, Forest) else contract.assemble(features)
    rows = scoring.score(rows, model).drop("features")
    ok = F.col("error").isNull()
    score = F.when(ok, F.col("risk_score")).otherwise(C.DEFAULT_SCORE)
    rows = rows.withColumn("risk_score", score).withColumn("risk_level", scoring.risk_tier(F.col("risk_score")))
    if leaves is None:
        rows = rows.withColumns({"contributions": F.lit(None).cast("array<double>"), "base_value": F.lit(0.0)})
    else:
        rows = shap.tree_shap(rows, leaves).withColumn("contributions", F.when(ok, F.col("contributions")))
    failed = F.array(F.lit(C.CONTRACT_FAILURE_RECOMMENDATION))
    return shap.with_factors(rows).withColumn(
        "recommendations", F.when(ok, scoring.metric_recommendations()).otherwise(failed)
    )


def rank_files(predicted: DataFrame) -> DataFrame:
    """Add ``rank``: files of a repository by falling risk. Only keys and scores are sorted."""
    place = rollup.rank_by_risk(predicted.select(*FILE_KEYS, "risk_score"), "repo", "path")
    return predicted.join(place.select(*FILE_KEYS, "rank"), FILE_KEYS)


def explain(ranked: DataFrame, top: int | None = None) -> DataFrame:
    """Texts for files of elevated risk, with ``top`` for the riskiest of each repository alone; else empty."""
    told = F.col("risk_level").isin("HIGH", "MEDIUM")
    if top is not None:
        told = told & (F.col("rank") <= top)
    why = scoring.why_text(
        F.col("path"), F.col("risk_score"), F.col("top_risk_factors"), F.col("raw.loc"),
        F.col("raw.cyclomatic_complexity"), F.col("raw.branch_count"), F.col("raw.volume"),
    )
    return ranked.withColumns(
        {
            "ai_explanation": F.when(told, why).otherwise(""),
            "test_suggestions": F.when(
                told, scoring.suggestion_text(F.col("path"), F.col("recommendations"))
            ).otherwise(""),
        }
    )


def payload(rows: DataFrame) -> DataFrame:
    """Pack metrics, churn and factor lists into ``metrics``; working columns go."""
    packed = F.struct("raw.*", "commit_count", "contributor_count", "top_risk_factors", "top_reducing_factors")
    return rows.withColumn("metrics", packed).select(
        "repo", "path", "rank", "risk_score", "risk_level", "metrics", "ai_explanation", "test_suggestions"
    )


def analyze(
    files: DataFrame, commits: DataFrame, model: Model, leaves: shap.Leaves | None,
    max_files: int | None = None, churn_top: int | None = None, explain_top: int | None = None, limits: Limits = None,
) -> DataFrame:
    """``files(repo, path, size, content)`` and ``commits(repo, path, commit)`` to one ranked row per file.

    All supported files that are not blank are measured, straight from the scan; texts are in no shuffle.
    ``max_files`` keeps the largest files of each repository, which are picked from the listing alone;
    ``churn_top`` and ``explain_top`` keep churn and texts to the riskiest. A path is unique in its repository.
    """
    chosen = filters.supported_files(files)
    if max_files is not None:
        largest = select_files(files.select(*FILE_KEYS, "size"), k=max_files)
        chosen = chosen.join(largest.select(*FILE_KEYS), FILE_KEYS, "left_semi")
    # written once: both the ranks and the result read it
    predicted = materialise(predict(chosen.filter(~is_blank(F.col("content"))), model, leaves, limits))
    enriched = rollup.churn_enrich(rank_files(predicted), commits, churn_top)
    return payload(explain(enriched, explain_top))
