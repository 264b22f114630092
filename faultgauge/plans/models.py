"""Models for queries: trained on the labelled files of a data set and kept for the session."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession

from faultgauge import constants as C
from faultgauge.operators import forest, shap, train
from faultgauge.operators.fits import FitStore
from faultgauge.session import kept_folder, new_path
from faultgauge.sources import artifacts, fixtures

#: Labelled rows in a partition of the training frame, which are narrow; each tree level is a task for every partition.
ROWS_PER_PARTITION = 50_000

_frames: dict[tuple[str, str], DataFrame] = {}
_paths: dict[tuple[str, str], str] = {}
_parts: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def partitions(spark: SparkSession, sf_dir: str) -> int:
    """Of the training frame: as many as its rows ask for, so that no task grows with the table."""
    return -(-fixtures.table(spark, sf_dir, "labels").count() // ROWS_PER_PARTITION) or 1


def training_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _frames:
        _frames[key] = train.training_frame(fixtures.labelled_files(spark, sf_dir), partitions(spark, sf_dir))
    return _frames[key]


def development(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The development part of the training frame in folds, and the held-out part."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _parts:
        _parts[key] = train.development_folds(training_data(spark, sf_dir), partitions(spark, sf_dir))
    return _parts[key]


def store(spark: SparkSession) -> FitStore:
    """The fits that queries, and sessions under the same shared folder, have in common."""
    return FitStore(spark, kept_folder(spark, "fits"))


def model_path(spark: SparkSession, sf_dir: str) -> str:
    """Path of the saved model, the final configuration fitted on the development part."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _paths:
        _, model = train.Boosted(C.BOOSTED_CONFIGS[C.FINAL_CONFIG]).fit(development(spark, sf_dir)[0])
        path = new_path(spark, "model")
        model.save(path)
        _paths[key] = path
    return _paths[key]


def model_and_leaves(spark: SparkSession, sf_dir: str) -> tuple[GBTClassificationModel, shap.Leaves]:
    path = model_path(spark, sf_dir)
    return artifacts.load_model(path), shap.load_leaves(spark, path)


def given_forest(spark: SparkSession, sf_dir: str) -> tuple[forest.Forest, shap.Leaves]:
    """A published forest, as a deployment has it: written as a table and loaded again."""
    path = new_path(spark, "forest")
    forest.write(fixtures.forest_nodes(spark, sf_dir), path)
    loaded = forest.load(spark, path)
    return loaded, loaded.leaves()
