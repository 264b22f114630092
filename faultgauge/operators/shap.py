"""Exact tree SHAP for boosted trees, from a table of leaves.

Each leaf is a value and, for every feature on its path, an interval that a row must fall in and the
share of training rows that did. The contribution of a leaf to a feature is a closed formula in
those, so a batch of rows is explained by a few array operations per path depth.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from math import factorial

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from faultgauge import constants as C

cloudpickle.register_pickle_by_value(sys.modules[__name__])

def tree_nodes(spark: SparkSession, model_path: str) -> DataFrame:
    """The nodes of a saved boosted model, one row each. Grows with the model, not with the data."""
    data = spark.read.parquet(f"{model_path}/data")
    weights = spark.read.parquet(f"{model_path}/treesMetadata")
    tree, _, weight = weights.columns
    weights = weights.select(F.col(tree).alias("treeID"), F.col(weight).alias("weight"))
    node = F.col("nodeData")
    return data.join(weights, "treeID").select(
        F.col("treeID").cast("int").alias("tree"),
        "weight",
        node.id.cast("int").alias("node"),
        node.prediction.alias("prediction"),
        node.rawCount.cast("double").alias("covered"),
        node.gain.alias("gain"),
        node.leftChild.cast("int").alias("left"),
        node.rightChild.cast("int").alias("right"),
        node.split.featureIndex.cast("int").alias("feature"),
        F.try_element_at(node.split.leftCategoriesOrThreshold, F.lit(1)).alias("threshold"),
    )


class Leaves:
    """Leaves of all trees as arrays (leaf, path position): feature, low, high, share; and values.

    A leaf with fewer path features than the longest is filled up with features that never matter:
    share 1 and an interval that holds everything.
    """

    def __init__(self, nodes: pd.DataFrame, n_features: int):
        found = []
        for _, tree in nodes.groupby("tree"):
            by_id = tree.set_index("node").to_dict("index")
            stack = [(0, {})]
            while stack:
                node_id, path = stack.pop()
                node = by_id[node_id]
                if node["left"] < 0:
                    found.append((node["weight"] * node["prediction"], path))
                    continue
                for child, is_left in ((node["left"], True), (node["right"], False)):
                    low, high, share = path.get(node["feature"], (-np.inf, np.inf, 1.0))
                    low, high = (low, min(high, node["threshold"])) if is_left else (max(low, node["threshold"]), high)
                    share *= by_id[child]["covered"] / node["covered"]
                    stack.append((child, {**path, node["feature"]: (low, high, share)}))
        self.n_features = n_features
        self.depth = max([len(p) for _, p in found] + [1])
        self.values = np.array([v for v, _ in found])
        shape = (len(found), self.depth)
        self.feature = np.zeros(shape, dtype=int)
        self.low, self.high, self.share = np.full(shape, -np.inf), np.full(shape, np.inf), np.ones(shape)
        for i, (_, path) in enumerate(found):
            for j, (feature, (low, high, share)) in enumerate(path.items()):
                self.feature[i, j], self.low[i, j], self.high[i, j], self.share[i, j] = feature, low, high, share
        self.base = float((self.values * self.share.prod(axis=1)).sum())

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """(rows, features) contributions to the margin."""
        m = self.depth
        seen = x[:, self.feature]
        inside = ((seen > self.low) & (seen <= self.high)).astype(float)
        weights = [factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)]
        out = np.zeros((len(x), self.n_features))
        for i in range(m):
            # coefficients, by coalition size, of the product over the other path features
            by_size = [np.ones(inside.shape[:2])]
            for j in range(m):
                if j == i:
                    continue
                o, z = inside[:, :, j], self.share[:, j]
                by_size = [
                    (by_size[k] * z if k < len(by_size) else 0) + (by_size[k - 1] * o if k > 0 else 0)
                    for k in range(len(by_size) + 1)
                ]
            others = sum(w * c for w, c in zip(weights, by_size))
            phi = self.values * (inside[:, :, i] - self.share[:, i]) * others
            out += phi @ (self.feature[:, i][:, None] == np.arange(self.n_features)).astype(float)
        return out


def load_leaves(spark: SparkSession, model_path: str, n_features: int = len(C.FEATURES)) -> Leaves:
    """Leaves of a saved model. Its size is trees x 2**depth, fixed by the training parameters."""
    return Leaves(tree_nodes(spark, model_path).toPandas(), n_features)


def tree_shap(rows: DataFrame, leaves: Leaves, names: list[str] | None = None) -> DataFrame:
    """Add ``contributions`` (one number per feature, log-odds) and ``base_value`` to scaled rows."""
    names = names or C.FEATURES
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        # the margin of a boosted classifier counts twice in its log-odds
        for batch in batches:
            x = batch.to_numpy(dtype="float32", na_value=np.nan).astype(float)
            phi = np.concatenate([2 * leaves.contributions(part) for part in _parts(x)]) if len(x) else x
            yield pd.Series(list(phi))

    return rows.withColumn("contributions", explain(F.struct(*names))).withColumn(
        "base_value", F.lit(2 * leaves.base)
    )


def _parts(x: np.ndarray, size: int = 512) -> list[np.ndarray]:
    """Slices small enough for the (rows, leaves) work arrays to stay in the cache."""
    return [x[i : i + size] for i in range(0, len(x), size)]


def factor_list(contributions: Column, names: list[str] | None = None) -> Column:
    """Factors by falling size of contribution; equal sizes keep feature order."""
    names = names or C.FEATURES
    labels = F.array(*[F.lit(n) for n in names])
    keyed = F.transform(
        contributions,
        lambda c, i: F.struct(
            (-F.abs(c)).alias("by_size"),
            i.alias("position"),
            F.element_at(labels, i + 1).alias("feature"),
            c.alias("contribution"),
            F.when(c > 0, "INCREASES_RISK").otherwise("DECREASES_RISK").alias("direction"),
        ),
    )
    return F.transform(
        F.array_sort(keyed), lambda f: F.struct(f["feature"], f["contribution"], f["direction"])
    )


def top_factors(factors: Column, direction: str, k: int = C.TOP_FACTORS) -> Column:
    return F.slice(F.filter(factors, lambda f: f["direction"] == direction), 1, k)


def with_factors(rows: DataFrame) -> DataFrame:
    """Add the factor list and its top raising and lowering parts; empty without contributions."""
    none = F.array().cast("array<struct<feature:string,contribution:double,direction:string>>")
    return (
        rows.withColumn("shap_factors", F.coalesce(factor_list(F.col("contributions")), none))
        .withColumn("top_risk_factors", top_factors(F.col("shap_factors"), "INCREASES_RISK"))
        .withColumn("top_reducing_factors", top_factors(F.col("shap_factors"), "DECREASES_RISK"))
    )


def _shares(means: DataFrame, names: list[str], value: str, share: str) -> DataFrame:
    """One row of means, one column per feature, to rows of (feature, mean, share of the total)."""
    total = sum(F.col(n) for n in names)
    rows = [
        F.struct(
            F.lit(n).alias("feature"),
            F.col(n).alias(value),
            F.coalesce(F.try_divide(F.col(n), total), F.lit(0.0)).alias(share),
        )
        for n in names
    ]
    return means.select(F.inline(F.array(*rows)))


def global_importance(rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Mean absolute contribution per feature, as a share of their total."""
    names = names or C.FEATURES
    means = rows.agg(*[F.avg(F.abs(F.col("contributions")[i])).alias(n) for i, n in enumerate(names)])
    return _shares(means, names, "mean_abs_shap", "shap_share")


def gain_importance(nodes: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Mean gain of each feature's splits, as a share of the total; 0 for features never split on."""
    names = names or C.FEATURES
    gain = lambda i: F.avg(F.when(F.col("feature") == i, F.col("gain")))
    splits = nodes.filter(F.col("left") >= 0)
    means = splits.agg(*[F.coalesce(gain(i), F.lit(0.0)).alias(n) for i, n in enumerate(names)])
    return _shares(means, names, "mean_gain", "gain_share")
