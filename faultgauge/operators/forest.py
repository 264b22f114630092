"""A forest as a table: one row per node, written and read like any other artefact, and scored without a Python worker.

``tree, weight, node, prediction, covered, gain, left, right, feature, threshold``; node 0 is a tree's root, and a leaf
has no children (-1). A row goes left where its value is at most the threshold. The score is the logistic of twice the
weighted sum of the leaves that a row reaches, as for MLlib's boosted trees, whose saved nodes have the same shape.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from faultgauge import constants as C
from faultgauge.operators import shap

NODE_SCHEMA = (
    "tree int, weight double, node int, prediction double, covered double, gain double, left int, right int, "
    "feature int, threshold double"
)


@dataclass
class Forest:
    """Nodes on the driver: trees x 2**depth of them, fixed by the training parameters and not by the data."""

    nodes: list[Row]

    @classmethod
    def of(cls, table: DataFrame) -> Forest:
        return cls(table.select(*[name.split()[0] for name in NODE_SCHEMA.split(", ")]).orderBy("tree", "node").collect())

    def leaves(self) -> shap.Leaves:
        """What contributions are computed from."""
        import pandas as pd

        return shap.Leaves(pd.DataFrame([n.asDict() for n in self.nodes]), len(C.FEATURES))

    def depth(self) -> int:
        inner = {(n["tree"], n["node"]): (n["left"], n["right"]) for n in self.nodes if n["left"] >= 0}
        levels, found = 0, [(tree, 0) for tree in {n["tree"] for n in self.nodes}]
        while found := [(tree, child) for tree, node in found if (tree, node) in inner for child in inner[tree, node]]:
            levels += 1
        return levels

    def raw(self, values: Column) -> Column:
        """Weighted sum of the leaves that an array of feature values reaches.

        All nodes form arrays, which are constants of the plan; a row goes down each tree by index.
        """
        at = {(n["tree"], n["node"]): i for i, n in enumerate(self.nodes)}
        roots = sorted(i for (_, node), i in at.items() if node == 0)
        if not roots:
            return F.lit(0.0)
        constant = lambda numbers: F.lit(list(numbers))
        goes_to = lambda side: constant(at[n["tree"], n[side]] if n[side] >= 0 else i for i, n in enumerate(self.nodes))
        left, right = goes_to("left"), goes_to("right")
        # a leaf leads to itself, whatever the value it is compared with
        feature = constant(max(n["feature"] if n["feature"] is not None else 0, 0) for n in self.nodes)
        threshold = constant(float(n["threshold"] if n["threshold"] is not None else 0.0) for n in self.nodes)
        gives = constant(float(n["weight"] * n["prediction"]) for n in self.nodes)

        def down(node: Column) -> Column:
            return F.when(F.get(values, F.get(feature, node)) <= F.get(threshold, node), F.get(left, node)).otherwise(F.get(right, node))

        steps = F.array(*[F.lit(0)] * self.depth())
        reached = lambda root: F.aggregate(steps, root, lambda node, _: down(node)) if self.depth() else root
        return F.aggregate(constant(roots), F.lit(0.0), lambda total, root: total + F.get(gives, reached(root)))

    def transform(self, rows: DataFrame) -> DataFrame:
        """Add ``margin`` (log-odds) and ``probability`` to rows with scaled features; values count at float precision."""
        values = F.array(*[F.coalesce(F.col(f), F.lit(0.0)).cast("float").cast("double") for f in C.FEATURES])
        margin = 2 * self.raw(F.col("_values"))
        scored = rows.withColumn("_values", values).withColumn("margin", margin).drop("_values")
        return scored.withColumn("probability", 1 / (1 + F.exp(-F.col("margin"))))


def write(nodes: DataFrame, path: str) -> None:
    nodes.coalesce(1).write.mode("overwrite").parquet(path)  # the size of a model


def load(spark: SparkSession, path: str) -> Forest | None:
    """The written forest, or None where there is none: scoring then stays neutral."""
    try:
        return Forest.of(spark.read.schema(NODE_SCHEMA).parquet(path))
    except AnalysisException as problem:
        print(f"forest at {path} not loaded: {type(problem).__name__}")
        return None
