"""Training and model experiments with MLlib, over a frame of (doc_id, label, ten scaled features)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from math import gcd

from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from faultgauge import constants as C
from faultgauge.operators import contract, evaluate, forest
from faultgauge.operators.fits import FitStore, frame_digest
from faultgauge.operators.metrics import file_metrics
from faultgauge.operators.topk import hash_ranks
from faultgauge.session import materialise

KEY, LABEL = "doc_id", "label"
PARTITIONS = 8


def dealt(frame: DataFrame, partitions: int = PARTITIONS) -> DataFrame:
    """The rows in so many partitions, by key and in order, checkpointed: fits draw the same rows from them each time."""
    return materialise(frame.repartition(partitions, KEY).sortWithinPartitions(KEY))


def training_frame(labelled: DataFrame, partitions: int = PARTITIONS) -> DataFrame:
    """Scaled features of labelled files; measured once and checkpointed, since every fit reads them.

    The result is narrow. Every tree level is a job over its ``partitions``: few for a small frame, as many as there
    are cores for one that fills them.
    """
    measured = contract.contract_row(file_metrics(labelled)).filter(F.col("error").isNull())
    return dealt(measured.select(KEY, LABEL, *C.FEATURES), partitions)


def development_folds(frame: DataFrame, partitions: int = PARTITIONS) -> tuple[DataFrame, DataFrame]:
    """The development part cut into folds, and the held-out part; all comparisons and choices use the first alone."""
    parts = materialise(evaluate.stratified_split(frame, KEY, LABEL))
    dev, test = (parts.filter(F.col("part") == p).drop("part") for p in ("dev", "test"))
    return dealt(evaluate.stratified_folds(dev, KEY, LABEL), partitions), test


def model_input(rows: DataFrame, features: list[str]) -> DataFrame:
    """``rows`` with the vector ``features`` that a fit reads; checkpointed, unless they come with it.

    Every level of a tree is a job, and what leads to its rows is sent with each of its tasks.
    """
    if "features" in rows.columns:
        return rows
    return materialise(contract.assemble(rows, features).select(*[c for c in (KEY, LABEL, "fold") if c in rows.columns], "features"))


def with_weights(train: DataFrame, balanced: bool = False, positive: float = 1.0) -> DataFrame:
    """Add ``weight``: n / (2 n_class) when balanced, else ``positive`` for the positive class."""
    if not balanced:
        return train.withColumn("weight", F.when(F.col(LABEL) == 1, float(positive)).otherwise(1.0))
    counts = train.agg(F.count("*").alias("n"), F.sum(LABEL).alias("pos")).first()
    n, pos = counts["n"], counts["pos"] or 0
    weight = F.when(F.col(LABEL) == 1, n / (2.0 * max(pos, 1))).otherwise(n / (2.0 * max(n - pos, 1)))
    return train.withColumn("weight", weight)


class Boosted:
    """Gradient-boosted trees with one configuration. ``key`` names what a fit on given rows depends on.

    ``share`` of the trees are fitted: all of them, unless many configurations are only to be gone through.
    """

    def __init__(self, config: dict, features: list[str] | None = None, share: float = 1.0):
        self.config = {**config, "trees": max(1, round(config["trees"] * share))}
        self.features = features or C.FEATURES
        self.key = ("boosted", *sorted(self.config.items()), *self.features)
        self.jobs = self.config["trees"] * (self.config["depth"] + 1)

    def fit(self, train: DataFrame):
        c = self.config
        estimator = GBTClassifier(
            labelCol=LABEL,
            featuresCol="features",
            weightCol="weight",
            maxIter=c["trees"],
            maxDepth=c["depth"],
            stepSize=c["rate"],
            subsamplingRate=c["rows"],
            featureSubsetStrategy=str(c["cols"]),
            seed=C.SEED,
        )
        model = estimator.fit(with_weights(model_input(train, self.features), positive=c["weight"]))
        return lambda rows: _scored(model, contract.assemble(rows, self.features), margin=True), model


class Forest:
    features = C.FEATURES

    def __init__(self, depth: int = 3, balanced: bool = False, trees: int = 100):
        self.depth, self.balanced, self.trees = depth, balanced, trees
        self.key = ("forest", depth, balanced, trees)

    def fit(self, train: DataFrame):
        estimator = RandomForestClassifier(
            labelCol=LABEL, weightCol="weight", numTrees=self.trees, maxDepth=self.depth, seed=C.SEED
        )
        model = estimator.fit(with_weights(model_input(train, self.features), self.balanced))
        return lambda rows: _scored(model, contract.assemble(rows)), model


class Logistic:
    """Unit-strength L2 penalty, which is 1/n in MLlib's averaged loss; features are not standardised."""

    features = C.FEATURES

    def __init__(self, balanced: bool = False):
        self.balanced = balanced
        self.key = ("logistic", balanced)

    def fit(self, train: DataFrame):
        n = train.count()
        estimator = LogisticRegression(labelCol=LABEL, weightCol="weight", regParam=1.0 / max(n, 1), standardization=False)
        model = estimator.fit(with_weights(model_input(train, self.features), self.balanced))
        return lambda rows: _scored(model, contract.assemble(rows)), model


class Majority:
    """Scores 1 or 0 for the class that most training rows have."""

    key = ("majority",)

    def fit(self, train: DataFrame):
        share = train.agg(F.avg(LABEL)).first()[0] or 0.0
        return lambda rows: rows.withColumn("score", F.lit(1.0 if share > 0.5 else 0.0)), None


class RandomGuess:
    """Scores 1 with the training rate, by an even hash of the row key."""

    key = ("random", C.SEED)

    def fit(self, train: DataFrame):
        share = train.agg(F.avg(LABEL)).first()[0] or 0.0
        return lambda rows: rows.withColumn("score", (uniform(C.SEED, F.col(KEY)) < share).cast("double")), None


def uniform(seed: int, key: Column) -> Column:
    """An even number in [0, 1) that depends on the seed and the key only."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(2.0**32)


def _scored(model, rows: DataFrame, margin: bool = False) -> DataFrame:
    out = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    if margin:
        out = out.withColumn("margin", 2 * vector_to_array("rawPrediction")[1])
    return out.drop("features", "rawPrediction", "probability", "prediction")


def baselines(share: float = 1.0) -> dict[str, object]:
    return {
        "majority": Majority(),
        "random": RandomGuess(),
        "logistic": Logistic(),
        "logistic, balanced": Logistic(balanced=True),
        "forest, depth 3": Forest(3, trees=max(1, round(100 * share))),
        "forest, depth 5": Forest(5, trees=max(1, round(100 * share))),
        "forest, depth 3, balanced": Forest(3, balanced=True, trees=max(1, round(100 * share))),
        "boosted, first configuration": Boosted(C.FIRST_CONFIG, share=share),
    }


def boosted_grid(share: float = 1.0) -> dict[str, Boosted]:
    return {name: Boosted(c, share=share) for name, c in {**C.BOOSTED_CONFIGS, **C.RECORDED_CONFIGS}.items()}


def out_of_fold(folded: DataFrame, models: dict[str, object], store: FitStore, threads: int | None = None) -> DataFrame:
    """Scores of every row by the fit that has not seen it, for each named model; ``margin`` for boosted trees.

    Fits that the store holds are read from it, the others are made and kept, each as soon as it is there. They are
    independent and, on small frames, bound by scheduling; one for each core (eight at least) run side by side, those of
    most jobs first. Models of the same features read the same input, which is made once.
    """
    frame = frame_digest(folded)
    keys = {(name, k): store.key(frame, m.key, k) for name, m in models.items() for k in range(C.N_FOLDS)}
    done = store.done()
    jobs = {key: (models[name], k) for (name, k), key in keys.items() if key not in done}

    threads = threads or max(8, folded.sparkSession.sparkContext.defaultParallelism)
    read = {tuple(m.features): m.features for m, _ in jobs.values() if hasattr(m, "features")}
    inputs = {names: model_input(folded, features) for names, features in read.items()}
    longest_first = sorted(jobs.items(), key=lambda job: -getattr(job[1][0], "jobs", 0))

    def run(job) -> None:
        key, (model, k) = job
        rows = inputs[tuple(model.features)] if hasattr(model, "features") else folded
        apply, _ = model.fit(rows.filter(F.col("fold") != k))
        held_out = apply(folded.filter(F.col("fold") == k))
        margin = F.col("margin") if "margin" in held_out.columns else F.lit(None).cast("double").alias("margin")
        store.keep(key, held_out.select(F.col(KEY).cast("bigint"), F.col(LABEL).cast("int"), "fold", "score", margin))

    with ThreadPoolExecutor(threads) as pool:
        list(pool.map(run, longest_first))
    named = [store.scores([keys[name, k] for k in range(C.N_FOLDS)]).withColumn("model", F.lit(name)) for name in models]
    return reduce(DataFrame.unionByName, named)


def cross_validate(folded: DataFrame, models: dict[str, object], store: FitStore) -> DataFrame:
    """Mean of the seven measures over the folds of ``folded``, per model."""
    by_fold = evaluate.all_measures(out_of_fold(folded, models, store), ["model", "fold"])
    return evaluate.cv_means(by_fold, ["model"])


def at_both_thresholds(scored: DataFrame, best: float) -> DataFrame:
    """Measures at 0.50 and at the threshold that was best out of fold."""
    rows = [
        evaluate.all_measures(scored.withColumn("at", F.lit(name)), ["at"], t).withColumn("threshold", F.lit(float(t)))
        for name, t in (("standard", 0.5), ("best", best))
    ]
    return rows[0].unionByName(rows[1])


def holdout(folded: DataFrame, test: DataFrame, store: FitStore) -> DataFrame:
    """Measures of the final configuration, fitted on the development part, on the held-out part."""
    config = Boosted(C.BOOSTED_CONFIGS[C.FINAL_CONFIG])
    with ThreadPoolExecutor(1) as pool:
        fitted = pool.submit(config.fit, folded)  # beside the fits of the folds
        sweep = evaluate.threshold_sweep(out_of_fold(folded, {"final": config}, store), ["model"])
        best = evaluate.best_threshold(sweep, ["model"]).first()["threshold"]
        apply, _ = fitted.result()
    return at_both_thresholds(materialise(apply(test)), best)


def class_weight_sweep(folded: DataFrame, store: FitStore, share: float = 1.0) -> DataFrame:
    base = C.BOOSTED_CONFIGS["n=80, d=2, lr=0.03, w=1.0"]
    return cross_validate(folded, {f"w={w}": Boosted({**base, "weight": w}, share=share) for w in C.POSITIVE_WEIGHTS}, store)


def feature_ablation(folded: DataFrame, store: FitStore, share: float = 1.0) -> DataFrame:
    base = C.BOOSTED_CONFIGS["n=80, d=2, lr=0.03, w=1.0"]
    return cross_validate(folded, {name: Boosted(base, names, share) for name, names in C.FEATURE_SUBSETS.items()}, store)


def permutations(n: int, count: int) -> list[tuple[int, int]]:
    """``(a, b)`` of ``count`` permutations r -> (a r + b) mod n of 0 .. n - 1; none of them leaves the ranks as they are."""
    out = []
    for i in range(count):
        a = (2 * i + 3) * (n // 7 + 1) % n or 1
        while gcd(a, n) != 1:
            a = a % n + 1
        out.append((a, (C.SEED + 101 * (i + 1)) % n or 1))
    return out


def permutation_importance(frame: DataFrame, model) -> DataFrame:
    """Loss of ROC-AUC when one feature's values are dealt out anew, per feature. ``model`` is a saved model or a forest.

    Rows are ranked once by a seeded hash. The value of each feature goes to the row whose rank a keyed permutation
    of ranks gives; a row and the ten values that arrive at it meet in one shuffle.
    """
    whole = frame.withColumn("_all", F.lit(0))
    ranked = materialise(hash_ranks(whole.select("_all", KEY, LABEL, *C.FEATURES), "_all", KEY, C.SEED).drop("_all"))
    n = ranked.count()
    own = F.struct((F.col("rank") - 1).alias("at"), F.lit(-1).alias("which"), F.lit(None).cast("double").alias("value"))
    sent = [
        F.struct((((F.col("rank") - 1) * a + b) % n).alias("at"), F.lit(i).alias("which"), F.col(f).cast("double").alias("value")) for i, (f, (a, b)) in enumerate(zip(C.FEATURES, permutations(max(n, 1), len(C.FEATURES))))
    ]
    row = F.struct(LABEL, *C.FEATURES)
    messages = ranked.select(row.alias("_row"), F.inline(F.array(own, *sent))).withColumn("_row", F.when(F.col("which") < 0, F.col("_row")))
    arrived = messages.groupBy("at").agg(
        F.max(F.when(F.col("which") < 0, F.col("_row"))).alias("row"),
        *[F.max(F.when(F.col("which") == i, F.col("value"))).alias(f"_{f}") for i, f in enumerate(C.FEATURES)],
    )
    # the row as it is, and once for each feature with the value that arrived in its place
    variants = F.array(*[
        F.struct(F.lit(name).alias("feature"), F.col(f"row.{LABEL}").alias(LABEL),
                 *[(F.col(f"_{f}") if f == name else F.col(f"row.{f}")).alias(f) for f in C.FEATURES])
        for name in ("none", *C.FEATURES)
    ])
    every = arrived.select(F.inline(variants))
    scored = model.transform(every).withColumnRenamed("probability", "score") if isinstance(model, forest.Forest) else _scored(model, contract.assemble(every))
    measured = evaluate.ranking_measures(scored, ["feature"])
    # one row per feature and one for the intact rows
    intact = F.max(F.when(F.col("feature") == "none", F.col("roc_auc"))).over(Window.partitionBy())
    return (
        measured.withColumn("intact_auc", intact)
        .filter(F.col("feature") != "none")
        .select("feature", "intact_auc", "roc_auc", (F.col("intact_auc") - F.col("roc_auc")).alias("importance"))
    )


def platt_calibration(scores: DataFrame) -> DataFrame:
    """Brier score before and after a logistic fit of the label on the out-of-fold margin.

    A row is calibrated by the fit over the other folds; slope and intercept are their means.
    """
    rows = VectorAssembler(inputCols=["margin"], outputCol="features").transform(scores)
    parts = []
    for k in range(C.N_FOLDS):
        model = LogisticRegression(labelCol=LABEL, featuresCol="features").fit(rows.filter(F.col("fold") != k))
        after = model.transform(rows.filter(F.col("fold") == k)).withColumn("calibrated", vector_to_array("probability")[1])
        parts.append(after.withColumns({"slope": F.lit(float(model.coefficients[0])), "intercept": F.lit(float(model.intercept))}))
    before_gap, after_gap = F.col("score") - F.col(LABEL), F.col("calibrated") - F.col(LABEL)
    return reduce(DataFrame.unionByName, parts).agg(
        F.count("*").alias("rows"),
        F.avg(before_gap * before_gap).alias("brier_before"),
        F.avg(after_gap * after_gap).alias("brier_after"),
        F.avg("slope").alias("slope"),
        F.avg("intercept").alias("intercept"),
    )
