"""Splits and measures of scored, labelled rows, for any number of groups (models, folds) at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultgauge import constants as C
from faultgauge.operators.topk import hash_ranks, running_sums
from faultgauge.session import materialise

THRESHOLDS = [C.SWEEP_START + k * C.SWEEP_STEP for k in range(C.SWEEP_COUNT)]


def stratified_split(rows: DataFrame, key: str = "id", label: str = "label", seed: int = C.SEED) -> DataFrame:
    """Add ``part``: the first 20% of each label in a seeded hash order are the test rows."""
    ranked = hash_ranks(rows, label, key, seed)
    test_rows = F.floor(F.col("group_rows") * C.TEST_SHARE + 0.5)
    return ranked.withColumn("part", F.when(F.col("rank") <= test_rows, "test").otherwise("dev")).drop(
        "rank", "group_rows"
    )


def stratified_folds(
    rows: DataFrame, key: str = "id", label: str = "label", seed: int = C.SEED, folds: int = C.N_FOLDS
) -> DataFrame:
    """Add ``fold``: rows of each label dealt out in a seeded hash order."""
    return (
        hash_ranks(rows, label, key, seed + 1)
        .withColumn("fold", ((F.col("rank") - 1) % folds).cast("int"))
        .drop("rank", "group_rows")
    )


def ratio(part: Column, whole: Column) -> Column:
    """0 where undefined."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _outcomes(threshold: float | Column) -> list[Column]:
    predicted, actual = F.col("score") >= threshold, F.col("label") == 1
    return [
        F.count_if(~predicted & ~actual).alias("tn"),
        F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"),
        F.count_if(predicted & actual).alias("tp"),
    ]


def _brier() -> Column:
    gap = F.col("score") - F.col("label")
    return F.avg(gap * gap).alias("brier")


def confusion(rows: DataFrame, by: list[str], threshold: float | Column = 0.5) -> DataFrame:
    return rows.groupBy(*by).agg(*_outcomes(threshold))


def rates(counts: DataFrame) -> DataFrame:
    """Add accuracy, precision, recall and F1 to confusion counts."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.withColumns(
        {
            "accuracy": ratio(tp + tn, tn + fp + fn + tp),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
        }
    )


def threshold_sweep(rows: DataFrame, by: list[str]) -> DataFrame:
    """Confusion and rates at every threshold.

    Each row is counted once, under the number of thresholds it reaches; those at most 26 counts per
    group are then added up per threshold. Rows are neither copied nor read again per threshold.
    """
    reached = sum((F.col("score") >= t).cast("int") for t in THRESHOLDS)
    steps = rows.groupBy(*by, reached.alias("reached")).agg(
        F.count("*").alias("n"), F.sum(F.col("label").cast("bigint")).alias("pos")
    )
    marks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(THRESHOLDS)])
    over = F.col("reached") > F.col("mark.i")
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    counts = (
        steps.withColumn("mark", F.explode(marks))
        .groupBy(*by, F.col("mark.threshold").alias("threshold"))
        .agg(
            F.sum(F.when(over, 0).otherwise(neg)).alias("tn"),
            F.sum(F.when(over, neg).otherwise(0)).alias("fp"),
            F.sum(F.when(over, 0).otherwise(pos)).alias("fn"),
            F.sum(F.when(over, pos).otherwise(0)).alias("tp"),
        )
    )
    return rates(counts)


def best_threshold(sweep: DataFrame, by: list[str]) -> DataFrame:
    """Highest F1; the lowest threshold where several reach it. 25 rows per group come in."""
    best = F.max_by(F.struct("threshold", "f1"), F.struct(F.round("f1", 12), -F.col("threshold")))
    return sweep.groupBy(*by).agg(best.alias("_best")).select(*by, "_best.threshold", "_best.f1")


def ranking_measures(rows: DataFrame, by: list[str]) -> DataFrame:
    """ROC-AUC with ties averaged, and average precision over distinct scores.

    Rows are first summed per distinct score; running sums over the scores are then taken across
    range partitions, so that no group has to fit in one task. With one class only, 0.5 and 0.
    """
    label = F.col("label").cast("bigint")
    levels = rows.groupBy(*by, "score").agg(F.sum(label).alias("pos"), F.sum(1 - label).alias("neg"))
    summed = running_sums(
        levels, by, [F.col("score").desc()], {"pos_above": F.col("pos"), "neg_above": F.col("neg")}
    )
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    sums = summed.groupBy(*by).agg(
        F.sum(pos).alias("p"),
        F.sum(neg).alias("n"),
        F.sum(pos * (F.col("neg_above") - neg / 2)).alias("lost"),
        F.sum(pos * F.col("pos_above") / (F.col("pos_above") + F.col("neg_above"))).alias("precision_sum"),
    )
    p, n = F.col("p"), F.col("n")
    both = (p > 0) & (n > 0)
    return sums.select(
        *by,
        F.when(both, 1 - F.col("lost") / (p * n)).otherwise(0.5).alias("roc_auc"),
        F.when(both, F.col("precision_sum") / p).otherwise(0.0).alias("pr_auc"),
    )


def brier(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(_brier())


def all_measures(rows: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """The seven measures per group. Both parts have one row per group when they are joined."""
    counted = rows.groupBy(*by).agg(*_outcomes(threshold), _brier())
    out = rates(counted).join(ranking_measures(rows, by), by)
    return out.select(*by, "tn", "fp", "fn", "tp", "accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "brier")


def cv_means(fold_measures: DataFrame, by: list[str]) -> DataFrame:
    names = ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "brier"]
    return fold_measures.groupBy(*by).agg(*[F.avg(n).alias(n) for n in names])


def calibration_bins(rows: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    which = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    return rows.groupBy(*by, which.alias("bin")).agg(
        F.count("*").alias("n"), F.avg("score").alias("mean_predicted"), F.avg("label").alias("observed_rate")
    )


def class_distribution(rows: DataFrame, label: str = "label") -> DataFrame:
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))  # one row per class
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(label, "n", (F.col("n") / total * 100).alias("pct"))


def feature_stats(rows: DataFrame, names: list[str], accuracy: int = 1_000) -> DataFrame:
    """Minimum, maximum, mean, sample deviation and exact median of each column, nulls left out.

    One scan takes the moments and, from a sketch, a bracket that the median lies in. A second one counts what lies
    below the bracket and sums equal values inside it, about three in ``accuracy`` rows; only those are ranked. A
    bracket that missed the median (the counts tell) is widened to the whole range. A column of nulls has no row.
    """
    spark = rows.sparkSession
    margin = 1.5 / accuracy
    found = rows.agg(*[
        f.alias(f"{n}.{s}") for n in names for s, f in (
            ("min", F.min(n)), ("max", F.max(n)), ("mean", F.avg(n)), ("std", F.stddev_samp(n)), ("total", F.count(n)),
            ("bracket", F.percentile_approx(n, [0.5 - margin, 0.5 + margin], accuracy)),
        )
    ]).first()
    names = [n for n in names if found[f"{n}.total"]]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def medians(brackets: dict[str, tuple]) -> dict[str, float | None]:
        """The median of each column, None where its bracket missed it."""
        if not brackets:
            return {}
        inside = {n: F.when(F.col(n).between(F.lit(low).cast(types[n]), F.lit(high).cast(types[n])), F.col(n)) for n, (low, high) in brackets.items()}
        below = [F.count_if(F.col(n) < F.lit(low).cast(types[n])).alias(f"{n}.below") for n, (low, _) in brackets.items()]
        # rows with no value in any bracket, nearly all, fall into one group
        summed = materialise(rows.groupBy(*[c.alias(n) for n, c in inside.items()]).agg(F.count("*").alias("_n"), *below))
        levels = summed.select("_n", F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").cast("double").alias("value")) for n in brackets])))
        levels = levels.filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.sum("_n").alias("n"))
        ranked = running_sums(levels, ["feature"], [F.col("value")], {"up_to": F.col("n")})
        under = summed.agg(*[F.sum(f"`{n}.below`").alias(n) for n in brackets]).first()
        # the middle rows, counted from the bracket's first
        middle = {n: ((found[f"{n}.total"] + 1) // 2 - under[n], (found[f"{n}.total"] + 2) // 2 - under[n]) for n in brackets}
        low, high = (F.create_map(*[F.lit(x) for n, m in middle.items() for x in (n, m[side])])[F.col("feature")] for side in (0, 1))
        up_to, first = F.col("up_to"), F.col("up_to") - F.col("n")
        holds = ranked.groupBy("feature").agg(
            F.max(F.when((first < low) & (up_to >= low), F.col("value"))).alias("low"), F.max(F.when((first < high) & (up_to >= high), F.col("value"))).alias("high")
        ).collect()
        return {r["feature"]: (r["low"] + r["high"]) / 2 for r in holds if r["low"] is not None and r["high"] is not None}

    exact = medians({n: found[f"{n}.bracket"] for n in names})
    exact |= medians({n: (found[f"{n}.min"], found[f"{n}.max"]) for n in names if n not in exact})
    lines = [(n, *[None if (x := found[f"{n}.{s}"]) is None else float(x) for s in ("min", "max", "mean", "std")], exact.get(n)) for n in names]
    return spark.createDataFrame(lines, "feature string, min double, max double, mean double, std double, median double")
