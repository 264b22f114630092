"""Ranks, running sums, splits and measures, also where one group holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultgauge.operators import evaluate
from faultgauge.operators.topk import hash_ranks, rank_rows, running_sums, top_k


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 6000
    group = np.where(rng.uniform(size=n) < 0.6, 0, rng.integers(1, 40, n))
    frame = pd.DataFrame(dict(id=np.arange(n), g=group, x=rng.integers(0, 25, n) / 25))
    frame["label"] = (rng.uniform(size=n) < frame.x).astype(int)
    return frame


def test_ranks(spark, skewed):
    rows = spark.createDataFrame(skewed)
    got = rank_rows(rows, ["g"], [F.col("x").desc(), F.col("id").asc()]).toPandas().sort_values("id")
    want = skewed.sort_values(["x", "id"], ascending=[False, True]).groupby("g").cumcount().sort_index() + 1
    assert (got["rank"].to_numpy() == want.to_numpy()).all()


def test_ranks_without_group(spark, skewed):
    got = rank_rows(spark.createDataFrame(skewed), [], [F.col("id").asc()]).toPandas()
    assert (got["rank"] == got["id"] + 1).all()


def test_running_sums(spark, skewed):
    rows = spark.createDataFrame(skewed)
    got = running_sums(rows, ["g"], [F.col("id").asc()], {"s": F.col("label")}).toPandas().sort_values("id")
    assert (got["s"].to_numpy() == skewed.groupby("g")["label"].cumsum().to_numpy()).all()


def test_top_k_is_cut_before_the_shuffle(spark, skewed):
    top = top_k(spark.createDataFrame(skewed), ["g"], [F.col("x").desc(), F.col("id").asc()], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    want = skewed.sort_values(["x", "id"], ascending=[False, True]).groupby("g").head(3)
    assert {r.id for r in top.collect()} == set(want.id)


def test_hash_ranks_split_and_folds(spark, skewed):
    rows = spark.createDataFrame(skewed)
    ranked = hash_ranks(rows, "label", "id", 42).toPandas()
    for _, part in ranked.groupby("label"):
        assert sorted(part["rank"]) == list(range(1, len(part) + 1))
    split = evaluate.stratified_split(rows).toPandas()
    assert len(split) == len(skewed) and split["id"].is_unique
    share = split[split.part == "test"].groupby("label").size() / split.groupby("label").size()
    assert share.between(0.199, 0.201).all()
    folds = evaluate.stratified_folds(rows).toPandas()
    assert len(folds) == len(skewed) and set(folds.fold) == set(range(5))
    sizes = folds.groupby(["label", "fold"]).size().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1)).max() <= 1


def test_measures_against_brute_force(spark, skewed):
    rows = spark.createDataFrame(skewed).withColumnRenamed("x", "score")
    got = evaluate.all_measures(rows, ["g"]).toPandas().set_index("g")
    assert len(got) == skewed.g.nunique()
    for g, part in skewed.groupby("g"):
        pos, neg = part[part.label == 1].x.to_numpy(), part[part.label == 0].x.to_numpy()
        if len(pos) and len(neg):
            wins = (pos[:, None] > neg[None, :]).mean() + (pos[:, None] == neg[None, :]).mean() / 2
            assert got.roc_auc[g] == pytest.approx(wins, abs=1e-12)
            ap, last = 0.0, 0.0
            for t in sorted(part.x.unique(), reverse=True):
                above = part[part.x >= t]
                recall = above.label.sum() / len(pos)
                ap, last = ap + (recall - last) * above.label.mean(), recall
            assert got.pr_auc[g] == pytest.approx(ap, abs=1e-12)
        assert got.brier[g] == pytest.approx(((part.x - part.label) ** 2).mean())
        assert got.loc[g, ["tn", "fp", "fn", "tp"]].sum() == len(part)


def test_one_class_and_empty_predictions(spark):
    rows = spark.createDataFrame([("a", 0.1, 0), ("a", 0.2, 0), ("b", 0.3, 1)], "m string, score double, label int")
    got = {r["m"]: r for r in evaluate.all_measures(rows, ["m"]).collect()}
    assert (got["a"].roc_auc, got["a"].pr_auc, got["a"].precision, got["a"].f1) == (0.5, 0.0, 0.0, 0.0)
    assert got["b"].recall == 0.0


def test_best_threshold_takes_the_first_of_equals(spark):
    rows = spark.createDataFrame([("a", 0.9, 1), ("a", 0.05, 0)], "m string, score double, label int")
    best = evaluate.best_threshold(evaluate.threshold_sweep(rows, ["m"]), ["m"]).first()
    assert best["threshold"] == 0.15 and best["f1"] == 1.0


def test_median_of_even_and_odd_counts(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 5.0), (4.0, 5.0), (9.0, None)], "a double, b double")
    got = {r["feature"]: r["median"] for r in evaluate.feature_stats(rows, ["a", "b"]).collect()}
    assert got == {"a": 3.0, "b": 5.0}


def test_rows_without_a_group_are_kept(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), (3, 3)], "g int, id int")
    got = {r["id"]: r["rank"] for r in rank_rows(rows, ["g"], [F.col("id").asc()]).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    assert hash_ranks(rows, "g", "id", 1).count() == 3


@pytest.mark.parametrize("kind", ["string", "double", "nulls"])
def test_running_sums_where_a_group_covers_several_ranges(spark, kind):
    rng = np.random.default_rng(8)
    n = 3000
    frame = pd.DataFrame(dict(id=np.arange(n), g=np.where(rng.uniform(size=n) < 0.8, 3, rng.integers(0, 6, n)), v=rng.integers(-5, 9, n)))
    rows = spark.createDataFrame(frame).repartition(5)
    g = F.col("g").cast("string" if kind == "string" else "double")
    if kind == "nulls":
        g = F.when(F.col("g") != 3, F.col("g"))  # the hot group is the one without a key
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = running_sums(rows.withColumn("g", g), ["g"], [F.col("id").asc()], {"s": F.col("v"), "r": F.lit(1)}).toPandas().sort_values("id")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert (got["s"].to_numpy() == frame.groupby("g")["v"].cumsum().to_numpy()).all()
    assert (got["r"].to_numpy() == frame.groupby("g").cumcount().to_numpy() + 1).all()


def test_running_sums_of_nothing(spark):
    rows = spark.createDataFrame([], "g string, id int")
    assert rank_rows(rows, ["g"], [F.col("id").asc()]).collect() == []


def test_rows_are_shuffled_once_for_running_sums(spark, skewed):
    rows = running_sums(spark.createDataFrame(skewed), ["g"], [F.col("id").asc()], {"s": F.col("label")})
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "Window" not in plan


def test_medians(spark):
    rng = np.random.default_rng(9)
    for n in (1, 2, 3, 10, 4001):
        frame = pd.DataFrame(dict(
            a=rng.normal(size=n), b=rng.integers(0, 3, n).astype(float), c=np.full(n, 2.5), d=rng.pareto(0.3, n), e=rng.integers(-5, 5, n)))
        frame.loc[rng.uniform(size=n) < 0.3, "a"] = None
        rows = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "a double, b double, c double, d double, e long").repartition(3)
        got = evaluate.feature_stats(rows, list("abcde"), accuracy=50).toPandas().set_index("feature")
        for name in frame:
            values = frame[name].dropna()
            if len(values):
                assert got.loc[name, "median"] == pytest.approx(values.median(), abs=0) and got.loc[name, "max"] == values.max()
            else:
                assert name not in got.index
    assert evaluate.feature_stats(rows.filter("false"), list("abcde")).collect() == []


def test_a_bracket_that_misses_the_median_is_widened(spark, monkeypatch):
    rows = spark.createDataFrame([(float(i),) for i in range(101)], "a double")
    real = F.percentile_approx
    monkeypatch.setattr(evaluate.F, "percentile_approx", lambda c, p, a: real(c, [0.9, 0.95], a))
    assert evaluate.feature_stats(rows, ["a"]).first()["median"] == 50.0


def test_permutation_deals_out_every_value_once(spark):
    from math import gcd

    from faultgauge.operators import train

    for n in (1, 2, 3, 7, 8, 30, 399, 1000):
        pairs = train.permutations(n, 10)
        assert all(gcd(a, n) == 1 for a, _ in pairs)
        for a, b in pairs:
            assert sorted((a * r + b) % n for r in range(n)) == list(range(n))
