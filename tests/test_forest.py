"""Forests as tables against MLlib and row-by-row descents; contracts of maps against entry-by-entry checks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from faultgauge import constants as C
from faultgauge.operators import contract, forest, scoring, shap
from faultgauge.plans import analyze, models
from faultgauge.sources import fixtures

SF = "/root/testdata/sf0.001"


def test_a_trained_model_scores_the_same_as_a_table(spark, tmp_path):
    frame = models.training_data(spark, SF)
    model, leaves = models.model_and_leaves(spark, SF)
    forest.write(shap.tree_nodes(spark, models.model_path(spark, SF)), str(tmp_path / "nodes"))
    table = forest.load(spark, str(tmp_path / "nodes"))
    from faultgauge.operators.contract import assemble

    want = {r.doc_id: (r.risk_score, r.margin) for r in scoring.score(assemble(frame), model).collect()}
    got = {r.doc_id: (r.risk_score, r.margin) for r in scoring.score(frame, table).collect()}
    assert len(set(want.values())) > 5 and set(got) == set(want)
    for key, pair in want.items():
        assert got[key] == pytest.approx(pair, abs=1e-12)
    explained = shap.tree_shap(scoring.score(frame, table), table.leaves()).collect()
    assert all(sum(r.contributions) + r.base_value == pytest.approx(r.margin, abs=1e-9) for r in explained)


def test_descent_row_by_row(spark):
    nodes = fixtures.forest_nodes(spark, SF)
    model = forest.Forest.of(nodes)
    by_tree = {}
    for n in nodes.collect():
        by_tree.setdefault(n.tree, {})[n.node] = n
    assert len(by_tree) == 25 and model.depth() == 2
    rnd = random.Random(1)
    rows = [(i, *[rnd.choice([0.0, k / 64, rnd.random()]) for k in range(10)]) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id int, " + ", ".join(f"{f} double" for f in C.FEATURES))
    single = {r.doc_id: r for r in frame.select("doc_id", *[F.col(f).cast("float").cast("double").alias(f) for f in C.FEATURES]).collect()}
    for r in model.transform(frame).collect():
        total = 0.0
        for tree in by_tree.values():
            n = tree[0]
            while n.left >= 0:
                n = tree[n.left if single[r.doc_id][C.FEATURES[n.feature]] <= n.threshold else n.right]
            total += n.weight * n.prediction
        assert r.margin == 2 * total and r.probability == pytest.approx(1 / (1 + math.exp(-2 * total)))


def test_no_forest_and_a_forest_of_one_leaf(spark, tmp_path):
    assert forest.load(spark, str(tmp_path / "absent")) is None
    frame = spark.createDataFrame([(1, *[0.5] * 10), (2, *[None] * 10)], "doc_id int, " + ", ".join(f"{f} double" for f in C.FEATURES))
    leaf = spark.createDataFrame([(0, 1.0, 0, 0.25, 4.0, -1.0, -1, -1, -1, 0.0)], forest.NODE_SCHEMA)
    assert {r.margin for r in forest.Forest.of(leaf).transform(frame).collect()} == {0.5}
    assert {r.margin for r in forest.Forest([]).transform(frame).collect()} == {0.0}


def test_scoring_needs_no_python_worker(spark):
    frame = spark.createDataFrame([(1, *[0.5] * 10)], "doc_id int, " + ", ".join(f"{f} double" for f in C.FEATURES))
    model = forest.Forest.of(fixtures.forest_nodes(spark, SF))
    plan = scoring.score(frame, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- contracts of maps ------------------------------------------------------------------------------

SPELLINGS = {a: f for f, names in C.FEATURE_ALIASES.items() for a in names}


def checked(entries):
    """The first bad entry, else the names without a value."""
    values = {}
    for key, value in entries:
        if key not in SPELLINGS:
            continue
        name = SPELLINGS[key]
        try:
            number = float(value)
        except (TypeError, ValueError):
            return f"Feature '{name}' has non-numeric value: {value}", None
        if math.isnan(number):
            return f"Feature '{name}' is NaN. Invalid numeric input.", None
        if math.isinf(number):
            return f"Feature '{name}' is Infinity. Invalid numeric input.", None
        values[name] = number
    missing = [f for f in C.FEATURES if f not in values]
    return (C.MISSING_FEATURES_PREFIX + str(missing), None) if missing else (None, values)


def test_entries_in_order_of_arrival(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(300):
        keys = [rnd.choice(names) for names in C.FEATURE_ALIASES.values()]
        keys += rnd.sample([k for k in [*SPELLINGS, "unknown", "Loc", ""] if k not in keys], rnd.randint(0, 6))
        rnd.shuffle(keys)
        if rnd.random() < 0.2:
            keys.pop()
        bad = ["NaN", "nan", "inf", "-Infinity", "abc", "", "12d", "1.5F", None, "0x10", "1 2"]
        rows.append((i, [(k, rnd.choice(bad) if rnd.random() < 0.04 else rnd.choice(["7", " 8.5 ", "1e2", "-3", "+4", ".5"])) for k in keys]))
    frame = spark.createDataFrame(rows, "id int, entries array<struct<key: string, value: string>>")
    maps = frame.select("id", F.map_from_entries("entries").alias("metrics"))
    got = {r.id: r for r in contract.contract_of_map(maps).collect()}
    errors = 0
    for i, entries in rows:
        error, values = checked(entries)
        errors += error is not None
        assert got[i].error == error, entries
        for f in C.FEATURES:
            low, high, _ = C.SCALING_BOUNDS[f]
            want = None if values is None else min(1.0, max(0.0, (values[f] - low) / (high - low)))
            assert got[i][f] == want
    assert 50 < errors < 290


def test_maps_of_numbers_empty_and_null_maps(spark):
    good = {k: 100.0 for k in C.METRIC_OF_FEATURE.values()}
    rows = [(1, good), (2, {}), (3, None), (4, {**good, "cyclo": float("nan")}), (5, {**good, "LOC": 9.0, "loc": 450.0})]
    out = {r.id: r for r in analyze.predict_maps(spark.createDataFrame(rows, "id int, metrics map<string,double>"), None, None).collect()}
    assert out[1].error is None and out[1].risk_score == 0.5
    for i in (2, 3):
        assert out[i].error.startswith(C.MISSING_FEATURES_PREFIX) and out[i].recommendations == [C.CONTRACT_FAILURE_RECOMMENDATION]
    assert "CYCLO" in out[4].error and out[4].risk_level == "MEDIUM" and out[4].shap_factors == []
    assert any("450 lines" in text for text in out[5].recommendations)


def test_bounds_of_a_written_schema(spark, tmp_path):
    path = str(tmp_path / "schema")
    rows = [("LOC", 0.0, 10.0), ("LOC", 5.0, 20.0), ("other", 0.0, 1.0)]
    spark.createDataFrame(rows, "name string, bound_min double, bound_max double").write.json(path)
    limits = contract.bounds_of(contract.feature_bounds(spark, path))
    assert limits["LOC"] == (0.0, 20.0) and limits["CYCLO"] == (1.0, 25.0) and len(limits) == 10
    frame = spark.createDataFrame([(1, {k: 5.0 for k in C.METRIC_OF_FEATURE.values()})], "id int, metrics map<string,double>")
    row = contract.contract_of_map(frame, limits=limits).first()
    assert row.LOC == 0.25 and row.CYCLO == pytest.approx(4 / 24)
