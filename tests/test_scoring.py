"""Addresses, languages, the feature contract, tiers, advice and texts."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultgauge import constants as C
from faultgauge.functions import paths
from faultgauge.functions.rounding import percent, round_half_even, tenths_text
from faultgauge.operators import contract, scoring, shap
from faultgauge.sources.repos import parse_repo_url, scan_checkout


def test_addresses(spark):
    cases = [
        ("https://github.com/ann/tools", "ann", "tools"),
        ("http://github.com/ann/tools.git", "ann", "tools"),
        ("ann/my.tools", "ann", "my.tools"),
        ("github.com/Ann-2/Tools_", "Ann-2", "Tools_"),
        ("  https://github.com/a/b/tree/main?x=1#y ", "a", "b"),
        ("onlyaname", None, None),
        ("", None, None),
    ]
    got = parse_repo_url(spark.createDataFrame([(c[0],) for c in cases], "url string")).collect()
    for row, (_, owner, repo) in zip(got, cases):
        assert (row.owner, row.repo, row.error is None) == (owner, repo, owner is not None)


def test_languages(spark):
    cases = {
        "a/job.py": "python", "ui/Row.tsx": "typescript_react", "ui/list.js": "javascript", "A.java": "java",
        "cmd/main.go": "go", "lib/sort.cpp": "cpp", "Api/Keys.cs": "csharp", "page.php": "php", "rake.rb": "ruby",
        "notes.txt": "generic", "dir.py/.js": "generic",
        "a/..py": "generic", ".x.PY": "python", "noext": "generic",
    }
    frame = spark.createDataFrame([(p,) for p in cases], "path string")
    got = {r[0]: r[1] for r in frame.select("path", paths.language(F.col("path"))).collect()}
    assert got == cases


METRICS = ["loc", "cyclomatic_complexity", "length", "volume", "difficulty", "int_fan_in", "int_fan_out",
           "num_operators", "num_operands", "branch_count"]
RAW = {
    1: dict(zip(METRICS, (75, 4, 90, 610, 7, 1, 3, 41, 49, 5))),
    2: dict(loc=33, cyclomatic_complexity=2),
    3: dict(zip(METRICS, (61, math.nan, 150, 700, 9, 1, 2, 70, 80, 3))),
    4: dict(zip(METRICS, (61, math.inf, 150, 700, 9, 1, 2, 70, 80, 3))),
    5: dict(zip(METRICS, (999, 19, 2400, 17000, 61, 5, 11, 700, 1700, 21))),
}


def test_contract(spark):
    rows = [(k, {m: float(v) for m, v in raw.items()}) for k, raw in RAW.items()]
    frame = contract.alias_features(spark.createDataFrame(rows, "id int, metrics map<string,double>"))
    errors = {r["id"]: r["error"] for r in contract.validate(frame).collect()}
    assert errors[1] is None and errors[5] is None
    assert "Missing required features: ['LENGTH', 'VOLUME'" in errors[2]
    assert "'CYCLO' is NaN" in errors[3] and "'CYCLO' is Infinity" in errors[4]
    scaled = {r["id"]: r for r in contract.scale_features(frame.filter("id in (1, 5)")).collect()}
    assert all(0 <= scaled[i][f] <= 1 for i in (1, 5) for f in C.FEATURES)
    assert scaled[5]["NUM_OPERANDS"] == 1.0 and scaled[1]["LOC"] == pytest.approx(0.05)


def test_assembled_order(spark):
    row = spark.createDataFrame([[float(i) / 10 for i in range(10)]], C.FEATURES)
    vector = contract.assemble(row).first()["features"].toArray()
    assert list(vector) == [float(np.float32(i / 10)) for i in range(10)]


def test_tiers_and_rounding(spark):
    frame = spark.createDataFrame([(x,) for x in (0.0, 0.39999, 0.4, 0.69999, 0.7, 1.0)], "x double")
    assert [r[0] for r in frame.select(scoring.risk_tier(F.col("x"))).collect()] == [
        "LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH"]
    numbers = [0.05, 0.15, 0.25, 0.35, 0.45, 2.25, 8.25, 8.75, 1.0, 30.04999, 12.95, 99.95, 1234.55, 0.0]
    numbers += [k / 20 for k in range(1, 400, 2)]
    frame = spark.createDataFrame([(x,) for x in numbers], "x double").coalesce(1)
    assert [r[0] for r in frame.select(tenths_text(F.col("x"))).collect()] == [f"{x:.1f}" for x in numbers]
    halves = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "x double").coalesce(1)
    got = halves.select(round_half_even(F.col("x")), percent(F.col("x") / 100)).collect()
    assert [tuple(r) for r in got] == [(0, 1), (2, 2), (2, 3), (0, 0)]


def test_explanation(spark):
    factor = "array<struct<feature string, contribution double, direction string>>"
    frame = spark.createDataFrame(
        [("lib/plan.go", 0.615, [("LOC", 0.4, "INCREASES_RISK"), ("BRANCH_COUNT", 0.1, "INCREASES_RISK")],
          ["Split it", "Test it"])],
        f"path string, score double, factors {factor}, advice array<string>",
    )
    why = scoring.why_text(F.col("path"), F.col("score"), F.col("factors"), F.lit(512), F.lit(9.0), F.lit(31.0), F.lit(800.0))
    row = frame.select(why.alias("why"), scoring.suggestion_text(F.col("path"), F.col("advice")).alias("s")).first()
    assert "plan.go a 62% defect risk score" in row.why
    assert "file size (512 lines), and a high branch count (31 paths). " in row.why
    assert row.s == "Split it; Test it"


def test_advice_is_cut_to_three(spark):
    row = spark.range(1).select(scoring.recommendations(*[F.lit(float(v)) for v in (16, 401, 21, 31, 16)])).first()[0]
    assert len(row) == 3 and row[2].startswith("Implement branch-coverage")
    row = spark.range(1).select(scoring.recommendations(*[F.lit(float(v)) for v in (8, 200, 20, 30, 15)])).first()[0]
    assert row == [C.DEFAULT_RECOMMENDATION]


def _random_nodes(seed: int, trees: int = 6, depth: int = 4) -> pd.DataFrame:
    rng, rows = np.random.default_rng(seed), []
    for tree in range(trees):
        count = itertools.count()

        def grow(level: int, covered: float) -> int:
            me = next(count)
            row = dict(tree=tree, weight=float(rng.uniform(0.1, 1)), node=me, prediction=float(rng.normal()),
                       covered=covered, left=-1, right=-1, feature=-1, threshold=0.0)
            rows.append(row)
            if level < depth and rng.uniform() < 0.85:
                left = float(int(covered * rng.uniform(0.2, 0.8)))
                row.update(feature=int(rng.integers(0, 5)), threshold=float(rng.uniform()))
                row["left"], row["right"] = grow(level + 1, left), grow(level + 1, covered - left)
            return me

        grow(0, 1000.0)
        weight = rows[-1]["weight"]
        for r in rows:
            if r["tree"] == tree:
                r["weight"] = weight
    return pd.DataFrame(rows)


def _expected_value(nodes: pd.DataFrame, x: np.ndarray, known: frozenset) -> float:
    """Value of a coalition: follow known features, average over both branches otherwise."""
    total = 0.0
    for _, tree in nodes.groupby("tree"):
        by_id = tree.set_index("node").to_dict("index")

        def value(i: int) -> float:
            n = by_id[i]
            if n["left"] < 0:
                return n["prediction"]
            if n["feature"] in known:
                return value(n["left"] if x[n["feature"]] <= n["threshold"] else n["right"])
            share = by_id[n["left"]]["covered"] / n["covered"]
            return share * value(n["left"]) + (1 - share) * value(n["right"])

        total += by_id[0]["weight"] * value(0)
    return total


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_contributions_equal_brute_force(seed):
    nodes, m = _random_nodes(seed), 5
    leaves = shap.Leaves(nodes, m)
    x = np.random.default_rng(seed + 50).uniform(size=(4, m))
    phi = leaves.contributions(x)
    for row, got in zip(x, phi):
        values = {s: _expected_value(nodes, row, s)
                  for k in range(m + 1) for s in map(frozenset, itertools.combinations(range(m), k))}
        for i in range(m):
            rest = [s for s in values if i not in s]
            want = sum(math.factorial(len(s)) * math.factorial(m - len(s) - 1) / math.factorial(m)
                       * (values[s | {i}] - values[s]) for s in rest)
            assert got[i] == pytest.approx(want, abs=1e-12)
        assert got.sum() + leaves.base == pytest.approx(values[frozenset(range(m))], abs=1e-12)
        assert leaves.base == pytest.approx(values[frozenset()], abs=1e-12)


def test_scan_checkout(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "b.js").write_text("let é = 2")
    got = {(r.repo, r.path, r.content) for r in scan_checkout(spark, str(tmp_path), "o/r").collect()}
    assert got == {("o/r", "src/a.py", "x = 1\n"), ("o/r", "b.js", "let é = 2")}
