"""Every query with SQL equals it on the smallest tables; the others hold their properties."""

import os
import shutil
import sys

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as spark_entry  # noqa: E402
from faultgauge import constants as C  # noqa: E402
from faultgauge.operators import train  # noqa: E402
from faultgauge.operators.fits import FitStore  # noqa: E402
from faultgauge.plans import catalog  # noqa: E402
from faultgauge.sources import artifacts  # noqa: E402
from tools.check_sql import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = spark_entry.queries(), spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    result = compare(QUERIES[name](spark, SF).toArrow(), duck.sql(ORACLE[name]).to_arrow_table())
    assert result.startswith("ok") and "types" not in result, result


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_contributions_add_up_to_the_margin(spark):
    rows = QUERIES["tree_shap"](spark, SF).collect()
    assert rows and all(r.adds_up for r in rows)
    assert any(abs(r[f]) > 0 for r in rows for f in C.FEATURES)


def test_model_survives_saving_and_its_absence_is_neutral(spark):
    rows = QUERIES["model_roundtrip"](spark, SF).collect()
    assert all(r.same_score for r in rows) and {r.default_score for r in rows} == {0.5}


def test_flagship(spark):
    rows = spark_entry.entry(spark).collect()
    assert rows
    by_repo = {}
    for r in rows:
        by_repo.setdefault(r.repo, []).append(r)
        assert r.risk_level == ("HIGH" if r.risk_score >= 0.7 else "MEDIUM" if r.risk_score >= 0.4 else "LOW")
        assert bool(r.ai_explanation) == (r.risk_level != "LOW")
    for files in by_repo.values():
        files.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in files] == list(range(1, len(files) + 1))
        assert all(a.risk_score >= b.risk_score for a, b in zip(files, files[1:]))


def test_importances_are_shares(spark):
    for name, column in (("shap_global", "shap_share"), ("gain_importance", "gain_share")):
        rows = QUERIES[name](spark, SF).collect()
        assert len(rows) == 10 and sum(r[column] for r in rows) == pytest.approx(1.0)


def test_fits_see_the_development_part_alone(spark):
    folded, test = catalog.models.development(spark, SF)
    dev_ids, test_ids = ({r.doc_id for r in part.collect()} for part in (folded, test))
    assert len(dev_ids) == 70 and len(test_ids) == 17 and not dev_ids & test_ids
    rows = QUERIES["oof_scores"](spark, SF).collect()
    assert {r.doc_id for r in rows} == dev_ids and len(rows) == 70
    assert {r.fold for r in rows} == set(range(5)) and all(r.scored for r in rows)


class Counted:
    """A model that tells how often it was fitted."""

    def __init__(self, name):
        self.key, self.fits = (name,), 0

    def fit(self, rows):
        self.fits += 1
        return lambda held_out: held_out.withColumn("score", F.lit(0.25)), None


def test_fits_are_made_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 2, i % 5) for i in range(20)], "doc_id long, label int, fold int")
    folded = rows.repartition(1)
    first, again, other = Counted("m"), Counted("m"), Counted("n")
    scores = train.out_of_fold(folded, {"a": first}, FitStore(spark, str(tmp_path)))
    assert first.fits == 5 and scores.count() == 20 and {r.model for r in scores.collect()} == {"a"}
    # under another name, in another order of the rows, by another store of the same folder
    shuffled = rows.orderBy("label").repartition(1)
    scores = train.out_of_fold(shuffled, {"b": again, "c": other}, FitStore(spark, str(tmp_path)))
    assert again.fits == 0 and other.fits == 5 and scores.count() == 40
    # scores without the line that follows them are not taken for a finished fit
    store = FitStore(spark, str(tmp_path))
    key = store.key(train.frame_digest(folded), ("m",), 3)
    assert key in store.done()
    shutil.rmtree(tmp_path / "done" / f"key={key}")
    train.out_of_fold(folded, {"a": first}, store)
    assert first.fits == 6
    # other rows, another frame
    fewer = Counted("m")
    train.out_of_fold(rows.filter("doc_id < 15").repartition(1), {"a": fewer}, store)
    assert fewer.fits == 5


def test_calibration_and_permutation(spark):
    row = QUERIES["platt_calibration"](spark, SF).first()
    assert row.rows == 70 and 0 <= row.brier_after <= 1
    rows = QUERIES["permutation_importance"](spark, SF).collect()
    assert {r.feature for r in rows} == set(C.FEATURES)


def test_measures_of_the_comparisons(spark, monkeypatch):
    monkeypatch.setattr(train, "baselines", lambda: {"majority": train.Majority(), "random": train.RandomGuess(), "logistic": train.Logistic()})
    rows = {r.model: r for r in QUERIES["baselines"](spark, SF).collect()}
    assert set(rows) == {"majority", "random", "logistic"}
    assert all(0 <= r[m] <= 1 for r in rows.values() for m in artifacts.MEASURES)
    assert rows["majority"].roc_auc == 0.5


def test_readers_see_one_version_of_the_artefacts(spark, tmp_path):
    folder = str(tmp_path)
    assert {r.document for r in artifacts.model_info(spark, artifacts.current(spark, folder)).collect()} == {"{}"}
    first = artifacts.next_version(spark, folder)
    spark.createDataFrame([(1,)], "training_rows int").write.json(f"{first}/metadata")
    artifacts.publish(spark, folder, first)
    second = artifacts.next_version(spark, folder)
    assert second != first
    spark.createDataFrame([(2,)], "training_rows int").write.json(f"{second}/metadata")
    assert artifacts.current(spark, folder) == first
    artifacts.publish(spark, folder, second)
    assert artifacts.current(spark, folder) == second
    with pytest.raises(AnalysisException):
        spark.range(1).write.mode("error").json(f"{folder}/current/version=2")


def test_compared_configurations_have_all_their_trees(spark, monkeypatch):
    asked, run_with = [], []
    monkeypatch.setattr(catalog.models, "development", lambda spark, sf: (None, None))
    monkeypatch.setattr(catalog.models, "training_data", lambda spark, sf: None)
    monkeypatch.setattr(catalog, "new_path", lambda spark, name: name)
    monkeypatch.setattr(catalog.artifacts, "current", lambda spark, folder: folder)
    monkeypatch.setattr(catalog.training, "run", lambda frame, folder, store, partitions, share=1.0: run_with.append(share))

    def stop(folded, models, store):
        asked.append(models)
        raise InterruptedError

    monkeypatch.setattr(catalog.train, "cross_validate", stop)
    for name in ("baselines", "gbt_grid", "class_weight_sweep", "feature_ablation"):
        with pytest.raises(InterruptedError):
            QUERIES[name](spark, SF)
    assert len(asked) == 4
    assert asked[0]["forest, depth 3"].trees == 100 and asked[0]["boosted, first configuration"].config["trees"] == C.FIRST_CONFIG["trees"]
    grid = {**C.BOOSTED_CONFIGS, **C.RECORDED_CONFIGS}
    assert {name: m.config["trees"] for name, m in asked[1].items()} == {name: c["trees"] for name, c in grid.items()}
    assert all(m.config["trees"] == 80 for models in asked[2:] for m in models.values())
    catalog._trained(spark, SF)
    assert run_with == [1.0]


class Seen(Counted):
    """Tells which rows it was fitted on, and in which order models were fitted."""

    features = ["LOC"]
    order: list = []

    def __init__(self, name, jobs):
        super().__init__(name)
        self.jobs = jobs

    def fit(self, rows):
        self.order.append(self.key[0])
        assert "features" in rows.columns and "LOC" not in rows.columns
        return super().fit(rows)


def test_models_of_the_same_features_read_one_input_and_the_longest_begin(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(train, "materialise", lambda df: made.append(df) or df)
    folded = spark.createDataFrame([(i, i % 2, i % 5, i / 20) for i in range(20)], "doc_id long, label int, fold int, LOC double").repartition(1)
    train.out_of_fold(folded, {"a": Seen("short", 1), "b": Seen("long", 9)}, FitStore(spark, str(tmp_path)), threads=1)
    assert len(made) == 1 and Seen.order == ["long"] * 5 + ["short"] * 5


def test_partitions_of_the_training_frame_grow_with_its_rows(spark, tmp_path, monkeypatch):
    for name, rows in (("none", 0), ("few", 3), ("many", 41)):
        spark.range(rows).write.parquet(f"{tmp_path}/{name}/labels.parquet")
    monkeypatch.setattr(catalog.models, "ROWS_PER_PARTITION", 10)
    assert [catalog.models.partitions(spark, f"{tmp_path}/{name}") for name in ("none", "few", "many")] == [1, 1, 5]
