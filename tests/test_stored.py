"""Batches that become visible together, deletions that rewrite only what they touch, and the job that stores results."""

import os

import pytest
from pyspark.errors import AnalysisException

from faultgauge.plans import service
from faultgauge.sources import snapshots, stored

ANALYSIS = "analysis_id int, user_id int, overall_risk double, risk_level string"
FILE = "analysis_id int, file_path string, risk_score double, risk_level string"


def analyses_of(spark, *rows):
    return spark.createDataFrame([(i, u, 0.5, "MEDIUM") for i, u in rows], ANALYSIS)


def files_of(spark, *ids):
    return spark.createDataFrame([(i, f"f{k}", 0.1, "LOW") for i in ids for k in range(3)], FILE)


def seen(spark, folder):
    return {
        t: sorted(r.analysis_id for r in snapshots.read(spark, folder, t).collect()) for t in ("analyses", "analysis_files")
    }


def parquet_files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_nothing_is_seen_before_it_is_published(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    with pytest.raises(LookupError):
        snapshots.read(spark, folder, "analyses")
    stored.persist(analyses_of(spark, (1, 7)), files_of(spark, 1), folder, "one")

    def stop(*_):
        raise InterruptedError

    with monkeypatch.context() as patched:
        patched.setattr(snapshots, "publish", stop)
        with pytest.raises(InterruptedError):
            stored.persist(analyses_of(spark, (2, 7)), files_of(spark, 2), folder, "two")
    assert seen(spark, folder) == {"analyses": [1], "analysis_files": [1, 1, 1]}
    # the same batch again, with other rows: what the first attempt left is replaced
    stored.persist(analyses_of(spark, (3, 7)), files_of(spark, 3), folder, "two")
    assert seen(spark, folder) == {"analyses": [1, 3], "analysis_files": [1, 1, 1, 3, 3, 3]}
    with pytest.raises(ValueError):
        stored.persist(analyses_of(spark, (4, 7)), files_of(spark, 4), folder, "two")


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    before = snapshots._latest(spark, folder)
    stored.persist(analyses_of(spark, (1, 7)), files_of(spark, 1), folder, "one")
    monkeypatch.setattr(snapshots, "_latest", lambda *_: before)
    with pytest.raises(AnalysisException):
        snapshots.publish(spark, folder, [snapshots.Batch("late", 1, ("analyses",))])


def test_only_touched_batches_are_rewritten(spark, tmp_path):
    folder = str(tmp_path)
    people = snapshots.Batch("people", 1, ("users",))
    snapshots.write({"users": spark.createDataFrame([(7, "a"), (8, "b")], "user_id int, name string")}, folder, people)
    snapshots.publish(spark, folder, [people])
    stored.persist(analyses_of(spark, (1, 7), (2, 8)), files_of(spark, 1, 2), folder, "mixed")
    stored.persist(analyses_of(spark, (3, 8)), files_of(spark, 3), folder, "other")
    before = parquet_files(f"{folder}/analyses/batch=other") | parquet_files(f"{folder}/analysis_files/batch=other")
    old = snapshots.live(spark, folder)

    assert stored.delete_users(spark, folder, spark.createDataFrame([(7,), (99,)], "user_id int")) == ["people", "mixed"]
    assert seen(spark, folder) == {"analyses": [2, 3], "analysis_files": [2, 2, 2, 3, 3, 3]}
    assert [r.user_id for r in snapshots.read(spark, folder, "users").collect()] == [8]
    after = parquet_files(f"{folder}/analyses/batch=other") | parquet_files(f"{folder}/analysis_files/batch=other")
    assert after == before
    # a reader that took the version before still has all of it
    assert snapshots.read(spark, folder, "analyses", old).count() == 3

    versions = len(os.listdir(f"{folder}/manifest"))
    assert stored.delete_users(spark, folder, spark.createDataFrame([(99,)], "user_id int")) == []
    assert len(os.listdir(f"{folder}/manifest")) == versions


def test_the_read_back_opens_the_chosen_batch_alone(spark, tmp_path):
    folder = str(tmp_path)
    for i in (1, 2):
        stored.persist(analyses_of(spark, (i, 7)), files_of(spark, i), folder, f"b{i}")
    chosen = [b for b in snapshots.live(spark, folder) if b.name == "b2"]
    assert all("batch=b2" in f for f in snapshots.read(spark, folder, "analyses", chosen).inputFiles())


def test_requests_to_stored_results(spark, tmp_path):
    folder = str(tmp_path)
    requests = spark.createDataFrame(
        [(1, 7, "https://github.com/o/good"), (2, 8, "o/good.git"), (3, 7, "o/blank"), (4, 7, "o/none"), (5, 7, "o/absent"), (6, 7, "bad"), (7, 7, None)],
        "analysis_id int, user_id int, url string",
    )
    files = spark.createDataFrame(
        [("o/good", "a.js", 9, "f(1)"), ("o/good", "b.js", 9, " "), ("o/blank", "a.js", 1, "\n"), ("o/none", "a.txt", 3, "text"), ("o/unasked", "a.js", 3, "f(2)")],
        "repo string, path string, size int, content string",
    )
    commits = spark.createDataFrame([], "repo string, path string, commit struct<author: struct<email: string>>")
    service.analyze_and_store(requests, files, commits, None, None, folder, "day")
    outcome = {r.analysis_id: (r.repository_name, r.files, r.risk_level, r.error) for r in snapshots.read(spark, folder, "requests").collect()}
    assert outcome[1] == outcome[2] == ("o/good", 1, "MEDIUM", None)
    assert outcome[3][1:3] == (0, None) and "empty" in outcome[3][3]
    assert "No supported" in outcome[4][3] and "No supported" in outcome[5][3] and outcome[6][3].endswith(": bad") and outcome[7][0] is None
    assert seen(spark, folder) == {"analyses": [1, 2], "analysis_files": [1, 2]}


def test_wide_rows_are_shuffled_without_drawn_ids_and_not_sorted_to_delete(spark, tmp_path, monkeypatch):
    plans = []
    written = snapshots.write

    def write(tables, folder, batch):
        plans.extend(t._jdf.queryExecution().optimizedPlan().toString() for n, t in tables.items() if n == "analysis_files")
        written(tables, folder, batch)

    monkeypatch.setattr(snapshots, "write", write)
    folder = str(tmp_path)
    stored.persist(analyses_of(spark, (1, 7), (2, 8)), files_of(spark, 1, 2), folder, "b")
    stored.delete_users(spark, folder, spark.createDataFrame([(7,)], "user_id long"))
    stored_plan, left_plan = plans
    assert 0 <= stored_plan.index("uuid(") < stored_plan.index("Join ") and stored_plan.count("uuid(") == 1
    assert "strategy=shuffle_hash" in left_plan
    assert {r.analysis_id for r in snapshots.read(spark, folder, "analysis_files").collect()} == {2}
