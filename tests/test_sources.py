"""Reading and storing: labels, checkouts, commits of several repositories, ids of children."""

import pytest
from pyspark.sql import functions as F

from faultgauge.operators import rollup
from faultgauge.plans import analyze
from faultgauge.sources import artifacts, repos, snapshots, stored


def test_labels_written_as_decimals_are_kept(spark, tmp_path):
    file = tmp_path / "t.csv"
    file.write_text("LOC,DEFECT_LABEL\n1,1.0\n2,0\n3,?\n4,1\n")
    rows = artifacts.read_training(spark, str(file)).collect()
    assert sorted((r.LOC, r.DEFECT_LABEL) for r in rows) == [(1.0, 1), (2.0, 0), (4.0, 1)]


def test_label_that_is_no_number_is_refused(spark, tmp_path):
    file = tmp_path / "t.csv"
    file.write_text("LOC,DEFECT_LABEL\n1,yes\n")
    with pytest.raises(Exception, match="is no number: yes"):
        artifacts.read_training(spark, str(file)).collect()


def test_checkouts_of_several_repositories(spark, tmp_path):
    for name in ("one", "two/one/src"):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "a.py").write_text(name)
    found = repos.scan_checkouts(spark, {"o/one": str(tmp_path / "one"), "o/two": str(tmp_path / "two")}).collect()
    assert {(r.repo, r.path, r.content) for r in found} == {("o/one", "a.py", "one"), ("o/two", "one/src/a.py", "two/one/src")}


def commits_of(spark, rows):
    schema = "repo string, path string, commit struct<author: struct<email: string>>"
    return spark.createDataFrame([(r, p, (None if a is None else (a,),)) for r, p, a in rows], schema)


def test_equal_paths_of_two_repositories(spark):
    commits = commits_of(spark, [("a", "x.js", "u@x"), ("a", "x.js", "v@x"), ("a", "x.js", None), ("b", "y.js", "u@x")])
    counts = {(r.repo, r.path): (r.commit_count, r.contributor_count) for r in rollup.churn_counts(commits).collect()}
    assert counts == {("a", "x.js"): (3, 2), ("b", "y.js"): (1, 1)}
    files = spark.createDataFrame([("a", "x.js", 9, "f(1)"), ("b", "x.js", 8, "g(2)")], "repo string, path string, size int, content string")
    out = {r.repo: r.metrics for r in analyze.analyze(files, commits, None, None).collect()}
    assert (out["a"].commit_count, out["b"].commit_count) == (3, 1)


def test_limits_of_an_analysis_are_asked_for(spark):
    files = spark.createDataFrame(
        [("a", f"f{i}.js", i, f"f({i})") for i in range(40)] + [("a", "blank.js", 99, " ")], "repo string, path string, size int, content string"
    )
    commits = commits_of(spark, [("a", f"f{i}.js", e) for i in range(40) for e in ("u", "v")])
    whole = analyze.analyze(files, commits, None, None).collect()
    assert len(whole) == 40 and all(r.metrics.commit_count == 2 and r.ai_explanation for r in whole)
    few = analyze.analyze(files, commits, None, None, max_files=25, churn_top=5, explain_top=3).collect()
    assert len(few) == 24 and sum(r.metrics.commit_count == 2 for r in few) == 5 and sum(bool(r.ai_explanation) for r in few) == 3


def test_children_refer_to_the_written_parent(spark, tmp_path):
    analyses = spark.createDataFrame([(1, 7, None, None), (2, 8, 0.5, "MEDIUM")], "analysis_id int, user_id int, overall_risk double, risk_level string")
    files = spark.createDataFrame(
        [(1, "a", 0.1, None), (1, "b", None, None), (3, "c", 0.2, "LOW")],
        "analysis_id int, file_path string, risk_score double, risk_level string",
    )
    stored.persist(analyses, files, str(tmp_path))
    parents, children = (snapshots.read(spark, str(tmp_path), t) for t in ("analyses", "analysis_files"))
    joined = children.join(parents, children.parent_row_id == parents.row_id)
    assert joined.count() == children.count() == 2
    assert parents.select("created_at").union(children.select("created_at")).distinct().count() == 1
    assert stored.lookup_owned(parents, 1, 7).count() == 1 and stored.lookup_owned(parents, 1, 8).count() == 0


def test_texts_are_in_no_shuffle_of_the_measuring_step(spark):
    files = spark.createDataFrame([("a", "x.js", 9, "f(1)")], "repo string, path string, size int, content string")
    plan = analyze.predict(files.filter(F.col("size") > 1), None, None)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_files_that_are_not_supported_are_not_opened(spark, tmp_path):
    for name in ("a.py", "B.JS", "c.txt", "Makefile", "d/e.Java", "f.pyc"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    found = repos.scan_checkouts(spark, {"o/r": str(tmp_path)})
    assert {r.path for r in found.collect()} == {"a.py", "B.JS", "d/e.Java"}
    assert all(f.endswith((".py", ".JS", ".Java")) for f in found.inputFiles())
    listing = repos.checkout_listing(spark, {"o/r": str(tmp_path)})
    assert {(r.path, r.size) for r in listing.collect()} >= {("c.txt", 5), ("Makefile", 8), ("a.py", 4)} and listing.count() == 6
    scan = listing._jdf.queryExecution().executedPlan().toString()
    assert "content" not in scan[scan.index("ReadSchema") :]
