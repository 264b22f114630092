"""Every operator as a query over the test tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from faultgauge import constants as C
from faultgauge.functions import lexical, paths
from faultgauge.functions.pinned import pinned
from faultgauge.operators import contract, evaluate, filters, forest, metrics, rollup, scoring, shap, train
from faultgauge.operators.topk import top_k
from faultgauge.plans import analyze, models, service, training
from faultgauge.session import new_path
from faultgauge.sources import artifacts, fixtures as X, repos, snapshots, stored

QUERIES: dict = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def r6(x: str | Column) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x, 6)


def day(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd").alias(name)


# --- scans, sources, sinks ----------------------------------------------------------------------


@query
def parse_repo_url(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses in all accepted forms, made from page addresses."""
    k = F.col("page_id") % 6
    tail = F.regexp_replace("url", "^https?://[^/]*", "")
    url = (
        F.when(k == 0, F.col("url"))
        .when(k == 1, F.concat(F.lit("  https://github.com"), tail, F.lit(" ")))
        .when(k == 2, F.concat(F.lit("github.com"), F.regexp_replace(tail, r"[?#].*", ""), F.lit(".git")))
        .when(k == 3, F.regexp_replace(tail, r"^/|[?#].*", ""))
        .when(k == 4, F.concat(F.lit("name_without_slash_"), F.col("page_id").cast("string")))
        .otherwise(F.concat(F.lit("http://github.com//"), F.regexp_replace(tail, "^/", "")))
    )
    requests = X.table(spark, sf, "pages").select("page_id", url.alias("url"))
    return repos.parse_repo_url(requests).select("page_id", "owner", "repo", F.col("error").isNotNull().alias("failed"))


@query
def scan_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Listings written as JSON lines and read back with a fixed schema."""
    path = new_path(spark, "tree")
    X.src_files(spark, sf).select("repo", "path", "size").write.json(path)
    return repos.scan_tree(spark, path)


@query
def content_fallback(spark: SparkSession, sf: str) -> DataFrame:
    files = X.src_files(spark, sf)
    primary = files.filter(F.col("doc_id") % 3 != 0)
    fallback = files.filter(F.col("doc_id") % 2 == 0).withColumn("content", F.concat(F.lit("copy of "), "content"))
    found = repos.content_with_fallback(files.drop("content"), primary, fallback, ["repo", "path"])
    return found.select("repo", "path", "content")


@query
def commit_scan(spark: SparkSession, sf: str) -> DataFrame:
    listing = X.src_files(spark, sf).select("doc_id", "repo", "path")
    found = repos.commit_scan(listing, repos.with_author(X.file_commits(spark, sf)))
    return found.select("doc_id", "path", "event_id", "author")


@query
def read_training(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of labelled documents written as CSV, some marked ``?``, and read back."""
    path = new_path(spark, "training")
    rows = metrics.file_metrics(X.labelled_files(spark, sf))
    marked = F.when(F.col("doc_id") % 10 == 0, "?").otherwise(F.col("loc").cast("string"))
    out = rows.select(
        marked.alias("LOC"),
        *[F.col(C.METRIC_OF_FEATURE[f]).alias(f) for f in C.FEATURES[1:]],
        F.col("label").alias("DEFECT_LABEL"),
    )
    out.write.option("header", "true").csv(path)
    return artifacts.read_training(spark, path).withColumns({f: r6(f) for f in ("VOLUME", "DIFFICULTY")})


@query
def feature_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds where a written schema gives some of them, from the observed range of order prices."""
    path = new_path(spark, "bounds")
    X.table(spark, sf, "orders").agg(
        F.lit("LOC").alias("name"), F.min("o_totalprice").alias("bound_min"), F.max("o_totalprice").alias("bound_max")
    ).write.json(path)
    return contract.feature_bounds(spark, path)


@query
def model_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Does the saved and reloaded model score as its table of nodes does? And the score without a model."""
    frame, path = models.training_data(spark, sf), models.model_path(spark, sf)
    forest.write(shap.tree_nodes(spark, path), table := new_path(spark, "nodes"))
    reloaded = scoring.score(contract.assemble(frame), artifacts.load_model(path)).select("doc_id", "risk_score")
    nodes = scoring.score(frame, forest.load(spark, table)).select("doc_id", F.col("risk_score").alias("by_nodes"))
    without = scoring.score(contract.assemble(frame), artifacts.load_model(new_path(spark, "absent")))
    both = reloaded.join(nodes, "doc_id").join(without.select("doc_id", F.col("risk_score").alias("default_score")), "doc_id")
    same = (F.abs(F.col("risk_score") - F.col("by_nodes")) < 1e-9) & F.col("risk_score").between(0, 1)
    return both.select("doc_id", same.alias("same_score"), "default_score")


@query
def persist_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """Analyses and files stored as one batch and read back."""
    folder = new_path(spark, "stored")
    analyses = X.analyses(spark, sf).drop("created_at")
    risk = F.when(F.col("analysis_id") % 10 != 0, F.col("overall_risk"))
    level = F.when(F.col("analysis_id") % 10 != 0, F.col("risk_level"))
    files = X.analysis_files(spark, sf).select("analysis_id", "file_path", "risk_score", "risk_level", "metrics")
    stored.persist(analyses.withColumn("overall_risk", risk).withColumn("risk_level", level), files, folder)
    parents = snapshots.read(spark, folder, "analyses")
    children = snapshots.read(spark, folder, "analysis_files").groupBy("analysis_id").agg(F.count("*").alias("files"))
    return parents.join(children, "analysis_id", "left").select(
        "analysis_id", "user_id", r6("overall_risk").alias("overall_risk"), "risk_level", "files"
    )


@query
def lookup_owned(spark: SparkSession, sf: str) -> DataFrame:
    """Every analysis asked for by its owner or, on every third row, by somebody else."""
    analyses = X.analyses(spark, sf)
    other = F.when(F.col("analysis_id") % 3 == 0, F.col("user_id") + 1).otherwise(F.col("user_id"))
    wanted = analyses.select((F.col("analysis_id") + 5).alias("analysis_id"), other.alias("user_id")).unionByName(
        analyses.select("analysis_id", other.alias("user_id"))
    )
    return stored.lookup_many(analyses, wanted)


@query
def unique_insert(spark: SparkSession, sf: str) -> DataFrame:
    """Users with an odd id arrive; those with an even id are there already."""
    users = X.users(spark, sf)
    return stored.unique_insert(
        users.filter(F.col("user_id") % 2 == 0), users.filter(F.col("user_id") % 2 == 1), "email", "user_id"
    )


@query
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Rows left in each stored table after every seventh user is deleted; analyses lie in two batches."""
    folder = new_path(spark, "stored")
    users, analyses, files = X.users(spark, sf), X.analyses(spark, sf).drop("created_at"), X.analysis_files(spark, sf)
    people = snapshots.Batch("people", 1, ("users",))
    snapshots.write({"users": users}, folder, people)
    snapshots.publish(spark, folder, [people])
    for odd in (0, 1):
        stored.persist(analyses.filter(F.col("analysis_id") % 2 == odd), files.filter(F.col("analysis_id") % 2 == odd), folder, f"half-{odd}")
    stored.delete_users(spark, folder, users.filter(F.col("user_id") % 7 == 0).select("user_id"))
    counts = [
        snapshots.read(spark, folder, n).agg(F.lit(n).alias("table_name"), F.count("*").alias("rows_left"), F.sum(i).alias("id_sum"))
        for n, i in (("users", "user_id"), ("analyses", "analysis_id"), ("analysis_files", "analysis_id"))
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


_stored_folders: dict[tuple[str, str], str] = {}


def stored_folder(spark: SparkSession, sf: str) -> str:
    """The job from addresses to stored results, run once in a session for each set of tables."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _stored_folders:
        folder = new_path(spark, "service")
        commits = X.file_commits(spark, sf).withColumn("repo", X.owned_name())
        service.analyze_and_store(X.requests(spark, sf), X.listed_files(spark, sf), commits, *models.given_forest(spark, sf), folder)
        _stored_folders[key] = folder
    return _stored_folders[key]


@query
def analyze_and_store(spark: SparkSession, sf: str) -> DataFrame:
    """Requested addresses to stored analyses and files, read back together."""
    folder = stored_folder(spark, sf)
    parents = snapshots.read(spark, folder, "analyses").select(
        F.col("row_id").alias("parent_row_id"), "repository_name", r6("overall_risk").alias("overall_risk"), F.col("risk_level").alias("repository_level")
    )
    children = snapshots.read(spark, folder, "analysis_files")
    return children.join(parents, "parent_row_id").select(
        "analysis_id", "repository_name", "overall_risk", "repository_level", "file_path", "rank", r6("risk_score").alias("risk_score"), "risk_level",
        "metrics.commit_count", "metrics.contributor_count", "ai_explanation", "test_suggestions",
    )


@query
def repository_results(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome of every request, as stored."""
    out = snapshots.read(spark, stored_folder(spark, sf), "requests")
    return out.withColumn("overall_risk", r6("overall_risk"))


# --- filters --------------------------------------------------------------------------------------


@query
def filter_supported(spark: SparkSession, sf: str) -> DataFrame:
    files = X.src_files(spark, sf)
    path = F.when(F.col("doc_id") % 2 == 0, F.upper("path")).otherwise(F.col("path"))
    return filters.supported_files(files.withColumn("path", path)).select("doc_id", "path")


@query
def filter_blank(spark: SparkSession, sf: str) -> DataFrame:
    return filters.non_blank(X.with_blank_files(X.src_files(spark, sf))).select("doc_id", "path")


@query
def filter_elevated(spark: SparkSession, sf: str) -> DataFrame:
    rows = filters.elevated(X.analysis_files(spark, sf))
    return rows.select("analysis_id", "file_path", "risk_score", "risk_level")


@query
def drop_dirty(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_orderkey")
    rows = X.table(spark, sf, "lineitem").select(
        k,
        F.when(k % 5 == 0, "?").otherwise(F.col("l_returnflag")).alias("flag"),
        F.when(k % 7 == 0, "?").when(k % 11 != 0, F.col("l_linestatus")).alias("status"),
        "l_quantity",
    )
    return filters.drop_dirty(rows)


@query
def repo_status(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes with files grouped by extension and by the blank rule, so that both failures occur."""
    files = X.with_blank_files(X.src_files(spark, sf))
    doc = F.col("doc_id")
    pairs = F.explode(F.array(F.concat(F.lit("a"), (doc % 13).cast("string")), F.concat(F.lit("b"), (doc % 17).cast("string"))))
    return filters.repository_status(files.select("path", "content", pairs.alias("repo")))


# --- projections ----------------------------------------------------------------------------------


@query
def alias_features(spark: SparkSession, sf: str) -> DataFrame:
    return contract.alias_features(X.metric_maps(spark, sf))


@query
def short_repo_name(spark: SparkSession, sf: str) -> DataFrame:
    return X.analyses(spark, sf).select("analysis_id", paths.short_name(F.col("repository_name")).alias("name"))


@query
def metrics_payload(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of each file with default churn, as one struct (spread for the check)."""
    m = metrics.file_metrics(X.src_files(spark, sf)).withColumns(
        {"commit_count": F.lit(1).cast("bigint"), "contributor_count": F.lit(1).cast("bigint")}
    )
    packed = m.select("doc_id", F.struct(*metrics.METRIC_COLUMNS, "commit_count", "contributor_count").alias("metrics"))
    return packed.select("doc_id", "metrics.loc", "metrics.language", "metrics.num_operands", "metrics.commit_count",
                         "metrics.contributor_count")


# --- static code metrics --------------------------------------------------------------------------


@query
def detect_language(spark: SparkSession, sf: str) -> DataFrame:
    odd = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(".env/."), F.regexp_extract("path", "[^.]*$", 0))).otherwise(
        F.when(F.col("doc_id") % 5 == 1, F.upper("path")).otherwise(F.col("path"))
    )
    files = X.src_files(spark, sf).select("doc_id", odd.alias("path"))
    return files.select("doc_id", paths.language(F.col("path")).alias("language"))


@query
def display_language(spark: SparkSession, sf: str) -> DataFrame:
    bare = F.when(F.col("doc_id") % 5 == 0, F.regexp_replace("path", r"\.[^.]*$", "")).otherwise(F.col("path"))
    files = X.src_files(spark, sf).select("doc_id", bare.alias("path"))
    return files.select("doc_id", paths.display_language(F.col("path")).alias("language"))


def _line_counts(files: DataFrame, key: str) -> DataFrame:
    return files.select(key, pinned(lexical.line_counts(F.col("content"))).alias("lines")).select(key, "lines.*").withColumn(
        "sloc", F.greatest(F.lit(1), F.col("total") - F.col("blank") - F.col("comment"))
    )


@query
def line_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _line_counts(X.src_files(spark, sf), "doc_id")


@query
def html_line_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _line_counts(X.html_files(spark, sf), "page_id")


@query
def strip_comments(spark: SparkSession, sf: str) -> DataFrame:
    """Pages read in turn as Python, Ruby and C-like code."""
    lang = F.element_at(F.array(F.lit("python"), F.lit("ruby"), F.lit("java")), (F.col("page_id") % 3 + 1).cast("int"))
    return X.html_files(spark, sf).select(
        "page_id", F.md5(lexical.strip_comments(F.col("content"), lang)).alias("text_md5")
    )


@query
def mask_strings(spark: SparkSession, sf: str) -> DataFrame:
    return X.html_files(spark, sf).select("page_id", F.md5(lexical.mask_strings(F.col("content"))).alias("text_md5"))


@query
def operator_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.operator_tokens(X.html_files(spark, sf), "page_id")


@query
def operand_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.operand_tokens(X.src_files(spark, sf), "doc_id")


@query
def halstead(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.file_metrics(X.html_files(spark, sf))
    return m.select("page_id", "num_operators", "num_operands", "length", r6("volume").alias("volume"),
                    r6("difficulty").alias("difficulty"))


@query
def cyclomatic_lexical(spark: SparkSession, sf: str) -> DataFrame:
    """Every document under each of five decision vocabularies."""
    langs = ["java", "c", "go", "php", "ruby"]
    files = X.src_files(spark, sf).select("doc_id", "content", F.explode(F.array(*[F.lit(x) for x in langs])).alias("language"))
    clean = files.withColumn("clean", metrics.clean_text(F.col("content"), F.col("language")))
    return clean.select("doc_id", "language", (1 + lexical.decision_count(F.col("clean"), F.col("language"))).alias("cyclo"))


@query
def branch_count(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.file_metrics(X.html_files(spark, sf)).select("page_id", "cyclomatic_complexity", "branch_count")


@query
def fan_in_out(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.file_metrics(X.html_files(spark, sf)).select("page_id", "int_fan_in", "int_fan_out")


def _all_metrics(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, *metrics.METRIC_COLUMNS).withColumns({c: r6(c) for c in ("volume", "difficulty")})


@query
def py_ast_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics from the grammar, over generated Python files that parse."""
    return _all_metrics(metrics.file_metrics(X.python_sources(spark, sf)), "doc_id")


@query
def ast_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Python files of which every third one does not parse and takes the lexical route."""
    return _all_metrics(metrics.file_metrics(X.python_sources(spark, sf, broken=True)), "doc_id")


@query
def blank_metrics(spark: SparkSession, sf: str) -> DataFrame:
    files = X.with_blank_files(X.src_files(spark, sf)).filter(lexical.is_blank(F.col("content")))
    return _all_metrics(metrics.file_metrics(files), "doc_id")


@query
def file_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _all_metrics(metrics.file_metrics(X.src_files(spark, sf)), "doc_id")


@query
def html_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _all_metrics(metrics.file_metrics(X.html_files(spark, sf)), "page_id")


# --- feature contract -----------------------------------------------------------------------------


@query
def validate_features(spark: SparkSession, sf: str) -> DataFrame:
    return contract.contract_of_map(X.metric_maps(spark, sf)).select("id", "error")


@query
def scale_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = contract.contract_row(metrics.file_metrics(X.src_files(spark, sf)))
    return rows.select("doc_id", *[r6(f).alias(f) for f in C.FEATURES])


@query
def assemble(spark: SparkSession, sf: str) -> DataFrame:
    """The model input, spread again: ten values at float precision."""
    from pyspark.ml.functions import vector_to_array

    rows = contract.assemble(contract.contract_row(metrics.file_metrics(X.src_files(spark, sf))))
    values = vector_to_array("features")
    return rows.select("doc_id", *[values[i].alias(f) for i, f in enumerate(C.FEATURES)])


@query
def contract_failures(spark: SparkSession, sf: str) -> DataFrame:
    """The neutral result of rows that fail the contract, next to a model that would score them."""
    out = analyze.predict_maps(X.metric_maps(spark, sf), *models.given_forest(spark, sf)).filter(F.col("error").isNotNull())
    return out.select(
        "id", "risk_score", "risk_level", F.array_join("recommendations", " | ").alias("recommendation"), "error",
        F.size("shap_factors").alias("factors"),
    )


# --- scoring and explanation ----------------------------------------------------------------------


@query
def score_files(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all files by a published forest."""
    model, _ = models.given_forest(spark, sf)
    rows = contract.contract_row(metrics.file_metrics(X.src_files(spark, sf)))
    return scoring.score(rows, model).select("doc_id", "path", r6("risk_score").alias("risk_score"), "risk_level")


@query
def score_default(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("l_linenumber") != 3, F.col("l_quantity") / 25 - 0.5)
    return X.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", scoring.final_score(raw).alias("score"))


@query
def risk_tiers(spark: SparkSession, sf: str) -> DataFrame:
    files = X.analysis_files(spark, sf)
    return files.select("analysis_id", "file_path", "risk_score", scoring.risk_tier(F.col("risk_score")).alias("risk_level"))


@query
def tree_shap(spark: SparkSession, sf: str) -> DataFrame:
    """Contributions of all files; they and the base value add up to the margin."""
    model, leaves = models.given_forest(spark, sf)
    rows = contract.contract_row(metrics.file_metrics(X.src_files(spark, sf)))
    explained = shap.tree_shap(scoring.score(rows, model), leaves)
    total = F.aggregate("contributions", F.lit(0.0), lambda a, b: a + b) + F.col("base_value")
    return explained.select(
        "doc_id", *[r6(F.col("contributions")[i]).alias(f) for i, f in enumerate(C.FEATURES)], r6("base_value").alias("base_value"),
        (F.abs(total - F.col("margin")) < 1e-9).alias("adds_up"),
    )


@query
def shap_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Top raising and lowering factors, from contributions with ties and zeros."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    contributions = F.array(*[((k * (i + 3) + c * i * i) % 9 - 4) / 10 for i in range(len(C.FEATURES))])
    rows = shap.with_factors(X.table(spark, sf, "orders").select(k, contributions.alias("contributions")))
    top = rows.select("o_orderkey", F.posexplode(F.concat("top_risk_factors", "top_reducing_factors")).alias("_", "f"))
    return top.select("o_orderkey", "f.feature", "f.contribution", "f.direction")


@query
def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.file_metrics(X.html_files(spark, sf)).unionByName(
        metrics.file_metrics(X.src_files(spark, sf).select(F.col("doc_id").alias("page_id"), "path", "content"))
    )
    packed = m.select("page_id", "path", F.struct(*metrics.METRIC_COLUMNS).alias("raw"))
    return packed.select("page_id", "path", F.array_join(scoring.metric_recommendations(), " | ").alias("recommendations"))


def _factors_by_key(key: Column) -> Column:
    """None to two factors that vary with the key; INT_FAN_IN is one that no phrase exists for."""
    at = lambda n: F.element_at(F.array(*[F.lit(f) for f in C.FEATURES]), (n % 10 + 1).cast("int"))
    names = (
        F.when(key % 4 == 0, F.array().cast("array<string>"))
        .when(key % 4 == 1, F.array(at(key)))
        .otherwise(F.array(at(key), at(key + 3)))
    )
    return F.transform(names, lambda n: F.struct(n.alias("feature"), F.lit(0.1).alias("contribution"),
                                                 F.lit("INCREASES_RISK").alias("direction")))


@query
def explain_text(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.file_metrics(X.html_files(spark, sf).withColumn("path", F.concat(F.lit("site/p"), F.col("page_id").cast("string"), F.lit(".js"))))
    score = (F.col("page_id") % 101) / 200
    advice = F.when(F.col("page_id") % 5 != 0, scoring.recommendations(
        F.col("cyclomatic_complexity"), F.col("loc"), F.col("branch_count"), F.col("difficulty"), F.col("int_fan_out")))
    why = scoring.why_text(F.col("path"), score, _factors_by_key(F.col("page_id")), F.col("loc"),
                           F.col("cyclomatic_complexity"), F.col("branch_count"), F.col("volume"))
    return m.select("page_id", why.alias("why"), scoring.suggestion_text(F.col("path"), advice).alias("suggestions"))


@query
def explain_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Which files get a text: the three riskiest of each analysis, where elevated."""
    files = X.analysis_files(spark, sf).select("analysis_id", "file_path", "risk_score", "risk_level")
    return filters.elevated(top_k(files, ["analysis_id"], rollup.by_risk(), C.EXPLAINED_FILES))


@query
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The whole analysis: listing, metrics, score, factors, churn and texts, ranked per repository."""
    model, leaves = models.given_forest(spark, sf)
    out = analyze.analyze(X.src_files(spark, sf), X.file_commits(spark, sf), model, leaves)
    factor = lambda i: F.try_element_at("metrics.top_risk_factors", F.lit(i))["feature"]
    return out.select(
        "repo", "path", "rank", r6("risk_score").alias("risk_score"), "risk_level", "metrics.loc", "metrics.cyclomatic_complexity",
        r6("metrics.volume").alias("volume"), "metrics.language", "metrics.commit_count", "metrics.contributor_count",
        factor(1).alias("factor_1"), factor(2).alias("factor_2"), factor(3).alias("factor_3"),
        "ai_explanation", "test_suggestions",
    )


@query
def predict_from_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The whole result of given maps of metrics, good and bad."""
    out = analyze.predict_maps(X.metric_maps(spark, sf), *models.given_forest(spark, sf))
    first = lambda factors: F.try_element_at(factors, F.lit(1))["feature"]
    return out.select(
        "id", r6("risk_score").alias("risk_score"), "risk_level", "error", F.array_join("recommendations", " | ").alias("recommendations"),
        first("top_risk_factors").alias("raises"), first("top_reducing_factors").alias("lowers"),
    )


@query
def score_with_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Pages scored under written bounds, which are the ranges that the measured pages span."""
    path = new_path(spark, "bounds")
    measured = metrics.file_metrics(X.html_files(spark, sf))
    ranges = measured.agg(*[F.struct(F.lit(f).alias("name"), F.min(m).cast("double").alias("bound_min"), F.max(m).cast("double").alias("bound_max")).alias(f)
                            for f, m in C.METRIC_OF_FEATURE.items()])
    ranges.select(F.inline(F.array(*C.FEATURES))).write.json(path)
    limits = contract.bounds_of(contract.feature_bounds(spark, path))
    out = analyze.predict_metrics(measured, *models.given_forest(spark, sf), limits)
    return out.select("page_id", "LOC", r6("VOLUME").alias("VOLUME"), r6("BRANCH_COUNT").alias("BRANCH_COUNT"), r6("risk_score").alias("risk_score"), "risk_level")


# --- joins and roll-ups ---------------------------------------------------------------------------


@query
def files_with_content(spark: SparkSession, sf: str) -> DataFrame:
    files = X.src_files(spark, sf)
    listing = files.select("repo", "path", "size")
    joined = listing.join(files.filter(F.col("doc_id") % 4 != 0).select("repo", "path", "content"), ["repo", "path"], "left")
    return filters.non_blank(joined).select("repo", "path", "size")


@query
def churn_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.churn_counts(X.file_commits(spark, sf))


def _listed_scores(spark: SparkSession, sf: str) -> DataFrame:
    score = F.col("doc_id") * 37 % 100 / 100
    return X.src_files(spark, sf).select("doc_id", "repo", "path", score.alias("risk_score"))


@query
def churn_enrich(spark: SparkSession, sf: str) -> DataFrame:
    ranked = rollup.rank_by_risk(_listed_scores(spark, sf), "repo", "path")
    out = rollup.churn_enrich(ranked, X.file_commits(spark, sf), C.ENRICHED_FILES)
    return out.select("repo", "path", "rank", "commit_count", "contributor_count")


@query
def analysis_with_files(spark: SparkSession, sf: str) -> DataFrame:
    files = X.analysis_files(spark, sf).filter(F.col("analysis_id") % 9 != 0).select("analysis_id", "file_path", "risk_score")
    analyses = X.analyses(spark, sf).select("analysis_id", "user_id", "risk_level")
    return rollup.analysis_with_files(analyses, files)


@query
def analysis_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Each analysis with a list of its files (spread into a text for the check)."""
    files = X.analysis_files(spark, sf).filter(F.col("analysis_id") % 9 != 0).select("analysis_id", "file_path", "risk_score", "risk_level")
    out = rollup.analysis_nested(X.analyses(spark, sf).select("analysis_id", "user_id"), files)
    told = F.transform("files", lambda f: F.concat(f["file_path"], F.lit(" "), f["risk_level"]))
    return out.select("analysis_id", "user_id", "file_count", F.array_join(told, "; ").alias("files"))


@query
def user_analyses(spark: SparkSession, sf: str) -> DataFrame:
    analyses = X.analyses(spark, sf).select("analysis_id", "user_id", "risk_level")
    return analyses.join(X.users(spark, sf).select("user_id", "name"), "user_id")


@query
def orphans(spark: SparkSession, sf: str) -> DataFrame:
    kept = X.analyses(spark, sf).filter(F.col("analysis_id") % 2 == 0)
    return stored.orphans(X.analysis_files(spark, sf).select("analysis_id", "file_path"), kept)


@query
def repo_risk(spark: SparkSession, sf: str) -> DataFrame:
    out = rollup.repository_risk(X.analysis_files(spark, sf), "analysis_id")
    return out.withColumn("overall_risk", r6("overall_risk"))


@query
def tier_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.tier_counts(X.analyses(spark, sf), X.analysis_files(spark, sf))


@query
def repo_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    out = rollup.scorecard(X.analyses(spark, sf), X.analysis_files(spark, sf))
    return out.withColumn("avg_complexity", r6("avg_complexity"))


@query
def language_mix(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.language_mix(X.analysis_files(spark, sf))


@query
def hot_dirs(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.hot_directories(X.analysis_files(spark, sf)).withColumn("avg_risk", r6("avg_risk"))


@query
def dashboard_totals(spark: SparkSession, sf: str) -> DataFrame:
    out = rollup.dashboard_totals(X.analyses(spark, sf))
    return out.withColumn("avg_risk", F.round("avg_risk", 9))


@query
def health_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.health_buckets(X.analyses(spark, sf))


@query
def report_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.report_summary(X.analyses(spark, sf), X.analysis_files(spark, sf))


@query
def report_fix_first(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.report_fix_first(X.analysis_files(spark, sf))


@query
def action_texts(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.action_texts(X.analysis_files(spark, sf))


@query
def report_all_files(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.report_all_files(X.analysis_files(spark, sf))


@query
def file_report(spark: SparkSession, sf: str) -> DataFrame:
    """The whole analysis without a model: neutral scores, churn, and texts from metrics alone."""
    out = analyze.analyze(X.src_files(spark, sf), X.file_commits(spark, sf), None, None)
    return out.select(
        "repo", "path", "rank", "risk_score", "risk_level", "metrics.loc", "metrics.cyclomatic_complexity",
        "metrics.commit_count", "metrics.contributor_count", "ai_explanation", "test_suggestions",
    )


@query
def repository_report(spark: SparkSession, sf: str) -> DataFrame:
    """Address, file count, mean risk and tier of each repository, from scored listings."""
    scored = _listed_scores(spark, sf)
    return rollup.repository_risk(scored, "repo").withColumn("overall_risk", r6("overall_risk"))


# --- top-k and rankings ---------------------------------------------------------------------------


@query
def top_files_by_size(spark: SparkSession, sf: str) -> DataFrame:
    size = F.when(F.col("doc_id") % 6 != 0, F.col("size"))
    files = X.src_files(spark, sf).select("repo", "path", size.alias("size"))
    return analyze.select_files(files)


@query
def rank_by_risk(spark: SparkSession, sf: str) -> DataFrame:
    files = X.analysis_files(spark, sf).select("analysis_id", "file_path", "risk_score")
    return rollup.rank_by_risk(files)


@query
def latest_analyses(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.latest_analyses(X.analyses(spark, sf)).select("user_id", "rank", "analysis_id", day("created_at"))


@query
def history(spark: SparkSession, sf: str) -> DataFrame:
    out = rollup.history(X.analyses(spark, sf), X.analysis_files(spark, sf))
    return out.select("user_id", "position", "analysis_id", day("created_at"), "risk_pct", "high_count",
                      "medium_count", "low_count")


@query
def risk_by_component(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.risk_by_component(X.analyses(spark, sf))


@query
def recent_risky_files(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.recent_risky_files(X.analyses(spark, sf), X.analysis_files(spark, sf))


# --- evaluation -----------------------------------------------------------------------------------


@query
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.stratified_split(X.split_rows(spark, sf))


@query
def stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.stratified_folds(X.split_rows(spark, sf))


@query
def class_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.class_distribution(X.scored(spark, sf)).withColumn("pct", r6("pct"))


@query
def feature_stats(spark: SparkSession, sf: str) -> DataFrame:
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    out = evaluate.feature_stats(X.table(spark, sf, "lineitem").select(*names), names)
    return out.select("feature", *[F.round(c, 4).alias(c) for c in ("min", "max", "mean", "std", "median")])


def _rounded(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: r6(n) for n in names})


@query
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.threshold_sweep(X.scored(spark, sf), ["model"])
    return _rounded(out, "threshold", "accuracy", "precision", "recall", "f1")


@query
def best_threshold(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.best_threshold(evaluate.threshold_sweep(X.scored(spark, sf), ["model", "fold"]), ["model", "fold"])
    return _rounded(out, "threshold", "f1")


@query
def classification_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.rates(evaluate.confusion(X.scored(spark, sf), ["model", "fold"]))
    return _rounded(out, "accuracy", "precision", "recall", "f1").drop("tn", "fp", "fn", "tp")


@query
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.confusion(X.scored(spark, sf), ["model", "fold"], 0.7)


@query
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.ranking_measures(X.scored(spark, sf), ["model", "fold"]).select("model", "fold", r6("roc_auc").alias("roc_auc"))


@query
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.ranking_measures(X.scored(spark, sf), ["model", "fold"]).select("model", "fold", r6("pr_auc").alias("pr_auc"))


@query
def brier(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluate.brier(X.scored(spark, sf), ["model", "fold"]), "brier")


@query
def cv_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.cv_means(evaluate.all_measures(X.scored(spark, sf), ["model", "fold"]), ["model"])
    return _rounded(out, "accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "brier")


@query
def calibration_bins(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluate.calibration_bins(X.scored(spark, sf), ["model"]), "mean_predicted", "observed_rate")


# --- training -------------------------------------------------------------------------------------


@query
def baseline_majority(spark: SparkSession, sf: str) -> DataFrame:
    """Measures of the majority and the random baseline, fitted and scored on all rows."""
    rows = X.split_rows(spark, sf).withColumnRenamed("id", "doc_id")
    scores = []
    for name, model in (("majority", train.Majority()), ("random", train.RandomGuess())):
        apply, _ = model.fit(rows)
        scores.append(apply(rows).withColumn("model", F.lit(name)))
    out = evaluate.all_measures(scores[0].unionByName(scores[1]), ["model"])
    return _rounded(out, "accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "brier")


@query
def baselines(spark: SparkSession, sf: str) -> DataFrame:
    folded, _ = models.development(spark, sf)
    return train.cross_validate(folded, train.baselines(), models.store(spark))


@query
def gbt_grid(spark: SparkSession, sf: str) -> DataFrame:
    folded, _ = models.development(spark, sf)
    grid = train.boosted_grid()
    trees = F.create_map(*[F.lit(x) for name, m in grid.items() for x in (name, m.config["trees"])])
    return train.cross_validate(folded, grid, models.store(spark)).withColumn("trees", trees[F.col("model")])


def _final_scores(spark: SparkSession, sf: str) -> DataFrame:
    folded, _ = models.development(spark, sf)
    return train.out_of_fold(folded, {"final": train.Boosted(C.BOOSTED_CONFIGS[C.FINAL_CONFIG])}, models.store(spark))


@query
def oof_scores(spark: SparkSession, sf: str) -> DataFrame:
    """One score for each development row, by the fit of the other folds; scores are the logistic of margins."""
    logistic = F.abs(1 / (1 + F.exp(-F.col("margin"))) - F.col("score")) < 1e-9
    return _final_scores(spark, sf).select("doc_id", "label", "fold", logistic.alias("scored"))


@query
def holdout_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and measures' ranges on the held-out part, at both thresholds."""
    out = train.holdout(*models.development(spark, sf), models.store(spark))
    ranges = [F.col(c).between(0, 1) for c in artifacts.MEASURES]
    return out.select(
        "at", (F.col("tn") + F.col("fp")).alias("negatives"), (F.col("fn") + F.col("tp")).alias("positives"),
        F.when(F.col("at") == "standard", F.col("threshold")).alias("given_threshold"),
        reduce(lambda a, b: a & b, ranges, F.col("threshold").between(0.05, 0.95)).alias("in_range"),
    )


@query
def feature_schema(spark: SparkSession, sf: str) -> DataFrame:
    frame = models.training_data(spark, sf)
    _, leaves = models.model_and_leaves(spark, sf)
    nodes = shap.tree_nodes(spark, models.model_path(spark, sf))
    return _schema_rows(artifacts.feature_schema(frame, nodes, shap.global_importance(shap.tree_shap(frame, leaves))))


@query
def shap_global(spark: SparkSession, sf: str) -> DataFrame:
    """Mean sizes of the published forest's contributions over the labelled files."""
    _, leaves = models.given_forest(spark, sf)
    out = shap.global_importance(shap.tree_shap(models.training_data(spark, sf), leaves))
    return _rounded(out, "mean_abs_shap", "shap_share")


@query
def gain_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Mean gains of the published forest's splits."""
    return _rounded(shap.gain_importance(X.forest_nodes(spark, sf)), "mean_gain", "gain_share")


@query
def class_weight_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return train.class_weight_sweep(models.development(spark, sf)[0], models.store(spark))


@query
def feature_ablation(spark: SparkSession, sf: str) -> DataFrame:
    return train.feature_ablation(models.development(spark, sf)[0], models.store(spark))


@query
def permutation_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Of the published forest, over all labelled files."""
    out = train.permutation_importance(models.training_data(spark, sf), models.given_forest(spark, sf)[0])
    return _rounded(out, "intact_auc", "roc_auc", "importance")


@query
def platt_calibration(spark: SparkSession, sf: str) -> DataFrame:
    return train.platt_calibration(_final_scores(spark, sf))


# --- artefacts: after the comparisons, whose fits they share --------------------------------------


def _trained(spark: SparkSession, sf: str) -> str:
    folder = new_path(spark, "artifacts")
    training.run(models.training_data(spark, sf), folder, models.store(spark), models.partitions(spark, sf))
    return artifacts.current(spark, folder)


_artifact_folders: dict[tuple[str, str], str] = {}


def artifact_folder(spark: SparkSession, sf: str) -> str:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _artifact_folders:
        _artifact_folders[key] = _trained(spark, sf)
    return _artifact_folders[key]


def _schema_rows(schema: DataFrame) -> DataFrame:
    """Statistics and bounds, and whether the importances are shares."""
    whole = lambda c: F.abs(F.sum(c).over(Window.partitionBy()) - 1) < 1e-9  # noqa: E731  (ten rows)
    return schema.select(
        F.col("feature_order").cast("int").alias("feature_order"), "name", "description", "bound_min", "bound_max",
        *[r6(c).alias(c) for c in ("min", "max", "mean", "std", "median")],
        (F.col("gain_share").between(0, 1) & F.col("shap_share").between(0, 1) & whole("gain_share") & whole("shap_share")).alias("shares"),
    )


@query
def write_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """The training job, then the feature schema it published."""
    return _schema_rows(spark.read.json(f"{artifact_folder(spark, sf)}/feature_schema"))


@query
def model_info(spark: SparkSession, sf: str) -> DataFrame:
    """How many entries each document has, and what the metadata say of the rows."""
    info = artifacts.model_info(spark, artifact_folder(spark, sf))
    entries = F.from_json("document", "array<struct<training_rows: bigint, test_rows: bigint, total_rows: bigint, trees: int>>")
    one = F.get(entries, F.lit(0))
    return info.select("part", F.size(entries).alias("entries"), one.training_rows.alias("training_rows"), one.test_rows.alias("test_rows"),
                       one.total_rows.alias("total_rows"), one.trees.alias("trees"))


@query
def artifact_checks(spark: SparkSession, sf: str) -> DataFrame:
    return artifacts.artifact_checks(spark, artifact_folder(spark, sf))
