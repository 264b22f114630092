"""Tables in the shape the engine reads, derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultgauge.operators.scoring import risk_tier
from faultgauge.session import spread

EXTENSION_CYCLE = ["py", "js", "ts", "tsx", "jsx", "java", "go", "cpp", "c", "cs", "php", "rb", "xyz"]
BLANK_TEXT = "  \n\t\n "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, name).select(key, *columns), key)


def file_path() -> Column:
    """The path of a document's file; negative ids belong to files that hold nothing."""
    doc = F.abs("doc_id")
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSION_CYCLE]), (doc % 13 + 1).cast("int"))
    name = F.concat(F.lit("f"), doc.cast("string"), F.lit("."), ext)
    folder = F.concat(F.lit("d"), (doc % 7).cast("string"), F.lit("/"))
    path = F.when(doc % 11 == 0, name).otherwise(F.concat(folder, name))
    return F.when(F.col("doc_id") < 0, F.concat(F.lit("void/"), path)).otherwise(path)


def src_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file per document: listing columns and content."""
    return text_table(spark, sf_dir, "documents", "doc_id", "text", "source", "n_chars").select(
        "doc_id", F.col("source").alias("repo"), file_path().alias("path"), F.col("n_chars").alias("size"),
        F.col("text").alias("content"),
    )


def with_blank_files(files: DataFrame) -> DataFrame:
    """``src_files`` and, for every 17th of them, one more file that holds white space only."""
    more = files.filter(F.col("doc_id") % 17 == 0).withColumn("doc_id", -1 - F.col("doc_id"))
    return files.unionByName(more.withColumns({"path": file_path(), "content": F.lit(BLANK_TEXT)}))


def html_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_table(spark, sf_dir, "pages", "page_id", "url", "html").select(
        "page_id", F.col("url").alias("path"), F.col("html").alias("content")
    )


def file_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo, path, event_id, commit`` with the author inside; commits go round all documents, every 13th has no author."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo"), file_path().alias("path"))
    email = F.concat(F.col("user_id").cast("string"), F.lit("@example.org"))
    author = F.when(F.col("event_id") % 13 != 0, F.struct(email.alias("email")))
    events = table(spark, sf_dir, "events").select(
        "event_id", (F.col("event_id") % F.lit(documents.count())).alias("doc_id"),
        F.struct(author.alias("author"), F.col("ts").alias("date")).alias("commit"),
    )
    return events.join(documents, "doc_id").select("repo", "path", "event_id", "commit")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.concat(F.lower(F.col("c_mktsegment")), F.lit("."), (F.col("c_custkey") % 400).cast("string"),
                 F.lit("@example.com")).alias("email"),
        F.col("c_name").alias("name"),
    )


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored analysis per order."""
    risk = F.col("o_totalprice") % 100 / 100
    priority = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("analysis_id"),
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderkey") % 50 == 0, F.lit("owner/"))
        .otherwise(F.concat(F.col("o_orderstatus"), F.lit("/"), priority))
        .alias("repository_name"),
        F.col("o_orderdate").alias("created_at"),
        risk.alias("overall_risk"),
        risk_tier(risk).alias("risk_level"),
    )


def analysis_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored file result per line item. Loc and complexity are left out on some rows."""
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSION_CYCLE]), (part % 13 + 1).cast("int"))
    path = F.concat(
        F.when(part % 11 == 0, "").otherwise(F.concat(F.col("l_returnflag"), F.lit("/"))),
        F.when(part % 5 == 0, F.concat(F.col("l_linestatus"), F.lit("/"))).otherwise(""),
        F.lit("p"), part.cast("string"), F.lit("-"), line.cast("string"), F.lit("-"),
        F.col("l_suppkey").cast("string"), F.lit("."), ext,
    )
    score = F.col("l_quantity") / 50
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("analysis_id"),
        path.alias("file_path"),
        score.alias("risk_score"),
        risk_tier(score).alias("risk_level"),
        F.struct(
            F.when(part % 9 != 0, F.floor(F.col("l_extendedprice") / 100)).alias("loc"),
            F.when(part % 8 != 0, 1 + line * F.col("l_tax") * 50).alias("cyclomatic_complexity"),
            F.when(part % 7 != 0, F.col("l_suppkey")).alias("commit_count"),
        ).alias("metrics"),
        F.when((part % 3 == 0) & (score >= 0.4), F.concat(F.lit("risk in part "), part.cast("string")))
        .alias("ai_explanation"),
        F.when(part % 4 == 0, F.concat(F.lit("test part "), part.cast("string")))
        .when(part % 4 == 1, F.lit(""))
        .alias("test_suggestions"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with many ties, for evaluation measures."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("model"),
        (F.col("l_orderkey") % 5).alias("fold"),
        (F.col("l_quantity") / 50).alias("score"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("label")
    )


def labelled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a quality label, as files without a path (read as generic code)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("label"))
    documents = text_table(spark, sf_dir, "documents", "doc_id", "text").withColumnRenamed("text", "content")
    return documents.join(labels, "doc_id").withColumn("path", F.lit(""))


def owned_name() -> Column:
    return F.concat(F.lit("own/"), F.col("repo"))


def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src_files`` under the names that requests give; one repository holds white space, one no supported file."""
    files = src_files(spark, sf_dir)
    return files.withColumns({
        "repo": owned_name(), "content": F.when(F.col("repo") == "src7", BLANK_TEXT).otherwise(F.col("content")),
        "path": F.when(F.col("repo") == "src9", F.concat("path", F.lit(".xyz"))).otherwise(F.col("path")),
    })


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``analysis_id, user_id, url``: a request for each nation; some name repositories that are not listed, or none."""
    k = F.col("n_nationkey")
    name = F.concat(F.lit("own/src"), k.cast("string"))
    url = (
        F.when(k % 6 == 0, F.concat(F.lit("https://github.com/"), name)).when(k % 6 == 1, F.concat(name, F.lit(".git")))
        .when(k % 6 == 2, F.concat(F.lit("github.com/"), name)).when(k == 15, "nothing").when(k == 21, "own/src0").otherwise(name)
    )
    return table(spark, sf_dir, "nation").select(k.alias("analysis_id"), F.col("n_regionkey").alias("user_id"), url.alias("url"))


def forest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest of the shape that training writes: a tree of two splits in a row for each nation.

    All weights, values and shares of rows are small fractions of powers of two, so sums do not depend on their order.
    """
    k, r = F.col("n_nationkey"), F.col("n_regionkey")

    def node(number: int, covered: int, left: int, value: Column, feature: Column, threshold: Column) -> Column:
        inner = left >= 0
        return F.struct(
            F.lit(number).alias("node"), (F.lit(0.0) if inner else value).cast("double").alias("prediction"),
            F.lit(float(covered)).alias("covered"), ((k * 5 + number) % 7 + 1 if inner else F.lit(-1)).cast("double").alias("gain"),
            F.lit(left).alias("left"), F.lit(left + 1 if inner else -1).alias("right"),
            (feature if inner else F.lit(-1)).cast("int").alias("feature"), (threshold if inner else F.lit(0)).cast("double").alias("threshold"),
        )

    value = lambda n: ((k * 11 + r * 3 + n * 5) % 13 - 6) / 16
    split = lambda n: ((k * 3 + n * (r + 2)) % 10, ((k * 7 + n * 9) % 20 + 1) / 64)
    shape = [(64, 1), (16, 3), (48, 5), (4, -1), (12, -1), (12, -1), (36, -1)]
    nodes = F.array(*[node(n, covered, left, value(n), *split(n)) for n, (covered, left) in enumerate(shape)])
    nations = table(spark, sf_dir, "nation").select(k, r)
    return nations.select(k.cast("int").alias("tree"), F.lit(0.125).alias("weight"), F.inline(nodes))


def python_sources(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    """Python, one file per document: a function with one branch per run of letters, digits and underscores.

    If ``broken``, every third document keeps an unclosed bracket at the end, so that it does not parse.
    """
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[\p{L}\p{N}_]++"), F.lit(0))
    branch = lambda w: F.concat(
        F.lit("    if '"), w, F.lit("' in rows and seen >= 0:\n        seen = seen + len('"), w, F.lit("')\n")
    )
    return text_table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id",
        F.concat(F.lit("gen/m"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
        F.concat(
            F.lit("def scan_"), F.col("doc_id").cast("string"), F.lit("(rows):\n    seen = 0\n"),
            F.array_join(F.transform(words, branch), ""),
            F.lit("    return seen\n"),
            F.when(F.lit(broken) & (F.col("doc_id") % 3 == 0), F.lit("rest = (\n")).otherwise(""),
        ).alias("content"),
    )


def metric_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics as maps of text, in mixed spellings; some rows hold bad, endless or missing values.

    Kinds 8 and 9 have a bad value under a spelling that a later one replaces, and two bad ones, of which the
    later belongs to the earlier feature; kind 10 has a null.
    """
    k = F.col("o_orderkey")
    kind = k % 12
    num = lambda m: (k * m % 1000).cast("string")
    entries = F.array(
        F.struct(F.lit("loc"), F.when(kind == 1, "abc").when(kind == 8, "NaN").otherwise(num(3))),
        F.struct(F.lit("CYCLO"), num(5)),
        F.struct(F.lit("cyclomatic_complexity"), F.when(kind == 2, "NaN").otherwise(num(7))),
        F.struct(F.lit("length"), num(11)),
        F.struct(F.lit("VOLUME"), F.when(kind == 3, "Infinity").otherwise(num(13))),
        F.struct(F.lit("difficulty"), F.when(kind == 4, "-Infinity").otherwise(num(17))),
        F.struct(F.lit("int_fan_in"), F.when(kind != 10, num(19))),
        F.struct(F.when(kind.isin(5, 6), "other").otherwise("int_fan_out"), num(23)),
        F.struct(F.lit("NUM_OPERATORS"), num(29)),
        F.struct(F.when(kind == 6, "another").otherwise("num_operands"), num(31)),
        F.struct(F.lit("branch_count"), F.when(kind == 9, "NaN").otherwise(num(37))),
        F.struct(F.when(kind.isin(7, 8, 9), "LOC").otherwise("unused"), F.when(kind == 9, "abc").when(kind.isin(7, 8), "12.5").otherwise("x")),
    )
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.map_from_entries(entries).alias("metrics"))
