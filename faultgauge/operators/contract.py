"""The ten-feature contract: aliases, checks, scaling, assembly."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultgauge import constants as C
from faultgauge.functions.pinned import pinned
from faultgauge.functions.rounding import clamp01
from faultgauge.operators.metrics import METRIC_COLUMNS


def alias_features(rows: DataFrame, metrics: str = "metrics") -> DataFrame:
    """Spread a map of metrics into the ten features. Of several spellings, the last one seen wins."""
    entries = F.map_entries(F.col(metrics))

    def last_seen(feature: str) -> Column:
        hits = F.filter(entries, lambda e: e["key"].isin(C.FEATURE_ALIASES[feature]))
        return F.try_element_at(hits, F.lit(-1))["value"]

    return rows.select(
        *[F.col(c) for c in rows.columns if c != metrics], *[last_seen(f).alias(f) for f in C.FEATURES]
    )


def feature_bounds(spark: SparkSession, schema_path: str | None = None) -> DataFrame:
    """Bounds of the ten features, from a written schema where there is one, else the defaults."""
    defaults = spark.createDataFrame(
        [(i, f, *C.SCALING_BOUNDS[f][:2]) for i, f in enumerate(C.FEATURES)],
        "feature_order int, feature string, default_min double, default_max double",
    )
    if schema_path is None:
        return defaults.withColumnsRenamed({"default_min": "bound_min", "default_max": "bound_max"})
    found = spark.read.schema("name string, bound_min double, bound_max double").json(schema_path)
    # a row for each of the ten names at most; of names written twice, the widest bounds
    written = found.filter(F.col("name").isin(C.FEATURES)).groupBy("name").agg(F.min("bound_min").alias("bound_min"), F.max("bound_max").alias("bound_max"))
    return defaults.join(F.broadcast(written), defaults.feature == written.name, "left").select(
        "feature_order",
        "feature",
        F.coalesce("bound_min", "default_min").alias("bound_min"),
        F.coalesce("bound_max", "default_max").alias("bound_max"),
    )


def bounds_of(bounds: DataFrame | None = None) -> dict[str, tuple[float, float]]:
    """The ten bounds as constants for expressions; ten rows, whatever the data."""
    if bounds is None:
        return {f: C.SCALING_BOUNDS[f][:2] for f in C.FEATURES}
    return {r.feature: (r.bound_min, r.bound_max) for r in bounds.collect()}


def _number(feature: str) -> Column:
    return F.col(feature).try_cast("double")


def contract_error() -> Column:
    """The first failed check of a row, or null. Bad values come before missing names.

    Numbers are checked in feature order, then the names that are missing are listed in that order.
    """
    checks = []
    for f in C.FEATURES:
        x = _number(f)
        checks.append(
            F.when(F.col(f).isNotNull() & x.isNull(),
                   F.concat(F.lit(f"Feature '{f}' has non-numeric value: "), F.col(f).cast("string")))
            .when(F.isnan(x), F.lit(f"Feature '{f}' is NaN. Invalid numeric input."))
            .when(F.abs(x) == float("inf"), F.lit(f"Feature '{f}' is Infinity. Invalid numeric input."))
        )
    names = F.array_except(
        F.array(*[F.lit(f"'{f}'") for f in C.FEATURES]),
        F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), f"'{f}'") for f in C.FEATURES])),
    )
    missing = F.when(
        F.size(names) > 0, F.concat(F.lit(C.MISSING_FEATURES_PREFIX + "["), F.array_join(names, ", "), F.lit("]"))
    )
    return F.coalesce(*checks, missing)


def validate(rows: DataFrame) -> DataFrame:
    """Add ``error``: null where the row satisfies the contract."""
    return rows.withColumn("error", pinned(contract_error()))


def scaled(feature: str, bounds: dict[str, tuple[float, float]]) -> Column:
    low, high = bounds.get(feature, (0.0, 1.0))
    x = _number(feature)
    return clamp01((x - low) / (high - low) if high > low else x)


def scale_features(rows: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Replace the ten raw features by their scaled values in [0, 1]."""
    limits = bounds_of(bounds)
    return rows.withColumns({f: scaled(f, limits) for f in C.FEATURES})


def assemble(rows: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Add the model input ``features``: the scaled values in contract order, at float precision.

    A row that failed the contract has no values; zeros stand in, and its score is not used.
    """
    names = features or C.FEATURES
    inputs = [f"_{f}" for f in names]
    single = rows.withColumns({i: F.coalesce(F.col(f), F.lit(0.0)).cast("float") for i, f in zip(inputs, names)})
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(single).drop(*inputs)


#: An entry's text with a trailing type letter, which reads as a number in Java only.
_TYPED = r"(?i)^\s*[+-]?[0-9.][0-9.e+-]*[df]\s*$"


def fold_entries(entries: Column) -> Column:
    """``error`` and ``values`` (ten numbers, null where not seen) from a list of (key, value), in order of arrival.

    Every entry that spells a feature is checked when its turn comes, also one that a later spelling of the same
    feature replaces. The first bad one stops the fold: what follows is not looked at.
    """
    place = F.create_map(*[F.lit(x) for i, f in enumerate(C.FEATURES) for a in C.FEATURE_ALIASES[f] for x in (a, i)])
    names = F.array(*[F.lit(f) for f in C.FEATURES])

    def step(state: Column, entry: Column) -> Column:
        at = F.try_element_at(place, entry["key"])
        text = entry["value"].cast("string")
        number = F.when(~text.rlike(_TYPED), text.try_cast("double"))
        told = lambda what: F.concat(F.lit("Feature '"), F.get(names, at), F.lit("' "), what)
        error = (
            F.when(number.isNull(), told(F.concat(F.lit("has non-numeric value: "), F.coalesce(text, F.lit("None")))))
            .when(F.isnan(number), told(F.lit("is NaN. Invalid numeric input.")))
            .when(F.abs(number) == float("inf"), told(F.lit("is Infinity. Invalid numeric input.")))
        )
        seen = F.transform(state["values"], lambda v, i: F.when(i == at, number).otherwise(v))
        return F.when(state["error"].isNotNull() | at.isNull(), state).otherwise(F.struct(error.alias("error"), seen.alias("values")))

    nothing = F.struct(F.lit(None).cast("string").alias("error"), F.array_repeat(F.lit(None).cast("double"), len(C.FEATURES)).alias("values"))
    return F.aggregate(entries, nothing, step)


def missing_error(values: Column) -> Column:
    """The names without a value, in contract order, or null."""
    quoted = F.array(*[F.lit(f"'{f}'") for f in C.FEATURES])
    names = F.filter(quoted, lambda _, i: F.get(values, i).isNull())
    return F.when(F.size(names) > 0, F.concat(F.lit(C.MISSING_FEATURES_PREFIX + "["), F.array_join(names, ", "), F.lit("]")))


def contract_of_map(rows: DataFrame, metrics: str = "metrics", limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Validated, scaled features of rows with a map of metrics, and what texts need of them in the struct ``raw``.

    A null map has no entries. In ``raw``, the plain spelling of a metric comes before the feature's name, and a
    metric that is not there has the value of an empty file.
    """
    entries = F.coalesce(F.map_entries(F.col(metrics)), F.map_entries(F.create_map().cast(rows.schema[metrics].dataType)))
    others = [c for c in rows.columns if c != metrics]
    folded = rows.select(*others, F.col(metrics).alias("_map"), pinned(fold_entries(entries)).alias("_fold"))
    values = F.col("_fold.values")

    def given(feature: str, empty: float) -> Column:
        spellings = (C.METRIC_OF_FEATURE[feature], feature)
        return F.coalesce(*[F.try_element_at(F.col("_map"), F.lit(s)).try_cast("double") for s in spellings], F.lit(empty))

    raw = F.struct(
        given("LOC", 0.0).alias("loc"), given("CYCLO", 1.0).alias("cyclomatic_complexity"), given("BRANCH_COUNT", 0.0).alias("branch_count"),
        given("DIFFICULTY", 0.0).alias("difficulty"), given("INT_FAN_OUT", 0.0).alias("int_fan_out"), given("VOLUME", 0.0).alias("volume"),
    )
    checked = folded.select(
        *others, raw.alias("raw"), F.coalesce(F.col("_fold.error"), missing_error(values)).alias("error"),
        *[F.get(values, F.lit(i)).alias(f) for i, f in enumerate(C.FEATURES)],
    )
    ok = F.col("error").isNull()
    return checked.withColumns({f: pinned(F.when(ok, scaled(f, limits or bounds_of()))) for f in C.FEATURES})


def contract_row(metrics: DataFrame, limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Validated, scaled features of measured files, with the measured values in the struct ``raw``.

    ``limits`` are the scaling bounds, of a written schema or the defaults.

    Rows that fail keep null features and their error. (Feature and metric names differ only in case,
    which Spark does not tell apart, so the two sets cannot be columns side by side.)
    """
    others = [F.col(c) for c in metrics.columns if c not in METRIC_COLUMNS]
    raw = metrics.select(*others, F.struct(*METRIC_COLUMNS).alias("raw"))
    named = raw.withColumns({f: F.col(f"raw.{m}") for f, m in C.METRIC_OF_FEATURE.items()})
    checked = validate(named)
    limits = limits or bounds_of()
    ok = F.col("error").isNull()
    return checked.withColumns({f: pinned(F.when(ok, scaled(f, limits))) for f in C.FEATURES})
