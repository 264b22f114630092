"""Scores, tiers, recommendations and explanation texts."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from faultgauge import constants as C
from faultgauge.functions.paths import base_name
from faultgauge.functions.rounding import clamp01, round_half_even, tenths_text
from faultgauge.operators.forest import Forest


def risk_tier(score: Column) -> Column:
    return F.when(score >= C.HIGH_FROM, "HIGH").when(score >= C.MEDIUM_FROM, "MEDIUM").otherwise("LOW")


def final_score(probability: Column) -> Column:
    """The probability where there is one, else the neutral score, within [0, 1]."""
    return clamp01(F.coalesce(probability, F.lit(C.DEFAULT_SCORE)))


def score(rows: DataFrame, model: GBTClassificationModel | Forest | None) -> DataFrame:
    """Add ``risk_score`` and ``risk_level`` to assembled rows. Without a model every score is neutral.

    The margin of the boosted trees is kept for the explanation check. A forest needs the scaled features alone.
    """
    if isinstance(model, Forest):
        scored = model.transform(rows).withColumn("risk_score", final_score(F.col("probability"))).drop("probability")
    elif model is None:
        scored = rows.withColumn("risk_score", final_score(F.lit(None).cast("double"))).withColumn(
            "margin", F.lit(0.0)
        )
    else:
        scored = (
            model.transform(rows)
            .withColumn("risk_score", final_score(vector_to_array("probability")[1]))
            .withColumn("margin", 2 * vector_to_array("rawPrediction")[1])
            .drop("rawPrediction", "probability", "prediction")
        )
    return scored.withColumn("risk_level", risk_tier(F.col("risk_score")))


def told(sentence: tuple[str, str], value: Column) -> Column:
    """A sentence with a value between its two parts."""
    return F.concat(F.lit(sentence[0]), value, F.lit(sentence[1]))


def recommendations(cyclo: Column, loc: Column, branches: Column, difficulty: Column, fan_out: Column) -> Column:
    """Up to three advices from measured values; the default when none applies."""
    lines, whole = F.regexp_replace(loc.cast("string"), r"\.0$", ""), lambda x: x.cast("bigint").cast("string")
    advice = F.array_compact(
        F.array(
            F.when(cyclo > 15, told(C.ADVICE_NESTED, tenths_text(cyclo))).when(cyclo > 8, told(C.ADVICE_COMPLEX, tenths_text(cyclo))),
            F.when(loc > 400, told(C.ADVICE_SPLIT, lines)).when(loc > 200, told(C.ADVICE_BLOAT, lines)),
            F.when(branches > 20, told(C.ADVICE_BRANCHES, whole(branches))),
            F.when(difficulty > 30, told(C.ADVICE_DIFFICULTY, tenths_text(difficulty))),
            F.when(fan_out > 15, told(C.ADVICE_COUPLING, whole(fan_out))),
        )
    )
    return F.when(F.size(advice) == 0, F.array(F.lit(C.DEFAULT_RECOMMENDATION))).otherwise(
        F.slice(advice, 1, C.TOP_RECOMMENDATIONS)
    )


def metric_recommendations(raw: str = "raw") -> Column:
    metric = lambda name: F.col(f"{raw}.{name}")
    return recommendations(
        metric("cyclomatic_complexity"), metric("loc"), metric("branch_count"), metric("difficulty"),
        metric("int_fan_out"),
    )


def evidence_phrase(feature: Column, loc: Column, cyclo: Column, branches: Column, volume: Column) -> Column:
    return (
        F.when(feature == "CYCLO", told(C.EVIDENCE_COMPLEX, tenths_text(cyclo)))
        .when(feature == "LOC", told(C.EVIDENCE_SIZE, loc.cast("string")))
        .when(feature == "BRANCH_COUNT", told(C.EVIDENCE_BRANCHES, branches.cast("bigint").cast("string")))
        .when(feature.isin("VOLUME", "LENGTH"), told(C.EVIDENCE_VOLUME, round_half_even(volume).cast("string")))
        .when(feature.isin("NUM_OPERATORS", "NUM_OPERANDS"), F.lit(C.EVIDENCE_DENSITY))
    )


def why_text(
    path: Column, score: Column, factors: Column, loc: Column, cyclo: Column, branches: Column, volume: Column
) -> Column:
    """One sentence of evidence from the first two factors, or from the metrics when they name none."""
    first_two = F.slice(F.coalesce(F.transform(factors, lambda f: f["feature"]), F.array().cast("array<string>")), 1, 2)
    from_factors = F.array_compact(
        F.transform(first_two, lambda f: evidence_phrase(f, loc, cyclo, branches, volume))
    )
    from_metrics = F.array_compact(
        F.array(
            F.when(cyclo > 10, told(C.EVIDENCE_NESTED, tenths_text(cyclo))),
            F.when(loc > 300, told(C.EVIDENCE_LARGE, loc.cast("string"))),
        )
    )
    evidence = (
        F.when(F.size(from_factors) > 0, from_factors)
        .when(F.size(from_metrics) > 0, from_metrics)
        .otherwise(F.array(F.lit(C.GENERIC_EVIDENCE)))
    )
    return F.concat(
        told(C.EXPLANATION_FILE, file_label(path)), told(C.EXPLANATION_SCORE, round_half_even(score * 100).cast("string")),
        F.array_join(evidence, ", and "), F.lit(". " + C.EXPLANATION_CLOSE),
    )


def file_label(path: Column) -> Column:
    return F.when(F.coalesce(path, F.lit("")) == "", "this file").otherwise(base_name(path))


def suggestion_text(path: Column, advice: Column) -> Column:
    return F.when(F.size(F.coalesce(advice, F.array().cast("array<string>"))) > 0, F.array_join(advice, "; ")).otherwise(
        told(C.DEFAULT_SUGGESTION, file_label(path))
    )
