"""Services for single subjects, as jobs over a table of requests of any size."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.expressions import add_all

# --- Fixed values: risk tiers and report texts ----------------------------------
LOW_BELOW = 0.3
MODERATE_BELOW = 0.7
TIERS = {
    "Low Risk": "Routine monitoring recommended. Maintain healthy lifestyle habits.",
    "Moderate Risk": "Further diagnostic tests advised. Schedule a follow-up consultation.",
    "High Risk": (
        "Immediate medical attention required. Urgent nephrologist referral suggested."
    ),
}
TIER_COLORS = {"Low Risk": "#4D96FF", "Moderate Risk": "#FFD93D", "High Risk": "#FF6B6B"}
TIER_ICONS = {"Low Risk": "✅", "Moderate Risk": "⚠️", "High Risk": "🚨"}
INCREASES, REDUCES = "Increases Risk", "Reduces Risk"
DISCLAIMER = (
    "Disclaimer: This report is generated by an AI research system for educational and "
    "clinical decision support purposes. It should not replace professional medical judgment. "
    "Final diagnosis must be confirmed by a licensed nephrologist."
)

Score = Callable[[DataFrame], DataFrame]


def fill_missing(requests: DataFrame, means: dict[str, float]) -> DataFrame:
    """Replace unspecified features by the population mean; count them in ``n_filled``."""
    missing = add_all([F.col(c).isNull().cast("int") for c in means])
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in means.items()}
    return requests.withColumn("n_filled", missing).withColumns(filled)


def _per_tier(p: Column, texts: dict[str, str]) -> Column:
    low, moderate, high = (texts[name] for name in TIERS)
    return F.when(p < LOW_BELOW, low).when(p < MODERATE_BELOW, moderate).otherwise(high)


def assessment(p: Column) -> Column:
    """Risk tier as a struct of level, action, color and icon."""
    return F.struct(
        _per_tier(p, {name: name for name in TIERS}).alias("level"),
        _per_tier(p, TIERS).alias("action"),
        _per_tier(p, TIER_COLORS).alias("color"),
        _per_tier(p, TIER_ICONS).alias("icon"),
    )


def assess(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add the tier and the decision at a tuned threshold."""
    return scored.withColumn("assessment", assessment(F.col("p"))).withColumn(
        "decision", (F.col("p") >= threshold).cast("int")
    )


def counterfactuals(requests: DataFrame, id_col: str, features, shifts: dict[str, float], score: Score) -> DataFrame:
    """Change of risk when one feature moves by a fixed amount, the others unchanged.

    Shifts of features the requests do not have are skipped.  All variants of all
    requests, including the unchanged one, are scored in one pass.
    """
    features = list(features)
    used = {f: d for f, d in shifts.items() if f in features}
    variants = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.lit(float(d)).alias("delta")) for f, d in used.items()]
    )
    base = score(requests.select(id_col, *features)).withColumnRenamed("p", "base_p")
    wide = base.select(id_col, "base_p", *features, F.explode(variants).alias("_v"))
    shifted = {
        f: F.when(F.col("_v.feature") == f, F.col(f) + F.col("_v.delta")).otherwise(F.col(f)) for f in used
    }
    moved = score(wide.withColumns(shifted))
    change = F.col("p") - F.col("base_p")
    return moved.select(
        id_col,
        F.col("_v.feature").alias("feature"),
        F.col("_v.delta").alias("delta"),
        F.round("base_p", 6).alias("base_p"),
        F.round(change * 100, 4).alias("risk_change_percent"),
    )


def bound_violations(requests: DataFrame, id_col: str, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """One row per given value outside its allowed range."""
    checks = [
        F.struct(
            F.lit(f).alias("feature"),
            F.col(f).cast("double").alias("value"),
            F.lit(float(lo)).alias("lower"),
            F.lit(float(hi)).alias("upper"),
        )
        for f, (lo, hi) in bounds.items()
        if f in requests.columns
    ]
    exploded = requests.select(id_col, F.explode(F.array(*checks)).alias("_c")).select(id_col, "_c.*")
    return exploded.where((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")))


def factor_lines(factors: DataFrame, id_col: str) -> DataFrame:
    """Top factors of a row as one ordered array of (rank, feature, effect, magnitude).

    ``factors`` holds a fixed number of rows per id, so the arrays are small.
    """
    effect = F.when(F.col("phi") > 0, INCREASES).otherwise(REDUCES)
    line = F.struct(
        F.col("factor_rank").alias("rank"),
        "feature",
        effect.alias("effect"),
        F.round(F.abs("phi"), 4).alias("magnitude"),
    )
    return factors.groupBy(id_col).agg(F.array_sort(F.collect_list(line)).alias("factors"))


def report_records(
    scored: DataFrame, factors: DataFrame, id_col: str, profile, generated_at: str
) -> DataFrame:
    """One report per request: profile, risk, recommendation, factors, stamp, disclaimer."""
    tier = assessment(F.col("p"))
    entries = [
        F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value"))
        for c in profile
        if c in scored.columns
    ]
    body = scored.select(
        id_col,
        F.array(*entries).alias("profile"),
        F.format_string("%.1f%%", F.round(F.col("p") * 100, 1)).alias("risk_score"),
        F.upper(tier["level"]).alias("level"),
        tier["action"].alias("recommendation"),
        tier["color"].alias("color"),
        F.date_format(F.to_timestamp(F.lit(generated_at)), "yyyy-MM-dd HH:mm:ss").alias("generated_at"),
        F.lit(DISCLAIMER).alias("disclaimer"),
    )
    return body.join(factor_lines(factors, id_col), id_col)


def request_flags(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Add 0/1 columns built with ``binary_flag`` or ``binary_flag_except``."""
    return reduce(lambda d, item: d.withColumn(*item), flags.items(), df)
