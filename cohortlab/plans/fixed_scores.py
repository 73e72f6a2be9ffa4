"""Models with given coefficients over the order cohort.

They make the predictions table reproducible in SQL, so that every metric can be
checked exactly: two linear models and one rounded to one digit (many ties), with
and without the leakage columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.expressions import linear_score, logistic

SCORE_DIGITS = 6
COARSE_DIGITS = 1

# (experiment, model) -> intercept and coefficients
LINEAR = {
    ("no_leakage", "volume"): (-1.5, {"n_lines": 0.8, "qty": 0.002, "acctbal_cents": -1e-07}),
    ("no_leakage", "pricing"): (-1.0, {"disc_pts": 0.11, "tax_pts": 0.13, "any_return": 0.4}),
    ("full", "volume"): (-4.0, {"n_lines": 0.6, "gross_cents": 2e-07, "qty": 0.002}),
    ("full", "pricing"): (-5.0, {"max_line_cents": 8e-07, "disc_pts": 0.05, "tax_pts": 0.05}),
}
# coarse model -> the linear model it rounds
COARSE = {("no_leakage", "coarse"): ("no_leakage", "volume"), ("full", "coarse"): ("full", "volume")}

RISK_INTERCEPT = -2.2
RISK = {
    "n_lines": 0.5,
    "qty": 0.004,
    "disc_pts": 0.03,
    "tax_pts": 0.04,
    "any_return": 0.25,
    "total_cents": -1e-08,
    "acctbal_cents": 2e-07,
    "c_nationkey": 0.01,
    "o_orderpriority": -0.05,
}


def predictions(cohort: DataFrame, id_col: str, target: str, extra=()) -> DataFrame:
    """The long predictions table of all fixed models, one pass over the cohort."""
    p = {
        key: F.round(logistic(linear_score(b, w)), SCORE_DIGITS) for key, (b, w) in LINEAR.items()
    }
    p.update({key: F.round(p[source], COARSE_DIGITS) for key, source in COARSE.items()})
    rows = [
        F.struct(F.lit(e).alias("experiment"), F.lit(m).alias("model"), col.alias("p"))
        for (e, m), col in p.items()
    ]
    ids = [F.col(id_col).alias("row_id"), F.col(target).alias("y"), *extra]
    return cohort.select(*ids, F.explode(F.array(*rows)).alias("_s")).select(
        "_s.experiment",
        "_s.model",
        "row_id",
        "y",
        "_s.p",
        (F.col("_s.p") >= 0.5).cast("int").alias("yhat"),
        *extra,
    )


def score_risk(df: DataFrame) -> DataFrame:
    """Add the probability of the fixed risk model."""
    return df.withColumn("p", F.round(logistic(linear_score(RISK_INTERCEPT, RISK)), SCORE_DIGITS))
