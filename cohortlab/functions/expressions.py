"""Small column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_key(id_col: str | Column, seed) -> Column:
    """32 hex digits that order rows at random but reproducibly: md5 of ``seed|id``."""
    value = F.col(id_col) if isinstance(id_col, str) else id_col
    prefix = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(prefix, F.lit("|"), value.cast("string")))


def hash_bucket(key: Column, digits: int = 4) -> Column:
    """First hex digits of a hash key as a number; four of them give 0..65535."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("int")


def hash_u32(key: Column) -> Column:
    """First eight hex digits of a hash key as a number, 0..2^32-1."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")


def ratio(num: Column, den: Column, when_zero=None) -> Column:
    """``num / den`` as double; ``when_zero`` (null by default) where ``den`` is 0."""
    return F.when(den != 0, num.cast("double") / den.cast("double")).otherwise(F.lit(when_zero))


def count_where(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def add_all(columns) -> Column:
    """Left-to-right sum of columns."""
    return reduce(lambda a, b: a + b, columns)


def steps_passed(value: Column, steps, strict: bool = False) -> Column:
    """How many of the ascending ``steps`` the value has reached (or, strict, exceeded)."""
    reached = [(value > F.lit(s)) if strict else (value >= F.lit(s)) for s in steps]
    return add_all([r.cast("int") for r in reached])


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin 0..bins-1 of equal width over [low, high]; the last bin holds ``high``."""
    pos = F.floor((value - low).cast("double") * bins / (high - low).cast("double"))
    return F.when(high > low, F.least(pos, F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")


def logistic(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def linear_score(intercept: float, coefficients: dict[str, float]) -> Column:
    """Intercept plus coefficient times column, added from left to right."""
    terms = [F.lit(intercept)]
    terms += [F.lit(w) * F.col(c).cast("double") for c, w in coefficients.items()]
    return add_all(terms)


def quadrant(y: Column, yhat: Column) -> Column:
    """TP, FP, TN or FN for a true and a predicted label."""
    return (
        F.when((y == 1) & (yhat == 1), "TP")
        .when((y == 0) & (yhat == 1), "FP")
        .when((y == 0) & (yhat == 0), "TN")
        .when((y == 1) & (yhat == 0), "FN")
    )


def relabel(col: Column, names: dict) -> Column:
    """Replace values by display names; other values keep their text."""
    out = None
    for value, name in names.items():
        out = F.when(col == value, name) if out is None else out.when(col == value, name)
    return col.cast("string") if out is None else out.otherwise(col.cast("string"))


def binary_flag(col: Column, one: str) -> Column:
    """1 where the column has the given value, else 0."""
    return F.when(col == one, 1).otherwise(0)


def binary_flag_except(col: Column, zero: str) -> Column:
    """0 where the column has the given value, else 1."""
    return F.when(col == zero, 0).otherwise(1)


def long_form(df: DataFrame, ids, values, name: str, value: str) -> DataFrame:
    """Wide to long with all values as double."""
    cast = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in values])
    return cast.unpivot(list(ids), list(values), name, value)
