"""Ranks, selections, running totals and quantiles without a global sort.

A window without partitions, or with only two of them, would put all rows of a
large table in one or two tasks.  The functions here first count rows per
bucket, add up the small bucket table, and only then rank inside a bucket.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.expressions import hash_bucket, hash_key
from cohortlab.session import materialize

EDGE_BUCKETS = 256
EDGE_ACCURACY = 10000
# Widths of a bracket around a quantile, as shares of the rows; the last one holds them all.
BRACKET_REACHES = (4 / EDGE_ACCURACY, 0.01, 1.0)


def _before(keys, order: str):
    """Window over everything that comes before the current bucket."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def hash_rank(
    df: DataFrame, id_col: str, seed, strata=(), rank_col: str = "rank", digits: int = 4, tasks: int | None = None
) -> DataFrame:
    """Add the 1-based position of each row in the hash order of its stratum.

    Equals ``row_number() over (partition by strata order by md5(seed|id), id)``,
    but the sort runs inside 16^digits hash buckets per stratum: 65,536, or fewer
    where the table is known to be small.  ``tasks`` fixes how many tasks sort
    the rows, for tables that need more than the session's shuffle partitions.
    """
    strata = list(strata)
    keyed = df.withColumn("_h", hash_key(id_col, seed)).withColumn("_b", hash_bucket(F.col("_h"), digits))
    counts = keyed.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_n"))
    # At most 65,536 rows per stratum.
    offsets = counts.withColumn(
        "_offset", F.coalesce(F.sum("_n").over(_before(strata, "_b")), F.lit(0))
    ).drop("_n")
    inside = Window.partitionBy(*strata, "_b").orderBy("_h", id_col)
    if tasks is not None:
        keyed = keyed.repartition(tasks, *strata, "_b")
    return (
        keyed.join(offsets, [*strata, "_b"])
        .withColumn(rank_col, F.col("_offset") + F.row_number().over(inside))
        .drop("_h", "_b", "_offset")
    )


def strata_quotas(counts: DataFrame, stratum: str, total: Column) -> DataFrame:
    """Share ``total`` rows among strata by size.

    ``counts`` has one row per stratum (``stratum``, ``n``); ``total`` may use
    ``n_all``, the overall count.  Each stratum gets the floor of its share, the
    rest goes to the largest fractions, ties to the smallest value.
    """
    everything = Window.partitionBy()
    sized = counts.withColumn("n_all", F.sum("n").over(everything))
    sized = sized.withColumn("_total", F.least(total.cast("bigint"), F.col("n_all")))
    big = "decimal(38,0)"
    product = F.col("_total").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")
    sized = sized.withColumn("_share", product.cast(big))
    n_all = F.col("n_all").cast("decimal(19,0)")
    sized = sized.withColumn("_rest", (F.col("_share") % n_all).cast(big))
    sized = sized.withColumn("_base", ((F.col("_share") - F.col("_rest")) / n_all).cast("bigint"))
    order = Window.partitionBy().orderBy(F.col("_rest").desc(), F.col(stratum).asc())
    left = F.col("_total") - F.sum("_base").over(everything)
    sized = sized.withColumn("_left", left).withColumn("_pos", F.row_number().over(order))
    extra = F.when(F.col("_pos") <= F.col("_left"), 1).otherwise(0)
    return sized.select(stratum, "n", (F.col("_base") + extra).alias("quota"))


def stratified_take(
    df: DataFrame, id_col: str, stratum: str, seed, total: Column, flag: str = "taken"
) -> DataFrame:
    """Flag exactly the first ``quota`` rows of every stratum in hash order.

    Finds the last hash key that still belongs to the quota, by counting rows
    per hash bucket and ranking the one bucket where the quota ends.  The flag is
    then a comparison with that key, so the table itself is never shuffled.
    """
    keyed = df.withColumn("_h", hash_key(id_col, seed))
    slim = keyed.select(stratum, F.col(id_col).alias("_id"), "_h", hash_bucket(F.col("_h")).alias("_b"))
    counts = slim.groupBy(stratum, "_b").agg(F.count(F.lit(1)).alias("_n"))
    quotas = strata_quotas(counts.groupBy(stratum).agg(F.sum("_n").alias("n")), stratum, total)
    running = counts.withColumn("_below", F.coalesce(F.sum("_n").over(_before([stratum], "_b")), F.lit(0)))
    border = (
        running.join(quotas, stratum)
        .where((F.col("_below") < F.col("quota")) & (F.col("_below") + F.col("_n") >= F.col("quota")))
        .select(stratum, "_b", (F.col("quota") - F.col("_below")).alias("_keep"))
    )
    # One row per stratum from here on: the strata are the classes of the target.
    inside = Window.partitionBy(stratum).orderBy("_h", "_id")
    last = (
        slim.join(F.broadcast(border), [stratum, "_b"])
        .withColumn("_pos", F.row_number().over(inside))
        .where(F.col("_pos") == F.col("_keep"))
        .select(stratum, F.struct("_h", F.col("_id")).alias("_last"))
    )
    here = F.struct(F.col("_h"), F.col(id_col).alias("_id"))
    return (
        keyed.join(F.broadcast(last), stratum, "left")
        .withColumn(flag, F.coalesce(here <= F.col("_last"), F.lit(False)))
        .drop("_h", "_last")
    )


def value_edges(df: DataFrame, order_col: str, buckets: int = EDGE_BUCKETS) -> list[float]:
    """Inner cut points that spread the rows of ``df`` evenly over buckets."""
    shares = [i / buckets for i in range(1, buckets)]
    found = df.agg(
        F.percentile_approx(F.col(order_col).cast("double"), shares, EDGE_ACCURACY).alias("e")
    ).first()["e"]
    return sorted(set(found or []))


def running_totals(
    df: DataFrame,
    keys,
    order_col: str,
    sums,
    descending: bool = False,
    buckets: int = EDGE_BUCKETS,
    keep_bucket: bool = False,
) -> DataFrame:
    """Add ``cum_<c>``: the total of ``c`` up to and including the current value.

    ``df`` must hold one row per (keys, order_col), for instance after a
    ``groupBy``, and should be cheap to read twice.  Bucket edges are quantiles
    of the pooled values, so no bucket holds many more rows than another however
    the values crowd; the result does not depend on the edges.
    """
    keys, sums = list(keys), list(sums)
    splits = [float("-inf"), *value_edges(df, order_col, buckets), float("inf")]
    position = "_value"
    placed = Bucketizer(
        splits=splits, inputCol=position, outputCol="_bucket", handleInvalid="error"
    ).transform(df.withColumn(position, F.col(order_col).cast("double")))
    sign = -1 if descending else 1
    placed = placed.withColumn("_bucket", (F.col("_bucket") * sign).cast("int")).drop(position)
    totals = placed.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = _before(keys, "_bucket")
    offsets = totals.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums],
    )
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = placed.join(offsets, [*keys, "_bucket"])
    for c in sums:
        out = out.withColumn(f"cum_{c}", F.col(f"_o_{c}") + F.sum(c).over(inside))
    out = out.drop(*[f"_o_{c}" for c in sums])
    return out if keep_bucket else out.drop("_bucket")


def value_counts(df: DataFrame, keys, value: str) -> DataFrame:
    """Distinct values with their row counts."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(counted: DataFrame, keys, value: str, shares: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles per group.

    ``counted`` is a materialized ``value_counts`` table.  The quantile at share q
    lies at position q*(n-1); it is read off the running count, so no task ever
    holds all values of a group.
    """
    keys = list(keys)
    cum = running_totals(counted, keys, value, ["n"])
    totals = counted.groupBy(*keys).agg(F.sum("n").alias("_total"))
    cum = cum.join(totals, keys)
    aggs = []
    for name, q in shares.items():
        at = F.lit(q) * (F.col("_total") - 1)
        first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
        for part, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (first <= pos) & (pos <= last)
            aggs.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"_{part}_{name}"))
    picked = cum.groupBy(*keys).agg(F.max("_total").alias("_total"), *aggs)
    out = []
    for name, q in shares.items():
        at = F.lit(q) * (F.col("_total") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return picked.select(*keys, F.col("_total").alias("n"), *out)


def per_value(key: str, choices: dict, kind: str = "double") -> Column:
    """The choice that belongs to the value of ``key``, null for other values; few choices only."""
    out = F.lit(None).cast(kind)
    for value, choice in choices.items():
        out = F.when(F.col(key) == F.lit(value), F.lit(choice).cast(kind)).otherwise(out)
    return out


def bracketed_quantiles(df: DataFrame, group: str, columns, shares: dict[str, float]) -> dict[tuple, dict[str, float]]:
    """Exact, linearly interpolated quantiles of several columns for each value of ``group``: numbers by (group, column).

    One aggregate gives a sketch per column and group, whose rank error is at most rows/EDGE_ACCURACY. It puts a bracket
    around every quantile that surely holds it; a second pass counts the rows below each bracket and groups the values inside.
    Only those, some thousandths of the rows, are shuffled. Each result also has ``n``, ``minimum`` and ``maximum``. Nulls don't
    count, NaN ends the job, a group without values of a column has no entry. ``group`` may have a few values only, null is none.
    """
    columns = list(columns)
    rows = df.where(F.col(group).isNotNull()).select(group, *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    probes = sorted({min(max(q + side * r, 0.0), 1.0) for q in shares.values() for r in BRACKET_REACHES for side in (-1, 1)})
    first = []
    for i in range(len(columns)):
        v = F.col(f"v{i}")
        first += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
        first.append(F.percentile_approx(v, probes, EDGE_ACCURACY).alias(f"p{i}"))
    seen = {r[group]: r for r in rows.groupBy(group).agg(*first).collect()} if columns else {}
    found, brackets = {}, {}
    for g, r in seen.items():
        for i, c in enumerate(columns):
            n = r[f"n{i}"]
            if not n:
                continue
            found[g, c] = {"n": n, "minimum": r[f"lo{i}"], "maximum": r[f"hi{i}"]}
            # wide enough for the sketch's error and the two rows that are interpolated
            reach = next(w for w in BRACKET_REACHES if w == 1.0 or w >= 2 / EDGE_ACCURACY + 3 / n)
            for name, q in shares.items():
                low, high = (probes.index(min(max(q + side * reach, 0.0), 1.0)) for side in (-1, 1))
                ends = (r[f"lo{i}"], r[f"hi{i}"]) if reach == 1.0 else (r[f"p{i}"][low], r[f"p{i}"][high])
                brackets[g, i, name] = ends
    if not brackets:
        return found

    def end(i: int, name: str, side: int) -> Column:
        return per_value(group, {g: ends[side] for (g, j, k), ends in brackets.items() if (j, k) == (i, name)})

    slots = [(i, name) for i in range(len(columns)) for name in shares]
    inside, below = [], []
    for s, (i, name) in enumerate(slots):
        v, low, high = F.col(f"v{i}"), end(i, name, 0), end(i, name, 1)
        inside.append(F.struct(F.lit(s).alias("slot"), F.when((v >= low) & (v <= high), v).alias("value")))
        below.append(F.sum(F.when(v < low, 1).otherwise(0)).alias(f"b{s}"))
    under = {r[group]: r for r in rows.groupBy(group).agg(*below).collect()}
    kept = rows.select(group, F.explode(F.filter(F.array(*inside), lambda s: s["value"].isNotNull())).alias("_s"))
    counted = materialize(value_counts(kept.select(group, "_s.*"), [group, "slot"], "value"), "brackets")
    cum = running_totals(counted, [group, "slot"], "value", ["n"])
    position, number = {}, {}
    for (g, i, name) in brackets:
        s = slots.index((i, name))
        at = shares[name] * (found[g, columns[i]]["n"] - 1)
        position[g, s], number[g, s] = at, under[g][f"b{s}"]
    # one row per group, column and quantile
    kind = dict(df.select(group).dtypes)[group]
    wanted = [(g, s, int(at // 1) - number[g, s], int(-(-at // 1)) - number[g, s]) for (g, s), at in position.items()]
    wanted = df.sparkSession.createDataFrame(wanted, f"`{group}` {kind}, slot int, _floor long, _ceil long")
    hit = [
        F.max(F.when((F.col("cum_n") - F.col("n") <= F.col(p)) & (F.col("cum_n") > F.col(p)), F.col("value"))).alias(f"at{p}")
        for p in ("_floor", "_ceil")
    ]
    for r in cum.join(F.broadcast(wanted), [group, "slot"]).groupBy(group, "slot").agg(*hit).collect():
        i, name = slots[r["slot"]]
        at = position[r[group], r["slot"]]
        if r["at_floor"] is None or r["at_ceil"] is None:
            raise RuntimeError(f"the bracket of {name} of {columns[i]} misses it")
        found[r[group], columns[i]][name] = r["at_floor"] + (r["at_ceil"] - r["at_floor"]) * (at - at // 1)
    return found
