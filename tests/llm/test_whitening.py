"""Whitening against numpy."""

import math

import numpy as np
import pytest

from cohortlab.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, index long, n int"


def compared(spark, rows, components=32, **limits):
    """The result by row and component, checked against a local computation on the valid rows."""
    vectors = spark.createDataFrame([(i, v, 7, 7) for i, v in rows], SCHEMA).repartition(3)
    got = whitening.whiten(vectors, components=components).collect()
    sizes = [len(v) for _, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    width = max(set(sizes), key=lambda s: (sizes.count(s), s))
    fit = [(i, v) for i, v in rows if v and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in fit])
    n, sums = len(x), x.sum(axis=0)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    centred = (x - 1_000_000) - (sums - 1_000_000 * n) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > values[0] * 1e-10).sum()))
    want = centred @ vectors[:, :k] / np.sqrt(values[:k])
    by_row = {}
    for r in got:
        by_row.setdefault((r["vec_id"], r["deviation"]), []).append(r)
        assert r["n"] == n and r["deviation_exact"] == r["deviation"] and r["identity_error"] <= 1e-8
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
    assert len(got) == n * k
    signs = None
    for (i, _), row, d in zip(fit, want, deviation, strict=True):
        mine = by_row[i, int(d)]
        found = np.array([r["whitened"] for r in sorted(mine, key=lambda r: r["component"])[: len(mine)]])
        if len(mine) == k:
            signs = np.sign(found * row) if signs is None else signs
            assert np.allclose(found, row * signs, atol=1e-6)
    return got


def test_equals_numpy(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    compared(spark, [(r["vec_id"], list(r["embedding"])) for r in table.collect()])


def test_invalid_rows_and_other_lengths_are_left_out(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=5).tolist()) for i in range(60)]
    bad = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [math.nan] * 5), (104, [math.inf] * 5), (105, [1.0, 2.0])]
    got = compared(spark, good + bad + [(None, [0.5] * 5)], components=3)
    assert {r["vec_id"] for r in got} == {*range(60), None}


def test_constant_dimensions_and_repeated_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 9, [float(a), 3.0, float(b), float(a)]) for i, (a, b) in enumerate(rng.normal(size=(40, 2)))]
    got = whitening.whiten(spark.createDataFrame([(i, v, 7, 7) for i, v in rows + rows[:3]], SCHEMA)).collect()
    assert {r["component"] for r in got} == {1, 2} and len(got) == 2 * 43
    assert max(r["identity_error"] for r in got) < 1e-8


def test_no_variance_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(empty).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25], 7, 7)] * 4, SCHEMA)).collect() == []


def test_panels_and_blocks_add_up(spark, monkeypatch):
    """Small blocks and panels, and wide vectors in several block columns, change nothing."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=7).tolist()) for i in range(50)]
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 3)
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", 12)
    monkeypatch.setattr(whitening, "PANEL_BLOCKS", 4)
    compared(spark, rows, components=4)


def test_huge_entries_do_not_end_the_job(spark):
    rows = [(i, [float(i % 3), 3e15 if i == 1 else 0.0]) for i in range(6)]
    got = whitening.whiten(spark.createDataFrame([(i, v, 7, 7) for i, v in rows], SCHEMA)).collect()
    assert {r["deviation"] for r in got if r["vec_id"] == 1} == {None}
    assert all(r["deviation_exact"] is not None for r in got)


def test_entries_beyond_long_are_held(spark):
    rows = [(i, [float(i % 3), 3e38 if i == 1 else 0.0]) for i in range(6)]
    got = whitening.whiten(spark.createDataFrame([(i, v, 7, 7) for i, v in rows], SCHEMA)).collect()
    assert {(r["deviation"], r["deviation_exact"]) for r in got if r["vec_id"] == 1} == {(None, None)}
    assert len({r["vec_id"] for r in got}) == 6
