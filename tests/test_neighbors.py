import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import balance, neighbors


def brute(queries, points, k, exclude_self):
    out = {}
    for qid, *q in queries.itertuples(index=False):
        pairs = []
        for pid, *p in points.itertuples(index=False):
            if exclude_self and qid == pid:
                continue
            d = 0.0
            for a, b in zip(q, p):
                d += (a - b) * (a - b)
            pairs.append((d, pid))
        out[qid] = sorted(pairs)[:k]
    return out


def joined(spark, queries, points, k, exclude_self=False):
    cols = list(queries.columns[1:])
    got = neighbors.knn_join(
        spark.createDataFrame(queries), spark.createDataFrame(points), cols, k, "id", "id", exclude_self
    ).toPandas()
    return {
        q: [(r.d2, r.neighbor_id) for r in part.sort_values("neighbor_rank").itertuples()]
        for q, part in got.groupby("id")
    }


def frame(n, dims, seed, start=0, digits=1):
    rng = np.random.default_rng(seed)
    data = np.round(rng.normal(size=(n, dims)) * np.array([50.0] + [1.0] * (dims - 1)), digits)
    out = pd.DataFrame(data, columns=[f"x{i}" for i in range(dims)])
    out.insert(0, "id", np.arange(start, start + n))
    return out


@pytest.fixture
def tiny_cells(monkeypatch):
    monkeypatch.setattr(neighbors, "NODE_ROWS", 16)
    monkeypatch.setattr(neighbors, "BLOCK_QUERIES", 10)


def test_exact_over_many_cells(spark, tiny_cells):
    q, p = frame(60, 3, 1, start=10_000), frame(400, 3, 2)
    assert joined(spark, q, p, 4) == brute(q, p, 4, False)


def test_exact_without_self(spark, tiny_cells):
    p = frame(200, 2, 3, digits=0)
    assert joined(spark, p, p, 5, True) == brute(p, p, 5, True)


def test_exact_when_cells_are_searched_in_chunks(spark, tiny_cells, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_POINTS", 8)
    p = frame(150, 3, 4)
    assert joined(spark, p, p, 3, True) == brute(p, p, 3, True)


def test_exact_when_a_third_of_the_rows_are_copies(spark, tiny_cells):
    p = frame(240, 2, 5)
    p.loc[p.index % 3 == 0, ["x0", "x1"]] = [1.0, 2.0]
    assert joined(spark, p, p, 4, True) == brute(p, p, 4, True)


@pytest.mark.parametrize("depth", [1, 2])
def test_exact_over_many_levels(spark, tiny_cells, monkeypatch, depth):
    monkeypatch.setattr(neighbors, "NODE_DEPTH", depth)
    q, p = frame(50, 3, 11, start=10_000), frame(300, 3, 12)
    q.loc[:9, "x0"] = 1e6  # far from all points, in nodes that hold few
    assert joined(spark, q, p, 4) == brute(q, p, 4, False)


def test_exact_when_nodes_hold_fewer_points_than_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "NODE_ROWS", 2)
    p = frame(60, 2, 13, digits=0)
    assert joined(spark, p, p, 7, True) == brute(p, p, 7, True)


@pytest.mark.parametrize("depth", [10, 3])
def test_few_pairs_of_nodes_meet(spark, monkeypatch, depth):
    """On clustered points the bound rules out all but a small share of the node pairs, at any height."""
    monkeypatch.setattr(neighbors, "NODE_ROWS", 32)
    monkeypatch.setattr(neighbors, "NODE_DEPTH", depth)
    rng = np.random.default_rng(14)
    centres = rng.uniform(-1000, 1000, size=(40, 3))
    data = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 3))
    points = pd.DataFrame(data, columns=["_f0", "_f1", "_f2"]).assign(_pid=np.arange(4000))
    tree = neighbors.PartitionTree(spark.createDataFrame(points), 4000, ["_f0", "_f1", "_f2"])
    boxes = tree.nodes.withColumnRenamed("_node", "_qnode").withColumn("_bound", F.lit(1.0)).drop("_rows", "_chunks")
    met = tree.visits(boxes, 5)
    n = tree.nodes.count()
    assert len(tree.depths) == (1 if depth == 10 else 3) and n > 100
    assert n <= met.count() < 0.1 * n * n
    assert set(met.columns) == {"_qnode", "_node", "_bound"}


def test_exact_in_one_block(spark):
    q, p = frame(60, 3, 1, start=10_000, digits=0), frame(400, 3, 2, digits=0)
    assert joined(spark, q, p, 4) == brute(q, p, 4, False)


def test_fewer_points_than_neighbours(spark):
    p = frame(3, 2, 6)
    assert joined(spark, p, p, 5, True) == brute(p, p, 5, True)


def test_no_points(spark):
    q = spark.createDataFrame([(1, 1.0)], "id bigint, x double")
    assert neighbors.knn_join(q, q.where("id < 0"), ["x"], 2, "id", "id").count() == 0


def test_null_feature_raises(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "id bigint, x double")
    with pytest.raises(Exception, match="null in feature x"):
        neighbors.knn_join(df, df, ["x"], 1, "id", "id").collect()


def test_similar_outcomes(spark):
    known = spark.createDataFrame([(1, 0.0, 1), (2, 1.0, 0), (3, 9.0, 1)], "id bigint, x double, y int")
    asked = spark.createDataFrame([(7, 0.4)], "id bigint, x double")
    near = neighbors.similar_subjects(asked, known, ["x"], "id", "y", n=2)
    assert [(r["neighbor_id"], r["distance"]) for r in near.orderBy("neighbor_rank").collect()] == [(1, 0.4), (2, 0.6)]
    assert neighbors.similar_outcomes(near, "id", "y").first()["n_positive"] == 1


@pytest.fixture(scope="module")
def unbalanced(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(i >= 30), float(rng.normal()), float(rng.integers(0, 2))) for i in range(230)]
    return spark.createDataFrame(rows, "id bigint, y int, a double, b double")


def test_smote_counts_and_segments(spark, unbalanced):
    out = balance.smote(unbalanced, "id", "y", ["a", "b"], 0.5).toPandas()
    assert (out.y == 0).sum() == 100 and (out.y == 1).sum() == 200
    made = out[out.synthetic == 1]
    assert made.id.is_unique and (made.id < 0).all()
    rows = out[out.synthetic == 0].set_index("id")
    for r in made.itertuples():
        base, near = rows.loc[int(r.base_id)], rows.loc[int(r.neighbor_id)]
        assert base.y == near.y == 0 and r.base_id != r.neighbor_id
        for c in ("a", "b"):
            lo, hi = sorted((base[c], near[c]))
            assert lo - 1e-12 <= getattr(r, c) <= hi + 1e-12


def test_smote_uses_bases_evenly(spark, unbalanced):
    out = balance.smote(unbalanced, "id", "y", ["a", "b"], 1.0)
    uses = [r["count"] for r in out.where("synthetic = 1").groupBy("base_id").count().collect()]
    assert sum(uses) == 170 and max(uses) - min(uses) <= 1


def test_smote_is_deterministic(spark, unbalanced):
    runs = [
        balance.smote(unbalanced.repartition(n), "id", "y", ["a", "b"]).orderBy("id").collect() for n in (2, 7)
    ]
    assert runs[0] == runs[1]


def test_smote_refuses_impossible_input(spark, unbalanced):
    with pytest.raises(ValueError, match="already exceeds"):
        balance.smote(unbalanced, "id", "y", ["a", "b"], 0.1)
    few = unbalanced.where(F.col("id") >= 26)
    with pytest.raises(ValueError, match="at least 6"):
        balance.smote(few, "id", "y", ["a", "b"])


def test_a_block_meets_few_of_its_points(monkeypatch):
    """Leaves inside a block give what the whole block gives, at a small share of the distances."""
    met, plain = [], neighbors._nearest
    monkeypatch.setattr(neighbors, "_nearest", lambda q, p, *rest: met.append(len(q) * len(p)) or plain(q, p, *rest))
    rng = np.random.default_rng(21)
    p, q = np.round(rng.normal(size=(8000, 3)), 2), np.round(rng.normal(size=(4000, 3)), 2)
    p_ids, q_ids = np.arange(8000), np.arange(4000)
    for bound in (np.full(4000, np.inf), np.full(4000, 0.01)):
        met.clear()
        found = neighbors._search_leaves(q, p, 5, bound, q_ids, p_ids, True)
        assert sum(met) < 0.3 * 8000 * 4000
        whole = plain(q, p, 5, bound, q_ids[:, None] == p_ids[None, :])
        assert all((a == b).all() for a, b in zip(found, whole, strict=True))


def test_points_are_copied_for_the_queries_that_visit_them(spark, monkeypatch):
    """Query nodes meet many nodes that few of their queries reach; the points there travel to those few only."""
    for name, value in (("NODE_ROWS", 64), ("BLOCK_QUERIES", 8)):
        monkeypatch.setattr(neighbors, name, value)
    scanned, scan = [], neighbors._scan

    def noted(asked, points, slices, *more):
        scanned.append((asked, {r["_node"]: r["_slices"] for r in slices.collect()}))
        return scan(asked, points, slices, *more)

    monkeypatch.setattr(neighbors, "_scan", noted)
    x = np.random.default_rng(8).uniform(size=(3000, 2))
    table = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double")
    got = neighbors.knn_join(table, table, ["a", "b"], 3, "id", "id", exclude_self=True).collect()
    asked, slices = scanned[1]
    visits = {}
    for r in asked.groupBy("_node", "_chunk").count().collect():
        visits[r["_node"]] = max(visits.get(r["_node"], 0), -(-r["count"] // 8))
    assert slices == visits and len(slices) > 8
    far = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(far, np.inf)
    right = np.argsort(far, axis=1, kind="stable")[:, :3]
    assert len(got) == 9000 and all(right[r["id"], r["neighbor_rank"] - 1] == r["neighbor_id"] for r in got)
