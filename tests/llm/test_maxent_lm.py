import numpy as np
import pyarrow as pa
import pytest

from cohortlab.llm import maxent_lm


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(5)
    own = np.sort(rng.integers(1, 2**63, 40, dtype=np.uint64))
    size = maxent_lm.WIDTH * maxent_lm.WIDTH
    built = maxent_lm.Model(maxent_lm.Classes(own, rng.integers(0, 50, size), rng.integers(0, 9, size)))
    built.group[:] = rng.normal(0, 1, built.group.shape)
    built.member[:] = rng.normal(0, 1, built.member.shape)
    return built


def test_class_probabilities_of_a_history_sum_to_one(model):
    width = maxent_lm.WIDTH
    tokens, _, lengths = maxent_lm._tokens(pa.array(["one two three two one"]))
    history = [f[2:3] for f in maxent_lm._features(tokens, lengths)]
    total = 0.0
    for group in range(width):
        outer, inner = model.buckets(history, np.array([group]))
        p_group = model.softmax(model.group, outer, model.classes.group_bias)
        p_member = model.softmax(model.member, inner, model.classes.member_bias[[group]])
        total += float(p_group[0, group]) * float(p_member.sum())
    assert total == pytest.approx(1, abs=1e-5)


def test_sums_by_bucket_equal_a_plain_loop():
    rng = np.random.default_rng(6)
    rows = rng.zipf(1.3, 4_000) % 500
    values = rng.random((4_000, maxent_lm.WIDTH), dtype=np.float32)
    out, plain = (np.ones((500, maxent_lm.WIDTH), dtype=np.float32) for _ in range(2))
    maxent_lm._sum_rows(out, rows, values)
    for r, v in zip(rows, values, strict=True):
        plain[r] += v
    assert np.allclose(out, plain, rtol=1e-4)


def test_nulls_empty_and_repeated_rows_and_other_columns(spark):
    rows = [(1, None), (2, ""), (3, "a b c a b"), (3, "a b c a b"), (None, "a b"), (4, "z " * 3_000)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, row long, word long")
    got = maxent_lm.score_documents(docs).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 3), (1, 1), (2, 1), (3, 6), (3, 6), (4, 3_001)]
    assert next(r.held_out for r in got if r.doc_id is None)
    assert len({(r.base_score, r.score) for r in got if r.doc_id == 3}) == 1
    assert all(r.score < 0 for r in got)
