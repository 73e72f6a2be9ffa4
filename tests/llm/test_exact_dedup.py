import hashlib
from collections import defaultdict

import numpy as np
import pytest

from cohortlab.llm import cuckoo_dedup as cd

SCHEMA = "doc_id long, text string, kept string"
ROWS = [
    (1, None, "x"),
    (None, "", "x"),
    (2, "a b", None),
    (3, "A b", "y"),
    (5, "É x", "z"),
    (5, "É x", "z"),
    (None, "É x", None),
    (7, "é x", "z"),
    (8, "long " * 50_000, "z"),
    (9, "LONG " * 50_000, "z"),
]


def _lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def _expected(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[_lower(text)].append(doc_id)
    return groups


def test_groups_match_brute_force(spark):
    got = cd.exact_dedup(spark.createDataFrame(ROWS, SCHEMA).repartition(5)).collect()
    groups = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in _expected(ROWS).items()}
    assert len(got) == len(ROWS)
    for r in got:
        ids = groups[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids)
        assert r.keep_id == (max(known) if known else None)
    assert sum(r.kept for r in got) == len(groups)


def test_one_row_of_each_text_stays_with_all_columns(spark):
    kept = cd.keep_one(spark.createDataFrame(ROWS, SCHEMA).repartition(4))
    assert kept.columns == ["doc_id", "text", "kept"]
    assert sorted(_lower(r.text) for r in kept.collect()) == sorted(_expected(ROWS))


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cd.exact_dedup(empty).count() == 0
    assert cd.keep_one(empty).count() == 0


def test_insert_and_delete_keep_the_index_right(spark):
    first = [(i, f"text {i % 40}") for i in range(100)]
    later = [(i, f"text {i % 60}") for i in range(100, 180)]
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = cd.CuckooIndex.build(cd.digests(table(first)), keys_per_bucket=10)
    index.insert(cd.digests(table(later)))
    gone = {i for i in range(180) if i % 3 == 0 or i % 40 == 7}
    index.delete(table([(i, "") for i in gone]).select("doc_id"))
    live = _expected([r for r in first + later if r[0] not in gone])
    got = {bytes(r.digest): (r.keep_id, r.group_size) for r in index.groups().collect()}
    assert got == {hashlib.sha256(t.encode()).digest(): (max(ids), len(ids)) for t, ids in live.items()}


@pytest.mark.parametrize("n", [1, 700, 20_000])
def test_filter_never_forgets_and_deletes(n):
    rng = np.random.default_rng(n)
    digests = [rng.bytes(32) for _ in range(n)]
    bucket = cd.Bucket()
    for at in range(0, n, 3_000):
        part = digests[at : at + 3_000]
        bucket.add(part + part[:5], [[i, 0, 1] for i in range(len(part))] + [[i, 0, 1] for i in range(len(part[:5]))])
    assert bucket.filter.contains(cd._keys(digests)).all()
    assert len(bucket.content) == n
    bucket.remove(digests[: n // 2])
    assert bucket.filter.contains(cd._keys(digests[n // 2 :])).all()
    assert (bucket.filter.table > 0).sum() == n - n // 2
    strangers = [rng.bytes(32) for _ in range(20_000)]
    assert bucket.filter.contains(cd._keys(strangers)).mean() < 0.01
