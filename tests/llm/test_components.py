"""Components of links, with and without rounds that shuffle."""

import random

import numpy as np
import pytest

from cohortlab.llm import components as cc
from cohortlab.llm import near_dedup, setsketch


def _links(seed, nodes=400, n=380):
    draw = random.Random(seed)
    loose = [(draw.randrange(nodes), draw.randrange(nodes)) for _ in range(n)]
    chain = [(1000 + i, 1001 + i) for i in range(60)]
    hub = [(5000, 5001 + i) for i in range(150)]
    return loose + chain + hub + loose[:20] + [(7, 7), (-3, 9), (2**40, 2**41)]


def _expected(links):
    label = {x: x for link in links if link[0] != link[1] for x in link}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def _found(spark, links, parts=7):
    rows = cc.components(spark.createDataFrame(links, "a long, b long").repartition(parts)).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.component for r in rows}


@pytest.mark.parametrize("seed, block", [(1, cc.BLOCK), (2, 200), (3, 30)])
def test_components_match_brute_force_in_one_and_many_blocks(spark, monkeypatch, seed, block):
    monkeypatch.setattr(cc, "BLOCK", block)
    links = _links(seed)
    assert _found(spark, links) == _expected(links)


def test_no_links(spark):
    assert _found(spark, []) == {}
    assert _found(spark, [(4, 4)]) == {}


def test_links_of_one_block_take_no_round_of_shuffles(spark, monkeypatch):
    def refused(links):
        raise AssertionError("a round was run")

    monkeypatch.setattr(cc, "_large_star", refused)
    links = _links(4)
    assert _found(spark, links) == _expected(links)


def _sketches(groups):
    """Registers and sizes of sets: each group's members share most of its 200 shingles."""
    draw = np.random.default_rng(5)
    sets = []
    for n in groups:
        base = draw.integers(0, 2**63, 200, dtype=np.uint64)
        sets += [np.unique(np.r_[base[: 200 - k % 3], draw.integers(0, 2**63, k % 3, dtype=np.uint64)]) for k in range(n)]
    return np.stack([setsketch.sketch(x) for x in sets]), np.array([len(x) for x in sets])


def test_a_bucket_of_alike_classes_is_spanned_without_all_pairs(monkeypatch):
    registers, sizes = _sketches([80, 1, 30, 1])
    compared, near = [], near_dedup._near

    def counted(registers, sizes, rows, row):
        compared.append(len(rows))
        return near(registers, sizes, rows, row)

    monkeypatch.setattr(near_dedup, "_near", counted)
    rows, reached = near_dedup._spanning(registers, sizes, np.arange(112))
    spanned = sum(compared)
    links = [(row, int(other)) for row, others in zip(rows, reached, strict=True) for other in others]
    pairs = near_dedup._promising(registers, sizes, np.arange(112), np.arange(112))
    label = _expected(links)
    assert len(links) == 79 + 29 and len(set(label.values())) == 2
    assert label == _expected(pairs)
    assert spanned < 0.8 * 112 * 111 / 2  # all pairs


def test_alike_classes_are_met_once():
    registers, sizes = _sketches([300])
    rows, reached = near_dedup._spanning(registers, sizes, np.arange(300))
    assert (len(rows), sum(map(len, reached))) == (1, 299)
