"""Exact top-k against sorting all pairs."""

import math
import random

import numpy as np
import pytest

from tidemark.llm import cover_tree, exact_topk


def plain(rows, k, every):
    valid = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(valid):
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for j, (i, w) in enumerate(valid) if j != at and len(w) == len(v))
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, every, kind="float", **options):
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], f"vec_id long, embedding array<{kind}>, cell int, part int, row int, v int")
    found = exact_topk.exact_topk(df, lambda c: c % every == 0, **options)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, found.collect()))


def vectors(seed, n, dim=6):
    rng = random.Random(seed)
    hot = [round(rng.uniform(-1, 1), 2) for _ in range(dim)]
    rows = []
    for i in range(n):
        v = [float(np.float32(rng.gauss(0, 0.3))) for _ in range(dim)]
        rows.append((i, [float(np.float32(x)) for x in hot] if i % 3 == 0 else v))
    return rows


@pytest.mark.parametrize(("block", "asked", "pivots"), [(8_192, 8_192, 32), (40, 7, 5), (1_000, 3, 1)])
def test_equals_all_pairs(spark, block, asked, pivots):
    rows = vectors(1, 400)
    assert run(spark, rows, 10, k=5, block=block, asked=asked, pivots=pivots) == plain(rows, 5, 10)


def test_odd_rows(spark):
    rows = vectors(2, 60, 3)
    rows += [(100, None), (110, [1.0, None, 2.0]), (120, [float("nan"), 1.0, 1.0]), (130, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (140, [1.0, 2.0]), (150, [3.0, 4.0]), (160, [0.5]), (0, rows[0][1]), (10, [0.25, 0.5, 0.75]), (170, [-300.0, 200.0, 999.0])]
    assert run(spark, rows, 10, k=5) == plain(rows, 5, 10)


def test_few_and_no_rows(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0])], 50, k=5) == [(0, 1, 1, 131072)]
    assert run(spark, [(1, [1.0])], 50, k=5) == []
    assert run(spark, [], 50, k=5) == []


def test_tree_covers_and_separates():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(2_000, 3))
    tree = cover_tree.CoverTree(points, 20)
    assert sorted(tree.order.tolist()) == list(range(2_000))
    stack = [tree.root]
    while stack:
        node = stack.pop()
        away = np.linalg.norm(points[tree.order[node.start : node.end]] - node.centre, axis=1)
        assert away.max() <= node.radius + 1e-9
        if node.children:
            assert sum(c.end - c.start for c in node.children) == node.end - node.start
            centres = np.array([c.centre for c in node.children])
            apart = np.linalg.norm(centres[:, None] - centres[None], axis=2) + np.eye(len(centres)) * 1e9
            assert max(c.radius for c in node.children) <= node.radius / 2 + 1e-9  # covering
            assert apart.min() > node.radius / 2 - 1e-9  # separation
        stack += node.children


@pytest.mark.parametrize(("kind", "block"), [("float", 16_384), ("double", 50)])
def test_large_components_take_part(spark, kind, block):
    """Components up to 2^30 beside small ones: nothing is dropped and every score is exact."""
    rng = random.Random(4)
    size = lambda: 2.0 ** rng.uniform(-4, 15)
    rows = [(i, [float(np.float32(rng.choice([-1, 1]) * size())) for _ in range(4)]) for i in range(300)]
    rows += [(0, [300_000.0, 1.0, 0.0, 0.0]), (1, [400_000.0, 0.0, 0.5, 0.0]), (301, [0.0, 0.0, float(2**30), 0.0]), (50, [0.0, 0.0, 1.0, float(2**20)])]
    assert run(spark, rows, 10, kind, k=5, block=block, asked=7, pivots=4) == plain(rows, 5, 10)


@pytest.mark.parametrize("sign", [1, -1])
def test_scores_beyond_64_bits_raise(spark, sign):
    rows = [(0, [2.0**60, 1.0]), (1, [sign * 2.0**60, 1.0])]
    with pytest.raises(Exception, match="64 bits"):
        run(spark, rows, 10, k=5)
    small = rows + [(i, [0.25 * i, 0.0]) for i in range(2, 8)]
    if sign < 0:  # it is not among the best of another
        assert run(spark, small[1:], 2, k=5) == plain(small[1:], 5, 2)


def test_rows_that_share_an_id_are_queries_and_candidates(spark):
    rows = [(0, [0.5, 0.25]), (0, [0.5, 0.25]), (0, [0.125, 0.75]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (10, [1.0, -1.0])]
    for block in (16_384, 2):
        assert run(spark, rows, 10, k=5, block=block) == plain(rows, 5, 10)


def test_search_prunes():
    """Far groups are never compared."""
    rng = np.random.default_rng(3)
    near, far = rng.integers(900, 1000, size=(500, 8)), rng.integers(-1000, -900, size=(5_000, 8))
    s = cover_tree.Search(near[:50].astype(float), np.arange(50), np.arange(50), 5)
    looked = []
    compare = s.compare
    s.compare = lambda q, d, data: (looked.append(len(q) * len(d)), compare(q, d, data))
    s.look(cover_tree.Data(np.concatenate([near, far]).astype(float), np.arange(5_500), np.arange(5_500)))
    assert sum(looked) < 50 * 1_000


def test_a_tree_without_groups_stays_a_leaf():
    """Points of many dimensions lie about equally far apart: no level of half the radius is narrow enough."""
    points = np.random.default_rng(5).normal(size=(3_000, 64))
    tree = cover_tree.CoverTree(points, 20)
    assert not tree.root.children and tree.root.end == 3_000
