"""Bounds of the diversity of subsets against all subsets."""

import itertools
import math
import random

import numpy as np
import pytest

from slatewise.plans import beyond_accuracy as B
from slatewise.plans.diversity_bounds import diversity_bounds, pair_bounds


def clustered(seed, items, spread=0.05, dims=4):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    return [(i, [x + rng.gauss(0, spread) for x in centers[i % 6]]) for i in range(items)]


def plain(vecs, n, distance):
    v = np.array(vecs)
    if distance == "cosine":
        size = np.linalg.norm(v, axis=1, keepdims=True)
        u = np.divide(v, size, out=np.zeros_like(v), where=size > 0)
        d = 1 - u @ u.T
    else:
        d = np.linalg.norm(v[:, None] - v[None], axis=2)
    values = [np.mean([d[a, b] for a, b in itertools.combinations(s, 2)]) for s in itertools.combinations(range(len(v)), n)]
    return min(values), max(values)


@pytest.mark.parametrize("n, items, distance", [(2, 60, "cosine"), (3, 30, "euclidean"), (4, 22, "cosine")])
def test_bounds_are_those_of_all_subsets(spark, n, items, distance):
    rows = clustered(n, items) + [(900, [0.0] * 4), (901, [1.0, 0.0, 0.0, 0.0]), (902, [1.0, 0.0, 0.0, 0.0])]
    attributes = spark.createDataFrame([*rows, (903, None)], "item long, embedding array<double>")
    candidates = spark.createDataFrame([(i,) for i, _ in rows] * 2 + [(903,), (999,)], "item long")
    got = diversity_bounds(candidates, attributes, n, distance=distance).first()
    low, high = plain([v for _, v in rows], n, distance)
    assert got["lowest"] == pytest.approx(low, abs=1e-9) and got["highest"] == pytest.approx(high, abs=1e-9)
    assert got["patterns"] < math.comb(len(rows), n) / 2
    if n == 2:
        both = B.candidate_diversity(spark.createDataFrame([(i,) for i, _ in rows], "item long"), attributes, n).first()
        assert (both["lowest"], both["highest"]) == pytest.approx((got["lowest"], got["highest"]), abs=1e-9)


@pytest.mark.parametrize("distance", ["cosine", "euclidean"])
def test_cells_bound_their_items(distance):
    rng = np.random.default_rng(1)
    for _ in range(50):
        groups = [rng.normal(size=3) + rng.normal(size=(5, 3)) * rng.random() for _ in range(3)]
        if distance == "cosine":
            groups = [g / np.linalg.norm(g, axis=1, keepdims=True) for g in groups]
        centers = np.array([g.mean(axis=0) for g in groups])
        radii = np.array([np.linalg.norm(g - c, axis=1).max() for g, c in zip(groups, centers)])
        low, high = pair_bounds(centers[None], radii[None], distance)
        for picks in itertools.product(range(5), repeat=3):
            own = [g[k] for g, k in zip(groups, picks)]
            d = [1 - a @ b if distance == "cosine" else np.linalg.norm(a - b) for a, b in itertools.combinations(own, 2)]
            assert low[0] - 1e-12 <= np.mean(d) <= high[0] + 1e-12


def test_odd_sizes(spark):
    attributes = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "item long, embedding array<double>")
    assert tuple(diversity_bounds(attributes, attributes, 1).first()) == (None, None, 0)
    assert tuple(diversity_bounds(attributes, attributes, 2).first())[:2] == (1.0, 1.0)
    with pytest.raises(ValueError):
        diversity_bounds(attributes, attributes, 3)
    with pytest.raises(ValueError):
        diversity_bounds(attributes, attributes, 2, distance="manhattan")
