"""The neighbour-keeping map: its parts against plain versions, its trust above the linear one's, reruns."""

import numpy as np

from pyspark.sql import functions as F

from curatrix.operators import layout, numeric


def clusters(n, seed=0, groups=9, width=20):
    rng = np.random.default_rng(seed)
    kind = rng.integers(0, groups, n)
    return rng.normal(0, 3, (groups, width))[kind] + rng.normal(0, 0.4, (n, width)), kind


def test_affinities_have_the_perplexity():
    x, _ = clusters(80)
    d = layout.distances(x, x)
    assert np.allclose(d, ((x[:, None] - x) ** 2).sum(2))
    p = layout.affinities(d, 10)
    assert np.allclose(p, p.T) and abs(p.sum() - 1) < 1e-6 and p.diagonal().max() <= 1e-12


def test_trustworthiness_against_plain_version():
    rng = np.random.default_rng(1)
    x, y = rng.random((30, 4)), rng.random((30, 2))
    total = 0
    for i in range(30):
        others = [j for j in range(30) if j != i]
        rank = {j: k + 1 for k, j in enumerate(sorted(others, key=lambda j: ((x[i] - x[j]) ** 2).sum()))}
        total += sum(max(0, rank[j] - 5) for j in sorted(others, key=lambda j: ((y[i] - y[j]) ** 2).sum())[:5])
    assert abs(layout.trustworthiness(x, y, 5) - (1 - 2 / (30 * 5 * (60 - 15 - 1)) * total)) < 1e-12
    assert layout.trustworthiness(x, x, 5) == 1


def test_map(spark):
    x, kind = clusters(600)
    rows = spark.createDataFrame([(k, v.tolist(), "keep") for k, v in enumerate(x)] + [(600, None, "a"), (601, [1.0, 2.0], "b"), (602, x[0].tolist(), "c"), (603, [float("nan")] * 20, "d")], "id int, embedding array<double>, x0 string").repartition(5)
    got = {r.id: r for r in layout.layout_2d(rows, sample=250).collect()}
    assert len(got) == 604 and got[600].x is None and got[601].y is None and got[603].x is None and (got[602].x, got[602].y) == (got[0].x, got[0].y)
    y = np.array([(got[k].x, got[k].y) for k in range(600)])
    line = {r.id: (r.x, r.y) for r in numeric.project_2d(rows.filter("id < 600")).collect()}
    linear = layout.trustworthiness(x, np.array([line[k] for k in range(600)]))
    assert layout.trustworthiness(x, y) > max(0.9, linear)
    # rows that were not in the sample lie in their cluster
    near = np.argsort(np.where(np.eye(600, dtype=bool), np.inf, layout.distances(y, y)), axis=1)[:, :5]
    assert (kind[near] == kind[:, None]).mean() > 0.97
    again = {r.id: (r.x, r.y) for r in layout.layout_2d(rows.orderBy(F.desc("id")), sample=250).collect()}
    assert all(np.allclose(again[k], y[k]) for k in range(600))


def test_few_vectors(spark):
    rows = lambda *x: spark.createDataFrame([(v,) for v in x], "embedding array<float>")
    assert [(r.x, r.y) for r in layout.layout_2d(rows([1.0, 2.0], [1.0, 2.0])).collect()] == [(0, 0), (0, 0)]
    assert layout.layout_2d(rows()).count() == 0
    assert [r.x for r in layout.layout_2d(rows(None)).collect()] == [None]
    two = layout.layout_2d(rows([0.0], [1.0])).collect()
    assert all(np.isfinite(r.x) for r in two) and two[0].x != two[1].x
