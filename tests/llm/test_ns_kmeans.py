import hashlib

import numpy as np
import pytest

from weirflow.llm import ns_kmeans


def brute(rows, clusters, rounds, dimensions, scale=1024, seed=3):
    """Plain rounds in Python numbers over (id, vector)."""
    kept = [(i, [int(np.floor(np.float64(x) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "")
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:clusters]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min((away(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        found = [nearest(v)[1] for _, v in kept]
        groups = [[v for (_, v), j in zip(kept, found, strict=True) if j == k] for k in range(len(centroids))]
        centroids = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centroids, strict=True)]
    return sorted(((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), key=repr), centroids


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, cluster string").repartition(3)


@pytest.mark.parametrize("seed", range(4))
def test_equals_plain_rounds(spark, seed):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, 4)) * (0.3 if seed % 2 else 2)
    rows = [(i, [float(x) for x in middles[i % 5] + rng.normal(size=4) * 0.4], "clash") for i in range(300)]
    assigned, history, computed = ns_kmeans.kmeans(frame(spark, rows, "double"), clusters=6, rounds=8, dimensions=4)
    want, centroids = brute([r[:2] for r in rows], 6, 8, 4)
    assert sorted(map(tuple, assigned.collect()), key=repr) == want
    assert history[-1].tolist() == centroids and len(history) == 9
    assert computed[0] == 1800 and sum(computed[2:]) < 0.8 * 1800 * 7


def test_nulls_ties_repeats_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 0.0]), (6, [0.0, -inf]), (7, [1.0, 2.0, 3.0])]
    good = [(10, [0.0, 0.0]), (11, [0.0, 0.0]), (12, [2.0, 0.0]), (12, [2.0, 0.0]), (None, [1.0, 0.0]), (None, [-1.0, -0.0001]), (13, [1.0, 1.0]), (14, [1.0, -1.0])]
    rows = [(i, v, None) for i, v in odd + good]
    for clusters in (1, 2, 3, 20):
        assigned, history, _ = ns_kmeans.kmeans(frame(spark, rows, "double"), clusters=clusters, rounds=4, dimensions=2)
        want, centroids = brute([r[:2] for r in rows], clusters, 4, 2)
        assert sorted(map(tuple, assigned.collect()), key=repr) == want and history[-1].tolist() == centroids
    assert ns_kmeans.report(frame(spark, [(1, [0.5] * 63, "")])).count() == 0
    assert ns_kmeans.report(frame(spark, []).limit(0)).count() == 0


def test_one_vector_many_times(spark):
    rows = [(i, [0.25] * 64, "") for i in range(100)] + [(200, [-0.5] * 64, "")]
    got = ns_kmeans.report(frame(spark, rows)).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in got if r.vec_id < 200} == {(0, 0, 0)} or len({r.cluster for r in got if r.vec_id < 200}) == 1
    assert len(got) == 101


def test_too_large(spark):
    with pytest.raises(Exception, match="64 bits"):
        ns_kmeans.kmeans(frame(spark, [(1, [1e9, 0.0], "")], "double"), dimensions=2)


def test_bounds_hold_over_many_rounds():
    """assign against all distances, with centroids that wander and come back, so that displacement and summed drifts part."""
    rng = np.random.default_rng(5)
    vectors = rng.integers(-1000, 1000, (500, 3)).astype("<i4")
    cluster, exact, since = np.full(500, -1, "int32"), np.zeros((500, 5), "int64"), np.zeros((500, 5), "uint16")
    start = rng.integers(-1000, 1000, (5, 3))
    history, computed = start[None], []
    for n in range(40):
        computed.append(int(ns_kmeans.assign(vectors, cluster, exact, since, history).sum()))
        away = np.stack([ns_kmeans.squared(vectors, c) for c in history[-1]], axis=1)
        assert (cluster == away.argmin(axis=1)).all()
        history = np.concatenate([history, (start + rng.integers(-60, 60, (5, 3)) * (n % 2))[None]])
    assert sum(computed[1:]) < 0.6 * 39 * 2500
