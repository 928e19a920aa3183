"""Embedding near-duplicates against brute force; estimates, bounds and the plan of bands."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import vectors


def brute(rows, threshold=0.93):
    """rows: (id, vector, label), ids unique."""
    ok = [i for i, (_, x, label) in enumerate(rows) if label is not None and x and None not in x and np.isfinite(x).all() and any(x)]
    n, parent = dict.fromkeys(range(len(rows)), 0), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    groups = {}
    for i in ok:
        groups.setdefault((rows[i][2], len(rows[i][1])), []).append(i)
    for own in groups.values():
        u = np.array([rows[i][1] for i in own], dtype=np.float64)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        near = u @ u.T >= threshold
        np.fill_diagonal(near, False)
        for a, b in zip(*np.nonzero(near), strict=True):
            n[own[a]] += 1
            x, y = root(own[a]), root(own[b])
            parent[max(x, y, key=lambda i: rows[i][0])] = min(x, y, key=lambda i: rows[i][0])
    return sorted((r[0], n[i], rows[root(i)][0], root(i) == i) for i, r in enumerate(rows))


def around(rng, centre, degrees):
    """A vector at exactly this angle from the centre."""
    c = centre / np.linalg.norm(centre)
    z = rng.standard_normal(len(c))
    z -= (z @ c) * c
    z /= np.linalg.norm(z)
    a = math.radians(degrees)
    return (math.cos(a) * c + math.sin(a) * z) * rng.uniform(0.1, 9)


def many(rng, size=32):
    """Groups of near copies, tight and loose, chains over the threshold's angle (21.57 degrees) and lone vectors."""
    out = []
    for degrees, count in ((2, 60), (7, 80), (10.7, 60), (14, 50), (18, 40), (21, 30)):
        centre = rng.standard_normal(size)
        out += [around(rng, centre, degrees * rng.uniform(0.3, 1)) for _ in range(count)]
        out += [around(rng, centre, d) for d in (12, 19, 21.5, 21.6, 24, 28, 33)]
    for _ in range(30):
        a = rng.standard_normal(size)
        out += [a, around(rng, a, 21.55), around(rng, a, 21.6), a * 3]
    chain = rng.standard_normal(size)
    for _ in range(12):
        chain = around(rng, chain, 20)
        out.append(chain)
    out += list(rng.standard_normal((250, size)))
    return out


def test_estimates_are_unbiased_and_their_bounds_hold():
    rng = np.random.default_rng(2)
    a = vectors.unit(rng.standard_normal((1, 64)))
    errors, out = [], 0
    for angle in (5, 20, 21.5, 60, 90):
        b = vectors.unit(np.array([around(rng, a[0], angle) for _ in range(2000)]))
        code, factor = vectors.codes(b, 64)
        est, bound = vectors.estimates(a @ vectors.rotation(64, 0).T, code, factor)
        errors.append((est[0] - math.cos(math.radians(angle))).mean())
        out += (np.abs(est[0] - math.cos(math.radians(angle))) > bound).sum()
    assert max(map(abs, errors)) < 0.01 and out == 0


@pytest.mark.parametrize("largest", [0, 10, 5000, 300_000, 10**9])
def test_bands_meet_the_chance_of_a_miss(largest):
    bits, bands = vectors.plan(largest, 0.93, 1e-6)
    assert (1 - (1 - math.acos(0.93) / math.pi) ** bits) ** bands <= 1e-6
    assert largest / 2**bits <= vectors.CROWD or bits == 4


@pytest.mark.parametrize("options", [{}, {"least_ball": 4, "block": 25, "crowd": 16}, {"least_ball": 4, "crowd": 100}, {"least_ball": 10**6}])
def test_links_equal_brute_force(spark, options):
    rng = np.random.default_rng(8)
    rows = [(i, x.astype(np.float32).tolist(), int(rng.integers(2)) * 0 + (i % 7 == 0)) for i, x in enumerate(many(rng))]
    order = rng.permutation(len(rows))
    rows = [(int(order[i]), x, label) for i, x, label in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(tuple(r) for r in vectors.near_vectors(df, **options).collect())
    assert got == brute(rows)


def test_a_crowd_becomes_balls_and_is_counted_without_its_pairs(spark, monkeypatch):
    """2,000 near copies: few items are left to meet, and every vector still has all its links."""
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(64)
    rows = [(i, around(rng, centre, 5).tolist(), 1) for i in range(2000)] + [(2000 + i, rng.standard_normal(64).tolist(), 1) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    written, cut = [], vectors.Cut
    monkeypatch.setattr(vectors, "Cut", lambda d: written.append(cut(d)) or written[-1])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect()}
    assert all(got[i] == (1999, 0, i == 0) for i in range(2000)) and all(got[i] == (0, i, True) for i in range(2000, 2500))
    named = next(w.df for w in written if "node" in w.df.columns and "k" in w.df.columns and "w" in w.df.columns)
    assert named.select("node").distinct().count() < 1200


def test_edge_cases(spark):
    e = [1.0, 2.0, 3.0]
    rows = [(1, e, 1), (2, [2.0, 4.0, 6.0], 1), (3, e, 2), (4, e, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 3.0], 1), (9, [1.0, float("nan"), 3.0], 1),
            (10, [1.0, float("inf"), 3.0], 1), (11, [*e, 0.0], 1), (12, [1e200, 2e200, 3e200], 1), (13, [1e-310, 2e-310, 3e-310], 1), (14, [5.0], 1), (15, [-5.0], 1), (16, [7.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(0) for c in ("k", "node", "g", "n_links", "kept", "home", "id", "x")})
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect()}
    assert {i: v for i, v in got.items() if v[0]} == {1: (3, 1, True), 2: (3, 1, False), 12: (3, 1, False), 13: (3, 1, False), 14: (1, 14, True), 16: (1, 14, False)}
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, 15))
    assert vectors.near_vectors(df.limit(0)).count() == 0
    twice = spark.createDataFrame([("a", e, 1), ("a", e, 1), (None, e, 1), ("b", [3.0, -1.0, 0.0], 1), (None, [0.0, 0.0, 1.0], None)], "key string, v array<double>, label int")
    out = sorted((tuple(r) for r in vectors.near_vectors(twice, vec_id="key", embedding="v").collect()), key=str)
    assert out == sorted([("a", 2, "a", True), ("a", 2, "a", False), (None, 2, "a", False), ("b", 0, "b", True), (None, 0, None, True)], key=str)
