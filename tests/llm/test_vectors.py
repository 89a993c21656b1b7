"""Search, clustering and whitening of vectors against brute force, with nulls, ties, repeats and clashing columns."""

import hashlib
import random

import numpy as np
import pytest
from compare import connect, same
from pyspark.sql import functions as F

from lodestone.llm import clusters, queries, topk, whitening
from lodestone.llm.vectors import scaled

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    """Rows of (vec_id, embedding) with extra columns named as outputs."""
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for name in ("q", "id", "x", "rank", "score", "cluster", "component", "values", "distance"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def random_rows(n, width, seed=0, values=20):
    rng = random.Random(seed)
    rows = [(i, [rng.randint(-values, values) / 16 for _ in range(width)]) for i in range(n)]
    rows += [(100 + i, rows[7][1]) for i in range(0, 60, 3)]  # many equal vectors
    rows += [(None, rows[3][1]), (50, None), (150, [NAN] + [0.5] * (width - 1)), (200, [INF] + [0.5] * (width - 1)), (250, [None] + [0.5] * (width - 1)), (7, rows[7][1])]
    rng.shuffle(rows)
    return rows


def usable(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


def integers(v, scale):
    return [int(np.floor(scale * float(np.float32(c)))) for c in v]


@pytest.mark.parametrize("name", ["op11_topk", "op12_kmeans"])
def test_against_sql(spark, name):
    same(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name])


def slow_top_k(rows, k, scale):
    good = [(i, integers(v, scale)) for i, v in rows if usable(v)]
    out = []
    for q, x in good:
        if q is not None and q % 50 == 0:
            found = sorted(((-sum(a * b for a, b in zip(x, y, strict=False)), i is None, i or 0) for i, y in good if i != q))[:k]
            out += [(q, r + 1, None if gone else i, -s) for r, (s, gone, i) in enumerate(found)]
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 7])
def test_top_k_against_brute_force(spark, monkeypatch, parts):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)  # several passes
    rows = random_rows(700, 6, values=3)  # small values: many equal scores
    rows += [(1000, []), (1001, [1.0])]
    got = topk.top_k(frame(spark, rows).repartition(parts), F.col("vec_id") % 50 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow_top_k(rows, 5, 256)


def test_top_k_reads_part_of_the_lists():
    rng = np.random.default_rng(5)
    rows = np.floor(256 * rng.standard_normal((4096, 16)) / 4)
    asked = np.concatenate([rows[:40] + rng.integers(-2, 3, (40, 16)), np.floor(256 * rng.standard_normal((40, 16)) / 4)])
    best, ids = topk.Best(len(asked), 5), np.arange(len(rows))
    for start, end in ((0, 256), (256, 1280), (1280, 4096)):
        part = topk.read_block(rows[start:end], ids[start:end], np.zeros(end - start, bool), asked, np.full(len(asked), -1), best)
    assert part < 0.8
    score = rows @ asked.T
    for q in range(len(asked)):
        order = np.lexsort((ids, -score[:, q]))[:5]
        assert best.id[best.q == q].tolist() == order.tolist() and best.score[best.q == q].tolist() == score[order, q].tolist()


def test_bounds_hold_at_every_depth():
    rng = np.random.default_rng(6)
    rows, asked = rng.integers(-9, 10, (60, 5)).astype(float), rng.integers(-9, 10, (8, 5)).astype(float)
    lists, score = topk.Lists(rows), rows @ asked.T
    for depth in range(1, 61):
        lists.read_to(depth)
        lower, upper = lists.bounds(asked)
        assert (lower <= score).all() and (score <= upper).all()
    assert (lower == score).all() and (upper == score).all()


def test_top_k_of_little(spark):
    none = frame(spark, [])
    assert topk.top_k(none, F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(frame(spark, [(50, [1.0])]), F.col("vec_id") % 50 == 0).count() == 0  # no candidate but itself
    two = topk.top_k(frame(spark, [(50, [1.0]), (1, [-2.0])]), F.col("vec_id") % 50 == 0)
    assert [tuple(r) for r in two.collect()] == [(50, 1, 1, -131072)]
    with pytest.raises(Exception, match="below"):
        topk.top_k(frame(spark, [(50, [1e30]), (1, [1.0])]), F.col("vec_id") % 50 == 0).count()


def slow_k_means(rows, width, k, rounds, scale=1024):
    good = [(i, integers(v, scale)) for i, v in rows if usable(v) and len(v) == width]
    start = sorted((i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest(), x) for i, x in good)[:k]
    centre = [x for *_, x in start]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    nearest = lambda x: min(range(len(centre)), key=lambda j: (far(x, centre[j]), j))
    for _ in range(rounds):
        own = [[] for _ in centre]
        for _, x in good:
            own[nearest(x)].append(x)
        centre = [[sum(c) // len(xs) for c in zip(*xs, strict=True)] if xs else centre[j] for j, xs in enumerate(own)]
    label = [(i, nearest(x), x) for i, x in good]
    each = [(i, j, far(x, centre[j])) for i, j, x in label]
    total = sum(d for *_, d in each)
    return sorted(((i, j, d, sum(e for _, m, e in each if m == j), total, hashlib.sha256(",".join(map(str, centre[j])).encode()).hexdigest()) for i, j, d in each), key=str)


@pytest.mark.parametrize("parts", [1, 5])
def test_k_means_against_brute_force(spark, monkeypatch, parts):
    monkeypatch.setattr(clusters, "TREE", 100)
    rows = random_rows(400, 4, values=9) + [(2000, [0.5] * 3), (2001, []), (2002, [0.5] * 5)]
    got = clusters.k_means(frame(spark, rows).repartition(parts), width=4)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow_k_means(rows, 4, 8, 10)


def test_filtering_equals_plain_assignment():
    rng = np.random.default_rng(2)
    for n, width, k, spread in ((1, 3, 2, 5), (9, 2, 4, 3), (500, 2, 8, 40), (300, 8, 8, 4), (64, 1, 5, 2)):
        points = rng.integers(-spread, spread + 1, (n, width))
        centroids = points[rng.integers(0, n, k)]  # repeated ones too
        _, tree = clusters.build(points)
        far = clusters.squared(tree.points, centroids)
        label, distance = clusters.labelled(tree, centroids)
        assert (label == far.argmin(1)).all() and (distance == far.min(1)).all()
        count, sums = clusters.moved(tree, centroids)
        assert (count == np.bincount(label, minlength=k)).all()
        assert all((sums[j] == tree.points[label == j].sum(0)).all() for j in range(k))


def test_filtering_prunes():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.integers(-20, 21, (200, 2)) + c for c in ([0, 0], [1000, 0], [0, 1000], [1000, 1000])])
    _, tree = clusters.build(points)
    centroids = np.array([[0, 0], [1000, 0], [0, 1000], [1000, 1000]])
    whole = [len(at) for at, _, w in clusters.filtered(tree, centroids) if w]
    points_met = sum(len(at) for at, _, w in clusters.filtered(tree, centroids) if not w)
    assert sum(whole) <= 8 and points_met == 0  # four clusters go as whole nodes


def test_k_means_of_little(spark):
    assert clusters.k_means(frame(spark, []), width=2).count() == 0
    few = [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])]
    got = clusters.k_means(frame(spark, few), width=2).collect()
    assert sorted((tuple(r) for r in got), key=str) == slow_k_means(few, 2, 8, 10)


def slow_whitening(rows, k, scale=256):
    good = [(i, integers(v, scale)) for i, v in rows if usable(v)]
    width = max(len(x) for _, x in good)
    good = [(i, x + [0] * (width - len(x))) for i, x in good]
    fit = np.array(sorted({tuple(x) for _, x in good}))
    centred = fit - fit.mean(0)
    e, u = np.linalg.eigh(centred.T @ centred / len(fit))
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    total = [int(s) for s in fit.sum(0)]
    return {(i, tuple(x)): (len(fit), sum((len(fit) * a - s) ** 2 for a, s in zip(x, total, strict=True)), (np.array(x) - fit.mean(0)) @ u / np.sqrt(e)) for i, x in good}, e / np.trace(centred.T @ centred / len(fit))


@pytest.mark.parametrize(("width", "parts"), [(3, 1), (24, 6), (40, 3)])
def test_whitening_against_brute_force(spark, width, parts):
    rng = np.random.default_rng(width)
    rows = random_rows(300, width, values=30)
    rows = [(None if i is None else at, None if v is None else [None if c is None else float(c * (1 + 3 * (j == 0) + (j == 1))) for j, c in enumerate(v)]) for at, (i, v) in enumerate(rows)]
    rows += [(900 + i, [float(c) for c in rng.standard_normal(width)]) for i in range(50)]
    df = frame(spark, rows).repartition(parts)
    got = whitening.whiten(df).join(scaled(df, 256).select(F.col("id").alias("vec_id"), F.col("x").alias("ints")).distinct(), "vec_id").collect()
    want, explained = slow_whitening(rows, 4)
    m = min(4, width)
    signs = {}
    assert len({(r["vec_id"], r["component"]) for r in got}) == m * len({i for (i, _), _ in want.items() if i is not None})
    for r in got:
        n, deviation, whitened = want[r["vec_id"], tuple(r["ints"])]
        c = r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviation)
        if abs(whitened[c]) > 1e-3:
            signs.setdefault(c, np.sign(whitened[c] * r["whitened"]))
            assert r["whitened"] * signs[c] == pytest.approx(whitened[c], rel=1e-7, abs=1e-7)
        assert r["explained"] == pytest.approx(explained[c], rel=1e-9) and r["identity_error"] < 1e-9
    assert set(signs) == set(range(m))


def test_whitening_keeps_every_row(spark):
    rows = random_rows(60, 5)
    n = sum(usable(v) for _, v in rows)
    assert whitening.whiten(frame(spark, rows)).count() == 4 * n


def test_whitening_of_little(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, []), (2, [])])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).count() == 0  # no spread at all
    line = whitening.whiten(frame(spark, [(i, [i / 4, i / 2, 0.0]) for i in range(10)])).collect()
    assert {r["component"] for r in line} == {1} and len(line) == 10  # one dimension: one component
    assert np.var([r["whitened"] for r in line]) == pytest.approx(1)


def test_lobpcg_with_close_eigenvalues():
    rng = np.random.default_rng(9)
    u = np.linalg.qr(rng.standard_normal((120, 120)))[0]
    e = np.concatenate([[5.0, 4.99, 4.98, 4.97], np.linspace(4.9, 0.1, 116)])
    v = (u * e) @ u.T
    products = []
    found, x = whitening.lobpcg(lambda b: (products.append(b.shape[1]), v @ b)[1], 120, 4)
    assert found == pytest.approx(e[:4], rel=1e-12)
    assert np.abs(np.abs(np.sum(x * u[:, :4], axis=0)) - 1).max() < 1e-12
    assert max(products) <= 3 * (4 + whitening.GUARD)
