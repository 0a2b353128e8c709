"""Queries over whole values against brute force."""

import numpy as np

from siltline.operators import sphere
from siltline.plans import cascade, stores


def grams(t):
    return {t[i : i + 5] for i in range(max(1, len(t) - 4))}


def test_titles_are_compared_whole(spark):
    start = "".join(chr(97 + i * i % 23) + chr(97 + i % 26) for i in range(100))
    tails = ["".join(chr(97 + (i * k + i // 7) % 25) for i in range(400)) for k in (3, 7)]
    titles = [start + tails[0], start + tails[0] + "zz", start + tails[1], "qq" + start + tails[1], start, "other " + tails[1][:30]]
    posts = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    sets = list(map(grams, titles))
    want = {}
    for a in range(len(titles)):
        for b in range(a + 1, len(titles)):
            s = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if s >= 0.8:
                want[a, b] = round(s, 6)
    got = {(r.a, r.b): r.jaccard for r in cascade.title_pairs(posts).collect()}
    assert got == want and {(0, 1), (2, 3)} <= set(want) and (0, 2) not in want


def test_new_posts_are_known_by_whole_titles(spark):
    rows = [(3, "a", "the same start, stored"), (4, "a", "the same start, new"), (5, "a", "the same start, stored"), (6, "a", "the same start, new"), (7, "b", "the same start, new")]
    got = stores.new_posts(spark.createDataFrame(rows, "id long, subreddit string, title string")).collect()
    assert sorted(r.id for r in got) == [4, 7]


def test_all_near_vectors_are_found(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 16))
    vecs = np.concatenate([base[np.arange(60) % 12] + rng.normal(size=(60, 16)) * 0.25, base[:1], base[:1], np.zeros((1, 16))])
    unit = vecs / np.maximum(np.linalg.norm(vecs, axis=1), 1e-30)[:, None]
    cos = unit @ unit.T
    n = len(vecs)
    want = {(i, j): round(float(cos[i, j]), 6) for i in range(n) for j in range(i + 1, n) if cos[i, j] >= 0.9 and 61 not in (i, j)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    for block, pivots in ((9, 1024), (4, 7), (2048, 1024), (9, 1)):
        rows = sphere.near_vectors(df, block, pivots).collect()
        got = {(r.a, r.b): r.cosine for r in rows}
        assert len(rows) == len(got) and got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert len([k for k in want if k[0] % 50 and k[1] % 50]) > 20


def test_pivots_compare_few_vectors_of_clusters(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(20, 64))
    vecs = base[np.arange(2000) % 20] + rng.normal(size=(2000, 64)) * 0.2
    unit = vecs / np.linalg.norm(vecs, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    rows = sphere.near_vectors(df, 100).collect()
    want = np.argwhere(np.triu(unit @ unit.T >= 0.9, 1)).tolist()
    assert sorted([r.a, r.b] for r in rows) == want and len(want) > 10_000
    _, cells = sphere.dealt(df.selectExpr("vec_id AS id", "embedding"), 100, 1024, 0.9)
    assert cells.homes.sum() == 2000 and cells.met < 0.15 * 2000 * 1999 / 2


def test_no_vectors(spark):
    none = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert sphere.near_vectors(none).count() == 0


def test_nearest_over_blocks(spark):
    """Blocks far below the tables, copies, a zero vector and nulls against plain sorting."""
    rng = np.random.default_rng(8)
    vecs = [v.tolist() for v in rng.normal(size=(70, 6))]
    vecs[40:44] = [vecs[0]] * 4
    vecs[13] = None
    rows = [(i, v) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    want = {}
    for q in range(0, 70, 10):
        rate = {i: round(float(np.dot(vecs[q], v) / np.linalg.norm(vecs[q]) / np.linalg.norm(v)), 6) for i, v in rows if i != q and v}
        want |= {(q, i): rate[i] for i in sorted(rate, key=lambda i: (-rate[i], i))[:3]}
    for block in (7, 4096):
        got = {(r["query"], r.other): r.cosine for r in sphere.nearest(df.where("id % 10 = 0"), df, 3, block).collect()}
        assert got == want
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "id long, embedding array<double>")
    got = [(r["query"], r.other, str(r.cosine)) for r in sphere.nearest(few.where("id < 2"), few, 3).orderBy("query", "other").collect()]
    assert got == [(0, 1, "None"), (0, 2, "nan"), (0, 3, "0.707107"), (1, 0, "None"), (1, 2, "None"), (1, 3, "None")]


def test_nearest_makes_no_row_a_pair(spark):
    df = spark.range(5000).selectExpr("id", "array(sin(id), cos(id), 1D) AS embedding")
    plan = sphere.nearest(df.where("id % 50 = 0"), df, 3)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_dealt_vectors_leave_in_small_frames(spark, monkeypatch):
    """Vectors without clusters visit every cell; no frame holds a batch times its cells."""
    monkeypatch.setattr(sphere, "DEALT", 50)
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 4)))], "vec_id long, embedding array<double>")
    unit = np.array([r.embedding for r in df.collect()])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    want = np.argwhere(np.triu(unit @ unit.T >= 0.9, 1)).tolist()
    assert sorted([r.a, r.b] for r in sphere.near_vectors(df, 40).collect()) == want
    frames = list(sphere.parts(iter([df.toPandas()]), 50))
    assert max(map(len, frames)) == 50 and sum(map(len, frames)) == 600


def test_short_numbers_lose_no_near_pair(monkeypatch):
    """Pairs on the threshold's very edge, tiles with few of them and with many."""
    monkeypatch.setattr(sphere, "TILE", (16, 64))
    rng = np.random.default_rng(10)
    x = sphere.unit_rows(rng.normal(size=(100, 8)))
    y = sphere.unit_rows(np.concatenate([rng.normal(size=(150, 8)), x[:50] + rng.normal(size=(50, 8)) * 0.02, np.repeat(x[:1], 70, axis=0)]))
    every = x @ y.T
    for edge in (0.9, float(every[3, 7]), float(np.nextafter(every[5, 160], 2)), float(every[90, 199])):
        got = {(int(i), int(j)): float(c) for at, low, cos in sphere.close(x, y, edge) for i, j, c in zip(at, low, cos)}
        sure = {(int(i), int(j)) for i, j in np.argwhere(every >= edge + 1e-12)}
        assert sure <= got.keys() <= {(int(i), int(j)) for i, j in np.argwhere(every >= edge - 1e-12)}
        assert all(abs(every[k] - c) < 1e-12 for k, c in got.items())
