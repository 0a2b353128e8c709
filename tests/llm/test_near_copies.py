"""Near copies of the pipeline's stage against brute force over all pairs."""

import numpy as np

from siltline.llm import near_copies

SCHEMA = "doc_id long, text string"


def planted():
    """Texts of 100 to 1000 words, each with copies of similarity 0.75 to 0.97 by scattered changes."""
    rng = np.random.default_rng(8)
    words, out = [f"w{i}" for i in range(3000)], []
    for n in (100, 300, 1000):
        for _ in range(12):
            base = list(rng.choice(words, n))
            out.append(" ".join(base))
            for share in (0.004, 0.012, 0.02, 0.03):
                copy = list(base)
                for at in rng.choice(n, max(1, round(share * n)), replace=False):
                    copy[at] = f"new{rng.integers(10**9)}"
                out.append(" ".join(copy))
    return out


def lows(texts):
    """The smallest member of the component of each text, by all pairs."""
    words = [t.lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    low, links = list(range(len(texts))), {0.8: 0, 0.9: 0, 0.95: 0}
    for i in range(len(texts)):
        for j in range(i):
            s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if s >= 0.8:
                links[max(x for x in links if x <= s)] += 1
                a, b = sorted((low[i], low[j]))
                low = [a if x == b else x for x in low]
    return low, links


def test_planted_copies_go(spark):
    import corpus_pipeline

    texts = planted()
    low, links = lows(texts)
    assert all(links.values())
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == sorted(set(low))


def test_slices_and_a_hot_template(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SLICE", 7)
    rng = np.random.default_rng(9)
    base = [f"t{i}" for i in range(120)]
    texts = [" ".join([*base[:at], f"fill{i}", *base[at + 1 :]]) for i, at in enumerate(rng.integers(0, 120, 60))]
    texts += [" ".join(rng.permutation(base)) for _ in range(5)]
    low, _ = lows(texts)
    got = sorted(r.doc_id for r in near_copies.one_per_group(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect())
    assert got == sorted(set(low)) == [0, 60, 61, 62, 63, 64]


def test_a_family_that_only_cells_connect(spark, monkeypatch):
    """Copies with many changes each: few are similar to a key's smallest node."""
    monkeypatch.setattr(near_copies, "SLICE", 16)
    rng = np.random.default_rng(10)
    base, texts = [f"t{i}" for i in range(150)], []
    for i in range(90):
        copy = list(base)
        for at in rng.choice(150, rng.integers(1, 6), replace=False):
            copy[at] = f"x{i}_{at}"
        texts.append(" ".join(copy))
    low, _ = lows(texts)
    got = sorted(r.doc_id for r in near_copies.one_per_group(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect())
    assert got == sorted(set(low)) and 1 < len(got) < 60


def test_overlaps_are_counted_exactly():
    rng = np.random.default_rng(11)
    for few in (0, 3, 10**6):
        near_copies.FEW, before = few, near_copies.FEW
        try:
            x, y = ([np.unique(rng.integers(0, 90, n, dtype=np.uint64)) for n in rng.integers(0, 60, m)] for m in (17, 23))
            want = [[len(np.intersect1d(a, b)) for b in y] for a in x]
            assert near_copies.overlaps(x, y, columns=8).tolist() == want
        finally:
            near_copies.FEW = before


def test_clashing_names_and_ties(spark):
    rows = [(1, "a b c", 5, "x"), (1, "a b c", 6, "y"), (2, "a  b c", 7, "z")]
    got = near_copies.one_per_group(spark.createDataFrame(rows, "doc_id long, text string, d long, node string")).collect()
    assert len(got) == 1 and got[0].doc_id == 1 and got[0].d in (5, 6)


def test_rows_without_words_and_repeated(spark):
    rows = [(1, "a b"), (2, None), (3, ""), (4, "A  b"), (5, "c"), (5, "c"), (None, "a b"), (None, None)]
    got = near_copies.one_per_group(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, ""), (0, "a b"), (1, "a b"), (2, ""), (5, "c")]
    assert near_copies.one_per_group(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_that_share_an_id_are_judged_apart(spark):
    words = [[f"{c}{i}" for i in range(60)] for c in "abc"]
    a, b, c = map(" ".join, words)
    rows = [(1, a), (5, a + " end"), (5, b), (7, c), (7, b + " end")]
    got = near_copies.one_per_group(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == [(1, a), (5, b), (7, c)]
