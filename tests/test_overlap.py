"""The join of titles by shingles against all pairs, and what it leaves to be measured."""

import random

from siltline.operators import overlap
from siltline.plans import cascade


def texts(n):
    rng = random.Random(5)
    words = ["".join(rng.choices("aeioulnrst", k=rng.randrange(2, 6))) for _ in range(60)]
    out = ["a", "ab", "aaaaaa", "aaaaaaa", "🎈é漢", "🎈é漢字abc", "🎈é漢字abcd"]
    while len(out) < n:
        t = [rng.choice(words) for _ in range(rng.randrange(1, 60))]
        for _ in range(rng.randrange(3)):
            out.append(" ".join(t))
            t[rng.randrange(len(t))] = rng.choice(words)
    return sorted(set(out))


def grams(t):
    return {t[i : i + 5] for i in range(max(1, len(t) - 4))}


def test_pairs_equal_all_pairs_and_few_are_measured(spark):
    titles = texts(400)
    sets = list(map(grams, titles))
    for t, s in zip(titles, sets):
        assert len(overlap.shingle_set(t)) == len(s)
    want = {}
    for a, x in enumerate(sets):
        for b in range(a + 1, len(sets)):
            s = len(x & sets[b]) / len(x | sets[b])
            if s >= 0.8:
                want[a, b] = round(s, 6)
    posts = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    assert {(r.a, r.b): r.jaccard for r in cascade.title_pairs(posts).collect()} == want and len(want) > 90
    one = posts.withColumnRenamed("title", "t")
    prefix = overlap.prefixes(one, overlap.bucket_counts(one), 0.8)
    assert prefix.count() < 0.3 * sum(map(len, sets)) + 2 * len(sets)  # before, whole sets were dealt
    assert overlap.candidates(prefix, 0.8).count() < 2 * len(want)
