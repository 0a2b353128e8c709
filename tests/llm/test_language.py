"""Language inference against plain loops over every word, and in bounded memory."""

import math
import resource
import time

import numpy as np
import pytest

from siltline.llm import op3_language as op3


def _plain(text, logp):
    """(language, its proportion, size of the set, known) of one text, word by word."""
    words = text.translate(op3._LETTERS).split()
    langs = range(len(logp))
    ll = []
    for w in words:
        bucket = op3.trigrams([w])[0]
        ll.append([sum(float(logp[j][b]) for b in bucket) / 3 for j in langs])
    top = [max(x) for x in ll]
    lik = [[math.exp(v - t) for v in x] for x, t in zip(ll, top)]

    def em(allowed):
        pi = {j: 1 / len(allowed) for j in allowed}
        for _ in range(op3.ROUNDS):
            new = dict.fromkeys(allowed, 0.0)
            for x in lik:
                s = max(sum(pi[j] * x[j] for j in allowed), 1e-300)
                for j in allowed:
                    new[j] += pi[j] * x[j] / s
            pi = {j: v / len(words) for j, v in new.items()}
        return pi, [max(sum(pi[j] * x[j] for j in allowed), 1e-300) for x in lik]

    first = [sum(x[j] / sum(x) for x in lik) for j in langs]
    short = sorted(sorted(langs, key=lambda j: -first[j])[: op3.SHORTLIST])
    pi, mix = em(short)
    cost = op3.PENALTY * math.log(len(words) + 1)
    single = [sum(x[j] - t for x, t in zip(ll, top)) for j in langs]
    one = max(langs, key=lambda j: single[j])
    sets = [(single[one] - cost, one, pi.get(one, 0.0), 1)]
    rank = sorted(short, key=lambda j: -pi[j])
    for m in range(2, len(short) + 1):
        p, like = em(sorted(rank[:m]))
        best = max(sorted(p), key=lambda j: p[j])
        sets.append((sum(map(math.log, like)) - m * cost, best, p[best], m))
    _, lang, share, n = max(sets, key=lambda s: s[0])
    gain = [t + math.log(x) + len(w) / 3 * op3.BUCKETS * math.log(2) for w, t, x in zip(words, top, mix)]
    return lang, share, n, sum(g >= 0 for g in gain) * 2 >= len(words) or sum(gain) >= 0


def _model(languages, seed):
    """Languages that each write in ten letters of their own and share some with the others."""
    rng = np.random.default_rng(seed)
    alphabets = [rng.choice(list(b"abcdefghijklmnopqrstuvwxyz"), 10, replace=False) for _ in range(languages)]
    write = lambda j, n: b" ".join(bytes(rng.choice(alphabets[j], rng.integers(1, 9)).tolist()) for _ in range(n))
    counts = [np.bincount(op3.trigrams([write(j, 4000)])[0], minlength=1 << op3.BUCKETS) + 0.5 for j in range(languages)]
    return np.log(np.array([n / n.sum() for n in counts])), write, rng


@pytest.mark.parametrize("languages", [1, 4, 20])
@pytest.mark.parametrize("block", [op3.BLOCK, 50])
def test_inference_is_the_plain_one(monkeypatch, languages, block):
    monkeypatch.setattr(op3, "BLOCK", block)
    logp, write, rng = _model(languages, languages)
    texts = [write(int(rng.integers(languages)), int(n)) for n in rng.integers(1, 60, 12)]
    texts += [b" 12 ".join(write(int(j), 25) for j in rng.integers(0, languages, 3)) for _ in range(6)]
    texts += [texts[0] * 3, b"the the The", "é".encode(), b"", b"12 .", b"q" * 300]
    got = list(zip(*(x.tolist() for x in op3.infer(texts, logp)), strict=True))
    for text, (lang, share, n, known) in zip(texts, got, strict=True):
        if not text.strip(b" 12."):
            assert (lang, share, n, known) == (-1, 0.0, 0, False)
            continue
        want = _plain(text, logp)
        assert (lang, n, known) == (want[0], want[2], want[3]) and share == pytest.approx(want[1], abs=1e-9)


def test_a_long_text_in_many_languages_is_bounded():
    """10 MB of letters at random, of which nearly all words differ, in 200 languages."""
    rng = np.random.default_rng(0)
    logp = np.log(rng.dirichlet(np.full(1 << op3.BUCKETS, 0.1), 200) + 1e-9).astype(np.float32)
    x = rng.integers(97, 123, 10_000_000, dtype=np.uint8)
    x[rng.random(len(x)) < 0.16] = 32
    before, t = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    best, _, sets, _ = op3.infer([x.tobytes()], logp)
    assert best[0] >= 0 and 1 <= sets[0] <= op3.SHORTLIST
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 500 and time.time() - t < 120
