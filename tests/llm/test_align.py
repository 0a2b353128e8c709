"""Alignment of tokenizers against plain loops and the tokenizer files themselves."""

import hashlib
import json
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltline.llm import op13_align

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
_printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTER = {chr(c): c for c in _printed} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in _printed)}
NAME = {i: t for t, i in json.load(open(public_tokenizers.path("byte_bpe_50k.json")))["model"]["vocab"].items()}


def plain_tokens(text):
    a = [(i, bytes(LETTER[c] for c in NAME[i])) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in B.encode(text):
        p = B.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()))
    want = b" " + text.encode()
    return (a, b) if text and b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


def spans(tokens):
    at, out = 0, []
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def plain(texts):
    """Every overlap by comparing all pairs of tokens, groups by the common ends."""
    rows, holds = [], defaultdict(set)
    for k, t in enumerate(texts):
        a, b = map(spans, plain_tokens(t or ""))
        links = [(x, y) for x, s, e in a for y, u, v in b if max(s, u) < min(e, v)]
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = [[[str(i) for i, s, e in side if lo < e <= hi] for side in (a, b)] for lo, hi in zip([0, *cuts], cuts)]
        shown = ";".join("|".join(map(",".join, g)) for g in groups)
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(shown.encode()).hexdigest() if a else ""))
        for link in set(links):
            holds[link].add(k)
    top = defaultdict(int)
    for (x, _), docs in holds.items():
        top[x] = max(top[x], len(docs))
    count = {p: len(d) for p, d in holds.items()}
    return [(na, nb, ng, len(ls), sum(count[p] == top[p[0]] for p in ls), sum(count[p] for p in ls), sha) for na, nb, ng, ls, sha in rows]


TEXTS = [
    "Hello world, this is a test.", "Hello  world\tand\n\nmore", None, "", "été über ñandú 漢字 🎈🎈", "Hello world, this is a test.", "a▁b",
    "<|endoftext|> <s> <unk> </s>", "   ", "unbelievably unbelievable 1234567 " * 5, "▁", "x" * 90, "ﬁ ½ 　 \xa0 \0",
]
FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("width", [3, 16, 1 << 16])
def test_alignments_equal_plain_loops(spark, width):
    docs = spark.createDataFrame([(i, t, 1, "b") for i, t in enumerate(TEXTS)], "doc_id long, text string, row int, a string").repartition(3)
    got = op13_align.alignments(docs, width)
    assert got.columns == ["doc_id", *FIELDS]
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in got.collect()}
    assert got == dict(enumerate(plain(TEXTS)))
    assert got[2] == got[3] == got[6] == (0, 0, 0, 0, 0, 0, "") and got[7][0] > 0


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.count_sum) for r in op13_align.alignments(docs).collect())
    want = plain(["one two", "one two", "one"])
    assert got == sorted([(1, want[0][5]), (1, want[1][5]), (0, want[2][5])])
    assert op13_align.alignments(docs.limit(0)).count() == 0


def test_pairs_beyond_the_sent_bound_are_joined(spark, monkeypatch):
    from siltline.llm import common

    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    monkeypatch.setattr(common, "SENT_KEYS", 0)
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in op13_align.alignments(docs, 16).collect()}
    assert got == dict(enumerate(plain(TEXTS)))


def test_long_texts(spark):
    texts = ["word " * 60000 + "x" * 5000, "a" + " " * 1_200_000 + "b", "no blank " + "y" * 200_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in op13_align.alignments(docs).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_a, got[i].n_b) == (len(A.encode(" " + t, add_special_tokens=False).ids), len(B.encode(t)))
        assert got[i].n_links == got[i].n_a + got[i].n_b - got[i].n_groups > 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "  ", "the ", "▁", "\n", "é", "漢", " word", "<s>", "12"]), max_size=60).map("".join), st.integers(1, 12))
def test_parts_do_not_change_ids(text, size):
    got = [i for p in op13_align.parts(text, size) for i in B.encode(p)]
    assert got == B.encode(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=40), st.lists(st.integers(1, 4), min_size=1, max_size=40))
def test_diagonals_equal_a_sorted_merge(x, y):
    ea, eb = np.cumsum(x), np.cumsum(y)
    path = sorted([(e, 0) for e in ea] + [(e, 1) for e in eb])
    for d in range(len(path) + 1):
        assert op13_align.diagonal(ea, eb, d) == (sum(s == 0 for _, s in path[:d]), sum(s == 1 for _, s in path[:d]))
