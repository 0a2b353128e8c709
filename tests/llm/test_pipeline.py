"""run() against a plain version of its four stages on a small table."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def made():
    rng = np.random.default_rng(21)
    words = {"en": [f"the{a}ing" for a in "bcdfghklmnprst"] + ["and", "of"], "de": [f"sch{a}ung" for a in "aeiou"] + ["und", "der", "nicht"]}
    item = " ".join(f"bench{a}{b}" for a in "abcde" for b in "uvwx")
    texts = []
    for i in range(40):
        base = list(rng.choice(words["en" if i % 2 else "de"], int(rng.integers(12, 160))))
        texts.append(" ".join(base))
        if i % 4 == 0:
            base[int(rng.integers(len(base)))] = "changed"
            texts.append(" ".join(base))
        if i % 9 == 0:
            texts.append("  ".join(base))
    texts += [item, "the band " + item, texts[5] + " " + item, None, "", "12 34 !", texts[3], " ".join(rng.choice(words["en"], 3000))]
    return texts, item


def kept(texts, item):
    docs = [i for i, t in enumerate(texts) if t and re.search(r"[^\W\d_]", t)]
    grams = {}
    for i in docs:
        w = texts[i].lower().split()
        grams[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    low = {i: i for i in docs}
    for i in docs:
        for j in docs:
            if j < i and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                a, b = sorted((low[i], low[j]))
                low = {k: a if v == b else v for k, v in low.items()}
    docs = sorted(set(low.values()))
    b = WORD.findall(item.lower())
    windows = {tuple(b[j : j + 13]) for j in range(len(b) - 12)}
    out = []
    for i in docs:
        w = WORD.findall(texts[i].lower())
        hit = {p for j in range(len(w) - 12) if tuple(w[j : j + 13]) in windows for p in range(j, j + 13)}
        if not (hit and 20 * len(hit) >= len(w)):
            out.append(i)
    return out


def test_run_equals_its_plain_version(spark, tmp_path):
    texts, item = made()
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    want = Counter()
    for i in kept(texts, item):
        ids = [*encode(texts[i], add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        for n, (a, z) in enumerate(zip(cuts, cuts[1:])):
            want[i, n, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    at = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    total = sum(at.values())
    assert max(at.values()) <= 2048 and len(at) <= -(-total // 2048) + 1


def test_stages_keep_clashing_columns_and_take_empty_tables(spark, tmp_path):
    item = " ".join(f"bench{a}{b}" for a in "abcde" for b in "uvwx")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, score double, d int, h string, node int, key string"
    rows = [(1, "the band and the singing " * 4, "en", 0.5, 1, "x", 2, "k"), (1, "the band and the singing " * 4, "en", 0.5, 1, "x", 2, "k"), (None, "and of the thing", None, None, None, None, None, None), (3, None, "en", 1.0, 2, "y", 3, "l")]
    for name, stage in corpus_pipeline.STAGES:
        for data in (rows, []):
            docs = spark.createDataFrame(data, schema)
            out = stage(spark, docs, str(tmp_path))
            n = out.count()
            assert n == 0 if not data else n > 0
            if name != "packing":
                assert out.columns == docs.columns
