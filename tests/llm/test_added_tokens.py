"""Packed ids against the tokenizer file with its defaults, on texts that hold its added token and on very long runs of blanks."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltline.llm import op8_chat, op10_packing

END = "<|endoftext|>"
PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([END, "a", " b", " ", "  ", "\n", "\t", "é,", "1", "<|", "|>", "'s"]), max_size=12).map("".join), min_size=1, max_size=4))
def test_added_tokens_are_one_id(texts):
    for t in texts:
        assert np.frombuffer(op10_packing.encoder().encode(t, special=True), "<u4").tolist() == PLAIN.encode(t, add_special_tokens=False).ids


def test_packed_lengths_and_digests(spark):
    texts = [f"end{END}next", END, f"{END} {END}", f"a  {END}  b c", "plain text", ""]
    got = op10_packing.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = {i: [*PLAIN.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    assert {r.doc_id: (r.length, r.ids_crc32) for r in got} == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}


BLANKS = 1_200_000


@pytest.mark.parametrize("blank", [" ", "\t", "\n", "\xa0", "\u3000"])
def test_runs_of_blanks_have_the_ids_of_the_tokenizer_file(blank):
    texts = PLAIN, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts[1].encode_special_tokens = True
    for t in (blank * BLANKS, f"a{blank * BLANKS}b {END} c"):
        for special, full in zip((True, False), texts):
            got = op10_packing.encoder().encode(t, special)
            assert np.array_equal(np.frombuffer(got, "<u4"), full.encode(t, add_special_tokens=False).ids)


@given(st.lists(st.sampled_from([END, "a", " ", "  ", "\n", "\u3000", "é,", "1", "'s", "漢"]), max_size=20).map("".join), st.booleans())
def test_parts_have_the_same_ids(text, special):
    e = op10_packing.encoder()
    assert np.array_equal(np.fromiter(e.by_parts(text, special), "<u4"), np.frombuffer(e.encode(text, special), "<u4"))


def test_blanks_are_packed_and_formatted(spark):
    texts = [" " * BLANKS, f"one{chr(10) * BLANKS}two"]
    cut = op10_packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in cut} == {i: len(PLAIN.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    turns = spark.createDataFrame([(1, i, "assistant", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    got = op8_chat.digests(op8_chat.formatted(turns)).first()
    assert got.n_turns == 2 and got.loss_chars == sum(map(len, texts))
