"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import (
    op1_hmm,
    op2_jpeg,
    op3_language,
    op4_warc,
    op5_simhash,
    op6_license,
    op7_winnow,
    op8_chat,
    op9_kdtree,
    op10_packing,
    op11_repair,
    op12_secrets,
    op13_align,
)

QUERIES = {
    "op1_hmm": op1_hmm.op1_hmm,
    "op2_jpeg": op2_jpeg.op2_jpeg,
    "op3_language": op3_language.op3_language,
    "op4_warc": op4_warc.op4_warc,
    "op5_simhash": op5_simhash.op5_simhash,
    "op6_license": op6_license.op6_license,
    "op7_winnowing": op7_winnow.op7_winnowing,
    "op8_chat": op8_chat.op8_chat,
    "op9_kdtree": op9_kdtree.op9_kdtree,
    "op10_packing": op10_packing.op10_packing,
    "op11_repair": op11_repair.op11_repair,
    "op12_secrets": op12_secrets.op12_secrets,
    "op13_align": op13_align.op13_align,
}
SQL = {"op4_warc": op4_warc.SQL, "op7_winnowing": op7_winnow.SQL, "op8_chat": op8_chat.SQL, "op11_repair": op11_repair.SQL}
