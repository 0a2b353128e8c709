"""The SQL of training-data queries on rows chosen to be hard."""

import duckdb
import pytest

from siltline.llm import queries

PAGES = [(3, "u", "é<b>"), (1, None, "é<b>"), (2, "u\n", None), (5, "w", ""), (4, "x", "only one"), (None, "n", "only one"), (None, "n", "of null ids")]
TURNS = [
    (1, 0, "system", "<<SYS>> a\\b </s"), (1, 1, "user", None), (1, 2, "assistant", "<s><s></s>[INST][/INST]<|end|>\\<s>"),
    (1, 2, "assistant", "<s><s></s>[INST][/INST]<|end|>\\<s>"), (1, None, "to<|role|>ol", "é 🎈\n"), (2, 0, None, ""), (2, 1, "user", "\\\\"),
]


@pytest.mark.parametrize("name", ["op4_warc", "op8_chat", "op11_repair"])
def test_query_equals_sql(spark, tmp_path, name):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, str(tmp_path))
    want = con.sql(queries.SQL[name])
    assert got.columns == want.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
