"""Cache identities of texts on literal rows."""

from siltline.plans import mentions



def test_null_texts_fly_together(spark, tmp_path):
    spark.createDataFrame([(4, None), (3, None), (2, "A  b"), (1, "a b"), (5, "c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.caller for r in mentions.single_flight(spark, str(tmp_path)).collect()} == {3: 3, 4: 3, 1: 1, 2: 1, 5: 5}
