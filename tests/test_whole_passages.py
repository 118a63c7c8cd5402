"""Requests are whole passages."""

from marlstone.plans import retrieval


def test_later_sentences_score(spark, tmp_path):
    spark.createDataFrame([("q", "Alpha beta. Gamma delta")], "case_id string, passage string").write.parquet(f"{tmp_path}/eval_cases.parquet")
    spark.createDataFrame([(1, "nothing here"), (2, "gamma delta"), (3, "alpha")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc: r.score for r in retrieval.bm25_topk(spark, str(tmp_path)).collect()}
    assert got[2] > got[3] > 0 == got[1]
