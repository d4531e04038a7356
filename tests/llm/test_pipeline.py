import corpus_pipeline as cp
from lodemap.llm.common import written


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        after = written(stage(spark, docs, data), name)
        assert after.columns == docs.columns and after.join(docs, docs.columns, "left_anti").isEmpty()
        docs = after
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[1] and sizes[2] > sizes[3] > sizes[4]
    assert cp.byte_bpe(spark, docs, data).count() == sizes[-1]


def test_odd_rows_and_empty_tables(spark, odd, tmp_path):
    odd.selectExpr("doc_id", "1 AS quality", "0 AS toxic").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    odd.selectExpr("doc_id AS item_id", "text").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd, odd.limit(0)):
        n = docs.count()
        for name, stage in cp.STAGES:
            docs = written(stage(spark, docs, str(tmp_path)), name)
        assert docs.count() <= n


def test_near_duplicates_keep_one_row_of_repeats(spark, documents):
    text = " ".join(f"w{i}" for i in range(60))
    docs = documents([(3, text), (3, text), (5, text + " end"), (9, "other text of its own"), (None, text), (None, "alone")])
    got = sorted((str(r.doc_id), r.text) for r in cp.near_duplicates(spark, docs, "").collect())
    assert got == [("3", text), ("9", "other text of its own"), ("None", "alone")]


def test_near_duplicates_lose_no_text_that_shares_an_id(spark, documents):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    docs = documents([(1, a), (1, b), (5, b), (9, c)])
    assert sorted((r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, "").collect()) == [(1, a), (1, b), (9, c)]
