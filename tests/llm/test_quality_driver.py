from pyspark.sql.classic.dataframe import DataFrame

from lodemap.llm import quality


def test_the_features_of_a_sample_reach_the_driver_compressed(spark, monkeypatch):
    rows = [(i, f"Word {i} and (more) words, {'x' * (i % 7)}.\nA line of {i}!") for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    seen, given = [], DataFrame.toLocalIterator
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda self, *a: (seen.append(r) or r for r in given(self, *a)))
    fitted = []
    monkeypatch.setattr(quality, "_descend", lambda p, u, *a, f=quality._descend, **b: fitted.append((p, u)) or f(p, u, *a, **b))
    assert quality.fit(table.where("doc_id < 30"), table.where("doc_id >= 30")) is not None
    assert len(seen) == 60 and sum(len(r["x"]) for r in seen) < 60 * quality.WIDTH * 4 / 8
    p, u = fitted[1]
    assert sorted(x.tobytes() for x in p) == sorted(quality.features(t).tobytes() for _, t in rows[:30])
    assert [x.tobytes() for x in u] == [quality.features(t).tobytes() for _, t in rows[30:]]
