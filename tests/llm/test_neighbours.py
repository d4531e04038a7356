import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodemap.llm import neighbours, queries


def test_recall_and_exact_scores(spark, data):
    got = queries.QUERIES["op1_nearest_neighbours"](spark, data).toPandas()
    rows = spark.read.parquet(f"{data}/embeddings.parquet").toPandas()
    ids, v = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float)
    hits = n = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(1))
        best = [ids[i] for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11)) and q not in set(mine["vec_id"])
        assert np.allclose(mine["score"], [d[ids == i][0] for i in mine["vec_id"]], rtol=0, atol=1e-15)
        hits, n = hits + len(set(best) & set(mine["vec_id"])), n + 10
    assert hits >= 0.9 * n


def test_ties_copies_and_rows_that_take_no_part(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = [[float(c) for c in rng.normal(size=5)] for _ in range(4)]
    rows = [(i * 50, x[i % 4]) for i in range(30)] + [(100, x[2]), (7, None), (8, [0.0] * 5), (9, [1.0, None, 1.0, 2.0, 3.0]), (10, [float("nan")] * 5), (None, x[0]), (11, []), (12, [float("inf")] + x[0][1:]), (13, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("code", F.lit("x"))
    for numbers in (1 << 22, 200):  # one block, and blocks of a few queries
        monkeypatch.setattr(neighbours, "BLOCK_NUMBERS", numbers)
        got = neighbours.nearest(df, F.col("vec_id") % 100 == 0, k=10).toPandas()
        zero = got[got["query_id"] == 0].sort_values("rank")
        assert list(zero["vec_id"])[:7] == [200, 400, 600, 800, 1000, 1200, 1400] and (zero["score"][:7] == 0).all()
        assert not set(got["vec_id"]) & {7, 8, 9, 10, 11, 12, 13} and set(got.groupby("query_id").size()) == {10}
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_fewer_rows_than_asked_for(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, -1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 2**0.5), (0, 2, 2, 2.0)]


def vectors_of(kind, n):
    rng = np.random.default_rng(n)
    if kind == "random":
        return rng.normal(size=(n, 64)).astype(np.float32)
    return (rng.normal(size=(20, 64))[rng.integers(0, 20, n)] + 0.3 * rng.normal(size=(n, 64))).astype(np.float32)


@pytest.mark.parametrize("kind", ["random", "clustered"])
def test_recall_on_tables_of_three_sizes(spark, kind, tmp_path):
    """Recall by brute force, and the probes that the sample asks for: a smaller share of all buckets on larger tables."""
    shares = []
    for n in (500, 2_000, 50_000):
        v, measured = vectors_of(kind, n), {}
        pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": list(v)}), tmp_path / f"{n}.parquet")
        df = spark.read.parquet(str(tmp_path / f"{n}.parquet"))
        every = max(50, n // 100)
        got = neighbours.nearest(df, F.col("vec_id") % every == 0, measured=measured).toPandas()
        v = v.astype(float)
        hits = total = 0
        for q in range(0, n, every):
            d = np.sqrt(((v - v[q]) ** 2).sum(1))
            d[q] = np.inf
            hits += len(set(np.argsort(d, kind="stable")[:10]) & set(got[got["query_id"] == q]["vec_id"]))
            total += 10
        assert hits >= 0.9 * total
        m = measured[64]
        shares.append(1.0 if m["probes"] is None else m["probes"] / 128 ** m["hashes"])
    assert shares[2] < shares[0]


def test_a_hot_bucket_and_equal_vectors(spark):
    """A third of all rows are one vector: the ten smallest other ids are nearest, and no task holds them all."""
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else rng.normal(size=4).tolist()) for i in range(3000)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 300)
    assert [(r.vec_id, r.score) for r in got.orderBy("rank").collect()] == [(3 * i, 0.0) for i in range(10)]


def test_comparisons_grow_slower_than_rows(spark):
    """Comparisons of a query from the tables, counted: a falling share of all entries on larger tables; the full search of short queries is not in it."""
    shares = []
    for n in (2_000, 20_000):
        measured = {}
        df = spark.createDataFrame(zip(range(n), vectors_of("random", n).tolist()), "vec_id long, embedding array<float>")
        assert neighbours.nearest(df, F.col("vec_id") % (n // 40) == 0, measured=measured).count() == 400
        assert measured[64]["entries"] == n and measured[64]["probes"] is not None
        shares.append(measured[64]["compared"] / (40 * n))
    assert 0 < shares[1] < shares[0] < 1


def test_lists_and_hot_buckets_meet_each_query_once(spark):
    """Buckets dealt out and lists cut: every entry meets the queries of its buckets, and no others."""
    postings = [(0, 1, e) for e in range(100)] + [(1, e % 7, e) for e in range(100)]
    probed = [(0, 1, q) for q in range(9)] + [(1, q % 7, q + 50) for q in range(20)]
    p, q = spark.createDataFrame(postings, "t int, bucket long, entry long"), spark.createDataFrame(probed, "t int, bucket long, query long")
    for hot in ([], [(0, 1)], [(0, 1), (1, 3), (1, 99)]):
        got = neighbours.met(p, spark.createDataFrame(hot, "t int, bucket long"), q, 3).collect()
        want = {e: sorted(x for t, b, y in postings if y == e for u, c, x in probed if (t, b) == (u, c)) for e in range(100)}
        assert {r.entry: sorted(r.met) for r in got} == want


def test_ids_with_several_vectors(spark):
    """Rows of the query's own id are no candidates, whatever vectors they have; each vector of a query's id is a query."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)] + [(100, rng.normal(size=6).tolist()) for _ in range(30)] + [(100, [1.0] * 6)] * 2
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 100).toPandas()
    assert 100 not in set(got["vec_id"]) and len(got) == 10 * 32
    v, ids = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    every = set()
    for q in {tuple(r[1]) for r in rows if r[0] == 100}:
        d = np.sqrt(((v - np.array(q)) ** 2).sum(1))
        every |= {(int(ids[i]), float(d[i])) for i in np.lexsort((ids, d)) if ids[i] != 100}
    assert {(r.vec_id, r.score) for r in got.itertuples()} <= every
