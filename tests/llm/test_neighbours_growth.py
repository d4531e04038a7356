import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lodemap.llm import neighbours


def test_a_task_holds_few_distances_and_loses_none():
    rng = np.random.default_rng(3)
    queries, rows = rng.normal(size=(4_000, 8)), np.round(rng.normal(size=(4_000, 8)), 1)
    rows[::7] = np.round(rows[::7])  # ties
    shared = SimpleNamespace(value=(np.arange(4_000), np.full(4_000, -5), queries))
    ids = [np.array([i]) for i in range(4_000)]
    batches = [pd.DataFrame({"ids": ids[at : at + 1_000], "embedding": list(rows[at : at + 1_000])}) for at in range(0, 4_000, 1_000)]
    every = [b.assign(met=[np.arange(4_000)] * len(b)) for b in batches]
    tracemalloc.start()
    got = pd.concat(neighbours._scan(shared, 11, None)(iter(batches)))
    assert tracemalloc.get_traced_memory()[1] < 80 << 20
    tracemalloc.stop()
    met = pd.concat(neighbours._scan(shared, 11, None)(iter(every)))
    for found in (got, met):
        found = found.assign(id=[x[0] for x in found["ids"]])
        assert (found.groupby("query").size() == 11).all()
        for q in range(0, 4_000, 97):
            d = np.sqrt(((queries[q] - rows) ** 2).sum(axis=1))
            mine = found[found["query"] == q].sort_values(["score", "id"])
            assert list(mine["id"]) == list(np.lexsort((np.arange(4_000), d))[:11]) and (mine["score"].to_numpy() == d[mine["id"]]).all()


def test_fewer_hashes_where_probes_do_not_do_and_blocks_by_what_moves(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(3_000, 64))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "MOST_PROBES", 100)
    results = []
    for most in (1 << 27, 20_000):
        monkeypatch.setattr(neighbours, "BLOCK_MET", most, raising=False)
        measured = {}
        results.append(neighbours.nearest(df, F.col("vec_id") % 50 == 0, measured=measured).orderBy("query_id", "rank").toPandas())
        assert neighbours.polytopes(64, 3_000) == 2 and measured[64]["hashes"] == 1 and measured[64]["probes"] <= 100
        assert (measured[64]["blocks"] > 1) == (most < 1 << 27)
    assert results[0].equals(results[1]) and len(results[0]) == 600
    best = {(q, i) for q in range(0, 3_000, 50) for i in [i for i in np.argsort(((v - v[q]) ** 2).sum(axis=1))[:11] if i != q][:10]}
    assert len(best & set(zip(results[0]["query_id"], results[0]["vec_id"]))) >= 0.9 * len(best)
