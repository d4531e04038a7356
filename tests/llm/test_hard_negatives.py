import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodemap.llm import hard_negatives as hn
from lodemap.llm import queries
from oracle import connect, same


def whole(vector):
    return [math.floor(256 * float(np.float32(x))) for x in vector]


def brute(rows, every, positives=5, negatives=10, low=30, high=90):
    """rows {vec_id: (label, vector)}"""
    q = {i: whole(v) for i, (_, v) in rows.items()}
    out = []
    for a in rows:
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(q[a], q[i])) for i in rows if i != a and len(q[i]) == len(q[a])}
        ranked = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in ranked if rows[i][0] == rows[a][0]][:positives]:
            found = [i for i in ranked if rows[i][0] != rows[a][0] and low * score[p] <= 100 * score[i] <= high * score[p]][:negatives]
            out += [(a, p, n + 1, i, score[p], score[i]) for n, i in enumerate(found)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, label, [float(x) for x in v]) for i, (label, v) in rows.items()], "vec_id long, label int, embedding array<float>")


def mined(df, every, **how):
    return sorted(tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % every == 0, **how).collect())


def test_query_equals_sql(spark, data):
    assert same(queries.QUERIES["op13_hard_negatives"](spark, data), connect(data), queries.ORACLES["op13_hard_negatives"])


@pytest.mark.parametrize("kind", ["random", "clustered", "tied", "one label"])
def test_equals_brute_force(spark, monkeypatch, kind):
    rng = np.random.default_rng(3)
    n, dims = 900, 7
    v = rng.normal(size=(n, dims)) if kind != "clustered" else rng.normal(size=(9, dims))[rng.integers(0, 9, n)] + 0.1 * rng.normal(size=(n, dims))
    if kind == "tied":
        v = np.round(v)
    label = np.zeros(n, int) if kind == "one label" else np.minimum(rng.integers(0, 5, n), rng.integers(0, 5, n))
    rows = {int(i): (int(x), y) for i, x, y in zip(rng.permutation(3 * n)[:n], label, v / np.linalg.norm(v + 1e-9, axis=1, keepdims=True))}
    monkeypatch.setattr(hn, "ANCHORS", 20)  # several blocks of anchors
    got = mined(frame(spark, rows), 50)
    assert got == brute(rows, 50) and (got or kind == "one label")


def test_odd_rows(spark):
    good = {0: (1, [1.0, 0.5]), 1: (1, [0.9, 0.5]), 2: (2, [0.5, 0.5]), 3: (2, [0.5, 0.5]), 100: (1, [1.0, 0.5]), 4: (1, [-1.0, -1.0]), 5: (3, [0.0, 0.0]), 200: (7, [1.0, 1.0]), 300: (1, [1.0, 0.5, 0.25]), 6: (1, [1.0, 0.5, 0.25]), 7: (2, [0.5, 0.5, 0.25]), 400: (1, []), 8: (1, []), 9: (2, [])}
    bad = [(10, None, [1.0, 1.0]), (11, 2, None), (12, 2, [None, 1.0]), (13, 2, [float("nan"), 1.0]), (14, 2, [float("inf"), 1.0]), (15, 2, [1e30, 1.0]), (None, 2, [0.5, 0.5])]
    again = [(2, 9, [0.5, 0.5]), (0, 1, [1.0, 0.5])]
    df = spark.createDataFrame([(i, label, v) for i, (label, v) in good.items()] + bad + again, "vec_id long, label int, embedding array<float>").selectExpr("*", *[f"'x' AS {c}" for c in "q asked x rank anchor score ids exact dims n".split()])
    assert mined(df, 100) == brute(good, 100)
    assert mined(df, 100, positives=1, negatives=1, low=0, high=100) == brute(good, 100, 1, 1, 0, 100)
    assert mined(df.limit(0), 100) == [] and mined(df.where("vec_id = 5"), 100) == []


def test_very_large_and_wide_numbers(spark):
    rng = np.random.default_rng(5)
    rows = {i: (i % 3, np.float32(rng.normal(size=300) * 10.0 ** rng.integers(-3, 4))) for i in range(120)}
    assert mined(frame(spark, rows), 10) == brute(rows, 10)


@pytest.mark.parametrize("n", [1, 70, 400, 3000])
def test_bounds_hold_every_score_and_prune(n):
    rng = np.random.default_rng(n)
    q = np.floor(256 * (x := rng.normal(size=(n, 33))) / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    block = hn.Block(next(pd.DataFrame([hn.packed(np.arange(n), np.zeros(n, np.int64), np.zeros(n, bool), q)]).itertuples()))
    anchors = q[:5]
    sums, below, above = block.sums(slice(0, n), anchors)
    exact = block.exact.astype(np.int64) @ anchors.T
    assert (sums + below <= exact).all() and (exact <= sums + above).all()
    if n == 3000:
        tenth = np.sort(exact, 0)[-10]
        assert (sums + above >= tenth).mean() < 0.05
