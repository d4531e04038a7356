import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodemap.llm import simhash


def slow_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aA bB\n\x0b\x85éß ", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text, 3) == slow_fingerprint(text, 3)


def clustered(n, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n // 8)]
    out = set()
    while len(out) < n:
        x = rng.choice(base)
        for _ in range(rng.randrange(6)):
            x ^= 1 << rng.randrange(64)
        out.add(x - (1 << 64) if x >> 63 else x)
    return sorted(out)


@pytest.mark.parametrize("trie_rows", [4096, 8])
def test_links_have_the_components_of_all_pairs(spark, trie_rows):
    fps = clustered(400, 5)
    want = groups(fps, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    df = spark.createDataFrame([(x, 0, x) for x in fps], "id long, view int, fp long")
    stars = simhash.components(simhash.hamming_links(df, 3, trie_rows))
    got = {x: x for x in fps} | {r.node: r.component for r in stars.collect()}
    assert got == want


def test_rows_of_one_fingerprint_and_least_partners(spark):
    df = spark.createDataFrame([(i, 0, 7) for i in range(50)], "id long, view int, fp long")
    got = {(r.a, r.b) for r in simhash.hamming_links(df, 3, most=2).collect()}
    assert got == {(i, j) for i in range(50) for j in range(min(i, 2))}
    assert {(r.a, r.b) for r in simhash.hamming_links(df, 3, trie_rows=8, most=1 << 40).select("a", "b").distinct().collect()} == {(i, j) for i in range(50) for j in range(i)}


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    assert {r.component for r in simhash.components(edges).collect()} == {0}


def test_forest_keeps_components():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 60, 200), rng.integers(0, 60, 200)
    kept = simhash._forest(a, b)
    assert len(kept) < 60
    every = groups(list(range(60)), lambda x, y: ((a == x) & (b == y) | (a == y) & (b == x)).any())
    some = groups(list(range(60)), lambda x, y: ((a[kept] == x) & (b[kept] == y) | (a[kept] == y) & (b[kept] == x)).any())
    assert every == some


def test_odd_rows(odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    of = {r.doc_id: r for r in got}
    assert of[1].fp == of[2].fp == of[3].fp == 0 and {of[i].component_id for i in (1, 2, 3)} == {1}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_similar_groups_equal_brute_force(spark, documents):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for k in range(40):
        base = rng.sample(words, rng.randrange(20, 200))
        texts.append(base)
        for _ in range(rng.randrange(5)):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(copy)
    docs = [(10 + i, " ".join(t)) for i, t in enumerate(texts)] + [(1, None), (2, "  "), (3, "one"), (4, "ONE"), (None, "one")]
    sets = {i: set(zip(*(t.lower().split()[k:] for k in range(5)))) or {tuple(t.lower().split())} for i, t in ((i, t or "") for i, t in docs) if i is not None}
    want = groups(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    rows = simhash.similar_groups(documents(docs)).collect()
    # The row without an id is a copy of rows with one, so it is in their group and does not stay.
    assert {r.doc_id: r.kept for r in rows} == want | {None: 3}
    assert sorted(r.doc_id for r in rows if r.stays) == sorted(set(want.values()))


def test_dense_group_keeps_one_of_each_linked_pair(documents, monkeypatch):
    monkeypatch.setattr(simhash, "MOST", 2)
    base = [f"v{i}" for i in range(120)]
    docs = [(i, " ".join(base[:i] + [f"z{i}"] + base[i + 1 :])) for i in range(30)]
    got = {r.doc_id: r.kept for r in simhash.similar_groups(documents(docs)).collect()}
    assert set(got.values()) == {0}


def shingled(texts):
    return {i: set(zip(*(t.split()[k:] for k in range(5)))) for i, t in texts}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_cut_and_extended_copies_are_found(documents):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(5000)]
    docs = []
    for k in range(120):
        base = rng.choices(words, k=rng.randrange(60, 300))
        share = 0.80 + 0.17 * k / 120
        n = int(len(base) * share) + 1
        copy = [base[:n], base[len(base) - n :], base + rng.choices(words, k=int(len(base) / share) - len(base)), base[: n // 2] + base[n // 2 + len(base) - n :]][k % 4]
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    sets = shingled(docs)
    want = {i: i - i % 2 if jaccard(sets[i], sets[i - i % 2]) >= 0.8 else i for i in sets}
    assert sum(i != j for i, j in want.items()) > 80
    assert {r.doc_id: r.kept for r in simhash.similar_groups(documents(docs)).collect()} == want


def test_chain_beside_many_unlike_texts_of_the_same_words(documents):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]

    def moved(words, places):
        words = list(words)
        for p in places:
            words.insert((p + 100) % 190, words.pop(p))
        return words

    middle = moved(base, [10, 30])
    docs = [(0, base), (50, middle), (100, moved(middle, [50, 70]))] + [(i, rng.sample(base, 200)) for i in range(1, 40)]
    docs = [(i, " ".join(w)) for i, w in docs]
    sets = shingled(docs)
    assert jaccard(sets[0], sets[50]) >= 0.8 <= jaccard(sets[50], sets[100]) and jaccard(sets[0], sets[100]) < 0.8
    got = {r.doc_id: r.kept for r in simhash.similar_groups(documents(docs)).collect()}
    assert got == {i: 0 if i in (50, 100) else i for i, _ in docs}


def test_a_star_is_dealt_out_by_its_edges(spark, monkeypatch):
    """One node with 100,000 edges: the components are right where they are broadcast and where both sides are shuffled."""
    edges = spark.range(1, 100_001).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    rim = spark.range(1, 100_001).select(F.lit(200_000).cast("long").alias("a"), F.col("id").alias("b"))
    for most in (1 << 20, 0):
        monkeypatch.setattr(simhash, "BROADCAST_EDGES", most)
        got = simhash.components(edges.union(rim))
        assert got.count() == 100_002 and got.agg(F.max("component")).first()[0] == 0


def test_components_of_nothing_and_of_null_ends(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert simhash.components(none).count() == 0
    odd = spark.createDataFrame([(None, 1), (2, None), (3, 3), (5, 4), (4, 5)], "a long, b long")
    assert {tuple(r) for r in simhash.components(odd).collect()} == {(4, 4), (5, 4)}


def test_meetings_of_a_large_group_with_others(spark, monkeypatch):
    """Pieces of the largest group meet the others' pieces alone; no pair of two groups is lost."""
    from lodemap.llm.common import Tables

    monkeypatch.setattr(simhash, "BUCKET_ROWS", 8)
    shared = spark.createDataFrame([(7, i, 10, 0, 60) for i in range(60)], "h long, id long, n int, pos int, rows int")
    stars = spark.createDataFrame([(i, 0) for i in range(40)], "node long, component long")
    with Tables(spark) as tables:
        got = {(r.a, r.b) for r in simhash._meetings(shared, stars, 0.8, 1 << 40, tables).collect()}
    assert got == {(a, b) for a in range(40, 60) for b in range(a)}


@pytest.mark.parametrize(("piece", "wider"), [(256, 4), (40, 0)])
def test_a_dense_group_returns_links_and_no_pairs(documents, monkeypatch, piece, wider):
    """240 texts, each unlike most others, that share most of their shingles: their pairs are met in tasks and do not leave them."""
    for name, value in (("PIECE_ROWS", piece), ("PAIRED_ROWS", piece), ("WIDER", wider), ("SEEN_FIRST", 4)):
        monkeypatch.setattr(simhash, name, value, raising=False)
    rng, base = random.Random(11), [f"v{i}" for i in range(120)]
    docs = []
    for i in range(240):
        words = list(base)
        for k, at in enumerate(rng.sample(range(5, 115), 2)):
            words[at] = f"z{i}_{k}"
        docs.append((i, " ".join(words)))
    sets = shingled(docs)
    want = groups(sorted(sets), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    assert 5 < len(set(want.values())) < 235
    made, meet = [], simhash._meetings

    def counted(*args):
        made.append(meet(*args).count())
        return meet(*args)

    monkeypatch.setattr(simhash, "_meetings", counted)
    assert {r.doc_id: r.kept for r in simhash.similar_groups(documents(docs)).collect()} == want
    assert sum(made) <= 240


def test_links_of_a_task_are_spanning_edges_of_two_groups_each():
    grams = [np.arange(k, k + 100, dtype=np.uint64).tobytes() for k in (0, 1, 2, 3, 50, 51, 500)]
    rows = pd.DataFrame({"task": 1, "side": [0, 0, 1, 1, 0, 1, 0], "within": True, "id": range(7), "component": [0, 0, 2, 3, 4, 5, 6], "s": grams})
    got = pd.concat(simhash._linked(0.8)(iter([rows[:3], rows[3:]])))
    assert len(got) == 3 and {frozenset(x) & {4, 5} for x in zip(got.a, got.b)} == {frozenset(), frozenset({4, 5})}
    apart = rows.assign(within=False, side=[0, 0, 0, 1, 0, 0, 1], component=range(7))
    got = pd.concat(simhash._linked(0.8)(iter([apart])))
    assert {frozenset(x) for x in zip(got.a, got.b)} == {frozenset({i, 3}) for i in range(3)}
