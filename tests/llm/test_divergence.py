import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import ODD

from lodemap.llm import divergence, queries
from oracle import connect, same

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, most):
    """(lang, source, text) rows -> the audit, by whole numbers of Python."""
    langs = defaultdict(lambda: defaultdict(Counter))
    df = defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = [x.translate(LOWER) for x in TERM.findall(text or "")]
        langs[lang][source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        size = {s: sum(c[t] for t in kept) for s, c in sources.items()}
        share = lambda n, total: 1 + 10**9 * (n + 2) // (total + 2 * len(kept))  # noqa: B023, E731
        f = lambda p, q: (p - q) * (p - q) // (p + q)
        whole = {t: share(sum(c[t] for c in sources.values()), sum(size.values())) for t in kept}
        p = {s: {t: share(c[t], size[s]) for t in kept} for s, c in sources.items()}
        for s, c in sources.items():
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], whole[t])) for t in kept if c[t] and p[s][t] > whole[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, most)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found)]
    return sorted(out)


def compare(spark, rows, least=10, most=10, extra=True):
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    if extra:
        df = df.selectExpr("*", *[f"'x' AS {c}" for c in "term n docs df total size terms block part first second item value rank".split()])
    got = sorted(tuple(r) for r in divergence.audit(df, least, most).collect())
    assert got == brute(rows, least, most)
    return got


def made(count, sources, seed):
    rng, words = random.Random(seed), [f"{a}{b}" for a in "abcdeéfgß日" for b in "qrstuvwxyz"]
    return [(rng.choice("xyz"), f"s{min(rng.randrange(sources), rng.randrange(sources))}", rng.choice([" ", "-", ", ", "1"]).join(rng.choices(words, k=rng.randrange(30))).title()) for _ in range(count)]


def test_query_equals_sql(spark, data):
    assert same(queries.QUERIES["op12_source_divergence"](spark, data), connect(data), queries.ORACLES["op12_source_divergence"])


def test_many_tiles_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TILE_SOURCES", 2)
    monkeypatch.setattr(divergence, "TILE_TERMS", 7)
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    assert compare(spark, made(300, 7, 1), least=4, most=3)


def test_odd_rows(spark):
    rows = [(lang, source, text) for _, text in ODD for lang, source in (("en", "a"), (None, "a"), ("en", None), ("", "b"))]
    rows += [("one", "only", "word word"), ("none", "a", "x"), ("none", "b", None), ("tie", "a", "p q"), ("tie", "b", "r s"), ("tie", "c", "p q")] * 2
    got = compare(spark, rows, least=2)
    assert ("none", "b", "pair", "a", [r[4] for r in got if r[:4] == ("none", "b", "pair", "a")][0], 1) in got
    assert not [r for r in got if r[0] == "one" and r[2] == "pair"]


def test_no_kept_terms_and_an_empty_table(spark):
    assert compare(spark, [("en", "a", "x y"), ("en", "b", "z"), ("en", "c", None)]) == [("en", s, "pair", o, 0, i + 1) for s, others in (("a", "bc"), ("b", "ac"), ("c", "ab")) for i, o in enumerate(others)]
    df = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(df).count() == 0


def test_a_term_is_never_cut(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE_BYTES", 8)
    for text in ("", " ", "a" * 50, "a b" * 9, " Übermäßig LANGE wörter, 1 2 3 und kurze " * 3, "x" * 20 + " " + "y" * 20 + " "):
        assert [t.decode() for p in divergence.pieces(text.encode()) for t in p] == [x.translate(LOWER) for x in TERM.findall(text)]


@pytest.mark.parametrize("seed", range(3))
def test_large_counts_are_exact(seed):
    rng = random.Random(seed)
    total = [rng.randrange(1, 9 * 10**15) for _ in range(200)] + [0, 1]
    count = [rng.randrange(0, t + 1) for t in total]
    got = divergence.proportion(np.array(count), np.array(total), np.array([7] * len(total)))
    assert got.tolist() == [1 + 10**9 * (n + 2) // (t + 14) for n, t in zip(count, total)]
