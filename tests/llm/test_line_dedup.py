import hashlib

import pytest

from conftest import ODD
from lodemap.llm import line_dedup, queries
from oracle import connect, same

BLANKS = " \t\n\x0b\f\r"
LOWER = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)


def brute(rows, least=2, shortest=10):
    """(doc_id, text) -> {(doc_id, text): (kept, lines, dropped)}"""
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    held = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            held.setdefault(key(line), set()).add(doc_id)
    first = {k: min(x for x in ids if x is not None) for k, ids in held.items() if len(k) >= shortest and len(ids) >= least}
    out = {}
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if first.get(key(x), doc_id) == doc_id]
        out[doc_id, text] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def got(df):
    return [(r.doc_id, r.text, (r.kept_text, r.n_lines, r.n_dropped)) for r in df.select("doc_id", "text", "kept_text", "n_lines", "n_dropped").collect()]


def compare(df, rows, **how):
    found, want = got(line_dedup.drop_repeated_lines(df, **how)), brute(rows, **how)
    assert len(found) == len(rows)
    for doc_id, text, result in found:
        assert result == want[doc_id, text]


def test_query_equals_sql(spark, data):
    assert same(queries.QUERIES["op11_line_dedup"](spark, data), connect(data), queries.ORACLES["op11_line_dedup"])


LINES = ["A line of ten and more", "  a LINE of ten and more\t", "short", "another line that is long", "É line with an accent", "é line with an accent", "", "x" * 9, "y" * 10, "日本語のテキストの行です", "last line of all\r"]


@pytest.mark.parametrize("few", [0, 100])
def test_odd_rows_ties_and_hot_lines(spark, documents, monkeypatch, few):
    monkeypatch.setattr(line_dedup, "FEW", few)
    monkeypatch.setattr(line_dedup, "HOT", 1_000_000 if few else 8)
    rows = [*ODD, *[(100 + i % 40, "\n".join([LINES[(i * j) % len(LINES)] for j in range(i % 7)] + [LINES[0]] * (i % 3))) for i in range(120)], (None, LINES[3]), (None, LINES[8]), (None, LINES[8] + "\n"), (7, LINES[3] + "\n" + LINES[3])]
    compare(documents(rows), rows)
    compare(documents(rows), rows, least=5, shortest=1)


def test_first_document_keeps_all_its_lines(spark, documents):
    rows = [(3, "the same long line\nthe same long line"), (5, "THE SAME LONG LINE \nown line of this one"), (9, "the same long line")]
    found = {d: r for d, _, r in got(line_dedup.drop_repeated_lines(documents(rows)))}
    assert found == {3: (rows[0][1], 2, 0), 5: ("own line of this one", 2, 1), 9: ("", 1, 1)}


def test_very_long_text(spark, documents):
    long = "\n".join(f"line number {i} of it" for i in range(200_000))
    rows = [(1, "\n".join(f"line number {i} of it" for i in range(0, 200_000, 2))), (2, long)]
    found = {d: r for d, _, r in got(line_dedup.drop_repeated_lines(documents(rows)))}
    assert found[1][2] == 0 and found[2][1:] == (200_000, 100_000)
    assert hashlib.sha256(found[2][0].encode()).digest() == hashlib.sha256("\n".join(long.split("\n")[1::2]).encode()).digest()


def test_columns_stay_and_an_empty_table(spark, documents):
    df = documents([(1, "a line that is repeated"), (2, "a line that is repeated")]).selectExpr("*", "'old' AS kept_text", "1 AS t1", "2 AS h1", "3 AS places", "4 AS pos", "5 AS g0", "6 AS first")
    out = line_dedup.drop_repeated_lines(df)
    assert set(out.columns) == set(df.columns) | {"n_lines", "n_dropped"} and {r.kept_text for r in out.collect()} == {"a line that is repeated", ""}
    assert line_dedup.drop_repeated_lines(df.limit(0)).count() == 0
