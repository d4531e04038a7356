import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text) or (doc_id, text, lang) as a table of documents, with columns whose names operators use inside."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows], DOCS)
        clash = "fp id node component size shard slot bucket copy row key digest ids decoded kept a b n task".split()
        return df.selectExpr("*", *[f"'x' AS {c}" for c in clash]) if extra else df

    return make


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "a b"), (5, "a b"), (None, "no id"), (None, None), (6, "Copyright 2020 X\nReleased under the MIT licence."), (7, "wort " * 30_000), (8, "日本語 テキスト 😀 é ß"), (9, "x" * 50_000)]


@pytest.fixture(scope="session")
def odd(documents):
    return documents(ODD)
