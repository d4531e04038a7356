import numpy as np

import corpus_pipeline as cp
from lodemap.llm import language

EN = "the cat sat on the mat and the dog was in the house with the other cats "
DE = "der hund und die katze sind in dem haus und das ist nicht der einzige hund "
LEARNED = [(i, (EN if i % 2 else DE) * (1 + i % 3), "en" if i % 2 else "de") for i in range(20)]


def kept(spark, docs):
    return sorted(r.doc_id for r in cp.language_filter(spark, docs, "").collect())


def test_texts_without_a_letter_go_also_where_nothing_is_learned(spark, documents):
    rows = [(1, None), (2, ""), (3, "12 34 !"), (4, "the cat"), (5, "日本語")]
    assert kept(spark, documents([(*r, None) for r in rows])) == [4, 5]
    assert kept(spark, documents([(*r, "en" if r[0] < 4 else None) for r in rows])) == [4, 5]
    assert kept(spark, documents([(*r, None) for r in rows[:3]])) == []


def test_texts_in_a_language_that_cannot_be_told_go(spark, documents):
    strange = [(100, "日本語の文章はここにあります。" * 5, None), (101, "съешь же ещё этих мягких французских булок " * 4, None), (102, "xqzvk wprtk qjxzz vvkq zxqj kkwz pqzx", None)]
    short = [(103, "the house", None), (104, "das ist der hund", "en"), (105, "der hund", None)]
    docs = documents(LEARNED + strange + short)
    assert kept(spark, docs) == [*range(20), 103, 104, 105]


def test_a_language_with_one_text_among_many_is_told(spark, documents):
    docs = documents(LEARNED + [(200, "日本語の文章はここにあります。", "ja"), (201, "日本語の文章", None)])
    assert kept(spark, docs) == [*range(20), 200, 201]


def test_profiles_are_of_all_texts(spark, documents):
    docs = documents([(1, EN + str(i), "en") for i in range(5_000)] + [(2, DE, "de")])
    # The draw by id takes all rows of an id or none.
    drawn = {r["lang"]: r["vector"] for r in language.fit(docs, train_texts=None).collect()}
    one = language._units([EN])[0][0]
    assert set(drawn) == {"en", "de"} and np.allclose(np.array(drawn["en"]) / language.SCALE, 5_000 * one, atol=5_000 / language.SCALE)
    assert cp.language_filter(spark, docs, "").count() == 5_001


def test_strange_texts_exceed_chance_as_often_as_it_says():
    rng = np.random.default_rng(6)
    texts = ["".join(chr(c) for c in rng.integers(0x4E00, 0x9FA5, 60)) for _ in range(600)]
    profiles = language._units(["".join(chr(c) for c in rng.integers(0xAC00, 0xD7A3, 400)) for _ in range(4)])[0]
    over = ((language._units(texts)[0] @ profiles.T).max(axis=1) > language.chance(4)).mean()
    assert over < 0.03 and 0.08 < language.chance(4) < 0.1 < language.chance(1_000)
