"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is its letters' vectors, rotated by place and multiplied
(bound); a text is the sum (bundle) of its trigrams; a language is the sum of its training texts, each scaled to
length one. A text's language is the one whose profile has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemap.llm.common import fold, python_batches, table, with_fields, written

DIMENSIONS = 1024
#: Training texts for a language, in the mean of the seeded draw; fewer where there are fewer.
TRAIN_TEXTS = 2_000
#: Profiles that go to every task at once, 4 kB each; of more languages, every text meets them in blocks of so many.
BLOCK_LANGUAGES = 2_000
#: Languages whose numbers of texts are broadcast; beyond, they are joined by a shuffle.
BROADCAST_LANGUAGES = 100_000
#: The share of texts strange to all profiles that one of them is like nevertheless, by chance.
CHANCE = 0.01
#: Unit vectors are summed as integers of this scale: the sums do not depend on the order of tasks.
SCALE = 1 << 20
SPACE, END = 32, 0


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=200_000 // 8)
def _vector(letter: int) -> np.ndarray:
    bits = np.random.Generator(np.random.Philox(key=letter)).integers(0, 2, DIMENSIONS, dtype=np.int8)
    return bits * 2 - 1


def bundles(texts: list[str | None]) -> np.ndarray:
    """The bundle of each text, one row each; zeros for null and for texts without a letter."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    start = 0
    while start < len(texts):  # a few hundred thousand letters at once
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop] or "") < 400_000):
            size += len(texts[stop] or "")
            stop += 1
        _bundle(texts[start:stop], out[start:stop])
        start = stop
    return out


def _bundle(texts: list[str | None], out: np.ndarray) -> None:
    joined = " " + " \0 ".join((t or "").lower().replace("\0", " ") for t in texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    signs = np.where(_letters()[points] | (points == END), points, SPACE)
    keep = np.ones(len(signs), bool)
    keep[1:] = (signs[1:] != SPACE) | (signs[:-1] != SPACE)
    signs = signs[keep]
    if len(signs) < 3:
        return
    present = np.zeros(int(signs.max()) + 1, bool)
    present[signs] = True
    alphabet = np.flatnonzero(present)
    at = (np.cumsum(present) - 1)[signs]
    n = len(alphabet)
    of = np.cumsum(signs == END)[1:-1]
    inside = (signs[:-2] != END) & (signs[1:-1] != END) & (signs[2:] != END)
    codes = ((at[:-2] * n + at[1:-1]) * n + at[2:])[inside]
    of = of[inside]
    if n**3 <= 1 << 22:
        seen = np.zeros(n**3, bool)
        seen[codes] = True
        grams = np.flatnonzero(seen)
        codes = (np.cumsum(seen) - 1)[codes]
    else:
        grams, codes = np.unique(codes, return_inverse=True)
    vectors = np.stack([_vector(int(c)) for c in alphabet])
    first, second = np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1)
    width = 8192
    for low in range(0, len(grams), width):
        g = grams[low : low + width]
        here = (codes >= low) & (codes < low + width) if len(grams) > width else slice(None)
        counts = np.bincount(of[here] * len(g) + codes[here] - low, minlength=len(texts) * len(g)).reshape(len(texts), len(g))
        bound = first[g // (n * n)] * second[g // n % n] * vectors[g % n]
        out += counts.astype(np.float32) @ bound.astype(np.float32)


def _units(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bundles of length one, and which texts have a letter."""
    vectors = bundles(texts)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.maximum(norms, 1e-9), _with_letter(texts)


def _with_letter(texts: list[str | None]) -> np.ndarray:
    return np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)


def lettered(text: str = "text") -> Column:
    """Whether a text has a letter; a null text has none."""

    @F.pandas_udf("boolean")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series(_with_letter(texts.tolist()))

    return found(F.col(text))


def chance(languages: int) -> float:
    """The cosine that a text of trigrams which no profile has exceeds with one of `languages` profiles in CHANCE of all cases.

    Vectors of unlike trigrams are independent signs, so such a cosine is normal with mean 0 and variance 1 / DIMENSIONS.
    """
    return -NormalDist().inv_cdf(CHANCE / languages) / DIMENSIONS**0.5


def fit(rows: DataFrame, train_texts: int | None = TRAIN_TEXTS, seed: int = 7) -> DataFrame:
    """(lang, vector): the profile of each language in `rows` (doc_id, text, lang), a written table.

    Rows without text or lang teach nothing; an empty table gives no profiles. About `train_texts` texts of each
    language, drawn by a seeded hash of their ids, are encoded; that bounds the work at any size of the table. With None all
    are. Texts are encoded whole. Repeated rows count as often as they are drawn. Any number of languages will do. Other columns are ignored.
    """
    rows = rows.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    drawn = rows
    if train_texts is not None:
        counts = written(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
        counts = F.broadcast(counts) if counts.count() <= BROADCAST_LANGUAGES else counts
        share = F.least(F.lit(1.0), train_texts / F.col("n"))
        drawn = rows.join(counts, "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < share * 1_000_000)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            units, _ = _units(b["text"].tolist())
            whole = np.rint(units * SCALE).astype(np.int64)
            for lang in b["lang"].unique():
                total[lang] = total.get(lang, 0) + whole[(b["lang"] == lang).to_numpy()].sum(axis=0)
            if len(total) > BLOCK_LANGUAGES:
                yield pd.DataFrame({"lang": list(total), "vector": [v.tolist() for v in total.values()]})
                total = {}
        if total:
            yield pd.DataFrame({"lang": list(total), "vector": [v.tolist() for v in total.values()]})

    parts = drawn.select("text", "lang").mapInPandas(summed, "lang string, vector array<long>")
    sums = parts.select("lang", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    vectors = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v"))
    return written(vectors.select("lang", F.col("v.x").alias("vector")), "profiles")


def _best(names: list[str], matrix: np.ndarray):
    @F.pandas_udf("lang_pred string, lang_score double")
    def best(texts: pd.Series) -> pd.DataFrame:
        units, lettered = _units(texts.tolist())
        cosines = units @ matrix.T
        at = cosines.argmax(axis=1)
        score = np.clip(cosines.max(axis=1).astype(np.float64), 0, 1)
        return pd.DataFrame({"lang_pred": [names[i] if k else "und" for i, k in zip(at, lettered)], "lang_score": np.where(lettered, score, 0.0)})

    return best


def predict(docs: DataFrame, profiles: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and lang_score: the language of the largest cosine (ties: the first name) and that cosine, from 0 to 1.

    `profiles` is of `fit`; it is read in blocks of names, so that none is left out, however many there are. A text that
    is null or has no letter, or any text where nothing was learned, is `und` with score 0. Texts are read whole. Rows
    stay as they are, repeated ones too; columns of `docs` of these two names are replaced.
    """
    blocks, found = max(1, -(-profiles.count() // BLOCK_LANGUAGES)), None
    for b in range(blocks):
        rows = profiles.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == b).orderBy("lang").collect()
        if not rows:
            continue
        vectors = np.array([r["vector"] for r in rows], np.float64)
        unit = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        one = _best([r["lang"] for r in rows], unit)(F.col(text))
        if found is None:
            found = one
        else:
            ahead = (one["lang_score"] > found["lang_score"]) | ((one["lang_score"] == found["lang_score"]) & (one["lang_pred"] < found["lang_pred"]))
            found = F.when(ahead, one).otherwise(found)
    if found is None:
        found = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("lang_score"))
    return with_fields(docs, found, ["lang_pred", "lang_score"])


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document; profiles are from documents outside fold 0 of 5."""
    python_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold(F.col("doc_id"), 5) == 0)
    found = predict(docs.select("doc_id", "held_out", "text"), fit(docs.where(~F.col("held_out"))))
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
