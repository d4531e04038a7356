"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

For trusted positives P and unlabelled texts U, turned into features, a linear model minimises
    prior * risk(P as 1) + max(0, risk(U as 0) - prior * risk(P as 0)),
the part in max() being the risk of the negatives, which no row marks. The class prior is estimated first: where
a probe of P against U scores at least t, U(t) >= prior * P(t), so the smallest ratio bounds the prior.

P is a bounded sample. Of U a sample gives the form of the risk, and all rows its value and slope: U(t) is counted in
all of U, and a model of the samples is fitted once more with the difference of both risks to first order.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemap.llm.common import collected, fold, python_batches, table, with_fields

#: Rows of each kind, P and U, whose features a fit holds at most, in the mean of the seeded draw.
TRAIN_ROWS = 4_000
#: Ids of labelled documents are broadcast up to so many; more meet the texts by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Sums over all rows are whole numbers of this part, so they do not depend on the order of tasks.
SCALE = 1 << 20
THRESHOLD = 0.7

# Kinds of bytes: small letters (and all of non-ASCII), capitals, digits, blanks, line ends, each mark on its own.
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
_KIND = np.zeros(256, np.uint8)
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[:33] = 3
_KIND[10] = 4
_KIND[_MARKS] = 5 + np.arange(len(_MARKS))
KINDS = 5 + len(_MARKS)
_TABLE = bytes(_KIND)
EDGES = np.linspace(0.05, 0.95, 19)
WIDTH = KINDS * KINDS + KINDS + 3 * (len(EDGES) + 1) + 4


def features(text: str | None) -> np.ndarray:
    """A text's shape: shares of kinds of bytes and of pairs of unlike neighbours, repetition, lengths. Zeros for no words."""
    out = np.zeros(WIDTH, np.float32)
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return out
    kinds = np.frombuffer(raw.translate(_TABLE), np.uint8)
    counts = np.bincount(kinds, minlength=KINDS)
    runs = kinds[np.concatenate([[True], kinds[1:] != kinds[:-1]])].astype(np.int64)
    pairs = np.bincount(runs[:-1] * KINDS + runs[1:], minlength=KINDS * KINDS)
    n = len(words)
    out[: KINDS * KINDS] = np.sqrt(pairs / max(1, pairs.sum()))
    at = KINDS * KINDS
    out[at : at + KINDS] = np.sqrt(counts / len(raw))
    at += KINDS
    fresh = len(set(words)) / n
    again = sum(map(bytes.__eq__, words, words[1:])) / max(1, n - 1)
    packed = min(1.0, len(zlib.compress(raw, 1)) / (len(raw) + 12))
    for x in (fresh, again, packed):
        out[at + int(np.searchsorted(EDGES, x))] = 1
        at += len(EDGES) + 1
    out[at:] = fresh, again, packed, min(1.0, np.log1p(n) / 12)
    return out


@dataclass
class Model:
    """A linear model: the probability of label 1 is sigmoid(weights . features + bias)."""

    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.stack([features(t) for t in texts]) if texts else np.zeros((0, WIDTH), np.float32)
        return _sigmoid(x.astype(np.float64) @ self.weights + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.log1p(np.exp(np.clip(z, -40, 40)))


@dataclass
class Shift:
    """By how much the mean risk as 0 of all unlabelled rows is over that of the sampled ones, to first order around a model."""

    at: np.ndarray
    loss: float
    slope: np.ndarray

    def near(self, w: np.ndarray, b: float) -> float:
        return self.loss + float(self.slope @ (np.append(w, b) - self.at))


def _risk_as_0(x: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    """Rows, the sum of their logistic loss as 0, and its slope by the weights and the bias."""
    total = np.zeros(x.shape[1] + 3)
    for at in range(0, len(x), 256):  # no copy of all rows in double precision
        part = x[at : at + 256].astype(np.float64)
        z = part @ w + b
        s = _sigmoid(z)
        total += np.concatenate([[len(part), _softplus(z).sum()], s @ part, [s.sum()]])
    return total


def _descend(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-3, shift: Shift | None = None) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk with the logistic loss. Where the negatives' risk is below 0, its gradient is reversed.

    shift is added to the risk of u.
    """
    w, b = np.zeros(p.shape[1], np.float32), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for k in range(1, steps + 1):
        sp, su = _sigmoid(p @ w + b), _sigmoid(u @ w + b)
        below = _softplus(u @ w + b).mean() - prior * _softplus(p @ w + b).mean()
        up, down = -prior * (1 - sp) / len(p), -prior * sp / len(p)
        gu, more = su / len(u), np.zeros(len(w) + 1)
        if shift is not None:
            below, more = below + shift.near(w, b), shift.slope
        if below < 0:
            up, down, gu, more = np.zeros_like(up), -down, -gu, -more
        gp = up + down
        g = np.append(p.T @ gp.astype(np.float32) + u.T @ gu.astype(np.float32) + decay * w, gp.sum() + gu.sum()) + more
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - step[-1]
    return w, b


@dataclass
class Probe:
    """A model of P against U, thresholds that keep a fifth of other rows of P at least, and what they keep of them."""

    weights: np.ndarray
    bias: float
    cuts: np.ndarray
    kept: np.ndarray

    @classmethod
    def fitted(cls, p: np.ndarray, u: np.ndarray) -> Probe:
        half = len(p) // 2
        w, b = _descend(p[:half], u, 0.5, steps=150)
        scores = np.concatenate([p[at : at + 256].astype(np.float64) @ w + b for at in range(half, len(p), 256)])
        cuts = np.quantile(scores, np.linspace(0.0, 0.8, 41))
        return cls(w, b, cuts, (scores[:, None] >= cuts).mean(0))

    def counts(self, x: np.ndarray) -> np.ndarray:
        """Rows, and how many of them each threshold keeps."""
        scores = x.astype(np.float64) @ self.weights + self.bias
        return np.append(len(x), (scores[:, None] >= self.cuts).sum(0)).astype(np.float64)

    def prior(self, counts: np.ndarray) -> float:
        ratios = counts[1:] / max(1.0, counts[0]) / np.maximum(self.kept, 1e-9)
        return float(np.clip(ratios.min(), 0.05, 0.98))


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives in U, from features of both: a probe learns one half of each and is read on the other."""
    probe = Probe.fitted(p, u[: len(u) // 2])
    return probe.prior(probe.counts(u[len(u) // 2 :]))


def totals(texts: DataFrame, add: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum over all rows of texts (text) of `add`, which gives `width` sums of a batch's features.

    A task sends one row for each of the sums; they are added by Spark.
    """

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            if len(batch):
                total += np.rint(add(np.stack([features(t) for t in batch["text"]])) * SCALE).astype(np.int64)
        yield pd.DataFrame({"k": np.arange(width), "v": total})

    found = texts.select("text").mapInPandas(part, "k int, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(width)
    for r in found:
        out[r["k"]] = r["v"] / SCALE
    return out


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows whose features, nearly all of them zero, are compressed, so that few bytes pass through the driver's JVM."""
    for b in batches:
        yield pd.DataFrame({"probe": b["probe"], "x": [zlib.compress(x, 1) for x in b["x"]]})


def fit(positives: DataFrame, unlabelled: DataFrame, train_rows: int = TRAIN_ROWS, seed: int = 11) -> Model | None:
    """A model from two tables (doc_id, text); None where one is empty. Null texts teach nothing.

    At most about `train_rows` rows of each, drawn by a seeded hash of id and text, come to the driver as features, rows
    equal in both once: neither one id nor one text, however often it stands there, makes the sample larger. All rows of
    `unlabelled` are read twice, repeated ones counting each time: for the prior, without those that the probe learned,
    and for their risk. Ids may be of any type.
    """

    def drawn(rows: DataFrame) -> Column:
        share = min(1.0, train_rows / max(1, rows.count()))
        return F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1_000_000)) < F.lit(share * 1_000_000)

    def sample(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"doc_id": b["doc_id"], "probe": b["probe"], "x": [features(t).tobytes() for t in b["text"]]})

        schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, probe boolean, x binary"
        ordered = rows.select("doc_id", "probe", "text").mapInPandas(shapes, schema).distinct().orderBy("doc_id", "x").select("probe", "x")
        flags, held = [], bytearray()  # one buffer: thousands of small ones would stay with the process
        for r in ordered.mapInPandas(_packed, "probe boolean, x binary").toLocalIterator():  # one partition after another, in order
            flags.append(r["probe"])
            held += zlib.decompress(r["x"])
        collected(rows.sparkSession)
        return np.frombuffer(held, np.float32).reshape(-1, WIDTH), np.array(flags, bool)

    half = F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(2)) == 0, F.lit(True)).alias("probe")
    positives, unlabelled = (rows.select("doc_id", "text", half).where("text is not null") for rows in (positives, unlabelled))
    some = drawn(unlabelled)
    (p, _), (u, learned) = sample(positives.where(drawn(positives))), sample(unlabelled.where(some))
    if len(p) < 2 or len(u) < 2:
        return None
    p = p[np.random.default_rng(seed).permutation(len(p))]
    learned = learned if 0 < learned.sum() < len(u) else np.arange(len(u)) % 2 == 0
    probe = Probe.fitted(p, u[learned])
    prior = probe.prior(totals(unlabelled.where(~(some & F.col("probe"))), probe.counts, len(probe.cuts) + 1))
    w, b = _descend(p, u, prior)
    of_all, of_some = (sums[1:] / max(1.0, sums[0]) for sums in (totals(unlabelled, partial(_risk_as_0, w=w, b=b), WIDTH + 3), _risk_as_0(u, w, b)))
    more = of_all - of_some
    w, b = _descend(p, u, prior, shift=Shift(np.append(w, b), float(more[0]), more[1:]))
    return Model(w.astype(np.float64), float(b), prior)


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """`docs` with quality_score, the probability of label 1 by the whole text; 0 where no model could be learned.

    Null and empty texts have the features of no words, and a score like any other. Rows stay as they are, repeated ones
    too; a column of `docs` of this name is replaced.
    """

    @F.pandas_udf("quality_score double")
    def scored(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"quality_score": model.scores(texts.tolist()).astype("float64")})

    found = F.struct(F.lit(0.0).alias("quality_score")) if model is None else scored(F.col(text))
    return with_fields(docs, found, ["quality_score"])


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from `documents` and `labels`, without rows of fold 2 of 4.

    Trusted positives have no label but 1: of labels that contradict each other the smallest holds. The unlabelled are the
    documents without a row of `labels`; a document whose labels are all null is neither. Repeated rows of `labels` change
    nothing, and a null doc_id marks no document.
    """
    known = docs.where(fold(F.col("doc_id"), 4) != 2).select("doc_id", "text")
    marks = labels.where(fold(F.col("doc_id"), 4) != 2).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    seen = marks.select("doc_id")
    if labels.count() <= BROADCAST_ROWS:  # else all texts that a pass reads are shuffled
        seen = F.broadcast(seen)
    return fit(known.join(marks.where("quality = 1").select("doc_id"), "doc_id", "left_semi"), known.join(seen, "doc_id", "left_anti"))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """The quality of every document, by a model of the rows outside fold 2 of 4."""
    python_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    found = score(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
