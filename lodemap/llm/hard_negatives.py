"""Hard-negative mining by a vector-approximation file.

Vectors become integers and stand in blocks. A block quantises each dimension into cells of one width between its own
smallest and largest value, and keeps the cells of its rows beside the exact vectors. For an anchor, the least score that
a row can have is a sum of table entries, one for each pair of dimensions; as all cells of a dimension are equally
wide, the largest is that sum and a number of the anchor's. Only rows whose bounds let them into a window, and above
what the window holds already, are scored exactly. So the result is exact; the cells only decide what is looked at.

Anchors go to the rows, in blocks of bounded size: a block of anchors is broadcast, each task keeps the best of what it
reads for each anchor, and the best of all tasks are ranked. No vector meets another by a shuffle. The first pass finds
the positives, the second the negatives in their windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodemap.llm.common import Tables, python_batches, scratch, table

#: Components are whole numbers of this fraction.
SCALE = 256
#: dims times the square of a component: beyond it a score times a hundred would not fit a long.
MOST_SQUARES = 2.0**56
#: Rows of a block, anchors that are broadcast at once, and that a task compares with a block at once.
BLOCK_ROWS, ANCHORS, ANCHORS_AT_ONCE = 4_096, 8_192, 256
#: Rows whose bounds are looked at before the windows' thresholds rise again.
STEP = 512
#: Numbers that are multiplied at once.
NUMBERS = 1 << 21
#: So few rows are scored at once: tables would cost more than they save.
FEW = 64
LOWEST, LAST = np.iinfo(np.int64).min // 4, np.iinfo(np.int64).max

INDEX = "dims int, n int, bits int, ids binary, labels binary, asked binary, low binary, width binary, codes binary, exact binary"
OUT = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def packed(ids: np.ndarray, labels: np.ndarray, asked: np.ndarray, exact: np.ndarray) -> dict:
    """One block of the file. Rows are put in order of label; codes hold the cells of two dimensions each."""
    order = np.lexsort((ids, labels))
    ids, labels, asked, exact = ids[order], labels[order], asked[order], exact[order]
    n, dims = exact.shape
    bits = 5 if n >= 1024 else 4 if n >= 256 else 3
    low = exact.min(0).astype(np.int64) if n else np.zeros(dims, np.int64)
    width = (exact.max(0) - low) // (1 << bits) + 1
    cells = ((exact - low) // width).astype(np.uint16)
    if dims % 2:
        cells = np.concatenate([cells, np.zeros((n, 1), np.uint16)], 1)
    codes = np.ascontiguousarray(((cells[:, 0::2] << bits) | cells[:, 1::2]).T)
    return {"dims": dims, "n": n, "bits": bits, "ids": ids.tobytes(), "labels": labels.tobytes(), "asked": asked.tobytes(), "low": low.tobytes(), "width": width.astype(np.int64).tobytes(), "codes": codes.tobytes(), "exact": exact.astype(np.int32).tobytes()}


class Block:
    """A block of the file as arrays."""

    def __init__(self, row):
        of = lambda name, kind: np.frombuffer(getattr(row, name), kind)
        self.dims, self.bits, self.n = row.dims, row.bits, row.n
        self.ids, self.labels, self.low, self.width = of("ids", np.int64), of("labels", np.int64), of("low", np.int64), of("width", np.int64)
        self.codes, self.exact = of("codes", np.uint16).reshape(-1, row.n), of("exact", np.int32).reshape(row.n, row.dims)

    def sums(self, rows: slice, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sums, below, above): rows by anchors; a score is no less than sum + below and no more than sum + above, by anchor."""
        cells = 1 << self.bits
        spread = anchors * (self.width - 1)
        below, above = np.minimum(spread, 0).sum(1), np.maximum(spread, 0).sum(1)
        starts = self.low[:, None] + self.width[:, None] * np.arange(cells)
        largest = np.abs(starts).max(initial=0) * max(1, np.abs(anchors).max(initial=0)) * self.dims
        kind = np.int32 if largest < 1 << 30 else np.int64
        starts, by_dim = starts.astype(kind), np.ascontiguousarray(anchors.T.astype(kind))
        codes = self.codes[:, rows]
        found, part = np.zeros((codes.shape[1], len(anchors)), kind), np.empty((codes.shape[1], len(anchors)), kind)
        for j, code in enumerate(codes):
            places = starts[2 * j][:, None] * by_dim[2 * j]
            last = starts[2 * j + 1][:, None] * by_dim[2 * j + 1] if 2 * j + 1 < self.dims else np.zeros_like(places)
            np.take((places[:, None] + last).reshape(cells * cells, -1), code, axis=0, out=part)
            found += part
        return found, below, above

    def scores(self, rows: np.ndarray, anchors: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Exact scores of pairs of a row and an anchor (places in `anchors`)."""
        step = max(1, NUMBERS // max(1, self.dims))
        parts = [np.einsum("ij,ij->i", self.exact[rows[i : i + step]].astype(np.int64), anchors[of[i : i + step]]) for i in range(0, len(rows), step)]
        return np.concatenate(parts) if parts else np.empty(0, np.int64)


class Best:
    """The k best (score descending, id ascending) of each of some groups."""

    def __init__(self, groups: int, k: int):
        self.k, self.score, self.ident = k, np.full((groups, k), LOWEST), np.full((groups, k), LAST)

    def add(self, group: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        touched = np.unique(group)
        group = np.concatenate([group, np.repeat(touched, self.k)])
        score, ident = np.concatenate([score, self.score[touched].ravel()]), np.concatenate([ident, self.ident[touched].ravel()])
        order = np.lexsort((ident, -score, group))
        group, score, ident = group[order], score[order], ident[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        kept = place < self.k
        self.score[group[kept], place[kept]], self.ident[group[kept], place[kept]] = score[kept], ident[kept]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        group, place = np.nonzero(self.score > LOWEST)
        return group, self.score[group, place], self.ident[group, place]


def _clipped(bound: np.ndarray, kind) -> np.ndarray:
    return np.clip(bound, np.iinfo(kind).min, np.iinfo(kind).max).astype(kind)


def _candidates(block: Block, rows: slice, anchors: np.ndarray, least, most) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, anchors) of pairs whose score may lie between least() and most(), numbers for each anchor, a step of rows at a time.

    least is asked again for every step, so it may rise with what has been found.
    """
    count = rows.stop - rows.start
    if count < FEW:
        yield np.repeat(np.arange(rows.start, rows.stop), len(anchors)), np.tile(np.arange(len(anchors)), count)
        return
    sums, below, above = block.sums(rows, anchors)
    for i in range(0, count, STEP):
        some = sums[i : i + STEP]
        r, a = np.nonzero((some >= _clipped(least() - above, some.dtype)) & (some <= _clipped(most() - below, some.dtype)))
        yield r + rows.start + i, a


def _positives(shared, k: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, labels, points = shared.value
        best = Best(len(ids), k)
        for batch in batches:
            for row in batch.itertuples():
                block = Block(row)
                for label in np.unique(labels[np.isin(labels, block.labels)]):
                    rows = slice(np.searchsorted(block.labels, label, "left"), np.searchsorted(block.labels, label, "right"))
                    first, last = np.searchsorted(labels, label, "left"), np.searchsorted(labels, label, "right")
                    for at in range(first, last, ANCHORS_AT_ONCE):
                        own = slice(at, min(last, at + ANCHORS_AT_ONCE))
                        for r, a in _candidates(block, rows, points[own], lambda: best.score[own, -1], lambda: np.full(own.stop - own.start, LAST // 4)):  # noqa: B023
                            other = block.ids[r] != ids[own][a]
                            r, a = r[other], a[other]
                            score = block.scores(r, points[own], a)
                            good = score >= best.score[own, -1][a]
                            best.add(a[good] + own.start, score[good], block.ids[r[good]])
        group, score, ident = best.rows()
        yield pd.DataFrame({"anchor": group, "vec_id": ident, "score": score})

    return scan


def _negatives(shared, windows, k: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, labels, points = shared.value
        ids, positive, positive_score, low, high = windows.value
        wide = low.shape[1]
        best = Best(low.size, k)
        for batch in batches:
            for row in batch.itertuples():
                block = Block(row)
                for at in range(0, len(labels), ANCHORS_AT_ONCE):
                    own = slice(at, min(len(labels), at + ANCHORS_AT_ONCE))
                    floor = lambda: np.maximum(low[own], best.score[:, -1].reshape(low.shape)[own])  # noqa: B023, E731
                    for r, a in _candidates(block, slice(0, block.n), points[own], lambda: floor().min(1), lambda: high[own].max(1)):  # noqa: B023
                        other = block.labels[r] != labels[own][a]
                        r, a = r[other], a[other]
                        score = block.scores(r, points[own], a)
                        fits = (score[:, None] >= floor()[a]) & (score[:, None] <= high[own][a])
                        pair, window = np.nonzero(fits)
                        best.add((a[pair] + own.start) * wide + window, score[pair], block.ids[r[pair]])
        group, score, ident = best.rows()
        a, w = group // wide, group % wide
        yield pd.DataFrame({"anchor_id": ids[a], "positive_id": positive[a, w], "positive_score": positive_score[a, w], "negative_id": ident, "negative_score": score})

    return scan


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (vec_id, label, asked, q) to blocks of the file, each of one length of vectors."""
    held: dict[int, list] = {}

    def block(rows: list) -> pd.DataFrame:
        ids, labels, asked = (np.array([r[i] for r in rows], kind) for i, kind in ((0, np.int64), (1, np.int64), (2, bool)))
        return pd.DataFrame([packed(ids, labels, asked, np.stack([r[3] for r in rows]).astype(np.int64).reshape(len(rows), -1))])

    for batch in batches:
        for row in zip(batch["vec_id"], batch["label"], batch["asked"], batch["q"]):
            rows = held.setdefault(len(row[3]), [])
            rows.append(row)
            if len(rows) == BLOCK_ROWS:
                yield block(held.pop(len(row[3])))
    for rows in held.values():
        yield block(rows)


def _asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The anchors of blocks (dims, n, ids, labels, asked, exact)."""
    for batch in batches:
        for row in batch.itertuples():
            asked = np.frombuffer(row.asked, bool)
            exact = np.frombuffer(row.exact, np.int32).reshape(row.n, row.dims)[asked]
            yield pd.DataFrame({"dims": np.full(len(exact), row.dims, np.int32), "vec_id": np.frombuffer(row.ids, np.int64)[asked], "label": np.frombuffer(row.labels, np.int64)[asked], "exact": [x.tobytes() for x in exact]})


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor and each of its positives.

    vectors (vec_id, label, embedding); an anchor is a row for which `anchor` holds. A component x becomes floor(256 x), a
    score is the inner product of these numbers. The positives of an anchor are the `positives` best other rows of its
    label, the negatives of a positive the `negatives` best rows of other labels whose score is `low` to `high` percent of
    the positive's; better is the higher score, then the smaller vec_id. A positive of negative score has no negatives.
    Rows with a null vec_id, label or vector, null or non-finite components, or components whose square times the length
    is over 2^56, take no part. Vectors of other lengths are not compared. Of rows that share a vec_id the smallest by
    label and vector takes part. Empty vectors all score 0. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    large = F.aggregate("embedding", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double") * SCALE)))
    fits = F.size("embedding") * (large + 1) * (large + 1) <= MOST_SQUARES
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))).where(fits)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    x = F.struct(F.col("label").cast("long").alias("label"), whole.alias("q"), F.coalesce(anchor, F.lit(False)).alias("asked"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).groupBy("vec_id").agg(F.min("x").alias("x")).select("vec_id", "x.*")
    folder = scratch(spark, "negatives")
    with Tables(spark) as tables:
        index = tables.written(rows.mapInPandas(_blocks, INDEX), "index")
        asked = tables.written(index.select("dims", "n", "ids", "labels", "asked", "exact").mapInPandas(_asked, "dims int, vec_id long, label long, exact binary"), "anchors")
        for size in asked.groupBy("dims").agg(F.count("*").alias("n")).orderBy("dims").collect():
            blocks = -(-size["n"] // ANCHORS)
            file = index.where(F.col("dims") == size["dims"])
            for b in range(blocks):
                own = asked.where((F.col("dims") == size["dims"]) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)).orderBy("label", "vec_id").collect()
                if not own:
                    continue
                ids, labels = (np.array([r[c] for r in own], np.int64) for c in ("vec_id", "label"))
                points = np.stack([np.frombuffer(r["exact"], np.int32) for r in own]).astype(np.int64)
                shared = spark.sparkContext.broadcast((ids, labels, points))
                place = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
                found = file.mapInPandas(_positives(shared, positives), "anchor long, vec_id long, score long").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= positives).toPandas()
                at = (found["anchor"].to_numpy(np.int64), found["rank"].to_numpy(np.int64) - 1)
                ident, score = np.zeros((len(ids), positives), np.int64), np.zeros((len(ids), positives), np.int64)
                least, most = np.full((len(ids), positives), LAST // 4), np.full((len(ids), positives), LOWEST)  # no window without a positive
                ident[at], score[at] = found["vec_id"], found["score"]
                least[at], most[at] = -(-low * score[at] // 100), high * score[at] // 100
                windows = spark.sparkContext.broadcast((ids, ident, score, least, most))
                place = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
                best = file.mapInPandas(_negatives(shared, windows, negatives), OUT).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= negatives)
                best.write.mode("append").parquet(folder)
                shared.unpersist()
                windows.unpersist()
        schema = OUT + ", rank int"
        written = spark.createDataFrame([], schema) if not asked.head(1) else spark.read.schema(schema).parquet(folder)
    return written.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Every row whose vec_id is divisible by 100 as an anchor, among all rows; labels of vec_ids divisible by 7 are moved on by one first."""
    python_batches(spark)
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


ORACLE = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x : CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i : a.q[i] * b.q[i])) AS BIGINT) AS score
FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""
