"""Approximate nearest neighbours by cross-polytope hashing, with multiprobe tables and exact reranking.

A table's hash rotates a unit vector by three rounds of random signs and a fast Hadamard transform, and takes the
signed axis that lies nearest. A table puts several such hashes together, the more the more rows there are, so that
buckets stay small. A query probes in each table the buckets nearest to it. How many, is measured: for a bounded
sample of queries the true neighbours are found in all rows, and the number of probes is that which meets nearly all
of them. Every row is in the index, with its buckets. Where too many probes would be needed, a table puts fewer hashes
together, so its buckets are larger.

Equal vectors are one entry of the index, with as many of their smallest ids as any result can show, so a vector that
a third of all rows hold is compared once. Entries and probes meet by a join on table and bucket, in which only ids
move: an entry joins the lists of queries that probe its buckets. Then each entry fetches its vector once, the queries'
vectors come by broadcast, a bounded block of them at a time, and exact distances rank what has met. A task holds the
best of each query and a bounded number of others, however many rows it reads.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodemap.llm.common import Tables, collected, python_batches, table, written

TABLES = 16
SEED = 20
#: Queries whose true neighbours fix the number of probes, at most, and the share of these neighbours that is to be met.
SAMPLE_QUERIES = 64
RECALL = 0.97
#: Buckets that a query probes in a table at most. Where they would not do with one hash a table either, all rows are looked at.
MOST_PROBES = 2_048
#: Numbers of the queries' vectors that go to the tasks at once.
BLOCK_NUMBERS = 1 << 22
#: Ids of queries that move to the entries at once, in the mean of the sample; with more, the queries are cut into more blocks.
BLOCK_MET = 1 << 27
#: Numbers that a task computes with at once.
NUMBERS = 1 << 20
#: Distances that a task holds besides the best of each query.
HELD = 1 << 18
#: Rows of a task's result that are put together at once.
ROWS_OUT = 1 << 16
#: Queries in one list of a bucket, in the mean.
LIST = 4_096
#: A bucket with over this part of all entries of the tables is dealt out to SALTS tasks; there are no more such buckets than this.
HOT_PARTS = 10_000
SALTS = 32
OUT = "query long, ids array<long>, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x


def axes_of(dims: int) -> int:
    """Signed axes of a polytope for vectors of so many components."""
    return 2 << max(0, dims - 1).bit_length()


def polytopes(dims: int, rows: int) -> int:
    """Hashes that a table puts together: as many as leave some buckets' worth of rows to each."""
    return max(1, math.ceil(math.log(max(rows, 2)) / math.log(axes_of(dims)) - 0.5))


def rotated(vectors: np.ndarray, tables: int, count: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """For each table and hash in turn, every vector's nearness to all signed axes."""
    n, dims = vectors.shape
    size = axes_of(dims) // 2
    unit = np.zeros((n, size))
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # neither over- nor underflows
    unit[:, :dims] = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    draw = np.random.Generator(np.random.Philox(key=[seed, dims]))
    for _ in range(tables * count):
        y = unit
        for _ in range(3):
            y = hadamard(y * draw.choice([-1.0, 1.0], size))
        yield np.concatenate([y, -y], 1)


def codes(vectors: np.ndarray, tables: int, count: int) -> np.ndarray:
    """The bucket of each vector in each table."""
    out = np.zeros((len(vectors), tables), np.int64)
    for k, near in enumerate(rotated(vectors, tables, count)):
        out[:, k // count] = out[:, k // count] * near.shape[1] + near.argmax(axis=1)
    return out


def probes(vectors: np.ndarray, tables: int, count: int, most: int) -> np.ndarray:
    """For each vector and table the `most` nearest buckets, nearest first: those of the largest sums of nearness."""
    total = axes_of(vectors.shape[1])
    wide = total if count == 1 else min(total, 8 + int(3 * most ** (1 / count)))  # nearest axes of each hash
    out = np.empty((len(vectors), tables, min(most, wide**count)), np.int64)
    near = rotated(vectors, tables, count)
    for t in range(tables):
        found, worth = np.zeros((len(vectors), 1), np.int64), np.zeros((len(vectors), 1))
        for _ in range(count):
            y = next(near)
            best = np.argsort(-y, axis=1, kind="stable")[:, :wide]
            found = (found[:, :, None] * total + best[:, None]).reshape(len(y), -1)
            worth = (worth[:, :, None] + np.take_along_axis(y, best, 1)[:, None]).reshape(len(y), -1)
            if worth.shape[1] > 2 * most:
                keep = np.argpartition(-worth, 2 * most, axis=1)[:, : 2 * most]
                found, worth = np.take_along_axis(found, keep, 1), np.take_along_axis(worth, keep, 1)
        out[:, t] = np.take_along_axis(found, np.argsort(-worth, axis=1, kind="stable")[:, : out.shape[2]], 1)
    return out


def needed(queries: np.ndarray, of: np.ndarray, near: np.ndarray, tables: int, count: int, recall: float) -> int:
    """Probes with which the share `recall` of the pairs (query `of[i]`, vector `near[i]`) meet; more than MOST_PROBES if these do not do."""
    ranks = np.full(len(of), MOST_PROBES + 1)
    buckets = codes(near, tables, count) if len(near) else None
    for low in range(0, len(queries), 16):
        places = probes(queries[low : low + 16], tables, count, MOST_PROBES)
        for i in np.flatnonzero((of >= low) & (of < low + 16)).tolist():
            hit, at = np.nonzero(places[of[i] - low] == buckets[i][:, None])
            if len(hit):
                ranks[i] = at.min() + 1
    return int(np.sort(ranks)[max(0, math.ceil(recall * len(ranks)) - 1)]) if len(ranks) else 1


def _best(k: int, parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Of (query, first id, score, ids) the k best entries of each query."""
    query, first, score, ids = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((first, score, query))
    query = query[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query, "left") < k
    order = order[keep]
    return query[keep], first[order], score[order], ids[order]


class _Held:
    """The k best entries of each query so far, and up to HELD distances that may be among them."""

    def __init__(self, k: int, queries: int):
        self.k, self.parts, self.size = k, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object))], 0
        self.worst = np.full(queries, np.inf)  # no entry beyond this is among a query's best

    def add(self, query: np.ndarray, first: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        keep = score <= self.worst[query]
        self.parts.append((query[keep], first[keep], score[keep], ids[keep]))
        self.size += len(self.parts[-1][0])
        if self.size > HELD:
            self.best()

    def best(self) -> tuple[np.ndarray, ...]:
        query, first, score, ids = _best(self.k, self.parts)
        last = np.flatnonzero(np.arange(len(query)) - np.searchsorted(query, query, "left") == self.k - 1)
        self.worst[query[last]] = score[last]
        self.parts, self.size = [(query, first, score, ids)], 0
        return query, first, score, ids


def _met(lists: list, keys: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of the batch, place of the query) of rows whose lists hold keys of queries, each once, `most` at a time."""
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    pairs = np.unique(row * len(keys) + np.searchsorted(keys, np.concatenate(lists)))
    for at in range(0, len(pairs), most):
        yield np.divmod(pairs[at : at + most], len(keys))


def _all(rows: np.ndarray, vectors: np.ndarray, worst: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each row and each query, `most` at a time, without those that surely lie beyond the query's `worst` at that moment."""
    tall = max(1, min(len(vectors), 4_096))
    wide = max(1, NUMBERS // tall)
    for at in range(0, len(vectors), tall):
        queries = vectors[at : at + tall]
        of_query = (queries**2).sum(axis=1)
        for low in range(0, len(rows), wide):
            part = rows[low : low + wide]
            sizes = (part**2).sum(axis=1)[:, None] + of_query
            with np.errstate(invalid="ignore", over="ignore"):
                beyond = sizes - 2 * (part @ queries.T) > worst[at : at + tall] ** 2 + 1e-9 * sizes  # the product's error is far smaller
            r, q = np.nonzero(~beyond)
            for i in range(0, len(r), most):
                yield r[i : i + most] + low, q[i : i + most] + at


def _scan(shared, k: int, count):
    """mapInPandas function: entries (ids, embedding, and met, where not all queries meet them); the k best for each query of a task.

    `shared`: keys of the queries in ascending order, their vec_ids and vectors. `count`: an accumulator of comparisons, or None.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, own, vectors = shared.value
        held, most = _Held(k, len(keys)), max(1, NUMBERS // vectors.shape[1])
        for batch in batches:
            if not len(batch):
                continue
            rows = np.stack(batch["embedding"].tolist()).astype(np.float64)
            ids = np.empty(len(batch), object)
            ids[:] = batch["ids"].tolist()
            first, second = np.array([x[0] for x in ids]), np.array([x[1] if len(x) > 1 else -1 for x in ids])
            more = np.array([len(x) > 1 for x in ids])
            for r, q in _met(batch["met"].tolist(), keys, most) if "met" in batch else _all(rows, vectors, held.worst, most):
                mine = first[r] == own[q]
                r, q, mine = (x[~mine | more[r]] for x in (r, q, mine))
                if count is not None:
                    count.add(len(r))
                if len(r):
                    score = np.sqrt(((vectors[q] - rows[r]) ** 2).sum(axis=1))
                    held.add(q, np.where(mine, second[r], first[r]), score, ids[r])
        query, _, score, ids = held.best()
        for at in range(0, len(query), ROWS_OUT):
            part = slice(at, at + ROWS_OUT)
            yield pd.DataFrame({"query": keys[query[part]], "ids": ids[part], "score": score[part]})

    return run


def _ranked(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, query_id, rank, vec_id, score): the best of all tasks, without each query's own id."""
    order = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    rows = found.join(queries.select("query", F.col("vec_id").alias("query_id")), "query").select("query", "query_id", F.explode("ids").alias("vec_id"), "score")
    return rows.where("vec_id != query_id").withColumn("rank", order).where(F.col("rank") <= k).select("query", "query_id", "rank", "vec_id", "score")


def _coded(tables: int, count: int):
    @F.pandas_udf("array<long>")
    def coded(column: pd.Series) -> pd.Series:
        return pd.Series(list(codes(np.stack(column.tolist()).astype(np.float64), tables, count)))

    return coded


def _probing(tables: int, count: int, most: int):
    """mapInPandas function: queries (query, embedding) to the buckets that they probe."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 16):
                part = batch.iloc[at : at + 16]
                places = probes(np.stack(part["embedding"].tolist()).astype(np.float64), tables, count, most)
                n = places.shape[2]
                yield pd.DataFrame({"t": np.tile(np.repeat(np.arange(tables, dtype=np.int32), n), len(part)), "bucket": places.reshape(-1), "query": np.repeat(part["query"].to_numpy(), tables * n)})

    return run


def entries(rows: DataFrame, k: int) -> DataFrame:
    """(embedding, ids): every vector of rows (vec_id, embedding) once, with its k smallest ids in order."""
    order = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = rows.distinct().withColumn("place", order).where(F.col("place") <= k)  # cut in each task before the shuffle
    return few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def met(postings: DataFrame, hot: DataFrame, probed: DataFrame, lists: int) -> DataFrame:
    """(entry, met): the queries that probe any bucket of an entry, as often as they do; entries that none probes are left out.

    `postings`: (t, bucket, entry); `probed`: (t, bucket, query); `hot`: buckets (t, bucket) that are dealt out. The queries of
    a bucket are cut into `lists` lists by their hash.
    """
    hot = F.broadcast(hot.withColumn("hot", F.lit(True)))
    grouped = probed.groupBy("t", "bucket", F.pmod(F.xxhash64("query"), F.lit(lists)).alias("part")).agg(F.collect_list("query").alias("met"))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = postings.join(hot, ["t", "bucket"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod("entry", F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    right = grouped.join(hot, ["t", "bucket"], "left").withColumn("salt", F.explode(salts))
    return left.select("t", "bucket", "salt", "entry").join(right.select("t", "bucket", "salt", "met"), ["t", "bucket", "salt"]).groupBy("entry").agg(F.flatten(F.collect_list("met")).alias("met"))


def nearest(vectors: DataFrame, query: Column, k: int = 10, tables: int = TABLES, recall: float = RECALL, measured: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row of `vectors` (vec_id, embedding) for which `query` holds.

    Score: Euclidean distance in double precision; ties go to the smaller vec_id. A row of the query's own vec_id is no
    candidate. Rows with a null vec_id, or whose vector is null, empty, zero or holds null or non-finite components, take
    no part; vectors of other lengths are not compared. Rows equal in id and vector count once, equal queries as well. A
    query that finds fewer than k is searched in all rows, so it gets k wherever there are as many. An empty table gives
    no rows. Other columns are ignored. `measured` gets, for each length, rows, entries, hashes a table, probes (None: all
    rows), blocks of queries, and the comparisons of queries with entries that came from the tables.
    """
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.where(good).select("vec_id", "embedding", query.alias("asked"), F.size("embedding").alias("dims"))
    lengths = [r.asDict() for r in rows.groupBy("dims").agg(F.count("*").alias("n"), F.count_if("asked").alias("queries")).where("queries > 0").orderBy("dims").collect()]
    out = []
    with Tables(spark) as scratch:
        for x in lengths:
            dims = x["dims"]
            own = rows.where(F.col("dims") == dims).select("vec_id", "embedding")
            asked = scratch.written(rows.where((F.col("dims") == dims) & F.col("asked")).select("vec_id", "embedding").distinct().withColumn("query", F.monotonically_increasing_id()), "queries")
            plain = scratch.written(entries(own, k + 1).withColumn("entry", F.monotonically_increasing_id()), "entries")
            total = plain.count()
            compared = None if measured is None else spark.sparkContext.accumulator(0)

            def searched(queries: DataFrame, block: list, candidates: DataFrame | None, plain=plain, compared=compared) -> DataFrame:
                """Rows of `_ranked` for a block of queries, held as rows in order of `query`; without candidates (entry, met) by way of all entries."""
                shared = spark.sparkContext.broadcast((np.array([r["query"] for r in block], np.int64), np.array([r["vec_id"] for r in block], np.int64), np.array([r["embedding"] for r in block], np.float64)))
                these = plain.select("ids", "embedding") if candidates is None else plain.join(candidates, "entry").select("ids", "embedding", "met")
                found = scratch.written(these.mapInPandas(_scan(shared, k + 1, None if candidates is None else compared), OUT), "found")
                shared.unpersist()
                return _ranked(found, queries, k)

            # The number of probes, by the true neighbours of a sample.
            some = asked.orderBy(F.xxhash64("vec_id", "embedding")).limit(SAMPLE_QUERIES)
            sample = sorted(some.collect(), key=lambda r: r["query"])
            pairs = scratch.written(searched(spark.createDataFrame(sample, asked.schema), sample, None), "true")
            near = pairs.select("query", F.col("vec_id").alias("id")).join(plain.select("embedding", F.explode("ids").alias("id")), "id").select("query", "embedding").collect()
            place = {r["query"]: i for i, r in enumerate(sample)}
            pairs = (np.array([r["embedding"] for r in sample], np.float64), np.array([place[r["query"]] for r in near], np.int64), np.array([r["embedding"] for r in near], np.float64).reshape(len(near), dims))
            most = None
            for count in range(polytopes(dims, total), 0, -1):
                if (tried := needed(*pairs, tables, count, recall)) <= MOST_PROBES:
                    most = tried
                    break

            blocks = max(1, -(-x["queries"] * dims // BLOCK_NUMBERS))
            if most is not None:
                postings = scratch.written(plain.select("entry", F.posexplode(_coded(tables, count)("embedding")).alias("t", "bucket")), "postings")
                sizes = scratch.written(postings.groupBy("t", "bucket").count(), "sizes")
                hot = scratch.written(sizes.where(F.col("count") > max(1_000, total * tables // HOT_PARTS)).select("t", "bucket"), "hot")
                # Queries go in so many blocks that the ids which move at once stay few, by what the sample probes.
                places = spark.createDataFrame(sample, asked.schema).select("query", "embedding").mapInPandas(_probing(tables, count, most), "t int, bucket long, query long")
                moved = places.join(sizes, ["t", "bucket"]).agg(F.sum("count")).first()[0] or 0
                blocks = max(blocks, -(-moved * x["queries"] // (len(sample) * BLOCK_MET)))
            lists = max(1, x["queries"] // blocks // LIST)
            for b in range(blocks):
                queries = asked.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)) == b)
                block = sorted(queries.collect(), key=lambda r: r["query"])
                if not block:
                    continue
                if most is None:
                    found = searched(queries, block, None)
                else:
                    probed = scratch.written(queries.select("query", "embedding").repartition(spark.sparkContext.defaultParallelism).mapInPandas(_probing(tables, count, most), "t int, bucket long, query long"), "probes")
                    found = scratch.written(searched(queries, block, met(postings, hot, probed, lists)), "ranked")
                    full = found.where(F.col("rank") == k).select("query")
                    short = sorted(queries.join(full, "query", "left_anti").select(asked.columns).collect(), key=lambda r: r["query"])
                    if short:
                        rest = searched(spark.createDataFrame(short, asked.schema), short, None)
                        found = found.join(full, "query", "left_semi").select("query_id", "rank", "vec_id", "score").unionByName(rest.select("query_id", "rank", "vec_id", "score"))
                out.append(written(found.select("query_id", "rank", "vec_id", "score"), "nearest"))
                if blocks > 1:
                    collected(spark)
            if measured is not None:
                measured[dims] = {"rows": x["n"], "entries": total, "hashes": count, "probes": most, "blocks": blocks, "compared": compared.value}
    if not out:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, out)


def op1_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest rows found for every row whose vec_id is divisible by 100, among all rows."""
    python_batches(spark)
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)
