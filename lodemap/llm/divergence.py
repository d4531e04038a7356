"""Source divergence audit: how far the sources of a language lie from each other, and by which terms.

Tasks count the terms of their documents, for each source, before anything is shuffled. The counts of a term meet in
one place, where terms of too few documents go. What stays is cut into tiles: a block of some thousand terms by two
blocks of sources of a language. A tile is two dense int64 matrices, group by term; numpy compares all pairs of rows by
broadcasting and sums over the terms. Spark adds the partial pair matrices of all tiles. The tiles on the diagonal
also keep a heap of the best terms of each group, and the heaps are merged by rank.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodemap.llm.common import Tables, python_batches, table, written

#: Lower-case letters as they are, A-Z as these, all else of ASCII as a blank; bytes of other code points stay.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are split into terms at once, and counts that a task holds before it passes them on.
PIECE_BYTES = 1 << 20
HELD_COUNTS = 300_000
#: Terms of a tile, in the mean, sources of a side of it, and numbers that numpy compares at once.
TILE_TERMS = 8_192
TILE_SOURCES = 64
PAIR_NUMBERS = 1 << 20
#: Languages and sources that are broadcast at most; beyond it they meet the counts by a shuffle.
BROADCAST_GROUPS = 100_000
SCALE_DIGITS = 9

COUNTS = "lang string, source string, term string, n long, docs long"
TILE = "lang string, part string, source string, item string, value long"


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of bounded size."""
    text, at = text.translate(LETTERS), 0
    while at < len(text):
        end = at + PIECE_BYTES
        if end < len(text):
            # A term is never cut: the piece ends at its last blank, or at the next one.
            cut = text.rfind(b" ", at, end)
            cut = cut if cut > at else text.find(b" ", end)
            end = cut if cut > at else len(text)
        yield text[at:end].split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (lang, source, text) to partial counts: occurrences of a term and documents that have it."""
    occurrences: dict[tuple, Counter] = {}
    documents: dict[tuple, Counter] = {}

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in occurrences.items():
            terms, docs = list(counts), documents[lang, source]
            for i in range(0, len(terms), 1 << 16):
                some = terms[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()),
                     pa.array([counts[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        occurrences.clear()
        documents.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            counts, docs = occurrences.setdefault((lang, source), Counter()), documents.setdefault((lang, source), Counter())
            seen: set[bytes] = set()
            for terms in pieces(text):
                counts.update(terms)
                seen.update(terms)
            docs.update(list(seen))
        if sum(map(len, occurrences.values())) > HELD_COUNTS:
            yield from passed_on()
    yield from passed_on()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs, df, total) of docs (lang, source, text): n occurrences in docs documents of the group; df, total: those of the language.

    Nulls are ''. One shuffle: counts go to their term, whose groups then stand together.
    """
    python_batches(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    found = rows.mapInArrow(_counted, COUNTS).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    return found.select("lang", "source", "term", "n", "docs", F.sum("docs").over(term).alias("df"), F.sum("n").over(term).alias("total"))


def proportion(count: np.ndarray, total: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)) in int64: long division by thousands, so that no product is too large."""
    over, under = np.asarray(count, np.int64) + 2, np.asarray(total, np.int64) + 2 * np.asarray(terms, np.int64)
    found, rest = np.divmod(over, under)
    for _ in range(SCALE_DIGITS // 3):
        digit, rest = np.divmod(rest * 1000, under)
        found = found * 1000 + digit
    return found + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def pair_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum over terms of the divergence of each row of a (group by term) and each row of b."""
    found = np.zeros((len(a), len(b)), np.int64)
    step = max(1, PAIR_NUMBERS // max(1, len(a) * len(b)))
    for t in range(0, a.shape[1], step):
        found += divergence(a[:, None, t : t + step], b[None, :, t : t + step]).sum(2)
    return found


def _tile(most: int):
    def tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Partial sums of pairs of sources, both ways, and the best terms of each source of a diagonal tile.

        Rows without a term are the sources of the tile with the sizes of source, language and block of terms; the others are counts.
        """
        lang, first, second = key[0], key[2], key[3]
        groups = rows[rows["term"].isna()].drop_duplicates("source").sort_values("source", kind="stable")
        counts = rows[rows["term"].notna()]
        column, terms = pd.factorize(counts["term"].to_numpy(dtype=object))
        place = {s: i for i, s in enumerate(groups["source"])}
        dense = np.zeros((len(groups), len(terms)), np.int64)
        at = counts["source"].map(place).to_numpy(np.int64)
        dense[at, column] = counts["n"].to_numpy(np.int64)
        kept, size = groups["terms"].to_numpy(np.int64)[:, None], groups["size"].to_numpy(np.int64)[:, None]
        p = proportion(dense, size, kept)
        out = []
        names, block = groups["source"].to_numpy(dtype=object), groups["block"].to_numpy(np.int64)
        a, b = np.flatnonzero(block == first), np.flatnonzero(block == second)
        sums = pair_sums(p[a], p[b])
        # Kept terms that no source of the tile has are not in its rows; they are alike.
        if absent := int(groups["part_terms"].iloc[0]) - len(terms):
            none = proportion(np.zeros_like(size), size, kept)
            sums += absent * pair_sums(none[a], none[b])
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                if x != y:
                    out.append((lang, "pair", names[x], names[y], int(sums[i, j])))
                    if first != second:
                        out.append((lang, "pair", names[y], names[x], int(sums[i, j])))
        if first == second and len(terms):
            whole = np.zeros(len(terms), np.int64)
            whole[column] = counts["total"].to_numpy(np.int64)
            q = proportion(whole, groups["lang_size"].iloc[0], kept[0, 0])
            for i, name in enumerate(names):
                higher = np.flatnonzero((dense[i] > 0) & (p[i] > q))
                value = divergence(p[i][higher], q[higher])
                best = heapq.nsmallest(most, ((-int(v), terms[t].encode(), t) for v, t in zip(value, higher)))
                out += [(lang, "term", name, terms[t], -v) for v, _, t in best]
        return pd.DataFrame(out, columns=["lang", "part", "source", "item", "value"])

    return tile


def _joined(rows: DataFrame, small: DataFrame, count: int, on: list[str]) -> DataFrame:
    return rows.join(F.broadcast(small) if count <= BROADCAST_GROUPS else small, on)


def audit(docs: DataFrame, least: int = 10, most: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (lang, source, text), null values as ''.

    Terms are runs of letters A-Z, a-z and code points from U+0080 on, A-Z in lower case. A language keeps those in
    `least` of its documents (rows) or more. Part `pair`: the divergence of a source and each other source of its
    language over all kept terms, every pair both ways (0 where no term is kept). Part `term`: the `most` terms that a
    source has above the language. Ranks go by value descending, then item ascending in UTF-8. All numbers are exact as
    long as counts of a source stay under 9 * 10^15. A source without a text is there; a language of one source has no
    pairs. An empty table gives no rows. Other columns are ignored, and repeated rows are documents like others.
    """
    spark = docs.sparkSession
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    with Tables(spark) as scratch:
        counts = scratch.written(term_counts(docs).where(F.col("df") >= least).select("lang", "source", "term", "n", "total"), "counts")
        sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"))
        kept = scratch.written(counts.groupBy("lang", "term").agg(F.first("total").alias("total")), "terms")
        terms = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_size"))
        place = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")
        zero = F.lit(0).cast("long")
        groups = docs.select(named("lang"), named("source")).distinct().join(sizes, ["lang", "source"], "left").join(terms, "lang", "left")
        groups = scratch.written(groups.select("lang", "source", F.coalesce("size", zero).alias("size"), F.coalesce("terms", zero).alias("terms"), F.coalesce("lang_size", zero).alias("lang_size"), F.floor(place / TILE_SOURCES).cast("long").alias("block")), "groups")
        number = groups.count()
        side = groups.groupBy("lang").agg((F.max("block") + 1).alias("sides"), F.greatest(F.lit(1).cast("long"), F.ceil(F.max("terms") / TILE_TERMS)).alias("parts"))
        # A source's rows go to the tiles of its block with every block of its language.
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1))
        in_tiles = lambda df, *columns: df.withColumn("other", other).select("lang", "part", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), *columns)
        placed = _joined(_joined(counts, groups.select("lang", "source", "block"), number, ["lang", "source"]), side, number, ["lang"])
        none = lambda name, kind: F.lit(None).cast(kind).alias(name)
        part = F.pmod(F.xxhash64("term"), F.col("parts"))
        numbers = in_tiles(placed.withColumn("part", part), "source", "term", "n", "total", none("size", "long"), none("terms", "long"), none("lang_size", "long"), none("part_terms", "long"), "block")
        in_part = _joined(kept, side, number, ["lang"]).groupBy("lang", part.alias("part")).agg(F.count("*").alias("part_terms"))
        marks = groups.join(side, "lang").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).join(in_part, ["lang", "part"], "left").fillna(0, "part_terms")
        marks = in_tiles(marks, "source", none("term", "string"), none("n", "long"), none("total", "long"), "size", "terms", "lang_size", "part_terms", "block")
        found = scratch.written(numbers.unionByName(marks).groupBy("lang", "part", "first", "second").applyInPandas(_tile(most), TILE), "tiles")
        pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
        every = pairs.unionByName(found.where("part = 'term'").select("lang", "source", "part", "item", "value"))
        rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
        ranked = every.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= most))
        return written(ranked.select("lang", "source", "part", "item", "value", "rank"), "divergence")


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    """The audit of all documents: terms in 10 documents of a language or more, the 10 best terms of each source."""
    return audit(table(spark, sf_dir, "documents").select("lang", "source", "text"), least=10, most=10)


_P = lambda n, size: f"(1 + (1000000000 * ({n} + 2)) // ({size} + 2 * v))"
_F = lambda p, q: f"((({p}) - ({q})) * (({p}) - ({q})) // (({p}) + ({q})))"
ORACLE = rf"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM o GROUP BY 1, 2 HAVING count(DISTINCT id) >= 10),
s AS (SELECT lang, count(*) AS v, CAST(sum(total) AS BIGINT) AS lang_size FROM k GROUP BY 1),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN k ON o.lang = k.lang AND o.term = k.term GROUP BY 1, 2, 3),
z AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS size FROM c GROUP BY 1, 2),
t AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n, {_P("coalesce(c.n, 0)", "coalesce(z.size, 0)")} AS p, {_P("k.total", "s.lang_size")} AS q
FROM g JOIN k ON g.lang = k.lang JOIN s ON g.lang = s.lang LEFT JOIN z ON g.lang = z.lang AND g.source = z.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum({_F("a.p", "b.p")}) AS BIGINT) AS value FROM t a JOIN t b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
UNION ALL SELECT lang, source, 'term', term, CAST({_F("p", "q")} AS BIGINT) FROM t WHERE n > 0 AND p > q),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM n WHERE part = 'pair' OR rank <= 10"""
