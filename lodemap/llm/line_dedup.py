"""Line dedup: lines that stand in several documents stay in the first of them only.

Lines are exploded and normalised, their keys hashed to 128 bits, and the distinct documents of each hash counted; the
lines of hashes in too many documents go, but for those of the smallest doc_id. What goes is a list of places for each
text, and the text is put together again from the stretches between them, in order.

Documents are made distinct for each hash before they are counted, so a line that a third of all documents share is
counted in parts. Its lines do not meet its count in one task either: hashes that hold over a ten-thousandth of what is
repeated are few (10,000 at most) and broadcast, and their lines are dealt out by place. Only hashes, ids and places are
shuffled for the decision; each text is shuffled once, to meet its list of places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemap.llm.common import Tables, table, written

BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A hash is hot if it is in more than this share of the repeated (hash, document) pairs, so there are no more hot ones than its inverse.
HOT = 10_000
#: No hash in so few documents is hot, however small the table.
FEW = 100
TEXT = ["doc_id", "t1", "t2"]


def _hashed(value: Column) -> tuple[Column, Column]:
    """Two halves of a 128-bit hash."""
    return F.xxhash64(value), F.xxhash64(F.lit(11), value)


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_keys(docs: DataFrame, shortest: int) -> DataFrame:
    """(doc_id, t1, t2, pos, h1, h2): the lines of docs (doc_id, t1, t2, text) whose key has `shortest` code points or more."""
    lines = docs.select(*TEXT, F.posexplode(_split(F.col("text"))).alias("pos", "line"))
    keys = lines.select(*TEXT, "pos", F.translate(F.trim("line", F.lit(BLANKS)), UPPER, LOWER).alias("key"))
    h1, h2 = _hashed(F.col("key"))
    return keys.where(F.length("key") >= shortest).select(*TEXT, "pos", h1.alias("h1"), h2.alias("h2"))


def repeated_lines(docs: DataFrame, least: int = 2, shortest: int = 10) -> DataFrame:
    """(doc_id, t1, t2, places): for each text (doc_id, hash t1 t2) the places of the lines that go, in order, from 0.

    A written table; texts that lose nothing have no row.
    """
    spark = docs.sparkSession
    t1, t2 = _hashed(F.col("text"))
    lines = line_keys(docs.select("doc_id", t1.alias("t1"), t2.alias("t2"), "text"), shortest)
    with Tables(spark) as scratch:
        pairs = lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        counts = pairs.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
        counts = scratch.written(counts.where((F.col("n") >= max(2, least)) & F.col("first").isNotNull()), "lines")
        total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
        hot = F.col("n") > max(FEW, total // HOT)
        few = counts.where(hot).select("h1", "h2", F.col("first").alias("hot_first"))
        rest = counts.where(~hot).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "first")
        met = lines.join(F.broadcast(few), ["h1", "h2"], "left")
        # A hot line has its answer; its key is its place, so that no task gets all of them.
        met = met.withColumns({"k1": F.when(F.col("hot_first").isNull(), F.col("h1")).otherwise(F.xxhash64("t1", "pos")), "k2": F.col("h2")})
        met = met.join(rest, ["k1", "k2"], "left").withColumn("first", F.coalesce("hot_first", "first"))
        gone = met.where(F.col("first").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first")))
        return written(gone.groupBy(*TEXT).agg(F.array_sort(F.collect_set("pos")).alias("places")), "places")


def _between(lines: Column, places: Column) -> Column:
    """The lines but for those at `places` (ascending, from 0), as one text: stretches between places, each copied once."""
    ends = F.concat(F.array(F.lit(-1)), places, F.array(F.size(lines)))
    # The lambda's variable holds lines and ends once, so that no stretch splits the text again.
    held = F.array(F.struct(lines.alias("lines"), ends.alias("ends")))

    def joined(x: Column) -> Column:
        start = lambda k: F.get(x["ends"], k)
        stretches = F.transform(F.sequence(F.lit(0), F.size(x["ends"]) - 2), lambda k: F.slice(x["lines"], start(k) + 2, start(k + 1) - start(k) - 1))
        return F.array_join(F.flatten(stretches), "\n")

    return F.get(F.transform(held, joined), F.lit(0))


def drop_repeated_lines(docs: DataFrame, least: int = 2, shortest: int = 10) -> DataFrame:
    """`docs` (doc_id, text) with kept_text, n_lines and n_dropped; columns of these names are replaced, others kept.

    A line's key is the line without white space at both ends and with A-Z in lower case. Keys of `shortest` code points
    or more that are in `least` documents or more (2 at least) lose all their lines but those of the smallest doc_id that
    has them. A null text is an empty one; a text without a line end is one line, an empty one has one empty line. Rows
    that share a doc_id are one document; so are those without, which comes after all others. Repeated rows have the
    same result each. Texts of any length are split in whole. An empty table gives no rows.
    """
    t1, t2 = _hashed(F.col("text"))
    other = [c for c in docs.columns if c.lower() not in ("kept_text", "n_lines", "n_dropped")]
    held = docs.select(F.col("doc_id"), F.col("text"), F.struct(*[F.col(f"`{c}`") for c in other]).alias("row"), t1.alias("t1"), t2.alias("t2"))
    gone = repeated_lines(docs, least, shortest).select(F.col("doc_id").alias("g0"), F.col("t1").alias("g1"), F.col("t2").alias("g2"), "places")
    same = F.col("doc_id").eqNullSafe(F.col("g0")) & (F.col("t1") == F.col("g1")) & (F.col("t2") == F.col("g2"))
    met = held.join(gone, same, "left")
    text, lines = F.coalesce("text", F.lit("")), _split(F.col("text"))
    kept = F.when(F.col("places").isNull(), text).otherwise(_between(lines, F.col("places")))
    return met.select("row.*", kept.alias("kept_text"), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.array_size("places"), F.lit(0)).cast("long").alias("n_dropped"))


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents: lines before dropping, lines dropped, and the digest of what is kept."""
    found = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = rf"""WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS pos FROM split),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, first IS NOT NULL AND first < doc_id AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""
