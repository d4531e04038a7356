"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over a window of tokens; it hashes the tokens that the mask keeps and ignores the others, so
a hit survives substitutions at ignored places. Hashes of all benchmark windows are joined with those of all
windows of a text. Each hit fixes a diagonal, along which text and item are then compared token by token: the
stretch with the best balance of matches and substitutions is the overlap, and it counts when it is long and
similar enough.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemap.llm.common import python_batches, table, written

# Masks of weight 6 over 8 to 11 tokens (1 keeps a token). Any stretch of 13 tokens with one
# substitution anywhere, and most with two, keeps a window of one of them whole.
MASKS = ["11111100", "1101100101", "11001011001", "1011010011"]
TOKEN = re.compile(r"\w+")
#: An overlap has so many matching tokens at least, or four fifths of a short item, ...
LEAST_MATCHES = 13
#: ... and such a share of its tokens match.
SIMILARITY = 0.8
#: Letters of benchmark text whose hashes go to the tasks at once. A larger benchmark is met in blocks of items.
BLOCK_CHARS = 8 << 20
#: Pairs of a text's and the benchmark's windows with one hash that are made one by one; of more, only the diagonals.
PAIRS = 1 << 12
OUT = "item_id long, doc_start long, item_start long, n_tokens long, n_matches long, item_tokens long"


def tokens(text: str | None) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return TOKEN.findall((text or "").lower())


def _correlated(p: np.ndarray, q: np.ndarray, n: int, m: int) -> np.ndarray:
    """How many pairs of places p (below n) and q (below m) have each difference p - q, from -(m - 1) on."""
    if len(p) * len(q) <= 4 * (n + m):
        return np.bincount((p[:, None] - q[None] + m - 1).ravel(), minlength=n + m - 1)
    size = 1 << (n + m).bit_length()
    x, y = np.zeros(size), np.zeros(size)
    x[p], y[m - 1 - q] = 1, 1
    return np.rint(np.fft.irfft(np.fft.rfft(x) * np.fft.rfft(y), size)[: n + m - 1]).astype(np.int64)


def _differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The distinct differences p - q."""
    m = int(q.max()) + 1
    return np.flatnonzero(_correlated(p, q, int(p.max()) + 1, m)) - (m - 1)


def _matches(words: np.ndarray, item: np.ndarray) -> np.ndarray:
    """How many tokens match on each diagonal, from -(len(item) - 1) on. Tokens that both have often are counted by a convolution."""
    n, m = len(words), len(item)
    total = np.zeros(n + m - 1, np.int64)
    for w in np.intersect1d(words, item).tolist():
        total += _correlated(np.flatnonzero(words == w), np.flatnonzero(item == w), n, m)
    return total


class Index:
    """Spaced-seed hashes of benchmark items (item_id, text). Items without tokens match nothing."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        found = [(i, w) for i, w in ((i, tokens(t)) for i, t in items) if w]
        self.ids = [i for i, _ in found]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for _, ws in found for w in ws))}
        self.items = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws in found]
        # Items shorter than a mask are met by a mask of their own length without gaps.
        lengths = sorted({len(w) for w in self.items if len(w) < max(map(len, MASKS))})
        self.masks = [np.flatnonzero([c == "1" for c in m]) for m in MASKS] + [np.arange(n) for n in lengths]
        self.spans = [len(m) for m in MASKS] + lengths
        self.tables = []
        for k, (mask, span) in enumerate(zip(self.masks, self.spans)):
            hashes, item, at = [], [], []
            for i, w in enumerate(self.items):
                if len(w) < span or k >= len(MASKS) and len(w) != span:
                    continue
                h = self.hashes(w, mask, span)
                hashes.append(h)
                item += [i] * len(h)
                at.append(np.arange(len(h)))
            if hashes:
                h, item, at = np.concatenate(hashes), np.array(item, np.int64), np.concatenate(at)
                order = np.argsort(h, kind="stable")
                self.tables.append((mask, span, h[order], item[order], at[order]))

    @staticmethod
    def hashes(words: np.ndarray, mask: np.ndarray, span: int, where: np.ndarray | None = None) -> np.ndarray:
        """Hash of the kept tokens of the windows that begin at `where` (all, if None)."""
        where = np.arange(len(words) - span + 1) if where is None else where
        out = np.full(len(where), 0x9E3779B97F4A7C15, np.uint64)
        for offset in mask:
            out = (out ^ words[where + offset].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
        return out

    def overlaps(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text its overlaps, the best of each item: tuples of OUT, by item."""
        lists = [tokens(t) for t in texts]
        gap = max(self.spans, default=1)
        starts = np.cumsum([0] + [len(w) + gap for w in lists])
        words = np.full(int(starts[-1]), -1, np.int64)
        for a, w in zip(starts, lists):
            words[a : a + len(w)] = np.fromiter(map(self.vocabulary.get, w, repeat(-1)), np.int64, len(w))
        known = words >= 0
        diagonals = []
        for mask, span, table_hashes, item, at in self.tables:
            n = len(words) - span + 1
            if n <= 0:
                continue
            whole = known[mask[0] : mask[0] + n].copy()
            for offset in mask[1:]:
                whole &= known[offset : offset + n]
            where = np.flatnonzero(whole)
            h = self.hashes(words, mask, span, where)
            low, high = np.searchsorted(table_hashes, h, "left"), np.searchsorted(table_hashes, h, "right")
            text = np.searchsorted(starts, where, "right") - 1
            some = high > low
            where, low, high, text, h = where[some], low[some], high[some], text[some], h[some]
            # How often each text has each hash; a hash that both have often gives as many diagonals as places, not as pairs of places.
            order = np.lexsort((h, text))
            where, low, high, text, h = where[order], low[order], high[order], text[order], h[order]
            first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
            many = np.diff(np.append(first, len(h)))
            often = many * (high - low)[first] > PAIRS
            for a, n in zip(first[often].tolist(), many[often].tolist()):
                k, rows = int(text[a]), slice(int(low[a]), int(high[a]))
                for i in np.unique(item[rows]).tolist():
                    shifts = _differences(where[a : a + n] - starts[k], at[rows][item[rows] == i])
                    diagonals.append(np.stack([np.full(len(shifts), k), np.full(len(shifts), i), shifts], 1))
            rare = np.repeat(~often, many)
            where, low, high, text = where[rare], low[rare], high[rare], text[rare]
            count = high - low
            hit = np.repeat(np.arange(len(where)), count)
            rows = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            diagonals.append(np.stack([text[hit], item[rows], where[hit] - starts[text[hit]] - at[rows]], 1))
        out: list[list[tuple]] = [[] for _ in texts]
        if not diagonals:
            return out
        found = np.concatenate(diagonals)
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        found = found[np.concatenate([[True], (found[1:] != found[:-1]).any(axis=1)])] if len(found) else found
        if not len(found):
            return out
        new = np.flatnonzero((found[1:, :2] != found[:-1, :2]).any(axis=1)) + 1
        for group in np.split(found, new):
            text, i = group[0, :2].tolist()
            if best := self._best(words[starts[text] : starts[text] + len(lists[text])], self.items[i], group[:, 2]):
                out[text].append((self.ids[i], *best, len(self.items[i])))
        return out

    def _best(self, words: np.ndarray, item: np.ndarray, shifts: np.ndarray) -> tuple[int, int, int, int] | None:
        """The best overlap on any of the diagonals `shifts`: the most matches, at the first place of equal ones.

        Diagonals that hold fewer matching tokens in all than the best overlap so far are not looked at.
        """
        if len(shifts) > 4:
            total = _matches(words, item)[shifts + len(item) - 1]
            least = min(LEAST_MATCHES, -(-8 * len(item) // 10))
            order = np.lexsort((shifts, -total))
            order = order[total[order] >= least]
            shifts, total = shifts[order], total[order]
        else:
            total = np.full(len(shifts), len(item))
        best = None
        for shift, most in zip(shifts.tolist(), total.tolist()):
            if best and (most < best[3] or most == best[3] and max(0, shift) >= best[0]):
                if len(shifts) > 4 and most < best[3]:
                    break
                continue
            found = self._verified(words, item, shift)
            if found and (best is None or (found[3], -found[0]) > (best[3], -best[0])):
                best = found
        return best

    @staticmethod
    def _verified(words: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int, int] | None:
        """(doc_start, item_start, n_tokens, n_matches) of the best stretch on a diagonal that is long and similar enough, or None.

        Matches earn 1 and substitutions cost 3; the best stretch has the largest sum, and begins and ends in a match.
        """
        low, high = max(0, -shift), min(len(item), len(words) - shift)
        same = words[low + shift : high + shift] == item[low:high]
        least = min(LEAST_MATCHES, -(-8 * len(item) // 10))
        if same.sum() < least:
            return None
        total = np.concatenate([[0], np.cumsum(np.where(same, 1, -3))])
        lowest = np.minimum.accumulate(total)
        end = int(np.argmax(total - lowest))
        begin = int(np.flatnonzero(total[: end + 1] == lowest[end])[-1])
        n, matches = end - begin, int(same[begin:end].sum())
        if matches < least or matches < SIMILARITY * n:
            # The best of all is not enough itself: the best of those that are.
            if (found := Index._enough(same, total, least)) is None:
                return None
            begin, end = found
            n, matches = end - begin, int(same[begin:end].sum())
        return low + begin + shift, low + begin, n, matches

    @staticmethod
    def _enough(same: np.ndarray, total: np.ndarray, least: int) -> tuple[int, int] | None:
        """(begin, end) of the stretch with the largest `total` among those of `least` matches and the share SIMILARITY, or None."""
        count = np.concatenate([[0], np.cumsum(same)])
        # In whole numbers: a stretch has the share where it does not lower 5 x matches - 4 x tokens.
        share = 5 * count - 4 * np.arange(len(count))
        highest = np.maximum.accumulate(share[::-1])[::-1]
        begins = np.flatnonzero(same)
        last = len(share) - 1 - np.searchsorted(highest[::-1], share[begins], "left")  # the longest stretch that has it
        best = None
        for b, e in zip(begins.tolist(), last.tolist()):
            first = int(np.searchsorted(count, count[b] + least, "left"))
            if first > e:
                continue
            sums = np.where(share[first : e + 1] >= share[b], total[first : e + 1] - total[b], np.iinfo(np.int64).min)
            at = int(np.argmax(sums))
            if best is None or sums[at] > best[0]:
                best = int(sums[at]), b, first + at
        return best and best[1:]


def _indexes(benchmark: DataFrame) -> Iterator[tuple[Index, bool]]:
    """The index of each block of the benchmark (item_id, text), and whether it is the last; rows equal in both are one item."""
    benchmark = benchmark.select("item_id", "text").distinct()
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // BLOCK_CHARS))
    items = benchmark.select("item_id", "text").where("text is not null")
    for b in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield Index(sorted(((r["item_id"], r["text"]) for r in block.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))), b == blocks - 1


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id and the overlap (doc_start, item_start, n_tokens, n_matches, item_tokens) of `docs` (doc_id, text) with `benchmark` (item_id, text).

    One row for each row of `docs` and item that overlap: the best overlap, at the first place of equal ones.
    Places and lengths are in tokens. Null and empty texts overlap nothing; a null item_id stays null; rows repeated in
    `docs` are repeated, rows repeated in `benchmark` are one item; an empty table on either side gives no rows. Texts are
    scanned whole, once for each block of the benchmark; nothing of them is shuffled. Other columns are ignored.
    """
    spark, found = docs.sparkSession, None
    for index, last in _indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names = ["doc_id", *[x.split()[0] for x in OUT.split(", ")]]
            for batch in batches:
                rows = []
                for doc_id, hits in zip(batch["doc_id"].astype("object"), shared.value.overlaps(batch["text"].tolist())):
                    rows += [(None if pd.isna(doc_id) else int(doc_id), *h) for h in hits]
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "item_id": "Int64"})

        part = docs.select("doc_id", "text").mapInPandas(scan, f"doc_id long, {OUT}")
        if not last:  # executors hold one block at a time
            part = written(part, "overlaps")
            shared.unpersist()
        found = part if found is None else found.unionByName(part)
    return found


def flagged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` with boolean `contaminated` added (a column of this name is replaced): whether the row's text overlaps an item of the benchmark.

    False for null and empty texts and for an empty benchmark. Rows, repeated ones too, stay as they are. Texts are
    scanned whole, once for each block of the benchmark.
    """
    spark = docs.sparkSession
    python_batches(spark)
    names = [c for c in docs.columns if c.lower() != "contaminated"]
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "text", F.lit(False).alias("contaminated"))
    for index, last in _indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)
        out = out.withColumn("contaminated", F.col("contaminated") | _hit(shared)("text"))
        if not last:
            out = written(out, "flagged")
            shared.unpersist()
    return out.select("row.*", "contaminated")


def _hit(shared):
    @F.pandas_udf("boolean")
    def hit(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(x) for x in shared.value.overlaps(texts.tolist())], dtype=bool)

    return hit


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every overlap of a document with a benchmark item."""
    python_batches(spark)
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("similarity", F.col("n_matches") / F.col("n_tokens"))
