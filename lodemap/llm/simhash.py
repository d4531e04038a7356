"""SimHash near-duplicates: fingerprints, and a binary-trie self-join under a Hamming budget.

The self-join. Cut a fingerprint of 64 bits into `budget + 1` blocks: two fingerprints with at most `budget`
differing bits agree in one block at least. So there is one binary trie for each block and value; each trie is
over the fingerprints that share that block, with the other bits as the path. A trie is joined with itself:
pairs of nodes descend together bit by bit, carry the number of bits in which their paths differ, and are
pruned beyond the budget. A trie with more than `trie_rows` fingerprints is cut into chunks, its sorted order
being the trie's own; pairs of chunks are tasks of their own, so no task holds a whole hot trie, and pairs of
chunks whose common prefixes already differ in too many bits are pruned before any row moves.

Links are wanted for their components, so each task returns a spanning forest of the links that it found,
never all pairs of a dense group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodemap.llm.common import collected, partitions, python_batches, table, Tables, written

BITS = 64
SEED = 42
#: The ends of up to so many edges are broadcast, 24 bytes each; of more they are shuffled.
BROADCAST_EDGES = 200_000
_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_AT = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(text: str | None, shingle: int) -> int:
    """SimHash of a text's word shingles as an unsigned 64-bit integer; 0 for no words or null.

    A-Z in lower case; words are runs without ASCII white space; a text of fewer words is one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], dtype="<u8")
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _BYTE_AT).ravel(), minlength=2048).reshape(8, 256)
    ones = (seen @ _BIT_OF_BYTE).ravel()
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: Column, shingle: int) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return hashed(text)


def _rotations(budget: int) -> list[tuple[int, int]]:
    """(first bit from the left, width) of each block."""
    n = budget + 1
    edges = [round(BITS * i / n) for i in range(n + 1)]
    return [(edges[i], edges[i + 1] - edges[i]) for i in range(n)]


def _forest(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Indices of links that keep the components of all links given; nodes are any integers."""
    nodes, ends = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b, kept, label = ends[: len(left)], ends[len(left) :], [], np.arange(len(nodes))
    at = np.arange(len(a))
    while len(at):
        la, lb = label[a[at]], label[b[at]]
        at = at[la != lb]
        if not len(at):
            break
        la, lb = label[a[at]], label[b[at]]
        high, low = np.maximum(la, lb), np.minimum(la, lb)
        roots, first = np.unique(high, return_index=True)  # each root hooks on to one smaller label: no cycles
        kept.append(at[first])
        label[roots] = low[first]
        while (label[label] != label).any():
            label = label[label]
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


class _Trie:
    """A sorted array of paths seen as a binary trie: a node at depth d is the range of rows with its d first bits."""

    def __init__(self, paths: np.ndarray, depth: int):
        self.paths, self.depth, self._ones = paths, depth, {}

    def middle(self, low: np.ndarray, high: np.ndarray, d: int) -> np.ndarray:
        """Where the second child of nodes at depth d begins."""
        if d not in self._ones:
            bit = (self.paths >> np.uint64(self.depth - 1 - d)) & np.uint64(1)
            self._ones[d] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        ones = self._ones[d]
        return high - (ones[high] - ones[low])


def trie_join(paths: np.ndarray, depth: int, pairs: np.ndarray, budget: int, width: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of `paths` whose last `depth` bits differ in at most `budget` places.

    `pairs`: one row (low, high, low, high) for each pair of root ranges; a root pairs with itself or one that
    stands apart. Pairs of nodes descend together; a frontier over `width` is cut and its parts go one by one.
    """
    trie = _Trie(paths, depth)
    stack = [(0, pairs.astype(np.int64), np.zeros(len(pairs), np.int64))]
    while stack:
        d, p, errors = stack.pop()
        same = (p[:, 0] == p[:, 2]) & (p[:, 1] == p[:, 3])
        lone = (p[:, 1] - p[:, 0] == 1) & (p[:, 3] - p[:, 2] == 1)
        if len(ends := p[lone & ~same]):  # single leaves: the rest of both paths at once
            left, right = ends[:, 0], ends[:, 2]
            close = np.bitwise_count(paths[left] ^ paths[right]) <= budget
            if close.any():
                yield left[close], right[close]
        p, errors = p[~lone], errors[~lone]
        if not len(p):
            continue
        if d == depth:  # rows of equal paths
            for low, high, low2, high2 in p.tolist():
                for a in range(low, high):
                    b = np.arange(a + 1, high) if (low, high) == (low2, high2) else np.arange(low2, high2)
                    yield np.full(len(b), a), b
            continue
        if len(p) > width:
            cut = len(p) // 2
            stack += [(d, p[:cut], errors[:cut]), (d, p[cut:], errors[cut:])]
            continue
        same = (p[:, 0] == p[:, 2]) & (p[:, 1] == p[:, 3])
        a, b = trie.middle(p[:, 0], p[:, 1], d), trie.middle(p[:, 2], p[:, 3], d)
        left = (np.stack([p[:, 0], a], 1), np.stack([a, p[:, 1]], 1))
        right = (np.stack([p[:, 2], b], 1), np.stack([b, p[:, 3]], 1))
        nodes, costs = [], []
        for x in (0, 1):
            for y in (0, 1):
                keep = errors + (x != y) <= budget
                if (x, y) == (1, 0):
                    keep &= ~same  # already there as (0, 1)
                node = np.concatenate([left[x], right[y]], 1)[keep]
                full = (node[:, 1] > node[:, 0]) & (node[:, 3] > node[:, 2])
                nodes.append(node[full])
                costs.append((errors + (x != y))[keep][full])
        stack.append((d + 1, np.concatenate(nodes), np.concatenate(costs)))


def _least(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Of links, the `most` smallest partners below each node, as (node, partner); whether any node has more."""
    pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0)
    first = np.concatenate([[0], np.flatnonzero(pairs[1:, 0] != pairs[:-1, 0]) + 1])
    place = np.arange(len(pairs)) - np.repeat(first, np.diff(np.append(first, len(pairs))))
    return pairs[place < most, 0], pairs[place < most, 1], bool((place >= most).any())


def _joined(budget: int, most: int | None):
    """mapInPandas function: rows (task, side, path, id), sorted by them; a task's links as spanning edges.

    With `most`, the links themselves: those of each node to so many smaller ones, and whether there are more.
    """

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        task, side = rows["task"].to_numpy(), rows["side"].to_numpy()
        path, ids = rows["path"].to_numpy().view(np.uint64), rows["id"].to_numpy()
        new = np.concatenate([[True], (task[1:] != task[:-1]) | (side[1:] != side[:-1])])
        low = np.flatnonzero(new)
        high = np.append(low[1:], len(rows))
        pair_next = np.append((task[low[1:]] == task[low[:-1]]), False)  # both chunks of a pair are here
        second = np.concatenate([[False], pair_next[:-1]])
        alone = ~pair_next & ~second & (side[low] == 0)
        i, j = np.flatnonzero(pair_next), np.flatnonzero(pair_next) + 1
        roots = np.concatenate([np.stack([low[alone], high[alone]] * 2, 1), np.stack([low[i], high[i], low[j], high[j]], 1)])
        roots = roots[(roots[:, 1] - roots[:, 0] > 1) | (roots[:, 0] != roots[:, 2])]
        out, held, full = [], 0, False
        for a, b in trie_join(path, BITS, roots, budget):
            out.append((ids[a], ids[b]))
            held += len(a)
            if held > 1 << 20:
                (a, b), more = fewer(out)
                out, held, full = [(a, b)], 0, full or more
        if not out:
            return pd.DataFrame({"a": [], "b": [], "more": []}).astype({"a": "int64", "b": "int64", "more": "bool"})
        (a, b), more = fewer(out)
        return pd.DataFrame({"a": a, "b": b, "more": full or more})

    def fewer(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[tuple[np.ndarray, np.ndarray], bool]:
        a, b = (np.concatenate(x) for x in zip(*parts))
        a, b = a[a != b], b[a != b]
        if most is not None:
            a, b, more = _least(a, b, most)
            return (a, b), more
        keep = _forest(a, b)
        return (a[keep], b[keep]), False

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:  # a task's rows may lie in several batches
            held.append(batch)
            size += len(batch)
            if size < 50_000:
                continue
            rows = pd.concat(held, ignore_index=True)
            task = rows["task"].to_numpy()
            cut = int(np.searchsorted(task, task[-1]))
            if cut:
                yield links(rows.iloc[:cut])
                rows = rows.iloc[cut:]
            held, size = [rows], len(rows)
        if size:
            yield links(pd.concat(held, ignore_index=True))

    return run


def hamming_links(fps: DataFrame, budget: int = 3, trie_rows: int = 4096, most: int | None = None) -> DataFrame:
    """Edges (a, b) between rows (id, view, fp) whose fingerprints in one view differ in at most `budget` bits.

    The edges have the components of all such pairs and at most a few edges for each row; an id has one row a view.
    With `most` they are the links of each row to at most so many smaller ids in each trie, and `more` says
    whether the trie's task saw others. Every trie takes part; one over `trie_rows` is met in pairs of its chunks.
    """
    cuts, parts = _rotations(budget), []
    for t, (at, width) in enumerate(cuts):
        key = F.expr(f"shiftrightunsigned(fp, {BITS - at - width}) & {(1 << width) - 1}")
        path = F.col("fp") if at == 0 else F.expr(f"shiftleft(fp, {at}) | shiftrightunsigned(fp, {BITS - at})")
        parts.append(F.struct((F.col("view") * len(cuts) + t).alias("trie"), key.alias("key"), path.alias("path")))
    rows = fps.select("id", F.explode(F.array(*parts)).alias("r")).select("r.*", "id")
    sizes = rows.groupBy("trie", "key").agg(F.count("*").alias("n")).where("n > 1")
    largest = sizes.agg(F.max("n")).first()[0] or 0
    large = sizes.where(F.col("n") > trie_rows)
    # A trie of few fingerprints is one task: its rows meet in one place, sorted as the trie is.
    small = rows.join(sizes.where(F.col("n") <= trie_rows), ["trie", "key"], "left_semi").select(
        F.xxhash64("trie", "key", F.lit(0), F.lit(0)).alias("task"), F.lit(0).alias("side"), "path", "id")
    # Chunks of a large trie are its nodes at a depth where a node holds trie_rows / 4 in the mean; a node that
    # still holds more is dealt into pieces by a hash.
    deep = F.least(F.lit(24), F.greatest(F.lit(1), F.ceil(F.log2(F.col("n") * 4.0 / trie_rows)))).cast("int")
    hot = rows.join(large.select("trie", "key", deep.alias("depth")), ["trie", "key"])
    width = F.element_at(F.array(*[F.lit(w) for _, w in cuts]), F.col("trie") % len(cuts) + 1)
    node = F.expr("shiftrightunsigned(shiftleft(path, w), 64 - depth)")
    hot = hot.withColumn("w", width).withColumn("node", node)
    counted = hot.groupBy("trie", "key", "node").agg(F.count("*").alias("rows"))
    cut = counted.withColumn("pieces", F.ceil(F.col("rows") / (trie_rows // 2)).cast("int"))
    chunk = cut.select("trie", "key", "node", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    # Pairs of chunks of a large trie: from each node down every path that differs in at most `budget` bits, never all pairs.
    near = cut.join(large.select("trie", "key", deep.alias("depth")), ["trie", "key"]).select("trie", "key", "node", "depth", F.col("node").alias("node2"))
    for _ in range(budget):
        flipped = near.withColumn("bit", F.explode(F.sequence(F.lit(0), F.col("depth") - 1))).withColumn("node2", F.expr("node2 ^ shiftleft(1L, bit)"))
        near = near.unionByName(flipped.drop("bit")).distinct()
    near = near.where("node <= node2").drop("depth")
    other = chunk.select("trie", "key", F.col("node").alias("node2"), F.col("piece").alias("piece2"))
    pairs = chunk.join(near, ["trie", "key", "node"]).join(other, ["trie", "key", "node2"]).where("node < node2 OR piece <= piece2")
    task = F.xxhash64("trie", "key", F.hash("node", "piece"), F.hash("node2", "piece2"), "node", "node2", "piece", "piece2")
    ends = pairs.select("trie", "key", task.alias("task"), F.explode(F.when(
        (F.col("node") == F.col("node2")) & (F.col("piece") == F.col("piece2")),
        F.array(F.struct(F.lit(0).alias("side"), F.col("node").alias("node"), F.col("piece").alias("piece"))),
    ).otherwise(F.array(
        F.struct(F.lit(0).alias("side"), F.col("node").alias("node"), F.col("piece").alias("piece")),
        F.struct(F.lit(1).alias("side"), F.col("node2").alias("node"), F.col("piece2").alias("piece")),
    ))).alias("e")).select("trie", "key", "task", "e.*")
    placed = hot.join(cut, ["trie", "key", "node"]).withColumn("piece", F.pmod(F.hash("id"), F.col("pieces")))
    dealt = placed.join(ends, ["trie", "key", "node", "piece"]).select("task", "side", "path", "id")
    tasks = small.unionByName(dealt) if largest > trie_rows else small
    tasks = tasks.repartition(partitions(fps.sparkSession), "task").sortWithinPartitions("task", "side", "path")
    return tasks.mapInPandas(_joined(budget, most), "a long, b long, more boolean")


def _stars(edges: DataFrame) -> tuple[int, bool]:
    """The number of edges (a, b), and whether they are stars: every a has one b, and no b is an a."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    got = nodes.agg(F.sum("down").alias("n"), F.count_if(F.expr("down > 1 or down > 0 and up > 0")).alias("wrong")).first()
    return got["n"] or 0, got["wrong"] == 0


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for the ends of edges (a, b) of longs; component: the smallest node reachable.

    Large-star and small-star steps in turn, each written to the shared folder, until the edges are stars. A step
    joins the edges with each node's smallest neighbour. Minima are taken before they are shuffled. What is joined
    is broadcast while there are few nodes, else a written table, so that both sides of the join are plain exchanges
    and the edges of one hot node can be split among tasks. Edges with a null end link nothing; no edges give no rows.
    """
    with Tables(edges.sparkSession) as tables:
        edges = tables.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        n, done = _stars(edges)
        for _ in range(rounds):
            if done:
                break
            few = n <= BROADCAST_EDGES
            held = F.broadcast if few else lambda df: tables.written(df, "low")  # noqa: B023
            # Large star: every node joins its larger neighbours to its smallest neighbour, itself included.
            both = edges.union(edges.select("b", "a")).toDF("u", "v")
            low = held(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
            large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
            large = large if few else tables.written(large.distinct(), "large")
            # Small star: every node joins its smaller neighbours and itself to the smallest of them.
            low = held(large.groupBy("a").agg(F.min("b").alias("m")))
            ends = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))
            edges = tables.written(large.join(low, "a").select(F.explode(ends).alias("e")).select("e.*").where("a <> b").distinct(), "edges")
            n, done = _stars(edges)
        if not done:
            raise RuntimeError(f"no stars after {rounds} rounds")
        stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        return written(stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct(), "stars")


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 3, trie_rows: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id) for every row of `docs` (doc_id, text).

    component_id: the smallest doc_id whose fingerprint is reachable over links. A null text has no words:
    fingerprint 0, linked like any other. A null doc_id stays a row; a component of only null ids has a null id.
    Repeated rows are repeated. Texts are read whole, however long. An empty table gives no rows. Other columns are ignored.
    """
    python_batches(docs.sparkSession)
    marked = written(docs.select("doc_id", simhash(F.col("text"), shingle).alias("fp")), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    stars = components(hamming_links(distinct.select(F.col("fp").alias("id"), F.lit(0).alias("view"), "fp"), budget, trie_rows))
    linked = distinct.join(stars.withColumnRenamed("node", "fp"), "fp")
    lowest = written(linked.groupBy("component").agg(F.min("first").alias("component_id")), "lowest")
    named = written(linked.join(lowest, "component").select("fp", "component_id"), "named")
    alone = distinct.join(named, "fp", "left_anti").select("fp", F.col("first").alias("component_id"))
    names = written(named.unionByName(alone), "names")
    return marked.join(names, "fp").select("doc_id", "fp", "component_id")


# --- similar texts, for a corpus of which one of each group stays ---

#: Seeds of the word-set fingerprints that bring similar texts together; any one within the budget will do.
VIEWS = 4
#: Partners that a text is compared with at first, in each task of shared shingles; later rounds take more.
MOST = 16
#: Shingles of at least so many texts are put last in a text's order, up to so many shingles, the most frequent ones.
#: Which ones these are changes what a join costs, never what it finds.
HOT_TEXTS = 4
HOT_SHINGLES = 100_000
#: Shingles that are counted at once in a task.
COUNTED = 4 << 20
#: Texts with a common shingle that one task meets at once; more are met in pairs of pieces of half as many.
BUCKET_ROWS = 4096
#: Of more texts with a common shingle no pairs are returned: their shingles move and are compared in the tasks, which return links alone.
DENSE_ROWS = 64
#: Such texts in a task, in pieces that meet first for themselves and then in pairs, and their shingles in each piece.
PIECE_ROWS = 256
PAIRED_ROWS = 1024
PIECE_SHINGLES = 1 << 18
#: Groups of one smallest text are met as one where it has at most so many times the texts of the largest of them.
WIDER = 4
#: Texts of a task that look at all others before one is fixed whose group need not.
SEEN_FIRST = 16


class _WordHashes(dict):
    """Hashes of words, remembered; `text` begins anew beyond a million."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found

    def text(self, text: str | None) -> tuple[list[bytes], np.ndarray]:
        """A text's words, A-Z in lower case, and their hashes."""
        if len(self) > 1 << 20:
            self.clear()
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        return words, np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_HASHES = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _majority(hashes: np.ndarray) -> int:
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _BYTE_AT).ravel(), minlength=2048).reshape(8, 256)
    return int(np.packbits((seen @ _BIT_OF_BYTE).ravel() * 2 > len(hashes), bitorder="little").view("<i8")[0])


def _shingles(hashes: np.ndarray, shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct word shingles of a text whose words have `hashes`; of fewer words the whole is one."""
    if not len(hashes):
        return hashes
    width = min(shingle, len(hashes))
    out = np.zeros(len(hashes) - width + 1, np.uint64)
    for i in range(width):
        out = _mixed(out + hashes[i : i + len(out)])
    return np.unique(out)


def _hot(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that many of all `texts` have, and in how many each is, as far as tasks saw them more than once."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def again() -> pd.DataFrame:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"h": h[n > 1].view(np.int64), "n": n[n > 1]})

        for batch in batches:
            for text in batch["text"]:
                own = xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass"))
                if own not in seen:  # copies are one text
                    seen.add(own)
                    held.append(_shingles(_HASHES.text(text)[1], shingle))
                    size += len(held[-1])
            if size >= COUNTED:
                yield again()
                held, size = [], 0
                seen.clear()
        if held:
            yield again()

    counts = texts.select("text").mapInPandas(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_TEXTS)
    rows = counts.orderBy(F.desc("n"), "h").limit(HOT_SHINGLES).collect()
    h, n = np.array([r["h"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _prefix(grams: np.ndarray, similarity: float, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles in one order for all texts, rare ones first: so many that similar texts have one of them in common."""
    size = len(grams) - int(np.ceil(similarity * len(grams) - 1e-9)) + 1
    known, counts = hot
    if len(known) and len(grams):
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        grams = grams[np.argsort(np.where(known[at] == grams, counts[at], 0), kind="stable")]
    return grams[:size].view(np.int64)


def marks(text: Column, shingle: int, similarity: float, hot) -> Column:
    """same (equal for equal word sequences), n (distinct shingles), views (of the word set), prefix (of shingles)."""

    @F.pandas_udf("same string, n int, views array<long>, prefix array<long>")
    def marked(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            words, hashes = _HASHES.text(t)
            if not words:
                rows.append(("", 0, [0] * VIEWS, []))
                continue
            grams, own = _shingles(hashes, shingle), np.unique(hashes)
            views = [_majority(_mixed(own + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))) for k in range(VIEWS)]
            rows.append((xxhash.xxh3_128_hexdigest(b" ".join(words)), len(grams), views, _prefix(grams, similarity, hot.value)))
        return pd.DataFrame(rows, columns=["same", "n", "views", "prefix"])

    return marked(text)


def row_key() -> Column:
    """Equal for rows of `docs` (doc_id, text) that are equal in both; a null text is an empty one."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(row_key, doc_id, rows, kept, stays): a row for every distinct row of `docs` (doc_id, text), and how many times it is there.

    kept: the smallest doc_id of its group; stays: whether it is the one that stays, that with the smallest doc_id and
    then the smallest row_key. A document is a row, not a doc_id: unlike texts that share a doc_id are in groups of their
    own. Null ids come after all others; a group of none else has a null `kept`. Texts of equal words are copies, those
    without words as well. Other texts are linked when the Jaccard similarity of their word shingles is `similarity` or
    more. Tries of the word set's fingerprints link most of them; then all texts with a common shingle among their first
    (`_prefix`) that are not in one group yet are compared, so groups are those of all links: in the tasks where many have
    the shingle (`_dense`), else as pairs. Texts are read whole. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    python_batches(spark)
    texts = docs.select(row_key().alias("row_key"), "doc_id", "text")
    hot = spark.sparkContext.broadcast(_hot(texts, shingle))
    with Tables(spark) as tables:
        marked = texts.select("row_key", "doc_id", marks(F.col("text"), shingle, similarity, hot).alias("m"))
        marked = tables.written(marked.select(F.monotonically_increasing_id().alias("id"), "row_key", "doc_id", "m.*"), "marks")
        # Copies first: one node for each word sequence, numbered as one of its rows, whose number is fixed as it is written.
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
        nodes = tables.written(marked.groupBy("same").agg(F.min("id").alias("id"), first, F.count("*").alias("rows")), "nodes")
        copies = tables.written(marked.select("same", "id").join(nodes.where("rows > 1").select("same", F.col("id").alias("node")), "same").where("id <> node").select("id"), "copies")
        points = marked.join(_small(copies), "id", "left_anti").where("n > 0")
        # Texts of one fingerprint are compared with the first of them, which alone takes part in the tries.
        views = points.select("id", F.posexplode("views").alias("view", "fp"))
        firsts = tables.written(views.groupBy("view", "fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "firsts")
        tied = views.join(_small(tables.written(firsts.where("n > 1").select("view", "fp", "rep"), "tied")), ["view", "fp"]).where("id > rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
        found = hamming_links(firsts.select(F.col("rep").alias("id"), "view", "fp"), 3, most=1)
        tried = tables.written(found.select("a", "b").union(tied).distinct(), "candidates")
        links = tables.written(_similar(tried, points, texts, shingle, similarity, tables), "similar")
        collected(spark)
        stars = components(links)
        # What the tries did not bring together: every pair of texts of two groups that may be similar, in rounds that
        # compare each text with more and more others, for links join groups and spare the rest of their pairs.
        shared = _shared(points, tables)
        if not shared.where(F.col("rows") > DENSE_ROWS).isEmpty():
            members = _members(shared.where(F.col("rows") > DENSE_ROWS), tables)
            for paired in (False, True):
                dealt = tables.written(_dense(members, stars, paired, tables), "dense")
                if dealt.isEmpty():
                    continue
                sets = _sets(dealt.select("id").distinct(), points, texts, shingle, tables)
                dealt = dealt.join(sets, "id").repartition(partitions(spark), "task").sortWithinPartitions("task")
                links = links.unionByName(tables.written(dealt.mapInPandas(_linked(similarity), "a long, b long"), "similar"))
                collected(spark)
                stars = components(links)
            shared = shared.where(F.col("rows") <= DENSE_ROWS)
        most, more = MOST, True
        while more:
            met = tables.written(_meetings(shared, stars, similarity, most, tables).groupBy("a", "b").agg(F.max("more").alias("more")), "candidates")
            fresh = tables.written(met.select("a", "b").join(tried, ["a", "b"], "left_anti"), "fresh")
            tried = tried.unionByName(fresh)
            new = tables.written(_similar(fresh, points, texts, shingle, similarity, tables), "similar")
            collected(spark)
            more = not met.where("more").isEmpty()
            if not new.isEmpty():
                links = links.unionByName(new)
                stars = components(links)
            most *= 16
        linked = nodes.select("id", "first").join(_small(stars.withColumnRenamed("node", "id")), "id")
        lowest = tables.written(linked.groupBy("component").agg(F.min("first").alias("lowest")), "lowest")
        moved = tables.written(linked.join(_small(lowest), "component").select("id", "lowest"), "moved")
        of = tables.written(nodes.join(_small(moved), "id", "left").select("same", F.coalesce("lowest", "first").alias("lowest")), "names")
        final = marked.groupBy("row_key", "same").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows")).join(of, "same")
        return written(final.select("row_key", "doc_id", "rows", F.col("lowest.doc_id").alias("kept"), (F.col("row_key") == F.col("lowest.row_key")).alias("stays")), "groups")


def _small(table: DataFrame) -> DataFrame:
    """A written table of numbers and keys, broadcast where it has BROADCAST_EDGES rows at most."""
    return F.broadcast(table) if table.count() <= BROADCAST_EDGES else table


def _shared(points: DataFrame, tables: Tables) -> DataFrame:
    """(h, id, n, pos, rows, leader): the shingles in the prefixes of texts (id, n, prefix) that are in those of others, too, in
    how many, and the smallest of these. n and pos cross the exchange as one number.
    """
    rows = points.select("id", F.col("n").cast("long").alias("n"), F.posexplode("prefix").alias("pos", "h")).select("h", "id", F.expr("shiftleft(n, 32) | pos").alias("size"))
    alike = rows.withColumn("rows", F.count("*").over(Window.partitionBy("h"))).withColumn("leader", F.min("id").over(Window.partitionBy("h"))).where("rows > 1")
    return tables.written(alike.select("h", "id", F.expr("shiftright(size, 32)").cast("int").alias("n"), F.expr("size & 4294967295").cast("int").alias("pos"), F.col("rows").cast("int").alias("rows"), "leader"), "shared")


def _in_groups(rows: DataFrame, stars: DataFrame) -> DataFrame:
    """`rows` (id) with their group, `component`."""
    names = stars.select(F.col("node").alias("id"), "component")
    return rows.join(_small(names), "id", "left").withColumn("component", F.coalesce("component", "id"))


def _in_pairs(rows: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """`rows` (key, id, component) once for each pair of pieces that they meet in: task, side, within.

    `sizes` (key, largest, others, own): the largest group has pieces of its own, which meet the others' pieces alone.
    """
    none, large = F.lit(0), F.col("component") == F.col("largest")
    many = rows.join(sizes, key).withColumn("side", F.when(large, F.col("others") + F.pmod(F.hash("id"), F.col("own"))).otherwise(F.pmod(F.hash("id"), F.col("others"))))
    many = many.withColumn("other", F.explode(F.sequence(none, F.col("others") + F.when(large, none).otherwise(F.col("own")) - 1)))
    task = F.xxhash64(key, F.least("side", "other"), F.greatest("side", "other"))
    return many.withColumn("task", task).withColumn("within", F.col("side") == F.col("other"))


def _members(shared: DataFrame, tables: Tables) -> DataFrame:
    """(key, id, n): the texts of `shared` in buckets, so that all texts of a shingle are in one.

    Near copies have many shingles in common and are the same texts for each; shingles with the same smallest text make one
    bucket, unless it would be much larger than theirs.
    """
    once = tables.written(shared.groupBy("leader", "id").agg(F.max("n").alias("n"), F.max("rows").alias("rows")), "members")
    wide = once.groupBy("leader").agg(F.count("*").alias("m"), F.max("rows").alias("top")).where(F.col("m") > F.col("top") * WIDER).select("leader")
    wide = _small(tables.written(wide, "wide"))
    narrow = once.join(wide, "leader", "left_anti").select(F.col("leader").alias("key"), "id", "n")
    return tables.written(narrow.union(shared.join(wide, "leader", "left_semi").select(F.col("h").alias("key"), "id", "n")), "members")


def _dense(members: DataFrame, stars: DataFrame, paired: bool, tables: Tables) -> DataFrame:
    """(task, side, within, id, component): the texts of each bucket that has texts of two groups, dealt out to tasks.

    Not `paired`: each text goes to one piece of its bucket, where it meets all others. `paired`: the pieces of buckets that
    had more than one meet each other; by then most texts of a dense bucket are in its largest group and meet no more.
    """
    rows = _in_groups(members, stars)
    groups = rows.groupBy("key", "component").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    sizes = groups.groupBy("key").agg(F.sum("size").alias("all"), F.sum("n").alias("n"), F.max("size").alias("top"), F.max_by(F.struct("component", "n"), F.struct("size", "component")).alias("most"), F.count("*").alias("groups")).where("groups > 1")
    pieces = lambda size, n, most: F.ceil(F.greatest(size / most, n / PIECE_SHINGLES)).cast("int")
    alone = pieces(F.col("all"), F.col("n"), PIECE_ROWS)
    if not paired:
        placed = rows.join(_small(tables.written(sizes.select("key", alone.alias("pieces")), "sizes")), "key").withColumn("side", F.pmod(F.hash("id"), F.col("pieces")))
        return placed.select(F.xxhash64("key", "side").alias("task"), "side", F.lit(True).alias("within"), "id", "component")
    others = pieces(F.col("all") - F.col("top"), F.col("n") - F.col("most.n"), PAIRED_ROWS).alias("others")
    own = pieces(F.col("top"), F.col("most.n"), PAIRED_ROWS).alias("own")
    sizes = sizes.where(alone > 1).select("key", F.col("most.component").alias("largest"), others, own)
    return _in_pairs(rows, "key", _small(tables.written(sizes, "sizes"))).select("task", "side", "within", "id", "component")


def _linked(similarity: float):
    """mapInPandas function: rows of `_dense` with their shingles `s`, sorted by task; the links of each task as spanning edges."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        ids, side, within = (rows[x].to_numpy() for x in ("id", "side", "within"))
        label = np.unique(rows["component"].to_numpy(), return_inverse=True)[1]
        n = np.array([len(x) // 8 for x in rows["s"]])
        _, gram, count = np.unique(np.frombuffer(b"".join(rows["s"]), "<u8"), return_inverse=True, return_counts=True)
        owner, first = np.repeat(np.arange(len(n)), n)[np.argsort(gram, kind="stable")], np.cumsum(count) - count
        ends, a, b, seed = np.cumsum(n), [], [], None
        for k, i in enumerate(np.argsort(np.bincount(label)[label], kind="stable").tolist()):
            # Texts in the group of one fixed text need no look from their side: those outside of it look at them.
            if k == SEEN_FIRST:
                seed = np.bincount(label)[label].argmax()
            if seed is not None and label[i] == label[seed]:
                continue
            own = gram[ends[i] - n[i] : ends[i]]
            own = own[count[own] > 1]
            size = count[own]
            at = np.arange(size.sum()) + np.repeat(first[own] - np.cumsum(size) + size, size)
            both = np.bincount(owner[at], minlength=len(n))
            near = np.flatnonzero((both / np.maximum(1, n[i] + n - both) >= similarity) & (label != label[i]) & (within[i] | (side != side[i])))
            for j in near[np.unique(label[near], return_index=True)[1]].tolist():
                a.append(ids[i])
                b.append(ids[j])
                label[label == label[j]] = label[i]
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:  # a task's rows may lie in several batches
            for _, part in batch.groupby("task", sort=False):
                if held and held[-1]["task"].iloc[0] != part["task"].iloc[0]:
                    yield links(pd.concat(held, ignore_index=True))
                    held = []
                held.append(part)
        if held:
            yield links(pd.concat(held, ignore_index=True))

    return run


def _meetings(shared: DataFrame, stars: DataFrame, similarity: float, most: int, tables: Tables) -> DataFrame:
    """(a, b, more): pairs of texts of two groups, a > b, that share a shingle and whose sizes and places of it allow `similarity`.

    Every such pair, or those of each text with its `most` smallest partners of a task and whether there are more.
    A shingle's rows are met in one task, or, where they are many, in pairs of pieces. The largest group among them has
    pieces of its own, which meet the others' pieces alone, so copies of one text make tasks in proportion to their number.
    """
    rows = _in_groups(shared, stars)
    dealt = rows.where(F.col("rows") <= BUCKET_ROWS).select(F.col("h").alias("task"), "h", F.lit(0).alias("side"), F.lit(True).alias("within"), "id", "n", "pos", "component")
    many = rows.where(F.col("rows") > BUCKET_ROWS)
    if not shared.where(F.col("rows") > BUCKET_ROWS).isEmpty():
        groups = many.groupBy("h", "component").agg(F.count("*").alias("size"))
        sizes = groups.groupBy("h").agg(F.sum("size").alias("all"), F.max("size").alias("top"), F.max_by("component", "size").alias("largest"), F.count("*").alias("groups")).where("groups > 1")
        pieces = lambda x: F.ceil(x * 2 / BUCKET_ROWS).cast("int")
        sizes = _small(tables.written(sizes.select("h", "largest", pieces(F.col("all") - F.col("top")).alias("others"), pieces(F.col("top")).alias("own")), "sizes"))
        dealt = dealt.unionByName(_in_pairs(many, "h", sizes).select("task", "h", "side", "within", "id", "n", "pos", "component"))
    dealt = dealt.repartition(partitions(shared.sparkSession), "task").sortWithinPartitions("task")
    return dealt.mapInPandas(_met(similarity, most), "a long, b long, more boolean")


def _met(similarity: float, most: int):
    """mapInPandas function: rows of `_meetings`, sorted by task; the pairs of each task."""
    enough = similarity / (1 + similarity)

    def pairs(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        task, h, side, within, ids, n, pos, group = (rows[x].to_numpy() for x in ("task", "h", "side", "within", "id", "n", "pos", "component"))
        # No more can be in common than what is left of both from their first common shingle on.
        rest = n - pos
        last = np.searchsorted(task, task, "right")
        at, step, out, held, full = np.arange(len(task)), 0, [], 0, False
        while True:
            step += 1
            at = at[at + step < last[at]]
            if not len(at):
                break
            to = at + step
            good = (group[at] != group[to]) & (h[at] == h[to]) & (within[at] | (side[at] != side[to]))
            good &= (np.minimum(n[at], n[to]) >= similarity * np.maximum(n[at], n[to]) - 1e-9) & (np.minimum(rest[at], rest[to]) >= enough * (n[at] + n[to]) - 1e-6)
            if good.any():
                out.append((ids[at[good]], ids[to[good]]))
                held += len(out[-1][0])
            if held > 1 << 20:
                a, b, more = _least(*(np.concatenate(x) for x in zip(*out)), most)
                out, held, full = [(a, b)], len(a), full or more
                if held > 1 << 19:
                    yield pd.DataFrame({"a": a, "b": b, "more": full})
                    out, held = [], 0
        if out:
            a, b, more = _least(*(np.concatenate(x) for x in zip(*out)), most)
            yield pd.DataFrame({"a": a, "b": b, "more": full or more})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:  # a task's rows may lie in several batches
            held.append(batch)
            size += len(batch)
            if size < 50_000:
                continue
            rows = pd.concat(held, ignore_index=True)
            task = rows["task"].to_numpy()
            cut = int(np.searchsorted(task, task[-1]))
            if cut:
                yield from pairs(rows.iloc[:cut])
                rows = rows.iloc[cut:]
            held, size = [rows], len(rows)
        if size:
            yield from pairs(pd.concat(held, ignore_index=True))

    return run


def _sets(ids: DataFrame, points: DataFrame, texts: DataFrame, shingle: int, tables: Tables) -> DataFrame:
    """(id, s): the sorted shingles of the texts `ids` (id, each once), which are read again."""

    @F.pandas_udf("binary")
    def packed(column: pd.Series) -> pd.Series:
        return pd.Series([_shingles(_HASHES.text(t)[1], shingle).tobytes() for t in column])

    keys = tables.written(points.select("id", "row_key").join(_small(tables.written(ids, "ends")), "id", "left_semi"), "keys")
    sets = tables.written(texts.join(_small(keys), "row_key").select("id", packed(F.col("text")).alias("s")), "shingles")
    if sets.count() > keys.count():  # rows equal in id and text are one text
        sets = tables.written(sets.groupBy("id").agg(F.max("s").alias("s")), "shingles")
    return sets


def _similar(candidates: DataFrame, points: DataFrame, texts: DataFrame, shingle: int, similarity: float, tables: Tables) -> DataFrame:
    """The candidates (a, b) whose texts' shingles have the Jaccard similarity.

    Only those are read again whose sizes and prefixes allow it: what two texts have in common is in both prefixes, or
    among the rest of one of them, so no similar pair is passed over.
    """
    ends = lambda pairs: pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    own = points.join(_small(tables.written(ends(candidates), "ends")), "id", "left_semi").select("id", "n", "prefix")
    of = lambda x: own.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("prefix").alias(f"p_{x}"))
    rest = F.greatest(F.col("n_a") - F.size("p_a"), F.col("n_b") - F.size("p_b"))
    likely = candidates.join(of("b"), "b").join(of("a"), "a").where(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9)
    likely = likely.where(F.size(F.array_intersect("p_a", "p_b")) + rest >= similarity / (1 + similarity) * (F.col("n_a") + F.col("n_b")) - 1e-6)
    likely = tables.written(likely.select("a", "b"), "likely")

    @F.pandas_udf("double")
    def jaccard(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right):
            a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(both / max(1, len(a) + len(b) - both))
        return pd.Series(out)

    sets = _sets(ends(likely), points, texts, shingle, tables)
    pairs = likely.join(sets.select(F.col("id").alias("b"), F.col("s").alias("s_b")), "b").join(sets.select(F.col("id").alias("a"), F.col("s").alias("s_a")), "a")
    return pairs.where(jaccard("s_a", "s_b") >= similarity).select("a", "b")


def op2_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's SimHash of 3-word shingles and the component of links at 3 or fewer differing bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, budget=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
