"""Token ids in files: blocks of ids as byte planes, each compressed with zstandard, with an index in every chunk.

A file set is a Parquet folder, so any store that Spark reaches can hold it. Its rows are chunks of whole
documents: the ids of a chunk are cut into blocks of a fixed size (the last one shorter), a block is transposed
into the four planes of its bytes, each plane is compressed, and the chunk's index says how many ids each block
and how many bytes each plane has, and how many ids each document has. A reader needs one chunk at a time.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodemap.llm.common import partitions, python_batches, scratch, table
from lodemap.llm.segments import SegmentIds, flat, taken

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
BLOCK_IDS = 16_384
#: A chunk is closed at the first document that brings it to so many ids.
CHUNK_IDS = 131_072
PLANES = 4
#: Segments that the tokenizer gets as one text.
TOGETHER = 512
SCHEMA = "segment int, chunk int, n_tokens long, doc_ids array<long>, doc_tokens array<long>, block_ids array<int>, plane_bytes array<int>, payload binary"
ARROW = pa.schema([("segment", pa.int32()), ("chunk", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())),
                   ("block_ids", pa.list_(pa.int32())), ("plane_bytes", pa.list_(pa.int32())), ("payload", pa.binary())])


def pack(ids: np.ndarray, level: int = 3) -> tuple[list[int], list[int], bytes]:
    """Ids of each block, bytes of each plane of each block, and the planes one after another."""
    squeeze = zstandard.ZstdCompressor(level=level)
    blocks, sizes, parts = [], [], []
    for at in range(0, len(ids), BLOCK_IDS):
        block = np.ascontiguousarray(ids[at : at + BLOCK_IDS], "<u4")
        blocks.append(len(block))
        for plane in block.view(np.uint8).reshape(-1, PLANES).T:
            parts.append(squeeze.compress(plane.tobytes()))
            sizes.append(len(parts[-1]))
    return blocks, sizes, b"".join(parts)


def unpack(blocks: list[int], sizes: list[int], payload: bytes) -> np.ndarray:
    """The ids of `pack`."""
    expand, at, out = zstandard.ZstdDecompressor(), 0, [np.zeros(0, "<u4")]
    for k, n in enumerate(blocks):
        planes = np.empty((n, PLANES), np.uint8)
        for p in range(PLANES):
            size = sizes[k * PLANES + p]
            planes[:, p] = np.frombuffer(expand.decompress(payload[at : at + size], max_output_size=n), np.uint8)
            at += size
        out.append(planes.view("<u4").ravel())
    return np.concatenate(out)


def _together(tokenizer) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Ids of segments one after another and how many each has, where many segments are one text for the tokenizer.

    The pattern cuts between a non-blank and a blank, so those that begin with one space and do not end in a blank can stand
    side by side; how many bytes each id stands for tells where a segment's ids end. A group whose ends are not met exactly,
    and all other segments, are encoded one by one.
    """
    added = {i: len(t.content.encode()) for i, t in tokenizer.get_added_tokens_decoder().items()}
    sizes = {i: len(t) for t, i in tokenizer.get_vocab().items()} | added  # a letter of a token is a byte
    size = np.zeros(max(sizes) + 1, np.int64)
    size[list(sizes)] = list(sizes.values())
    one_by_one = lambda segments: [e.ids for e in tokenizer.encode_batch_fast(segments, add_special_tokens=False)]

    def encode(segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        beside = [k for k, s in enumerate(segments) if s[0] == " " and len(s) > 1 and not s[1].isspace() and not s[-1].isspace()]
        groups = [beside[at : at + TOGETHER] for at in range(0, len(beside), TOGETHER)]
        own = np.fromiter((len(s) if s.isascii() else len(s.encode("utf-8", "surrogatepass")) for s in segments), np.int64, len(segments))
        parts, lengths, order, sure = [], [], [], np.zeros(len(segments), bool)
        for group, e in zip(groups, tokenizer.encode_batch_fast(["".join([segments[k] for k in g]) for g in groups], add_special_tokens=False)):
            ids, places = np.array(e.ids, np.int64), np.array(group)
            reached, ends = np.cumsum(size[ids]), np.cumsum(own[places])
            last = np.searchsorted(reached, ends)
            if len(ids) and last[-1] == len(ids) - 1 and np.array_equal(reached[last], ends):
                parts.append(ids)
                lengths.append(np.diff(last, prepend=-1))
                order.append(places)
                sure[places] = True
        alone = np.flatnonzero(~sure)
        ids, counts = flat(one_by_one([segments[k] for k in alone]))
        at = np.argsort(np.concatenate([*order, alone]))
        return taken(np.concatenate([*parts, ids]), np.concatenate([*lengths, counts]), at)

    return encode


@lru_cache(maxsize=4)
def _coder(path: str, added_tokens: bool) -> SegmentIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not added_tokens
    added = tokenizer.get_added_tokens_decoder().values() if added_tokens else ()
    if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
        raise ValueError("an added token that takes blanks or depends on what is beside it")
    return SegmentIds(_together(tokenizer), limit=1_200_000, added=tuple(t.content for t in added))


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, added_tokens: bool = False) -> None:
    """Write the ids of every text of `docs` (doc_id, text) to `folder`, in ascending order of doc_id.

    With `added_tokens`, an added token of the tokenizer in a text is that token, as an unaltered tokenizer has it; else text.

    Null texts are empty and have the end id alone. Null ids come first; rows of one doc_id are in order of their
    texts' hashes, so repeated rows stay and are interchangeable; rows equal in both are dealt to ranges by their place.
    Texts are encoded whole. An empty table gives files without chunks. Other columns are ignored.
    """
    order = ["doc_id", "tie", "row"]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, segment, chunk = _coder(tokenizer_path, added_tokens), TaskContext.get().partitionId(), 0
        held: list[tuple] = []  # (doc ids, tokens of each, all tokens)
        size = 0

        def closed() -> pa.RecordBatch:
            blocks, sizes, payload = pack(np.concatenate([x[2] for x in held]))
            doc_ids, tokens = pa.concat_arrays([x[0] for x in held]), np.concatenate([x[1] for x in held])
            row = {"segment": segment, "chunk": chunk, "n_tokens": int(tokens.sum()), "doc_ids": doc_ids.to_pylist(), "doc_tokens": tokens.tolist(), "block_ids": blocks, "plane_bytes": sizes, "payload": payload}
            return pa.RecordBatch.from_pylist([row], ARROW)

        for batch in batches:
            ids, at = coder(batch.column("text").to_pylist())
            stream = np.insert(ids, at[1:], end_id)
            tokens = np.diff(at) + 1
            ends = np.concatenate([[0], np.cumsum(tokens)])
            first, n = 0, len(tokens)
            while first < n:  # up to the document that fills the chunk
                last = min(n, int(np.searchsorted(ends, ends[first] + CHUNK_IDS - size)))
                held.append((batch.column("doc_id").slice(first, last - first), tokens[first:last], stream[ends[first] : ends[last]]))
                size += int(ends[last] - ends[first])
                first = last
                if size >= CHUNK_IDS:
                    yield closed()
                    chunk, size, held = chunk + 1, 0, []
        if held:
            yield closed()

    rows.select("doc_id", "text").mapInArrow(chunks, SCHEMA).write.option("compression", "none").parquet(folder)


def read(spark, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids): each document's ids as little-endian unsigned 32-bit integers, and how many ids stand before it.

    Starts come from the index alone: sums of a segment's chunks, and of the segments before it, of which there is one
    a task of `write`. ids_crc32 is the crc32 of `ids`; without `with_ids` only that leaves the task. Null and repeated
    doc_ids are rows as they were written. A folder without chunks gives no rows. A document's ids are one value, so a
    text may have 2 GB of ids at most.
    """
    files = spark.read.schema(SCHEMA).parquet(folder)
    segments = files.groupBy("segment").agg(F.sum("n_tokens").alias("n"))
    before = segments.select("segment", (F.sum("n").over(Window.orderBy("segment")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("segment").orderBy("chunk")) - F.col("n_tokens")
    starts = files.select("segment", "chunk", "n_tokens").withColumn("inside", inside).join(before, "segment")
    starts = starts.select("segment", "chunk", (F.col("before") + F.col("inside")).alias("chunk_start"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(name) for name in batch.schema.names}
            for r in range(batch.num_rows):
                blocks, sizes = column["block_ids"][r].as_py(), column["plane_bytes"][r].as_py()
                raw = memoryview(unpack(blocks, sizes, column["payload"][r].as_py()).astype("<u4", copy=False)).cast("B")
                counts = column["doc_tokens"][r].values.to_numpy(zero_copy_only=False)
                at = np.concatenate([[0], np.cumsum(counts)])
                parts = [raw[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                n = len(parts)
                out = [pa.array([column["segment"][r].as_py()] * n, pa.int32()), pa.array([column["chunk"][r].as_py()] * n, pa.int32()), column["doc_ids"][r].values,
                       pa.array(at[:-1]), pa.array(counts), pa.array(map(zlib.crc32, parts), pa.int64())]
                names = ["segment", "chunk", "doc_id", "offset", "n_tokens", "ids_crc32"]
                if with_ids:
                    out, names = [*out, pa.array([bytes(p) for p in parts], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)

    ids = ", ids binary" if with_ids else ""
    found = files.drop("n_tokens").mapInArrow(documents, f"segment int, chunk int, doc_id long, offset long, n_tokens long, ids_crc32 long{ids}")
    start = (F.col("chunk_start") + F.col("offset")).alias("start")
    return found.join(starts, ["segment", "chunk"]).select("doc_id", start, "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back."""
    python_batches(spark)
    folder = scratch(spark, "tokens")
    write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER), added_tokens=True)
    return read(spark, folder, with_ids=False)
