"""Byte-level BPE by monoid tree reduction.

Encodings form a monoid: the ids of two neighbouring stretches of bytes are joined by encoding a window around
the seam again. A sequence of tokens is the encoding of its bytes if and only if each pair of neighbours is its
own encoding: the first merge across a boundary would take place in the pair alone as well, since merges are in
order of rank and those before it stay inside the two tokens. So a window grows until the pairs at its edges are
encodings of themselves; the tokens outside then provably stay. Decoding concatenates bytes up the same tree.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemap.llm.common import python_batches, table, with_fields
from lodemap.llm.segments import SegmentIds

RANKS = "byte_bpe_multi_50k.tiktoken"
# Code points that the regex package's Unicode tables call letters or numbers and the tokenizer's
# tables, of an older Unicode, do not: to its pattern they are neither. First and last of each range.
NEITHER = """558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2 a7f1-a7f1 ab6c-ab6d
107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9 11df1-11df1 1246f-1246f 12475-1247f 12550-12686 16ea0-16eb8
16ebb-16ed3 16ff2-16ff3 16ff4-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168 1d6a6-1d6a6
1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e
2cea2-2cead 323b0-33479 3d000-3fc3f"""
#: Stretches of so many bytes are encoded by plain merges; halves up to the second size are remembered.
LEAF, REMEMBERED = 3, 24


class Encoder:
    """Ids of bytes by the ranks of a file of lines `base64 rank`."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.seam = lru_cache(maxsize=1 << 17)(self._seam)
        self.half = lru_cache(maxsize=1 << 17)(self.encode_bytes)
        self.pattern = pattern()

    def merged(self, data: bytes) -> list[int]:
        """The pair of lowest rank, the leftmost of equals, is merged until none is left."""
        rank = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        found = [rank(data[i : i + 2]) for i in range(len(data) - 1)]
        none = 1 << 40
        worth = [none if r is None else r for r in found]
        while worth:
            low = min(worth)
            if low == none:
                break
            i = worth.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del worth[i]
            if i < len(worth):
                worth[i] = none if (r := rank(parts[i] + parts[i + 1])) is None else r
            if i:
                worth[i - 1] = none if (r := rank(parts[i - 1] + parts[i])) is None else r
        return [self.ranks[p] for p in parts]

    def _seam(self, a: int, b: int) -> list[int] | None:
        """The encoding of two neighbouring tokens' bytes; None where it is these tokens, so that both stay."""
        window = self.merged(self.tokens[a] + self.tokens[b])
        return None if window == [a, b] else window

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two stretches from theirs."""
        if not left or not right:
            return left or right
        window = self.seam(left[-1], right[0])  # one token on either side
        if window is None:
            return left + right
        if (len(left) == 1 or self.seam(left[-2], window[0]) is None) and (len(right) == 1 or self.seam(window[-1], right[1]) is None):
            return left[:-1] + window + right[1:]
        width = 2
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            window = self.merged(b"".join(map(self.tokens.__getitem__, left[i:] + right[:j])))
            if (i == 0 or self.seam(left[i - 1], window[0]) is None) and (j == len(right) or self.seam(window[-1], right[j]) is None):
                return left[:i] + window + right[j:]
            width *= 2

    def encode_bytes(self, data: bytes) -> list[int]:
        """Halves are encoded and joined."""
        if len(data) <= LEAF:
            return self.merged(data)
        half = len(data) // 2
        below = self.half if half < REMEMBERED else self.encode_bytes
        left, right = below(data[:half]), below(data[half:])
        return self.join(left, right)

    def piece(self, match: str) -> list[int]:
        data = match.encode("utf-8", "replace")
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.encode_bytes(data)

    def encode(self, text: str) -> list[int]:
        """Each match of the pattern on its own; between matches nothing is joined."""
        return [i for match in self.pattern.findall(text) for i in self.piece(match)]

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids, concatenated up the tree of halves."""
        if len(ids) <= 4096:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def pattern() -> regex.Pattern:
    """The tokenizer's pattern with its own classes of letters and numbers."""
    neither = "".join("\\U{:0>8}-\\U{:0>8}".format(*r.split("-")) for r in NEITHER.split())
    text = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", "OTHER").replace(r"\p{L}", "LETTER").replace(r"\p{N}", "NUMBER")
    return regex.compile(text.replace("OTHER", rf"[[^\s\p{{L}}\p{{N}}][{neither}]]").replace("LETTER", rf"[\p{{L}}--[{neither}]]").replace("NUMBER", rf"[\p{{N}}--[{neither}]]"), regex.V1)


@lru_cache(maxsize=4)
def _coder(path: str) -> tuple[Encoder, SegmentIds]:
    encoder = Encoder(path)
    return encoder, SegmentIds(lambda segments: list(map(encoder.encode, segments)), limit=600_000)


def encode_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """`docs` with `ids` (little-endian unsigned 32-bit integers) and `decoded` (the bytes of those ids) added.

    Columns of these names in `docs` are replaced. Null and empty texts have no ids; both columns are then empty bytes.
    Rows stay as they are, repeated ones too. Texts are encoded whole. Surrogates, which UTF-8 has not, cannot be in a column.
    """

    @F.pandas_udf("ids binary, decoded binary")
    def coded(texts: pd.Series) -> pd.DataFrame:
        encoder, segment_ids = _coder(path)
        ids, at = segment_ids(texts.tolist())
        ids = ids.astype("<u4")
        parts = [ids[a:b] for a, b in zip(at[:-1], at[1:])]
        return pd.DataFrame({"ids": [p.tobytes() for p in parts], "decoded": [encoder.decode(p.tolist()) for p in parts]})

    return with_fields(docs, coded(F.col(text)), ["ids", "decoded"])


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of `docs`."""
    found = encode_decode(docs.select("doc_id", "text"), path)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded by the ranks of a public tokenizer."""
    python_batches(spark)
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))
