"""Texts cut where a tokenizer's pattern always cuts, and ids of such pieces remembered while a worker lives.

The patterns meant are alternatives of word-like runs with one blank before, `\\s+(?!\\S)` and `\\s+`.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

import numpy as np

# Unicode white space, as \s of the tokenizers' patterns takes it (the separators 1C to 1F are not in it),
# and ASCII marks.
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_MARK = r"!\"#$%&()'*+,\-./:;<=>?@\[\\\]^_`{|}~"
#: The patterns let no match go from a non-blank to a blank, nor from a letter or digit to an ASCII mark, so the ids
#: of a text are those of its segments, one after another. A segment is a run of letters and digits that ends at such
#: a place, with the blanks and marks before it; else all up to the next blank; else blanks at the end of the text.
SEGMENT = re.compile(rf"[{_BLANK}]*[{_MARK}]*[^\W_]++(?=[{_MARK}{_BLANK}]|\Z)|[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+")

#: Blanks other than space and line end, and the sign that marks the cuts: texts with one of these are cut by SEGMENT.
_RARE = ["\0", "\t", "\r", "\x0b", "\x0c", "\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]


def _quick(text: str) -> list[str] | None:
    """Segments that begin at every space and line end, by plain replacements; None where that could cut inside a run of blanks.

    Before the last blank of a run a cut is safe, too: the patterns leave that one to what follows. Two line ends are one segment's.
    """
    for c in _RARE[:5] if text.isascii() else _RARE:
        if c in text:
            return None
    cut = text.replace(" ", "\0 ").replace("\n", "\0\n")
    if "\n\0\n" in cut:
        cut = cut.replace("\n\0\n", "\n\n")
        if "\n\0\n" in cut:
            return None
    if " \0" in cut or cut.endswith("\n\0 "):
        return None
    found = cut.split("\0")
    return found if found[0] else found[1:]


class _Numbers(dict):
    """Numbers of segments in the order in which they were first asked for; `new` lists those since the last were learned."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, segment: str) -> int:
        number = self[segment] = len(self)
        self.new.append(segment)
        return number


def flat(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids one after another, and their lengths."""
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths


def taken(ids: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs `at` of ids that are runs of these lengths, and their lengths."""
    starts, new = np.cumsum(lengths) - lengths, lengths[at]
    ends = np.cumsum(new)
    return ids[np.repeat(starts[at] - ends + new, new) + np.arange(int(new.sum()))], new


class SegmentIds:
    """Encodes texts segment by segment; what `encode` returned for a segment is kept, up to `limit` segments.

    `encode` returns a list of ids for each segment, or all ids one after another and how many each has.

    A worker then needs about a hundred bytes for each, whatever the table's size. Beyond the limit, or beyond
    LETTERS for each of so many segments, as texts without blanks would have, it begins anew.
    """

    LETTERS = 24

    def __init__(self, encode: Callable[[list[str]], list[list[int]] | tuple[np.ndarray, np.ndarray]], limit: int, added: tuple[str, ...] = ()):
        self.encode, self.limit = encode, limit
        #: Tokens that a text is cut at before all else, each a segment; of two at one place the longer one.
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self._clear()

    def _clear(self) -> None:
        self.known = _Numbers()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)  # segment k has ids[starts[k]:starts[k + 1]]
        self.learned = self.letters = 0

    def _learn(self) -> None:
        """Ids of the new segments, put after those of the others."""
        new = self.known.new
        found = self.encode(new)
        ids, lengths = found if isinstance(found, tuple) else flat(found)
        n, at, total = self.learned, int(self.starts[self.learned]), int(lengths.sum())
        while n + len(lengths) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while at + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.starts[n + 1 : n + 1 + len(lengths)] = at + np.cumsum(lengths)
        self.ids[at : at + total] = ids
        self.learned += len(lengths)
        self.letters += sum(map(len, new))
        new.clear()

    def _segments(self, text: str) -> list[str]:
        if self.added is None or not self.added.search(text):
            return _quick(text) or SEGMENT.findall(text)
        found, at = [], 0
        for m in self.added.finditer(text):
            found += SEGMENT.findall(text[at : m.start()])
            found.append(m[0])
            at = m.end()
        return found + SEGMENT.findall(text[at:])

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and where each text's ids begin (with the end of the last)."""
        if len(self.known) > self.limit or self.letters > self.limit * self.LETTERS:
            self._clear()
        places: list[int] = []
        counts = np.zeros(len(texts) + 1, np.int64)
        number = self.known.__getitem__
        for k, text in enumerate(texts):
            if text:
                places += map(number, self._segments(text))
                counts[k + 1] = len(places)
            else:
                counts[k + 1] = len(places)
        if self.known.new:
            self._learn()
        place = np.array(places, np.int64)
        lengths = self.starts[place + 1] - self.starts[place]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.repeat(self.starts[place] - ends[:-1], lengths) + np.arange(ends[-1])]
        return ids, ends[counts]
