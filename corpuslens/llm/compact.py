"""Numbers by word for tables of any size: the most frequent words in a dict, all others packed, and as exact."""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence
from zlib import crc32

import numpy as np


class Packed(Mapping[str, int]):
    """Words and numbers in 20 bytes a word besides its letters: checksums in order lead to the words, which are compared in full."""

    def __init__(self, words: Sequence[str], numbers: Sequence[int]) -> None:
        raw = [w.encode() for w in words]
        sums = np.fromiter(map(crc32, raw), np.uint32, len(raw))
        order = np.argsort(sums, kind="stable")
        ends = np.zeros(len(raw) + 1, np.int64)
        ends[1:] = np.cumsum([len(raw[i]) for i in order])
        self.letters = b"".join(raw[i] for i in order)
        self.sums, self.ends, self.numbers = array("I", sums[order].tobytes()), array("q", ends.tobytes()), array("q", np.asarray(numbers, np.int64)[order].tobytes())

    def get(self, word: str, default=None):
        raw = word.encode("utf-8", "surrogatepass")
        own = crc32(raw)
        i = bisect_left(self.sums, own)
        while i < len(self.sums) and self.sums[i] == own:
            if self.letters[self.ends[i] : self.ends[i + 1]] == raw:
                return self.numbers[i]
            i += 1
        return default

    def __contains__(self, word: object) -> bool:
        return self.get(word) is not None

    def __getitem__(self, word: str) -> int:
        if (n := self.get(word)) is None:
            raise KeyError(word)
        return n

    def __iter__(self) -> Iterator[str]:
        return (self.letters[a:b].decode() for a, b in zip(self.ends, self.ends[1:]))

    def __len__(self) -> int:
        return len(self.numbers)


class Tiered(Mapping[str, int]):
    """The words of `first`, a dict, and of `rest`, which has none of them."""

    def __init__(self, first: dict[str, int], rest: Packed) -> None:
        self.first, self.rest = first, rest

    def get(self, word: str, default=None):
        n = self.first.get(word)
        return self.rest.get(word, default) if n is None else n

    def __contains__(self, word: object) -> bool:
        return word in self.first or word in self.rest

    def __getitem__(self, word: str) -> int:
        return self.first[word] if word in self.first else self.rest[word]

    def __iter__(self) -> Iterator[str]:
        yield from self.first
        yield from self.rest

    def __len__(self) -> int:
        return len(self.first) + len(self.rest)


def tiered(first: dict[str, int], words: Sequence[str], numbers: Sequence[int]) -> Mapping[str, int]:
    """`first` as it is where there are no further words."""
    return Tiered(first, Packed(words, numbers)) if len(words) else first
