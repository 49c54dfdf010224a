"""Word shingles of whole texts as sorted 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

#: Words whose hashes a worker remembers; the memory is emptied when it is full.
REMEMBERED = 500_000
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
HALF = np.uint64(32)


class Words(dict):
    """Hash of a word, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def scramble(values: np.ndarray) -> np.ndarray:
    for _ in range(2):
        values = (values ^ (values >> HALF)) * MIX
    return values ^ (values >> HALF)


def shingle_sets(texts: Iterable[str], words: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, sorted.

    Words are runs of anything but ASCII blanks, A-Z in lower case: what
    `bytes` calls words. A text of fewer words is one shingle; one without words has none.
    """
    known = Words()
    for text in texts:
        found = text.encode().lower().split()
        if len(known) > REMEMBERED:
            known.clear()
        hashes = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        width = min(words, len(hashes))
        if not width:
            yield hashes
            continue
        rolled = hashes[: len(hashes) - width + 1].copy()
        for k in range(1, width):
            rolled = rolled * STEP + hashes[k : len(hashes) - width + 1 + k]
        yield np.unique(scramble(rolled))
