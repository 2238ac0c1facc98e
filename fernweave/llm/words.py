"""Words and shingles as numbers: what the joins on word shingles share."""

from __future__ import annotations

import numpy as np

#: Lower-cases A-Z, keeps 0-9, a-z and all bytes of other characters; anything else ends a word.
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: Bytes that a worker keeps of words and their hashes.
MEMO_BYTES = 96 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    """From a word to its 64-bit hash."""

    def __init__(self):
        super().__init__()
        self.held = 0

    def __missing__(self, word: bytes) -> int:
        import xxhash

        got = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self.held += 180 + len(word)
            if self.held > MEMO_BYTES:
                self.clear()
                self.held = 0
            self[word] = got
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words (at least one), by its start."""
    s = np.full(max(0, len(hashes) - size + 1), np.uint64(size))
    for i in range(size):
        s = s * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(s)]
    return mixed(s)
