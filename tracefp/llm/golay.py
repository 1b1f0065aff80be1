"""The perfect binary (23, 12, 7) Golay code as a fuzzy hash of short bit strings.

Every 23-bit word lies within three bits of exactly one code word, its own.  A word
three bits away from its own code word has five further code words at four bits,
any other word has none.  Two words that differ in one bit: the own code word of
either is among the (at most six) code words within four bits of the other.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

N, K = 23, 12
GENERATOR = 0b110001110101  # x^11+x^10+x^6+x^5+x^4+x^2+1 with its bits turned


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte syndromes, pattern to the own code word, patterns to further ones).

    The code is cyclic: the syndrome of a word is its remainder by the generator
    polynomial.  Patterns are listed by syndrome; a further pattern of -1 is void.
    """
    def remainder(word: int) -> int:
        for bit in range(N - 1, N - K - 1, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - (N - K))
        return word

    unit = [remainder(1 << b) for b in range(N)]
    syndromes = np.zeros((3, 256), np.int64)
    for part in range(3):
        for value in range(256):
            for bit in range(8):
                if value >> bit & 1 and part * 8 + bit < N:
                    syndromes[part, value] ^= unit[part * 8 + bit]
    own = np.full(1 << (N - K), -1, np.int64)
    for weight in range(4):
        for bits in combinations(range(N), weight):
            s = 0
            for b in bits:
                s ^= unit[b]
            assert own[s] == -1
            own[s] = sum(1 << b for b in bits)
    further: list[list[int]] = [[] for _ in own]
    for bits in combinations(range(N), 4):
        s = 0
        for b in bits:
            s ^= unit[b]
        if bin(own[s]).count("1") == 3:
            further[s].append(sum(1 << b for b in bits))
    return syndromes, own, np.array([x + [-1] * (5 - len(x)) for x in further], np.int64)


def syndrome(words: np.ndarray) -> np.ndarray:
    s, _, _ = tables()
    return s[0, words & 255] ^ s[1, words >> 8 & 255] ^ s[2, words >> 16 & 255]


def own_index(words: np.ndarray) -> np.ndarray:
    """12-bit index of each word's own code word."""
    _, own, _ = tables()
    return (words ^ own[syndrome(words)]) >> (N - K)


def near_indices(words: np.ndarray) -> np.ndarray:
    """(n, 6) indices of all code words within four bits; -1 where there are fewer."""
    _, own, further = tables()
    s = syndrome(words)
    more = further[s]
    out = np.empty((len(words), 6), np.int64)
    out[:, 0] = (words ^ own[s]) >> (N - K)
    out[:, 1:] = np.where(more >= 0, (words[:, None] ^ more) >> (N - K), -1)
    return out
