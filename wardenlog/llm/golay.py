"""Keys from the perfect binary Golay code of 23 bits, so that near words share a key.

Every word of 23 bits lies within three bits of exactly one codeword; a word at distance three has five more codewords at
distance four. Its keys are the 12-bit indices of the first, and in the second case of all six. Two words that differ in
two bits or fewer share a key: where the nearer codeword of one is four bits from the other, it is among the other's five.
"""

from __future__ import annotations

from functools import cache

import numpy as np

BITS, INFO = 23, 12
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the code (fixed value).
GENERATOR = 0b101011100011


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of each word by the generator."""
    rest = words.astype(np.int64).copy()
    for bit in range(BITS - 1, BITS - INFO - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - (BITS - INFO))), rest)
    return rest


@cache
def _errors() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the error pattern of weight three or less, and the patterns of weight four (five, or -1)."""
    one = [1 << i for i in range(BITS)]
    by_weight = {0: np.array([0])}
    for w in (1, 2, 3, 4):
        low = by_weight[w - 1]
        by_weight[w] = np.unique(np.concatenate([low[(low & b) == 0] | b for b in one]))
    near = np.zeros(1 << 11, np.int64)
    for w in (0, 1, 2, 3):
        near[_syndromes(by_weight[w])] = by_weight[w]
    four, syndromes = by_weight[4], _syndromes(by_weight[4])
    order = np.argsort(syndromes, kind="stable")
    four, syndromes = four[order], syndromes[order]
    far = np.full((1 << 11, 5), -1, np.int64)
    weight = np.array([bin(x).count("1") for x in near])
    for s in np.nonzero(weight == 3)[0]:
        far[s] = four[np.searchsorted(syndromes, s):np.searchsorted(syndromes, s, "right")]
    return near, far


def keys(words: np.ndarray) -> np.ndarray:
    """A row of six codeword indices for each word; -1 where there are fewer."""
    near, far = _errors()
    words = words.astype(np.int64)
    s = _syndromes(words)
    out = np.full((len(words), 6), -1, np.int64)
    out[:, 0] = (words ^ near[s]) >> (BITS - INFO)
    patterns = far[s]
    out[:, 1:] = np.where(patterns < 0, -1, (words[:, None] ^ patterns) >> (BITS - INFO))
    return out
