"""Index words of the binary Golay code, for keys that survive a few wrong bits.

The (23, 12) code is perfect: each 23-bit word is within three bits of exactly
one codeword. A word at three bits from its codeword has five more at four
bits. Keyed by the indices of all these (one, or six), two words that differ in
at most two bits share a key.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

BITS, DATA, CHECK = 23, 12, 11
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GENERATOR = 0b110001110101
KEYS = 6


def _remainder(word: int) -> int:
    for i in range(BITS - 1, CHECK - 1, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - CHECK)
    return word


_CHECKS = np.array([_remainder(d << CHECK) for d in range(1 << DATA)], dtype=np.uint32)
_CODEWORDS = (np.arange(1 << DATA, dtype=np.uint32) << CHECK) | _CHECKS


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error's data bits, the indices to add for the other near codewords, and how many keys there are."""
    error = np.zeros(1 << CHECK, dtype=np.uint32)
    other = np.zeros((1 << CHECK, KEYS), dtype=np.uint32)
    count = np.ones(1 << CHECK, dtype=np.uint8)
    sevens = [int(c) for c in _CODEWORDS if bin(c).count("1") == 7]
    for weight in range(4):
        for bits in combinations(range(BITS), weight):
            e = sum(1 << b for b in bits)
            s = int(_CHECKS[e >> CHECK]) ^ (e & ((1 << CHECK) - 1))
            error[s] = e >> CHECK
            if weight == 3:
                near = [c >> CHECK for c in sevens if c & e == e]
                other[s, 1:] = near
                count[s] = KEYS
    return error, other, count


_ERROR, _OTHER, _COUNT = _tables()


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(n, 6)`` 12-bit indices of the codewords near each 23-bit word, and how many of the six count."""
    words = words.astype(np.uint32)
    data = words >> CHECK
    syndrome = _CHECKS[data] ^ (words & ((1 << CHECK) - 1))
    return (data ^ _ERROR[syndrome])[:, None] ^ _OTHER[syndrome], _COUNT[syndrome]
