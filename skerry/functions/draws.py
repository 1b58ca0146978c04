"""md5 draws of many observations at once: the numbers of ``columns.draw``, in numpy."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np

#: Observations that are hashed together.
CHUNK = 8192
_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_PLACES = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *((7 * i) % 16 for i in range(16))]


def _digest(prefix: bytes, digits: np.ndarray) -> list[np.ndarray]:
    """The four words of md5 of ``prefix`` followed by each row of ``digits``, read as big-endian numbers."""
    n, d = digits.shape
    size = len(prefix) + d
    if size > 55:  # more than one block
        found = b"".join(hashlib.md5(prefix + row.tobytes()).digest() for row in digits)
        return list(np.frombuffer(found, ">u4").reshape(n, 4).T.astype(np.uint32))
    block = np.zeros((n, 64), np.uint8)
    block[:, : len(prefix)] = np.frombuffer(prefix, np.uint8)
    block[:, len(prefix) : size] = digits
    block[:, size] = 0x80
    block[:, 56:58] = (8 * size) & 255, (8 * size) >> 8
    words = block.view("<u4")
    varying = range(len(prefix) // 4, (size - 1) // 4 + 1)
    message = [np.ascontiguousarray(words[:, k]) if k in varying else int(words[0, k]) for k in range(16)]
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, e = (np.full(n, x, np.uint32) for x in start)
    for i in range(64):
        if i < 16:
            f = e ^ (b & (c ^ e))
        elif i < 32:
            f = c ^ (e & (b ^ c))
        elif i < 48:
            f = b ^ c ^ e
        else:
            f = c ^ (b | ~e)
        f += a
        word = message[_PLACES[i]]
        if isinstance(word, int):
            f += np.uint32((word + _ADDED[i]) & 0xFFFFFFFF)
        else:
            f += word
            f += np.uint32(_ADDED[i])
        turned = f << np.uint32(_TURNS[i])
        turned |= f >> np.uint32(32 - _TURNS[i])
        turned += b
        a, e, c, b = e, c, b, turned
    return [(x + y).byteswap() for x, y in zip((a, b, c, e), start)]


def digests(numbers: np.ndarray, prefixes: list[str]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(i, places, words) of md5 of each prefix and each number that is not negative, numbers with as many digits at a time."""
    lengths = np.array([len(str(x)) for x in numbers.tolist()], int)
    alike = []
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        powers = 10 ** np.arange(d - 1, -1, -1, dtype=np.int64)
        alike.append((at, (numbers[at, None] // powers % 10 + 48).astype(np.uint8)))
    for i, prefix in enumerate(prefixes):
        for at, digits in alike:
            yield i, at, _digest(prefix.encode(), digits)
