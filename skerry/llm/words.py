"""Word and shingle hashes of many texts at once.

Words are ``[^\\x20\\x09-\\x0D]+`` runs after A-Z are lower-cased.  Hashes have 64 bits: each byte
value has a random 64-bit weight, a word is the polynomial of its weights, and a final mix spreads
the bits.  All arithmetic is modulo 2**64, over whole arrays.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 18
SHINGLE_WORDS = 5

_rng = np.random.default_rng(20240229)
_WEIGHT = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = _rng.integers(1, 2**63, SHINGLE_WORDS, dtype=np.uint64) * U64(2) + U64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def running_hash(joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(total, down): bytes i to j hash to ``(total[j] - total[i]) * down[i]``, wherever they stand; A-Z count as a-z."""
    up, down = _power_tables(len(joined) + 1)
    total = np.empty(len(joined) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_WEIGHT[_LOWER[joined]] * up[: len(joined)], out=total[1:])
    return total, down


def chunks(texts: Sequence[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts as UTF-8, each run of about ``limit`` bytes: (index of the first, texts)."""
    first, size, run = 0, 0, []
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if run and size + len(raw) > limit:
            yield first, run
            first, size, run = i, 0, []
        run.append(raw)
        size += len(raw)
    if run:
        yield first, run


def slices(batches: Iterator, rows: int = 512) -> Iterator:
    """Arrow batches in parts of ``rows`` rows, so that a worker holds Python objects of one part at a time.

    Workers live on between stages; at the end of a task unused memory goes back to the system.
    """
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def word_hashes(raws: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin (one more entry than texts)."""
    joined = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    sizes = np.fromiter((len(r) + 1 for r in raws), np.int64, len(raws))
    ends_at = np.cumsum(sizes)
    space = _SPACE[joined]
    edge = np.diff(space.view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge[1:] == 1) + 1
    total, down = running_hash(joined)
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.concatenate(([0], np.searchsorted(starts, ends_at)))


def shingle_sets(raws: Sequence[bytes], words: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Each text's sorted distinct shingles of ``words`` words.

    A text with fewer words has one shingle, its whole sequence; one without words has none.
    """
    hashes, at = word_hashes(raws)
    if len(hashes) >= words:
        n = len(hashes) - words + 1
        rolled = np.zeros(n, np.uint64)
        for k in range(words):
            rolled += mix(hashes[k : k + n] + U64(k + 1)) * _STEP[k % SHINGLE_WORDS]
        rolled = mix(rolled)
    else:
        rolled = np.empty(0, np.uint64)
    found = []
    for i in range(len(raws)):
        a, b = at[i], at[i + 1]
        if b - a >= words:
            found.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            short = np.zeros(1, np.uint64)
            for k in range(b - a):
                short += mix(hashes[a + k : a + k + 1] + U64(k + 1)) * _STEP[k % SHINGLE_WORDS]
            found.append(mix(short + U64(b - a)))
        else:
            found.append(np.empty(0, np.uint64))
    return found
