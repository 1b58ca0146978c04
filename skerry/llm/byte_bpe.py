"""Byte-level BPE: encode by merge ranks, decode by concatenating vocabulary strings.

The vocabulary comes from a tokenizer file (JSON of the ``tokenizers`` library); nothing is trained.

Encoding a pre-token: its bytes are a doubly linked list of symbols; a priority queue holds
(rank, position, symbols) of adjacent pairs.  The lowest rank is merged first; an entry whose
symbols have changed since it was queued is stale and skipped.

Texts are cut at single blanks and line feeds between other characters, where the pre-tokenizer
cuts too, so that a repeated piece is encoded once per worker (the table of pieces is bounded and
holds results only: dropping it changes no result).  A text with any other white space, or with the
string of an added token, goes through the pre-tokenizer's pattern as a whole.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import regex

#: The byte-level pre-tokenizer's pattern (fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A text that holds one of these isn't cut at blanks: white space in runs, or of other kinds (fixed value of Unicode).
_UNEVEN = ("  ", " \n", "\n ", "\n\n", *map(chr, (9, 11, 12, 13, 28, 29, 30, 31, 133, 160, 5760, 6158, *range(8192, 8204), 8232, 8233, 8239, 8287, 12288, 65279)))
#: Entries of a table; the tables of ``ByteBPE`` are smaller, as they share a worker with other stages of a pipeline.
MAX_PIECES, MAX_OWN_PIECES = 600_000, 100_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Pieces(dict):
    """A bounded table of results; a missing key is computed.

    A result is kept aside at first and enters the table when it is asked for again, so that
    pieces that occur once don't push out the frequent ones.
    """

    def __init__(self, make: Callable, limit: int = MAX_PIECES):
        self.make, self.limit, self.recent = make, limit, {}

    def __missing__(self, key):
        value = self.recent.pop(key, None)
        if value is None:
            if len(self.recent) >= self.limit:
                self.recent.clear()
            value = self.recent[key] = self.make(key)
        else:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def packed(ids: Iterable[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.fromiter(ids, "<u4").tobytes()


class PieceEncoder:
    """Packed ids of whole texts from those of pieces; ``encode_piece`` gives those of one cut-out piece."""

    def __init__(self, encode_piece: Callable[[str], bytes], encode_whole: Callable[[str], bytes], added: list[str], limit: int = MAX_PIECES):
        self.after_blank = Pieces(lambda piece: encode_piece(" " + piece), limit)
        self.at_start = Pieces(encode_piece, limit)
        self.line_feed = encode_piece("\n")
        self.encode_whole, self.refused = encode_whole, (*_UNEVEN, *added)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in self.refused):
            return self.encode_whole(text)
        found: list[bytes] = []
        for k, line in enumerate(text.split("\n")):
            first, *rest = line.split(" ")
            if k:
                found.append(self.line_feed)
            found.append(self.at_start[first])
            found.extend(map(self.after_blank.__getitem__, rest))
        return b"".join(found)


class ByteBPE:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        as_byte = {s: b for b, s in enumerate(symbols)}
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.base = [vocab.get(s) for s in symbols]
        self.merges: dict[int, dict[int, tuple[int, int]]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocab[left], {}).setdefault(vocab[right], (rank, vocab[left + right]))
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.strings: dict[int, bytes] = {i: bytes(as_byte[c] for c in s) for s, i in vocab.items()}
        self.strings |= {i: s.encode() for s, i in self.added.items()}
        self.pattern = regex.compile(PATTERN)
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.tokens = Pieces(lambda token: packed(self.merge(token.encode("utf-8", "replace"))), MAX_OWN_PIECES)
        self.numbers = {i: str(i) for i in self.strings}
        self.pieces = PieceEncoder(self.encode_piece, self.encode_whole, list(self.added), MAX_OWN_PIECES)
        self.encode = self.pieces.encode

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [i for i in map(self.base.__getitem__, raw) if i is not None]
        n = len(ids)
        if n < 2:
            return ids
        merges, none = self.merges, {}
        queue, left = [], ids[0]
        for k, right in enumerate(ids[1:]):
            if hit := merges.get(left, none).get(right):
                queue.append((hit[0], k, left, right, hit[1]))
            left = right
        if not queue:
            return ids
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            _, k, left, right, made = heapq.heappop(queue)
            if ids[k] != left or (j := after[k]) >= n or ids[j] != right:  # stale
                continue
            ids[k], ids[j] = made, -1
            j = after[k] = after[j]
            if j < n:
                before[j] = k
                if hit := merges.get(made, none).get(ids[j]):
                    heapq.heappush(queue, (hit[0], k, made, ids[j], hit[1]))
            if (j := before[k]) >= 0 and (hit := merges.get(ids[j], none).get(made)):
                heapq.heappush(queue, (hit[0], j, ids[j], made, hit[1]))
        return [i for i in ids if i >= 0]

    def encode_piece(self, piece: str) -> bytes:
        return b"".join(map(self.tokens.__getitem__, self.pattern.findall(piece)))

    def encode_whole(self, text: str) -> bytes:
        parts = self.split_added.split(text) if self.split_added else [text]
        return b"".join(packed((self.added[p],)) if p in self.added else self.encode_piece(p) for p in parts if p)

    def decode(self, ids: Iterable[int]) -> str:
        """Vocabulary strings one after the other; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")

    def joined(self, ids: Iterable[int]) -> str:
        """Decimal ids, joined by commas."""
        return ",".join(map(self.numbers.__getitem__, ids))


@functools.cache
def load(path: str) -> ByteBPE:
    """One encoder per process and file."""
    return ByteBPE(path)


@functools.cache
def load_library(path: str) -> PieceEncoder:
    """The same cutting in front of the ``tokenizers`` library, which encodes every piece."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()

    def encode(text: str) -> bytes:
        return packed(library.encode(text, add_special_tokens=False).ids)

    return PieceEncoder(encode, encode, [t.content for t in library.get_added_tokens_decoder().values()])


def resolve(path: str | None, name: str = "byte_bpe_50k.json") -> str:
    """The tokenizer file's place on this machine: ``path``, else where the public tokenizers are installed."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)
