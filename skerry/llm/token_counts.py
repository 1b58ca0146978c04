"""Unigram token counts with a trie shared by pre-tokens.

A pre-token is a word ``[^\\x20\\x09-\\x0D]+`` behind the mark U+2581.  Its tokens are the
segmentation of greatest total score; of equal ones, that with fewer tokens.  Pieces come from a
public vocabulary file in order of rank; their scores are the logarithms of a Zipf law over the
ranks.  A character in no piece costs its UTF-8 bytes, one token each.

Distinct pre-tokens are inserted in a trie.  A node holds the best forward score of its prefix and
the tokens of it; both follow from the nodes above, so a prefix that many pre-tokens share is
scored once, and a pre-token's count is its last node's.  Trie and terminal counts are bounded in
size and built anew when full, which changes no result.

Defined cases: a null or empty text has 0 tokens and 0 pre-tokens; a null id is carried; repeated
rows are counted alike; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.byte_bpe import Pieces, resolve

MARK = "▁"
FILE = "piece_bpe_32k.model"
MAX_NODES = 600_000
#: By how much a byte of an unknown character scores below the last piece.
BYTE_PENALTY = 10.0
_BLANKS = str.maketrans("\t\n\x0b\x0c\r", "     ")


def zipf_scores(pieces: list[str]) -> dict[str, float]:
    """Logarithms of shares proportional to 1 / (rank + 1)."""
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces)))) if pieces else 0.0
    return {p: -math.log(r + 1) - total for r, p in reversed(list(enumerate(pieces)))}


def read_pieces(path: str) -> list[str]:
    """Ordinary pieces of a sentencepiece file, by rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]


class Trie:
    """Prefixes with their best forward scores and token counts."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte = min(scores.values(), default=0.0) - BYTE_PENALTY
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.tokens = [0.0], [0]

    def count(self, pretoken: str) -> int:
        """Insert a pre-token; its number of tokens."""
        if len(self.best) > MAX_NODES:
            self.clear()
        child, best, tokens, scores = self.child, self.best, self.tokens, self.scores
        path, node = [0], 0
        for i, c in enumerate(pretoken):
            key = node << 21 | ord(c)
            node = child.get(key, -1)
            if node < 0:
                size = len(c.encode("utf-8", "surrogatepass"))
                above = path[i]
                top, n = best[above] + size * self.byte, -tokens[above] - size
                for j in range(max(0, i + 1 - self.longest), i + 1):
                    s = scores.get(pretoken[j : i + 1])
                    if s is not None:
                        above = path[j]
                        found = (best[above] + s, -tokens[above] - 1)
                        if found > (top, n):
                            top, n = found
                node = child[key] = len(best)
                best.append(top)
                tokens.append(-n)
            path.append(node)
        return tokens[node]


@functools.cache
def _table(path: str) -> Pieces:
    trie = Trie(zipf_scores(read_pieces(path)))
    return Pieces(lambda word: trie.count(MARK + word))


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``n_pretokens`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(resolve(path, FILE))
        for batch in batches:
            n_tokens, n_words = [], []
            for text in batch.column(1).to_pylist():
                found = [w for w in (text or "").translate(_BLANKS).split(" ") if w]
                n_words.append(len(found))
                n_tokens.append(sum(map(table.__getitem__, found)))
            yield pa.record_batch([batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(n_words, pa.int64())], names=["doc_id", "n_tokens", "n_pretokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_pretokens long")
