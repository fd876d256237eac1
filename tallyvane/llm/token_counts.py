"""Unigram token counts with one forward pass per shared prefix.

A text is cut into pre-tokens (words with a leading mark). Each task keeps a trie of
the distinct pre-tokens it has met. A node stands for a prefix and stores the best
unigram score of that prefix and the number of pieces on the best path; both depend
on the prefix alone, so they are computed once however many pre-tokens share it.
A pre-token's count is then its terminal node's, and a text's count is a sum of
look-ups. Nothing is shuffled, and the trie is emptied at a fixed number of nodes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
MAX_NODES = 1_000_000
LONG = 64  # a pre-token of more characters is scored along its own path only


@lru_cache(maxsize=2)
def load_scores(path: str) -> tuple[dict[str, float], int]:
    """Piece scores of a sentencepiece vocabulary file and the longest piece's length.

    The file orders pieces by frequency, so a piece of rank r gets Zipf's log
    probability log(1 / (r + 2)). Control pieces and byte pieces are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores: dict[str, float] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            scores[model.id_to_piece(i)] = -math.log(len(scores) + 2)
    return scores, max(map(len, scores))


class Trie:
    """Forward scores by prefix. ``nodes[prefix]`` is (score, pieces) of the best segmentation.

    A character that no piece covers is written as its UTF-8 bytes, each at
    ``byte_score``. Of equal scores the one with fewer pieces wins.
    """

    def __init__(self, scores: dict[str, float], longest: int, byte_score: float = -12.0):
        self.scores, self.longest, self.byte_score = scores, longest, byte_score
        self.children: list[dict[str, int]] = [{}]
        self.score, self.pieces = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def _best(self, word: str, end: int, path) -> tuple[float, int]:
        """Best (score, -pieces) of word[:end] from those of its prefixes; path[i] gives prefix i's."""
        size = len(word[end - 1].encode("utf-8", "surrogatepass"))
        s, n = path[end - 1]
        best = (s + size * self.byte_score, n - size)
        for start in range(max(0, end - self.longest), end):
            piece = self.scores.get(word[start:end])
            if piece is not None:
                s, n = path[start]
                if (s + piece, n - 1) > best:
                    best = (s + piece, n - 1)
        return best

    def count(self, word: str) -> int:
        """Number of tokens of a pre-token."""
        known = self.terminal.get(word)
        if known is not None:
            return known
        if len(self.score) > MAX_NODES:
            self.__init__(self.scores, self.longest, self.byte_score)
        if len(word) > LONG:  # long junk would fill the trie with paths nobody shares
            path = [(0.0, 0)]
            for end in range(1, len(word) + 1):
                path.append(self._best(word, end, path))
            return -path[-1][1]
        node, path = 0, [(0.0, 0)]
        for end, letter in enumerate(word, 1):
            below = self.children[node].get(letter)
            if below is None:
                score, pieces = self._best(word, end, path)
                below = self.children[node][letter] = len(self.score)
                self.children.append({})
                self.score.append(score)
                self.pieces.append(pieces)
            node = below
            path.append((self.score[node], self.pieces[node]))
        self.terminal[word] = -self.pieces[node]
        return -self.pieces[node]


def count_tokens(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """The rows of ``docs`` without text, with n_pretokens, n_distinct_pretokens and n_tokens.

    Pre-tokens are the white-space separated words of the whole text (``str.split``),
    each behind a mark. A null or blank text has none. Columns of those names are replaced;
    repeated rows are counted alike.
    """
    added = ("n_pretokens", "n_distinct_pretokens", "n_tokens")
    rows = docs.drop(*added)
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, *[T.StructField(c, T.LongType()) for c in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(*load_scores(vocabulary_path))
        for batch in batches:
            columns: tuple[list[int], list[int], list[int]] = ([], [], [])
            for text in batch.column("text"):
                found = Counter((text.as_py() or "").split())
                columns[0].append(sum(found.values()))
                columns[1].append(len(found))
                columns[2].append(sum(n * trie.count(MARK + w) for w, n in found.items()))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], *[pa.array(c, pa.int64()) for c in columns]],
                                             names=[*[f.name for f in kept], *added])

    return rows.mapInArrow(run, schema)
