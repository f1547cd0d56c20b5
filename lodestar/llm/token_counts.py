"""Token counts of whole texts under a unigram model, by dynamic programming along a trie."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestar.llm.common import SharedFile, map_texts, per_process
from lodestar.llm.trie import PieceTrie, bands, tiktoken_pieces

#: A word with the space before it, a run of other signs, or a run of white space.
PRETOKEN = re.compile(r" ?\w+| ?[^\w\s]+|\s+")
#: Pre-tokens in a trie at most.
TRIE_WORDS = 1 << 15


class UnigramCounter:
    """Tokens of the best segmentation of a pre-token; of equally good ones, the fewest.

    The score of the piece of rank r is that of Zipf's law, -log(r + offset). Bytes that the
    vocabulary lacks are added after its last rank.
    """

    def __init__(self, pieces: list[bytes], offset: float = 100.0):
        have = set(pieces)
        pieces = pieces + [bytes([b]) for b in range(256) if bytes([b]) not in have]
        self.trie = PieceTrie(pieces)
        self.score = np.append(-np.log(np.arange(len(pieces)) + offset), -np.inf)

    def count_long(self, word: bytes) -> int:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end, pieces in enumerate(self.trie.pieces_ending(word), 1):
            best.append(max((best[end - n][0] + self.score[p], best[end - n][1] - 1) for n, p in pieces))
        return -best[-1][1]

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Token counts of sorted, distinct, non-empty words; scores are computed once for a shared prefix."""
        out = np.zeros(len(words), dtype=np.int64)
        best, tokens = np.zeros((1, 1)), np.zeros((1, 1), dtype=np.int64)
        for parent, pieces, ends, nodes in self.trie.walk(words):
            w = pieces.shape[1]
            before, used = best[parent], tokens[parent]
            through = before[:, :w] + self.score[pieces]
            top = through.max(axis=1)
            fewest = np.where(through == top[:, None], used[:, :w] + 1, np.iinfo(np.int64).max).min(axis=1)
            best = np.concatenate([top[:, None], before[:, :w]], axis=1)
            tokens = np.concatenate([fewest[:, None], used[:, :w]], axis=1)
            out[ends] = fewest[nodes]
        return out

    def __call__(self, texts: list) -> list[pa.Array]:
        found = [PRETOKEN.findall(t) if t else [] for t in texts]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        codes, distinct = pd.factorize(np.array([w for f in found for w in f], dtype=object))
        words = [w.encode() for w in distinct]
        of = np.full(len(words), -1, dtype=np.int64)
        for band in bands(words, TRIE_WORDS):
            of[band] = self.counts([words[i] for i in band])
        for k in np.nonzero(of < 0)[0].tolist():  # over 1,536 bytes: a path that shares nothing
            of[k] = self.count_long(words[k])
        sums = np.concatenate([[0], np.cumsum(of[codes])])
        ends = np.cumsum(sizes)
        return [pa.array(sizes), pa.array(sums[ends] - sums[ends - sizes])]


def token_counts(df: DataFrame, vocabulary: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``n_pretokens`` and ``n_tokens`` (longs) for each whole text.

    ``vocabulary`` is the path of a .tiktoken file of at most 64 MB, read by the driver. One pass, no
    shuffle; the distinct pre-tokens of a few MB of text form tries at a time, of words of like length.
    A null or empty text has none of either; rows, repeated or not, are counted on their own; an empty
    table gives no rows; all columns (or ``keep``) go through, but for those of the new names, which
    are replaced.
    """
    file = SharedFile(df.sparkSession, vocabulary)

    def kernel():
        return per_process(("token_counts", file.key), lambda: UnigramCounter(tiktoken_pieces(file.data)))

    fields = [T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())]
    return map_texts(df, text_col, fields, kernel, keep)
