"""A trie of vocabulary pieces, walked along a trie of distinct words, level by level in numpy."""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np


def tiktoken_pieces(data: bytes) -> list[bytes]:
    """The pieces of a .tiktoken file, by rank."""
    ranked = sorted((int(rank), base64.b64decode(piece)) for piece, rank in map(bytes.split, data.splitlines()))
    return [piece for _, piece in ranked]


def bands(words: list[bytes], rows: int, first: int = 48, last: int = 1536) -> Iterator[list[int]]:
    """Indices of the words of up to ``last`` bytes, in sorted lists of at most ``rows``, to be tries of their own.

    The lengths in a list end at ``first`` or at a doubling of it, so that a trie's table of letters
    holds less than twice the bytes of its words, but for the shortest ones.
    """
    limits = [first]
    while limits[-1] < last:
        limits.append(min(2 * limits[-1], last))
    held: list[list[int]] = [[] for _ in limits]
    for i in sorted(range(len(words)), key=words.__getitem__):
        if len(words[i]) <= last:
            held[bisect_left(limits, len(words[i]))].append(i)
    for limit, band in zip(limits, held, strict=True):
        step = max(1, rows * first // limit)
        yield from (band[a : a + step] for a in range(0, len(band), step))


class PieceTrie:
    """Transitions over bytes. State 0 is the root, -1 is dead; ``piece_of[state]`` is a piece's index or -1."""

    def __init__(self, pieces: list[bytes]):
        children: list[dict[int, int]] = [{}]
        piece_at: dict[int, int] = {}
        for k, piece in enumerate(pieces):
            state = 0
            for byte in piece:
                after = children[state].get(byte)
                if after is None:
                    after = children[state][byte] = len(children)
                    children.append({})
                state = after
            piece_at.setdefault(state, k)
        n = len(children)
        inner = [s for s in range(n) if children[s]]
        #: Bytes of the longest piece.
        self.longest = max(map(len, pieces), default=0)
        self.piece_of = np.full(n + 1, -1, dtype=np.int32)
        self.piece_of[list(piece_at)] = list(piece_at.values())
        # only states with children have a row of the table; the last row is dead, for leaves and -1
        self._row = np.full(n + 1, len(inner), dtype=np.int32)
        self._row[inner] = np.arange(len(inner))
        self._table = np.full((len(inner) + 1, 256), -1, dtype=np.int32)
        for r, s in enumerate(inner):
            self._table[r, list(children[s])] = list(children[s].values())

    def step(self, states: np.ndarray, byte: np.ndarray) -> np.ndarray:
        return self._table[self._row[states], byte]

    def pieces_ending(self, word: bytes) -> Iterator[list[tuple[int, int]]]:
        """For each end in ``word``: (length, piece) of the pieces that end there, shortest first."""
        live: list[tuple[int, int]] = []
        for i, byte in enumerate(word):
            live = [(start, s) for start, state in [(i, 0), *live] if (s := int(self._table[self._row[state], byte])) >= 0]
            yield [(i + 1 - start, int(self.piece_of[s])) for start, s in live if self.piece_of[s] >= 0]

    def walk(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Insert sorted, distinct, non-empty words in a trie and visit its levels, each prefix once.

        Yields for depth 1, 2, ...: the parent of each node, the piece of the last 1, 2, ... bytes
        of each node's prefix (-1: none), the words that end at this depth, and their nodes.
        """
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        width = int(lengths.max(initial=0))
        letters = np.array(words, dtype=f"S{max(width, 1)}").view(np.uint8).reshape(len(words), -1)
        shared = np.zeros(len(words), dtype=np.int64)
        if len(words) > 1:
            same = letters[1:] == letters[:-1]
            shared[1:] = np.minimum(np.where(same.all(axis=1), width, same.argmin(axis=1)), np.minimum(lengths[1:], lengths[:-1]))
        node, states = np.zeros(len(words), dtype=np.int64), np.zeros((1, 0), dtype=np.int32)
        for depth in range(1, width + 1):
            new = (lengths >= depth) & (shared < depth)
            rows = np.nonzero(new)[0]
            parent, byte = node[rows], letters[rows, depth - 1]
            node = np.cumsum(new) - 1
            before = np.concatenate([np.zeros((len(rows), 1), dtype=np.int32), states[parent]], axis=1)
            states = self.step(before, byte[:, None])
            alive = (states >= 0).any(axis=0)
            states = states[:, : int(np.nonzero(alive)[0].max(initial=-1)) + 1]
            ends = np.nonzero(lengths == depth)[0]
            yield parent, self.piece_of[states], ends, node[ends]
