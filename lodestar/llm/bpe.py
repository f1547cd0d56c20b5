"""Byte-level BPE encoding and decoding by the merge ranks of a vocabulary file."""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestar.llm.common import SharedFile, map_texts, per_process

#: Words, numbers, signs and white space, as the byte-level pre-tokenizer parts them.
SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary strings: itself if it is printable Latin-1, else the next from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(rest)}


# The settings of a vocabulary file under which ``BytePairCodec`` gives the ids of the tokenizers library.
EXPECTED = {
    "normalizer": None,
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},
    "decoder": {"type": "ByteLevel"},
    "model": {
        "type": "BPE",
        "dropout": None,
        "unk_token": None,
        "continuing_subword_prefix": None,
        "end_of_word_suffix": None,
        "fuse_unk": False,
        "byte_fallback": False,
        "ignore_merges": False
    },
}


def check_settings(spec: dict) -> None:
    """Raise ValueError for a vocabulary file whose settings ask for other ids than ``BytePairCodec`` gives."""
    for part, want in EXPECTED.items():
        have = spec.get(part)
        other = (have or None) != want if want is None else [k for k, v in want.items() if ((have or {}).get(k) or None) != (v or None)]
        if other:
            raise ValueError(f"unsupported {part}: {have if want is None else {k: (have or {}).get(k) for k in other}}")
    if any(t.get(flag) for t in spec.get("added_tokens", []) for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("unsupported added token: it strips or stands for whole words only")


class BytePairCodec:
    """Encodes by the ranks of merges; ids of a pre-token are kept, in ``cache_entries`` entries at most.

    ``data`` is a tokenizers JSON file of byte-level BPE without a normalizer or a prefix space, split by
    the standard pattern; ``check_settings`` refuses others. Added tokens are matched as plain strings.
    """

    def __init__(self, data: bytes, cache_entries: int = 400_000, cached_chars: int = 64):
        spec = json.loads(data)
        check_settings(spec)
        model, letters = spec["model"], byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab: dict[str, int] = model["vocab"]
        self.strings: list[bytes] = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for s, k in vocab.items():
            self.strings[k] = raw(s)
        self.of_byte = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s, k in self.special.items():
            self.strings[k] = s.encode()
        self.parts = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.cache: dict[str, bytes] = {}
        self.cache_entries, self.cached_chars = cache_entries, cached_chars

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token: the pair of least rank, leftmost first, is merged until none is left.

        Symbols are a doubly linked list; a queue entry is stale, and skipped, if a symbol of its pair
        has been merged since.
        """
        symbol = [self.of_byte[b] for b in word]
        n = len(symbol)
        if n < 2:
            return symbol
        merges = self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            found = merges.get((symbol[i], symbol[i + 1]))
            if found:
                queue.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, joined = heapq.heappop(queue)
            j = after[i]
            if symbol[i] != left or j == n or symbol[j] != right:
                continue
            symbol[i], symbol[j] = joined, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = merges.get((joined, symbol[k]))
                if found:
                    heapq.heappush(queue, (found[0], i, joined, symbol[k], found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get((symbol[h], joined))
                if found:
                    heapq.heappush(queue, (found[0], h, symbol[h], joined, found[1]))
        return [s for s in symbol if s >= 0]

    def _word(self, word: str) -> bytes:
        packed = np.array(self.merge(word.encode()), dtype="<u4").tobytes()
        if len(word) <= self.cached_chars:
            if len(self.cache) >= self.cache_entries:
                self.cache.clear()
            self.cache[word] = packed
        return packed

    def _ordinary(self, text: str) -> list[bytes]:
        get, word = self.cache.get, self._word
        return [get(w) or word(w) for w in SPLIT.findall(text)]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; strings of special tokens are their ids."""
        if not self.parts:
            return b"".join(self._ordinary(text))
        out, at = [], 0
        for m in self.parts.finditer(text):
            out += [*self._ordinary(text[at : m.start()]), np.array([self.special[m[0]]], dtype="<u4").tobytes()]
            at = m.end()
        return b"".join(out + self._ordinary(text[at:] if at else text))

    def decode(self, packed: bytes) -> str:
        """Concatenated vocabulary strings, as UTF-8; bytes that are none become U+FFFD."""
        strings = self.strings
        return b"".join([strings[k] for k in np.frombuffer(packed, dtype="<u4").tolist()]).decode("utf-8", "replace")


def _codec(df: DataFrame, vocabulary: str):
    file = SharedFile(df.sparkSession, vocabulary)
    return lambda: per_process(("bpe", file.key), lambda: BytePairCodec(file.data))


def encode_texts(df: DataFrame, vocabulary: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``ids`` (binary: little-endian unsigned 32-bit integers) of each whole text.

    ``vocabulary`` is the path of a tokenizers JSON file of byte-level BPE, at most 64 MB, read by the
    driver. One pass, no shuffle. A null or empty text has no ids; repeated rows are encoded alike; an
    empty table gives no rows; all columns (or ``keep``) go through, but for one of the new name.
    """
    make = _codec(df, vocabulary)

    def kernel():
        codec = make()
        return lambda texts: [pa.array([codec.encode(t or "") for t in texts], type=pa.binary())]

    return map_texts(df, text_col, [T.StructField("ids", T.BinaryType())], kernel, keep)


def round_trip(df: DataFrame, vocabulary: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``encode_texts``, and ``decoded``: the text that the ids give back (empty for none)."""
    make = _codec(df, vocabulary)

    def kernel():
        codec = make()

        def f(texts: list) -> list[pa.Array]:
            ids = [codec.encode(t or "") for t in texts]
            return [pa.array(ids, type=pa.binary()), pa.array([codec.decode(i) for i in ids], type=pa.string())]

        return f

    return map_texts(df, text_col, [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())], kernel, keep)
