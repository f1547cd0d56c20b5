"""Secrets in whole texts: fixed patterns, and random strings by their characters per token."""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestar.llm.common import SharedFile, map_texts, per_process
from lodestar.llm.trie import tiktoken_pieces

# Fixed values of the contract: kinds in order, their patterns, and the least length of what a match must show.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

#: Strings that the token-efficiency test looks at: runs of key characters.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
# Digests (MD5, SHA-1, SHA-2) and UUIDs.
KNOWN = (
    re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})"),
    re.compile(r"(?:sha(?:1|224|256|384|512)|md5)[-_=/][0-9A-Za-z+/=]+"),
    re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
)
# Words or numbers joined by signs (dates, versions, slugs, paths), and what the signs join.
JOINED, PIECE = re.compile(r"[+/_=-]*(?:(?:[A-Za-z]+|[0-9]+)(?:[+/_=-]+|$))*"), re.compile("[A-Za-z]+|[0-9]+")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_WORDS = (b"passw", b"secret", b"token", b"api")
_AS_X = bytes.maketrans(b"0123456789abcdef", b"x" * 16)
_RUNS = bytes(ord("x") if chr(b).isalnum() and b < 128 or b in b"+/_=-" else 0 for b in range(256))


class SecretScanner:
    """``spans(text)`` gives (start, end, kind) in code points, end exclusive, by start then kind.

    The pattern kinds are as the contract has them, and stay. ``random`` adds candidates of fewer
    than ``ratio`` characters per token, if none of ``KNOWN`` matches them and no pattern span overlaps;
    words and numbers joined by signs only if one of them is no efficient piece by itself.
    """

    def __init__(self, pieces: list[bytes], ratio: float = 2.0):
        self.ratio = ratio
        self.encoding = tiktoken.Encoding("scan", pat_str=PATTERN, mergeable_ranks={p: k for k, p in enumerate(pieces)}, special_tokens={})

    def base(self, text: str, raw: bytes) -> list[tuple[int, int, int]]:
        spans = []
        low = raw.lower()
        if any(w in low for w in _WORDS):  # every keyword has one of these
            spans += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        if b"AKIA" in raw:
            spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
        if b"x" * HEX_LEAST in raw.translate(_AS_X):
            spans += [(m.start(), m.end(), 2) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
        return spans

    def is_random(self, string: str) -> bool:
        if any(k.fullmatch(string) for k in KNOWN) or not self.is_dense(string):
            return False
        return not (JOINED.fullmatch(string) and all(map(self.is_plain, PIECE.findall(string))))

    def is_dense(self, string: str) -> bool:
        return len(string) < self.ratio * len(self.encoding.encode_ordinary(string))

    def is_plain(self, piece: str) -> bool:
        """A number of under 20 digits (random digits are as efficient as dates), a single token, or an efficient string."""
        return piece.isdigit() and len(piece) < 20 or not self.is_dense(piece) or len(self.encoding.encode_ordinary(piece)) == 1

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        if not text:
            return []
        raw = text.encode()
        spans = self.base(text, raw)
        if b"x" * 20 in raw.translate(_RUNS):
            taken = disjoint(spans)
            ends = [e for _, e in taken]
            for m in CANDIDATE.finditer(text):
                near = bisect_right(ends, m.start())  # the first stretch that ends after the candidate's start
                if (near == len(taken) or taken[near][0] >= m.end()) and self.is_random(m[0]):
                    spans.append((m.start(), m.end(), 3))
        return sorted(spans, key=lambda s: (s[0], s[2]))


def disjoint(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The stretches (start, end) that spans cover, in order; those that overlap are one."""
    out: list[tuple[int, int]] = []
    for start, end, _ in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each stretch that spans cover replaced by ``[SECRET]``."""
    out, at = [], 0
    for start, end in disjoint(spans):
        out += [text[at:start], "[SECRET]"]
        at = end
    return "".join([*out, text[at:]])


def _scanner(spark, vocabulary: str, ratio: float):
    file = SharedFile(spark, vocabulary)
    return lambda: per_process(("secret_scan", file.key, ratio), lambda: SecretScanner(tiktoken_pieces(file.data), ratio))


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def scan_secrets(df: DataFrame, vocabulary: str, text_col: str = "text", keep: list[str] | None = None, ratio: float = 2.0) -> DataFrame:
    """Append ``secret_spans``, an array of (kind, start, end) by start then kind, for each whole text.

    Offsets are code points, end exclusive; the kinds are ``assign``, ``access``, ``hex`` and
    ``random``. ``vocabulary`` is the path of a .tiktoken file of at most 64 MB, read by the driver.
    One pass, no shuffle; time grows with the text and its spans. A null or empty text has no spans;
    rows, repeated or not, are scanned on their own; an empty table gives no rows; all columns (or
    ``keep``) go through, but for one of the new name.
    """
    make = _scanner(df.sparkSession, vocabulary, ratio)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def kernel():
        scanner = make()
        return lambda texts: [
            pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in scanner.spans(t)] for t in texts], type=pa.list_(kind))
        ]

    return map_texts(df, text_col, [T.StructField("secret_spans", T.ArrayType(SPAN))], kernel, keep)


def redact_secrets(df: DataFrame, vocabulary: str, text_col: str = "text", ratio: float = 2.0) -> DataFrame:
    """``df`` with ``[SECRET]`` in place of every stretch that spans of ``scan_secrets`` cover.

    Spans that overlap are one stretch. Null texts stay null, texts without spans as they are;
    rows, repeated or not, are taken on their own; an empty table gives no rows. All columns stay, in
    their order, whatever their names.
    """
    make = _scanner(df.sparkSession, vocabulary, ratio)

    def kernel():
        scanner = make()

        def f(texts: list) -> list[pa.Array]:
            found = [scanner.spans(t) for t in texts]
            return [pa.array([redact(t, s) if s else t for t, s in zip(texts, found, strict=True)], type=pa.string())]

        return f

    names = df.columns
    flat, text = df.toDF(*[f"x{i}" for i in range(len(names))]), f"x{names.index(text_col)}"
    return map_texts(flat, text, [T.StructField(text, T.StringType())], kernel).select(*flat.columns).toDF(*names)
