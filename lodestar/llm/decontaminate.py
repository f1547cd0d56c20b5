"""Benchmark passages in documents: one Aho-Corasick automaton over windows of the items' words."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import bound_batches, map_texts, per_process, pick, set_checkpoint_dir

#: A-Z become a-z; ASCII signs, white space and controls part words; all other bytes are of words.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: The same words in the original text.
WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010FFFF]+")
#: Bytes of text that wait for the automata of a benchmark of several.
WAITING = 32 << 20


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(NORMAL).split()


def line_of(text: str | None) -> tuple[int, str]:
    """The number of words, and the words with a space on either side of each."""
    words = words_of(text) if text else []
    return len(words), f" {b' '.join(words).decode()} "


class Hits:
    """What was found in one text: words inside windows, as changes at their edges, and items."""

    def __init__(self, words: list[int] | None = None, items: list[str] | None = None):
        self.edges: dict[int, int] = {}
        for w in words or []:
            self.add(w, w + 1)
        self.items: set[str] = set(items or [])

    def add(self, first: int, stop: int) -> None:
        self.edges[first] = self.edges.get(first, 0) + 1
        self.edges[stop] = self.edges.get(stop, 0) - 1

    def report(self, text: str | None, n: int) -> tuple[int, list[int], list[str], list[tuple[int, int]]]:
        """Number of words, indices of words inside a window, items, and (start, end) of the hit stretches in ``text``."""
        if not self.edges:
            return n, [], [], []
        edge = np.zeros(n + 1, dtype=np.int64)
        edge[list(self.edges)] = list(self.edges.values())
        hit = np.nonzero(np.cumsum(edge)[:-1])[0]
        bounds = [m.span() for m in WORD.finditer(text)]
        runs = np.split(hit, np.nonzero(np.diff(hit) > 1)[0] + 1)
        return n, hit.tolist(), sorted(self.items), [(bounds[r[0]][0], bounds[r[-1]][1]) for r in runs]


class Windows:
    """An automaton of the windows of (item, text) pairs; a window is ``size`` words, or all of a shorter item."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        found: dict[str, tuple[int, set[str]]] = {}
        for item, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - size + 1) if words else 0):
                window = words[i : i + size]
                found.setdefault(f" {b' '.join(window).decode()} ", (len(window), set()))[1].add(item)
        self.automaton = ahocorasick.Automaton()
        for window, value in found.items():
            self.automaton.add_word(window, value)
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def find(self, line: str, hits: Hits) -> None:
        """Add what occurs in ``line``, the words of a text, to ``hits``: the line is read once."""
        if self.empty:
            return
        matches = list(self.automaton.iter(line))
        if not matches:
            return
        spaces = np.nonzero(np.frombuffer(line.encode("utf-32-le"), dtype="<u4") == 32)[0]
        last = np.searchsorted(spaces, [end for end, _ in matches])
        for stop, (_, (size, of)) in zip(last.tolist(), matches, strict=True):
            hits.add(stop - size, stop)
            hits.items |= of

    def scan(self, text: str | None) -> tuple[int, list[int], list[str], list[tuple[int, int]]]:
        n, line = line_of(text)
        hits = Hits()
        if n:
            self.find(line, hits)
        return hits.report(text, n)


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_words", T.ArrayType(T.IntegerType())),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("hit_spans", T.ArrayType(SPAN))
]


def _arrays(rows: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
    spans = [[{"start": a, "end": b} for a, b in r[3]] for r in rows]
    return [*(pa.array([r[i] for r in rows], kinds[i]) for i in range(3)), pa.array(spans, kinds[3])]


def _scan_by_turns(parts, window: int, text_at: int, keep: list[int], before: list[int] | None, names: list[str], waiting: int):
    """Scan texts with one automaton after another: a few MB of text wait while each is built, used and let go.

    ``before`` are the columns of words and items that other automata have found.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            texts = [t for batch in held for t in batch.column(text_at).to_pylist()]
            lines = [line_of(t) for t in texts]
            seeds = [[x for batch in held for x in batch.column(i).to_pylist()] for i in before] if before else [[None] * len(texts)] * 2
            hits = [Hits(*seed) for seed in zip(*seeds, strict=True)]
            for part in parts:
                windows = Windows(part.value, window)
                for (n, line), found in zip(lines, hits, strict=True):
                    if n:
                        windows.find(line, found)
                del windows
            at = 0
            for batch in held:
                rows = [hits[i].report(texts[i], lines[i][0]) for i in range(at, at + batch.num_rows)]
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + _arrays(rows), names=names)

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > waiting:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return run


def find_benchmark(
    df: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    keep: list[str] | None = None,
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    automaton_chars: int = 4_000_000,
    group_bytes: int = 64 << 20,
    waiting: int = WAITING
) -> DataFrame:
    """Append what of the benchmark each whole text holds, without a shuffle of the texts.

    New columns: ``n_words``; ``hit_words``, indices of the words inside any occurrence of a window;
    ``items``, the ids (as strings, sorted) of items with an occurring window; ``hit_spans``, the hit
    stretches as code points (start, end exclusive) of the original text. A document word is hit
    inside ``window`` consecutive words of an item, or all words of a shorter one.

    The benchmark's size is measured first. Windows of up to ``automaton_chars`` characters make one
    automaton, which is built from a broadcast once a worker and scans a text once. A larger benchmark
    is split by item into automata that take turns: a task holds one of them and ``waiting`` bytes of
    text at a time. Beyond ``group_bytes`` of items, which is what is broadcast at a time, the texts
    are checkpointed between groups, so a benchmark of any size is searched whole.

    Null and wordless texts and items hit nothing, as do items of null id; repeated rows are scanned on
    their own, and rows of one item id are one item. An empty benchmark hits nothing, an empty table
    gives no rows. All columns (or ``keep``) go through, but for those of the new names.
    """
    spark = df.sparkSession
    items = pick(benchmark, item=item_col, text=item_text_col).where("item is not null and text is not null").select(
        F.col("item").cast("string").alias("item"), "text"
    )
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    count = max(1, -(-size * window // automaton_chars))
    groups = max(1, -(-size // group_bytes))
    part_of = F.pmod(F.xxhash64("item"), F.lit(count))

    def shared(k: int):
        return spark.sparkContext.broadcast([tuple(r) for r in items.where(part_of == k).collect()])

    if count == 1:
        part, key = shared(0), ("windows", uuid.uuid4().hex, window)

        def kernel():
            windows = per_process(key, lambda: Windows(part.value, window))
            return lambda texts: _arrays([windows.scan(t) for t in texts])

        return map_texts(df, text_col, FIELDS, kernel, keep)

    names = df.columns
    new = [f.name for f in FIELDS]
    through = [i for i, c in enumerate(names) if c not in new and (keep is None or c in keep)]
    text_at = names.index(text_col)
    flat = [f"x{i}" for i in sorted({*through, text_at})]
    found = df.toDF(*[f"x{i}" for i in range(len(names))]).select(*flat)
    out = T.StructType([*found.schema.fields, *FIELDS])
    bound_batches(spark)
    for g in range(groups):
        if g:
            set_checkpoint_dir(spark)
            found = found.select(*flat, "hit_words", "items").checkpoint()
        parts = [shared(k) for k in range(count) if k % groups == g]
        before = [len(flat), len(flat) + 1] if g else None
        found = found.mapInArrow(
            _scan_by_turns(parts, window, flat.index(f"x{text_at}"), list(range(len(flat))), before, out.names, waiting), out
        )
    return found.select(*[f"x{i}" for i in through], *new).toDF(*[names[i] for i in through], *new)


def contaminated(n_hit, n_words):
    """The contract's rule: some word is hit, and at least a twentieth of all are."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` without its contaminated rows, all columns kept, whatever their names.

    Rows are judged on their own, repeated or not; null and wordless texts stay, as all rows do if the
    benchmark is empty. An empty table gives no rows.
    """
    names = df.columns
    flat = df.toDF(*[f"x{i}" for i in range(len(names))])
    found = find_benchmark(flat, benchmark, f"x{names.index(text_col)}")
    return found.where(~contaminated(F.size("hit_words").cast("long"), F.col("n_words"))).select(*flat.columns).toDF(*names)
