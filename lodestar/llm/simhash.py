"""SimHash fingerprints of whole texts, linked by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import map_texts, pick, set_checkpoint_dir
from lodestar.llm.tiles import tiled
from lodestar.operators.graph import connected_components, drop_checkpoint, union_labels

#: Hashes whose 64 bits are spread out at a time, which takes 64 times as many bytes.
SPREAD = 1 << 18
#: Hashes of a sketch, and what stands for one that is missing.
SKETCH, MISSING = 128, np.uint64(1 << 32)
#: Rows of a broadcast list of buckets at most.
FEW = 1 << 20
#: What tells tiles apart.
TILE = ["key", "ti", "tj"]
#: Pairs that a task compares at a time.
PAIRS = 1 << 20


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()  # bytes: only ASCII letters change, only ASCII white space parts words


def hashes_of(words: list[bytes], shingle: int, seed: int) -> list[int]:
    """XXH64 of the space-joined runs of ``shingle`` words; of all words if there are fewer."""
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = [0, *ends[:-shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]


def sketch_of(words: list[bytes], shingle: int, seed: int) -> bytes:
    """The least SKETCH of the 32-bit hashes of the shingles, in order: the whole set of a text that has no more."""
    least = np.unique(np.array(hashes_of(words, shingle, seed), dtype=np.uint64).astype(np.uint32))
    return least[:SKETCH].astype("<u4").tobytes()


class Sketches:
    """Sketches of many texts, to be compared with one another."""

    def __init__(self, packed: list[bytes]):
        self.rows = np.full((len(packed), SKETCH), MISSING, dtype=np.uint64)
        for row, raw in enumerate(packed):
            self.rows[row, : len(raw) // 4] = np.frombuffer(raw, "<u4")
        distinct, codes = np.unique(self.rows, return_inverse=True)
        self.codes = codes.reshape(self.rows.shape)
        self.mark = np.zeros(len(distinct), dtype=bool)
        last = self.rows[:, -1] if len(packed) else np.zeros(0, dtype=np.uint64)
        self.top = np.where(last < MISSING, last, MISSING - np.uint64(1))

    def similarity(self, i: int, others: np.ndarray) -> np.ndarray:
        """Jaccard similarity of text i's shingles with those of others; 1 if both have none.

        Up to the lesser of two full sketches' greatest hashes both hold all of their texts' hashes: the
        similarity is that of these, an estimate (standard error 0.035 at 0.8) or, of short texts, exact.
        """
        until = np.minimum(self.top[i], self.top[others])
        within = self.rows[others] <= until[:, None]
        self.mark[self.codes[i]] = True
        common = (self.mark[self.codes[others]] & within).sum(axis=1)
        self.mark[self.codes[i]] = False
        union = np.searchsorted(self.rows[i], until, "right") + within.sum(axis=1) - common
        return np.where(union == 0, 1.0, common / np.maximum(union, 1))


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A fingerprint (uint64) for each run of ``sizes`` hashes: bit k is 1 if set in over half of them."""
    ones = np.zeros((len(sizes), 64), dtype=np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for a in range(0, len(hashes), SPREAD):
        part, own = hashes[a : a + SPREAD], owner[a : a + SPREAD]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        first = np.nonzero(np.append(True, own[1:] != own[:-1]))[0]
        ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > sizes[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(
    df: DataFrame, text_col: str = "text", shingle: int = 3, seed: int = 42, keep: list[str] | None = None, sketch: int = 0
) -> DataFrame:
    """Append ``fingerprint`` (long, the 64 bits as signed) of each whole text; 0 for a text of no words or null.

    With ``sketch``, a number of words, also ``sketch``: the least hashes of the shingles of as many words.
    """

    def kernel():
        def f(texts: list) -> list[pa.Array]:
            words = [words_of(t) if t else [] for t in texts]
            found = [hashes_of(w, shingle, seed) for w in words]
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            hashes = np.fromiter((h for one in found for h in one), dtype=np.uint64, count=int(sizes.sum()))
            made = [pa.array(majority_bits(hashes, sizes).view(np.int64))]
            return [*made, pa.array([sketch_of(w, sketch, seed) for w in words], pa.binary())] if sketch else made

        return f

    fields = [T.StructField("fingerprint", T.LongType())] + ([T.StructField("sketch", T.BinaryType())] if sketch else [])
    return map_texts(df, text_col, fields, kernel, keep)


def segments(bits: int) -> tuple[int, int, bool]:
    """Segments, bits of each, and whether their balls are whole, such that fingerprints at ``bits`` differing bits meet.

    Two fingerprints agree in one of the segments up to one bit, found by half a ball of radius 1 around
    either, or, beyond 7 bits, up to two, found as whole balls of radius 1 around both have a value in common.
    """
    if not 0 <= bits <= 11:
        raise ValueError("balls of radius 1 find 0 to 11 differing bits")
    return (2, 32, False) if bits <= 3 else (4, 16, bits > 7)


def _entries(nodes: DataFrame, bits: int) -> DataFrame:
    """Rows (key, node, fp, own): each segment of a fingerprint, and what is made from it by changing one of its bits.

    In half a ball only bits of 0 are set: of two values one bit apart, one has that bit 0, so all pairs
    are found, once. ``key`` holds the number of the segment and a value of it; ``own`` marks the segment
    itself, or all entries of whole balls.
    """
    count, width, whole = segments(bits)
    entries = []
    for s in range(count):
        value = F.shiftrightunsigned("fp", s * width).bitwiseAND(F.lit((1 << width) - 1))
        entry = lambda v, own, s=s: F.struct(v.bitwiseOR(F.lit(s << 32)).alias("key"), F.lit(own).alias("own"))
        entries.append(entry(value, 1))
        for k in range(width):
            bit = F.lit(1 << k)
            entries.append(entry(value.bitwiseXOR(bit), 1) if whole else F.when(value.bitwiseAND(bit) == 0, entry(value.bitwiseOR(bit), 0)))
    return nodes.select("node", "fp", F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.key", "node", "fp", "e.own")


def _tiles(entries: DataFrame, sizes: DataFrame, tile_rows: int) -> DataFrame:
    """Entries (key, ti, tj, node, fp) of the buckets of ``sizes (key, n)``, dealt into tiles."""
    sizes = F.broadcast(sizes) if sizes.count() <= FEW else sizes
    bucket = entries.join(sizes, "key").select("key", "node", "fp", F.ceil(F.col("n") / tile_rows).alias("size"))
    return tiled(bucket, ["key"], "node", F.col("size")).select(*TILE, "node", "fp")


def _by_tile(kernel):
    """Run ``kernel(table, tile numbers)`` on batches that are sorted by tile, whole tiles at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            keys = _tile_number(t)
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last tile may go on
            if cut:
                yield from kernel(t.slice(0, cut), keys[:cut])
            held = t.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield from kernel(held, _tile_number(held))

    return run


def _tile_number(t: pa.Table) -> np.ndarray:
    cols = [t.column(c).to_numpy() for c in TILE]
    new = np.zeros(t.num_rows, dtype=bool)
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _forest(t: pa.Table, tile: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    fp, node = t.column("fp").to_numpy().view(np.uint64), t.column("node").to_numpy()
    order = np.lexsort((node, tile))
    fp, node, tile = fp[order], node[order], tile[order]
    label = np.arange(len(fp))
    starts = np.nonzero(np.append(True, tile[1:] != tile[:-1]))[0]
    sizes = np.diff(np.append(starts, len(fp)))
    small = 64
    in_small = np.repeat(sizes <= small, sizes)
    rows = np.nonzero(in_small)[0]
    for k in range(1, min(small, int(sizes[sizes <= small].max(initial=0)))):
        i = rows[: len(rows) - k]
        j = rows[k:]
        near = (tile[i] == tile[j]) & (np.bitwise_count(fp[i] ^ fp[j]) <= bits)
        label = union_labels(label, i[near], j[near])
    for a, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        step = max(1, PAIRS // n)
        for b in range(a, a + n, step):
            i, j = np.nonzero(np.bitwise_count(fp[b : min(b + step, a + n), None] ^ fp[None, a : a + n]) <= bits)
            label = union_labels(label, i + b, j + a)
    child = np.nonzero(node[label] != node)[0]
    if len(child):
        yield pa.RecordBatch.from_arrays([pa.array(node[child]), pa.array(node[label[child]])], names=["a", "b"])


def simhash_links(nodes: DataFrame, bits: int = 3, tile_rows: int = 4096) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the nodes of ``nodes (node, fp)`` at ``bits`` (up to 11) differing bits or chains of such.

    Multi-index hashing: up to 3 bits, two fingerprints agree up to one bit in a 32-bit half; up to 7, in
    a 16-bit quarter; up to 11, in a quarter up to two bits. Each fingerprint is entered under its
    segments and under Hamming balls of radius 1 around each. A bucket that only one fingerprint entered,
    or none under its own segment, is dropped as it is counted; of two, the distance is verified at once.
    What remains, the buckets of three and more, is dealt into tiles of bounded size that verify
    distances in full and give back a spanning forest of the links, so a segment that many share costs
    rows in proportion to them, not their pairs. ``fp`` must be distinct.

    A fingerprint makes 34 entries (36 beyond 3 bits, 68 beyond 7), which are shuffled once while buckets
    are few against fingerprints, as 2^32 are against millions. From some 10^10 fingerprints, or 10^5 of
    16-bit segments, most buckets hold several, all entries are shuffled a second time, and the
    comparisons in a bucket grow with the square of its rows, as they do for any table of such keys.
    """
    set_checkpoint_dir(nodes.sparkSession)
    entries = _entries(nodes, bits)
    each = entries.groupBy("key").agg(
        F.count("*").alias("n"),
        F.max("own").alias("own"),
        F.min("node").alias("a"),
        F.max("node").alias("b"),
        F.bit_xor("fp").alias("differ")
    )
    met = each.where("n > 1 and own = 1").select("key", "n", "a", "b", "differ").checkpoint()
    pairs = met.where((F.col("n") == 2) & (F.bit_count("differ") <= bits)).select("a", "b")
    tiles = _tiles(entries, met.where("n > 2").select("key", "n"), tile_rows)
    dense = tiles.repartition(*TILE).sortWithinPartitions(*TILE).mapInArrow(
        _by_tile(lambda t, tile: _forest(t, tile, bits)), "a long, b long"
    )
    found = pairs.union(dense).distinct().checkpoint()
    drop_checkpoint(met)
    return found


def _first_meeting(a: np.ndarray, b: np.ndarray, key: int, width: int) -> np.ndarray:
    """Whether ``key`` is the one, of all that the balls around fingerprints a and b have in common, where the pair is looked at."""
    s, value = key >> 32, np.uint64(key & 0xFFFFFFFF)
    mask = np.uint64((1 << width) - 1)
    apart = a ^ b
    lower = np.zeros(len(a), dtype=bool)
    for k in range(s):
        lower |= np.bitwise_count((apart >> np.uint64(k * width)) & mask) <= 2
    here, mine = (apart >> np.uint64(s * width)) & mask, (a >> np.uint64(s * width)) & mask
    bit = here & (~here + np.uint64(1))  # the lowest that differs
    first = np.where(here == bit, np.minimum(mine, mine ^ here), np.minimum(mine ^ bit, mine ^ here ^ bit))
    return ~lower & (first == value)


def _near_rows(fp: np.ndarray, key: int, bits: int, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, those j > i) of a tile whose fingerprints differ in ``bits`` bits at most, and that are looked at here."""
    step = max(1, PAIRS // len(fp))
    for a in range(0, len(fp), step):
        near = np.bitwise_count(fp[a : a + step, None] ^ fp[None, :]) <= bits
        i, j = np.nonzero(near)
        i += a
        i, j = i[i < j], j[i < j]
        first = _first_meeting(fp[i], fp[j], key, width)
        i, j = i[first], j[first]
        for row in np.unique(i).tolist():
            yield row, j[slice(*np.searchsorted(i, [row, row + 1]))]


def _tile_slices(t: pa.Table, tile: np.ndarray) -> Iterator[pa.Table]:
    starts = np.nonzero(np.append(True, tile[1:] != tile[:-1]))[0].tolist()
    for a, b in zip(starts, [*starts[1:], t.num_rows], strict=True):
        if b - a > 1:
            yield t.slice(a, b - a).combine_chunks()


def _may_be_similar(bits: int):
    """The rows of a tile that are near another: at most all of them, never pairs."""
    width = segments(bits)[1]

    def kernel(t: pa.Table, tile: np.ndarray) -> Iterator[pa.RecordBatch]:
        for one in _tile_slices(t, tile):
            some = np.zeros(one.num_rows, dtype=bool)
            for i, j in _near_rows(one.column("fp").to_numpy().view(np.uint64), one.column("key")[0].as_py(), bits, width):
                some[i] = True
                some[j] = True
            if some.any():
                yield from one.filter(pa.array(some)).to_batches()

    return _by_tile(kernel)


def _similar(bits: int, least: float):
    """A spanning forest of the links of a tile: near fingerprints, and similar sketches."""
    width = segments(bits)[1]

    def kernel(t: pa.Table, tile: np.ndarray) -> Iterator[pa.RecordBatch]:
        for one in _tile_slices(t, tile):
            one = one.sort_by("node")
            fp, node = one.column("fp").to_numpy().view(np.uint64), one.column("node").to_numpy()
            sketches = Sketches(one.column("sketch").to_pylist())
            label = np.arange(len(fp))
            for i, j in _near_rows(fp, one.column("key")[0].as_py(), bits, width):
                j = j[label[j] != label[i]]
                j = j[sketches.similarity(i, j) >= least]
                label = union_labels(label, np.full(len(j), i), j)
            child = np.nonzero(label != np.arange(len(fp)))[0]
            yield pa.RecordBatch.from_arrays([pa.array(node[child]), pa.array(node[label[child]])], names=["a", "b"])

    return _by_tile(kernel)


def similar_links(nodes: DataFrame, bits: int = 11, least: float = 0.8, tile_rows: int = 4096) -> DataFrame:
    """Edges ``(a, b)`` that connect the nodes of ``nodes (node, fp, sketch)`` at ``bits`` (8 to 11) differing bits and a similarity of ``least``.

    The tables of ``simhash_links`` for 8 to 11 bits find the pairs; so many bits are not enough to link by,
    as among many millions of texts some differ in as few by chance. Tiles first give back the rows that
    are near another, never pairs; these come again with their sketches, and a link needs similar ones.
    A pair is compared in one of the buckets where it meets. Buckets are those of 16-bit segments, so the
    comparisons grow with the square of the nodes (some 100 CPU seconds a GB at 15 million nodes).
    """
    if not 8 <= bits <= 11:
        raise ValueError("similar_links takes 8 to 11 bits")
    set_checkpoint_dir(nodes.sparkSession)
    entries = _entries(nodes.select("node", "fp"), bits)
    sizes = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").checkpoint()
    tiles = _tiles(entries, sizes, tile_rows).repartition(*TILE).sortWithinPartitions(*TILE)
    rows = tiles.mapInArrow(_may_be_similar(bits), "key long, ti int, tj int, node long, fp long")
    whole = rows.join(nodes.select("node", "sketch"), "node").select(*TILE, "node", "fp", "sketch")
    found = whole.repartition(*TILE).sortWithinPartitions(*TILE).mapInArrow(_similar(bits, least), "a long, b long").distinct().checkpoint()
    drop_checkpoint(sizes)
    return found


def simhash_near_duplicates(
    df: DataFrame, bits: int = 3, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Fingerprint and near-duplicate component of each row of ``df``.

    Returns the id, ``fingerprint`` (16 lowercase hex digits) and ``component_id``, the smallest id
    reachable by links of at most ``bits`` differing bits. Rows of one fingerprint are one node.
    A null, empty or blank text has the fingerprint zero and is linked like any other. A row of null
    id links with nothing and has component null. Repeated rows share a node. Empty tables give no
    rows; other columns are ignored. Ids are integers.
    """
    set_checkpoint_dir(df.sparkSession)
    docs = fingerprints(pick(df, id=id_col, text=text_col), shingle=shingle, seed=seed, keep=["id"])
    docs = docs.select(F.col("id").cast("long").alias("id"), F.col("fingerprint").alias("fp")).checkpoint()
    nodes = docs.where("id is not null").groupBy("fp").agg(F.min("id").alias("node")).checkpoint()
    components = connected_components(simhash_links(nodes, bits))
    of_fp = nodes.join(components, "node", "left").select(F.col("fp").alias("own"), F.coalesce("component", "node").alias("component"))
    out = docs.join(of_fp, F.col("fp") == F.col("own"), "left")
    return out.select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id")
    )


def keep_one_of_each(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits: int = 11,
    similar: float = 0.8,
    words: int = 5,
    shingle: int = 3,
    seed: int = 42
) -> DataFrame:
    """One row of each near-duplicate component of ``df``, all columns kept, whatever their names.

    Texts link if their fingerprints (of 3-word shingles) differ in ``bits`` bits at most and their
    ``words``-word shingles have a similarity of ``similar``, by sketches: exact for texts of up to 128
    shingles, an estimate beyond. Equal texts are one node, and texts of no words (null, empty, blank) are
    similar to each other.

    The row of the smallest id stays; rows of null id are grouped like others and stay only if all of
    their component are such. Of rows of that id with different texts, and of rows of one id and text,
    one stays, by hash. An empty table gives no rows.

    Rows go by 128 bits of hash of id and text, texts by 64. Repeated rows are reduced to one before the
    shuffle, so no task gathers the copies of one; texts are shuffled once, to be joined with what stays.
    """
    set_checkpoint_dir(df.sparkSession)
    names = df.columns
    flat = df.toDF(*[f"x{i}" for i in range(len(names))])
    own, text = (F.col(f"x{names.index(c)}") for c in (id_col, text_col))
    keyed = flat.withColumn("k1", F.xxhash64(own, text)).withColumn("k2", F.xxhash64(F.lit(1), text, own))
    rows = keyed.select(own.alias("id"), "k1", "k2", F.xxhash64(F.lit(2), text).alias("node"), text.alias("text"))
    docs = fingerprints(rows, shingle=shingle, seed=seed, keep=["id", "k1", "k2", "node"], sketch=words)
    first = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "k1", "k2")).alias("first")
    nodes = docs.groupBy("node", F.col("fingerprint").alias("fp"), "sketch").agg(first).checkpoint()
    components = connected_components(similar_links(nodes.select("node", "fp", "sketch"), bits, similar))
    grouped = nodes.select("node", "first").join(components, "node", "left").groupBy(F.coalesce("component", "node").alias("component"))
    kept = grouped.agg(F.min("first").alias("first")).select("first.k1", "first.k2")
    plain = [c for c, t in keyed.dtypes if c.startswith("x") and "map<" not in t]
    single = keyed.groupBy("k1", "k2").agg(F.min_by(F.struct(*flat.columns), F.xxhash64(*plain)).alias("row"))
    return single.join(kept, ["k1", "k2"], "left_semi").select("row.*").toDF(*names)
