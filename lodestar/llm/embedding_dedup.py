"""Near-duplicate vectors: int8 tile products with per-vector error bounds, exact where they leave doubt."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import bound_batches, pick, set_checkpoint_dir
from lodestar.llm.tiles import tiled
from lodestar.operators.graph import connected_components, union_labels

#: More than what rounding in float32 can add to a scaled product of unit vectors.
SLACK = 1e-5
#: Rows of a tile that are multiplied at a time with all of its other side.
STRIP = 256


def units(m: np.ndarray) -> np.ndarray:
    """Rows at unit length; by a power of two first, so that squares of very large or small components stay finite."""
    m = m / np.exp2(np.floor(np.log2(np.abs(m).max(axis=1))))[:, None]
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes in -127..127 (int8), the step of each vector, and the norm of its rounding error."""
    step = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / step[:, None])
    error = np.sqrt(((unit - codes * step[:, None]) ** 2).sum(axis=1)) * (1 + 1e-12) + 1e-12
    return codes.astype(np.int8), step, error


def possible(left: tuple, right: tuple, threshold: float, same: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Strips (first row, mask) of the pairs whose cosine may be ``threshold``; i < j if both sides are the same block.

    Sides are (codes, steps, errors) of unit vectors. With x = q * s + e, |e| <= d and |x| = 1, x.y
    differs from the product of the codes by dx + dy + dx * dy at most, so a pair that this bound leaves
    below the threshold is no link. BLAS has no int8 product: codes are multiplied as floats, which hold
    sums of up to 1,040 products exactly, and as doubles beyond.
    """
    (qx, sx, dx), (qy, sy, dy) = left, right
    kind = np.float32 if qx.shape[1] <= 1040 else np.float64
    qy = qy.astype(kind).T
    for a in range(0, len(qx), STRIP):
        b = min(a + STRIP, len(qx))
        near = qx[a:b].astype(kind) @ qy
        near *= sx[a:b, None].astype(kind)
        near *= sy[None, :].astype(kind)
        mask = near >= threshold - SLACK - dx[a:b, None] - (dy * (1 + dx[a:b].max()))[None, :]
        yield a, np.triu(mask, a + 1) if same else mask


def linked(left: np.ndarray, right: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index arrays (i, j) of the pairs with cosine >= threshold: the possible ones are recomputed in double precision."""
    x, y = units(left), units(right)
    for a, mask in possible(quantise(x), quantise(y), threshold, same):
        i, j = np.nonzero(mask)
        i += a
        for k in range(0, len(i), 1 << 15):
            u, v = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            hit = np.einsum("ij,ij->i", x[u], y[v]) >= threshold
            yield u[hit], v[hit]


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, size, h1, h2, vector) to (label, size, h1, h2, codes, step, error)."""
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        for size in np.unique(sizes):
            part = batch.take(pa.array(np.nonzero(sizes == size)[0]))
            codes, step, error = quantise(units(_vectors(part.column("vector"))))
            packed = pa.array([row.tobytes() for row in codes], pa.binary())
            columns = [*(part.column(i) for i in range(4)), packed, pa.array(step), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "size", "h1", "h2", "codes", "step", "error"])


def _sides(t: pa.Table) -> tuple[pa.Table, int, bool]:
    """A tile's rows by side, in a fixed order, the number of those of side 0, and whether the block meets itself."""
    t = t.combine_chunks().sort_by([("side", "ascending"), ("h1", "ascending"), ("h2", "ascending")])
    return t, int((t.column("side").to_numpy() == 0).sum()), t.column("ti")[0].as_py() == t.column("tj")[0].as_py()


def _may_link(threshold: float):
    """The rows of a tile that may link with another: at most all of them, never pairs."""

    def run(t: pa.Table) -> pa.Table:
        t, cut, itself = _sides(t)
        some = np.zeros(t.num_rows, dtype=bool)
        if cut and (itself or cut < t.num_rows):
            codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.int8).reshape(t.num_rows, -1)
            step, error = t.column("step").to_numpy(), t.column("error").to_numpy()
            side = lambda s: (codes[s], step[s], error[s])
            others = slice(0, cut) if itself else slice(cut, None)
            for a, mask in possible(side(slice(0, cut)), side(others), threshold, itself):
                some[a : a + len(mask)] |= mask.any(axis=1)
                some[others] |= mask.any(axis=0)
        return t.filter(pa.array(some)).select(["label", "size", "ti", "tj", "side", "h1", "h2"])

    return run


def _exact(threshold: float):
    """Counts of links for each row of a tile, and a spanning forest of the links between ids."""

    def run(t: pa.Table) -> pa.Table:
        t, cut, itself = _sides(t)
        ids, weight = t.column("id").to_numpy(), t.column("weight").to_numpy()
        n = len(ids)
        order = np.argsort(ids, kind="stable")
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.arange(n)
        label, links = np.arange(n), np.zeros(n, dtype=np.int64)
        if cut and (itself or cut < n):
            vectors = _vectors(t.column("vector").combine_chunks())
            for i, j in linked(vectors[:cut], vectors[:cut] if itself else vectors[cut:], threshold, itself):
                j = j if itself else j + cut
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                label = union_labels(label, rank[i], rank[j])
        child, some = np.nonzero(label != np.arange(n))[0], np.nonzero(links)[0]
        void = lambda k: pa.nulls(k, pa.int64())
        both = lambda a, b: pa.concat_arrays([a, b])
        names = t.column("label").combine_chunks()
        return pa.table({
            "label": both(names.take(pa.array(some)), pa.nulls(len(child), names.type)),
            **{h: both(pa.array(t.column(h).to_numpy()[some]), void(len(child))) for h in ("h1", "h2")},
            "links": both(pa.array(links[some]), void(len(child))),
            "a": both(void(len(some)), pa.array(ids[order][child])),
            "b": both(void(len(some)), pa.array(ids[order][label[child]])),
        })

    return run


def embedding_near_duplicates(
    df: DataFrame,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | None = "label",
    tile_numbers: int = 1 << 20
) -> DataFrame:
    """Links, components and one kept vector of each component, for all rows of ``df``.

    Two vectors link if their labels are equal (all are, without ``label_col``), their lengths are
    equal and their cosine in double precision is at least ``threshold`` (over 0, up to 1). Vectors
    with equal components are one class, so a vector that millions of rows share is multiplied once;
    from then on a class goes by 128 bits of hash.

    The classes of a label are dealt into blocks of about ``tile_numbers`` components, and every two
    blocks meet in a tile, first as int8 codes with a step and an error bound each. Only the rows that
    may link there come again with their whole vectors, and give back a count for each class and a
    spanning forest of the links, never the pairs. All pairs of a label are compared by definition:
    products grow with the square of a label, and a vector's codes are sent to as many tiles as the
    label has blocks (one for 16,384 vectors of 64 components).

    Returns a row for each row of ``df``: the id, ``n_links`` (other rows linked directly),
    ``component_id`` (smallest id reachable) and ``kept`` (id = component_id). A null id, label or
    vector, a zero vector or one with null or non-finite components links with nothing; a row of
    null id has component null and is not kept. Repeated rows count as separate vectors. An empty
    table gives no rows. Ids are integers; other columns are ignored.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0, and 1 at most")
    set_checkpoint_dir(df.sparkSession)
    bound_batches(df.sparkSession)
    columns = {"id": id_col, "raw": vector_col} | ({"label": label_col} if label_col else {})
    rows = pick(df, **columns)
    if not label_col:
        rows = rows.withColumn("label", F.lit(0))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    valid = F.coalesce(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall("raw", finite) & F.exists("raw", lambda x: x != 0), F.lit(False)
    )
    rows = rows.select(F.col("id").cast("long").alias("id"), "label", F.when(valid, F.col("raw")).alias("vector"))
    hashes = [F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2")]
    key, kind = ["label", "h1", "h2"], dict(rows.dtypes)["label"]

    classes = rows.where("vector is not null").groupBy("label", "vector").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
    classes = classes.select("label", F.size("vector").alias("size"), *hashes, "vector", "id", "weight").checkpoint()
    sizes = classes.groupBy("label", "size").agg(F.ceil(F.count("*") * F.col("size") / tile_numbers).alias("blocks"))
    coded = classes.select("label", "size", "h1", "h2", "vector").mapInArrow(
        _coded, f"label {kind}, size int, h1 long, h2 long, codes binary, step double, error double"
    )
    dealt = tiled(coded.join(sizes, ["label", "size"]), ["label", "size"], "h1", F.col("blocks")).drop("blocks")
    tile = ["label", "size", "ti", "tj"]
    may = dealt.groupBy(*tile).applyInArrow(_may_link(threshold), f"label {kind}, size int, ti int, tj int, side int, h1 long, h2 long")
    whole = may.join(classes.drop("size"), key)
    found = whole.groupBy(*tile).applyInArrow(_exact(threshold), f"label {kind}, h1 long, h2 long, links long, a long, b long").checkpoint()

    counts = found.where("links is not null").groupBy(*key).agg(F.sum("links").alias("links"))
    # two classes may share the smallest id only if an id is repeated: they are one node here
    components = connected_components(found.where("a is not null").select("a", "b"))
    of_class = classes.select(*key, "id", "weight").join(counts, key, "left").join(components, F.col("id") == F.col("node"), "left")
    of_class = of_class.select(
        *key, (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("component")
    )
    own = rows.select("id", "label", *[F.when(F.col("vector").isNotNull(), h).alias(n) for h, n in zip(hashes, ("h1", "h2"), strict=True)])
    component = F.coalesce("component", "id")
    return own.join(of_class, key, "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")
    )
