"""What the text operators share: column picking, Arrow text maps and broadcast files."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.operators.graph import ensure_checkpoint_dir as set_checkpoint_dir  # noqa: F401

#: Bytes of text that a Python kernel holds at a time; one longer text is a chunk of its own.
CHUNK_BYTES = 2 << 20
#: Bytes of an Arrow batch that the JVM hands to a kernel: rows alone don't bound a batch of texts.
BATCH_BYTES = 8 << 20


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select ``out=in`` columns by position, so that other columns may have any (even equal) names."""
    names = df.columns
    flat = df.toDF(*[f"c{i}" for i in range(len(names))])
    return flat.select(*[F.col(f"c{names.index(name)}").alias(out) for out, name in columns.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class SharedFile:
    """Bytes of a small file read once by the driver (at most ``limit``) and broadcast to the workers."""

    def __init__(self, spark: SparkSession, path: str, limit: int = 64 << 20):
        with open(path, "rb") as f:
            data = f.read(limit + 1)
        if len(data) > limit:
            raise ValueError(f"{path} is over {limit} bytes, too large to broadcast")
        self.key = hashlib.sha256(data).hexdigest()
        self._data = spark.sparkContext.broadcast(data)

    @property
    def data(self) -> bytes:
        return self._data.value


_HELD: list[tuple[tuple, object]] = []


def per_process(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` returns, held for later tasks of this Python worker. One value is held: workers
    live on from stage to stage, and what an earlier stage needed would take the memory of the next."""
    if not _HELD or _HELD[0][0] != key:
        _HELD.clear()
        _HELD.append((key, make()))
    return _HELD[0][1]


def chunked(sizes: Sequence[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes, a whole row at least."""
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def bound_batches(spark: SparkSession) -> None:
    """Set the session's bytes of an Arrow batch to BATCH_BYTES, unless they are set."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "1") == "1":  # unset: a default must be a valid size
        spark.conf.set(key, str(BATCH_BYTES))


Kernel = Callable[[list], Sequence[pa.Array]]


def map_texts(
    df: DataFrame,
    text_col: str,
    fields: list[T.StructField],
    kernel: Callable[[], Kernel],
    keep: list[str] | None = None,
    chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """Append ``fields`` computed from whole texts, in one Arrow pass without a shuffle.

    ``kernel()`` runs once a task and returns a function from a list of texts (None for null) to one
    Arrow array for each field. ``keep`` names the columns that go through (default: all); a kept
    column of the name of a new field is replaced by it.
    """
    bound_batches(df.sparkSession)
    names = df.columns
    at = names.index(text_col)
    new = {f.name for f in fields}
    through = [i for i, n in enumerate(names) if n not in new and (keep is None or n in keep)]
    flat = df.toDF(*[f"c{i}" for i in range(len(names))])
    used = sorted({*through, at})
    flat = flat.select(*[f"c{i}" for i in used])
    out = T.StructType([flat.schema[f"c{i}"] for i in through] + [T.StructField(f"r{j}", f.dataType, True) for j, f in enumerate(fields)])
    kept, text_at = [used.index(i) for i in through], used.index(at)
    result_names = [f"c{i}" for i in through] + [f"r{j}" for j in range(len(fields))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = kernel()
        for batch in batches:
            text = batch.column(text_at)
            sizes = pc.fill_null(pc.binary_length(text), 0).to_pylist()
            for a, b in chunked(sizes, chunk_bytes):
                made = f(text.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in kept] + list(made), names=result_names)

    mapped = flat.mapInArrow(run, out)
    return mapped.select(*[F.col(f"c{i}").alias(names[i]) for i in through], *[F.col(f"r{j}").alias(f.name) for j, f in enumerate(fields)])
