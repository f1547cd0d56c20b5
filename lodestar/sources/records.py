"""Readers of binary record sets. A file is one row of ``binaryFile``, so shards are to be of 2 GB at most."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the record format: the magic number, and the bits of a length field.
MAGIC, LENGTH = 0xCED7230A, (1 << 29) - 1


def split_records(raw: bytes) -> Iterator[bytes]:
    """The payloads of a record file: magic, length, bytes, padding to four."""
    at = 0
    while at + 8 <= len(raw):
        magic, head = struct.unpack_from("<II", raw, at)
        if magic != MAGIC:
            raise ValueError(f"no record at byte {at}")
        size = head & LENGTH
        yield raw[at + 8 : at + 8 + size]
        at += 8 + (size + 3) // 4 * 4


def parse_record(payload: bytes) -> tuple[int, list[float], bytes]:
    """(id, labels, content): one label in the header, or as many floats after it as its flag says."""
    flag, label, number, _ = struct.unpack_from("<IfQQ", payload)
    labels = np.frombuffer(payload, "<f4", flag, offset=24).tolist() if flag else [label]
    return number, labels, payload[24 + 4 * flag :]


def _decoded(files: DataFrame, rows_of, names: list[str], types: list[pa.DataType], schema: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held, size = [], 0
                for row in rows_of(raw.as_py()):
                    held.append((path, *row))
                    size += len(row[-1])
                    if size > 16 << 20:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names
                        )
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names
                    )

    return files.select("path", "content").mapInArrow(run, schema)


def read_records(spark: SparkSession, folder: str, glob: str = "*.rec") -> DataFrame:
    """(path, id, labels, content) of record files; the row of id 0 with two labels is a header of id ranges, where there is one."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    types = [pa.string(), pa.int64(), pa.list_(pa.float32()), pa.binary()]
    return _decoded(
        files,
        lambda raw: map(parse_record, split_records(raw)),
        ["path", "id", "labels", "content"],
        types,
        "path string, id long, labels array<float>, content binary"
    )


def split_pairs(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Key and value pairs, each side after its length as a little-endian 32-bit integer."""
    at = 0
    while at < len(raw):
        sides = []
        for _ in range(2):
            (size,) = struct.unpack_from("<i", raw, at)
            sides.append(raw[at + 4 : at + 4 + size])
            at += 4 + size
        yield sides[0], sides[1]


def read_pairs(spark: SparkSession, folder: str, glob: str = "*.kv") -> DataFrame:
    """(path, key, value) of files of length-prefixed pairs."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    types = [pa.string(), pa.binary(), pa.binary()]
    return _decoded(files, split_pairs, ["path", "key", "value"], types, "path string, key binary, value binary")


def write_records(df: DataFrame, path: str, label_col: str = "label", shards: int = 16, seed: int = 0, id_col: str = "id") -> None:
    """The Parquet form of a record set, shuffled by a seeded hash of the id into shards."""
    from lodestar.operators.training import shuffled

    shuffled(df, id_col, seed, shards).repartition(shards, "shard").sortWithinPartitions("shard", "position").drop("position").write.partitionBy("shard").parquet(path, mode="overwrite")
