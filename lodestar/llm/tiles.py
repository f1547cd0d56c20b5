"""Splitting the pairs of a group into tiles of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tiled(rows: DataFrame, keys: list[str], id_col: str, blocks: Column) -> DataFrame:
    """Copies of ``rows`` with ``ti, tj, side``, so that any two rows of a group (of equal ``keys``) meet in a tile.

    The rows of a group are dealt by hash of ``id_col`` into the number of blocks that ``blocks`` gives,
    which must be the same for all of a group; tile (ti, tj), ti <= tj, has the rows of block ti as side
    0 and, where tj differs, those of tj as side 1. A row goes to as many tiles as there are blocks, and
    a tile holds two blocks, however large the group is.
    """
    names = rows.columns
    dealt = rows.withColumn("blocks", blocks.cast("int")).withColumn(
        "block", F.pmod(F.xxhash64(id_col), F.col("blocks").cast("long")).cast("int")
    )
    copies = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return copies.select(
        *names,
        F.least("block", "other").alias("ti"),
        F.greatest("block", "other").alias("tj"),
        (F.col("block") > F.col("other")).cast("int").alias("side")
    )
