"""Weighted rendezvous hashing of record keys over shards."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import pick


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard of the least -ln(u) / weight, where u in (0, 1) is a hash of the key and the shard.

    A shard wins keys in proportion to its weight. As the draw of one shard doesn't depend on the
    others, a new shard takes keys only into itself and a removed one gives up only its own.
    """
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("shards need weights over 0")

    def draw(shard: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(2**53))
        return F.struct((-F.log(u) / F.lit(float(weight))).alias("draw"), F.lit(shard).alias("shard"))

    return F.array_min(F.array(*[draw(s, w) for s, w in weights.items()]))["shard"]


def shard_documents(
    df: DataFrame,
    weights: Mapping[int, float],
    grown: Mapping[int, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = 4096,
    copies: int = 1 << 20
) -> DataFrame:
    """Assign each row a shard by its key alone (law ``key``) and a gapless slot within the shard.

    Returns the id, ``size`` (UTF-8 bytes of the text plus 8), ``text_crc32``, ``law``, ``shard``,
    ``slot`` (from 0) and ``grown_shard`` (under the weights ``grown``; null without). The text is read
    once and stays behind the first projection; only ids and numbers are shuffled.

    Rows of equal id, size and crc32 are counted before the shuffle, so a row repeated any number of
    times is a few counts, which are laid out in stretches of ``copies`` rows. Slots number a shard by
    bucket, a hash of the row, then by key: a bucket's counts are summed up in order and offset by the
    totals of the buckets before, so no task ever holds a whole shard or all rows of one id. The
    offsets are shards x ``buckets`` rows.

    A null text has size 8 and crc32 0, as an empty one. A null id is replaced as a key by the text's
    crc32. Repeated rows go to one shard and have slots of their own. Empty tables give no rows; other
    columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = pick(df, id=id_col, text=text_col).select(
        "id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("crc")
    )
    same = rows.groupBy("id", "size", "crc").agg(F.count("*").alias("n"))
    parts = same.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / copies).cast("int"))))
    key = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("crc32:"), F.col("crc").cast("string")))
    parts = parts.select(
        "id",
        "size",
        "crc",
        "part",
        F.least(F.lit(copies), F.col("n") - F.col("part") * F.lit(copies)).cast("long").alias("n"),
        key.alias("key")
    )
    parts = parts.select(
        "*",
        rendezvous(F.col("key"), weights).alias("shard"),
        (rendezvous(F.col("key"), grown) if grown else F.lit(None).cast("int")).alias("grown"),
        F.pmod(F.xxhash64(F.lit("bucket"), "key", "size", "crc", "part"), F.lit(buckets)).cast("int").alias("bucket"))
    own = Window.partitionBy("shard", "bucket").orderBy("key", "crc", "size", "part", F.col("id").isNull())
    placed = parts.withColumn("until", F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    # both sides of the join below read one shuffle by (shard, bucket)
    totals = placed.groupBy("shard", "bucket").agg(F.max("until").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    out = placed.join(offsets, ["shard", "bucket"])
    last = F.col("offset") + F.col("until") - 1
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard",
        F.explode(F.sequence(last - F.col("n") + 1, last)).alias("slot"), F.col("grown").alias("grown_shard"))
