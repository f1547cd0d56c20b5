"""Connected components, over a whole cluster and inside one task, and the checkpoints that cut their lineage."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that ``spark.checkpoint.dir`` names.

    A local master without one gets a folder of its own, as in tests. A cluster without one is an
    error: checkpoints in the local folders of executors go with the executors.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def drop_checkpoint(df: DataFrame) -> None:
    """Remove the files of what ``DataFrame.checkpoint()`` gave, once nothing reads them any more."""
    jvm = df.sparkSession.sparkContext._jvm
    found = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if found.isDefined():
        path = jvm.org.apache.hadoop.fs.Path(found.get())
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def union_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of ``a[i]`` and ``b[i]``; ``label[x]`` is the smallest member of x's set, before and after."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that connect what the edges (a, b) connect: fewer than there are nodes."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = union_labels(np.arange(len(nodes)), ends[: len(a)], ends[len(a) :])
    child = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[child], nodes[label[child]]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for the nodes of ``edges (a, b)``; component is the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014). A star is a minimum for
    each node, which combines before the shuffle, joined back to the edges, which adaptive execution
    may split: the neighbours of a hub are never gathered. Each round ends in a checkpoint, so a lost
    executor costs one round at most, and removes the one before. Null ends and loops are ignored; no
    edges give no rows.
    """
    ensure_checkpoint_dir(edges.sparkSession)

    def star(pairs: DataFrame, centre: str, leaf: str) -> DataFrame:
        least = pairs.groupBy(F.col(centre).alias("centre")).agg(F.min(leaf).alias("low"))
        joined = pairs.join(least, F.col(centre) == F.col("centre"))
        return joined.select(F.col(centre).alias("u"), F.col(leaf).alias("v"), F.least("low", centre).alias("m"))

    now = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct().checkpoint()
    mark = None
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, "u", "v").where("v > u").select("v", F.col("m").alias("u")).distinct()
        small = star(large, "v", "u")  # the centre v is named u here, and the leaves are its smaller neighbours
        ends = [F.struct(F.col(c).alias("v"), F.col("m").alias("u")) for c in ("v", "u")]
        done, now = now, small.select(F.explode(F.array(*ends)).alias("e")).select("e.v", "e.u").where("u <> v").distinct().checkpoint()
        drop_checkpoint(done)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            roots = now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
            return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(roots)
        mark = seen
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
