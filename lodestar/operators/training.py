"""Training-set preparation: noise drop, repeats, triplets, class centres, shuffles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.scalars import seeded
from lodestar.functions.vectors import dot, normalize, squared_l2
from lodestar.operators.cumulative import running_totals


def drop_noise(samples: DataFrame, centres: DataFrame, degrees: float = 75.0) -> DataFrame:
    """``samples (id, label, embedding)`` near the dominant of their label's ``centres (label, sub, embedding)``, relabelled from 0 without gaps.

    A sample votes for its nearest sub-centre (lowest on ties), the most voted (lowest on ties) is
    dominant, and samples with cosine over cos(degrees) to it stay. Returns id, label, new_label.
    """
    unit = centres.select("label", "sub", normalize(F.col("embedding")).alias("centre"))
    scored = samples.select("id", "label", normalize(F.col("embedding")).alias("e")).join(unit, "label").select(
        "id", "label", "sub", dot(F.col("e"), F.col("centre")).alias("cos")
    )
    votes = scored.groupBy("id", "label").agg(
        F.max_by("sub", F.struct("cos", -F.col("sub"))).alias("sub")
    ).groupBy("label", "sub").agg(F.count("*").alias("votes"))
    dominant = votes.groupBy("label").agg(F.max_by("sub", F.struct("votes", -F.col("sub"))).alias("sub"))
    kept = scored.join(dominant, ["label", "sub"]).where(F.col("cos") > math.cos(math.radians(degrees)))
    labels = running_totals(kept.select("label").distinct().withColumn("one", F.lit(1)), "label", ["one"], descending=False)
    return kept.join(labels, "label").select("id", "label", (F.col("one_to_here") - 1).cast("long").alias("new_label"))


def repeat_factors(image_classes: DataFrame, threshold: float) -> DataFrame:
    """(image, factor): the greatest max(1, sqrt(threshold / frequency)) of an image's classes."""
    distinct = image_classes.select("image", "class").distinct()
    total = distinct.agg(F.count_distinct("image").alias("images"))
    frequency = distinct.groupBy("class").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))
    factor = frequency.select("class", F.greatest(F.lit(1.0), F.sqrt(F.lit(threshold) / (F.col("n") / F.col("images")))).alias("factor"))
    return distinct.join(factor, "class").groupBy("image").agg(F.max("factor").alias("factor"))


def repeated(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """``rows (image, ...)`` ceil(factor) times, numbered from 1."""
    return rows.join(factors, "image").withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil("factor").cast("int")))).drop("factor")


def semi_hard_triplets(vectors: DataFrame, margin: float, most_positive: float | None = None, seed: int = 0) -> DataFrame:
    """For each anchor and positive of ``vectors (id, label, embedding, batch)``, one semi-hard negative of their batch by a seeded hash.

    Semi-hard: d(a, n) - d(a, p) < margin and d(a, p) < d(a, n), squared distances. All pairs of a batch
    are compared, so a batch is to be of the size of a mini-batch; ``in_batches`` makes such.
    """
    side = lambda p: vectors.select("batch", *[F.col(c).alias(f"{p}_{c}") for c in ("id", "label", "embedding")])
    pairs = side("a").join(side("o"), "batch").where("a_id <> o_id")
    pairs = pairs.select(
        "batch",
        "a_id",
        "o_id",
        (F.col("a_label") == F.col("o_label")).alias("same"),
        squared_l2(F.col("a_embedding"), F.col("o_embedding")).alias("d")
    )
    positive = pairs.where("same and a_id < o_id").select("batch", "a_id", F.col("o_id").alias("p_id"), F.col("d").alias("ap"))
    positive = positive.where(F.col("ap") < most_positive) if most_positive else positive
    negative = pairs.where("not same").select("batch", "a_id", F.col("o_id").alias("n_id"), F.col("d").alias("an"))
    found = positive.join(negative, ["batch", "a_id"]).where((F.col("an") - F.col("ap") < margin) & (F.col("ap") < F.col("an")))
    pick = F.struct(seeded(seed, F.col("a_id"), F.col("p_id"), F.col("n_id")), F.col("n_id"))
    return found.groupBy("batch", "a_id", "p_id").agg(F.min_by("n_id", pick).alias("n_id")).drop("batch")


def in_batches(rows: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """``rows (id)`` with a ``batch`` of about ``size`` rows each, dealt by a seeded hash of the id."""
    batches = F.lit(max(1, -(-rows.count() // size)))
    return rows.withColumn("batch", seeded(seed, F.col("id")) % batches)


def class_centre_sample(classes: DataFrame, positives: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """All positive classes and, up to ``n``, others by a seeded hash; (label, position), positions in order of label.

    The first ``n`` of the order are found by a running count, so millions of classes are no one task's.
    """
    flagged = classes.select("label").distinct().join(
        positives.select("label").distinct().withColumn("positive", F.lit(1)), "label", "left"
    )
    forced = positives.select("label").distinct().count()
    drawn = flagged.withColumn(
        "draw", F.when(F.col("positive") == 1, F.lit(-1)).otherwise(seeded(seed, F.col("label")))
    ).withColumn("one", F.lit(1))
    placed = running_totals(drawn, "draw", ["one"], descending=False, ties=["label"])
    chosen = placed.where(F.col("one_to_here") <= max(n, forced)).select("label", "one")
    return running_totals(chosen, "label", ["one"], descending=False).select(
        "label", (F.col("one_to_here") - 1).cast("long").alias("position")
    )


def shuffled(rows: DataFrame, id_col: str, seed: int, shards: int) -> DataFrame:
    """A reproducible shuffle: rows dealt to shards, and ordered within them, by seeded hashes of the id."""
    return rows.withColumn(
        "shard", (seeded(seed, F.col(id_col)) % shards).cast("int")
    ).withColumn("position", seeded(seed + 1, F.col(id_col)))


def identity_balanced(samples: DataFrame, per_identity: int, seed: int = 0) -> DataFrame:
    """Exactly ``per_identity`` rows of each label: a seeded order, repeated from its start where a label has fewer.

    The rank limit applies before the shuffle too, so a label of any size sends a few rows a task.
    """
    order = Window.partitionBy("label").orderBy(seeded(seed, F.col("id")), "id")
    ranked = samples.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_identity)
    sizes = samples.groupBy("label").agg(F.count("*").alias("n"))
    turns = F.ceil((F.lit(per_identity + 1) - F.col("r")) / F.col("n"))
    return ranked.join(sizes, "label").withColumn("copy", F.explode(F.sequence(F.lit(1), turns.cast("int")))).drop("r", "n")


def dataset_properties(records: DataFrame) -> DataFrame:
    """Rows and labels of a record set, and the id range of each label as its first and last id."""
    return records.groupBy("label").agg(F.count("*").alias("images"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def runs(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Consecutive equal values within a key: (key, run, value, length)."""
    w = Window.partitionBy(key).orderBy(order)
    marked = rows.withColumn("new", (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")).withColumn("run", F.sum("new").over(w))
    return marked.groupBy(key, "run").agg(F.first(value).alias(value), F.count("*").alias("length"))


def grouped_batches(rows: DataFrame, batch: int, seed: int = 0) -> DataFrame:
    """``rows (id, group)`` in batches of one group each: a seeded order, filled up to a whole batch from its start."""
    keyed = rows.withColumn("key", seeded(seed, F.col("id"))).withColumn("one", F.lit(1))
    ranked = running_totals(keyed, "key", ["one"], descending=False, keys=["group"], ties=["id"])
    sizes = rows.groupBy("group").agg(F.count("*").alias("n"))
    total = F.ceil(F.col("n") / batch) * batch
    places = F.sequence((F.col("one_to_here") - 1).cast("long"), (total - 1).cast("long"), F.col("n").cast("long"))
    placed = ranked.join(sizes, "group").withColumn("place", F.explode(places))
    return placed.select("id", "group", F.floor(F.col("place") / batch).alias("batch"), (F.col("place") % batch).alias("slot"))


def replica_of(rows: DataFrame, replicas: int, seed: int = 0) -> DataFrame:
    """``rows (id)`` dealt to replicas in a seeded order, as many rows each: the first rows are dealt again to fill up."""
    keyed = rows.withColumn("key", seeded(seed, F.col("id")))
    ranked = running_totals(
        keyed.withColumn("one", F.lit(1)), "key", ["one"], descending=False, ties=["id"]
    ).withColumn("place", F.col("one_to_here") - 1)
    n = F.lit(rows.count())
    places = F.sequence(F.col("place").cast("long"), (F.ceil(n / replicas) * replicas - 1).cast("long"), n.cast("long"))
    return ranked.withColumn("place", F.explode(places)).select(
        "id", (F.col("place") % replicas).cast("int").alias("replica"), F.floor(F.col("place") / replicas).alias("step")
    )
