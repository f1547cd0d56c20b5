"""Tables of the engine's shapes, built from the supplied ones; each has a twin in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.vectors import dot, normalize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors; a person is one of five parts of a label."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("vector_id"), (F.col("label") * 5 + F.col("vec_id") % 5).cast("long").alias("person_id"), "embedding", "label"
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: vectors of ids divisible by 50, against all rows."""
    return gallery(spark, sf_dir).where("vector_id % 50 = 0").select(F.col("vector_id").alias("query_id"), "person_id", "embedding")


def planted(spark: SparkSession, sf_dir: str, weight: float) -> DataFrame:
    """Vectors with ``weight`` added to the element of their label, at unit length."""
    raised = F.transform("embedding", lambda x, i: x.cast("double") + F.when(i == F.col("label"), F.lit(weight)).otherwise(F.lit(0.0)))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").cast("long").alias("label"), normalize(raised).alias("embedding")
    )


def binary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a quality label, scored by length: many ties."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("quality").alias("label"), (F.col("n_chars") / F.lit(1000.0)).alias("score")
    )


def verification_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interleaved pairs of planted vectors: (0, 1), (2, 3), ...; a pair is genuine if the labels are equal modulo 2."""
    v = planted(spark, sf_dir, 1.0)
    a = v.where("vec_id % 2 = 0").select(
        (F.col("vec_id") / 2).cast("long").alias("pair_idx"), F.col("label").alias("la"), F.col("embedding").alias("ea")
    )
    b = v.where("vec_id % 2 = 1").select(
        ((F.col("vec_id") - 1) / 2).cast("long").alias("pair_idx"), F.col("label").alias("lb"), F.col("embedding").alias("eb")
    )
    distance = F.round(2 - 2 * dot(F.col("ea"), F.col("eb")), 6)
    return a.join(b, "pair_idx").select(
        "pair_idx", (F.col("la") % 2 == F.col("lb") % 2).cast("int").alias("label"), distance.alias("distance")
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as boxes: an image is sixteen orders."""
    x1, y1 = (F.col("l_partkey") % 40).cast("double"), (F.col("l_suppkey") % 40).cast("double")
    raw = table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 16).cast("long").alias("image"),
        (F.col("l_linenumber") % 3).cast("long").alias("class"),
        x1.alias("x1"),
        y1.alias("y1"),
        (x1 + 20 + F.col("l_quantity") % 20).alias("x2"),
        (y1 + 20 + F.col("l_partkey") % 17).alias("y2"),
        (F.col("l_extendedprice") / 100000).alias("score")
    ).distinct()
    order = Window.partitionBy("image").orderBy("class", "x1", "y1", "x2", "y2", "score")
    return raw.withColumn("det", F.row_number().over(order).cast("long"))


def track_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as boxes of a video: an order is a frame, sixty-four orders a video."""
    x, y = (F.col("l_partkey") % 400).cast("double"), (F.col("l_suppkey") % 10 * 40).cast("double")
    rows = table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 64).cast("long").alias("video"),
        F.col("l_orderkey").alias("frame"),
        x.alias("x1"),
        y.alias("y1"),
        (x + 80).alias("x2"),
        (y + 90).alias("y2"),
        F.least(F.col("l_extendedprice") / 50000, F.lit(1.0)).alias("score")
    )
    order = Window.partitionBy("video", "frame").orderBy("x1", "y1", "score")
    return rows.withColumn("det", F.row_number().over(order).cast("long"))


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth detection, shifted a little; some are to be ignored."""
    d, s = detections(spark, sf_dir), F.col("det") % 3
    return d.where("det % 5 = 0").select(
        "image",
        "class",
        F.col("det").alias("gt"),
        *[(F.col(c) + s).alias(c) for c in ("x1", "y1", "x2", "y2")],
        (F.col("det") % 35 == 0).alias("ignore")
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one-face frames of four monitors; errors are unknown faces."""
    at = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 4).alias("monitor"),
        F.unix_micros(at).alias("micros"),
        (F.unix_micros(at) / F.lit(1e6)).alias("seconds"),
        F.col("event_id").alias("face"),
        F.when(F.col("event_type") != "error", F.col("user_id")).alias("person"),
        ((F.col("event_id") % 50) / 100).alias("left"),
        ((F.col("event_id") % 40) / 100).alias("top"),
        F.lit(0.3).alias("width"),
        F.lit(0.3).alias("height"),
        at.alias("at")
    )


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change feed of vectors."""
    op = F.when(F.col("event_type").isin("purchase", "signup"), "add").when(F.col("event_type") == "error", "delete")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("vector_id")
    ).where("op is not null")


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("person_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
        (F.col("c_custkey") * 3).alias("cover_sample_id")
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as face samples; those not finished are of three persons, so that other persons have none and these have many."""
    o = table(spark, sf_dir, "orders")
    person = F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).otherwise(F.col("o_custkey") % 3)
    return o.select(
        F.col("o_orderkey").alias("sample_id"),
        person.alias("person_id"),
        (F.col("o_totalprice") / 1000).alias("quality"),
        F.when(F.col("o_orderpriority").startswith("1"), F.concat(F.lit("crops/"), F.col("o_orderkey").cast("string"))).alias("crop_path")
    )


SQL = {
    "gallery": """gallery AS (SELECT vec_id AS vector_id, (label * 5 + vec_id % 5)::BIGINT AS person_id, embedding::DOUBLE[] AS embedding,
        label FROM embeddings)""",
    "queries": "queries AS (SELECT vector_id AS query_id, person_id, embedding AS query FROM gallery WHERE vector_id % 50 = 0)",
    "pairs": """pairs AS (SELECT query_id, q.person_id AS own, vector_id, g.person_id, label, list_inner_product(query, embedding) AS score
        FROM queries q, gallery g)""",
    "raised1": """raised AS (SELECT vec_id, label::BIGINT AS label, list_transform(embedding, lambda x, i: x::DOUBLE + CASE
        WHEN i - 1 = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS e FROM embeddings)""",
    "raised2": """raised AS (SELECT vec_id, label::BIGINT AS label, list_transform(embedding, lambda x, i: x::DOUBLE + CASE
        WHEN i - 1 = label THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END) AS e FROM embeddings)""",
    "planted": "planted AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM raised)",
    "scores": "scores AS (SELECT quality AS label, n_chars / 1000.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id))",
    "curve": """curve AS (SELECT score, pos, neg, sum(pos) OVER w AS pos_ge, sum(neg) OVER w AS neg_ge, sum(pos) OVER () AS p, sum(neg)
        OVER () AS n
        FROM (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM scores GROUP BY score)
            WINDOW w AS (ORDER BY score DESC))""",
    "vpairs": """vpairs AS (SELECT (a.vec_id // 2)::BIGINT AS pair_idx, (a.label % 2 = b.label % 2)::INT AS label,
        round(2 - 2 * list_inner_product(a.e, b.e), 6) AS distance
        FROM planted a JOIN planted b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1)""",
    "dets": """dets AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY class, x1, y1, x2, y2, score) AS det FROM (
        SELECT DISTINCT l_orderkey // 16 AS image, (l_linenumber % 3)::BIGINT AS class, (l_partkey % 40)::DOUBLE AS x1,
            (l_suppkey % 40)::DOUBLE AS y1,
            (l_partkey % 40)::DOUBLE + 20 + l_quantity % 20 AS x2, (l_suppkey % 40)::DOUBLE + 20 + l_partkey % 17 AS y2,
            l_extendedprice / 100000 AS score FROM lineitem))""",
    "gts": """gts AS (SELECT image, class, det AS gt, x1 + det % 3 AS x1, y1 + det % 3 AS y1, x2 + det % 3 AS x2, y2 + det % 3 AS y2,
        det % 35 = 0 AS ignored FROM dets WHERE det % 5 = 0)""",
    "frames": """frames AS (SELECT user_id % 4 AS monitor, epoch_us(ts) AS micros, epoch_us(ts) / 1e6 AS seconds, event_id AS face, CASE
        WHEN event_type <> 'error' THEN user_id END AS person, ts FROM events)""",
    "feed": """feed AS (SELECT event_id AS seq, CASE WHEN event_type IN ('purchase', 'signup') THEN 'add' ELSE 'delete' END AS op,
        user_id AS vector_id FROM events WHERE event_type IN ('purchase', 'signup', 'error'))""",
    "persons": """persons AS (SELECT c_custkey AS person_id, c_name AS name, c_mktsegment AS segment, c_custkey * 3 AS cover_sample_id
        FROM customer)""",
    "samples": """samples AS (SELECT o_orderkey AS sample_id, CASE
        WHEN o_orderstatus = 'F' THEN o_custkey ELSE o_custkey % 3 END AS person_id, o_totalprice / 1000 AS quality, CASE
            WHEN o_orderpriority LIKE '1%' THEN 'crops/' || o_orderkey END AS crop_path FROM orders)""",
}


def with_(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + " "


def sql_iou(a: str, b: str, pixel: int = 0) -> str:
    """IoU of the boxes of two aliases, least divisor 1e-6."""
    p = f" + {pixel}" if pixel else ""
    inter = f"greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1){p}, 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1){p}, 0)"
    size = lambda t: f"({t}.x2 - {t}.x1{p}) * ({t}.y2 - {t}.y1{p})"
    return f"({inter} / greatest({size(a)} + {size(b)} - {inter}, 1e-6))"
