"""Dataset protocols, assigners and samplers against plain code and literal cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import assignment, detection_eval
from lodestar.operators.detection import iou_matrix

DETS = "image long, class long, det long, x1 double, y1 double, x2 double, y2 double, score double"
GTS = "image long, class long, gt long, x1 double, y1 double, x2 double, y2 double, ignore boolean"


def test_perfect_detections_score_one(spark):
    rows = [(i, i % 2, k, 10.0 * k, 5.0, 10.0 * k + 8 + 40 * (k % 2), 50.0 + i) for i in range(4) for k in range(3)]
    gts = spark.createDataFrame([(*r, False) for r in rows], GTS)
    dets = spark.createDataFrame([(*r, 0.9 - 0.01 * r[2]) for r in rows], DETS)
    out = {(x["area"], x["threshold"]): (x["ap"], x["recall"]) for x in detection_eval.coco_summary(dets, gts).collect()}
    assert out["all", 0.5] == pytest.approx((1.0, 1.0)) and out["all", 0.95] == pytest.approx((1.0, 1.0))
    assert detection_eval.face_ap(dets, gts.withColumn("counts", ~F.col("ignore"))).first()["ap"] == pytest.approx(1.0)


def test_coco_summary_matches_plain_interpolation(spark):
    r = np.random.default_rng(0)
    drows, grows, k = [], [], 0
    for image in range(8):
        g = np.hstack([xy := r.integers(0, 80, (5, 2)).astype(float), xy + r.integers(20, 70, (5, 2))])
        for b in g:
            grows.append((image, 0, k, *b.tolist(), False))
            drows.append((image, 0, k, *(b + r.integers(-6, 7, 4)).tolist(), float(r.random())))
            drows.append((image, 0, 1000 + k, *(b + r.integers(-25, 26, 2).repeat(2)[[0, 2, 1, 3]]).tolist(), float(r.random())))
            k += 1
    drows = [d for d in drows if d[5] > d[3] and d[6] > d[4]]
    marks = []
    for image in range(8):
        d = sorted((x for x in drows if x[0] == image), key=lambda x: (-x[7], x[2]))
        g = [x for x in grows if x[0] == image]
        near, free = iou_matrix(np.array([x[3:7] for x in d]), np.array([x[3:7] for x in g])), np.ones(len(g), bool)
        for i, x in enumerate(d):
            fit = np.where(free & (near[i] >= 0.5), near[i], -1)
            hit = fit.max() >= 0
            if hit:
                free[fit.argmax()] = False
            marks.append((-x[7], image, x[2], hit))
    hits = np.cumsum([m[3] for m in sorted(marks)])
    recall, precision = hits / len(grows), hits / np.arange(1, len(hits) + 1)
    want = np.mean([max(precision[recall >= t - 1e-9], default=0.0) for t in np.linspace(0, 1, 101)])
    got = detection_eval.coco_summary(
        spark.createDataFrame(drows, DETS), spark.createDataFrame(grows, GTS)
    ).where("area = 'all' and threshold = 0.5").first()
    assert got["ap"] == pytest.approx(want) and got["recall"] == pytest.approx(recall[-1])


def test_crowds_make_detections_neither(spark):
    gts = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 100.0, 100.0, True), (1, 0, 2, 200.0, 0.0, 240.0, 40.0, False)], GTS)
    dets = spark.createDataFrame(
        [(1, 0, k, 10.0 * k, 10.0, 10.0 * k + 9, 20.0, 0.9) for k in range(5)] + [(1, 0, 9, 200.0, 0.0, 240.0, 40.0, 0.5)], DETS
    )
    assert detection_eval.coco_matches(dets, gts).where(
        "area = 'all' and threshold = 0.5"
    ).agg(F.sum("tp"), F.sum("fp")).first()[:] == (1, 0)
    assert detection_eval.face_ap(dets, gts.withColumn("counts", ~F.col("ignore")), 0.5).first()["ap"] < 1.0


def test_similarity_transform_is_recovered():
    r = np.random.default_rng(1)
    src = r.normal(size=(5, 2))
    m = np.array([[0.8, -0.6, 3.0], [0.6, 0.8, -1.0]]) * np.array([[2, 2, 1]])
    assert np.allclose(assignment.similarity_transform(src, src @ m[:, :2].T + m[:, 2]), m)


def test_samplers_balance(spark):
    rows = spark.createDataFrame(
        [(1, k, k % 2 if k < 6 else (2 if k == 6 else -1), 0.05 * (k % 10)) for k in range(40)],
        "image long, det long, assigned long, iou double"
    )
    got = assignment.instance_balanced_sample(rows, 3).collect()
    assert {x["assigned"] for x in got} == {0, 1, 2}
    slots = [x["slot"] for x in assignment.iou_balanced_sample(rows, 9).collect()]
    assert sorted(slots) == [0, 0, 0, 1, 1, 1, 2, 2, 2]
    hard = assignment.hard_sample(rows.withColumn("loss", F.col("det").cast("double")), 8, 0.25).collect()
    assert sorted(x["det"] for x in hard) == [5, 6, 34, 35, 36, 37, 38, 39]


def test_strict_review_extends_its_references(spark):
    refs = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, [0.0, 1.0])], "vector_id long, person_id long, embedding array<double>")
    rows = [(5, 0, 10, 3, [0.6, 0.8]), (5, 1, 11, 3, [0.61, 0.79]), (5, 2, 12, 1, [0.1, 0.99]), (6, 0, 13, 1, [0.9, 0.4])]
    out = assignment.strict_review(
        spark.createDataFrame(rows, "request long, position long, query_id long, person_id long, embedding array<double>"), refs
    ).orderBy("request", "position").collect()
    assert [x["accepted"] for x in out] == [True, True, False, True]


def test_point_assignment_takes_the_nearest(spark):
    points = spark.createDataFrame([(1, k, float(k), 5.0, 0) for k in range(10)], "image long, det long, x double, y double, level long")
    gts = spark.createDataFrame([(1, 0, 7, 0.0, 0.0, 8.0, 10.0, False)], GTS)
    got = {x["det"]: x["assigned"] for x in assignment.point_assign(points, gts, nearest=3).collect()}
    assert {k for k, v in got.items() if v == 7} == {3, 4, 5}


def test_landmark_and_bucket_codes_are_inverse(spark):
    from lodestar.functions import boxes as bx

    a, b = tuple(F.lit(float(x)) for x in (10, 20, 50, 80)), tuple(F.lit(float(x)) for x in (14, 18, 61, 90))
    ((x, y),) = bx.decode_landmarks(a, bx.encode_landmarks(a, [(F.lit(33.0), F.lit(44.0))]))
    codes = bx.encode_buckets(a, b, 14)
    row = spark.range(1).select(
        x.alias("x"),
        y.alias("y"),
        F.array(*bx.decode_inclusive(a, bx.encode_inclusive(a, b))).alias("d"),
        F.array(*bx.decode_buckets(a, codes, 14)).alias("k"),
        codes[0]["offset"].alias("o")
    ).first()
    assert (row["x"], row["y"]) == pytest.approx((33, 44)) and row["d"] == pytest.approx([14, 18, 61, 90]) and row["k"] == pytest.approx([14, 18, 61, 90]) and abs(row["o"]) <= 0.5


def test_batches_and_replicas_are_full(spark):
    from lodestar.operators import training

    rows = spark.createDataFrame([(i, i % 3 if i < 20 else 5) for i in range(21)], "id long, group long")
    got = training.grouped_batches(rows, 4).collect()
    assert all(
        n == 4 for n in {
            (x["group"], x["batch"]): sum((y["group"], y["batch"]) == (x["group"], x["batch"]) for y in got) for x in got
        }.values()
    )
    assert {x["id"] for x in got} == set(range(21)) and len({x["group"] for x in got if x["id"] == 20}) == 1
    dealt = training.replica_of(rows, 4).collect()
    assert [sum(x["replica"] == r for x in dealt) for r in range(4)] == [6] * 4 and {x["id"] for x in dealt} == set(range(21))


def test_prediction_folders_and_reports(spark, tmp_path):
    from lodestar.sources import files

    (tmp_path / "p" / "0--Parade").mkdir(parents=True)
    (tmp_path / "p" / "0--Parade" / "a_1.txt").write_text("0--Parade/a_1.jpg\n2\n1 2 3 4 0.9\n5 6 7 8 0.5\n")
    got = files.read_face_predictions(spark, str(tmp_path / "p")).orderBy("det").collect()
    assert [(x["event"], x["image"], x["det"], x["x2"], x["score"]) for x in got] == [
        ("0--Parade", "a_1", 0, 4.0, 0.9), ("0--Parade", "a_1", 1, 12.0, 0.5)
    ]
    metrics = spark.createDataFrame([("a<b", 0.25)], "metric string, value double")
    assert "a&lt;b</td><td>0.25" in files.html_report("T", metrics) and files.json_report(metrics) == '{"a<b": 0.25}'


def test_datasets_are_evaluated_apart(spark):
    from lodestar.operators.detection import eval_map

    gts = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 9.0, 9.0, False)], GTS)
    dets = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 9.0, 9.0, 0.5)], DETS)
    out = detection_eval.evaluate_each({"a": (dets, gts), "b": (dets.limit(0), gts)}, eval_map).collect()
    assert {x["dataset"]: x["ap"] for x in out} == {"a": pytest.approx(1.0), "b": 0.0}
