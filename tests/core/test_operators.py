"""Operators that SQL cannot express, and literal cases, against NumPy or plain Python."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.functions import boxes as bx
from lodestar.functions import scalars as sc
from lodestar.functions import vectors as vec
from lodestar.operators import clustering, detection, evaluation, search, store, templates, training
from lodestar.operators.cumulative import running_totals
from lodestar.sources import files
from lodestar.streaming import monitor, tracking


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


# vectors


def test_int8_quantization_rounds_half_away_and_clips(spark):
    got = one(spark, q=vec.quantize_int8(arr(-1, -0.1276, -0.1274, -0.0005, 0.0005, 0.1266, 1), 1000))["q"]
    assert got == [-128, -128, -127, -1, 1, 127, 127]


def test_half_precisions_match_numpy(spark):
    values = [float(np.float32(x)) for x in np.random.default_rng(0).normal(size=64)]
    row = spark.createDataFrame([(values,)], "v array<float>").select(vec.to_fp16("v").alias("h"), vec.to_bf16("v").alias("b")).first()
    assert row["h"] == [float(np.float16(x)) for x in values]
    assert all(abs(a - b) <= abs(a) * 2**-8 for a, b in zip(values, row["b"], strict=True))
    assert all(np.float32(b).view(np.uint32) & 0xFFFF == 0 for b in row["b"])


def test_cosine_of_odd_vectors(spark):
    null = F.lit(None).cast("array<double>")
    row = one(
        spark,
        a=vec.cosine(arr(1, 0), arr(0, 1)),
        b=vec.cosine(arr(1, 0), arr(1)),
        c=vec.cosine(null, arr(1)),
        d=vec.cosine(arr(2, 0), arr(3, 0)),
        z=vec.normalize(arr(0, 0)),
        u=vec.is_unit(arr(1, 0), 2),
        n=vec.is_unit(arr(1, float("nan")), 2)
    )
    assert (row["a"], row["b"], row["c"], row["d"], row["z"], row["u"], row["n"]) == (0.0, 0.0, 0.0, 1.0, [0.0, 0.0], True, False)


def test_calibration_fixes_the_middle(spark):
    row = one(spark, m=vec.calibrate(F.lit(0.48)), hi=vec.calibrate(F.lit(1.0)), lo=vec.calibrate(F.lit(-1.0)))
    assert row["m"] == pytest.approx(0.6) and 0.01 <= row["lo"] < row["m"] < row["hi"] <= 1


# search


@pytest.mark.parametrize("block_bytes", [128, 1 << 20])
def test_search_matches_numpy_in_any_blocks(spark, block_bytes):
    r = np.random.default_rng(4)
    g = r.normal(size=(200, 8)).round(1)
    person = r.integers(0, 20, size=200)
    gallery = spark.createDataFrame(
        [(i, int(person[i]), g[i].tolist()) for i in range(200)] + [(999, 1, None)],
        "vector_id long, person_id long, embedding array<double>"
    ).repartition(5)
    queries = spark.createDataFrame(
        [(i, int(person[i]), g[i].tolist()) for i in range(0, 200, 20)], "query_id long, person_id long, embedding array<double>"
    )
    scores = g[::20] @ g.T
    faces, persons = {}, {}
    for k, s in enumerate(scores):
        order = sorted(range(200), key=lambda i: (-s[i], i))
        faces[20 * k] = order[:4]
        best = {p: min((i for i in range(200) if person[i] == p), key=lambda i: (-s[i], i)) for p in set(person.tolist())}
        persons[20 * k] = sorted(best, key=lambda p: (-s[best[p]], p))[:4]
    got = search.face_topk(queries, gallery, 4, block_bytes).collect()
    assert {q: [x["vector_id"] for x in sorted(got, key=lambda x: x["rank"]) if x["query_id"] == q] for q in faces} == faces
    for strategy in ("gemm", "sql"):
        got = search.grouped_topk(queries, gallery, 4, strategy=strategy, block_bytes=block_bytes).collect()
        assert {q: [x["person_id"] for x in sorted(got, key=lambda x: x["rank"]) if x["query_id"] == q] for q in persons} == persons
    pairs = search.threshold_pairs(queries, gallery, 5.0, block_bytes).collect()
    assert {(x["query_id"], x["vector_id"]) for x in pairs} == {(20 * k, i) for k in range(10) for i in range(200) if scores[k, i] >= 5.0}


def test_search_of_nothing(spark):
    gallery = spark.createDataFrame([], "vector_id long, person_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>")
    assert search.grouped_topk(queries, gallery, 3).count() == 0
    assert search.identify(queries, gallery, 0.5).first()["status"] == "unknown"
    assert search.face_topk(queries.limit(0), gallery, 3).count() == 0


# evaluation


def test_zero_budget_targets_are_left_out(spark):
    rows = [(1, 0.95), (1, 0.9)] + [(0, 0.1)] * 99 + [(0, 0.2)]
    got = evaluation.tar_at_far(spark.createDataFrame(rows, "label int, score double"), [1e-2, 1e-3]).collect()
    assert len(got) == 1 and got[0]["budget"] == 1 and got[0]["tar"] == 1.0 and got[0]["threshold"] == 0.2 and not got[0]["exclusive"]


def test_ties_at_the_top_impostor_need_a_threshold_above(spark):
    rows = [(1, 0.9), (1, 0.5), (1, 0.5)] + [(0, 0.5)] * 5 + [(0, 0.1)] * 95
    got = evaluation.tar_at_far(spark.createDataFrame(rows, "label int, score double"), [0.02]).first()
    assert got["exclusive"] and got["threshold"] == 0.5 and got["tar"] == pytest.approx(1 / 3) and got["far"] == 0


@pytest.mark.parametrize("descending", [True, False])
def test_running_totals_match_cumsum(spark, descending):
    r = np.random.default_rng(1)
    x = np.unique(r.normal(size=500))
    n = r.integers(0, 9, size=len(x))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "n": n})).repartition(7)
    got = running_totals(df, "x", ["n"], descending, part_rows=60).orderBy("x").toPandas()["n_to_here"].to_numpy()
    want = np.cumsum(n[::-1])[::-1] if descending else np.cumsum(n)
    assert (got == want).all()


def test_kfold_val_matches_numpy(spark):
    r = np.random.default_rng(2)
    label = r.integers(0, 2, size=203)
    distance = np.round(np.where(label == 1, r.normal(1.0, 0.3, 203), r.normal(1.5, 0.3, 203)).clip(0, 3.9), 4)
    pairs = spark.createDataFrame(pd.DataFrame({"pair_idx": range(203), "label": label, "distance": distance}))
    folds = np.concatenate([[f] * len(p) for f, p in enumerate(np.array_split(np.arange(203), 10))])
    t = np.array([i * 0.001 for i in range(4000)])
    for x in evaluation.kfold_val(pairs, 0.1).collect():
        train, own = folds != x["fold"], folds == x["fold"]
        neg = distance[train & (label == 0)]
        far = (neg[None, :] < t[:, None]).mean(axis=1)
        lo, hi = np.nonzero(far <= 0.1)[0].max(), np.nonzero(far > 0.1)[0].min()
        want = t[lo] + (0.1 - far[lo]) / (far[hi] - far[lo]) * (t[hi] - t[lo])
        assert x["threshold"] == pytest.approx(want)
        assert x["val"] == pytest.approx((distance[own & (label == 1)] < want).mean())


def test_kfold_accuracy_matches_numpy(spark):
    r = np.random.default_rng(3)
    label = r.integers(0, 2, size=97)
    distance = np.round(np.where(label == 1, r.normal(1.0, 0.4, 97), r.normal(1.6, 0.4, 97)).clip(0, 3.9), 2)
    pairs = spark.createDataFrame(pd.DataFrame({"pair_idx": range(97), "label": label, "distance": distance}))
    folds = np.concatenate([[f] * len(p) for f, p in enumerate(np.array_split(np.arange(97), 10))])
    t = np.array([i * 0.01 for i in range(400)])
    right = (distance[None, :] < t[:, None]) == (label == 1)[None, :]
    for x in evaluation.kfold_accuracy(pairs).collect():
        best = right[:, folds != x["fold"]].mean(axis=1).argmax()
        assert x["threshold"] == pytest.approx(t[best]) and x["accuracy"] == pytest.approx(right[best][folds == x["fold"]].mean())


def test_open_set_counts_failures_in_the_denominator(spark):
    probes = spark.createDataFrame(
        [(1, 1, 1, 0.9, 0.2), (2, 2, 3, 0.6, 0.6), (3, None, 5, 0.5, None), (4, None, 5, 0.4, None)],
        "query_id long, truth long, best long, score double, wrong_score double"
    )
    got = evaluation.open_set(probes, [0.25]).first()
    assert got["budget"] == 1 and got["tar"] == 0.5


# boxes and detections


def boxes(rng, n, spread=60):
    xy = rng.integers(0, spread, size=(n, 2)).astype(float)
    return np.hstack([xy, xy + rng.integers(5, 40, size=(n, 2))])


def plain_iou(a, b, pixel=0.0):
    w, h = min(a[2], b[2]) - max(a[0], b[0]) + pixel, min(a[3], b[3]) - max(a[1], b[1]) + pixel
    inter = max(w, 0) * max(h, 0)
    size = lambda x: (x[2] - x[0] + pixel) * (x[3] - x[1] + pixel)
    return inter / (size(a) + size(b) - inter)


def frame(spark, rng, images=6, n=40):
    rows, k = [], 0
    for image, b in itertools.chain.from_iterable(((i, x) for x in boxes(rng, n)) for i in range(images)):
        rows.append((image, int(rng.integers(2)), k, *b.tolist(), float(rng.integers(0, 50)) / 50))
        k += 1
    return spark.createDataFrame(rows, "image long, class long, det long, x1 double, y1 double, x2 double, y2 double, score double"), rows


@pytest.mark.parametrize(("pixel", "inclusive"), [(1.0, False), (0.0, True)])
def test_nms_matches_plain_greed(spark, pixel, inclusive):
    dets, rows = frame(spark, np.random.default_rng(0))
    want = set()
    for key in {(r[0], r[1]) for r in rows}:
        kept = []
        for r in sorted((r for r in rows if (r[0], r[1]) == key), key=lambda r: (-r[7], r[2])):
            near = [plain_iou(r[3:7], k[3:7], pixel) for k in kept]
            if not any(x >= 0.4 if inclusive else x > 0.4 for x in near):
                kept.append(r)
        want |= {r[2] for r in kept}
    assert {x["det"] for x in detection.nms(dets, 0.4, pixel=pixel, inclusive=inclusive).collect()} == want
    assert detection.nms(dets.limit(0), 0.4).count() == 0
    assert detection.greedy_keep(
        boxes(np.random.default_rng(5), 300), 0.3, block=7
    ).tolist() == detection.greedy_keep(boxes(np.random.default_rng(5), 300), 0.3).tolist()


def test_hungarian_is_optimal():
    r = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 5), (5, 3), (6, 6)):
        cost = r.random((n, m))
        to = detection.hungarian(cost)
        got = sum(cost[i, j] for i, j in enumerate(to) if j >= 0)
        a, b = (cost, m) if n <= m else (cost.T, n)
        assert (to >= 0).sum() == min(n, m) and got == pytest.approx(
            min(sum(a[i, p[i]] for i in range(len(a))) for p in itertools.permutations(range(b), len(a)))
        )


def test_each_truth_is_matched_once(spark):
    dets, rows = frame(spark, np.random.default_rng(2), images=3, n=30)
    gts = dets.where("det % 4 = 0").select(
        "image", "class", F.col("det").alias("gt"), *[(F.col(c) + 1).alias(c) for c in ("x1", "y1", "x2", "y2")]
    )
    for mark in (detection.mark_default, detection.mark_available):
        out = mark(dets, gts, 0.5).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp")).first()
        assert out["tp"] + out["fp"] == 90 and 0 < out["tp"] <= gts.count()
    recall = {(x["number"], x["threshold"]): x["recall"] for x in detection.proposal_recall(dets, gts, [5, 30], [0.5, 0.99]).collect()}
    assert recall[30, 0.5] > 0.9 and recall[5, 0.5] < recall[30, 0.5] and recall[30, 0.99] == 0
    assert detection.hungarian_assign(dets, gts).where("assigned >= 0").groupBy("image", "assigned").count().where("count > 1").count() == 0
    ap = {
        x["class"]: x["ap"] for x in detection.eval_map(
            gts.select("image", "class", F.col("gt").alias("det"), "x1", "y1", "x2", "y2", F.lit(1.0).alias("score")), gts
        ).collect()
    }
    assert all(v > 0.9 for v in ap.values())


def test_codecs_are_inverse(spark):
    a, b = tuple(F.lit(float(x)) for x in (10, 20, 50, 80)), tuple(F.lit(float(x)) for x in (14, 18, 61, 90))
    point = (F.lit(30.0), F.lit(50.0))
    trips = [
        bx.decode_delta(a, bx.encode_delta(a, b, stds=(0.1, 0.1, 0.2, 0.2)), stds=(0.1, 0.1, 0.2, 0.2)),
        bx.decode_tblr(a, bx.encode_tblr(a, b)),
        bx.decode_yolo(a, bx.encode_yolo(a, b, 32), 32),
        bx.distance_to_box(point, bx.box_to_distance(point, b)),
        bx.from_cxcywh(bx.to_cxcywh(b)),
        bx.flip(bx.flip(b, F.lit(99.0), F.lit(99.0), "diagonal"), F.lit(99.0), F.lit(99.0), "diagonal")
    ]
    row = one(spark, **{f"c{i}": F.array(*t) for i, t in enumerate(trips)})
    assert all(row[i] == pytest.approx([14, 18, 61, 90]) for i in range(len(trips)))


def test_box_functions(spark):
    a, b = tuple(F.lit(float(x)) for x in (0, 0, 10, 10)), tuple(F.lit(float(x)) for x in (5, 5, 15, 15))
    far = tuple(F.lit(float(x)) for x in (20, 0, 30, 10))
    row = one(
        spark,
        i=bx.iou(a, b),
        p=bx.iou(a, b, pixel=1),
        f=bx.iou(a, b, "iof"),
        g=bx.iou(a, far, "giou"),
        n=bx.interval_iou(a, b),
        z=bx.ltwh_iou(a, tuple(F.lit(None).cast("double") for _ in range(4))), r=F.array(
            *bx.public_box(tuple(F.lit(x) for x in (0.5, 1.5, 200.0, 9.0)), F.lit(100.0), F.lit(100.0))
        ),
        v=F.array(*bx.gaze_vector(*bx.gaze_angles(F.lit(0.0), F.lit(0.6), F.lit(0.8))))
    )
    assert row["i"] == pytest.approx(25 / 175) and row["p"] == pytest.approx(36 / 206) and row["f"] == 0.25 and row["n"] == pytest.approx(25 / 175)
    assert row["g"] == pytest.approx(-100 / 300) and row["z"] == 0.0 and row["r"] == [0, 2, 100, 9] and row["v"] == pytest.approx([0.0, 0.6, 0.8])
    assert bx.anchors(16, [1.0], [8.0]) == [(-56.0, -56.0, 71.0, 71.0)]


# clusters and training sets


def test_dbscan_border_and_noise(spark):
    def at(deg):
        return [math.cos(math.radians(deg)), math.sin(math.radians(deg))]

    degrees = {1: 0, 2: 5, 3: 10, 4: 30, 5: 90, 6: 95, 7: 100, 8: 200, 9: 60}
    v = spark.createDataFrame([(i, at(x)) for i, x in degrees.items()], "id long, embedding array<double>")
    got = {x["id"]: x["cluster"] for x in clustering.dbscan(v, math.cos(math.radians(21)), 3).collect()}
    near = {i: [j for j in degrees if abs(degrees[i] - degrees[j]) <= 21] for i in degrees}
    core = {i for i in degrees if len(near[i]) >= 3}
    assert core == {1, 2, 3, 5, 6, 7} and got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 5, 8: -1, 9: -1}


@pytest.mark.parametrize("block_bytes", [256, 1 << 20])
def test_dbscan_matches_plain_code(spark, block_bytes):
    r = np.random.default_rng(6)
    x = r.normal(size=(90, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    core = near.sum(axis=1) >= 5
    label = {i: i for i in range(90) if core[i]}
    for _ in range(90):
        label = {i: min(label[j] for j in label if near[i, j]) for i in label}
    want = {i: label.get(i, min((label[j] for j in label if near[i, j]), default=-1)) for i in range(90)}
    v = spark.createDataFrame([(i, x[i].tolist()) for i in range(90)], "id long, embedding array<double>").repartition(3)
    got = {y["id"]: y["cluster"] for y in clustering.dbscan(v, 0.9, 5, block_bytes).collect()}
    assert got == want and -1 in want.values() and len(set(want.values())) > 2


def test_two_clusters_and_albums(spark):
    v = spark.createDataFrame(
        [(0, 7, [1.0, 0.0]), (1, 7, [0.98, 0.08]), (2, 8, [0.0, 1.0]), (3, 9, [0.08, 0.98]), (4, 9, [-1.0, 0.0])],
        "id long, photo long, embedding array<double>"
    )
    clusters = clustering.numbered(clustering.dbscan(v.select("id", "embedding"), 0.9, 2))
    assert {x["id"]: x["album"] for x in clusters.collect()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}
    assert [(x["album"], x["faces"], x["photos"]) for x in clustering.albums(clusters, v).collect()] == [(0, 2, 1), (1, 2, 2), (2, 1, 1)]


def test_triplets_are_semi_hard(spark):
    r = np.random.default_rng(0)
    rows = [(i, i % 4, (r.normal(size=3) + i % 4).tolist()) for i in range(24)]
    vectors = spark.createDataFrame(rows, "id long, label long, embedding array<double>")
    got = training.semi_hard_triplets(training.in_batches(vectors, 100), 2.0).collect()
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(rows[a][2], rows[b][2], strict=True))
    assert got and all(
        rows[t["a_id"]][1] == rows[t["p_id"]][1] != rows[t["n_id"]][1] and 0 < d(t["a_id"], t["n_id"]) - d(t["a_id"], t["p_id"]) < 2.0 for t in got
    )


def test_samplers(spark):
    rows = spark.createDataFrame([(i, i % 3 if i < 30 else 9) for i in range(31)], "id long, label long")
    assert {
        (x["label"], x["count"]) for x in training.identity_balanced(rows, 4).groupBy("label").count().collect()
    } == {(0, 4), (1, 4), (2, 4), (9, 4)}
    chosen = training.class_centre_sample(rows, rows.where("label = 9"), 2).collect()
    assert len(chosen) == 2 and 9 in {x["label"] for x in chosen} and {x["position"] for x in chosen} == {0, 1}


def test_noise_is_replaced_the_same_way_twice(spark):
    f = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.8, 0.6]), (1, 3, [0.0, -1.0])], "class long, id long, embedding array<double>")
    a, b = (sorted(map(str, templates.replace_noise(f, f.where("id = 3").select("id")).collect())) for _ in range(2))
    assert a == b
    moved = templates.replace_noise(f, f.where("id = 3").select("id")).where("id = 3").first()["embedding"]
    assert moved == pytest.approx([1.8 / math.hypot(1.8, 0.6), 0.6 / math.hypot(1.8, 0.6)], abs=5e-3)


# store


def test_cursor_is_signed_and_scoped():
    cursor = store.sign_cursor(b"k", "persons", "p9")
    assert store.read_cursor(b"k", "persons", cursor) == "p9"
    for scope, text in (("faces", cursor), ("persons", cursor[:-2] + "AA"), ("persons", "x")):
        with pytest.raises(ValueError, match="cursor"):
            store.read_cursor(b"k", scope, text)


def test_ids_have_no_gaps(spark):
    rows = spark.createDataFrame([(f"n{i}",) for i in range(500)], "name string")
    got = store.allocate_ids(rows, [F.col("name")], 100, buckets=7).collect()
    assert sorted(x["id"] for x in got) == list(range(101, 601))


def test_replay_honours_clear(spark):
    feed = spark.createDataFrame(
        [(1, "add", 1), (2, "add", 2), (3, "clear", None), (4, "add", 3), (5, "add", 4), (6, "delete", 4), (7, "add", 1)],
        "seq long, op string, vector_id long"
    )
    assert sorted(x["vector_id"] for x in store.replay(feed).collect()) == [1, 3]


def test_roots_match_whole_folders(spark):
    media = spark.createDataFrame([("/a/b/c.jpg",), ("/a/bc/d.jpg",), ("/x/y.jpg",)], "path string")
    got = store.under_roots(media, spark.createDataFrame([("/a/b/",), ("/x",)], "root string")).collect()
    assert sorted(x["path"] for x in got) == ["/a/b/c.jpg", "/x/y.jpg"]


def test_subject_must_be_enrolled_once(spark):
    gallery = spark.createDataFrame([(1, 10), (2, 20), (3, 20)], "template long, subject long")
    probes = spark.createDataFrame([(10,)], "subject long")
    assert templates.gallery_positions(gallery, probes).first()["position"] == 1
    with pytest.raises(Exception, match="once"):
        templates.gallery_positions(gallery, spark.createDataFrame([(20,)], "subject long")).collect()


def test_scalar_text(spark):
    row = one(
        spark,
        u=sc.redact_url(F.lit("rtsp://user:pw@host:554/live?key=1")),
        t=sc.hhmmss(F.lit(3_723_000)),
        f=sc.far_label(F.lit(1e-4)),
        i=sc.valid_id(F.lit("-x")),
        r=sc.first_reason([("a", F.lit(False)), ("b", F.lit(True))])
    )
    assert tuple(row) == ("rtsp://host:554/live", "01:02:03", "1e-4", False, "b")


# monitors


RULES = monitor.Rules(confirm_frames=2, absence_seconds=5.0, cooldown_seconds=0.0)


def dets(spark, rows):
    return spark.createDataFrame(
        [(m, float(s), i, p, x, 0.2, 0.3, 0.3) for i, (m, s, p, x) in enumerate(rows)],
        "monitor long, seconds double, face long, person long, left double, top double, width double, height double"
    )


def events_of(df):
    return [(x["type"], x["seconds"], x["person"]) for x in df.orderBy("monitor", "sequence").collect()]


def test_confirm_change_and_absence(spark):
    rows = [(1, 0, 7, 0.1), (1, 1, 7, 0.1), (1, 2, 8, 0.8), (1, 3, 7, 0.1), (1, 9, 7, 0.1)]
    assert events_of(monitor.monitor_events(dets(spark, rows), RULES)) == [("person_enter", 1.0, 7)]
    rows = [(1, 0, 7, 0.1), (1, 1, 7, 0.1), (1, 2, None, 0.1), (1, 3, None, 0.1), (1, 20, 9, 0.9)]
    assert events_of(monitor.monitor_events(dets(spark, rows), RULES)) == [
        ("person_enter", 1.0, 7), ("person_exit", 2.0, 7), ("unknown_enter", 3.0, None), ("unknown_exit", 20.0, None)
    ]


def test_cooldown_keeps_the_clock_and_numbers(spark):
    m = monitor.Monitor(monitor.Rules(confirm_frames=1, absence_seconds=1.0, cooldown_seconds=10.0))
    out = []
    for now in (0.0, 3.0, 6.0, 10.0):
        out += m.frame(now, [(5, [0.1, 0.1, 0.2, 0.2])])
        out += m.frame(now + 1.5, [])
    assert [(e[0], e[1], e[2]) for e in out] == [
        (1, "person_enter", 0.0), (2, "person_exit", 1.5), (3, "person_enter", 10.0), (4, "person_exit", 11.5)
    ]


def test_stream_gives_the_events_of_the_table(spark, tmp_path):
    rows = [(m, s, (m if s % 7 else None), 0.1 + 0.01 * (s % 3)) for m in (1, 2) for s in [*range(0, 12), *range(30, 42)]]
    table = dets(spark, rows).withColumn("at", F.timestamp_seconds("seconds"))
    table.repartition(1).sortWithinPartitions("seconds").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = monitor.monitor_stream(stream, RULES).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")
    ).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    got = events_of(spark.read.parquet(str(tmp_path / "out")))
    want = events_of(monitor.monitor_events(table, RULES))
    assert got[: len(want)] == want


def test_event_page_tells_what_was_lost(spark):
    e = spark.createDataFrame([(i, "x") for i in range(1, 6)], "sequence long, type string")
    page = monitor.event_page(e, 3, 1, 10).collect()
    assert [x["sequence"] for x in page] == [3, 4, 5] and all(x["truncated"] and not x["has_more"] for x in page)
    assert [x["sequence"] for x in monitor.event_page(e, 3, None, 2).collect()] == [4, 5]


def test_tracker_keeps_identities_through_a_gap():
    t = tracking.Tracker()
    seen = []
    for k in range(12):
        a, b = [10 + 2 * k, 10, 40 + 2 * k, 50], [200 - 2 * k, 100, 240 - 2 * k, 160]
        found = [a, b] if k != 6 else [b]
        scores = [0.9, 0.3 if k == 8 else 0.8] if k != 6 else [0.8]
        seen.append({tr: box for tr, _, box in t.frame(np.array(found, float), np.array(scores))})
    assert set(seen[-1]) == {1, 2} and set(seen[6]) == {2} and set(seen[8]) == {1, 2}
    assert seen[-1][1] == pytest.approx([32, 10, 62, 50], abs=1.5)


def test_rate_limit_and_latest_frame(spark):
    f = spark.createDataFrame([(1, s / 10, s) for s in range(30)], "monitor long, seconds double, seq long")
    assert [x["seq"] for x in monitor.rate_limited(f, 2.0).orderBy("seq").collect()] == [0, 5, 10, 15, 20, 25]
    assert [(x["seq"], x["skipped"]) for x in monitor.latest_frames(f, 1.0).orderBy("slot").collect()] == [(9, 9), (19, 9), (29, 9)]


# sources


def test_text_sources(spark, tmp_path):
    (tmp_path / "label.txt").write_text(
        "# a/1.jpg 640 480\n10 20 50 80\n1 1 4 4\n# a/2.jpg 10 10\n" + " ".join(
            ["5", "5", "9", "9"] + ["6", "6", "0"] * 4 + ["-1", "-1", "-1"]
        ) + "\n"
    )
    got = files.read_face_labels(files.read_lines(spark, str(tmp_path / "label.txt")), least=10).orderBy("image", "box").collect()
    assert [(x["image"], x["width"], x["x2"], x["ignore"]) for x in got] == [
        ("a/1.jpg", 640, 50.0, False), ("a/1.jpg", 640, 4.0, True), ("a/2.jpg", 10, 9.0, True)
    ]
    assert got[0]["landmarks"] is None and [p["weight"] for p in got[2]["landmarks"]] == [1.0, 1.0, 1.0, 1.0, 0.0]
    (tmp_path / "wider.txt").write_text("0--Parade/x.jpg\n2\n1 2 3 4 0 0\n5 6 7 8 0 0\n1--Fire/y.jpg\n1\n9 9 2 2 0 0\n")
    got = files.read_face_boxes(files.read_lines(spark, str(tmp_path / "wider.txt"))).orderBy("image", "box").collect()
    assert [(x["image"], x["x1"], x["x2"]) for x in got] == [
        ("0--Parade/x.jpg", 1.0, 4.0), ("0--Parade/x.jpg", 5.0, 12.0), ("1--Fire/y.jpg", 9.0, 11.0)
    ]
    (tmp_path / "marks.txt").write_text("1.jpg " + " ".join(str(i) for i in range(10)) + " 0.99\n")
    assert files.read_landmarks(spark, str(tmp_path / "marks.txt")).first()["landmarks"][1] == [2.0, 3.0]
    (tmp_path / "pairs.csv").write_bytes(b"\xef\xbb\xbfimage1_path,image2,label\na,b,1\nc,d,\n")
    assert [tuple(x) for x in files.read_pairs_csv(spark, str(tmp_path / "pairs.csv")).collect()] == [("a", "b", 1), ("c", "d", 0)]


def test_annotation_sources(spark, tmp_path):
    (tmp_path / "coco.json").write_text(
        '{"images":[{"id":1,"file_name":"a.jpg","width":9,"height":9}],"annotations":[{"id":5,"image_id":1,"category_id":7,"bbox":[1,2,3,4],"area":12,"iscrowd":0},{"id":6,"image_id":1,"category_id":3,"bbox":[1,2,0,4],"area":0}],"categories":[{"id":7,"name":"x"},{"id":3,"name":"y"}]}'
    )
    images, found = files.read_coco(spark, str(tmp_path / "coco.json"))
    assert images.count() == 1 and [(x["image"], x["class"], x["x2"], x["ignore"]) for x in found.collect()] == [(1, 1, 4.0, False)]
    (tmp_path / "voc.xml").write_text(
        "<annotation><filename>a.jpg</filename><object><name>cat</name><difficult>1</difficult><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object><object><name>dog</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object></annotation>"
    )
    assert [
        (x["image"], x["class"], x["x1"], x["ignore"]) for x in files.read_voc(spark, str(tmp_path / "voc.xml"), ["cat"]).collect()
    ] == [("a.jpg", 0, 0.0, True)]
    (tmp_path / "f.bin").write_bytes(np.array([1, 3, 4, 5], "<i4").tobytes() + np.array([1, 2, 3], "<f4").tobytes())
    assert files.read_feature_files(spark, str(tmp_path)).first()["embedding"] == [1.0, 2.0, 3.0]


def test_folders_and_exports(spark, tmp_path):
    for p in ("0001/gallery.jpg", "0001/probe.PNG", "unknown/x.jpg", "0001/notes.txt"):
        (tmp_path / "set" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "set" / p).write_bytes(b"x")
    got = files.identity_layout(files.list_images(spark, str(tmp_path / "set"))).collect()
    assert {(x["identity"], x["name"], x["role"]) for x in got} == {
        ("0001", "gallery.jpg", "gallery"), ("0001", "probe.PNG", "probe"), ("unknown", "x.jpg", "unknown")
    }
    out = files.csv_ready(spark.createDataFrame([(1, [1, 2])], "b int, a array<int>"), spark.createDataFrame([("x",)], "c string"))
    assert out.columns == ["a", "b", "c"] and sorted(map(tuple, out.collect()), key=str) == [("[1,2]", 1, None), (None, None, "x")]
    truth = files.match_truth(
        spark.createDataFrame([("/a/x.jpg",), ("/b/y.jpg",)], "path string"),
        spark.createDataFrame([("/a/x.jpg", "X"), ("y.jpg", "Y")], "path string, identity string")
    )
    assert sorted(x["identity"] for x in truth.collect()) == ["X", "Y"]
    report = files.markdown_report("R", spark.createDataFrame([("auc", 0.5), ("tar", None)], "metric string, value double"))
    assert "| auc | 0.5 |" in report and "insufficient data" in report


def test_record_files(spark, tmp_path):
    import struct

    def record(payload):
        return struct.pack("<II", 0xCED7230A, len(payload)) + payload + b"\0" * (-len(payload) % 4)

    one_label = struct.pack("<IfQQ", 0, 7.0, 3, 0) + b"image"
    two_labels = struct.pack("<IfQQ", 2, 0.0, 0, 0) + np.array([5, 9], "<f4").tobytes()
    (tmp_path / "a.rec").write_bytes(record(two_labels) + record(one_label))
    from lodestar.sources import records

    got = {x["id"]: (x["labels"], bytes(x["content"])) for x in records.read_records(spark, str(tmp_path)).collect()}
    assert got == {0: ([5.0, 9.0], b""), 3: ([7.0], b"image")}
    (tmp_path / "b.kv").write_bytes(struct.pack("<i", 1) + b"k" + struct.pack("<i", 3) + b"val")
    assert [(bytes(x["key"]), bytes(x["value"])) for x in records.read_pairs(spark, str(tmp_path)).collect()] == [(b"k", b"val")]
    df = spark.range(100).select("id", (F.col("id") % 5).alias("label"))
    records.write_records(df, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and back.select("shard").distinct().count() == 4


def test_face_quality(spark):
    points = F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((30, 40), (70, 40), (50, 58), (35, 80), (65, 80))])
    yaw, pitch, roll = sc.landmark_pose(points)
    row = one(
        spark,
        yaw=yaw,
        pitch=pitch,
        roll=roll,
        q=sc.server_quality(F.lit(0.9), F.lit(0.8), F.lit(0.5), F.lit(100.0), F.lit(80.0), yaw, pitch, roll),
        s=sc.sharpness(F.lit(100.0)),
        t=sc.trusted_vector(arr(3, 4), F.lit(2)),
        bad=sc.trusted_vector(arr(0, 0), F.lit(2)),
        f=sc.flags({"b": F.lit(True), "a": F.lit(True)})
    )
    assert (row["yaw"], row["roll"]) == (0.0, 0.0) and row["pitch"] == pytest.approx(0.0, abs=1e-9)
    assert row["q"] == pytest.approx(0.35 * 0.9 + 0.25 * 0.8 + 0.4) and row["s"] == pytest.approx(1 - math.exp(-1))
    assert row["t"] == [0.6, 0.8] and row["bad"] is None and row["f"] == ["a", "b"]


def test_feature_hub_and_frames(spark):
    hub = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, [0.0, 1.0])], "vector_id long, person_id long, embedding array<double>")
    q = spark.createDataFrame(
        [(10, 1, 50.0, [0.9, 0.1]), (11, 1, 80.0, [-1.0, 0.0]), (12, 1, 10.0, [0.0, 1.0])],
        "query_id long, frame long, area double, embedding array<double>"
    )
    assert [
        (x["query_id"], x["vector_id"]) for x in search.hub_top1(q, hub, 0.5).orderBy("query_id").collect()
    ] == [(10, 1), (11, -1), (12, 2)]
    got = search.frame_search(q, hub, 2, 0.5).orderBy("place").collect()
    assert [(x["query_id"], x["person_id"], x["status"]) for x in got] == [(11, None, "unknown"), (10, 1, "matched")]


def test_change_feed_is_consumed_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(i, "add", i) for i in range(10)], "seq long, op string, vector_id long")
    rows.write.parquet(str(tmp_path / "feed"))
    seen = []
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "feed"))
    for _ in range(2):  # the second run finds everything acknowledged
        query = monitor.consume_feed(stream, lambda df, k: seen.extend(r["seq"] for r in df.collect()), str(tmp_path / "cp"))
        assert query.awaitTermination(120)
    assert seen == list(range(10))
