"""Registered queries that SQL cannot express, and operators with literal cases, against plain code."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import vectors
from lodestar.operators import assignment, detection, detection_eval, evaluation, search, store
from lodestar.operators.cumulative import running_totals
from lodestar.operators.detection import iou_matrix
from lodestar.plans import fixtures as fx
from lodestar.plans.queries import QUERIES, RULES
from lodestar.sources import files
from lodestar.streaming import monitor, tracking

SF = "/root/testdata/sf0.001"


def overlap(a, b):
    w, h = (max(0.0, min(a[k] + a[k + 2], b[k] + b[k + 2]) - max(a[k], b[k])) for k in (0, 1))
    return w * h / (a[2] * a[3] + b[2] * b[3] - w * h)


def test_r3_equals_a_plain_simulation(spark):
    want = defaultdict(list)
    frames = defaultdict(lambda: defaultdict(list))
    for x in fx.frames(spark, SF).collect():
        frames[x["monitor"]][x["seconds"]].append((x["face"], x["person"], (x["left"], x["top"], x["width"], x["height"])))
    for m, instants in frames.items():
        live, last_sent, count = {}, {}, 0

        def send(kind, track, person, now, m=m, last_sent=last_sent):
            key = (kind, person is None, track if person is None else person)
            if key in last_sent and now - last_sent[key] < RULES.cooldown_seconds:
                return
            last_sent[key] = now
            want[m].append((("unknown_" if person is None else "person_") + kind, now, track, person))

        for now in sorted(instants):
            taken = set()
            for _, person, box in sorted(instants[now]):
                ranked = sorted(
                    (-overlap(t["box"], box), n) for n, t in live.items() if n not in taken and (
                        None in (person, t["person"]) or person == t["person"]
                    )
                )
                if ranked and -ranked[0][0] > RULES.least_iou:
                    n = ranked[0][1]
                    t = live[n]
                    if t["person"] != person:
                        if t["sure"]:
                            send("exit", n, t["person"], now)
                        t.update(person=person, run=0, sure=False)
                else:
                    count += 1
                    n = count
                    t = live[n] = {"person": person, "run": 0, "sure": False}
                taken.add(n)
                t.update(box=box, seen=now, run=t["run"] + 1)
                if not t["sure"] and t["run"] >= RULES.confirm_frames:
                    t["sure"] = True
                    send("enter", n, person, now)
            for n in [n for n, t in live.items() if now - t["seen"] >= RULES.absence_seconds]:
                t = live.pop(n)
                if t["sure"]:
                    send("exit", n, t["person"], now)
    got = defaultdict(list)
    for x in QUERIES["r3_monitor_events"](spark, SF).orderBy("monitor", "sequence").collect():
        got[x["monitor"]].append((x["type"], x["seconds"], x["track"], x["person"]))
        assert x["sequence"] == len(got[x["monitor"]])
    assert got == want and sum(map(len, want.values())) > 20


def test_folds_take_rows_in_any_batches(spark):
    detections, seen = fx.frames(spark, SF), []
    for rows in ("3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        events = sorted(map(str, monitor.monitor_events(detections, RULES).collect()))
        tracks = sorted(map(str, tracking.track_boxes(fx.track_frames(spark, SF).where("video < 4")).collect()))
        seen.append((events, tracks))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert seen[0] == seen[1] and all(seen[0])


def test_r10_equals_one_tracker_a_video(spark):
    rows = defaultdict(lambda: defaultdict(list))
    for x in fx.track_frames(spark, SF).orderBy("det").collect():
        rows[x["video"]][x["frame"]].append([x[c] for c in ("x1", "y1", "x2", "y2", "score")])
    want = []
    for video, own in rows.items():
        tracker = tracking.Tracker()
        for frame in sorted(own):
            m = np.array(own[frame])
            want += [(video, frame, t, *np.round([*b, s], 6)) for t, s, b in tracker.frame(m[:, :4], m[:, 4])]
    got = [
        (
            x["video"], x["frame"], x["track"], *(x[c] for c in ("x1", "y1", "x2", "y2", "score"))
        ) for x in QUERIES["r10_track_boxes"](spark, SF).collect()
    ]
    assert len(got) == len(want) and np.allclose(np.array(sorted(got), dtype=float), np.array(sorted(want), dtype=float), atol=2e-6)


def test_x9_hungarian_is_least_in_total(spark):
    dets, gts, to = defaultdict(dict), defaultdict(dict), defaultdict(dict)
    for x in fx.detections(spark, SF).collect():
        dets[x["image"]][x["det"]] = [x[c] for c in detection.BOX]
    for x in fx.truths(spark, SF).collect():
        gts[x["image"]][x["gt"]] = [x[c] for c in detection.BOX]
    for x in QUERIES["x9_hungarian_assign"](spark, SF).collect():
        to[x["image"]][x["det"]] = x["assigned"]
    assert to.keys() == dets.keys()
    for image, own in dets.items():
        assert to[image].keys() == own.keys()
        d, g = sorted(own), sorted(gts[image])
        if not g or len(g) > 12:
            continue
        near = iou_matrix(np.array([own[k] for k in d]), np.array([gts[image][k] for k in g]), eps=1e-6)
        best = np.full(1 << len(g), np.inf)  # by the set of truths that have a box
        best[0] = 0.0
        sets = np.arange(1 << len(g))
        for row in near:
            after = best.copy()
            for j, v in enumerate(row):
                free = sets[(sets >> j & 1) == 0]
                np.minimum.at(after, free | 1 << j, best[free] + 1 - v)
            best = after
        chosen = [(d.index(k), g.index(v)) for k, v in to[image].items() if v >= 0]
        assert len({j for _, j in chosen}) == len(chosen) == min(len(d), len(g))
        assert sum(1 - near[i, j] for i, j in chosen) == pytest.approx(
            best[-1] if len(d) >= len(g) else min(best[s] for s in sets if bin(s).count("1") == len(d))
        )


def test_a25_equals_plain_matching(spark):
    """All sizes, threshold 0.5: ignored truths are crowds, matched over the detection's own area and never used up."""
    dets, gts = defaultdict(list), defaultdict(list)
    for x in fx.detections(spark, SF).collect():
        dets[x["class"], x["image"]].append((-x["score"], x["det"], [x[c] for c in detection.BOX]))
    for x in fx.truths(spark, SF).collect():
        gts[x["class"], x["image"]].append((x["gt"], [x[c] for c in detection.BOX], x["ignore"]))
    ap, top = {}, {}
    for c in {k[0] for k in gts}:
        marks, n = [], sum(not t[2] for k, own in gts.items() if k[0] == c for t in own)
        for (_, image), own in ((k, v) for k, v in dets.items() if k[0] == c):
            used, truths = set(), sorted(gts[c, image])
            for score, det, box in sorted(own)[:100]:
                found = None
                for wanted in (False, True):
                    for gt, other, crowd in truths:
                        if crowd != wanted or gt in used:
                            continue
                        w, h = (max(0.0, min(box[k + 2], other[k + 2]) - max(box[k], other[k])) for k in (0, 1))
                        size = lambda b: (b[2] - b[0]) * (b[3] - b[1])
                        v = w * h / (size(box) if crowd else size(box) + size(other) - w * h)
                        if v >= 0.5 and (found is None or v >= found[0]):
                            found = (v, gt, crowd)
                    if found:
                        break
                if found and not found[2]:
                    used.add(found[1])
                if not (found and found[2]):
                    marks.append((score, image, det, found is not None))
        hits = np.cumsum([m[3] for m in sorted(marks)])
        recall, precision = hits / n, hits / np.arange(1, len(hits) + 1)
        ap[c] = np.mean([max(precision[recall >= t - 1e-9], default=0.0) for t in np.linspace(0, 1, 101)])
        top[c] = recall[-1]
    got = QUERIES["a25_coco_summary"](spark, SF).where("area = 'all' and threshold = 0.5").first()
    assert got["ap"] == pytest.approx(np.mean(list(ap.values())), abs=2e-6) and got["recall"] == pytest.approx(
        np.mean(list(top.values())), abs=2e-6
    )


@pytest.mark.parametrize("rows", [40, 10_000])
def test_running_totals_of_ties_and_keys(spark, rows):
    r = np.random.default_rng(2)
    data = [
        (int(k), float(s), i, int(v)) for i, (k, s, v) in enumerate(
            zip(r.integers(0, 3, 900), r.choice([1.0, 2.0, 2.0, 2.0, 3.5], 900), r.integers(0, 9, 900), strict=True)
        )
    ]
    df = spark.createDataFrame(data, "k long, s double, i long, v long").repartition(5)
    for descending in (True, False):
        got = {
            x["i"]: (x["v_to_here"], x["v_most"]) for x in running_totals(
                df.withColumn("m", F.col("v")), "s", ["v"], descending, ["k"], ["i"], ["m"], part_rows=rows
            ).withColumnRenamed("m_to_here", "v_most").collect()
        }
        total, most = defaultdict(int), defaultdict(int)
        for k, _, i, v in sorted(data, key=lambda x: (-x[1] if descending else x[1], x[2])):
            total[k] += v
            most[k] = max(most[k], v)
            assert got[i] == (total[k], most[k])


def test_gallery_ties_go_to_what_was_seen_first(spark):
    gallery = spark.createDataFrame(
        [(1, 20, [1.0, 0.0]), (2, 10, [2.0, 0.0]), (3, 30, [0.0, 1.0]), (4, 10, [1.0, 0.0]), (5, 40, None)],
        "vector_id long, person_id long, embedding array<double>"
    )
    probe = spark.createDataFrame([(7, [3.0, 0.0])], "query_id long, embedding array<double>")
    got = [
        (
            x["rank"], x["person_id"], x["vector_id"], x["score"], x["status"]
        ) for x in search.search_gallery(probe, gallery, 0, 0.5).collect()
    ]
    assert got == [(1, 20, 1, 1.0, "matched")]
    got = [
        (x["person_id"], x["vector_id"], x["status"]) for x in search.search_gallery(probe, gallery, None, 0.5).orderBy("rank").collect()
    ]
    assert got == [(20, 1, "matched"), (10, 2, "matched"), (30, 3, "below_threshold")]


def test_faces_are_inserted_whole_or_not_at_all(spark):
    have = spark.createDataFrame([(1, 5), (2, 5)], "sample_id long, person_id long")
    new = spark.createDataFrame([(1, 9), (2, 5), (3, 9)], "position long, person_id long")
    rows, feed = store.insert_faces(new, have, 10, 3, 2, 4, 6)
    assert sorted((x["vector_id"], x["person_id"]) for x in rows.collect()) == [(3, 9), (4, 5), (5, 9)]
    assert sorted(map(tuple, feed.collect())) == [(7, 5, "add", 3, 9), (8, 6, "add", 4, 5), (9, 5, "add", 5, 9)]
    for capacity, most in ((4, 9), (10, 2)):
        with pytest.raises(ValueError, match="limit"):
            store.insert_faces(new, have, capacity, most, 2, 4, 6)
    hub = spark.createDataFrame([(4, [1.0]), (9, [2.0])], "id long, embedding array<double>")
    with pytest.raises(ValueError, match="taken"):
        store.hub_insert(hub, spark.createDataFrame([(9, [3.0])], "id long, embedding array<double>"), auto=False)
    assert {
        x["id"]: x["embedding"] for x in store.hub_get(hub, spark.createDataFrame([(4,), (5,)], "id long")).collect()
    } == {4: [1.0], 5: None}


def test_access_control_of_no_hits(spark):
    probes = spark.createDataFrame([(1, 5), (2, None), (3, 6)], "query_id long, truth long")
    hits = spark.createDataFrame([(1, 1, 4, 0.9), (1, 2, 5, 0.8), (2, 1, 4, 0.3)], "query_id long, rank int, person_id long, score double")
    got = evaluation.access_control(probes, hits, 0.5).first()
    assert tuple(got) == (3, 0.0, 0.5, pytest.approx(2 / 3))
    none = evaluation.roc_auc(spark.createDataFrame([(1, 0.5), (1, 0.7)], "label int, score double")).first()
    assert none["auc"] is None


def test_decoding_is_bounded(spark):
    def ppm(raw):
        head, size, _, body = raw.split(b"\n", 3)
        w, h = map(int, size.split())
        assert head == b"P6"
        return np.frombuffer(body, np.uint8).reshape(h, w, 3)

    image = b"P6\n2 1\n255\n" + bytes(range(6))
    rows = [("a", image), ("b", b""), ("c", None), ("d", b"x" * 500), ("e", b"P6\nbad"), ("f", b"P6\n30 3\n255\n" + bytes(270))]
    got = files.decode_images(
        spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in rows], "path string, content binary"), ppm, 400, 50
    ).orderBy("path").collect()
    assert [x["status"] for x in got] == ["ok", "empty", "empty", "too_large", "not_an_image", "too_many_pixels"]
    assert (got[0]["height"], got[0]["width"], bytes(got[0]["pixels"])) == (1, 2, bytes(range(6))) and got[5]["pixels"] is None


def test_annotation_dialects(spark, tmp_path):
    (tmp_path / "lvis.json").write_text(
        '{"images":[{"id":1,"coco_url":"http://x/val/7.jpg","width":9,"height":9,"neg_category_ids":[4],"not_exhaustive_category_ids":[]}],"annotations":[{"id":5,"image_id":1,"category_id":8,"bbox":[1,2,3,4],"area":12},{"id":6,"image_id":1,"category_id":4,"bbox":[1,2,0.5,4],"area":2}],"categories":[{"id":8,"name":"b","frequency":"r"},{"id":4,"name":"a","frequency":"f"}]}'
    )
    images, boxes, categories = files.read_lvis(spark, str(tmp_path / "lvis.json"))
    assert images.first()["file_name"] == "7.jpg" and images.first()["neg_category_ids"] == [4]
    assert [tuple(x)[:7] for x in boxes.collect()] == [(1, 1, 5, 1.0, 2.0, 4.0, 6.0)] and {
        x["class"]: x["frequency"] for x in categories.collect()
    } == {0: "f", 1: "r"}
    (tmp_path / "city.json").write_text(
        '{"images":[{"id":1,"file_name":"train/ulm/1.png"},{"id":2,"file_name":"train/jena/2.png"}],"annotations":[{"id":5,"image_id":1,"category_id":3,"bbox":[1,2,3,4],"area":12,"iscrowd":0},{"id":6,"image_id":2,"category_id":3,"bbox":[1,2,3,4],"area":12,"iscrowd":1}],"categories":[{"id":3,"name":"car"}]}'
    )
    images, boxes = files.read_cityscapes(spark, str(tmp_path / "city.json"))
    assert [(x["id"], x["city"]) for x in images.collect()] == [(1, "ulm")] and boxes.count() == 2
    (tmp_path / "a.xml").write_text(
        "<annotation><filename>a.jpg</filename><object><name>face</name><bndbox><xmin>1</xmin><ymin>1</ymin><xmax>5</xmax><ymax>31</ymax></bndbox></object><object><name>face</name><bndbox><xmin>1</xmin><ymin>1</ymin><xmax>51</xmax><ymax>31</ymax></bndbox></object></annotation>"
    )
    assert sorted(x["ignore"] for x in files.read_voc(spark, str(tmp_path / "a.xml"), ["face"], 10.0).collect()) == [False, True]
    pairs = files.verification_pairs(
        spark.createDataFrame([(i, bytearray([i])) for i in range(5)], "idx long, content binary"),
        spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "pair_idx long, label int")
    )
    assert sorted(
        (x["pair_idx"], bytes(x["first"]), bytes(x["second"])) for x in pairs.collect()
    ) == [(0, b"\x00", b"\x01"), (1, b"\x02", b"\x03")]


def test_checked_cosine_refuses_other_sizes(spark):
    good = spark.createDataFrame([([3.0, 0.0], [5.0, 0.0])], "a array<double>, b array<double>")
    assert good.select(vectors.checked_cosine(F.col("a"), F.col("b"))).first()[0] == 1.0
    bad = spark.createDataFrame([([3.0, 0.0], [5.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="differ in size"):
        bad.select(vectors.checked_cosine(F.col("a"), F.col("b"))).collect()


def test_hard_examples_leave_ignored_boxes_out(spark):
    rows = spark.createDataFrame(
        [(1, k, a, float(k)) for k, a in enumerate([3, -1, None, -1, 5, None])], "image long, det long, assigned long, loss double"
    )
    assert sorted((x["det"], x["assigned"]) for x in assignment.hard_sample(rows, 3, 0.34).collect()) == [(1, -1), (3, -1), (4, 5)]


def test_settings_are_evaluated_apart(spark):
    gts = spark.createDataFrame(
        [(1, 0, 1, 0.0, 0.0, 10.0, 10.0, True, True), (1, 0, 2, 50.0, 0.0, 90.0, 40.0, False, True)],
        "image long, class long, gt long, x1 double, y1 double, x2 double, y2 double, easy boolean, hard boolean"
    )
    dets = spark.createDataFrame(
        [(1, 0, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 0, 2, 200.0, 0.0, 240.0, 40.0, 0.1)],
        "image long, class long, det long, x1 double, y1 double, x2 double, y2 double, score double"
    )
    got = {x["setting"]: x["ap"] for x in detection_eval.face_ap_settings(dets, gts, ["easy", "hard"]).collect()}
    assert got == {"easy": pytest.approx(1.0), "hard": pytest.approx(0.5)}


def test_pdf_reports_point_at_their_objects(spark):
    metrics = spark.createDataFrame([(f"m{i} (x)", None if i == 2 else i / 3) for i in range(100)], "metric string, value double")
    raw = files.pdf_report("Report \\ \u0416", metrics)
    start = int(raw.rsplit(b"startxref\n", 1)[1].split()[0])
    entries = raw[start:].split(b"\n")[3:]
    offsets = [int(e[:10]) for e in entries if e.endswith(b"n ")]
    assert raw.startswith(b"%PDF-1.4") and len(offsets) == 9 and raw.count(b"/Type /Page ") == 3
    assert all(raw[o:].startswith(f"{i} 0 obj".encode()) for i, o in enumerate(offsets, 1))
    assert b"(Report \\\\ ?) Tj" in raw and b"(m2 \\(x\\): insufficient data) Tj" in raw


def test_keypoint_and_partly_marked_summaries(spark):
    sigmas = [0.1, 0.05]
    gts = spark.createDataFrame(
        [(1, 0, 1, 0.0, 0.0, 40.0, 40.0, [5.0, 5.0, 2.0, 30.0, 30.0, 1.0]), (1, 0, 2, 60.0, 0.0, 100.0, 40.0, [0.0] * 6)],
        "image long, class long, gt long, x1 double, y1 double, x2 double, y2 double, points array<double>",
    )
    found = [(1, 0, 1, 0.0, 0.0, 40.0, 40.0, 0.9, [5.0, 6.0, 30.0, 31.0]), (1, 0, 2, 60.0, 0.0, 99.0, 40.0, 0.8, [70.0, 5.0, 80.0, 9.0])]
    dets = spark.createDataFrame(found, "image long, class long, det long, x1 double, y1 double, x2 double, y2 double, score double, points array<double>")
    out = {(x["area"], x["threshold"]): x["ap"] for x in detection_eval.coco_summary(dets, gts, sigmas=sigmas).collect()}
    similar = (np.exp(-1 / 0.04 / 1600 / 2) + np.exp(-1 / 0.01 / 1600 / 2)) / 2
    assert all(out["all", t] == pytest.approx(float(similar >= t)) for t in detection_eval.THRESHOLDS) and similar > 0.95
    far = detection_eval.oks_matrix(np.array([[[5.0, 6.0], [300.0, 31.0]]]), np.zeros((1, 2, 3)), np.array([[0.0, 0, 40, 40]]), np.array(sigmas))
    assert far[0, 0] == pytest.approx((1 + np.exp(-(220.0**2) / 0.01 / 1600 / 2)) / 2)

    box = (0.0, 0.0, 40.0, 40.0)
    truths = spark.createDataFrame([(1, 0, 1, *box), (2, 1, 2, *box), (3, 2, 3, *box)], "image long, class long, gt long, x1 double, y1 double, x2 double, y2 double")
    # of class 0 one box is found, with a better one in an image known to lack it; of class 1 a better one where it is marked in part
    rows = [(1, 0, 1, *box, 0.5), (4, 0, 2, *box, 0.9), (2, 1, 3, *box, 0.5), (5, 1, 4, *box, 0.9), (4, 2, 5, *box, 0.9), (3, 2, 6, *box, 0.5)]
    dets = spark.createDataFrame(rows, "image long, class long, det long, x1 double, y1 double, x2 double, y2 double, score double")
    images = spark.createDataFrame([(4, [0], []), (5, [1], [1]), (1, [], [])], "image long, none array<long>, partly array<long>")
    kinds = spark.createDataFrame([(0, "r"), (1, "c"), (2, "f")], "class long, frequency string")
    got = {x["frequency"]: x["ap"] for x in detection_eval.lvis_summary(dets, truths, images, kinds).collect()}
    assert got == {"r": pytest.approx(0.5), "c": pytest.approx(1.0), "f": pytest.approx(1.0), "all": pytest.approx(2.5 / 3)}
