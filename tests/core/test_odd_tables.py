"""Registered queries over tables that the supplied ones have no case of."""

import functools
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.operators import cumulative, detection_eval, search
from lodestar.plans.queries import ORACLES, QUERIES
from lodestar.streaming import tracking


def test_j10_pages_of_one_address(spark, tmp_path):
    rows = [(0, "a"), (1, "a"), (2, "b"), (4, "b"), (5, "c"), (6, None), (9, None), (None, "d")]
    spark.createDataFrame(rows, "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.sql(ORACLES["j10_new_paths"]).fetchall(), key=str)
    got = QUERIES["j10_new_paths"](spark, str(tmp_path))
    assert got.columns == ["path"] and sorted(map(tuple, got.collect()), key=str) == want and len(want) == 4


@pytest.mark.parametrize("profile", ["int8", "int8_x736"])
def test_int8_search_makes_no_row_for_each_pair(spark, capsys, profile):
    r = np.random.default_rng(4)
    vectors = np.round(r.normal(size=(60, 8)) / 8, 2)
    vectors[20:40] = vectors[:20]  # ties
    rows = [(i, i % 7, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(99, 1, None)]
    gallery = spark.createDataFrame(rows, "vector_id long, person_id long, embedding array<float>")
    queries = gallery.where("vector_id % 5 = 0").select(F.col("vector_id").alias("query_id"), "embedding")
    blocks = search.grouped_topk(queries, gallery, 4, profile=profile)
    few = search.grouped_topk(queries, gallery, 4, profile=profile, block_bytes=256)
    pairs = search.grouped_topk(queries, gallery, 4, strategy="sql", profile=profile)
    want = sorted(map(tuple, pairs.collect()))
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, few.collect())) == want and len(want) == 48
    blocks.explain()
    assert not re.search("NestedLoop|Cartesian", capsys.readouterr().out)
    QUERIES["t2_grouped_topk_int8"](spark, "/root/testdata/sf0.001").explain()
    assert not re.search("NestedLoop|Cartesian", capsys.readouterr().out)


def plain_match(near, ignored, crowd, threshold):
    """The truth of each detection in order, -1 for none: the best free one at the threshold, real ones first."""
    free, out = np.ones(near.shape[1], dtype=bool), []
    for row in near:
        out.append(-1)
        for group in (~ignored, ignored):
            fits = np.nonzero(group & (free | crowd) & (row >= threshold))[0]
            if len(fits):
                out[-1] = max(fits, key=lambda j: (row[j], j))
                free[out[-1]] = False
                break
    return out


def boxes_with_ties(spark):
    r = np.random.default_rng(8)
    dets, gts = [], []
    for image in range(9):
        for kind in range(3):
            for i in range(int(r.integers(0, 14))):
                x, y, s = r.integers(0, 3, 2).tolist() + [int(r.choice([20, 30, 90, 100]))]
                dets.append((image, kind, i, float(x), float(y), float(x + s), float(y + s), float(r.choice([0.2, 0.5, 0.9]))))
            for i in range(int(r.integers(0, 7))):
                x, y, s = r.integers(0, 3, 2).tolist() + [int(r.choice([20, 30, 90, 100]))]
                gts.append((image, kind, i, float(x), float(y), float(x + s), float(y + s), bool(r.random() < 0.3)))
    box = "x1 double, y1 double, x2 double, y2 double"
    return dets, gts, spark.createDataFrame(dets, f"image long, class long, det long, {box}, score double"), spark.createDataFrame(
        gts, f"image long, class long, gt long, {box}, ignore boolean"
    )


@pytest.mark.parametrize("cells", [1 << 21, 50])
def test_coco_matches_of_many_groups_are_those_of_each(spark, monkeypatch, cells):
    monkeypatch.setattr(detection_eval, "CELLS", cells)
    d, t, dets, gts = boxes_with_ties(spark)
    size = lambda b: (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
    want = {}
    for key in {x[:2] for x in d}:
        own = sorted((x for x in d if x[:2] == key), key=lambda x: (-x[7], x[2]))[:5]
        others = sorted(x for x in t if x[:2] == key)
        db, tb = (np.array([x[3:7] for x in rows]).reshape(-1, 4) for rows in (own, others))
        crowd = np.array([x[7] for x in others], dtype=bool)
        w, h = (np.maximum(np.minimum(db[:, None, k + 2], tb[:, k + 2]) - np.maximum(db[:, None, k], tb[:, k]), 0) for k in (0, 1))
        near = w * h / np.where(crowd, size(db)[:, None], size(db)[:, None] + size(tb) - w * h)
        for area, (low, high) in detection_eval.AREAS.items():
            ignored = crowd | (size(tb) < low) | (size(tb) > high)
            for threshold in detection_eval.THRESHOLDS:
                for x, b, j in zip(own, size(db), plain_match(near, ignored, crowd, threshold), strict=True):
                    skip = ignored[j] if j >= 0 else not low <= b <= high
                    want[*key, x[2], area, threshold] = (int(j >= 0 and not skip), int(j < 0 and not skip))
    got = detection_eval.coco_matches(dets, gts, 5).collect()
    assert {(x["image"], x["class"], x["det"], x["area"], x["threshold"]): (x["tp"], x["fp"]) for x in got} == want
    assert len(got) == len(want) == 40 * detection_eval.coco_marks(dets, gts, 5).count()


def test_coco_summary_deals_a_row_for_each_detection(spark, monkeypatch, capsys):
    _, _, dets, gts = boxes_with_ties(spark)
    summary = detection_eval.coco_summary(dets, gts)
    one = sorted(map(tuple, summary.collect()))
    assert len(one) == 40 and any(x[2] > 0 for x in one)
    summary.explain()
    assert "shiftright" not in capsys.readouterr().out  # which makes a row for each area and threshold
    cut = functools.partial(cumulative.part_of, part_rows=7)
    assert not cut(dets, "score", ties=["image", "det"])._jc.toString().isdigit()
    monkeypatch.setattr(detection_eval, "part_of", cut)
    many = sorted(map(tuple, detection_eval.coco_summary(dets, gts).collect()))
    assert [x[:2] for x in many] == [x[:2] for x in one]
    assert np.allclose([x[2:] for x in many], [x[2:] for x in one], rtol=0, atol=1e-12)


def crowded_videos():
    r, out = np.random.default_rng(5), []
    for video, frames in ((None, 6), (1, 1), (2, 70), (3, 25), (4, 40)):
        for frame in range(frames):
            if r.random() < 0.1:
                continue
            for det in range(int(r.integers(1, 9))):
                x, y = r.integers(0, 5, 2) * 5.0
                w, h = r.choice([40.0, 45.0], 2)
                out.append((video, frame * 3, det, x, y, x + w, y + h, float(r.choice([0.3, 0.55, 0.7, 0.9]))))
    return out


def test_videos_side_by_side_are_tracked_as_each_alone():
    rows, want = crowded_videos(), []
    for video in dict.fromkeys(x[0] for x in rows):
        tracker = tracking.Tracker()
        for frame in dict.fromkeys(x[1] for x in rows if x[0] == video):
            own = np.array([x[3:] for x in rows if x[:2] == (video, frame)])
            want += [(video, frame, t, s, *b) for t, s, b in tracker.frame(own[:, :4], own[:, 4])]
    names = ["video", "frame", "det", *tracking.BOX, "score"]
    table = pa.table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))
    numbers = [(c, pa.float64()) for c in ("score", *tracking.BOX)]
    schema = pa.schema([("video", pa.int64()), ("frame", pa.int64()), ("track", pa.int64()), *numbers])
    by = lambda x: (-1 if x[0] is None else x[0], *x[1:3])
    for most, batch in ((10_000, 10_000), (60, 7), (60, 200), (1, 1), (5, 3)):
        made = tracking._Videos("video", 30, most, schema).run(iter(table.to_batches(max_chunksize=batch)))
        got = sorted((tuple(x.values()) for b in made for x in b.to_pylist()), key=by)
        assert [x[:3] for x in got] == [x[:3] for x in sorted(want, key=by)] and len(got) > 300
        assert np.allclose([x[3:] for x in got], [x[3:] for x in sorted(want, key=by)], rtol=0, atol=1e-6)


def test_many_assignments_are_those_of_each():
    r = np.random.default_rng(6)
    for values in ([0.1, 0.3, 0.5, 0.8, 1.0], np.arange(1, 400) / 400):
        costs = [r.choice(values, tuple(r.integers(1, 6, 2))) for _ in range(300)]
        i = np.concatenate([np.repeat(np.arange(len(c)), c.shape[1]) + sum(map(len, costs[:k])) for k, c in enumerate(costs)])
        j = np.concatenate([np.tile(np.arange(c.shape[1]), len(c)) + sum(x.shape[1] for x in costs[:k]) for k, c in enumerate(costs)])
        lane = np.repeat(np.arange(len(costs)), [c.size for c in costs])
        a, b = tracking._assign_many(np.concatenate([c.ravel() for c in costs]), i, j, lane, 0.8)
        want, rows, columns = [], 0, 0
        for c in costs:
            want += [(x + rows, y + columns) for x, y in tracking.assign(c, 0.8)]
            rows, columns = rows + len(c), columns + c.shape[1]
        assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted(want)
