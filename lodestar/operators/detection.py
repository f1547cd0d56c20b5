"""Detections: suppression, assignment, true and false positives, average precision.

``dets (image, class, det, x1, y1, x2, y2, score)`` and ``gts (image, class, gt, x1, y1, x2, y2)``.
Greedy operators work on one image (and class) at a time, in order of score descending, then det.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.boxes import box, iou
from lodestar.functions.scalars import seeded
from lodestar.operators.cumulative import running_totals
from lodestar.operators.grouped import Rows, keep_by_group, map_groups

BOX = ["x1", "y1", "x2", "y2"]
#: Detections by score, then number, and truths by number.
BY_SCORE = ["score desc nulls last", "det", "gt"]


def iou_matrix(a: np.ndarray, b: np.ndarray, pixel: float = 0.0, eps: float = 0.0, area_pixel: float | None = None) -> np.ndarray:
    area_pixel = pixel if area_pixel is None else area_pixel
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0]) + pixel
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1]) + pixel
    inter = np.maximum(w, 0) * np.maximum(h, 0)
    size = lambda m: (m[:, 2] - m[:, 0] + area_pixel) * (m[:, 3] - m[:, 1] + area_pixel)
    return inter / np.maximum(size(a)[:, None] + size(b)[None, :] - inter, eps or 1e-300)


def greedy_keep(
    boxes: np.ndarray, threshold: float, pixel: float = 1.0, inclusive: bool = False, area_pixel: float | None = None, block: int = 1024
) -> np.ndarray:
    """Positions kept of boxes in order: one is dropped if its IoU with a kept one exceeds (``inclusive``: reaches) the threshold.

    Overlaps are computed for ``block`` boxes at a time, and only for those that are still left.
    """
    kept, left = [], np.arange(len(boxes))
    while len(left):
        head = left[:block]
        near = iou_matrix(boxes[head], boxes[left], pixel, area_pixel=area_pixel)
        drops = near >= threshold if inclusive else near > threshold
        alive = np.ones(len(left), dtype=bool)
        for i in range(len(head)):
            if alive[i]:
                kept.append(head[i])
                alive &= ~drops[i]
        alive[: len(head)] = False
        left = left[alive]
    return np.array(kept, dtype=np.int64)


def nms(
    dets: DataFrame,
    threshold: float,
    keys: tuple[str, ...] = ("image", "class"),
    pixel: float = 1.0,
    inclusive: bool = False,
    area_pixel: float | None = None
) -> DataFrame:
    """Greedy non-maximum suppression within ``keys``: the rows kept, all columns."""
    return keep_by_group(
        dets, list(keys), [F.desc("score"), F.col("det")], BOX, lambda b: greedy_keep(b, threshold, pixel, inclusive, area_pixel)
    )


def multiclass_nms(dets: DataFrame, least_score: float, threshold: float, most: int, pixel: float = 0.0) -> DataFrame:
    """Scores over ``least_score``, suppression within each class, and the ``most`` best of an image."""
    kept = nms(dets.where(F.col("score") > least_score), threshold, pixel=pixel)
    order = Window.partitionBy("image").orderBy(F.desc("score"), "det")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def fast_nms(dets: DataFrame, threshold: float, top_k: int | None = None, pixel: float = 0.0) -> DataFrame:
    """Suppression in which suppressed boxes suppress too: a row stays if no better one of its image and class overlaps it over the threshold."""
    order = Window.partitionBy("image", "class").orderBy(F.desc("score"), "det")
    ranked = dets.withColumn("rank", F.row_number().over(order))
    ranked = ranked.where(F.col("rank") <= top_k) if top_k else ranked
    better = ranked.select("image", "class", F.col("rank").alias("better"), *[F.col(c).alias(f"b_{c}") for c in BOX])
    # the rank join alone would leave groups to a few tasks; the equality keeps images together
    over = (F.col("better") < F.col("rank")) & (iou(box(), box("b_"), pixel=pixel) > threshold)
    return ranked.join(better, (ranked["image"] == better["image"]) & (ranked["class"] == better["class"]) & over, "left_anti")


def merge_scales(candidates: list[DataFrame], threshold: float, most: int) -> DataFrame:
    """Candidates of several input sizes: one suppression of them all in each image, then the ``most`` best."""
    union = candidates[0]
    for c in candidates[1:]:
        union = union.unionByName(c)
    kept = nms(union, threshold, keys=("image",))
    order = Window.partitionBy("image").orderBy(F.desc("score"), "det")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def top_detections(dets: DataFrame, most: int, score: Column) -> DataFrame:
    """The ``most`` rows of each image by any score, lowest det on ties."""
    order = Window.partitionBy("image").orderBy(F.desc("metric"), "det")
    return dets.withColumn("metric", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def single_face_policy(dets: DataFrame, policy: str, score: Column) -> DataFrame:
    """One row for each image: ``require_one`` (error if several), ``skip`` (none if several), or the best by ``score``."""
    counted = dets.groupBy("image").agg(F.count("*").alias("faces"), F.max_by("det", F.struct(score, -F.col("det"))).alias("best"))
    several = F.col("faces") > 1
    if policy == "require_one":
        return counted.select(
            "image",
            "faces",
            F.when(~several, F.col("best")).alias("det"),
            F.when(several, "multiple_faces").otherwise("ok").alias("status")
        )
    if policy == "skip":
        return counted.where(~several).select("image", "faces", F.col("best").alias("det"), F.lit("ok").alias("status"))
    return counted.select("image", "faces", F.col("best").alias("det"), F.lit("ok").alias("status"))


def _pairs(dets: DataFrame, gts: DataFrame, keys: list[str], pixel: float, eps: float) -> DataFrame:
    truth = gts.select(*keys, "gt", *[F.col(c).alias(f"g_{c}") for c in BOX], *[F.col(c) for c in gts.columns if c == "ignore"])
    return dets.join(truth, keys).withColumn("iou", iou(box(), box("g_"), pixel=pixel, eps=eps))


def max_iou_assign(
    dets: DataFrame, gts: DataFrame, positive: float = 0.5, negative: float = 0.4, least_positive: float = 0.0, low_quality: bool = True
) -> DataFrame:
    """The ground truth of each box: gt, -1 for background (best IoU under ``negative``) or null between.

    With ``low_quality`` each ground truth whose best IoU is at least ``least_positive`` takes all boxes
    that reach that IoU; of several such truths the last counts.
    """
    keys = ["image"]
    pairs = _pairs(dets, gts, keys, 0.0, 1e-6)
    own = pairs.groupBy("image", "det").agg(F.max_by(F.struct("gt", "iou"), F.struct("iou", -F.col("gt"))).alias("b"))
    out = dets.select("image", "det").join(own, ["image", "det"], "left")
    got = F.when(F.col("b.iou") >= positive, F.col("b.gt")).when(F.coalesce("b.iou", F.lit(0.0)) < negative, F.lit(-1))
    out = out.select("image", "det", got.cast("long").alias("assigned"), F.coalesce("b.iou", F.lit(0.0)).alias("iou"))
    if not low_quality:
        return out
    best = pairs.groupBy("image", "gt").agg(F.max("iou").alias("top")).where(F.col("top") >= least_positive)
    forced = pairs.join(best, ["image", "gt"]).where(F.col("iou") == F.col("top")).groupBy("image", "det").agg(F.max("gt").alias("forced"))
    return out.join(forced, ["image", "det"], "left").select(
        "image", "det", F.coalesce("forced", "assigned").cast("long").alias("assigned"), "iou"
    )


def atss_assign(dets: DataFrame, gts: DataFrame, k: int = 9) -> DataFrame:
    """Adaptive assignment of boxes with a ``level``: the ``k`` nearest centres of each level are candidates of a truth.

    Positive are candidates whose IoU reaches the mean plus the sample deviation over the truth's
    candidates and whose centre lies inside it; of several truths the one of the highest IoU counts.
    """
    pairs = _pairs(dets, gts, ["image"], 0.0, 1e-6)
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    gx, gy = (F.col("g_x1") + F.col("g_x2")) / 2, (F.col("g_y1") + F.col("g_y2")) / 2
    near = Window.partitionBy("image", "gt", "level").orderBy(F.pow(cx - gx, F.lit(2.0)) + F.pow(cy - gy, F.lit(2.0)), "det")
    candidates = pairs.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
    # rounded, so that equal overlaps reach their own mean
    limits = candidates.groupBy("image", "gt").agg(F.round(F.avg("iou") + F.coalesce(F.stddev_samp("iou"), F.lit(0.0)), 9).alias("limit"))
    inside = F.least(cx - F.col("g_x1"), cy - F.col("g_y1"), F.col("g_x2") - cx, F.col("g_y2") - cy) > 0.01
    chosen = candidates.join(limits, ["image", "gt"]).where((F.round("iou", 9) >= F.col("limit")) & inside)
    best = chosen.groupBy("image", "det").agg(F.max_by(F.struct("gt", "iou"), F.struct("iou", -F.col("gt"))).alias("b"))
    return dets.select("image", "det").join(best, ["image", "det"], "left").select(
        "image", "det", F.coalesce("b.gt", F.lit(-1)).cast("long").alias("assigned"), F.col("b.iou").alias("iou")
    )


def mark_default(dets: DataFrame, gts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``dets`` with tp and fp: a row whose best truth (lowest gt on ties) reaches the threshold is a true positive if it is the first of that truth by score.

    Later ones and those that reach none are false positives; a best truth marked ``ignore`` makes a row neither.
    """
    if "ignore" not in gts.columns:
        gts = gts.withColumn("ignore", F.lit(False))
    keys = ["image", "class"]
    best = _pairs(dets, gts, keys, 0.0, 1e-6).groupBy(*keys, "det").agg(
        F.max_by(F.struct("gt", "iou", "ignore"), F.struct("iou", -F.col("gt"))).alias("b")
    )
    matched = dets.join(best, [*keys, "det"], "left").withColumn("hit", F.coalesce(F.col("b.iou") >= threshold, F.lit(False)))
    order = Window.partitionBy(*keys, F.col("hit"), F.col("b.gt")).orderBy(F.desc("score"), "det")
    first = F.row_number().over(order) == 1
    counted = matched.withColumn("first", first)
    ignored = F.col("hit") & F.coalesce("b.ignore", F.lit(False))
    tp = (F.col("hit") & F.col("first") & ~ignored).cast("int")
    return counted.select(*dets.columns, tp.alias("tp"), F.when(ignored, 0).otherwise(1 - tp).alias("fp"))


def boxes_of(rows: Rows, some: np.ndarray) -> np.ndarray:
    return np.column_stack([rows[c][some].astype(float) for c in BOX])


def with_truths(dets: DataFrame, gts: DataFrame, keys: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """Both in one table, to meet by group: ``gt`` is null in rows of ``dets``, ``det`` and ``score`` in those of ``gts``."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    score = F.col("score").cast("double").alias("score") if "score" in dets.columns else none("double", "score")
    left = dets.select(*keys, "det", score, *BOX, none("long", "gt"), *more)
    return left.unionByName(gts.select(*keys, none("long", "det"), none("double", "score"), *BOX, "gt", *more))


def mark_available(dets: DataFrame, gts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``dets`` with tp and fp, each row by score taking its best truth that is still free; small truths need less overlap."""

    def run(g: Rows) -> Rows:
        d, t = ~np.isnan(g["det"].astype(float)), ~np.isnan(g["gt"].astype(float))
        tp = np.zeros(int(d.sum()), dtype=np.int32)
        tb = boxes_of(g, t)
        if len(tb) and len(tp):
            near = iou_matrix(boxes_of(g, d), tb - np.array([0, 0, 1, 1.0]), pixel=1.0)
            w, h = tb[:, 2] - tb[:, 0], tb[:, 3] - tb[:, 1]
            able = near >= np.minimum(w * h / ((w + 10) * (h + 10)), threshold)
            free = np.ones(len(tb), dtype=bool)
            for i in np.nonzero(able.any(axis=1))[0]:
                fits = free & able[i]
                if fits.any():
                    j = int(np.where(fits, near[i], -1).argmax())
                    free[j], tp[i] = False, 1
        return {"image": g["image"][d], "class": g["class"][d], "det": g["det"][d].astype(np.int64), "score": g["score"][d], "tp": tp, "fp": 1 - tp}

    kinds = dict(dets.dtypes)
    schema = f"image {kinds['image']}, class {kinds['class']}, det long, score double, tp int, fp int"
    return map_groups(with_truths(dets, gts, ["image", "class"]), ["image", "class"], BY_SCORE, run, schema)


def mark_by_area(dets: DataFrame, gts: DataFrame, areas: dict[str, tuple[float, float]], threshold: float = 0.5) -> DataFrame:
    """``mark_default`` for each of ``areas``, ranges [least, most) of a box's area, in a column ``area``.

    Within a range, a best truth outside it makes a row neither, as one marked ``ignore`` does, and a row
    that reaches no truth is a false positive only if it lies in the range itself. One matching serves all.
    """
    keys = ["image", "class"]
    ranges = F.array(
        *[F.struct(F.lit(n).alias("area"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for n, (lo, hi) in areas.items()]
    )
    if "ignore" not in gts.columns:
        gts = gts.withColumn("ignore", F.lit(False))
    size = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    pairs = _pairs(dets, gts, keys, 0.0, 1e-6).withColumn("g_size", size(box("g_")))
    best = pairs.groupBy(*keys, "det").agg(F.max_by(F.struct("gt", "iou", "ignore", "g_size"), F.struct("iou", -F.col("gt"))).alias("b"))
    matched = dets.join(best, [*keys, "det"], "left").withColumn(
        "hit", F.coalesce(F.col("b.iou") >= threshold, F.lit(False))
    ).withColumn("size", size(box()))
    order = Window.partitionBy(*keys, F.col("hit"), F.col("b.gt")).orderBy(F.desc("score"), "det")
    each = matched.withColumn("first", F.row_number().over(order) == 1).withColumn("r", F.explode(ranges))
    inside = lambda c: (c >= F.col("r.lo")) & (c < F.col("r.hi"))
    counts = F.col("hit") & ~F.coalesce("b.ignore", F.lit(False)) & inside(F.col("b.g_size"))
    tp, fp = counts & F.col("first"), (counts & ~F.col("first")) | (~F.col("hit") & inside(F.col("size")))
    return each.select(F.col("r.area").alias("area"), *dets.columns, tp.cast("int").alias("tp"), fp.cast("int").alias("fp"))


def precision_recall(marked: DataFrame, gts: DataFrame) -> DataFrame:
    """Recall and precision of each class down the global order of score, then image, then det."""
    truths = gts.where(~F.col("ignore")) if "ignore" in gts.columns else gts
    totals = truths.groupBy("class").agg(F.count("*").alias("truths"))
    cum = running_totals(
        marked.select("class", "image", "det", "score", "tp", "fp"), "score", ["tp", "fp"], keys=["class"], ties=["image", "det"]
    ).join(totals, "class")
    tps, fps = F.col("tp_to_here"), F.col("fp_to_here")
    return cum.select(
        "class",
        "image",
        "det",
        "score",
        "truths",
        (tps / F.col("truths")).alias("recall"),
        (tps / F.greatest(tps + fps, F.lit(1))).alias("precision")
    )


def average_precision(curve: DataFrame, mode: str = "area") -> DataFrame:
    """AP of each class of ``precision_recall``: area under the monotone envelope, or the mean over 11 recalls.

    At equal recall only the best precision counts, so a class is reduced to a row for each distinct
    recall. Recall rises by 1 / truths at a time, so that is the width of every step over 0.
    """
    points = curve.groupBy("class", "truths", "recall").agg(F.max("precision").alias("precision"))
    if mode == "11points":
        goals = curve.sparkSession.createDataFrame([(i / 10,) for i in range(11)], "goal double")
        best = points.crossJoin(F.broadcast(goals)).groupBy("class", "goal").agg(
            F.coalesce(F.max(F.when(F.col("recall") >= F.col("goal") - 1e-12, F.col("precision"))), F.lit(0.0)).alias("p")
        )
        return best.groupBy("class").agg((F.sum("p") / 11).alias("ap"))
    envelope = running_totals(points, "recall", [], keys=["class"], maxima=["precision"])
    return envelope.groupBy("class").agg(
        F.sum(F.when(F.col("recall") > 0, F.col("precision_to_here") / F.col("truths")).otherwise(0.0)).alias("ap")
    )


def eval_map(dets: DataFrame, gts: DataFrame, threshold: float = 0.5, mode: str = "area", mark=mark_default) -> DataFrame:
    """AP of each class with ground truth (0 without detections), and the counts."""
    marked = mark(dets, gts, threshold)
    ap = average_precision(precision_recall(marked, gts), mode)
    truths = (gts.where(~F.col("ignore")) if "ignore" in gts.columns else gts).groupBy("class").agg(F.count("*").alias("truths"))
    n = dets.groupBy("class").agg(F.count("*").alias("dets"))
    return truths.join(n, "class", "left").join(ap, "class", "left").select(
        "class", "truths", F.coalesce("dets", F.lit(0)).alias("dets"), F.coalesce("ap", F.lit(0.0)).alias("ap")
    )


def eval_map_by_area(dets: DataFrame, gts: DataFrame, areas: dict[str, tuple[float, float]], threshold: float = 0.5) -> DataFrame:
    """AP of each class and range of areas in which it has ground truth: (area, class, truths, ap)."""
    size = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    inside = F.array_compact(F.array(*[F.when((size >= lo) & (size < hi), F.lit(n)) for n, (lo, hi) in areas.items()]))
    truths = gts.withColumn("area", F.explode(inside))
    both = F.struct("area", "class").alias("class")
    marked = mark_by_area(dets, gts, areas, threshold)
    named = lambda df: df.select(both, *[c for c in df.columns if c not in ("area", "class")])
    ap = average_precision(precision_recall(named(marked), named(truths)))
    real = truths.where(~F.col("ignore")) if "ignore" in gts.columns else truths
    counts = named(real).groupBy("class").agg(F.count("*").alias("truths"))
    return counts.join(ap, "class", "left").select("class.area", "class.class", "truths", F.coalesce("ap", F.lit(0.0)).alias("ap"))


def proposal_recall(dets: DataFrame, gts: DataFrame, numbers: list[int], thresholds: list[float]) -> DataFrame:
    """Share of truths met at each IoU threshold by the best ``number`` boxes of an image, matched one to one by greatest IoU first."""

    def run(g: Rows) -> Rows:
        d, t = ~np.isnan(g["det"].astype(float)), ~np.isnan(g["gt"].astype(float))
        rows = []
        whole = iou_matrix(boxes_of(g, t), boxes_of(g, d), eps=1e-6)
        for n in numbers:
            near = whole[:, :n].copy()
            met = np.zeros(len(whole))
            for k in range(min(near.shape)):
                i, j = np.unravel_index(near.argmax(), near.shape)
                met[k] = near[i, j]
                near[i, :], near[:, j] = -1, -1
            rows += [(n, th, int((met >= th).sum()), len(whole)) for th in thresholds]
        return {name: np.array(column) for name, column in zip(("number", "threshold", "met", "truths"), zip(*rows, strict=True), strict=True)}

    schema = "number int, threshold double, met long, truths long"
    found = map_groups(with_truths(dets, gts, ["image"]), ["image"], BY_SCORE, run, schema)
    return found.groupBy("number", "threshold").agg((F.sum("met") / F.greatest(F.sum("truths"), F.lit(1))).alias("recall"))


def rank_sample(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in an order; hashes for random samplers, losses for hard-example mining."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def random_sample(assigned: DataFrame, n: int, positive_share: float, seed: int = 0) -> DataFrame:
    """Of each image up to ``n`` boxes by a seeded hash: at most the positive share of positives, the rest negatives."""
    positive = F.col("assigned") >= 0
    shuffled = seeded(seed, F.col("image"), F.col("det"))
    ranked = assigned.where("assigned is not null").withColumn("positive", positive).withColumn(
        "rank", F.row_number().over(Window.partitionBy("image", "positive").orderBy(shuffled, "det"))
    )
    most = int(n * positive_share)
    taken = F.least(F.coalesce(F.max(F.when(F.col("positive"), F.col("rank"))).over(Window.partitionBy("image")), F.lit(0)), F.lit(most))
    return ranked.withColumn("taken", taken).where(
        F.when(F.col("positive"), F.col("rank") <= most).otherwise(F.col("rank") <= F.lit(n) - F.col("taken"))
    ).select("image", "det", "assigned")


def hungarian(cost: np.ndarray) -> np.ndarray:
    """Column of each row (-1: none) in an assignment of least total cost, by shortest augmenting paths."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=np.int64)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64), np.zeros(m + 1, dtype=bool)
        while True:
            used[j0] = True
            free = np.nonzero(~used[1:])[0] + 1
            reduced = c[match[j0] - 1, free - 1] - u[match[j0]] - v[free]
            better = reduced < least[free]
            least[free[better]], way[free[better]] = reduced[better], j0
            j1 = free[least[free].argmin()]
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[free] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = np.full(cost.shape[0], -1, dtype=np.int64)
    for j in range(1, m + 1):
        if match[j]:
            if flip:
                out[j - 1] = match[j] - 1
            else:
                out[match[j] - 1] = j - 1
    return out


def hungarian_assign(dets: DataFrame, gts: DataFrame) -> DataFrame:
    """One box for each truth of an image such that the sum of 1 - IoU is least; -1 for the others."""

    def run(g: Rows) -> Rows:
        d, t = ~np.isnan(g["det"].astype(float)), ~np.isnan(g["gt"].astype(float))
        of = np.full(int(d.sum()), -1, dtype=np.int64)
        if len(of) and t.any():
            to = hungarian(1 - iou_matrix(boxes_of(g, d), boxes_of(g, t), eps=1e-6))
            of = np.where(to >= 0, g["gt"][t].astype(np.int64)[to], -1)
        return {"image": g["image"][d], "det": g["det"][d].astype(np.int64), "assigned": of}

    schema = f"image {dict(dets.dtypes)['image']}, det long, assigned long"
    return map_groups(with_truths(dets, gts, ["image"]), ["image"], [F.col("det"), F.col("gt")], run, schema)
