"""Dataset-level detection protocols: COCO-style average precision and face-style precision curves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.cumulative import part_of
from lodestar.operators.detection import BOX, BY_SCORE, boxes_of, iou_matrix, rank_sample, with_truths
from lodestar.operators.grouped import Rows, map_groups

# Fixed values of the COCO protocol.
THRESHOLDS = [round(0.5 + 0.05 * k, 2) for k in range(10)]
AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}
SETTINGS = len(AREAS) * len(THRESHOLDS)
#: Cells of the arrays over groups, settings and truths, or groups, detections and truths, at a time.
CELLS = 1 << 21


def oks_matrix(points: np.ndarray, truth: np.ndarray, boxes: np.ndarray, sigmas: np.ndarray) -> np.ndarray:
    """Object keypoint similarity of ``points`` (n, k, 2) to ``truth`` (m, k, 3: x, y, visible) with ``boxes`` (m, 4).

    The mean of exp(-d^2 / (2 area (2 sigma)^2)) over a truth's visible points; of one without such, over
    the distances by which points lie outside its box widened by its own size on each side.
    """
    out = np.zeros((len(points), len(truth)))
    for j, (t, b) in enumerate(zip(truth, boxes, strict=True)):
        size, seen = b[2:] - b[:2], t[:, 2] > 0
        if seen.any():
            off = points[:, seen] - t[seen, :2]
        else:
            off = np.maximum(b[:2] - size - points, 0) + np.maximum(points - b[2:] - size, 0)
        spread = (2 * sigmas[seen if seen.any() else slice(None)]) ** 2
        out[:, j] = np.exp(-(off**2).sum(axis=2) / spread / (size.prod() + np.spacing(1)) / 2).mean(axis=1)
    return out


def _match_many(near: np.ndarray, valid: np.ndarray, ignored: np.ndarray, crowd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each detection, in order, takes a truth, and whether that is an ignored one: (groups, detections, areas, thresholds).

    ``near`` is (groups, detections, truths), ``valid`` and ``crowd`` (groups, truths), ``ignored`` (groups,
    areas, truths). A detection takes the best free truth at the threshold, the first of equal ones; real
    truths before ignored ones; crowds are never used up. All areas and thresholds go on side by side.
    """
    groups, n, _ = near.shape
    free = np.broadcast_to(valid[:, None, None, :], (groups, len(AREAS), len(THRESHOLDS), valid.shape[1])).copy()
    hit = np.zeros((groups, n, len(AREAS), len(THRESHOLDS)), dtype=bool)
    skip, least = hit.copy(), np.minimum(THRESHOLDS, 1 - 1e-10)
    near = np.where(valid[:, None, :], near, -1.0)
    for i in range(n):
        at = np.nonzero((near[:, i] >= least[0]).any(axis=1))[0]
        if not len(at):
            continue
        own, without = near[at, i], ignored[at]
        fits = (free[at] | crowd[at][:, None, None, :]) & (own[:, None, :] >= least[:, None])[:, None]
        real = fits & ~without[:, :, None, :]
        fits = np.where(real.any(axis=3, keepdims=True), real, fits)
        j = np.where(fits, own[:, None, None, :], -1.0).argmax(axis=3)
        found = fits.any(axis=3)
        hit[at, i] = found
        g, a, t = np.nonzero(found)
        j = j[g, a, t]
        skip[at[g], i, a, t] = without[g, a, j]
        free[at[g], a, t, j] = False
    return hit, skip


def _chunks(detections: np.ndarray, truths: np.ndarray, cells: int) -> list[np.ndarray]:
    """Groups of like numbers of truths, as many at a time as keep the padded arrays to a few million cells."""
    order, out, start, most = np.lexsort((detections, truths)), [], 0, 0
    for at, g in enumerate(order.tolist()):
        most = max(most, int(detections[g]))
        if at > start and (at + 1 - start) * max(int(truths[g]), 1) * max(most, SETTINGS) > cells:
            out.append(order[start:at])
            start, most = at, int(detections[g])
    return [*out, order[start:]] if len(order) else []


def coco_marks(dets: DataFrame, gts: DataFrame, most: int = 100, sigmas: list[float] | None = None) -> DataFrame:
    """(class, image, det, score, tp, fp) of the ``most`` best detections of each image and class.

    ``tp`` and ``fp`` have a bit for each area and threshold: bit 10 a + t for area a and threshold t, in the
    order of ``AREAS`` and ``THRESHOLDS``. For the rest see ``coco_matches``.
    """
    dets = rank_sample(dets, ["image", "class"], [F.desc("score"), F.col("det")], most)
    more = ("points",) if sigmas else ()
    bit, cells = 1 << np.arange(SETTINGS, dtype=np.int64), CELLS

    def overlap(db: np.ndarray, tb: np.ndarray, crowd: np.ndarray) -> np.ndarray:
        size = lambda b: (b[..., 2] - b[..., 0]) * (b[..., 3] - b[..., 1])
        w = np.minimum(db[:, :, None, 2], tb[:, None, :, 2]) - np.maximum(db[:, :, None, 0], tb[:, None, :, 0])
        h = np.minimum(db[:, :, None, 3], tb[:, None, :, 3]) - np.maximum(db[:, :, None, 1], tb[:, None, :, 1])
        inter, own = np.maximum(w, 0) * np.maximum(h, 0), size(db)[:, :, None]
        near = inter / np.maximum(own + size(tb)[:, None, :] - inter, 1e-300)
        if not crowd.any():
            return near
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(crowd[:, None, :], inter / own, near)

    def run(g: Rows, starts: np.ndarray) -> Rows:
        is_det, is_gt = ~np.isnan(g["det"].astype(float)), ~np.isnan(g["gt"].astype(float))
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(is_det))))
        d, t = np.nonzero(is_det)[0], np.nonzero(is_gt)[0]
        boxes = np.column_stack([g[c].astype(float) for c in BOX])
        size = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
        crowd = np.zeros(len(is_det), dtype=bool)
        crowd[t] = g["ignore"][t].astype(bool)
        if sigmas:
            k = len(sigmas)
            points = {i: np.array(g["points"][i], dtype=float).reshape(k, -1) for i in np.nonzero(is_det | is_gt)[0].tolist()}
            crowd[t] |= np.array([not (points[i][:, 2] > 0).any() for i in t.tolist()], dtype=bool)
        dn, tn = np.bincount(group[d], minlength=len(starts)), np.bincount(group[t], minlength=len(starts))
        d_from, t_from = np.append(0, np.cumsum(dn)), np.append(0, np.cumsum(tn))
        tp, fp = np.zeros(len(d), dtype=np.int64), np.zeros(len(d), dtype=np.int64)
        for some in _chunks(dn, tn, cells):
            n, m = int(dn[some].max()), int(tn[some].max())
            if not n:
                continue
            has = np.arange(n) < dn[some][:, None]
            place = np.where(has, d_from[some][:, None] + np.arange(n), 0)
            row = d[place]
            outside = np.stack([(size[row] < low) | (size[row] > high) for low, high in AREAS.values()], axis=2)[..., None]
            if m:
                valid = np.arange(m) < tn[some][:, None]
                # the last truth comes first, as it wins ties
                other = t[np.where(valid, t_from[some + 1][:, None] - 1 - np.arange(m), 0)]
                theirs = crowd[other]
                ignored = np.stack([theirs | (size[other] < low) | (size[other] > high) for low, high in AREAS.values()], axis=1)
                if sigmas:
                    near = np.full((len(some), n, m), -1.0)
                    for x, (nd, nt) in enumerate(zip(dn[some].tolist(), tn[some].tolist(), strict=True)):
                        if nd and nt:
                            mine, own = (np.array([points[i] for i in r.tolist()]) for r in (row[x, :nd], other[x, :nt]))
                            near[x, :nd, :nt] = oks_matrix(mine[:, :, :2], own, boxes[other[x, :nt]], np.array(sigmas))
                else:
                    near = overlap(boxes[row], boxes[other], theirs)
                near[~has] = -1.0
                hit, skip = _match_many(near, valid, ignored, theirs)
            else:
                hit = skip = np.zeros((len(some), n, len(AREAS), len(THRESHOLDS)), dtype=bool)
            false = ~hit & ~outside
            tp[place[has]] = (hit & ~skip).reshape(len(some), n, -1)[has] @ bit
            fp[place[has]] = false.reshape(len(some), n, -1)[has] @ bit
        return {c: g[c][d] for c in ("image", "class", "score")} | {"det": g["det"][d].astype(np.int64), "tp": tp, "fp": fp}

    kinds = dict(dets.dtypes)
    schema = f"image {kinds['image']}, class {kinds['class']}, det long, score double, tp long, fp long"
    ignore = F.col("ignore") if "ignore" in gts.columns else F.lit(False)
    both = with_truths(dets.withColumn("ignore", F.lit(False)), gts.withColumn("ignore", ignore), ["image", "class"], ("ignore", *more))
    return map_groups(both, ["image", "class"], BY_SCORE, run, schema, many=True)


def _setting(k: Column) -> list[Column]:
    """The area and the threshold of a bit of ``coco_marks``."""
    area = F.array(*[F.lit(a) for a in AREAS])[F.floor(k / len(THRESHOLDS)).cast("int")]
    return [area.alias("area"), F.array(*[F.lit(t) for t in THRESHOLDS])[k % len(THRESHOLDS)].alias("threshold")]


def coco_matches(dets: DataFrame, gts: DataFrame, most: int = 100, sigmas: list[float] | None = None) -> DataFrame:
    """(class, image, det, score, area, threshold, tp, fp) of the ``most`` best detections of each image and class.

    Truths marked ``ignore`` are crowds: overlap with them is over the detection's own area and makes
    it neither. Truths outside an area range, and unmatched detections outside it, don't count there.
    With ``sigmas``, one for each keypoint, both sides have an array ``points`` (x, y and, of truths,
    visible, one after the other), and overlap is keypoint similarity; truths without a visible point are
    ignored.
    """
    each = coco_marks(dets, gts, most, sigmas).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(SETTINGS - 1))))
    bits = [F.expr(f"int(shiftright({c}, k) & 1)").alias(c) for c in ("tp", "fp")]
    return each.select("image", "class", "det", "score", *_setting(F.col("k")), *bits)


def coco_summary(dets: DataFrame, gts: DataFrame, most: int = 100, sigmas: list[float] | None = None) -> DataFrame:
    """AP of each area and threshold by 101-point interpolation, and the greatest recall: mean over classes that have truths there."""
    counts, each = _by_class(dets, gts, coco_marks(dets, gts, most, sigmas), sigmas)
    grid = counts.crossJoin(dets.sparkSession.createDataFrame([(t,) for t in THRESHOLDS], "threshold double"))
    every = grid.join(each, ["class", "area", "threshold"], "left")
    return every.groupBy("area", "threshold").agg(
        F.avg(F.coalesce("ap", F.lit(0.0))).alias("ap"), F.avg(F.coalesce("recall", F.lit(0.0))).alias("recall")
    )


def lvis_summary(dets: DataFrame, gts: DataFrame, images: DataFrame, categories: DataFrame, most: int = 300) -> DataFrame:
    """AP over all thresholds of each ``frequency`` of LVIS classes, and of ``all``: (frequency, ap).

    ``images (image, none, partly)`` has the classes that an image is known to have none of, and those not
    marked in full; ``categories (class, frequency)``. Detections of a class that an image neither has nor
    is known to lack are left out, and unmatched ones of a class not marked in full are neither.
    """
    here = gts.select("image", "class").union(images.select("image", F.explode("none").alias("class"))).distinct()
    judged = dets.join(here, ["image", "class"], "left_semi")
    partly = images.select("image", F.explode("partly").alias("class")).distinct().withColumn("partly", F.lit(True))
    marked = coco_marks(judged, gts, most).join(partly, ["image", "class"], "left")
    marked = marked.withColumn("fp", F.when(F.col("partly"), F.lit(0)).otherwise(F.col("fp"))).drop("partly")
    counts, each = _by_class(dets, gts, marked)
    grid = counts.where("area = 'all'").crossJoin(dets.sparkSession.createDataFrame([(t,) for t in THRESHOLDS], "threshold double"))
    every = grid.join(each, ["class", "area", "threshold"], "left").join(categories, "class")
    named = every.select(F.explode(F.array(F.lit("all"), F.col("frequency"))).alias("frequency"), F.coalesce("ap", F.lit(0.0)).alias("ap"))
    return named.groupBy("frequency").agg(F.avg("ap").alias("ap"))


def _by_class(dets: DataFrame, gts: DataFrame, marks: DataFrame, sigmas: list[float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Truths of each class and area, and (class, area, threshold, recall, ap) of the ``coco_marks`` of some ``dets``."""
    size = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    real = gts.where(~F.col("ignore")) if "ignore" in gts.columns else gts
    if sigmas:
        seen = F.filter("points", lambda x, i: (i % 3 == 2) & (x > 0))
        real = real.where(F.size(seen) > 0)
    inside = [F.count(F.when((size >= low) & (size <= high), 1)) for low, high in AREAS.values()]
    truths = real.groupBy("class").agg(F.array(*inside).alias("truths"))
    counts = truths.select("class", F.posexplode("truths").alias("at", "truths")).where("truths > 0").select(
        "class", F.array(*[F.lit(a) for a in AREAS])[F.col("at")].alias("area"), "truths"
    )
    order = dets.select(F.col("score").cast("double").alias("score"), "image", F.col("det").cast("long").alias("det"))
    kind = f"class {dict(marks.dtypes)['class']}"
    # both the totals and the curves read one shuffle
    laid = marks.select("class", "image", "det", "score", "tp", "fp").withColumn(
        "part", part_of(order, "score", ties=["image", "det"]).cast("int")
    ).repartition("class", "part")

    def bits(column: np.ndarray, k: int) -> np.ndarray:
        return (column >> k) & 1

    def total(t: pa.Table) -> pa.Table:
        tp, fp = (t.column(c).to_numpy() for c in ("tp", "fp"))
        sums = [[int(bits(c, k).sum()) for k in range(SETTINGS)] for c in (tp, tp | fp)]
        return t.slice(0, 1).select(["class", "part"]).append_column("tps", pa.array([sums[0]])).append_column("all", pa.array([sums[1]]))

    def earlier(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        for name in ("tps", "all"):
            own = np.array(t.column(name).to_pylist(), dtype=np.int64)
            t = t.set_column(t.column_names.index(name), name, pa.array([*(np.cumsum(own, axis=0) - own)], pa.list_(pa.int64())))
        return t

    def curve(t: pa.Table, before: pa.Table) -> pa.Table:
        found = {"k": [], "goal": [], "p": [], "r": []}
        if t.num_rows and before.num_rows:
            tps_before, all_before, truths = (before.column(c)[0].as_py() for c in ("tps", "all", "truths"))
            by = pc.sort_indices(t, [("score", "descending"), ("image", "ascending"), ("det", "ascending")]).to_numpy()
            tp, fp = (t.column(c).to_numpy()[by] for c in ("tp", "fp"))
            either = tp | fp
            for k in range(SETTINGS):
                of, at = truths[k // len(THRESHOLDS)], np.nonzero(bits(tp, k))[0]
                if not of or not len(at):
                    continue  # rows that are no hit make no point of their own: their precision is lower at the same recall
                hits = tps_before[k] + np.arange(1, len(at) + 1)
                precision = hits / (all_before[k] + np.cumsum(bits(either, k))[at])
                goal = np.floor(hits / of * 100 + 1e-9).astype(np.int32)
                first = np.append(0, np.nonzero(np.diff(goal))[0] + 1)
                found["k"].append(np.full(len(first), k, dtype=np.int32))
                found["goal"].append(goal[first])
                found["p"].append(np.maximum.reduceat(precision, first))
                found["r"].append(np.full(len(first), hits[-1] / of))
        n = sum(map(len, found["k"]))
        names = pa.table({c: np.concatenate(v) if v else pa.array([], pa.int32() if c in ("k", "goal") else pa.float64()) for c, v in found.items()})
        return names.add_column(0, "class", t.column("class").combine_chunks().take(pa.array(np.zeros(n, dtype=np.int64))))

    totals = laid.groupBy("class", "part").applyInArrow(total, f"{kind}, part int, tps array<long>, all array<long>")
    offsets = totals.groupBy("class").applyInArrow(earlier, f"{kind}, part int, tps array<long>, all array<long>").join(truths, "class")
    points = laid.groupBy("class", "part").cogroup(offsets.groupBy("class", "part")).applyInArrow(
        curve, f"{kind}, k int, goal int, p double, r double"
    )
    keys = ["class", "area", "threshold"]
    points = points.select("class", *_setting(F.col("k")), "goal", "p", "r")
    # a recall is the best precision for the goals up to it: its own goal is the last, and a maximum carries it down
    at = points.groupBy(*keys, "goal").agg(F.max("p").alias("p"), F.max("r").alias("r"))
    full = at.groupBy(*keys).agg(
        F.max("r").alias("recall"), F.map_from_entries(F.collect_list(F.struct("goal", "p"))).alias("best")
    )  # at most 101 entries
    later = lambda i: F.array_max(
        F.transform(F.sequence(i, F.lit(100)), lambda k: F.coalesce(F.try_element_at("best", k), F.lit(0.0)))
    )
    ap = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(100)), later), F.lit(0.0), lambda a, x: a + x) / 101
    return counts, full.select("class", "area", "threshold", "recall", ap.alias("ap"))


def face_ap(dets: DataFrame, gts: DataFrame, threshold: float = 0.5, steps: int = 1000) -> DataFrame:
    """AP of each ``setting`` of truths by ``steps`` score thresholds, scores scaled to [0, 1] over the whole set.

    ``gts`` has a boolean ``counts`` (a truth of the setting; others are ignored where matched). A
    detection is a proposal unless its best truth is an ignored one; inclusive-pixel IoU.
    """
    ends = dets.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    span = (ends["hi"] - ends["lo"]) if ends["hi"] is not None and ends["hi"] > ends["lo"] else 1.0
    scaled = dets.withColumn("score", (F.col("score") - F.lit(float(ends["lo"] or 0.0))) / F.lit(float(span)))
    both = with_truths(scaled.withColumn("ignore", F.lit(False)), gts.withColumn("ignore", ~F.col("counts")), ["image"], ("ignore",))

    def run(g: Rows) -> Rows:
        d, t = ~np.isnan(g["det"].astype(float)), ~np.isnan(g["gt"].astype(float))
        ignored, used = g["ignore"][t].astype(bool), np.zeros(int(t.sum()), dtype=bool)
        near = iou_matrix(boxes_of(g, d), boxes_of(g, t), pixel=1.0)
        recalled, proposal = np.zeros(len(near), dtype=np.int64), np.ones(len(near), dtype=np.int64)
        for i in np.nonzero((near >= threshold).any(axis=1))[0]:
            j = int(near[i].argmax())
            if ignored[j]:
                proposal[i] = 0
            elif not used[j]:
                used[j], recalled[i] = True, 1
        # threshold k keeps scores >= 1 - (k + 1) / steps; a detection counts from its first on
        first = np.maximum(np.ceil((1 - g["score"][d].astype(float)) * steps - 1 - 1e-9), 0).astype("int64")
        return {"step": np.minimum(first, steps - 1), "recalled": recalled, "proposals": proposal}

    each = map_groups(both, ["image"], BY_SCORE, run, "step long, recalled long, proposals long")
    hits = each.groupBy("step").agg(F.sum("recalled").alias("recalled"), F.sum("proposals").alias("proposals"))
    truths = gts.agg(F.coalesce(F.sum(F.col("counts").cast("long")), F.lit(0)).alias("truths"))
    up = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # at most ``steps`` rows
    curve = hits.select(
        "step", F.sum("recalled").over(up).alias("r"), F.sum("proposals").over(up).alias("n")
    ).crossJoin(F.broadcast(truths))
    curve = curve.select(
        "step",
        (F.col("r") / F.greatest("truths", F.lit(1))).alias("recall"),
        F.coalesce(F.col("r") / F.when(F.col("n") > 0, F.col("n")), F.lit(0.0)).alias("precision")
    )
    ahead = Window.orderBy("step").rowsBetween(0, Window.unboundedFollowing)
    width = F.col("recall") - F.coalesce(F.lag("recall").over(Window.orderBy("step")), F.lit(0.0))
    return curve.withColumn("width", width).withColumn("envelope", F.max("precision").over(ahead)).agg(
        F.coalesce(F.sum(F.col("width") * F.col("envelope")), F.lit(0.0)).alias("ap")
    )


def face_ap_settings(dets: DataFrame, gts: DataFrame, settings: list[str], threshold: float = 0.5, steps: int = 1000) -> DataFrame:
    """``face_ap`` for each setting, a boolean column of ``gts`` that marks its truths (easy, medium, hard): (setting, ap)."""
    out = None
    for name in settings:
        one = face_ap(dets, gts.withColumn("counts", F.col(name)), threshold, steps).withColumn("setting", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("setting", "ap")


def evaluate_each(parts: dict[str, tuple[DataFrame, DataFrame]], evaluate) -> DataFrame:
    """``evaluate(dets, gts)`` of each named dataset, as one table with the column ``dataset``."""
    out = None
    for name, (dets, gts) in parts.items():
        one = evaluate(dets, gts).withColumn("dataset", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
