"""Box arithmetic. A box is four numeric columns or an ARRAY of x1, y1, x2, y2."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = Sequence[Column]


def box(prefix: str = "", names: Sequence[str] = ("x1", "y1", "x2", "y2")) -> tuple[Column, ...]:
    return tuple(F.col(prefix + n).cast("double") for n in names)


def area(b: Box, pixel: float = 0.0) -> Column:
    """(x2 - x1 + pixel) * (y2 - y1 + pixel); pixel is 1 under the inclusive convention."""
    return (b[2] - b[0] + pixel) * (b[3] - b[1] + pixel)


def overlap(a: Box, b: Box, pixel: float = 0.0) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0]) + pixel
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1]) + pixel
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Box, b: Box, mode: str = "iou", pixel: float = 0.0, eps: float = 1e-6) -> Column:
    """Intersection over union, over the first box's area (``iof``), or generalised (``giou``); ``eps`` is the least divisor."""
    inter = overlap(a, b, pixel)
    union = area(a, pixel) if mode == "iof" else area(a, pixel) + area(b, pixel) - inter
    union = F.greatest(union, F.lit(eps)) if eps else union
    if mode != "giou":
        return inter / union
    hull = (F.greatest(a[2], b[2]) - F.least(a[0], b[0])) * (F.greatest(a[3], b[3]) - F.least(a[1], b[1]))
    hull = F.greatest(hull, F.lit(eps))
    return inter / union - (hull - union) / hull


def ltwh_iou(a: Box, b: Box) -> Column:
    """IoU of normalized (left, top, width, height); 0.0 if anything is missing or the union is not over 0."""
    inter = overlap((a[0], a[1], a[0] + a[2], a[1] + a[3]), (b[0], b[1], b[0] + b[2], b[1] + b[3]))
    union = a[2] * a[3] + b[2] * b[3] - inter
    return F.coalesce(F.when(union > 0, inter / union), F.lit(0.0))


def interval_iou(a: Box, b: Box) -> Column:
    """IoU by the overlap of intervals: width = w1 + w2 - (end - start), 0 if either overlap is not over 0."""
    w = (a[2] - a[0]) + (b[2] - b[0]) - (F.greatest(a[2], b[2]) - F.least(a[0], b[0]))
    h = (a[3] - a[1]) + (b[3] - b[1]) - (F.greatest(a[3], b[3]) - F.least(a[1], b[1]))
    inter = F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))
    return inter / (area(a) + area(b) - inter)


def to_xywh(b: Box) -> tuple[Column, ...]:
    return b[0], b[1], b[2] - b[0], b[3] - b[1]


def to_cxcywh(b: Box) -> tuple[Column, ...]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], b[3] - b[1]


def from_cxcywh(b: Box) -> tuple[Column, ...]:
    return b[0] - b[2] / 2, b[1] - b[3] / 2, b[0] + b[2] / 2, b[1] + b[3] / 2


def clip(b: Box, width: Column, height: Column) -> tuple[Column, ...]:
    to = lambda x, m: F.greatest(F.lit(0.0), F.least(x, m))
    return to(b[0], width), to(b[1], height), to(b[2], width), to(b[3], height)


def normalized(b: Box, width: Column, height: Column) -> tuple[Column, ...]:
    """Left, top, width, height as shares of the image, clipped first."""
    c = clip(b, width, height)
    return c[0] / width, c[1] / height, (c[2] - c[0]) / width, (c[3] - c[1]) / height


def public_box(b: Box, width: Column, height: Column) -> tuple[Column, ...]:
    """Clipped whole pixels, rounded half to even."""
    return tuple(F.bround(x, 0).cast("int") for x in clip(b, width, height))


def flip(b: Box, width: Column, height: Column, direction: str = "horizontal") -> tuple[Column, ...]:
    x = (width - b[2], width - b[0]) if direction in ("horizontal", "diagonal") else (b[0], b[2])
    y = (height - b[3], height - b[1]) if direction in ("vertical", "diagonal") else (b[1], b[3])
    return x[0], y[0], x[1], y[1]


def rescale(b: Box, factor: float) -> tuple[Column, ...]:
    """Scaled about its centre."""
    cx, cy, w, h = to_cxcywh(b)
    return from_cxcywh((cx, cy, w * factor, h * factor))


def scale_by(b: Box, sx: Column, sy: Column) -> tuple[Column, ...]:
    return b[0] * sx, b[1] * sy, b[2] * sx, b[3] * sy


def distance_to_box(point: Box, distance: Box, width: Column | None = None, height: Column | None = None) -> tuple[Column, ...]:
    """The box at (left, top, right, bottom) distances of a point, clamped to the image if its size is given."""
    b = (point[0] - distance[0], point[1] - distance[1], point[0] + distance[2], point[1] + distance[3])
    return b if width is None else clip(b, width, height)


def box_to_distance(point: Box, b: Box, most: float | None = None, eps: float = 0.1) -> tuple[Column, ...]:
    d = (point[0] - b[0], point[1] - b[1], b[2] - point[0], b[3] - point[1])
    return d if most is None else tuple(F.greatest(F.lit(0.0), F.least(x, F.lit(most - eps))) for x in d)


def distance_to_landmarks(
    point: Sequence[Column], distances: Sequence[tuple[Column, Column]], width: Column | None = None, height: Column | None = None
) -> list[tuple[Column, Column]]:
    """Landmarks at signed distances of a point, clamped to the image if its size is given."""
    to = lambda x, m: x if m is None else F.greatest(F.lit(0.0), F.least(x, m))
    return [(to(point[0] + dx, width), to(point[1] + dy, height)) for dx, dy in distances]


def landmarks_to_distance(
    point: Sequence[Column], landmarks: Sequence[tuple[Column, Column]], most: float | None = None, eps: float = 0.1
) -> list[tuple[Column, Column]]:
    """Signed distances of landmarks from a point; with ``most`` clamped to 0..most - eps."""
    to = lambda d: d if most is None else F.greatest(F.lit(0.0), F.least(d, F.lit(most - eps)))
    return [(to(x - point[0]), to(y - point[1])) for x, y in landmarks]


def landmark_similarity(points: Column, truth: Column, box: Box, area: Column, sigmas: Sequence[float]) -> Column:
    """Object keypoint similarity of ``points`` to ``truth``, arrays of (x, y) and (x, y, visible): the mean of
    exp(-d^2 / (2 area (2 sigma)^2)) over visible points, or, if none is, of the distances by which points
    lie outside the truth's box (x1, y1, x2, y2) widened by its own size on each side.
    """
    w, h = box[2] - box[0], box[3] - box[1]
    beyond = lambda v, lo, hi: F.greatest(lo - v, F.lit(0.0)) + F.greatest(v - hi, F.lit(0.0))
    spread = F.array(*[F.lit((2.0 * s) ** 2) for s in sigmas])

    def term(dx: Column, dy: Column, i: Column) -> Column:
        return F.exp(-(dx * dx + dy * dy) / F.get(spread, i) / (area + F.lit(2.0**-52)) / 2)

    near = F.transform(points, lambda p, i: term(p["x"] - F.get(truth, i)["x"], p["y"] - F.get(truth, i)["y"], i))
    seen = F.filter(near, lambda e, i: F.get(truth, i)["visible"] > 0)
    outside = F.transform(points, lambda p, i: term(beyond(p["x"], box[0] - w, box[2] + w), beyond(p["y"], box[1] - h, box[3] + h), i))
    used = F.when(F.size(seen) > 0, seen).otherwise(outside)
    return F.aggregate(used, F.lit(0.0), lambda a, x: a + x) / F.size(used)


def encode_delta(
    anchor: Box, target: Box, means: Sequence[float] = (0, 0, 0, 0), stds: Sequence[float] = (1, 1, 1, 1), pixel: float = 0.0
) -> tuple[Column, ...]:
    """Centre offsets over the anchor's size and logs of size ratios, standardised; ``pixel`` 1 is the inclusive convention."""
    size = lambda b: (b[2] - b[0] + pixel, b[3] - b[1] + pixel)
    (aw, ah), (tw, th) = size(anchor), size(target)
    centre = (lambda b, w, h: (b[0] + w * 0.5, b[1] + h * 0.5)) if pixel else (lambda b, w, h: ((b[0] + b[2]) * 0.5, (b[1] + b[3]) * 0.5))
    (ax, ay), (tx, ty) = centre(anchor, aw, ah), centre(target, tw, th)
    raw = ((tx - ax) / aw, (ty - ay) / ah, F.log(tw / aw), F.log(th / ah))
    return tuple((r - float(m)) / float(s) for r, m, s in zip(raw, means, stds, strict=True))


def decode_delta(
    anchor: Box,
    delta: Box,
    means: Sequence[float] = (0, 0, 0, 0),
    stds: Sequence[float] = (1, 1, 1, 1),
    ratio_clip: float = 16 / 1000,
    width: Column | None = None,
    height: Column | None = None
) -> tuple[Column, ...]:
    dx, dy, dw, dh = (d * float(s) + float(m) for d, m, s in zip(delta, means, stds, strict=True))
    most = abs(math.log(ratio_clip))
    held = lambda x: F.greatest(F.lit(-most), F.least(x, F.lit(most)))
    ax, ay, aw, ah = to_cxcywh(anchor)
    b = from_cxcywh((ax + aw * dx, ay + ah * dy, aw * F.exp(held(dw)), ah * F.exp(held(dh))))
    return b if width is None else clip(b, width, height)


def encode_tblr(prior: Box, target: Box, normalizer: float = 4.0) -> tuple[Column, ...]:
    """Top, bottom, left, right distances from the prior's centre, over its height or width and the normalizer."""
    cx, cy, w, h = to_cxcywh(prior)
    return (cy - target[1]) / h / normalizer, (target[3] - cy) / h / normalizer, (cx - target[0]) / w / normalizer, (target[2] - cx) / w / normalizer


def decode_tblr(prior: Box, tblr: Box, normalizer: float = 4.0) -> tuple[Column, ...]:
    cx, cy, w, h = to_cxcywh(prior)
    t, b, left, r = (x * normalizer for x in tblr)
    return cx - left * w, cy - t * h, cx + r * w, cy + b * h


def encode_yolo(anchor: Box, target: Box, stride: float, eps: float = 1e-6) -> tuple[Column, ...]:
    ax, ay, aw, ah = to_cxcywh(anchor)
    tx, ty, tw, th = to_cxcywh(target)
    inside = lambda x: F.greatest(F.lit(eps), F.least(x, F.lit(1 - eps)))
    log = lambda x: F.log(F.greatest(x, F.lit(eps)))
    return inside((tx - ax) / stride + 0.5), inside((ty - ay) / stride + 0.5), log(tw / aw), log(th / ah)


def decode_yolo(anchor: Box, code: Box, stride: float) -> tuple[Column, ...]:
    ax, ay, aw, ah = to_cxcywh(anchor)
    return from_cxcywh(((code[0] - 0.5) * stride + ax, (code[1] - 0.5) * stride + ay, F.exp(code[2]) * aw, F.exp(code[3]) * ah))


def centre_score(b: Box, width: Column, height: Column, weight: float = 2.0) -> Column:
    """Area less ``weight`` times the squared distance of the centre from the image's."""
    cx, cy, w, h = to_cxcywh(b)
    return w * h - weight * (F.pow(cx - width / 2, F.lit(2.0)) + F.pow(cy - height / 2, F.lit(2.0)))


def padded_crop(b: Box, width: Column, height: Column, share: float = 0.1) -> tuple[Column, ...]:
    pw, ph = (b[2] - b[0]) * share, (b[3] - b[1]) * share
    return tuple(x.cast("int") for x in clip((b[0] - pw, b[1] - ph, b[2] + pw, b[3] + ph), width, height))


def anchors(base_size: float, ratios: Sequence[float], scales: Sequence[float]) -> list[tuple[float, float, float, float]]:
    """Windows of each ratio and scale about a base square at the origin (inclusive convention, half-to-even sizes)."""
    centre, out = (base_size - 1) / 2, []
    for ratio in ratios:
        w = round(math.sqrt(base_size * base_size / ratio))
        h = round(w * ratio)
        for s in scales:
            hw, hh = (w * s - 1) / 2, (h * s - 1) / 2
            out.append((centre - hw, centre - hh, centre + hw, centre + hh))
    return out


def affine(x: Column, y: Column, m: Sequence[Sequence[float]]) -> tuple[Column, Column]:
    return x * m[0][0] + y * m[0][1] + m[0][2], x * m[1][0] + y * m[1][1] + m[1][2]


def gaze_vector(pitch: Column, yaw: Column) -> tuple[Column, Column, Column]:
    return F.cos(pitch) * F.sin(yaw), F.sin(pitch), F.cos(pitch) * F.cos(yaw)


def gaze_angles(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    return F.asin(y / F.sqrt(x * x + y * y + z * z)), F.atan2(x, z)


def encode_landmarks(anchor: Box, points: Sequence[tuple[Column, Column]]) -> list[tuple[Column, Column]]:
    """Landmarks as offsets from the anchor's centre over its size, under the inclusive convention."""
    w, h = anchor[2] - anchor[0] + 1.0, anchor[3] - anchor[1] + 1.0
    cx, cy = anchor[0] + 0.5 * (w - 1.0), anchor[1] + 0.5 * (h - 1.0)
    return [((x - cx) / w, (y - cy) / h) for x, y in points]


def decode_landmarks(anchor: Box, offsets: Sequence[tuple[Column, Column]]) -> list[tuple[Column, Column]]:
    w, h = anchor[2] - anchor[0] + 1.0, anchor[3] - anchor[1] + 1.0
    cx, cy = anchor[0] + 0.5 * (w - 1.0), anchor[1] + 0.5 * (h - 1.0)
    return [(dx * w + cx, dy * h + cy) for dx, dy in offsets]


def encode_inclusive(anchor: Box, target: Box) -> tuple[Column, ...]:
    """Delta code whose sizes count both ends and whose centres are at (size - 1) / 2."""
    size = lambda b: (b[2] - b[0] + 1.0, b[3] - b[1] + 1.0)
    (aw, ah), (tw, th) = size(anchor), size(target)
    centre = lambda b, w, h: (b[0] + 0.5 * (w - 1.0), b[1] + 0.5 * (h - 1.0))
    (ax, ay), (tx, ty) = centre(anchor, aw, ah), centre(target, tw, th)
    return (tx - ax) / (aw + 1e-14), (ty - ay) / (ah + 1e-14), F.log(tw / aw), F.log(th / ah)


def decode_inclusive(anchor: Box, delta: Box) -> tuple[Column, ...]:
    aw, ah = anchor[2] - anchor[0] + 1.0, anchor[3] - anchor[1] + 1.0
    cx, cy = delta[0] * aw + anchor[0] + 0.5 * (aw - 1.0), delta[1] * ah + anchor[1] + 0.5 * (ah - 1.0)
    w, h = F.exp(delta[2]) * aw, F.exp(delta[3]) * ah
    return cx - 0.5 * (w - 1.0), cy - 0.5 * (h - 1.0), cx + 0.5 * (w - 1.0), cy + 0.5 * (h - 1.0)


def encode_buckets(proposal: Box, target: Box, buckets: int, scale: float = 3.0) -> list[Column]:
    """For each side of the target (left, right, top, bottom) the nearest bucket edge of the widened proposal and the offset from it in buckets.

    The widened proposal is cut into ``buckets`` stretches on an axis; a side looks at the half it lies on.
    Returns structs (bucket, offset).
    """
    p = rescale(proposal, scale)
    out = []
    for lo, hi, sides in ((p[0], p[2], (target[0], target[2])), (p[1], p[3], (target[1], target[3]))):
        size, half = (hi - lo) / buckets, -(-buckets // 2)
        for side, start, sign in ((sides[0], lo, 1), (sides[1], hi, -1)):
            near = F.greatest(F.lit(0.0), F.least(F.lit(half - 1.0), F.round((side - start) * sign / size - 0.5)))
            out.append(F.struct(near.cast("int").alias("bucket"), ((start + sign * (near + 0.5) * size - side) / size).alias("offset")))
    return out


def decode_buckets(proposal: Box, codes: Sequence[Column], buckets: int, scale: float = 3.0) -> tuple[Column, ...]:
    p = rescale(proposal, scale)
    w, h = (p[2] - p[0]) / buckets, (p[3] - p[1]) / buckets
    at = lambda code, start, size, sign: start + sign * (code["bucket"] + 0.5) * size - code["offset"] * size
    return at(codes[0], p[0], w, 1), at(codes[2], p[1], h, 1), at(codes[1], p[2], w, -1), at(codes[3], p[3], h, -1)
