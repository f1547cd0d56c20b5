"""Multi-object tracking by detection scores: high-score boxes first, then low-score ones (Zhang et al., 2022)."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lodestar.operators.detection import BOX, hungarian, iou_matrix

# Fixed values of the published tracker.
HIGH, NEW, FIRST, SECOND, UNSURE, SAME = 0.5, 0.6, 0.8, 0.5, 0.7, 0.15
POSITION, VELOCITY = 1 / 20, 1 / 160
#: Rows of whole videos that a task takes side by side; total costs nearer to each other than CLEAR count as ties.
ROWS, CLEAR = 1 << 16, 1e-9


class Motion:
    """A Kalman filter of constant velocity over (centre x, centre y, aspect, height)."""

    STEP = np.eye(8) + np.eye(8, k=4)

    def __init__(self, z: np.ndarray):
        h = z[3]
        self.mean = np.concatenate([z, np.zeros(4)])
        self.cov = np.diag(
            np.square(
                [2 * POSITION * h, 2 * POSITION * h, 1e-2, 2 * POSITION * h, 10 * VELOCITY * h, 10 * VELOCITY * h, 1e-5, 10 * VELOCITY * h]
            )
        )

    def predict(self, moving: bool) -> None:
        if not moving:
            self.mean[7] = 0.0
        h = self.mean[3]
        noise = np.square([POSITION * h, POSITION * h, 1e-2, POSITION * h, VELOCITY * h, VELOCITY * h, 1e-5, VELOCITY * h])
        self.mean = self.STEP @ self.mean
        self.cov = self.STEP @ self.cov @ self.STEP.T + np.diag(noise)

    def update(self, z: np.ndarray) -> None:
        h = self.mean[3]
        seen = self.cov[:4, :4] + np.diag(np.square([POSITION * h, POSITION * h, 1e-1, POSITION * h]))
        gain = np.linalg.solve(seen, self.cov[:, :4].T).T
        self.mean = self.mean + gain @ (z - self.mean[:4])
        self.cov = self.cov - gain @ seen @ gain.T

    def box(self) -> np.ndarray:
        cx, cy, aspect, h = self.mean[:4]
        return np.array([cx - aspect * h / 2, cy - h / 2, cx + aspect * h / 2, cy + h / 2])


def _z(b: np.ndarray) -> np.ndarray:
    w, h = b[2] - b[0], b[3] - b[1]
    return np.array([b[0] + w / 2, b[1] + h / 2, w / h, h])


def assign(cost: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Pairs of least total cost in which leaving a row and a column apart costs ``limit``; none over it."""
    if not cost.size:
        return []
    n, m = cost.shape
    padded = np.full((n + m, n + m), limit / 2)
    padded[n:, m:] = 0.0
    padded[:n, :m] = cost
    to = hungarian(padded)
    return [(i, int(j)) for i, j in enumerate(to[:n]) if j < m and cost[i, j] <= limit]


class Tracker:
    def __init__(self, buffer: int = 30):
        self.buffer, self.now, self.last = buffer, 0, 0
        self.tracks: list[dict] = []

    def _near(self, tracks: list[dict], boxes: np.ndarray) -> np.ndarray:
        if not tracks or not len(boxes):
            return np.zeros((len(tracks), len(boxes)))
        return 1 - iou_matrix(np.array([t["motion"].box() for t in tracks]), boxes, pixel=1.0)

    def _take(self, track: dict, box: np.ndarray, score: float) -> None:
        track["motion"].update(_z(box))
        track.update(state="tracked", seen=self.now, score=score, sure=True)

    def frame(self, boxes: np.ndarray, scores: np.ndarray) -> list[tuple[int, float, np.ndarray]]:
        """Sure tracks after one frame: (track, score, box)."""
        self.now += 1
        high, low = boxes[scores >= HIGH], boxes[scores < HIGH]
        high_scores, low_scores = scores[scores >= HIGH], scores[scores < HIGH]
        known = [t for t in self.tracks if t["sure"]]
        unsure = [t for t in self.tracks if not t["sure"]]
        for t in known:
            t["motion"].predict(t["state"] == "tracked")
        left = list(range(len(high)))
        for i, j in assign(self._near(known, high), FIRST):
            self._take(known[i], high[j], high_scores[j])
            left.remove(j)
        rest = [t for t in known if t["seen"] != self.now and t["state"] == "tracked"]
        for i, j in assign(self._near(rest, low), SECOND):
            self._take(rest[i], low[j], low_scores[j])
        for t in rest:
            if t["seen"] != self.now:
                t["state"] = "lost"
        spare = list(left)
        for i, j in assign(self._near(unsure, high[spare]), UNSURE):
            self._take(unsure[i], high[spare[j]], high_scores[spare[j]])
            left.remove(spare[j])
        for j in left:
            if high_scores[j] >= NEW:
                self.last += 1
                self.tracks.append(
                    {
                        "track": self.last,
                        "motion": Motion(_z(high[j])),
                        "state": "tracked",
                        "seen": self.now,
                        "born": self.now,
                        "score": high_scores[j],
                        "sure": self.now == 1
                    }
                )
        self.tracks = [t for t in self.tracks if (t["sure"] or t["seen"] == self.now) and self.now - t["seen"] <= self.buffer]
        self._drop_twins()
        return [(t["track"], float(t["score"]), t["motion"].box()) for t in self.tracks if t["sure"] and t["state"] == "tracked"]

    def _drop_twins(self) -> None:
        """Of a tracked and a lost track that nearly coincide, the one followed for longer stays."""
        live, lost = [t for t in self.tracks if t["state"] == "tracked"], [t for t in self.tracks if t["state"] == "lost"]
        if not live or not lost:
            return
        near = 1 - iou_matrix(np.array([t["motion"].box() for t in live]), np.array([t["motion"].box() for t in lost]), pixel=1.0)
        gone = set()
        for i, j in np.argwhere(near < SAME):
            a, b = live[i], lost[j]
            gone.add((b if a["seen"] - a["born"] > b["seen"] - b["born"] else a)["track"])
        self.tracks = [t for t in self.tracks if t["track"] not in gone]


def _boxes(mean: np.ndarray) -> np.ndarray:
    cx, cy, aspect, h = mean[:, 0], mean[:, 1], mean[:, 2], mean[:, 3]
    return np.column_stack([cx - aspect * h / 2, cy - h / 2, cx + aspect * h / 2, cy + h / 2])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - IoU of the boxes of each row, in inclusive pixels."""
    w = np.minimum(a[:, 2], b[:, 2]) - np.maximum(a[:, 0], b[:, 0]) + 1.0
    h = np.minimum(a[:, 3], b[:, 3]) - np.maximum(a[:, 1], b[:, 1]) + 1.0
    inter = np.maximum(w, 0) * np.maximum(h, 0)
    size = lambda m: (m[:, 2] - m[:, 0] + 1.0) * (m[:, 3] - m[:, 1] + 1.0)
    return 1 - inter / np.maximum(size(a) + size(b) - inter, 1e-300)


def _meet(a: np.ndarray, b: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of equal lanes of two arrays of lanes in order."""
    n = np.bincount(b, minlength=lanes)
    each, first = n[a], (np.cumsum(n) - n)[a]
    i = np.repeat(np.arange(len(a)), each)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first, each)


def _best(pairs: list[tuple[int, int, float]]) -> list[tuple[int, int]] | None:
    """The pairs (row, column, gain) of greatest total gain that share no row or column; None if that is no clear best or takes long to find."""
    rows: dict[int, list[tuple[int, float]]] = {}
    for i, j, gain in pairs:
        rows.setdefault(j, []).append((i, gain))
    if math.prod(len(x) + 1 for x in rows.values()) > 4096:
        return None
    totals: list[tuple[float, tuple]] = [(0.0, ())]
    for j, own in rows.items():
        totals += [(t + gain, (*chosen, (i, j))) for t, chosen in totals for i, gain in own if all(i != x for x, _ in chosen)]
    totals.sort(key=lambda x: -x[0])
    return None if totals[0][0] - totals[1][0] < CLEAR else list(totals[0][1])


def _assign_many(cost: np.ndarray, i: np.ndarray, j: np.ndarray, lane: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """What ``assign`` gives for each lane, of the costs of all pairs (i, j) in order of i, then j.

    Pairs over the limit never count, so the others fall into small sets without common rows or columns.
    Sets of one row or one column take their least cost, others their best choice; a lane without a clear
    best is left to ``assign``, which has its own way with ties.
    """
    near = np.nonzero(cost <= limit + CLEAR)[0]
    if not len(near):
        return i[:0], j[:0]
    ni, nj, gain = i[near], j[near], limit - cost[near]
    of_i, of_j = np.bincount(ni), np.bincount(nj)
    others_i, others_j = np.zeros_like(of_i), np.zeros_like(of_j)
    np.maximum.at(others_j, nj, of_i[ni])  # the most pairs that a row of this column has
    np.maximum.at(others_i, ni, of_j[nj])
    by_j = others_j[nj] == 1
    star = by_j | (others_i[ni] == 1)
    group = np.where(by_j, nj, len(of_j) + ni)[star]
    order = np.lexsort((-gain[star], group))
    at, own, g = np.nonzero(star)[0][order], group[order], gain[star][order]
    changed = own[1:] != own[:-1]
    first, second = np.append(True, changed)[: len(own)], np.append(~changed, False)[: len(own)]
    second &= first
    unclear = np.zeros(len(at), dtype=bool)
    unclear[second] = g[second] - g[np.nonzero(second)[0] + 1] < CLEAR
    unclear |= first & (np.abs(g) < CLEAR)
    left = {int(x) for x in lane[near[at[unclear]]]}
    taken = at[first & (g > 0)]
    out_i, out_j, out_lane = ni[taken].tolist(), nj[taken].tolist(), lane[near[taken]].tolist()
    sets: dict[int, list[tuple[int, int, float]]] = {}
    for x, a, b, v in zip(lane[near[~star]].tolist(), ni[~star].tolist(), nj[~star].tolist(), gain[~star].tolist(), strict=True):
        sets.setdefault(x, []).append((a, b, v))
    for x, pairs in sets.items():
        chosen = None if x in left else _best(pairs)
        if chosen is None:
            left.add(x)
        else:
            out_i += [a for a, _ in chosen]
            out_j += [b for _, b in chosen]
            out_lane += [x] * len(chosen)
    if left:
        keep = [k for k, x in enumerate(out_lane) if x not in left]
        out_i, out_j = [out_i[k] for k in keep], [out_j[k] for k in keep]
        for x in left:
            a, b = np.searchsorted(lane, [x, x + 1])
            rows = int((i[a:b] != i[a]).argmax()) or b - a  # columns of a row
            for r, c in assign(cost[a:b].reshape(-1, rows), limit):
                out_i.append(int(i[a + r * rows]))
                out_j.append(int(j[a + c]))
    return np.array(out_i, dtype=np.int64), np.array(out_j, dtype=np.int64)


class Trackers:
    """``Tracker`` for several videos (lanes) that go on side by side, in flat arrays over their tracks in order of lane and birth.

    The filter's four coordinates never mix, so it is four filters of position and velocity.
    """

    def __init__(self, lanes: int, buffer: int = 30):
        self.buffer, self.now, self.last = buffer, np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int64)
        whole = lambda: np.zeros(0, dtype=np.int64)
        self.t = {c: whole() for c in ("lane", "track", "seen", "born")} | {c: np.zeros(0, dtype=bool) for c in ("live", "sure")}
        self.t |= {"score": np.zeros(0)} | {c: np.zeros((0, 4)) for c in ("mean", "speed", "place", "both", "pace")}

    def _predict(self, at: np.ndarray) -> None:
        t = self.t
        t["speed"][at[~t["live"][at]], 3] = 0.0
        h = t["mean"][at, 3]
        t["mean"][at] += t["speed"][at]
        p, c, v = t["place"][at], t["both"][at], t["pace"][at]
        t["place"][at] = (p + c) + (c + v) + _spread(POSITION * h, 1e-2)
        t["both"][at] = c + v
        t["pace"][at] = v + _spread(VELOCITY * h, 1e-5)

    def _take(self, at: np.ndarray, boxes: np.ndarray, scores: np.ndarray) -> None:
        t = self.t
        p, c = t["place"][at], t["both"][at]
        seen = p + _spread(POSITION * t["mean"][at, 3], 1e-1)
        to_place, to_pace = p / seen, c / seen
        off = _z_many(boxes) - t["mean"][at]
        t["mean"][at] += to_place * off
        t["speed"][at] += to_pace * off
        t["place"][at] -= to_place * seen * to_place
        t["both"][at] -= to_place * seen * to_pace
        t["pace"][at] -= to_pace * seen * to_pace
        t["live"][at] = t["sure"][at] = True
        t["seen"][at], t["score"][at] = self.now[t["lane"][at]], scores

    def _match(self, at: np.ndarray, lane: np.ndarray, boxes: np.ndarray, scores: np.ndarray, some: np.ndarray, limit: float) -> np.ndarray:
        """Tracks take boxes of their lane; the positions of the boxes taken."""
        own = self.t["lane"][at]
        i, j = _meet(own, lane[some], len(self.now))
        if not len(i):
            return some[:0]
        cost = _apart(_boxes(self.t["mean"][at])[i], boxes[some][j])
        a, b = _assign_many(cost, i, j, own[i], limit)
        self._take(at[a], boxes[some[b]], scores[some[b]])
        return some[b]

    def frame(self, lanes: np.ndarray, lane: np.ndarray, boxes: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, ...]:
        """One more frame of each of ``lanes``; ``lane`` of each box is in order. Sure tracks: (lane, track, score, box)."""
        self.now[lanes] += 1
        here = np.zeros(len(self.now), dtype=bool)
        here[lanes] = True
        if not here[self.t["lane"]].all():  # of videos that are over
            self._keep(here[self.t["lane"]])
        t, now = self.t, self.now
        free = scores >= HIGH
        known, unsure = np.nonzero(t["sure"])[0], np.nonzero(~t["sure"])[0]
        self._predict(known)
        free[self._match(known, lane, boxes, scores, np.nonzero(free)[0], FIRST)] = False
        rest = known[(t["seen"][known] != now[t["lane"][known]]) & t["live"][known]]
        self._match(rest, lane, boxes, scores, np.nonzero(scores < HIGH)[0], SECOND)
        t["live"][rest[t["seen"][rest] != now[t["lane"][rest]]]] = False
        free[self._match(unsure, lane, boxes, scores, np.nonzero(free)[0], UNSURE)] = False
        new = np.nonzero(free & (scores >= NEW))[0]
        if len(new):
            self._add(lane[new], boxes[new], scores[new])
            t = self.t
        age = now[t["lane"]] - t["seen"]
        self._keep((t["sure"] | (age == 0)) & (age <= self.buffer))
        self._drop_twins()
        t = self.t
        out = np.nonzero(t["sure"] & t["live"])[0]
        return t["lane"][out], t["track"][out], t["score"][out], _boxes(t["mean"][out])

    def _keep(self, some: np.ndarray) -> None:
        if not some.all():
            self.t = {c: v[some] for c, v in self.t.items()}

    def _add(self, lane: np.ndarray, boxes: np.ndarray, scores: np.ndarray) -> None:
        n = np.bincount(lane, minlength=len(self.now))
        place = np.arange(len(lane)) - (np.cumsum(n) - n)[lane]
        z, now = _z_many(boxes), self.now[lane]
        more = {
            "lane": lane, "track": self.last[lane] + 1 + place, "seen": now, "born": now, "live": np.ones(len(lane), dtype=bool),
            "sure": now == 1, "score": scores, "mean": z, "speed": np.zeros_like(z), "place": _spread(2 * POSITION * z[:, 3], 1e-2),
            "both": np.zeros_like(z), "pace": _spread(10 * VELOCITY * z[:, 3], 1e-5)
        }
        self.last += n
        order = np.argsort(np.append(self.t["lane"], lane), kind="stable")
        self.t = {c: np.concatenate([v, more[c]])[order] for c, v in self.t.items()}

    def _drop_twins(self) -> None:
        t = self.t
        live, lost = np.nonzero(t["live"])[0], np.nonzero(~t["live"])[0]
        i, j = _meet(t["lane"][live], t["lane"][lost], len(self.now))
        if not len(i):
            return
        boxes = _boxes(t["mean"])
        twins = np.nonzero(_apart(boxes[live[i]], boxes[lost[j]]) < SAME)[0]
        if len(twins):
            a, b = live[i[twins]], lost[j[twins]]
            stay = np.ones(len(t["lane"]), dtype=bool)
            stay[np.where(t["seen"][a] - t["born"][a] > t["seen"][b] - t["born"][b], b, a)] = False
            self._keep(stay)


def _spread(size: np.ndarray, aspect: float) -> np.ndarray:
    """Variances of centre x, centre y, aspect and height, of deviations ``size`` and, of the aspect, ``aspect``."""
    return np.square(np.column_stack([size, size, np.full(len(size), aspect), size]))


def _z_many(b: np.ndarray) -> np.ndarray:
    w, h = b[:, 2] - b[:, 0], b[:, 3] - b[:, 1]
    return np.column_stack([b[:, 0] + w / 2, b[:, 1] + h / 2, w / h, h])


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each row differs from the one before; nulls are equal."""
    codes = column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.append(True, codes[1:] != codes[:-1]) if len(codes) else np.zeros(0, dtype=bool)


class _Videos:
    """Tracks of rows by key, frame and det: whole videos side by side, ``rows`` at a time; one of more rows by itself, in parts."""

    def __init__(self, key: str, buffer: int, rows: int, schema: pa.Schema):
        self.key, self.buffer, self.rows, self.schema, self.long = key, buffer, rows, schema, None

    def run(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
            if n >= self.rows:
                t = pa.concat_tables(held).combine_chunks()
                starts = np.nonzero(_changes(t.column(self.key)))[0]
                cut = int(starts[-1])  # the last video may go on
                yield from self._whole(t.slice(0, cut), starts[:-1])
                t = t.slice(cut)
                if t.num_rows >= self.rows:
                    cut = int(np.nonzero(_changes(t.column("frame")))[0][-1])  # and so may its last frame
                    self.long = self.long or Trackers(1, self.buffer)
                    yield from self._fold(t.slice(0, cut), np.zeros(1 if cut else 0, dtype=np.int64), self.long)
                    t = t.slice(cut)
                held, n = [t], t.num_rows
        if n:
            t = pa.concat_tables(held).combine_chunks()
            yield from self._whole(t, np.nonzero(_changes(t.column(self.key)))[0])

    def _whole(self, t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.long is not None and len(starts):  # the rest of the video that goes by itself
            cut = int(starts[1]) if len(starts) > 1 else t.num_rows
            yield from self._fold(t.slice(0, cut), starts[:1], self.long)
            self.long, t, starts = None, t.slice(cut), starts[1:] - cut
        if len(starts):
            yield from self._fold(t, starts, Trackers(len(starts), self.buffer))

    def _fold(self, t: pa.Table, starts: np.ndarray, trackers: Trackers) -> Iterator[pa.RecordBatch]:
        """``starts`` of the videos in ``t``, a lane each."""
        if not t.num_rows:
            return
        new = _changes(t.column("frame"))
        new[starts] = True
        first = np.nonzero(new)[0]  # row of each frame
        video = np.searchsorted(starts, first, side="right") - 1
        step = np.arange(len(first)) - np.searchsorted(video, video)
        ends = np.append(first[1:], t.num_rows)
        boxes = np.column_stack([t.column(c).to_numpy().astype(float) for c in BOX])
        scores = t.column("score").to_numpy().astype(float)
        order = np.argsort(step, kind="stable")  # by step, then video
        out = []
        for own in np.split(order, np.cumsum(np.bincount(step))[:-1]):
            n = ends[own] - first[own]
            row = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            lane, track, score, b = trackers.frame(video[own], np.repeat(video[own], n), boxes[row], scores[row])
            out.append((first[own][np.searchsorted(video[own], lane)], track, score, b))
        at, track, score, b = (np.concatenate(x) for x in zip(*out, strict=True))
        if len(at):
            named = [t.column(c).combine_chunks().take(pa.array(at)) for c in (self.key, "frame")]
            arrays = [*named, *(pa.array(x) for x in (track, score, *b.T))]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, self.schema, strict=True)], schema=self.schema)


def track_boxes(detections: DataFrame, key: str = "video", buffer: int = 30, rows: int = ROWS) -> DataFrame:
    """Tracks of ``detections (key, frame, det, x1, y1, x2, y2, score)``, one video in order of frame in one task.

    A task takes whole videos side by side, ``rows`` rows at a time; a longer video goes by itself, in parts.
    Rows without a frame are left out.
    """
    kind = dict(detections.dtypes)[key]
    laid = detections.where(F.col("frame").isNotNull()).select(key, "frame", "det", *BOX, "score").repartition(key)
    schema = f"{key} {kind}, frame long, track long, score double, x1 double, y1 double, x2 double, y2 double"
    arrow = to_arrow_schema(detections.sparkSession.createDataFrame([], schema).schema)
    return laid.sortWithinPartitions(key, "frame", "det").mapInArrow(lambda batches: _Videos(key, buffer, rows, arrow).run(batches), schema)
