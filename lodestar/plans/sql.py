"""DuckDB twins that are longer than a line or two: greedy operators by recursion, curves, samplers."""

from __future__ import annotations

from lodestar.plans.fixtures import sql_iou, with_

#: A recursion over what a WITH list defines.
RECURSIVE = "WITH RECURSIVE "


def recursive(*names: str) -> str:
    return with_(*names).replace("WITH ", RECURSIVE, 1)


def seeded(*columns: str, seed: int = 0) -> str:
    """The number that ``functions.scalars.seeded`` makes of the columns."""
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(columns)}, {seed})), 1, 15))::BIGINT"


def nms(source: str, threshold: float, pixel: int, name: str = "kept") -> str:
    """CTEs that end in ``name``: the rows of ``source`` that greedy suppression within image and class keeps.

    For each row the better ones that overlap it are listed; down the ranks, a row is kept if none of
    its list has been kept.
    """
    return f""", {name}_r AS (SELECT *, row_number() OVER (PARTITION BY image, class ORDER BY score DESC, det) AS place FROM {source}),
{name}_s AS (
    SELECT a.image, a.class, a.place, coalesce(list(b.place) FILTER (b.place IS NOT NULL), []) AS above
    FROM {name}_r a LEFT JOIN {name}_r b ON a.image = b.image AND a.class = b.class AND b.place < a.place
        AND {sql_iou('a', 'b', pixel)} > {threshold}
    GROUP BY ALL),
{name}_k AS (
    SELECT image, class, place, true AS keep, [place] AS held FROM {name}_s WHERE place = 1
    UNION ALL
    SELECT s.image, s.class, s.place, NOT list_has_any(k.held, s.above), CASE
        WHEN list_has_any(k.held, s.above) THEN k.held ELSE list_append(k.held, s.place) END
    FROM {name}_k k JOIN {name}_s s ON s.image = k.image AND s.class = k.class AND s.place = k.place + 1),
{name} AS (SELECT r.* EXCLUDE (place) FROM {name}_r r JOIN {name}_k k ON r.image = k.image AND r.class = k.class AND r.place = k.place
    AND k.keep) """


def tar(targets: list[float], total: str = "p") -> str:
    """CTEs after ``scores`` and ``curve`` that end in ``tar``: target, budget, threshold, exclusive, tar, far."""
    return f""", goals AS (SELECT unnest({targets})::DOUBLE AS target),
top AS (SELECT max(score) AS top, count(*) AS negatives FROM scores WHERE label <> 1),
b AS (SELECT target, floor(target * negatives)::BIGINT AS budget, top, negatives FROM goals, top),
fits AS (
    SELECT * FROM (
        SELECT target, score, pos_ge, neg_ge, row_number() OVER (PARTITION BY target ORDER BY pos_ge DESC, score) AS r
        FROM curve JOIN b ON neg_ge <= budget AND score <= top) WHERE r = 1),
above AS (SELECT count(*) FILTER (label = 1 AND score > top) AS above, count(*) FILTER (label = 1) AS p FROM scores, top),
tar AS (
    SELECT target, budget, coalesce(score, top) AS threshold, score IS NULL AS exclusive,
        coalesce(pos_ge, above) / greatest({total}, 1) AS tar, coalesce(neg_ge, 0) / negatives AS far
    FROM b LEFT JOIN fits USING (target), above WHERE budget > 0) """


A11 = with_("scores", "curve") + tar([0.01, 0.1]) + """, best AS (
    SELECT score, (pos_ge + n - neg_ge) / (p + n) AS accuracy FROM curve ORDER BY (pos_ge + n - neg_ge) / (p + n) DESC, score LIMIT 1)
SELECT 'pairs' AS metric, count(*)::DOUBLE AS value FROM scores
UNION ALL SELECT 'mean_genuine', round(avg(score) FILTER (label = 1), 6) FROM scores
UNION ALL SELECT 'mean_impostor', round(avg(score) FILTER (label <> 1), 6) FROM scores
UNION ALL SELECT 'threshold', round(score, 6) FROM best
UNION ALL SELECT 'accuracy', round(accuracy, 6) FROM best
UNION ALL SELECT 'auc', round(sum(neg / n * ((2 * pos_ge - pos) / p) / 2), 6) FROM curve
UNION ALL SELECT 'tar@' || target::VARCHAR, round(tar, 6) FROM tar"""

#: Probes and the other planted vectors: the best score of each probe with each label.
PROBES = """best AS (
    SELECT q.vec_id AS query_id, q.label AS own, g.label, max(greatest(-1, least(1, list_inner_product(q.e, g.e)))) AS score
    FROM planted q JOIN planted g ON q.vec_id % 50 = 0 AND g.vec_id % 50 <> 0 GROUP BY ALL),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS r FROM best) WHERE r <= 2),
probes AS (
    SELECT query_id, CASE WHEN own < 7 THEN own END AS truth, arg_min(label, r) AS best, max(score) AS score,
        max(score) FILTER (label <> own) AS wrong
    FROM hits GROUP BY query_id, own)"""

A12 = with_("raised1", "planted").rstrip() + ", " + PROBES + """, scores AS (
    SELECT 1 AS label, score FROM probes WHERE truth IS NOT NULL AND best = truth
    UNION ALL SELECT 0, CASE WHEN truth IS NULL THEN score ELSE wrong END FROM probes WHERE CASE
        WHEN truth IS NULL THEN score ELSE wrong END IS NOT NULL),
curve AS (
    SELECT score, pos, neg, sum(pos) OVER w AS pos_ge, sum(neg) OVER w AS neg_ge, sum(pos) OVER () AS p, sum(neg) OVER () AS n
    FROM (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM scores GROUP BY score)
        WINDOW w AS (ORDER BY score DESC))
""" + tar([0.01, 0.1, 0.5], "(SELECT count(*) FROM probes WHERE truth IS NOT NULL)") + """
SELECT target, budget, round(threshold, 6) AS threshold, exclusive, round(tar, 6) AS tar, round(far, 6) AS far FROM tar"""

A15 = with_("raised1", "planted", "vpairs") + """, f AS (SELECT *, (ntile(10) OVER (ORDER BY pair_idx) - 1)::INT AS fold FROM vpairs),
grid AS (SELECT unnest(range(4000)) AS step),
sizes AS (SELECT fold, count(*) FILTER (label <> 1) AS n FROM f GROUP BY fold),
c AS (
    SELECT fold, step, count(*) FILTER (f.fold = s.fold AND distance < step * 0.001::DOUBLE) AS neg
    FROM grid CROSS JOIN (SELECT DISTINCT fold FROM f) s JOIN (SELECT fold, distance FROM f WHERE label <> 1) f USING (fold) GROUP BY ALL),
far AS (
    SELECT fold, step, (sum(neg) OVER e - neg) / greatest(sum(n) OVER e - n, 1) AS far
    FROM c JOIN sizes USING (fold) WINDOW e AS (PARTITION BY step)),
ends AS (
    SELECT fold, max(far) AS most, max(step) FILTER (far <= 0.1) AS lo, arg_max(far, step) FILTER (far <= 0.1) AS lo_far,
        min(step) FILTER (far > 0.1) AS hi, arg_min(far, step) FILTER (far > 0.1) AS hi_far FROM far GROUP BY fold),
t AS (
    SELECT fold, coalesce(CASE WHEN most < 0.1 THEN 0.0::DOUBLE WHEN hi IS NULL THEN lo * 0.001::DOUBLE
        ELSE 0.001::DOUBLE * (lo + (0.1::DOUBLE - lo_far) / (hi_far - lo_far) * (hi - lo)) END, 0.0::DOUBLE) AS threshold FROM ends)
SELECT fold, round(any_value(threshold), 6) AS threshold,
    round(count(*) FILTER (distance < threshold AND label = 1) / greatest(count(*) FILTER (label = 1), 1), 6) AS val,
    round(count(*) FILTER (distance < threshold AND label <> 1) / greatest(count(*) FILTER (label <> 1), 1), 6) AS far
FROM f JOIN t USING (fold) GROUP BY
    fold""".replace("SELECT fold, step, count(*) FILTER (f.fold = s.fold AND distance", "SELECT fold, step, count(*) FILTER (distance")


def half(x: str, bits: int, least: int) -> str:
    """``x`` rounded to ``bits`` bits after the leading one, half to even."""
    size = f"abs({x}::FLOAT)::DOUBLE"
    near = f"pow(2.0::DOUBLE, floor(log2({size})))"
    power = f"CASE WHEN {near} > {size} THEN {near} / 2 WHEN {near} * 2 <= {size} THEN {near} * 2 ELSE {near} END"
    step = f"(greatest({power}, pow(2.0::DOUBLE, {least})) / pow(2.0::DOUBLE, {bits}))"
    return f"CASE WHEN {size} = 0 THEN 0 ELSE sign({x}) * round_even({size} / {step}, 0) * {step} END"


F_HALF = with_("gallery") + f""", c AS (
    SELECT vector_id, list_transform(embedding, lambda x: {half('x', 10, -14)}) AS h, list_transform(embedding,
        lambda x: {half('x', 7, -126)}) AS b FROM gallery)
SELECT vector_id, round(list_inner_product(h, h), 6) AS fp16, round(list_inner_product(b, b), 6) AS bf16 FROM c"""

F16 = """WITH e AS (
    SELECT event_id, value % 100 / 100 AS q, user_id % 90 - 45 AS yaw, event_id % 60 - 30 AS pitch, event_id % 40 - 20 AS roll FROM events)
SELECT event_id, round_even(greatest(0, least(1, 0.4::DOUBLE * q + 0.35::DOUBLE * q + 0.25::DOUBLE * (1 - least(1,
    (abs(yaw) + abs(pitch) + abs(roll)) / 135)))), 6) AS quality,
    array_to_string(list_filter([CASE WHEN q < 0.3::DOUBLE THEN 'blurry' END, CASE WHEN abs(yaw) > 30 THEN 'profile' END, CASE
        WHEN abs(roll) > 15 THEN 'tilted' END], lambda x: x IS NOT NULL), ',') AS reasons,
    CASE WHEN q < 0.3::DOUBLE THEN 'blurry' WHEN abs(yaw) > 30 THEN 'profile' WHEN abs(roll) > 15 THEN 'tilted' END AS first FROM e"""

J8 = with_("dets", "gts") + f""", p AS (
    SELECT d.image, d.det, {sql_iou('d', 'g')} AS iou, {sql_iou('d', 'g', 1)} AS pixel,
        greatest(least(d.x2, g.x2) - greatest(d.x1, g.x1), 0) * greatest(least(d.y2, g.y2) - greatest(d.y1, g.y1), 0) AS inter,
        (d.x2 - d.x1) * (d.y2 - d.y1) AS da, (g.x2 - g.x1) * (g.y2 - g.y1) AS ga,
        (greatest(d.x2, g.x2) - least(d.x1, g.x1)) * (greatest(d.y2, g.y2) - least(d.y1, g.y1)) AS hull,
        (d.x2 - d.x1) + (g.x2 - g.x1) - (greatest(d.x2, g.x2) - least(d.x1, g.x1)) AS w, (d.y2 - d.y1) + (g.y2 - g.y1) - (greatest(d.y2,
            g.y2) - least(d.y1, g.y1)) AS h
    FROM dets d JOIN gts g ON d.image = g.image AND d.class = g.class)
SELECT image, det, count(*) AS truths, round(max(iou), 9) AS best, round(sum(iou), 9) AS iou, round(sum(pixel), 9) AS pixel,
    round(sum(inter / da), 9) AS iof,
    round(sum(iou - (hull - (da + ga - inter)) / hull), 9) AS giou,
    round(sum(CASE WHEN w > 0 AND h > 0 THEN w * h ELSE 0 END / (da + ga - CASE WHEN w > 0 AND h > 0 THEN w * h ELSE 0 END)), 9) AS interval
FROM p GROUP BY image, det"""

X1 = recursive("dets") + nms("dets", 0.4, 1) + "SELECT * FROM kept"

X3 = recursive("dets") + ", scored AS (SELECT * FROM dets WHERE score > 0.05)" + nms("scored", 0.5, 0) + """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, det) AS rank FROM kept) WHERE rank <= 10"""

X6 = with_("dets") + """SELECT image, det // 2 AS det, round(sum(x1 * score) / sum(score), 9) AS x1, round(sum(y1 * score) / sum(score),
    9) AS y1,
    round(sum(x2 * score) / sum(score), 9) AS x2, round(sum(y2 * score) / sum(score), 9) AS y2, round(sum(score * score) / sum(score),
        9) AS score FROM dets GROUP BY ALL"""

_PAIRS = f""", p AS (SELECT d.image, d.det, d.class, d.score, d.x1, d.y1, d.x2, d.y2, g.gt, g.x1 AS gx1, g.y1 AS gy1, g.x2 AS gx2,
    g.y2 AS gy2, {sql_iou('d', 'g')} AS iou
    FROM dets d JOIN gts g ON d.image = g.image) """

X8 = with_("dets", "gts") + _PAIRS + """, c AS (
    SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY image, gt, class
            ORDER BY pow((x1 + x2) / 2 - (gx1 + gx2) / 2, 2) + pow((y1 + y2) / 2 - (gy1 + gy2) / 2, 2), det) AS r FROM p) WHERE r <= 9),
l AS (SELECT image, gt, round(avg(iou) + coalesce(stddev_samp(iou), 0), 9) AS bound FROM c GROUP BY ALL),
s AS (
    SELECT image, det, gt, iou, row_number() OVER (PARTITION BY image, det ORDER BY iou DESC, gt) AS r FROM c JOIN l USING (image, gt)
    WHERE round(iou, 9) >= bound AND least((x1 + x2) / 2 - gx1, (y1 + y2) / 2 - gy1, gx2 - (x1 + x2) / 2, gy2 - (y1 + y2) / 2) > 0.01)
SELECT d.image, d.det, coalesce(gt, -1)::BIGINT AS assigned, round(iou, 6) AS iou FROM dets d LEFT JOIN (SELECT * FROM s
    WHERE r = 1) USING (image, det)"""

X9_APPROX = with_("dets", "gts") + f""", a AS (SELECT image, det, x1, y1, x2, y2 FROM dets UNION ALL
    SELECT image, det, x1 + 2, y1, x2 + 2, y2 FROM dets),
p AS (SELECT a.image, a.det, g.gt, {sql_iou('a', 'g')} AS iou FROM a JOIN gts g ON a.image = g.image),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image, det ORDER BY iou DESC, gt) AS r FROM p) WHERE r = 1)
SELECT d.image, d.det, CASE WHEN iou >= 0.5 THEN gt WHEN coalesce(iou, 0) < 0.4 THEN -1 END::BIGINT AS assigned FROM dets d LEFT
    JOIN b USING (image, det)"""

X9_GRID = with_("dets", "gts") + _PAIRS + """, b AS (SELECT image, det, max(iou) AS top, arg_max(gt, (iou, -gt)) AS gt FROM p GROUP BY ALL),
f AS (SELECT image, det, max(gt) AS forced FROM (SELECT image, gt, arg_max(det, (iou, -det)) AS det FROM p WHERE det % 2 = 0 GROUP BY ALL)
    GROUP BY ALL)
SELECT d.image, d.det, CASE WHEN forced IS NOT NULL THEN forced WHEN d.det % 2 = 0 AND top > 0.5 THEN b.gt
    WHEN coalesce(top, 0) <= 0.4 THEN -1 END::BIGINT AS assigned
FROM dets d LEFT JOIN b USING (image, det) LEFT JOIN f USING (image, det)"""

X9_POINT = with_("dets", "gts") + """, l AS (SELECT min(class) AS lo, max(class) AS hi FROM dets),
p AS (
    SELECT d.image, d.det, gt, sqrt(pow(((d.x1 + d.x2) / 2 - (g.x1 + g.x2) / 2) / (g.x2 - g.x1),
        2) + pow(((d.y1 + d.y2) / 2 - (g.y1 + g.y2) / 2) / (g.y2 - g.y1), 2)) AS far
    FROM dets d JOIN gts g ON d.image = g.image, l
    WHERE d.class = greatest(lo, least(hi, floor((log2(greatest(g.x2 - g.x1, 1e-6) / 4) + log2(greatest(g.y2 - g.y1,
        1e-6) / 4)) / 2 + 1e-9)))),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image, gt ORDER BY far, det) AS r FROM p) WHERE r <= 3),
o AS (SELECT image, det, arg_min(gt, (far, gt)) AS gt FROM n GROUP BY ALL)
SELECT d.image, d.det, coalesce(gt, -1)::BIGINT AS assigned FROM dets d LEFT JOIN o USING (image, det)"""


def assigned(least_positive: float = 0.0) -> str:
    """CTEs that end in ``assigned``: max_iou_assign of dets to gts."""
    return with_("dets", "gts") + _PAIRS + f""", own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image, det
        ORDER BY iou DESC, gt) AS r FROM p) WHERE r = 1),
tops AS (SELECT image, gt, max(iou) AS top FROM p GROUP BY ALL),
forced AS (SELECT p.image, det, max(p.gt) AS forced FROM p JOIN tops b ON p.image = b.image AND p.gt = b.gt AND p.iou = top
    AND top >= {least_positive} GROUP BY ALL),
assigned AS (
    SELECT d.image, d.det, d.score, coalesce(forced, CASE WHEN iou >= 0.5 THEN gt
        WHEN coalesce(iou, 0) < 0.4 THEN -1 END)::BIGINT AS assigned, coalesce(iou, 0) AS iou
    FROM dets d LEFT JOIN own USING (image, det) LEFT JOIN forced USING (image, det)) """


def sampled(order: str, columns: str, n: int = 16, most: int = 4) -> str:
    """Up to ``most`` positives of an image in an order, then negatives up to ``n``."""
    return assigned() + f""", r AS (
    SELECT *, assigned >= 0 AS positive, row_number() OVER (PARTITION BY image, assigned >= 0 ORDER BY {order}, det) AS r,
        least(count(*) FILTER (assigned >= 0) OVER (PARTITION BY image), {most}) AS taken FROM assigned WHERE assigned IS NOT NULL)
SELECT {columns} FROM r WHERE r <= CASE WHEN positive THEN {most} ELSE {n} - taken END"""


X10_RANDOM = sampled(seeded("image", "det"), "image, det, assigned")
X10_HARD = sampled("score DESC", "image, det, assigned, score AS loss")
X10_INSTANCE = assigned() + f""", t AS (
    SELECT *, {seeded('image', 'det')} AS draw, row_number() OVER (PARTITION BY image, assigned
        ORDER BY {seeded('image', 'det')}, det) AS turn FROM assigned WHERE assigned >= 0)
SELECT image, det, assigned FROM t QUALIFY row_number() OVER (PARTITION BY image ORDER BY turn, draw, det) <= 8"""
X10_IOU = assigned() + f""", n AS (SELECT *, least(floor(iou / 0.5::DOUBLE * 3), 2)::BIGINT AS slot FROM assigned WHERE assigned = -1),
t AS (SELECT *, row_number() OVER (PARTITION BY image, slot ORDER BY {seeded('image', 'det')}, det) AS turn FROM n)
SELECT image, det, slot FROM t QUALIFY row_number() OVER (PARTITION BY image ORDER BY turn, slot, det) <= 9"""
X10_RANK = recursive("dets") + nms("dets", 0.5, 0) + """, j AS (SELECT d.image, d.class, d.det, d.score, (k.det IS NOT NULL)::INT AS leader
    FROM dets d LEFT JOIN kept k ON d.image = k.image AND d.class = k.class AND d.det = k.det),
w AS (SELECT *, count(*) OVER (PARTITION BY image) AS n, row_number() OVER (PARTITION BY image ORDER BY leader DESC, score DESC, det) AS r
    FROM j)
SELECT image, class, det, leader, round(sqrt((n - r + 1) / n), 6) AS weight FROM w"""

A21 = recursive("dets", "gts") + """, r AS (SELECT *, row_number() OVER (PARTITION BY image, class ORDER BY score DESC, det) AS place
    FROM dets),
near AS (
    SELECT r.image, r.class, r.place, g.gt, greatest(least(r.x2, g.x2 - 1) - greatest(r.x1, g.x1) + 1, 0) * greatest(least(r.y2,
        g.y2 - 1) - greatest(r.y1, g.y1) + 1, 0) AS inter,
        (r.x2 - r.x1 + 1) * (r.y2 - r.y1 + 1) AS da, (g.x2 - g.x1) * (g.y2 - g.y1) AS ga, (g.x2 - g.x1 + 10) * (g.y2 - g.y1 + 10) AS wide
    FROM r JOIN gts g ON r.image = g.image AND r.class = g.class AND NOT g.ignored),
able AS (SELECT image, class, place, list(gt ORDER BY inter / (da + ga - inter) DESC, gt) AS gts FROM near
    WHERE inter / (da + ga - inter) >= least(ga / wide, 0.5) GROUP BY ALL),
s AS (SELECT r.image, r.class, r.place, coalesce(gts, []) AS gts FROM r LEFT JOIN able USING (image, class, place)),
k AS (
    SELECT image, class, 0::BIGINT AS place, 0 AS tp, []::BIGINT[] AS used FROM r WHERE place = 1
    UNION ALL
    SELECT s.image, s.class, s.place, (len(list_filter(s.gts, lambda x: NOT list_contains(k.used, x))) > 0)::INT,
        list_concat(k.used, list_filter(s.gts, lambda x: NOT list_contains(k.used, x))[1:1])
    FROM k JOIN s ON s.image = k.image AND s.class = k.class AND s.place = k.place + 1)
SELECT image, class, det, score, tp, 1 - tp AS fp FROM r JOIN k USING (image, class, place)"""

A23 = recursive("dets", "gts") + f""", r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, det) AS place FROM dets),
numbers AS (SELECT unnest([5, 20, 100]) AS number),
p AS (
    SELECT number, d.image, d.place, g.gt, {sql_iou('d', 'g')} AS iou, row_number() OVER (PARTITION BY number, d.image
        ORDER BY {sql_iou('d', 'g')} DESC, g.gt, d.place) AS k
    FROM numbers JOIN r d ON d.place <= number JOIN gts g ON d.image = g.image WHERE {sql_iou('d', 'g')} >= 0.4999),
m AS (
    SELECT number, image, k, iou AS met, [gt] AS gused, [place] AS dused FROM p WHERE k = 1
    UNION ALL
    SELECT p.number, p.image, p.k, CASE WHEN list_contains(m.gused, p.gt) OR list_contains(m.dused, p.place) THEN NULL ELSE p.iou END,
        CASE WHEN list_contains(m.gused, p.gt) OR list_contains(m.dused, p.place) THEN m.gused ELSE list_append(m.gused, p.gt) END,
        CASE WHEN list_contains(m.gused, p.gt) OR list_contains(m.dused, p.place) THEN m.dused ELSE list_append(m.dused, p.place) END
    FROM m JOIN p ON p.number = m.number AND p.image = m.image AND p.k = m.k + 1),
thresholds AS (SELECT unnest([0.5, 0.7])::DOUBLE AS threshold)
SELECT number, threshold, round(count(*) FILTER (met >= threshold) / (SELECT count(*) FROM gts), 6) AS recall FROM numbers CROSS
    JOIN thresholds LEFT JOIN m USING (number) GROUP BY ALL"""

A24 = with_("dets", "gts") + f""", ends AS (SELECT min(score) AS lo, max(score) AS hi FROM dets),
b AS (SELECT d.image, d.det, (d.score - lo) / (hi - lo) AS score, g.gt, g.ignored, {sql_iou('d', 'g', 1)} AS iou FROM ends, dets d LEFT
    JOIN gts g ON d.image = g.image),
m AS (SELECT *, coalesce(iou >= 0.5, false) AS hit FROM (SELECT *, row_number() OVER (PARTITION BY image, det
    ORDER BY iou DESC NULLS LAST, gt) AS r FROM b) WHERE r = 1),
f AS (SELECT *, row_number() OVER (PARTITION BY image, gt, hit ORDER BY score DESC, det) = 1 AS first FROM m),
s AS (
    SELECT least(greatest(ceil((1 - score) * 1000 - 1 - 1e-9), 0), 999) AS step, sum((hit AND first
        AND NOT ignored)::INT) AS recalled, sum((NOT (hit AND coalesce(ignored, false)))::INT) AS proposals
    FROM f GROUP BY ALL),
c AS (
    SELECT step, sum(recalled) OVER (ORDER BY step) / (SELECT greatest(count(*) FILTER (NOT ignored), 1) FROM gts) AS recall,
        coalesce(sum(recalled) OVER (ORDER BY step) / nullif(sum(proposals) OVER (ORDER BY step), 0), 0) AS precision FROM s),
e AS (SELECT recall - coalesce(lag(recall) OVER (ORDER BY step), 0) AS width, max(precision) OVER (ORDER BY step ROWS BETWEEN CURRENT ROW
    AND UNBOUNDED FOLLOWING) AS envelope FROM c)
SELECT round(coalesce(sum(width * envelope), 0), 6) AS ap FROM e"""

_DENSE = recursive("raised2", "planted") + """, near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM planted a JOIN planted b
    ON list_inner_product(a.e, b.e) >= 0.8 - 1e-9),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 3),
edge AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (SELECT id AS node, id AS seen FROM core UNION SELECT r.node, e.b FROM reach r JOIN edge e ON e.a = r.seen),
named AS (SELECT node AS id, min(seen) AS cluster FROM reach GROUP BY node),
border AS (SELECT a AS id, min(cluster) AS cluster FROM near JOIN named ON named.id = near.b WHERE a NOT IN (SELECT id FROM core)
    GROUP BY a),
clusters AS (SELECT vec_id AS id, coalesce(n.cluster, b.cluster, -1)::BIGINT AS cluster FROM planted LEFT JOIN named n ON n.id = vec_id LEFT
    JOIN border b ON b.id = vec_id) """
X11 = _DENSE + "SELECT * FROM clusters"
X13 = _DENSE + """, own AS (SELECT id, CASE WHEN cluster = -1 THEN id ELSE cluster END AS cluster FROM clusters),
albums AS (SELECT cluster, row_number() OVER (ORDER BY min(id)) - 1 AS album FROM own GROUP BY cluster),
faces AS (SELECT album, id, id % 100 AS photo, e FROM own JOIN albums USING (cluster) JOIN planted ON vec_id = id),
means AS (SELECT album, i, avg(e[i]) AS x FROM faces, range(1, 65) t(i) GROUP BY ALL),
centres AS (SELECT album, list(x ORDER BY i) AS c FROM means GROUP BY ALL),
scored AS (SELECT album, id, photo, round(list_inner_product(e, c) / sqrt(list_inner_product(c, c)), 9) AS score FROM faces
    JOIN centres USING (album))
SELECT album, count(*) AS faces, count(DISTINCT photo) AS photos, arg_max(id, (score, -id)) AS cover FROM scored GROUP BY album"""

X12 = recursive("raised2", "planted") + """, v AS (SELECT vec_id % 8 AS part, vec_id AS id, e, row_number() OVER (PARTITION BY vec_id % 8
    ORDER BY vec_id) AS place FROM planted),
k AS (
    SELECT part, place, id, 0::BIGINT AS cluster, [e] AS sums FROM v WHERE place = 1
    UNION ALL
    SELECT part, place, id, CASE WHEN top >= 0.6 THEN best - 1 ELSE len(sums) END,
        CASE WHEN top >= 0.6 THEN list_concat(list_concat(sums[1:best - 1], [list_transform(list_zip(sums[best], e),
            lambda p: p[1] + p[2])]), sums[best + 1:]) ELSE list_append(sums, e) END
    FROM (
        SELECT *, list_max(scores) AS top, list_position(scores, list_max(scores)) AS best
        FROM (SELECT v.*, k.sums, list_transform(k.sums, lambda s: list_inner_product(s, v.e) / sqrt(list_inner_product(s, s))) AS scores
            FROM k JOIN v ON v.part = k.part AND v.place = k.place + 1)))
SELECT part, id, cluster::BIGINT AS cluster FROM k"""

X14 = recursive("gallery") + """, c AS (SELECT vector_id % 150 AS request, vector_id AS position, vector_id AS query_id, person_id,
    embedding AS e, row_number() OVER (PARTITION BY vector_id % 150 ORDER BY vector_id) AS place FROM gallery WHERE vector_id % 50 = 0),
refs AS (
    SELECT c.query_id, max(list_inner_product(c.e, g.embedding)) FILTER (g.person_id = c.person_id) AS own, max(list_inner_product(c.e,
        g.embedding)) FILTER (g.person_id <> c.person_id) AS other
    FROM c JOIN gallery g ON g.vector_id % 50 <> 0 GROUP BY ALL),
mates AS (
    SELECT a.query_id, list(struct_pack(id := b.query_id, same := a.person_id = b.person_id, s := list_inner_product(a.e, b.e))) AS mates
    FROM c a JOIN c b ON a.request = b.request AND b.place < a.place GROUP BY ALL),
n AS (SELECT c.*, own, other, coalesce(mates, []) AS mates FROM c LEFT JOIN refs USING (query_id) LEFT JOIN mates USING (query_id)),
k AS (
    SELECT request, 0::BIGINT AS place, NULL::BIGINT AS query_id, NULL::BOOLEAN AS accepted, NULL::DOUBLE AS own, NULL::DOUBLE AS other,
        []::BIGINT[] AS held FROM n WHERE place = 1
    UNION ALL
    SELECT request, place, query_id, own IS NULL OR own > other, own, other, CASE
        WHEN own IS NULL OR own > other THEN list_append(held, query_id) ELSE held END FROM (
        SELECT n.request, n.place, n.query_id, k.held,
            list_max(list_append(list_transform(list_filter(n.mates, lambda m: m.same
            AND list_contains(k.held, m.id)), lambda m: m.s), n.own)) AS own,
            coalesce(list_max(list_append(list_transform(list_filter(n.mates, lambda m: NOT m.same
            AND list_contains(k.held, m.id)), lambda m: m.s), n.other)), -1) AS other
        FROM k JOIN n ON n.request = k.request AND n.place = k.place + 1))
SELECT request, position, query_id, person_id, accepted, round(k.own, 6) AS own, round(k.other, 6) AS other FROM k
    JOIN c USING (request, query_id)"""

X16 = with_("raised1", "planted") + f""", p AS (
    SELECT a.vec_id // 50 AS batch, a.vec_id AS a_id, b.vec_id AS o_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.e,
        b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
    FROM planted a JOIN planted b ON a.vec_id // 50 = b.vec_id // 50 AND a.vec_id <> b.vec_id),
t AS (
    SELECT x.batch, x.a_id, x.o_id AS p_id, y.o_id AS n_id FROM p x JOIN p y ON x.batch = y.batch AND x.a_id = y.a_id
    WHERE x.same AND x.a_id < x.o_id AND NOT y.same AND y.d - x.d < 0.2 AND x.d < y.d)
SELECT a_id, p_id, arg_min(n_id, ({seeded('a_id', 'p_id', 'n_id')}, n_id)) AS n_id FROM t GROUP BY batch, a_id, p_id"""

X17 = f"""WITH c AS (SELECT DISTINCT c_custkey AS label FROM customer),
d AS (SELECT label, row_number() OVER (ORDER BY label <= 40 DESC, {seeded('label')}, label) AS r FROM c)
SELECT label, row_number() OVER (ORDER BY label) - 1 AS position FROM d WHERE r <= 200"""

X18 = f"""WITH r AS (SELECT o_orderkey AS id, o_custkey AS label, row_number() OVER (PARTITION BY o_custkey
    ORDER BY {seeded('o_orderkey')}, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT id, label, unnest(range(1, ceil((5 - r) / n)::BIGINT + 1))::INT AS copy FROM r WHERE r <= 4"""

K11 = f"SELECT vec_id, label, ({seeded('vec_id', seed=7)} % 16)::INT AS shard, {seeded('vec_id', seed=8)} AS position FROM embeddings"


def followed(rows: str, keys: str, order: str, wait: str) -> str:
    """CTEs that end in ``let``: of each key the first row, then always the first at least ``wait`` seconds later."""
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f""", firsts AS (SELECT {keys}, seconds, min({order}) AS {order} FROM {rows} GROUP BY ALL),
hops AS MATERIALIZED (SELECT a.{order} AS here, b.{order} AS there FROM firsts a ASOF JOIN firsts b ON {same}
    AND a.seconds + {wait} <= b.seconds),
let AS (
    SELECT arg_min({order}, (seconds, {order})) AS {order} FROM firsts GROUP BY {keys}
    UNION ALL SELECT there FROM let JOIN hops ON here = let.{order}) """


R1 = recursive("frames").rstrip() + ", f AS (SELECT monitor, seconds, face AS seq FROM frames)" + followed(
    "f", "monitor", "seq", "120::DOUBLE"
) + "SELECT monitor, round(seconds, 3) AS seconds, seq FROM f JOIN let USING (seq)"
R6 = RECURSIVE + """e AS (SELECT event_id, event_type, user_id, epoch(date_trunc('second', ts)) AS seconds
    FROM events)""" + followed("e", "event_type, user_id", "event_id", "3600") + "SELECT e.* FROM e JOIN let USING (event_id)"


S1 = with_("gallery", "feed") + """, state AS (SELECT max(seq // 10)::BIGINT AS revision, max(seq) AS max_seq FROM feed)
SELECT vector_id, person_id, round(list_sum(embedding), 6) AS total, revision, max_seq FROM gallery, state"""
S3 = with_("samples") + """SELECT sample_id, person_id, round(quality, 6) AS quality, crop_path, row_number()
    OVER (ORDER BY person_id, sample_id) AS place FROM samples"""
S5 = """WITH f AS (SELECT vec_id AS face_id, vec_id % 300 AS media_id, CASE
    WHEN vec_id % 9 <> 0 THEN embedding::DOUBLE[] END AS e, vec_id // 7 AS created FROM embeddings)
SELECT face_id, media_id, created, url AS path, round(list_sum(e), 6) AS total, row_number()
    OVER (ORDER BY created DESC, face_id DESC) AS place
FROM f JOIN pages ON page_id = media_id WHERE e IS NOT NULL"""

#: Persons of the gallery for each stated query, by best cosine; ties by the person seen first.
_LISTED = with_("gallery") + """, queries AS (SELECT vector_id AS query_id, person_id AS own, embedding AS query FROM gallery
    WHERE vector_id % 50 = 0),
pairs AS (SELECT query_id, own, vector_id, person_id, list_cosine_similarity(query, embedding) AS score FROM queries, gallery
    WHERE vector_id % 50 <> 0),
best AS (SELECT query_id, own, person_id, max(score) AS score, arg_max(vector_id, (score, -vector_id)) AS vector_id FROM pairs
    GROUP BY ALL),
seen AS (SELECT person_id, min(vector_id) AS first FROM gallery WHERE vector_id % 50 <> 0 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank FROM best JOIN seen USING (person_id)) """
T5 = _LISTED + """SELECT query_id, rank, person_id, vector_id, round(score, 6) AS score, CASE
    WHEN score >= 0.3 THEN 'matched' ELSE 'below_threshold' END AS status FROM ranked WHERE rank <= 5"""
T7 = _LISTED + "SELECT query_id, rank, person_id, round(score, 6) AS score FROM ranked"
J5 = with_("gallery") + """SELECT q.vector_id AS query_id, g.vector_id, (q.person_id = g.person_id)::INT AS label,
    round(list_inner_product(q.embedding, g.embedding), 6) AS score
FROM gallery q, gallery g WHERE q.vector_id % 50 = 0 AND g.vector_id % 50 <> 0"""
A13 = _LISTED + """, e AS (
    SELECT query_id, any_value(CASE WHEN own % 3 <> 0 THEN own END) AS truth, max(score) FILTER (rank = 1) AS top,
        min(rank) FILTER (person_id = own AND own % 3 <> 0) AS place
    FROM ranked WHERE rank <= 5 GROUP BY query_id)
SELECT count(*) AS probes, round(count(*) FILTER (place <= 1) / count(truth), 6) AS top1, round(count(*) FILTER (place <= 5) / count(truth),
    6) AS topk,
    round(count(*) FILTER (top < 0.36) / count(*), 6) AS unknown_rejection_rate FROM e"""


def _tpir(name: str, parity: int) -> str:
    """CTEs of one gallery, planted vectors of ids of a parity and labels under 6; probes are the stated ones."""
    return f""", {name}_s AS (
    SELECT q.vec_id AS query_id, max(list_inner_product(q.e, g.e)) FILTER (g.label = q.label) AS own, max(list_inner_product(q.e,
        g.e)) FILTER (g.label <> q.label) AS other
    FROM planted q JOIN planted g ON q.vec_id % 50 = 0 AND g.vec_id % 50 <> 0 AND g.vec_id % 2 = {parity} AND g.label < 6 GROUP BY ALL),
{name}_n AS (SELECT other, row_number() OVER (ORDER BY other DESC) AS place, count(*) OVER () AS n FROM {name}_s WHERE own IS NULL),
{name}_t AS (SELECT far, other AS threshold FROM fars JOIN {name}_n ON place = greatest(floor(n * far) - 1, 0) + 1),
{name} AS (SELECT far, count(*) FILTER (own > other AND own > threshold) / count(*) AS tpir FROM {name}_t, {name}_s WHERE own IS NOT NULL
    GROUP BY far)"""


A18 = with_("raised1", "planted").rstrip() + ", fars AS (SELECT unnest([0.01, 0.3, 0.8])::DOUBLE AS far)" + _tpir("a", 0) + _tpir("b", 1) + """
SELECT far, round((a.tpir + b.tpir) / 2, 6) AS tpir FROM a JOIN b USING (far)"""

AREAS = {"small": (0.0, 800.0), "large": (800.0, 1e6)}
_CASES = " UNION ALL ".join(f"SELECT '{n}' AS area, {lo}::DOUBLE AS lo, {hi}::DOUBLE AS hi" for n, (lo, hi) in AREAS.items())
A22_AREAS = with_("dets", "gts") + f""", areas AS ({_CASES}),
b AS (
    SELECT * FROM (
        SELECT d.*, g.gt, g.ignored, (g.x2 - g.x1) * (g.y2 - g.y1) AS gs, {sql_iou('d', 'g')} AS iou,
            row_number() OVER (PARTITION BY d.image, d.class, d.det ORDER BY {sql_iou('d', 'g')} DESC NULLS LAST, g.gt) AS r
        FROM dets d LEFT JOIN gts g ON d.image = g.image AND d.class = g.class) WHERE r = 1),
h AS (SELECT *, coalesce(iou >= 0.5, false) AS hit FROM b),
f AS (SELECT *, row_number() OVER (PARTITION BY image, class, hit, gt ORDER BY score DESC, det) = 1 AS first FROM h),
m AS (
    SELECT area, class, image, det, score, (hit AND NOT ignored AND gs >= lo AND gs < hi AND first)::INT AS tp,
        ((hit AND NOT ignored AND gs >= lo AND gs < hi AND NOT first) OR (NOT hit AND (x2 - x1) * (y2 - y1) >= lo
            AND (x2 - x1) * (y2 - y1) < hi))::INT AS fp
    FROM f, areas),
t AS (SELECT area, class, count(*) AS truths FROM gts JOIN areas ON (x2 - x1) * (y2 - y1) >= lo AND (x2 - x1) * (y2 - y1) < hi
    WHERE NOT ignored GROUP BY ALL),
c AS (SELECT area, class, sum(coalesce(tp, 0)) OVER w AS tps, sum(coalesce(fp, 0)) OVER w AS fps FROM m
    WINDOW w AS (PARTITION BY area, class ORDER BY score DESC, image, det)),
pr AS (SELECT area, class, tps / truths AS recall, max(tps / greatest(tps + fps, 1)) AS precision FROM c JOIN t USING (area, class)
    GROUP BY ALL),
e AS (
    SELECT area, class, max(precision) OVER (PARTITION BY area, class ORDER BY recall ROWS BETWEEN CURRENT ROW
        AND UNBOUNDED FOLLOWING) AS envelope,
        recall - coalesce(lag(recall) OVER (PARTITION BY area, class ORDER BY recall), 0) AS width FROM pr),
a AS (SELECT area, class, sum(width * envelope) AS ap FROM e GROUP BY ALL)
SELECT area, class, truths, round(coalesce(ap, 0), 6) AS ap FROM t LEFT JOIN a USING (area, class)"""

SETTINGS = {"easy": 30, "medium": 25, "hard": 0}


def face_setting(side: int) -> str:
    """``A24`` with the truths of at least ``side`` pixels of height."""
    return A24.replace("g.ignored", f"g.y2 - g.y1 < {side} AS ignored").replace("FILTER (NOT ignored)", f"FILTER (y2 - y1 >= {side})")


A24_SETTINGS = " UNION ALL ".join(f"SELECT '{name}' AS setting, ap FROM ({face_setting(side)})" for name, side in SETTINGS.items())

F25 = with_("dets") + """SELECT image, det, round((x1 + x2) / 2 - x1, 6) AS d_left, round(greatest(0, least(y2 - 20, 29.9)), 6) AS d_bottom,
    greatest(0, least((x1 + x2) / 2 + 12, 50)) AS decoded_x2,
    x1 + 5 - 30 AS mark_dx, greatest(0, least(y2 - 40, 9.9)) AS mark_dy, greatest(0, least(x1 + 2 * score, 45)) AS mark_x FROM dets"""

F25_OKS = with_("dets") + """, o AS (
    SELECT image, det, x1, y1, x2, y2, (x2 - x1) * (y2 - y1) AS area, [det % 2, det % 3, 0] AS seen,
        [[x1 + 1, y1 + 2], [x1 + 4, y1 + 4], [x2 - 3, y2 - 60]] AS p, [[x1, y1], [x1 + 2, y1 + 2], [x2, y2]] AS g FROM dets),
e AS (
    SELECT *, list_transform(range(1, 4), lambda i: exp(-(pow(p[i][1] - g[i][1], 2) + pow(p[i][2] - g[i][2], 2)) / pow(2 * [0.1, 0.05,
        0.2][i], 2) / (area + pow(2.0::DOUBLE, -52)) / 2)) AS near,
        list_transform(range(1, 4), lambda i: exp(-(pow(greatest(2 * x1 - x2 - p[i][1], 0) + greatest(p[i][1] - 2 * x2 + x1, 0),
            2) + pow(greatest(2 * y1 - y2 - p[i][2], 0) + greatest(p[i][2] - 2 * y2 + y1, 0), 2))
            / pow(2 * [0.1, 0.05, 0.2][i], 2) / (area + pow(2.0::DOUBLE, -52)) / 2)) AS far FROM o),
u AS (SELECT image, det, CASE WHEN list_sum(seen) > 0 THEN list_filter(near, lambda x, i: seen[i] > 0) ELSE far END AS used FROM e)
SELECT image, det, round(list_sum(used) / len(used), 6) AS oks FROM u"""

F38 = """WITH p AS (SELECT l_orderkey AS face, l_linenumber % 3 AS i, l_partkey % 50 AS x, l_suppkey % 30 AS y, l_quantity AS z,
    l_partkey % 47 AS tx, l_suppkey % 31 AS ty, l_quantity + l_discount AS tz FROM lineitem)
SELECT face, round(avg(sqrt(pow(x - tx, 2) + pow(y - ty, 2) + pow(z - tz, 2))) / sqrt(pow(max(tx) - min(tx), 2) + pow(max(ty) - min(ty),
    2) + pow(max(tz) - min(tz), 2)), 6) AS by_box
FROM p GROUP BY face HAVING max(abs(tx) + abs(ty) + abs(tz)) > 0
    AND sqrt(pow(max(tx) - min(tx), 2) + pow(max(ty) - min(ty), 2) + pow(max(tz) - min(tz), 2)) > 0"""

K3 = with_("samples") + """, a AS (SELECT sample_id AS position, person_id FROM samples WHERE crop_path IS NOT NULL),
t AS (SELECT person_id, row_number() OVER (ORDER BY min(position)) AS turn FROM a GROUP BY person_id)
SELECT 5000 + row_number() OVER (ORDER BY position) AS seq, 70 + turn AS revision, 'add' AS op, 900000 + row_number()
    OVER (ORDER BY position) AS vector_id, person_id FROM a JOIN t USING (person_id)"""

K12 = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), top AS (SELECT max(vec_id) AS last FROM v
    WHERE vec_id % 3 <> 0),
h AS (SELECT vec_id AS id, e FROM v WHERE vec_id % 3 <> 0 UNION ALL SELECT last + row_number() OVER (ORDER BY vec_id), e FROM v, top
    WHERE vec_id % 3 = 0)
SELECT id, round(CASE WHEN id % 7 = 0 THEN e[64] ELSE e[1] END, 6) AS first FROM h WHERE id % 11 <> 0"""

K10 = """WITH r AS (SELECT o_orderkey AS id, o_totalprice AS score, o_orderpriority AS note FROM orders), l AS (SELECT max(id) AS last
    FROM r)
SELECT id, score, note FROM r UNION ALL SELECT last + row_number() OVER (ORDER BY c_custkey), c_acctbal, NULL FROM customer, l"""

U4 = """SELECT c_custkey AS id, c_acctbal AS score FROM customer WHERE c_mktsegment <> 'BUILDING'
UNION ALL SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer
    WHERE c_mktsegment <> 'BUILDING')"""

R11 = with_("frames") + """, f AS (SELECT monitor, face AS seq, seconds, (person IS NOT NULL)::INT AS matched,
    (person IS NULL)::INT AS unknown FROM frames),
w AS (SELECT monitor, count(*) AS n, max(seconds) - min(seconds) AS span FROM (SELECT *, row_number() OVER (PARTITION BY monitor
    ORDER BY seq DESC) AS r FROM f) WHERE r <= 120 GROUP BY monitor),
a AS (
    SELECT monitor, count(*) AS processed, max(seq) - min(seq) + 1 AS decoded, max(seq) AS last_seq, max(seconds) AS last_seconds,
        arg_max(matched, seq) AS matched, arg_max(unknown, seq) AS unknown FROM f GROUP BY monitor)
SELECT monitor, processed, decoded, decoded - processed AS dropped, last_seq, round(last_seconds, 3) AS last_seconds, CASE WHEN n > 1
    AND span > 0 THEN round((n - 1) / span, 3) ELSE 0 END AS actual_fps, matched, unknown
FROM a JOIN w USING (monitor)"""

A28 = """SELECT event_type, count(value) AS runs, round(avg(value), 6) AS mean_ms, min(value) AS least_ms, max(value) AS most_ms FROM events
    GROUP BY event_type"""

X2 = recursive("dets") + nms("dets", 0.5, 1).replace("> 0.5)", ">= 0.5)").replace(") > 0.5", ") >= 0.5") + "SELECT * FROM kept"
_UNION = """, whole AS (SELECT image, 0 AS class, det, x1, y1, x2, y2, score FROM dets UNION ALL
    SELECT image, 0, det + 1000, x1 + 1, y1, x2 + 1, y2, score * 0.9 FROM dets)"""
X5 = recursive("dets").rstrip() + _UNION + nms("whole", 0.4, 1) + """SELECT image, det, rank FROM (SELECT image, det, row_number()
    OVER (PARTITION BY image ORDER BY score DESC, det) AS rank FROM kept) WHERE rank <= 12"""
X6_NMS = recursive("dets").rstrip() + _UNION + nms("whole", 0.4, 0) + """SELECT image, det, rank FROM (SELECT image, det, row_number()
    OVER (PARTITION BY image ORDER BY score DESC, det) AS rank FROM kept) WHERE rank <= 12"""

F27 = with_("dets") + """, b AS (SELECT *, x2 - x1 AS w, y2 - y1 AS h, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM dets)
SELECT image, det, round(greatest(0, least(x1, 45)), 0)::INT AS public_x1, round_even(greatest(0, least(x2 + 0.5, 45)),
    0)::INT AS public_x2, round((greatest(0, least(x2, 45)) - greatest(0, least(x1, 45))) / 45, 6) AS share_w,
    floor(greatest(0, least(x1 - w * 0.1, 50)))::INT AS crop_x1, round((20 - y1) / 40 / 4, 6) AS top, round((cx - 20) / 8 + 0.5,
        6) AS raw_x, round(greatest(1e-6, least((cx - 20) / 8 + 0.5, 1 - 1e-6)), 6) AS yolo_x, round(ln(w / 40), 6) AS yolo_w,
    round((x1 + 0.5 * (w + 1 - 1) - 20) / (41 + 1e-14), 6) AS inclusive_dx, round(ln((h + 1) / 41), 6) AS inclusive_dh,
        round((x1 + 3 - 20) / 41, 6) AS mark_x, 40 - x2 AS flipped, round(cx - w * 0.75, 6) AS wider_x1
FROM b"""

F15 = """WITH e AS (SELECT event_id, value % 100 / 100 AS q, user_id % 90 - 45 AS yaw, event_id % 60 - 30 AS pitch,
    event_id % 40 - 20 AS roll, event_id % 120 AS w, user_id % 100 AS h FROM events)
SELECT event_id, round(greatest(0, least(1, 0.35::DOUBLE * q + 0.25::DOUBLE * (1 - q) + 0.15::DOUBLE * greatest(0, least(1,
    1 - abs(q - 0.5::DOUBLE) / 0.5)) + 0.15::DOUBLE * greatest(0, least(1, least(w, h) / 80)) + 0.1::DOUBLE * greatest(0, least(1,
        1 - greatest(abs(yaw), abs(pitch), abs(roll)) / 90)))), 6) AS server,
    round(0.28::DOUBLE * q + 0.22::DOUBLE * (w / 120) + 0.22::DOUBLE * (1 - q) + 0.18::DOUBLE * (h / 100) + 0.1::DOUBLE * q, 6) AS studio,
        round(greatest(0, least(1, 1 - exp(-w / 100))), 6) AS sharp,
    array_to_string(list_sort(list_filter([CASE WHEN q < 0.3::DOUBLE THEN 'dark' END, CASE WHEN w < 40 THEN 'small' END, CASE
        WHEN abs(yaw) > 30 THEN 'blurred' END], lambda x: x IS NOT NULL)), ',') AS flags FROM e"""

F30 = """WITH e AS (SELECT event_id, (event_id % 60 - 30) / 40 AS p, (user_id % 80 - 40) / 30 AS y FROM events)
SELECT event_id, round(cos(p) * sin(y), 6) AS gx, round(sin(p), 6) AS gy, round(cos(p) * cos(y), 6) AS gz, round(asin(sin(p)), 6) AS pitch,
    round(atan2(cos(p) * sin(y), cos(p) * cos(y)), 6) AS yaw FROM e"""

F37 = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN list_transform(embedding, lambda x: 0.0::DOUBLE)
    WHEN vec_id % 7 = 0 THEN embedding[1:32]::DOUBLE[] ELSE list_transform(embedding, lambda x: x::DOUBLE * 3) END AS e FROM embeddings)
SELECT vec_id, len(e) = 64 AND list_inner_product(e, e) > 0 AS trusted, CASE WHEN len(e) = 64
    AND list_inner_product(e, e) > 0 THEN round(e[1] / sqrt(list_inner_product(e, e)), 6) END AS first FROM v"""

T8 = with_("gallery", "queries", "pairs") + """, r AS (SELECT query_id, vector_id, score, row_number() OVER (PARTITION BY query_id
    ORDER BY score DESC, vector_id) AS rank FROM pairs WHERE vector_id % 50 <> 0)
SELECT q.query_id, coalesce(vector_id, -1)::BIGINT AS vector_id, round(coalesce(score, 0), 6) AS score FROM queries q LEFT JOIN (SELECT *
    FROM r WHERE rank = 1 AND score >= 0.35) r ON r.query_id = q.query_id"""
T8_TOP = T8[: T8.index("SELECT q.query_id, coalesce")] + """SELECT query_id, rank, vector_id, round(score, 6) AS score FROM r
    WHERE rank <= 5 AND score >= 0.3"""
T11 = with_("dets") + "SELECT image, class, arg_max(det, (score, -det)) AS det, max(score) AS score FROM dets GROUP BY ALL"
T17 = with_("gallery") + """, f AS (SELECT vector_id AS query_id, vector_id // 200 AS frame, vector_id * 37 % 101 AS area,
    embedding AS query FROM gallery WHERE vector_id % 50 = 0),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY area DESC, query_id) AS place FROM f) WHERE place <= 2),
b AS (
    SELECT * FROM (
        SELECT frame, place, query_id, person_id, list_inner_product(query, embedding) AS score, row_number() OVER (PARTITION BY query_id
            ORDER BY list_inner_product(query, embedding) DESC, person_id) AS r
        FROM t, gallery WHERE vector_id % 50 <> 0) WHERE r = 1)
SELECT frame, place, query_id, CASE WHEN score >= 0.35 THEN person_id END AS person_id, round(score, 6) AS score, CASE
    WHEN score >= 0.35 THEN 'matched' ELSE 'unknown' END AS status FROM b"""

X18_GROUPS = f"""WITH r AS (SELECT o_orderkey AS id, o_custkey % 7 AS "group", row_number() OVER (PARTITION BY o_custkey % 7
    ORDER BY {seeded('o_orderkey')}, o_orderkey) - 1 AS place, count(*) OVER (PARTITION BY o_custkey % 7) AS n FROM orders),
p AS (SELECT id, "group", unnest(range(place, (ceil(n / 64) * 64)::BIGINT, n)) AS place FROM r)
SELECT id, "group", place // 64 AS batch, place % 64 AS slot FROM p"""
X18_REPLICAS = f"""WITH r AS (SELECT c_custkey AS id, row_number()
    OVER (ORDER BY {seeded('c_custkey', seed=3)}, c_custkey) - 1 AS place, count(*) OVER () AS n FROM customer),
p AS (SELECT id, unnest(range(place, (ceil(n / 7) * 7)::BIGINT, n)) AS place FROM r)
    SELECT id, (place % 7)::INT AS replica, place // 7 AS step FROM p"""
U6 = """WITH c AS (SELECT DISTINCT l_orderkey AS image, l_suppkey AS class
    FROM lineitem), f AS (SELECT class, greatest(1, sqrt(0.01::DOUBLE / (count(*) / (SELECT count(DISTINCT image) FROM c)))) AS f FROM c
        GROUP BY class),
i AS (SELECT image, max(f) AS factor FROM c JOIN f USING (class) GROUP BY image)
SELECT o_orderkey AS image, unnest(range(1, ceil(factor)::BIGINT + 1))::INT AS copy FROM orders JOIN i ON image = o_orderkey"""
J10 = "SELECT url AS path FROM pages WHERE page_id % 4 <> 1"
J11 = "SELECT c_custkey AS probe, c_nationkey AS subject, c_nationkey * 10 AS position FROM customer"
F23 = with_("frames") + """, f AS (SELECT face, (face % 50) / 100 AS l, (face % 40) / 100 AS t FROM frames)
SELECT a.face, round(coalesce(CASE WHEN b.face IS NULL THEN NULL ELSE greatest(0.3::DOUBLE - abs(a.l - b.l),
    0) * greatest(0.3::DOUBLE - abs(a.t - b.t), 0) / (0.18::DOUBLE - greatest(0.3::DOUBLE - abs(a.l - b.l),
        0) * greatest(0.3::DOUBLE - abs(a.t - b.t), 0)) END, 0), 6) AS iou
FROM f a LEFT JOIN f b ON b.face = a.face + 1"""
