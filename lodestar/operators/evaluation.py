"""Verification and identification metrics over scored rows ``(label, score)``; label 1 is a genuine pair."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.cumulative import running_totals


def confusion(scores: DataFrame, threshold: float) -> DataFrame:
    """Counts, accuracy, FAR = FP / max(1, N) and FRR = FN / max(1, P) of accepting score >= threshold."""
    hit, true = F.col("score") >= threshold, F.col("label") == 1
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    cells = scores.agg(
        count(hit & true).alias("tp"), count(~hit & ~true).alias("tn"), count(hit & ~true).alias("fp"), count(~hit & true).alias("fn")
    )
    total = F.greatest(F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"), F.lit(1))
    return cells.select(
        "*",
        ((F.col("tp") + F.col("tn")) / total).alias("accuracy"),
        (F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), F.lit(1))).alias("far"),
        (F.col("fn") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))).alias("frr")
    )


def score_curve(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A row for each distinct score: genuine and impostor rows at it (pos, neg) and at or above it (pos_ge, neg_ge), and the totals p and n."""
    keys = keys or []
    at = scores.groupBy(*keys, "score").agg(
        F.sum((F.col("label") == 1).cast("long")).alias("pos"), F.sum((F.col("label") != 1).cast("long")).alias("neg")
    )
    curve = running_totals(at, "score", ["pos", "neg"], keys=keys).withColumnsRenamed({"pos_to_here": "pos_ge", "neg_to_here": "neg_ge"})
    totals = at.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return curve.join(totals, keys) if keys else curve.crossJoin(F.broadcast(totals))


def best_threshold(scores: DataFrame) -> DataFrame:
    """The score at which accepting it and above is most accurate, the lowest such; and that accuracy."""
    accuracy = (F.col("pos_ge") + F.col("n") - F.col("neg_ge")) / (F.col("p") + F.col("n"))  # a curve has a row or more
    best = score_curve(scores).agg(
        F.max_by(F.struct("score", accuracy.alias("accuracy")), F.struct(accuracy.alias("accuracy"), -F.col("score"))).alias("b")
    )
    return best.select(F.col("b.score").alias("threshold"), F.col("b.accuracy").alias("accuracy"))


def tar_at_far(scores: DataFrame, targets: list[float], positive_total: int | None = None) -> DataFrame:
    """For each target with a budget floor(target * impostors) of at least 1: the most genuine accepts within it, at the least threshold.

    If more impostors than the budget share the top impostor score, only scores above it will do:
    ``threshold`` is then that score with ``exclusive`` true. ``positive_total`` may exceed the scored rows.
    """
    curve = score_curve(scores)
    goals = scores.sparkSession.createDataFrame([(float(t),) for t in targets], "target double")
    top = scores.where("label <> 1").agg(F.max("score").alias("top"), F.count("*").alias("negatives"))
    ranked = curve.crossJoin(F.broadcast(goals)).crossJoin(F.broadcast(top)).withColumn(
        "budget", F.floor(F.col("target") * F.col("negatives")).cast("long")
    )
    fits = (F.col("neg_ge") <= F.col("budget")) & (F.col("score") <= F.col("top"))
    chosen = ranked.where("budget > 0").groupBy("target", "budget").agg(
        F.max_by(F.struct("score", "pos_ge", "neg_ge"), F.when(fits, F.struct("pos_ge", -F.col("score")))).alias("b"),
        F.coalesce(F.max(F.when(F.col("score") > F.col("top"), F.col("pos_ge"))), F.lit(0)).alias("above"),
        F.first("top").alias("top"), F.first("p").alias("p"), F.first("negatives").alias("negatives"))
    exclusive = F.col("b").isNull()
    total = F.lit(positive_total) if positive_total is not None else F.col("p")
    return chosen.select(
        "target",
        "budget",
        F.when(exclusive, F.col("top")).otherwise(F.col("b.score")).alias("threshold"),
        exclusive.alias("exclusive"),
        (F.when(exclusive, F.col("above")).otherwise(F.col("b.pos_ge")) / F.greatest(total, F.lit(1))).alias("tar"),
        (F.when(exclusive, F.lit(0)).otherwise(F.col("b.neg_ge")) / F.col("negatives")).alias("far")
    )


def tar_at_far_kyc(scores: DataFrame, targets: list[float]) -> DataFrame:
    """The highest TAR at a FAR of at most the target; status ``insufficient data`` under max(20, int(1 / target)) impostors."""
    curve = score_curve(scores)
    goals = scores.sparkSession.createDataFrame([(float(t), max(20, int(1 / t))) for t in targets], "target double, least long")
    ranked = curve.crossJoin(F.broadcast(goals))
    tar = F.max(
        F.when(F.col("neg_ge") / F.greatest(F.col("n"), F.lit(1)) <= F.col("target"), F.col("pos_ge") / F.greatest(F.col("p"), F.lit(1)))
    )
    out = ranked.groupBy("target", "least").agg(F.coalesce(tar, F.lit(0.0)).alias("tar"), F.first("n").alias("n"))
    enough = F.col("n") >= F.col("least")
    return out.select(
        "target", F.when(enough, F.col("tar")).alias("tar"), F.when(enough, "ok").otherwise("insufficient data").alias("status")
    )


def roc_auc(scores: DataFrame) -> DataFrame:
    """Area under the full ROC curve by trapezoids over distinct scores; null without genuine or without impostor rows."""
    height = F.try_divide(2 * F.col("pos_ge") - F.col("pos"), F.col("p"))
    return score_curve(scores).agg(F.sum(F.try_divide("neg", "n") * height / 2).alias("auc"))


def tpr_at_fpr(scores: DataFrame, targets: list[float]) -> DataFrame:
    """TPR where the curve's FPR is nearest to each target; of equally near points the highest TPR. The curve starts at (0, 0)."""
    curve = score_curve(scores).select(
        F.coalesce(F.try_divide("neg_ge", "n"), F.lit(0.0)).alias("fpr"), F.coalesce(F.try_divide("pos_ge", "p"), F.lit(0.0)).alias("tpr")
    )
    curve = curve.union(scores.sparkSession.createDataFrame([(0.0, 0.0)], "fpr double, tpr double"))
    goals = scores.sparkSession.createDataFrame([(float(t),) for t in targets], "target double")
    near = F.struct(F.abs(F.col("fpr") - F.col("target")), -F.col("tpr"))
    return curve.crossJoin(F.broadcast(goals)).groupBy("target").agg(F.min_by("tpr", near).alias("tpr"), F.min_by("fpr", near).alias("fpr"))


def fold_of(index, n: int, k: int):
    """Contiguous folds of 0..n-1, larger ones first."""
    q, r = divmod(n, k)
    if not q:
        return index.cast("int")
    return F.when(index < r * (q + 1), F.floor(index / (q + 1))).otherwise(r + F.floor((index - r * (q + 1)) / q)).cast("int")


def _fold_counts(pairs: DataFrame, k: int, steps: int, width: float) -> DataFrame:
    """(fold, step, pos, neg, p, n): accepted pairs (distance < threshold) of each fold and threshold. At most k x thresholds rows."""
    n = pairs.count()
    # the number of i >= 0 with i * width <= distance: a quotient may be one off, so its neighbours are compared
    near = F.floor(F.col("distance") / width)
    reached = sum((((near + i) * F.lit(width) <= F.col("distance")).cast("long") for i in (0, 1)), F.lit(0))
    step = F.least(
        F.greatest(
            near + reached - F.when(near > 0, ((near - 1) * F.lit(width) > F.col("distance")).cast("long")).otherwise(F.lit(0)), F.lit(0)
        ),
        F.lit(steps)
    ).cast("int")
    binned = pairs.select(fold_of(F.col("pair_idx"), n, k).alias("fold"), step.alias("step"), (F.col("label") == 1).alias("true"))
    counts = binned.groupBy("fold", "step").agg(
        F.sum(F.col("true").cast("long")).alias("pos"), F.sum((~F.col("true")).cast("long")).alias("neg")
    )
    grid = pairs.sparkSession.range(steps).select(F.col("id").cast("int").alias("step")).crossJoin(counts.select("fold").distinct())
    full = grid.join(counts.where(F.col("step") < steps), ["fold", "step"], "left")
    so_far = Window.partitionBy("fold").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    sizes = binned.groupBy("fold").agg(F.sum(F.col("true").cast("long")).alias("p"), F.sum((~F.col("true")).cast("long")).alias("n"))
    return full.select(
        "fold",
        "step",
        F.sum(F.coalesce("pos", F.lit(0))).over(so_far).alias("pos"),
        F.sum(F.coalesce("neg", F.lit(0))).over(so_far).alias("neg")
    ).join(sizes, "fold")


def kfold_accuracy(pairs: DataFrame, k: int = 10, steps: int = 400, width: float = 0.01) -> DataFrame:
    """Per fold of ``pairs (pair_idx from 0, label, distance)``: the first threshold of best accuracy on the other folds, and the accuracy on its own."""
    counts = _fold_counts(pairs, k, steps, width).withColumn(
        "right", F.col("pos") + F.col("n") - F.col("neg")
    ).withColumn("size", F.col("p") + F.col("n"))
    everyone = Window.partitionBy("step")
    train = counts.select(
        "fold",
        "step",
        (F.col("right") / F.col("size")).alias("accuracy"),
        F.coalesce(
            F.try_divide(F.sum("right").over(everyone) - F.col("right"), F.sum("size").over(everyone) - F.col("size")), F.lit(0.0)
        ).alias("train"),
        (F.col("pos") / F.greatest("p", F.lit(1))).alias("tpr"),
        (F.col("neg") / F.greatest("n", F.lit(1))).alias("fpr")
    )
    best = train.groupBy("fold").agg(F.max_by(F.struct("step", "accuracy"), F.struct("train", -F.col("step"))).alias("b"))
    return best.select("fold", (F.col("b.step") * F.lit(width)).alias("threshold"), F.col("b.accuracy").alias("accuracy"))


def kfold_roc(pairs: DataFrame, k: int = 10, steps: int = 400, width: float = 0.01) -> DataFrame:
    """Mean TPR and FPR over folds at each threshold."""
    counts = _fold_counts(pairs, k, steps, width)
    return counts.groupBy("step").agg(
        F.avg(F.when(F.col("p") > 0, F.col("pos") / F.col("p")).otherwise(0.0)).alias("tpr"),
        F.avg(F.when(F.col("n") > 0, F.col("neg") / F.col("n")).otherwise(0.0)).alias("fpr")
    )


def kfold_val(pairs: DataFrame, target: float = 1e-3, k: int = 10, steps: int = 4000, width: float = 0.001) -> DataFrame:
    """Per fold: the threshold at which the other folds' FAR meets ``target``, and VAL and FAR of the fold there.

    The threshold is interpolated between the last one with a FAR up to the target and the next; it is
    0 if no FAR reaches the target.
    """
    counts = _fold_counts(pairs, k, steps, width)
    everyone = Window.partitionBy("step")
    far = (F.sum("neg").over(everyone) - F.col("neg")) / F.greatest(F.sum("n").over(everyone) - F.col("n"), F.lit(1))
    train = counts.select("fold", "step", far.alias("far"))
    below = train.where(F.col("far") <= target).groupBy("fold").agg(F.max(F.struct("step", "far")).alias("lo"))
    above = train.where(F.col("far") > target).groupBy("fold").agg(F.min(F.struct("step", "far")).alias("hi"))
    reach = train.groupBy("fold").agg(F.max("far").alias("most"))
    t = F.when(F.col("most") < target, F.lit(0.0)).when(F.col("hi").isNull(), F.col("lo.step") * width).otherwise(
        width * (
            F.col("lo.step") + (target - F.col("lo.far")) / (F.col("hi.far") - F.col("lo.far")) * (F.col("hi.step") - F.col("lo.step"))
        )
    )
    chosen = reach.join(below, "fold", "left").join(above, "fold", "left").select("fold", F.coalesce(t, F.lit(0.0)).alias("threshold"))
    n = pairs.count()
    own = pairs.withColumn("fold", fold_of(F.col("pair_idx"), n, k)).join(F.broadcast(chosen), "fold")
    hit, true = F.col("distance") < F.col("threshold"), F.col("label") == 1
    return own.groupBy("fold").agg(
        F.first("threshold").alias("threshold"),
        (F.sum((hit & true).cast("long")) / F.greatest(F.sum(true.cast("long")), F.lit(1))).alias("val"),
        (F.sum((hit & ~true).cast("long")) / F.greatest(F.sum((~true).cast("long")), F.lit(1))).alias("far")
    )


def one_to_one(scores: DataFrame, targets: list[float]) -> DataFrame:
    """The 1:1 report as (metric, value): counts, mean scores, best threshold and its confusion, AUC, TAR at each target."""
    best = best_threshold(scores)
    means = scores.agg(
        F.count("*").cast("double").alias("pairs"),
        F.avg(F.when(F.col("label") == 1, F.col("score"))).alias("mean_genuine"),
        F.avg(F.when(F.col("label") != 1, F.col("score"))).alias("mean_impostor")
    )
    fixed = means.crossJoin(best).crossJoin(roc_auc(scores))
    long = fixed.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in (
                        "pairs", "mean_genuine", "mean_impostor", "threshold", "accuracy", "auc"
                    )
                ]
            )
        ).alias("m")
    ).select("m.*")
    return long.union(tar_at_far(scores, targets).select(F.concat(F.lit("tar@"), F.col("target").cast("string")), "tar"))


def open_set(probes: DataFrame, targets: list[float]) -> DataFrame:
    """1:N open-set TPIR at FPIR targets of ``probes (query_id, truth, best, score, wrong_score)``.

    Genuine scores are those of known probes (truth not null) whose best person is the true one, over
    all known probes; impostor scores are the best scores of unknown probes and the best wrong score
    of known ones.
    """
    known = F.col("truth").isNotNull()
    genuine = probes.where(known & (F.col("best") == F.col("truth"))).select(F.lit(1).alias("label"), "score")
    impostor = probes.select(
        F.lit(0).alias("label"), F.when(known, F.col("wrong_score")).otherwise(F.col("score")).alias("score")
    ).where("score is not null")
    total = probes.where(known).count()
    return tar_at_far(genuine.union(impostor), targets, positive_total=total)


def rank_rates(ranks: DataFrame, ks: list[int]) -> DataFrame:
    """Share of ``ranks (rank, null if not enrolled)`` up to each k."""
    total = F.greatest(F.count("*"), F.lit(1))
    return ranks.agg(*[(F.sum(F.coalesce((F.col("rank") <= k).cast("long"), F.lit(0))) / total).alias(f"rank_{k}") for k in ks])


def recall_at_far(positives: DataFrame, negatives: DataFrame, queries: int, fars: list[float]) -> DataFrame:
    """1:N closed recall: the threshold is the ceil(queries * far)-th largest negative score; positives strictly above it, over queries."""
    places = {f: math.ceil(queries * f) for f in fars}
    curve = running_totals(negatives.groupBy("score").agg(F.count("*").alias("at")), "score", ["at"])
    goals = negatives.sparkSession.createDataFrame([(float(f), p) for f, p in places.items()], "far double, place long")
    limits = goals.crossJoin(curve).where(F.col("at_to_here") >= F.col("place")).groupBy("far").agg(F.max("score").alias("threshold"))
    return F.broadcast(limits).crossJoin(positives.select("score")).groupBy("far", "threshold").agg(
        (F.sum((F.col("score") > F.col("threshold")).cast("long")) / F.lit(queries)).alias("recall")
    )


def open_tpir(scored: DataFrame, fars: list[float]) -> DataFrame:
    """1:N open-set identification of ``scored (query_id, own, other)`` against one gallery: (far, threshold, tpir).

    ``own`` is a probe's score with its own subject, null if that is not enrolled; ``other`` its best score
    with any other. The threshold is the max(int(n * far) - 1, 0)-th, from 0, of the n unenrolled probes'
    best scores, largest first; an enrolled probe counts if its own score exceeds all others and it.
    """
    unknown = scored.where("own is null and other is not null")
    n = unknown.count()
    known = scored.where("own is not null")
    curve = running_totals(unknown.groupBy(F.col("other").alias("score")).agg(F.count("*").alias("at")), "score", ["at"])
    goals = scored.sparkSession.createDataFrame([(float(f), max(int(n * f) - 1, 0) + 1) for f in fars], "far double, place long")
    limits = goals.crossJoin(curve).where(F.col("at_to_here") >= F.col("place")).groupBy("far").agg(F.max("score").alias("threshold"))
    right = (F.col("own") > F.coalesce("other", F.lit(float("-inf")))) & (F.col("own") > F.col("threshold"))
    hits = F.broadcast(limits).crossJoin(known.select("own", "other"))
    return hits.groupBy("far", "threshold").agg((F.sum(right.cast("long")) / F.count("*")).alias("tpir"))


def mean_open_tpir(galleries: list[DataFrame], fars: list[float]) -> DataFrame:
    """``open_tpir`` of several galleries, and their mean: (far, tpir)."""
    out = open_tpir(galleries[0], fars)
    for scored in galleries[1:]:
        out = out.unionByName(open_tpir(scored, fars))
    return out.groupBy("far").agg(F.avg("tpir").alias("tpir"))


def access_control(probes: DataFrame, hits: DataFrame, threshold: float, k: int = 5) -> DataFrame:
    """One row: probes, top-1 and top-k accuracy over those of ``probes (query_id, truth)`` with a truth, and the share not accepted.

    ``hits (query_id, rank, person_id, score)`` are the persons found; a probe is accepted if its first
    reaches the threshold, and not if it has none. Accuracies are null if no truth is known.
    """
    own = hits.join(probes, "query_id").groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"),
        F.min(F.when(F.col("person_id") == F.col("truth"), F.col("rank"))).alias("place")
    )
    each = probes.join(own, "query_id", "left")
    known = F.count("truth")
    share = lambda most: F.when(
        known > 0, F.sum((F.col("truth").isNotNull() & F.coalesce(F.col("place") <= most, F.lit(False))).cast("long")) / known
    )
    accepted = F.coalesce(F.col("top") >= threshold, F.lit(False))
    return each.agg(
        F.count("*").alias("probes"),
        share(1).alias("top1"),
        share(k).alias("topk"),
        (F.sum((~accepted).cast("long")) / F.greatest(F.count("*"), F.lit(1))).alias("unknown_rejection_rate")
    )


def latency(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs and mean, least and greatest ``elapsed_ms`` by ``keys``; null times don't count."""
    return runs.groupBy(*keys).agg(
        F.count("elapsed_ms").alias("runs"),
        F.avg("elapsed_ms").alias("mean_ms"),
        F.min("elapsed_ms").alias("least_ms"),
        F.max("elapsed_ms").alias("most_ms")
    )
