"""Running totals over a global order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a task is to sum up in order, as long as there are fewer than PARTS parts.
PART_ROWS = 1 << 20
PARTS = 1 << 12
#: Rows of the sample, for each part, that the cuts between parts are taken from.
SAMPLE = 64


def _place(key: Column, cuts: list[Column]) -> Column:
    """The number of ``cuts``, which are in order, up to ``key``: by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    bounds = F.array(*cuts)
    return F.aggregate(
        steps, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.get(bounds, at + step - 1) <= key), at + step).otherwise(at)
    )


def part_of(df: DataFrame, order: str, descending: bool = True, ties: list[str] | None = None, part_rows: int = PART_ROWS) -> Column:
    """The part of a row in an order that is cut at the quantiles of a sample of ``df`` into parts of about ``part_rows`` rows.

    ``df`` is counted, and sampled if it makes more than one part.
    """
    ties = ties or []
    n = df.count()
    wanted = min(PARTS, -(-n // part_rows))
    kinds = dict(df.dtypes)
    # ties are ascending in either direction, so a descending order is an ascending one of negatives
    fields = [(-F.col(order) if descending else F.col(order)).cast(kinds[order]), *[F.col(t) for t in ties]]
    fields = [f.alias(f"k{i}") for i, f in enumerate(fields)]
    if wanted <= 1:
        return F.lit(0)
    sample = sorted(tuple(r) for r in df.select(*fields).sample(min(1.0, wanted * SAMPLE / n), seed=0).collect())
    chosen = sorted({sample[len(sample) * k // wanted] for k in range(1, wanted)}) if sample else []
    types = [kinds[order], *[kinds[t] for t in ties]]
    cuts = [F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(c, types, strict=True))]) for c in chosen]
    return _place(F.struct(*fields), cuts) if cuts else F.lit(0)


def running_totals(
    df: DataFrame,
    order: str,
    sums: list[str],
    descending: bool = True,
    keys: list[str] | None = None,
    ties: list[str] | None = None,
    maxima: list[str] | None = None,
    part_rows: int = PART_ROWS
) -> DataFrame:
    """Append ``<name>_to_here``: the total of each of ``sums`` (or greatest of ``maxima``) up to and with each row.

    Rows of equal ``order`` (numeric, not null) within ``keys`` are told apart by ``ties`` (ascending);
    without those they must be distinct. The rows are counted, and from about a million on (``part_rows``)
    the order, ties included, is cut at the quantiles of a sample into parts of about as many, so neither
    many rows nor many of one value meet in one task. Each part is summed up, and the totals of the parts
    before, keys x parts rows, are added as offsets. Rows are shuffled once, by key and part.
    """
    keys, maxima, ties = keys or [], maxima or [], ties or []
    part = part_of(df, order, descending, ties, part_rows)
    # both the totals and the windows below read one shuffle
    laid = df.withColumn("part", part).repartition(*keys, "part")
    totals = laid.groupBy(*keys, "part").agg(*[F.sum(c).alias(f"{c}_part") for c in sums], *[F.max(c).alias(f"{c}_part") for c in maxima])
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(f"{c}_part").over(earlier), F.lit(0)).alias(f"{c}_before") for c in sums]
    before += [F.max(f"{c}_part").over(earlier).alias(f"{c}_before") for c in maxima]
    offsets = totals.select(*keys, "part", *before)
    own = Window.partitionBy(*keys, "part").orderBy(
        F.desc(order) if descending else F.asc(order), *ties
    ).rowsBetween(Window.unboundedPreceding, 0)
    out = laid.join(offsets, [*keys, "part"])
    here = [(F.sum(c).over(own) + F.col(f"{c}_before")).alias(f"{c}_to_here") for c in sums]
    here += [F.greatest(F.max(c).over(own), F.col(f"{c}_before")).alias(f"{c}_to_here") for c in maxima]
    return out.select(*df.columns, *here)
