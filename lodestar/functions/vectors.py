"""Vector expressions over ARRAY columns, summed in double precision in element order."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps per unit of the two int8 storage profiles.
INT8_SCALES = {"int8": 1000, "int8_x736": 736}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalize(a: Column) -> Column:
    """a / |a|; unchanged if |a| <= 1e-12; null for null."""
    size = norm(a)
    return F.when(size <= 1e-12, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / size))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0.0 if either is null or the lengths differ."""
    return F.when(a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)), dot(normalize(a), normalize(b))).otherwise(F.lit(0.0))


def checked_cosine(a: Column, b: Column, normalized: bool = False) -> Column:
    """Cosine, or the plain product of vectors that are ``normalized``; vectors of different or no lengths are an error."""
    score = dot(a, b) if normalized else dot(normalize(a), normalize(b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), score).otherwise(
        F.raise_error(F.lit("vectors differ in size")).cast("double")
    )


def similarity(a: Column, b: Column) -> Column:
    """Dot product clipped to [-1, 1]; for unit vectors."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def is_unit(a: Column, dimension: int, tolerance: float = 2e-4) -> Column:
    """Finite, of ``dimension`` elements, and of norm 1 within ``tolerance``."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(a) == dimension) & finite & (F.abs(norm(a) - 1) <= tolerance), F.lit(False))


def decision(score: Column, threshold: float, margin: float = 0.05) -> Column:
    return F.when(score >= threshold, "same").when(score >= threshold - margin, "uncertain").otherwise("different")


def quantize_int8(a: Column, scale: int) -> Column:
    """Half away from zero after a product in single precision, clipped to -128..127."""
    return F.transform(
        a, lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), F.round(x.cast("float") * F.lit(float(scale)).cast("float")).cast("int")))
    )


def _rounded_to(bits: int, least: int, most: int):
    """Nearest number of ``bits`` bits after the leading one, ties to even; exponents under ``least`` share its step, from ``most`` it is infinite."""

    def one(x: Column) -> Column:
        size = F.abs(x.cast("float")).cast("double")
        near = F.pow(F.lit(2.0), F.floor(F.log2(size)).cast("double"))  # a power of two that a rounded logarithm may miss by one
        power = F.when(near > size, near / 2).when(near * 2 <= size, near * 2).otherwise(near)
        step = F.greatest(power, F.lit(2.0**least)) / F.lit(2.0**bits)
        out = F.rint(size / step) * step
        out = F.when(out >= F.lit(2.0**most), F.lit(float("inf"))).otherwise(out)
        plain = (size == 0) | F.isnan(size) | (size == float("inf"))
        return F.when(plain, x.cast("float")).otherwise((F.signum(x.cast("double")) * out).cast("float"))

    return one


def to_fp16(a: Column) -> Column:
    """Nearest half-precision numbers, ties to even."""
    return F.transform(a, _rounded_to(10, -14, 16))


def to_bf16(a: Column) -> Column:
    """Nearest bfloat16 numbers, ties to even."""
    return F.transform(a, _rounded_to(7, -126, 128))


def profile_similarity(a: Column, b: Column, profile: str = "fp32") -> Column:
    """Dot product under a storage profile, neither clipped nor rounded: fp32, fp16, bf16, int8 or int8_x736."""
    if profile in INT8_SCALES:
        scale = INT8_SCALES[profile]
        product = F.zip_with(quantize_int8(a, scale), quantize_int8(b, scale), lambda x, y: x * y)
        return F.aggregate(product, F.lit(0), lambda acc, x: acc + x) / F.lit(float(scale * scale))
    if profile == "fp32":
        return dot(a, b)
    cast = {"fp16": to_fp16, "bf16": to_bf16}[profile]
    return dot(cast(a), cast(b))


def calibrate(
    cos: Column, threshold: float = 0.48, middle: float = 0.6, steepness: float = 8.0, low: float = 0.01, high: float = 1.0
) -> Column:
    """A logistic map of cosines onto [low, high] that takes ``threshold`` to ``middle``."""
    bias = -math.log((high - middle) / (middle - low))
    return F.lit(high - low) / (1 + F.exp(-(steepness * (cos - threshold)) - bias)) + low


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda acc, x: acc + x
    )
