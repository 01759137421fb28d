"""Array arithmetic on JVM-side array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(vec: Column | str) -> Column:
    return _col(vec).cast("array<double>")


def normalize_pixels(pixels: Column | str) -> Column:
    """0..255 to [-1, 1] with mean and deviation one half."""
    return F.transform(_col(pixels), lambda x: (x / F.lit(255.0) - 0.5) / 0.5)


def denormalize_pixels(pixels: Column | str) -> Column:
    """[-1, 1], clamped, to [0, 1]."""
    return F.transform(
        _col(pixels), lambda x: (F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0)) + 1.0) / 2.0
    )


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(vec: Column | str) -> Column:
    return F.sqrt(F.aggregate(as_double(vec), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(vec: Column | str) -> Column:
    """Vector over its norm; the zero vector has no direction and gives null."""
    norm = l2_norm(vec)
    return F.when(norm > 0, F.transform(as_double(vec), lambda x: x / norm))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine as dot over the product of norms: no normalised copy is built."""
    norms = l2_norm(a) * l2_norm(b)
    return F.when(norms > 0, dot(a, b) / norms)


def has_rank(shape: Column | str, rank: int, values: Column | str | None = None) -> Column:
    """True where the shape has ``rank`` axes and, if given, fits the number of values."""
    ok = F.size(_col(shape)) == rank
    if values is not None:
        cells = F.aggregate(_col(shape), F.lit(1).cast("bigint"), lambda acc, n: acc * n)
        ok = ok & (cells == F.size(_col(values)))
    return ok


def vector_text(vec: Column | str, decimals: int = 6) -> Column:
    """A vector as space-separated integers in units of 10^-decimals, for exports and diffs."""
    scale = float(10**decimals)
    units = F.transform(_col(vec), lambda x: F.round(x * scale).cast("bigint").cast("string"))
    return F.array_join(units, " ")
