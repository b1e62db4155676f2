"""Column expressions over vectors held as arrays: distances, norms, quantisation, codes.

All sums are folds from the left in double precision over exactly widened coordinates; NumPy kernels
elsewhere keep that order, so every strategy decides membership by the same number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def squared_l2(a, b) -> Column:
    """Sum of squared differences: the distance that decides every Euclidean join."""
    return _fold(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def l1(a, b) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def linf(a, b) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def dot(a, b) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a) -> Column:
    return F.sqrt(_fold(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def levelled(a) -> Column:
    """A vector divided by a power of two near its largest coordinate: cosines stay the same to the last bit, and no square overflows or vanishes."""
    top = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    power = F.when(top > 0, F.pow(F.lit(2.0), F.floor(F.log2(top)))).otherwise(F.lit(1.0))
    return F.transform(a, lambda x: x.cast("double") / power)


def cosine(a, b) -> Column:
    """0 where one of the vectors is zero."""
    a, b = levelled(a), levelled(b)
    norms = norm(a) * norm(b)
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def angle(a, b) -> Column:
    """Degrees between two vectors; cosines beyond 1 by rounding count as 1."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b)))))


def integer_squared_l2(a, b) -> Column:
    """Exact squared distance of bigint vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda t, x: t + x)


def normalised(a) -> Column:
    """The vector over its norm; a zero vector is an error."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a))).otherwise(F.raise_error(F.lit("zero vector")))


def quantisation_scale(a) -> Column:
    """Largest magnitude over 127; 1 for a zero vector."""
    top = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    return F.when(top > 0, top / 127).otherwise(F.lit(1.0))


def quantised(a, scale) -> Column:
    """Codes from -127 to 127, rounded half to even."""
    return F.transform(a, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x.cast("double") / scale))).cast("tinyint"))


def packed_pair(i, j, n) -> Column:
    """Row-major number of a pair."""
    return F.col(i) * F.lit(n) + F.col(j) if isinstance(i, str) else i * n + j


def cell(column, origin, width) -> Column:
    return F.floor((column - origin) / width).cast("long")


def morton3(x, y, z, bits: int = 10) -> Column:
    """Interleaved bits of three non-negative integers."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for k, c in enumerate((x, y, z)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1).cast("long")), 3 * b + k))
    return out


def condensed_pair(k, n: int) -> tuple[Column, Column]:
    """Row and column of position k among the pairs i < j of n rows, in order."""
    k = k.cast("double")
    i = F.floor((2 * n - 1 - F.sqrt(F.lit(float((2 * n - 1) ** 2)) - 8 * k)) / 2).cast("long")
    begin = lambda r: r * (2 * n - r - 1) / 2
    i = F.when(begin(i + 1) <= k, i + 1).when(begin(i) > k, i - 1).otherwise(i)
    return i, (k - begin(i)).cast("long") + i + 1


def hadamard(a, size: int) -> Column:
    """Orthonormal Walsh-Hadamard transform of a vector of a power of two coordinates: distances are kept."""
    if size & (size - 1) or size < 1:
        raise ValueError("the size is a power of two")
    sign = lambda i, k: F.when(F.bit_count(i.bitwiseAND(k)) % 2 == 0, 1.0).otherwise(-1.0)
    places = F.sequence(F.lit(0), F.lit(size - 1))
    return F.transform(places, lambda k: _fold(F.zip_with(a, places, lambda x, i: x.cast("double") * sign(i, k))) / size**0.5)
