"""Pairs of blocks: how dense work over all pairs is spread.

Rows are dealt to blocks of bounded size by a hash of their id, and each block is packed once; each pair of blocks is
handled by one call of a NumPy kernel, which never holds more than two blocks, whatever the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType, StructType

from vicinage.plans.storage import BROADCAST_BYTES, measured_bytes, written

BLOCK_ROWS = 512
#: Bytes of blocks that a task holds of one side where blocks are too many to be broadcast.
GROUP_BYTES = 16 << 20
LEAST_ROWS, MOST_ROWS = 256, 2048


def block_rows(count: int) -> int:
    """Rows of a block: as many as make the copies few, and as few as give all tasks some pairs of blocks."""
    return max(LEAST_ROWS, min(MOST_ROWS, count // 16))


def checked(df: DataFrame, id_column: str, vector: str, *extra: str, largest: float | None = None) -> DataFrame:
    """id, vec and extra columns; null, ragged by type or non-finite vectors are errors when read, and with `largest` those with a coordinate beyond it."""
    bad = F.col(vector).isNull() | F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | (F.size(vector) == 0)
    vec = F.when(bad, F.raise_error(F.lit("vectors must be finite and not empty")))
    if largest is not None:
        vec = vec.when(F.exists(vector, lambda x: F.abs(x) > largest), F.raise_error(F.lit(f"coordinates must not be beyond {largest}")))
    vec = vec.otherwise(F.col(vector))
    return df.select(F.col(id_column).cast("long").alias("id"), vec.alias("vec"), *extra)


def matrix(vectors: pd.Series) -> np.ndarray:
    if vectors.map(len).nunique() > 1:
        raise ValueError("vectors of different dimensions")
    return np.stack(vectors.to_numpy()).astype(np.float64)


Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool], pd.DataFrame]


def over_tiles(left: DataFrame, right: DataFrame | None, kernel: Kernel, schema: str, rows: int | None = None) -> DataFrame:
    """kernel(ids, vectors, other ids, other vectors, same block) for each pair of blocks of id and vec.

    Without right, left is joined with itself and each unordered pair of blocks is taken once. Every block is packed
    once; what is dealt to tasks are pairs of block numbers, which then meet their blocks.
    """
    return tiles_of(left, right, rows)(kernel, schema)


def tiles_of(left: DataFrame, right: DataFrame | None, rows: int | None = None) -> Callable[[Kernel, str], DataFrame]:
    """over_tiles of some kernels one after another: blocks are packed once for all of them."""
    one, n, small_one = _packed(left, rows)
    small_two = small_one
    if right is None and not small_one:
        return lambda kernel, schema: _met_groups(one, n, None, n, kernel, schema)
    if right is None:
        two, reach = one, n // 2 + 1  # block i meets i, i + 1, ... around the circle, so that all have as many partners
        i, k = F.floor(F.col("id") / reach), F.col("id") % reach
        pairs = _numbers(one, n * reach).select(i.cast("int").alias("_i"), ((i + k) % n).cast("int").alias("_j"), k.alias("_k"))
        pairs = pairs.where((F.col("_k") * 2 < n) | ((F.col("_k") * 2 == n) & (F.col("_i") < F.col("_j")))).drop("_k")
    else:
        two, m, small_two = _packed(right, rows)
        if not small_one and not small_two:
            return lambda kernel, schema: _met_groups(one, n, two, m, kernel, schema)
        pairs = _numbers(one, n * m).select(F.floor(F.col("id") / m).cast("int").alias("_i"), (F.col("id") % m).cast("int").alias("_j"))
    return lambda kernel, schema: _met(pairs, one, two, kernel, schema, right is None, (small_one, small_two))


def over_tiles_by(df: DataFrame, key: str, kernel: Kernel, schema: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """over_tiles of the rows of each key with themselves, of key, id and vec. A key with many rows is split into blocks; null keys match nothing."""
    sizes = written(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_n")), "tile-keys")
    dealt = df.join(sizes, key).withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    packed = written(_blocks(dealt, key, "_b"), "tiles")
    each = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    pairs = sizes.select(key, "_n", each.alias("_i")).select(key, "_i", each.alias("_j")).where("_i <= _j")
    fits = measured_bytes(packed) <= BROADCAST_BYTES
    return _met(dealt_pairs(pairs), packed, packed, kernel, schema, True, (fits, fits), key)


def binned_within(left: DataFrame, right: DataFrame | None, keys: list[str], limit: float) -> DataFrame:
    """pairs_within of rows (keys, id, vec) whose keys each differ by at most 1. A bin with many rows is split into blocks."""

    def blocks(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = block_rows(df.count())
        sizes = written(df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_n")), "tile-keys")
        name = F.concat_ws(",", *keys, "_at").alias("_b")  # numbers of the bin and of the block in it
        packed = written(_blocks(df.join(sizes, keys).withColumn("_at", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int")).select(name, "id", "vec"), "_b"), "tiles")
        return packed, sizes.withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select(*keys, name)

    one, names = blocks(left)
    two, others = (one, names) if right is None else blocks(right)
    for k in keys:
        others = others.withColumn(k, F.explode(F.sequence(F.col(k) - 1, F.col(k) + 1)))
    pairs = names.withColumnRenamed("_b", "_i").join(others.withColumnRenamed("_b", "_j"), keys).select("_i", "_j")
    if right is None:
        pairs = pairs.where("_i <= _j")
    fit = tuple(measured_bytes(b) <= BROADCAST_BYTES for b in (one, two))
    within = _within(limit, "l2", False, right is None)

    def kernel(ids, x, others, y, same):
        found = within(ids, x, others, y, same)
        if right is not None or same:
            return found
        return pd.concat([found, found[found["i"] == found["j"]]])  # an id that repeats in another bin: both directions

    return _met(dealt_pairs(pairs), one, two, kernel, "i long, j long", right is None, fit)


def dealt_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs of blocks in as many partitions as there is to do."""
    pairs = written(pairs, "tile-pairs")
    count, least = pairs.count(), int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(max(1, min(count, max(least, count // 64))))


def _numbers(df: DataFrame, count: int) -> DataFrame:
    """Numbers below count, in as many partitions as there is to do."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.sparkSession.range(0, count, 1, max(1, min(count, max(least, count // 64))))


def _packed(df: DataFrame, rows: int | None) -> tuple[DataFrame, int, bool]:
    """(_b, n, dim, ids, vecs) of id and vec, dealt to blocks by the hash of the id; the number of blocks; whether they are small enough to be broadcast."""
    count, widest = df.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    n = max(1, math.ceil(count / (rows or block_rows(count))))
    fits = count * (8 + 8 * widest) <= BROADCAST_BYTES
    return written(_blocks(df.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), "_b"), "tiles"), n, fits


def _blocks(dealt: DataFrame, *by: str) -> DataFrame:
    """(by, n, dim, ids, vecs): the rows of each group as the bytes of their ids and coordinates, single or double as they are."""
    kind = np.dtype("<f4" if dealt.schema["vec"].dataType.elementType == FloatType() else "<f8")

    def pack(group: pa.Table) -> pa.Table:
        lists = group.column("vec").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        if len(np.unique(sizes)) > 1:
            raise ValueError("vectors of different dimensions")
        vecs = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
        ids = group.column("id").to_numpy().astype(np.int64)
        made = {c: group.column(c)[:1].combine_chunks() for c in by}
        made |= {"n": pa.array([len(sizes)], pa.int32()), "dim": pa.array([int(sizes[0])], pa.int32()), "ids": pa.array([ids.tobytes()]), "vecs": pa.array([vecs.tobytes()])}
        return pa.table(made)

    fields = [dealt.schema[c] for c in by]
    rows = dealt.select(*by, "id", "vec")
    return rows.groupBy(*by).applyInArrow(pack, StructType([*fields, *StructType.fromDDL("n int, dim int, ids binary, vecs binary").fields]))


def unpacked(vecs: bytes, n: int, dim: int) -> np.ndarray:
    """The packed vectors of a block as doubles."""
    kind = np.dtype("<f4" if len(vecs) == 4 * n * dim else "<f8")
    return np.frombuffer(vecs, kind).astype(np.float64).reshape(n, dim)


def _met(pairs: DataFrame, one: DataFrame, two: DataFrame, kernel: Kernel, schema: str, itself: bool, fit: tuple[bool, bool], *by: str) -> DataFrame:
    """fit: whether the blocks of either side may be broadcast. Partitions of pairs hold some tens of them, so that Arrow's batches are bounded."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.to_dict("records"):
                i, j = np.frombuffer(r["a_ids"], np.int64), np.frombuffer(r["b_ids"], np.int64)
                x, y = unpacked(r["a_vecs"], r["a_n"], r["a_dim"]), unpacked(r["b_vecs"], r["b_n"], r["b_dim"])
                if x.shape[1] != y.shape[1]:
                    raise ValueError("vectors of different dimensions")
                yield kernel(i, x, j, y, itself and r["_i"] == r["_j"])

    side = lambda df, at, name: df.select(*by, F.col("_b").alias(at), *[F.col(c).alias(f"{name}_{c}") for c in ("n", "dim", "ids", "vecs")])
    sides = [(side(one, "_i", "a"), "_i", fit[0]), (side(two, "_j", "b"), "_j", fit[1])]
    for blocks, at, small in sorted(sides, key=lambda s: s[2]):  # what is broadcast comes last, so that it isn't shuffled along
        pairs = pairs.join(F.broadcast(blocks) if small else blocks, [*by, at])
    return pairs.drop(*by).mapInPandas(run, schema)


def group_count(spark: SparkSession, size: int, count: int) -> int:
    """Into how many groups `count` blocks of `size` bytes are put whose pairs are tasks: each holds some GROUP_BYTES, and all tasks have some."""
    wanted = min(16, math.isqrt(2 * int(spark.conf.get("spark.sql.shuffle.partitions"))) + 1)
    return max(1, min(count, max(wanted, -(-size // GROUP_BYTES))))


def _met_groups(one: DataFrame, n: int, two: DataFrame | None, m: int, kernel: Kernel, schema: str) -> DataFrame:
    """kernel for each pair of blocks of one, numbered below n, and of two below m, or of one with itself.

    Blocks are put into groups of some GROUP_BYTES, and each pair of groups is a task: it holds the blocks of one group, those of the other pass by. So a
    block is shuffled once for each group of the other side, not once for each block.
    """
    itself = two is None
    size = lambda df: df.agg(F.coalesce(F.sum(F.octet_length("ids") + F.octet_length("vecs")), F.lit(0))).first()[0]
    g = group_count(one.sparkSession, size(one), n)
    h = g if itself else group_count(one.sparkSession, size(two), m)
    own = lambda count, of: F.floor(F.col("_b").cast("long") * of / count).cast("int")
    unit = lambda i, j: (j * (j + 1) / 2 + i if itself else i * h + j).cast("int")
    each = lambda low, high: F.explode(F.sequence(low, high))
    first = one.withColumn("_g", own(n, g)).select("*", each(F.col("_g") if itself else F.lit(0), F.lit(h - 1)).alias("_h"), F.lit(0).alias("_side"))
    if itself:  # a group meets itself as the first side
        other = one.withColumn("_h", own(n, g)).where("_h > 0").select("*", each(F.lit(0), F.col("_h") - 1).alias("_g"), F.lit(1).alias("_side"))
    else:
        other = two.withColumn("_h", own(m, h)).select("*", each(F.lit(0), F.lit(g - 1)).alias("_g"), F.lit(1).alias("_side"))
    columns = [unit(F.col("_g"), F.col("_h")).alias("_unit"), (F.col("_g") == F.col("_h")).alias("_same"), "_side", "_b", "n", "dim", "ids", "vecs"]
    dealt = first.select(*columns).unionByName(other.select(*columns))
    dealt = dealt.repartitionById(g * (g + 1) // 2 if itself else g * h, "_unit").sortWithinPartitions("_unit", "_side", "_b")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for frame in frames:
            for r in frame.to_dict("records"):
                if r["_unit"] != now:
                    now, held = r["_unit"], []
                j, y = np.frombuffer(r["ids"], np.int64), unpacked(r["vecs"], r["n"], r["dim"])
                if r["_side"] == 0:
                    held.append((j, y))
                    if not (itself and r["_same"]):
                        continue
                for k, (i, x) in enumerate(held):
                    if x.shape[1] != y.shape[1]:
                        raise ValueError("vectors of different dimensions")
                    yield kernel(i, x, j, y, r["_side"] == 0 and k == len(held) - 1)

    return dealt.mapInPandas(run, schema)


def folded(metric: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of the rows of x and y, summed from the left as the Column expressions do; leading axes are broadcast."""
    out = np.zeros(np.broadcast_shapes(x.shape[:-1], y.shape[:-1]))
    if metric == "cosine":
        x, y = levelled(x), levelled(y)
        a, b = np.zeros(x.shape[:-1]), np.zeros(y.shape[:-1])
        for d in range(x.shape[-1]):
            out += x[..., d] * y[..., d]
            a += x[..., d] * x[..., d]
            b += y[..., d] * y[..., d]
        norms = np.sqrt(a) * np.sqrt(b)
        return 1 - np.where(norms > 0, out / np.where(norms > 0, norms, 1.0), 0.0)
    gap = np.empty_like(out)
    for d in range(x.shape[-1]):
        with np.errstate(over="ignore"):
            np.subtract(x[..., d], y[..., d], out=gap)
            if metric == "l2":
                np.multiply(gap, gap, out=gap)
            else:
                np.abs(gap, out=gap)
            np.maximum(out, gap, out=out) if metric == "linf" else np.add(out, gap, out=out)
    return out


def folded_at(metric: str, x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, some: int = 1024) -> np.ndarray:
    """`folded` of the rows a of x with the rows b of y, as many at a time as stay in a core's cache."""
    out = np.empty(len(a))
    for at in range(0, len(a), some):
        out[at : at + some] = folded(metric, x[a[at : at + some]], y[b[at : at + some]])
    return out


def levelled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two near their largest coordinate: cosines stay the same to the last bit."""
    top = np.abs(x).max(axis=-1, initial=0.0)
    return np.ldexp(x, 1 - np.frexp(top)[1][..., None])


#: Rows that meet a block at once where all coordinates are compared: what they make stays in a core's cache.
SLAB_ROWS = 64


def slabs(metric: str, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, distances) of a few rows of x at a time with all rows of y, each summed as `folded` does."""
    y = np.asfortranarray(y)[None]
    for at in range(0, len(x), SLAB_ROWS):
        yield at, folded(metric, x[at : at + SLAB_ROWS, None], y)


def rough(metric: str, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """A cheap matrix that isn't above the distance by more than the slack that comes with it."""
    if metric == "cosine":
        x, y = levelled(x), levelled(y)
        norms = np.sqrt(np.outer((x * x).sum(1), (y * y).sum(1)))
        return 1 - np.where(norms > 0, (x @ y.T) / np.where(norms > 0, norms, 1.0), 0.0), 1e-9
    if metric == "l2":  # both blocks by one power of two, so that no square overflows or vanishes before it is summed
        power = int(np.frexp(max(np.abs(x).max(initial=0.0), np.abs(y).max(initial=0.0)))[1])
        x, y = np.ldexp(x, -power), np.ldexp(y, -power)
        xx, yy = (x * x).sum(1), (y * y).sum(1)
        slack = 1e-12 * max(xx.max(initial=0), yy.max(initial=0)) * max(1, x.shape[1])
        with np.errstate(over="ignore", under="ignore"):
            near = np.ldexp(xx[:, None] + yy[None, :] - 2 * (x @ y.T), 2 * power)
            return near, float(np.ldexp(slack, 2 * power)) + x.shape[1] * 2.0**-1022
    return coded(metric, x, y)


#: Steps of a coordinate's code in sums of absolute differences; sums of 64 coordinates fit 16 bits.
STEPS = 511


def coded(metric: str, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """l1 or linf distances of all pairs of rows by codes of 16 bits, a few rows at a time, and how far they may be off either way."""
    power = int(np.frexp(max(np.abs(x).max(initial=0.0), np.abs(y).max(initial=0.0)))[1])
    x, y = np.ldexp(x, -power), np.ldexp(y, -power)  # no difference overflows
    dim = x.shape[1]
    low = min(x.min(initial=0.0), y.min(initial=0.0))
    span = max(x.max(initial=0.0), y.max(initial=0.0)) - low
    steps = 32000 if metric == "linf" else max(STEPS, 32000 // max(1, dim))
    unit = span / steps if span > 0 else 1.0
    a, b = (np.rint((m - low) / unit).astype(np.int16) for m in (x, y))
    b = np.asfortranarray(b)[None]
    out = np.empty((len(a), len(b[0])), np.float64)
    group = dim if metric == "linf" else max(1, 32700 // (steps + 1))  # coordinates whose sum fits
    for at in range(0, len(a), SLAB_ROWS):
        part = a[at : at + SLAB_ROWS, None]
        gap, total = np.empty((2, len(part), out.shape[1]), np.int16)
        whole = np.zeros(total.shape, np.int32) if group < dim else None
        for begin in range(0, dim, group):
            total[:] = 0
            for d in range(begin, min(dim, begin + group)):
                np.subtract(part[..., d], b[..., d], out=gap)
                np.abs(gap, out=gap)
                np.maximum(total, gap, out=total) if metric == "linf" else np.add(total, gap, out=total)
            if whole is not None:
                whole += total
        np.multiply(total if whole is None else whole, unit, out=out[at : at + len(part)])
    # Each code is off by half a unit, a difference by one; the rest is for rounding, here and in the fold.
    slack = unit * (1 + 2.0**-20) * (1 if metric == "linf" else dim) + 2.0**-40 * max(1, dim)
    with np.errstate(over="ignore", under="ignore"):
        if power:
            out = np.ldexp(out, power, out=out)
        return out, float(np.ldexp(slack, power)) + dim * 2.0**-1022


def single(x: np.ndarray, y: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, float, float, int] | None:
    """(a, b, limit, slack, power): matrices of single precision whose product a @ b has the squared distances of all rows of x and y, over 2^(2 power).

    No entry is off the folded distance by more than the slack either way: it covers the rounding of the coordinates, of the product and of the fold. None if it isn't small beside the limit.
    """
    power = int(np.frexp(max(np.abs(x).max(initial=0.0), np.abs(y).max(initial=0.0)))[1])
    x, y, dim = np.ldexp(x, -power), np.ldexp(y, -power), x.shape[1]
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    with np.errstate(over="ignore", under="ignore"):
        level = float(np.ldexp(limit, -2 * power))
        slack = 5 * (dim + 16) * 2.0**-24 * float(max(xx.max(initial=0.0), yy.max(initial=0.0))) + float(np.ldexp(float(dim), -1022 - 2 * power))
    if not (slack <= level * 2.0**-8 and level < 2.0**100):
        return None
    a, b = np.empty((len(x), dim + 2), np.float32), np.empty((len(y), dim + 2), np.float32)
    a[:, :dim], a[:, dim], a[:, dim + 1] = x, xx, 1.0
    b[:, :dim], b[:, dim], b[:, dim + 1] = -2 * y, 1.0, yy
    return a, b.T, level, slack, power


#: Rows of a block that are multiplied at once: the product stays in a core's cache.
SIFT_ROWS = 512


def sifted(metric: str, x: np.ndarray, y: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of x, rows of y, sure): the pairs that may lie within the limit, row by row, and whether they surely do. The folded distance decides of the others."""
    made = single(x, y, limit) if metric == "l2" and len(x) and len(y) else None
    if made is None:
        near, slack = rough(metric, x, y)
        a, b = np.nonzero(near <= limit + slack)
        return a, b, np.zeros(len(a), bool)
    one, two, level, slack, _ = made
    upto, below = np.nextafter(np.float32(level + slack), np.float32(np.inf)), np.float32(level - slack)
    below = np.nextafter(below, np.float32(-np.inf))
    at, sure = [], []
    for begin in range(0, len(one), SIFT_ROWS):
        near = (one[begin : begin + SIFT_ROWS] @ two).ravel()
        found = np.flatnonzero(near <= upto)
        at.append(found + begin * len(y))
        sure.append(near[found] <= below)
    a, b = np.divmod(np.concatenate(at), len(y))
    return a, b, np.concatenate(sure)


def settled(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, sure: np.ndarray, limit: float, metric: str = "l2") -> np.ndarray:
    """Which pairs of sifted lie within the limit."""
    inside = sure.copy()
    inside[~sure] = folded_at(metric, x, y, a[~sure], b[~sure]) <= limit
    return inside


def pairs_within(left: DataFrame, right: DataFrame | None, limit: float, metric: str = "l2", distances: bool = False) -> DataFrame:
    """Pairs (i, j) of distance at most limit (for l2: squared distance). Self-joins give i <= j, each row with itself.

    A matrix product sifts, with slack on the safe side; the folded distance decides.
    """
    return over_tiles(left, right, _within(limit, metric, distances, right is None), "i long, j long" + (", d double" if distances else ""))


def every_pair(left: DataFrame, right: DataFrame | None, limit: float, metric: str = "l2") -> DataFrame:
    """pairs_within without any sifting: the folded distance of every pair is taken, a few rows of a block at a time."""
    itself = right is None

    def kernel(ids, x, others, y, same):
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for at, d in slabs(metric, x, y):
            a, b = np.nonzero(d <= limit)
            i, j = ids[at + a], others[b]
            if itself:
                keep = i <= j if same else np.ones(len(i), bool)
                i, j = np.minimum(i, j)[keep], np.maximum(i, j)[keep]
            found.append((i, j))
        return pd.DataFrame({"i": np.concatenate([i for i, _ in found]), "j": np.concatenate([j for _, j in found])})

    return over_tiles(left, right, kernel, "i long, j long")


def pairs_within_groups(df: DataFrame, key: str, limit: float, metric: str = "l2") -> DataFrame:
    """Pairs i <= j of rows (key, id, vec) that share a key and lie within the limit, once for each key that they share."""
    return over_tiles_by(df, key, _within(limit, metric, False, True), "i long, j long")


def progressive(df: DataFrame, ranks: tuple[int, ...], limits: tuple[float, ...]) -> DataFrame:
    """(i, j, threshold, rank) for all pairs i < j: the last rank up to which the squared distance of the leading coordinates is within the limit.

    Partial distances never fall, so a pair survives all smaller ranks too. A pair that the first rank rules out for
    a limit has no row for it. Each band is added for survivors only.
    """

    def kernel(ids, x, others, y, same):
        out = [pd.DataFrame({"i": [], "j": [], "threshold": [], "rank": []})]
        if len(ids):
            near, slack = rough("l2", x[:, : ranks[0]], y[:, : ranks[0]])
            keep = near <= max(limits) + slack
            if same:
                keep &= ids[:, None] < others[None, :]
            a, b = np.nonzero(keep)
            total, last = np.zeros(len(a)), np.zeros((len(limits), len(a)), np.int32)
            begin, alive = 0, np.arange(len(a))
            for rank in ranks:
                for d in range(begin, min(rank, x.shape[1])):
                    gap = x[a[alive], d] - y[b[alive], d]
                    total[alive] += gap * gap
                for k, limit in enumerate(limits):
                    last[k, alive[total[alive] <= limit]] = rank
                begin, alive = rank, alive[total[alive] <= max(limits)]
            i, j = np.minimum(ids[a], others[b]), np.maximum(ids[a], others[b])
            for k, limit in enumerate(limits):
                got = last[k] > 0
                out.append(pd.DataFrame({"i": i[got], "j": j[got], "threshold": limit, "rank": last[k, got]}))
        return pd.concat(out if len(out) == 1 else out[1:])

    return over_tiles(df, None, kernel, "i long, j long, threshold double, rank int")


def _within(limit: float, metric: str, distances: bool, itself: bool) -> Kernel:
    def kernel(ids, x, others, y, same):
        if not len(ids):
            return pd.DataFrame({"i": [], "j": []} | ({"d": []} if distances else {}))
        a, b, sure = sifted(metric, x, y, limit)
        if itself and same:
            keep = ids[a] <= others[b]
            a, b, sure = a[keep], b[keep], sure[keep]
        if distances:
            d = folded_at(metric, x, y, a, b)
            inside = d <= limit
            d = d[inside]
        else:
            inside = settled(x, y, a, b, sure, limit, metric)
        a, b = a[inside], b[inside]
        i, j = ids[a], others[b]
        if itself:
            i, j = np.minimum(i, j), np.maximum(i, j)
        return pd.DataFrame({"i": i, "j": j} | ({"d": d} if distances else {}))

    return kernel


def nearest(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2", itself: bool = True) -> DataFrame:
    """(q, rank, id, d): the k nearest of base for each query, ties by id. Without itself, equal ids are no match.

    Every tile gives at most k rows a query, so what is ranked together doesn't grow with the base's blocks alone.
    """

    def kernel(ids, x, others, y, same):
        if not len(ids):
            return pd.DataFrame({"q": [], "id": [], "d": []})
        near, slack = rough(metric, x, y)
        wanted = np.ones(near.shape, bool) if itself else ids[:, None] != others[None, :]
        near = np.where(wanted, near, np.inf)
        if near.shape[1] > k:
            part = np.partition(near, k - 1, axis=1)[:, k - 1 : k]
            wanted &= near <= part + 2 * slack + 1e-9 * np.abs(part)
        a, b = np.nonzero(wanted)
        d = folded_at(metric, x, y, a, b)
        order = np.lexsort((others[b], d, a))
        a, b, d = a[order], b[order], d[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)  # within its query
        a, b, d = a[place < k], b[place < k], d[place < k]
        return pd.DataFrame({"q": ids[a], "id": others[b], "d": d})

    from pyspark.sql import Window

    found = over_tiles(queries, base, kernel, "q long, id long, d double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "rank", "id", "d")


def _bins(values: np.ndarray) -> np.ndarray:
    """Numbers that don't fall as values (0 or more) rise: 4096 for each doubling, all of them below 2^23."""
    return np.maximum(values, 0.0).view(np.int64) >> 40


def _begin(bins):
    """The smallest value of a bin."""
    return (np.asarray(bins, np.int64) << 40).view(np.float64)


def _single_bins(x: np.ndarray, y: np.ndarray, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(bins, pairs, slack) of the squared distances of the wanted rows of x and y by a product in single precision; None if it isn't good enough."""
    made = single(x, y, np.ldexp(1.0, 2 * int(np.frexp(max(np.abs(x).max(initial=0.0), np.abs(y).max(initial=0.0)))[1]))) if len(x) and len(y) else None
    if made is None or abs(made[-1]) > 400 or made[3] < 2.0**-100:
        return None
    one, two, _, slack, power = made
    if slack > 2.0**-8 * float(np.median(one[::16] @ two[:, ::16])):
        return None
    total = np.zeros(0, np.int64)
    for begin in range(0, len(one), SIFT_ROWS):
        near = one[begin : begin + SIFT_ROWS] @ two
        near = near.ravel() if wanted is None else near[wanted[begin : begin + SIFT_ROWS]]
        counts = np.bincount((np.maximum(near, 0) + np.float32(slack)).view(np.int32) >> 11)
        if len(counts) > len(total):
            counts, total = total, counts
        total[: len(counts)] += counts
    bins = np.flatnonzero(total)
    return bins + (1023 - 127 + 2 * power) * 4096, total[bins], float(np.ldexp(slack, 2 * power))  # exponents of doubles, and what was scaled away


def smallest(left: DataFrame, right: DataFrame | None, count: int) -> DataFrame:
    """The `count` smallest squared distances of all pairs and the next larger one, as rows (d, pairs).

    Self-joins take pairs i < j. Tiles first count their rough distances in bins, so that a bound of the wanted ones is known before any is sent;
    then each tile gives its own smallest values up to there. What is sent is near what is asked for, whatever the number of tiles.
    """
    itself = right is None

    def rough_of(ids, x, others, y, same):
        near, slack = rough("l2", x, y)
        return (np.where(ids[:, None] < others[None, :], near, np.inf) if same and itself else near), slack

    def binned(ids, x, others, y, same):
        if not len(ids):
            return pd.DataFrame({"bin": [], "pairs": [], "slack": []})
        found = _single_bins(x, y, ids[:, None] < others[None, :] if same and itself else None)
        if found is None:
            near, slack = rough_of(ids, x, others, y, same)
            found = *np.unique(_bins(near[np.isfinite(near)] + slack), return_counts=True), slack
        bins, n, slack = found  # no distance is beyond its own bin, nor below it by more than 2 slack
        if len(bins):
            last = min(np.searchsorted(np.cumsum(n), count), len(bins) - 1)
            few = np.searchsorted(_begin(bins), _begin(bins[last] + 1) + 2 * slack) + 1  # those behind can't be wanted
            bins, n = bins[:few], n[:few]
        return pd.DataFrame({"bin": bins, "pairs": n, "slack": slack})

    met = tiles_of(left, right)
    counted = met(binned, "bin long, pairs long, slack double").groupBy("bin").agg(F.sum("pairs").alias("pairs"), F.max("slack").alias("slack"))
    told = sorted(map(tuple, counted.collect()))  # bins, not pairs: 4096 for each doubling of the distance
    limit, upto, beyond = np.inf, 0, np.inf
    off = max((s for *_, s in told), default=0.0)
    for at, n, _ in told:
        if _begin(at) >= beyond:  # has a pair beyond the last one asked for
            limit = float(_begin(at + 1))
            break
        upto += n
        if upto >= count and beyond == np.inf:
            beyond = _begin(at + 1) + 2 * off

    def kernel(ids, x, others, y, same):
        if not len(ids):
            return pd.DataFrame({"d": [], "pairs": []})
        if limit < np.inf:
            a, b, _ = sifted("l2", x, y, limit)
        else:
            a, b = np.divmod(np.arange(len(x) * len(y)), len(y))
        if same and itself:
            before = ids[a] < others[b]
            a, b = a[before], b[before]
        d, n = np.unique(folded_at("l2", x, y, a, b), return_counts=True)
        few = np.searchsorted(np.cumsum(n), count) + 2  # the wanted ones and one beyond
        d, n = d[:few], n[:few]
        return pd.DataFrame({"d": d, "pairs": n})

    found = met(kernel, "d double, pairs long")
    return found.groupBy("d").agg(F.sum("pairs").alias("pairs"))
