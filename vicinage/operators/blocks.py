"""Block layouts, block summaries, provable bounds, pruning and roll-ups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinage.functions import metrics as M
from vicinage.plans.storage import small, written

LAYOUTS = ("original", "random", "pivot_sort", "pca_sort", "balanced_axis")


def gram(points: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, covariance and row number of vec; partial sums are made on the executors, one small matrix a task."""
    import pandas as pd

    def part(batches):
        total, outer, n = None, None, 0
        for b in batches:
            x = np.stack(b["vec"].to_numpy()).astype(np.float64)
            total = x.sum(0) if total is None else total + x.sum(0)
            outer = x.T @ x if outer is None else outer + x.T @ x
            n += len(x)
        if n:
            yield pd.DataFrame({"s": [total.tolist()], "o": [outer.ravel().tolist()], "n": [n]})

    rows = points.select("vec").mapInPandas(part, "s array<double>, o array<double>, n long")
    flat = rows.select("n", F.posexplode(F.concat("s", "o")).alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("k").collect()
    if not flat:
        return np.zeros(0), np.zeros((0, 0)), 0
    v, n = np.array([r["v"] for r in flat]), flat[0]["n"]
    d = int((np.sqrt(1 + 4 * len(v)) - 1) / 2)
    mean = v[:d] / n
    return mean, v[d:].reshape(d, d) / n - np.outer(mean, mean), n


def principal_axes(points: DataFrame, rank: int) -> tuple[np.ndarray, float]:
    """Columns of leading principal axes, and by how much a projected squared distance may exceed the true one."""
    _, covariance, _ = gram(points)
    p = np.linalg.eigh(covariance)[1][:, ::-1][:, :rank]
    return p, 1 + float(np.linalg.norm(p.T @ p - np.eye(p.shape[1]))) + 1e-9


def projected(vec, axes: np.ndarray) -> Column:
    return F.array(*[M.dot(F.col(vec), F.array(*[F.lit(float(x)) for x in axis])) for axis in axes.T])


def farthest_pivots(points: DataFrame, count: int) -> list[list[float]]:
    """Farthest-point pivots: the smallest id first, then always the row farthest from those chosen, ties by smaller id."""
    first = points.orderBy("id").limit(1).collect()
    chosen = [first[0]["vec"]] if first else []
    while chosen and len(chosen) < count:
        gaps = [M.squared_l2("vec", F.array(*[F.lit(float(x)) for x in p])) for p in chosen]
        gap = F.least(*gaps) if len(gaps) > 1 else gaps[0]
        chosen.append(points.select("vec", F.struct(gap, -F.col("id")).alias("_g")).agg(F.max_by("vec", "_g")).first()[0])
    return chosen


def nearest_pivot(points: DataFrame, pivots: list[list[float]]) -> DataFrame:
    """id, pivot (its number), d2 of each row's nearest pivot; ties by the smaller number."""
    gaps = [F.struct(M.squared_l2("vec", F.array(*[F.lit(float(x)) for x in p])).alias("d2"), F.lit(k).alias("pivot")) for k, p in enumerate(pivots)]
    best = F.least(*gaps) if len(gaps) > 1 else gaps[0]
    return points.select("id", best.alias("_b")).select("id", F.col("_b.pivot").alias("pivot"), F.col("_b.d2").alias("d2"))


def layout(points: DataFrame, method: str = "pca_sort", rows: int = 64) -> DataFrame:
    """points with block, blocks of about `rows` rows that lie together under a method.

    Rows are ordered by a score, range-partitioned and numbered from partition sizes: no task sees all rows.
    """
    if method == "original":
        score = F.col("id").cast("double")
    elif method == "random":
        score = F.xxhash64("id").cast("double")
    elif method == "pivot_sort":
        pivot = farthest_pivots(points, 1)
        score = M.squared_l2("vec", F.array(*[F.lit(float(x)) for x in pivot[0]])) if pivot else F.lit(0.0)
    elif method in ("pca_sort", "balanced_axis"):
        axes, _ = principal_axes(points, 1 if method == "pca_sort" else 2)
        scores = [M.dot("vec", F.array(*[F.lit(float(x)) for x in axis])) for axis in axes.T]
        if method == "balanced_axis" and len(scores) > 1:  # halves by the first axis, ordered by the second inside
            cut = points.select(F.percentile_approx(scores[0], 0.5)).first()[0]
            score = F.when(scores[0] <= cut, 0.0).otherwise(1.0) * 1e6 + scores[1]
        else:
            score = scores[0]
    else:
        raise ValueError(f"method is one of {LAYOUTS}")
    return numbered(points.withColumn("_s", score), ["_s", "id"]).withColumn("block", F.floor(F.col("_n") / rows).cast("long")).drop("_s", "_n")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with _n, its rows' places in an order, from 0: ranks within ranges plus the rows of earlier ranges."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    ranged = ranged.withColumn("_k", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("long"), 33))
    ranged = written(ranged, "numbered")
    sizes = ranged.groupBy("_p").count()
    before = F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select("_p", F.coalesce(before, F.lit(0)).alias("_base"))  # one row a partition
    return ranged.join(F.broadcast(base), "_p").withColumn("_n", F.col("_base") + F.col("_k")).drop("_p", "_k", "_base")


def summaries(points: DataFrame, feature: str = "vec") -> DataFrame:
    """block, size, low and high corner, centre, radius of each block of points (id, block, feature)."""
    flat = points.select("block", F.posexplode(feature).alias("k", "v"))
    axes = flat.groupBy("block", "k").agg(F.min("v").cast("double").alias("low"), F.max("v").cast("double").alias("high"), F.avg("v").alias("mean"))
    boxes = axes.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("k", "low", "high", "mean"))).alias("_a"))
    boxes = boxes.select("block", *[F.col(f"_a.{f}").alias(n) for f, n in (("low", "low"), ("high", "high"), ("mean", "centre"))])
    radius = points.join(boxes.select("block", "centre"), "block").groupBy("block").agg(F.max(F.sqrt(M.squared_l2(feature, "centre"))).alias("radius"), F.count(F.lit(1)).alias("size"))
    return boxes.join(radius, "block")


def bounds(blocks: DataFrame, kind: str = "box") -> DataFrame:
    """(b1, b2, lower, upper): bounds of the squared distance between any rows of two blocks, b1 <= b2."""
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = blocks.toDF(*[f"{c}1" for c in blocks.columns]).repartition(parts)  # few rows, each of which meets all others
    b = blocks.toDF(*[f"{c}2" for c in blocks.columns])
    pairs = a.join(b, F.col("block1") <= F.col("block2"))
    if kind == "ball":
        gap = F.sqrt(M.squared_l2("centre1", "centre2"))
        lower, upper = F.pow(F.greatest(F.lit(0.0), gap - F.col("radius1") - F.col("radius2")), 2), F.pow(gap + F.col("radius1") + F.col("radius2"), 2)
    else:
        spans = F.arrays_zip("low1", "high1", "low2", "high2")
        apart = F.transform(spans, lambda s: F.greatest(F.lit(0.0), s["low1"] - s["high2"], s["low2"] - s["high1"]))
        reach = F.transform(spans, lambda s: F.greatest(s["high1"] - s["low2"], s["high2"] - s["low1"]))
        square = lambda xs: F.aggregate(xs, F.lit(0.0), lambda t, x: t + x * x)
        lower, upper = square(apart), square(reach)
    return pairs.select(F.col("block1").alias("b1"), F.col("block2").alias("b2"), lower.alias("lower"), upper.alias("upper"), F.col("size1"), F.col("size2"))


def pad(limit: float) -> float:
    """Slack for rounding in bounds over coordinates of magnitude up to 1."""
    return 2.0**-20 + 1e-12 * abs(limit)


def block_pairs(points: DataFrame, limit: float, kind: str = "box") -> DataFrame:
    """Pairs of blocks that may hold a pair within the limit; a block with itself is never left out."""
    return bounds(summaries(points), kind).where(_kept(limit)).withColumn("all_in", F.col("upper") <= limit - pad(limit))


def _kept(limit: float) -> Column:
    return (F.col("b1") == F.col("b2")) | (F.col("lower") <= limit + pad(limit))


def ruled_out(points: DataFrame, limit: float, kind: str = "box") -> DataFrame:
    """(b1, b2), b1 <= b2: the pairs of blocks that block_pairs leaves out."""
    return bounds(summaries(points), kind).where(~F.coalesce(_kept(limit), F.lit(False))).select("b1", "b2")


def block_join(points: DataFrame, limit: float, kind: str = "box") -> DataFrame:
    """Pairs i <= j within the squared distance, found in the block pairs that bounds leave. points: id, vec, block.

    Neighbouring blocks are packed together, up to some 2048 rows, and meet by number. There the bounds of `block_pairs` rule out pairs of
    blocks or take them whole; elsewhere a matrix product sifts and the folded distance decides.
    """
    import pandas as pd

    from vicinage.operators.tiles import MOST_ROWS, dealt_pairs, folded, matrix, rough, unpacked

    largest = points.groupBy("block").count().agg(F.max("count")).first()[0] or 1
    single = points.schema["vec"].dataType.elementType.typeName() == "float"

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block", kind="stable")
        x = matrix(rows["vec"])
        return pd.DataFrame([[key[0], len(x), x.shape[1], rows["id"].to_numpy(np.int64).tobytes(), rows["block"].to_numpy(np.int64).tobytes(), x.astype("<f4" if single else "<f8").tobytes()]])

    dealt = points.select("id", "vec", "block", F.floor(F.col("block") / max(1, MOST_ROWS // largest)).cast("long").alias("_b"))
    packed = written(dealt.groupBy("_b").applyInPandas(pack, "_b long, n int, dim int, ids binary, blocks binary, vecs binary"), "block-groups")

    def bounded(x: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, ...]:
        """Places of the blocks, then corners, or centres and radii."""
        begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        sizes = np.diff([*begin, len(of)])
        if kind != "ball":
            return sizes, np.minimum.reduceat(x, begin), np.maximum.reduceat(x, begin)
        centre = np.add.reduceat(x, begin) / sizes[:, None]
        return sizes, centre, np.maximum.reduceat(np.sqrt(((x - np.repeat(centre, sizes, 0)) ** 2).sum(1)), begin)

    def gaps(one: tuple, two: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the squared distance between blocks, as `bounds` has them."""
        _, a, u = one
        _, b, v = two
        lower, upper = np.empty((len(a), len(b))), np.empty((len(a), len(b)))
        for k in range(len(a)):  # a block with all others
            if kind == "ball":
                gap, radii = np.sqrt(((a[k] - b) ** 2).sum(1)), u[k] + v
                lower[k], upper[k] = np.maximum(0, gap - radii) ** 2, (gap + radii) ** 2
            else:
                lower[k] = (np.maximum(0, np.maximum(a[k] - v, b - u[k])) ** 2).sum(1)
                upper[k] = (np.maximum(u[k] - b, v - a[k]) ** 2).sum(1)
        return lower, upper

    def run(frames):
        for frame in frames:
            for r in frame.to_dict("records"):
                i, j, p, q = (np.frombuffer(r[c], np.int64) for c in ("a_ids", "b_ids", "a_blocks", "b_blocks"))
                x, y = unpacked(r["a_vecs"], r["a_n"], r["a_dim"]), unpacked(r["b_vecs"], r["b_n"], r["b_dim"])
                one, two = bounded(x, p), bounded(y, q)
                lower, upper = gaps(one, two)
                spread = lambda m: np.repeat(np.repeat(m, one[0], 0), two[0], 1)  # noqa: B023, E731
                own = p[:, None] == q[None, :]
                wanted = (own & (i[:, None] <= j[None, :])) | (p[:, None] < q[None, :])
                wanted &= own | spread(lower <= limit + pad(limit))
                whole = spread(upper <= limit - pad(limit))
                near, slack = rough("l2", x, y)
                a, b = np.nonzero(wanted & (whole | (near <= limit + slack)))
                inside = whole[a, b]
                inside[~inside] = folded("l2", x[a[~inside]], y[b[~inside]]) <= limit
                a, b = a[inside], b[inside]
                yield pd.DataFrame({"i": np.minimum(i[a], j[b]), "j": np.maximum(i[a], j[b])})

    numbers = packed.select("_b")
    pairs = dealt_pairs(numbers.toDF("_i").crossJoin(numbers.toDF("_j")).where("_i <= _j"))  # of groups of many blocks
    side = lambda at, name: small(packed.select(F.col("_b").alias(at), *[F.col(c).alias(f"{name}_{c}") for c in ("n", "dim", "ids", "blocks", "vecs")]))
    return pairs.join(side("_i", "a"), "_i").join(side("_j", "b"), "_j").mapInPandas(run, "i long, j long")


def pruned_share(points: DataFrame, limit: float, kind: str = "box") -> DataFrame:
    """One row, pruned: the share of row pairs in block pairs that bounds rule out."""
    weights = F.when(F.col("b1") == F.col("b2"), F.col("size1") * (F.col("size1") + 1) / 2).otherwise(F.col("size1") * F.col("size2"))
    out = (F.col("b1") != F.col("b2")) & (F.col("lower") > limit + pad(limit))
    return bounds(summaries(points), kind).agg((F.sum(F.when(out, weights).otherwise(0.0)) / F.sum(weights)).alias("pruned"))


def tile_counts(pairs: DataFrame, rows: int = 64) -> DataFrame:
    """(b1, b2, pairs): how many pairs fall in each tile of row blocks, smaller block first."""
    bi, bj = F.floor(F.col("i") / rows).cast("long"), F.floor(F.col("j") / rows).cast("long")
    return pairs.groupBy(F.least(bi, bj).alias("b1"), F.greatest(bi, bj).alias("b2")).agg(F.count(F.lit(1)).alias("pairs"))


def rolled_up(tiles: DataFrame, factor: int = 2) -> DataFrame:
    """Tile counts of blocks `factor` times as large."""
    up = lambda c: F.floor(F.col(c) / factor).cast("long")
    return tiles.groupBy(up("b1").alias("b1"), up("b2").alias("b2")).agg(F.sum("pairs").alias("pairs"))
