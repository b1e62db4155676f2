"""Similarity joins: one call, several strategies with the same result."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinage.functions import metrics as M
from vicinage.operators.tiles import binned_within, every_pair, nearest, over_tiles, pairs_within, sifted
from vicinage.plans.storage import small, written

STRATEGIES = ("tiles", "naive", "cascade", "pivot")


def similarity_join(left: DataFrame, right: DataFrame | None, limit: float, strategy: str = "tiles", metric: str = "l2") -> DataFrame:
    """Pairs (i, j) with distance at most limit, of id and vec; l2 limits are squared distances. Inclusive.

    Self-joins (no right) give every unordered pair once, each row with itself included.
    """
    if strategy == "tiles":
        return pairs_within(left, right, limit, metric)
    if strategy == "cascade":
        return cascade_within(left, right, limit)
    if strategy == "pivot":
        return pivot_join(left, right, limit)
    if strategy == "naive":
        return every_pair(left, right, limit, metric)
    raise ValueError(f"strategy is one of {STRATEGIES}")


def mirrored(pairs: DataFrame) -> DataFrame:
    """Both directions of the pairs i <= j, those of a row with itself once."""
    return pairs.unionByName(pairs.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j")))


def ranked_range_join(queries: DataFrame, base: DataFrame, k: int, limit: float) -> DataFrame:
    """(q, rank, id, d): all rows of base within the limit of each query, nearest first, ties by id.

    The k nearest are searched first. A query whose k-th is still within the limit may have more: it is answered
    again by a range join, in place of its first answer.
    """
    found = written(nearest(queries, base, k).where(F.col("d") <= limit), "nearest")
    saturated = written(found.where(F.col("rank") == k).select(F.col("q").alias("id")), "saturated")
    whole = pairs_within(queries.join(saturated, "id", "left_semi").select("id", "vec"), base, limit, distances=True).toDF("q", "id", "d")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))
    settled = found.join(saturated.toDF("q"), "q", "left_anti").select("q", "rank", "id", "d")
    return settled.unionByName(whole.withColumn("rank", rank))


def cascade(left: DataFrame, right: DataFrame | None, limit: float) -> DataFrame:
    """(i, j, stage, state) of every pair that the first certificate doesn't reject; a pair's last stage is given.

    Stage 1 bounds the distance by int8 codes and the exact norm of what they leave out, stage 2 by single
    precision, stage 3 is the folded double distance. Bounds grow with the rounding errors that the norms
    of the vectors, their dimension and the fold itself allow, at any scale and offset. state is 1 for accepted, 0 for rejected.
    """
    import numpy as np
    import pandas as pd

    itself = right is None

    def kernel(ids, x, others, y, same):
        frames = [pd.DataFrame({"i": ids[a], "j": others[b], "stage": stage, "state": state}) for a, b, stage, state in certified(ids, x, others, y, itself and same, limit) if (stage, state) != (1, 0)]
        found = pd.concat(frames, ignore_index=True) if frames else pd.DataFrame({"i": [], "j": [], "stage": [], "state": []})
        if itself and len(found):
            found["i"], found["j"] = np.minimum(found["i"], found["j"]), np.maximum(found["i"], found["j"])
        return found

    return over_tiles(left, right, kernel, "i long, j long, stage int, state int")


def _dots(x, y, a, b, some: int = 1024):
    """Inner products of the rows a of x with the rows b of y."""
    import numpy as np

    out = np.empty(len(a))
    for at in range(0, len(a), some):
        np.einsum("ij,ij->i", x[a[at : at + some]], y[b[at : at + some]], out=out[at : at + some])
    return out


def cascade_within(left: DataFrame, right: DataFrame | None, limit: float) -> DataFrame:
    """(i, j) that the cascade accepts. One matrix product sets far pairs aside, the stages are asked of the others only."""
    import numpy as np
    import pandas as pd

    itself = right is None

    def kernel(ids, x, others, y, same):
        found = [(np.zeros(0, np.int64),) * 2]
        if len(ids):
            near = sifted("l2", x, y, limit)[:2]
            found += [(a, b) for a, b, _, state in certified(ids, x, others, y, itself and same, limit, near) if state == 1]
        a, b = (np.concatenate(f) for f in zip(*found))
        i, j = ids[a], others[b]
        return pd.DataFrame({"i": np.minimum(i, j), "j": np.maximum(i, j)} if itself else {"i": i, "j": j})

    return over_tiles(left, right, kernel, "i long, j long")


def certified(ids, x, others, y, same: bool, limit: float, pairs=None):
    """(rows of x, rows of y, stage, state) of all pairs of two blocks, i <= j where the block is the same, or of some pairs (rows of x, rows of y) only; none is in two of them."""
    import numpy as np

    from vicinage.operators.tiles import folded

    if not len(ids):
        return []
    unit, d = 2.0**-53, x.shape[1]
    fold, least = (d + 8) * unit, d * 2.0**-1022  # relative error of the folded distance; squares that vanish
    shift = x.mean(0)  # differences stay, and codes are finer around a common offset
    zx, zy = x - shift, y - shift
    norm = lambda m: np.sqrt((m * m).sum(1)) * (1 + fold) + 2.0**-500
    one, two = ((slice(None), None), (None, slice(None))) if pairs is None else ((pairs[0],), (pairs[1],))
    nx, ny = norm(zx), norm(zy)
    shifted = 4 * unit * (nx[one] + ny[two])

    def coded(z):
        top = np.abs(z).max(1)
        scale = np.where(top > 2.0**-1000, top / 127, 1.0)
        c = np.clip(np.rint(z / scale[:, None]), -127, 127)
        return c, scale, norm(z - c * scale[:, None]) + 4 * unit * norm(z)

    (cx, sx, ex), (cy, sy, ey) = coded(zx), coded(zy)
    qx, qy = (cx * cx).sum(1) * sx**2, (cy * cy).sum(1) * sy**2
    products = cx @ cy.T if pairs is None else _dots(cx, cy, *pairs)  # whole numbers below 2^53
    square = qx[one] + qy[two] - 2 * (sx[one] * sy[two]) * products
    slack = 32 * unit * (qx[one] + qy[two]) + least
    apart = ex[one] + ey[two] + shifted
    lower = np.maximum(0, np.sqrt(np.maximum(0, square - slack)) - apart) ** 2 * (1 - 2 * fold) - least
    upper = (np.sqrt(np.maximum(0, square) + slack) + apart) ** 2 * (1 + 2 * fold) + least
    wanted = ids[one] <= others[two] if same else np.ones(square.shape, bool)
    places = lambda mask: np.nonzero(mask) if pairs is None else (pairs[0][mask], pairs[1][mask])
    out = [(*places(wanted & (upper <= limit)), 1, 1), (*places(wanted & (lower > limit)), 1, 0)]
    a, b = places(wanted & ~(upper <= limit) & ~(lower > limit))
    single = 2.0**-24
    with np.errstate(over="ignore", invalid="ignore"):
        x32, y32 = zx.astype(np.float32), zy.astype(np.float32)
        d32 = np.sqrt(((x32[a] - y32[b]) ** 2).sum(1, dtype=np.float32).astype(np.float64))
    # Beyond single precision's range nothing is decided; below it, what vanishes is added.
    off = 4 * unit * (nx[a] + ny[b]) + 2 * single * (nx[a] + ny[b]) + d * 2.0**-74
    rel = (d + 8) * single
    high = np.where(np.isfinite(d32), (d32 * (1 + rel) + off) ** 2 * (1 + 2 * fold) + least, np.inf)
    low = np.where(np.isfinite(d32), np.maximum(0, d32 * (1 - rel) - off) ** 2 * (1 - 2 * fold) - least, -np.inf)
    yes, no = high <= limit, low > limit
    out += [(a[yes], b[yes], 2, 1), (a[no], b[no], 2, 0)]
    a, b = a[~yes & ~no], b[~yes & ~no]
    exact = folded("l2", x[a], y[b]) <= limit
    return [*out, (a[exact], b[exact], 3, 1), (a[~exact], b[~exact], 3, 0)]


def stage_state_counts(left: DataFrame, limit: float) -> DataFrame:
    """(stage, state, pairs) of the cascade over a self-join, i <= j: 1 accepted, 0 rejected, 2 passed on to the next stage.

    Tiles count their own pairs: five numbers a tile.
    """
    import pandas as pd

    def kernel(ids, x, others, y, same):
        n = {(stage, state): len(a) for a, _, stage, state in certified(ids, x, others, y, same, limit)}
        rows = [(stage, state, k) for (stage, state), k in n.items()]
        rows += [(s, 2, sum(k for (stage, _), k in n.items() if stage > s)) for s in (1, 2)]
        return pd.DataFrame(rows, columns=["stage", "state", "pairs"])

    counted = over_tiles(left, None, kernel, "stage int, state int, pairs long")
    return counted.groupBy("stage", "state").agg(F.sum("pairs").alias("pairs"))


def pivot_join(left: DataFrame, right: DataFrame | None, limit: float, pivots: int = 2) -> DataFrame:
    """Metric bins: rows within sqrt(limit) of one another differ by at most one bin of distance to any pivot.

    The rows of a bin are dealt to blocks, so that a bin of any size is many tasks; blocks of neighbouring bins meet.
    """
    width = max(max(limit, 0.0) ** 0.5 * (1 + 1e-9), 1e-6)  # wider bins are sound as well
    base = left if right is None else right
    chosen = [r["vec"] for r in base.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()]
    if not chosen:
        return left.select(F.col("id").alias("i"), F.col("id").alias("j")).where("false")
    keys = [f"_k{k}" for k in range(len(chosen))]
    bins = [F.floor(F.sqrt(M.squared_l2("vec", F.array(*[F.lit(float(x)) for x in p]))) / width).cast("long").alias(k) for p, k in zip(chosen, keys)]
    binned = lambda df: df.select("id", "vec", *bins)
    return binned_within(binned(left), None if right is None else binned(right), keys, limit)


def grid_join(points: DataFrame, key: str, columns: list[str], eps: float) -> DataFrame:
    """Pairs i <= j of points within eps in the given numeric columns (at most three of them make the grid).

    Cells a little wider than eps are the key of an equi-join of distinct points.
    """

    def fits(a: list, b: list) -> tuple:
        total = F.lit(0.0)
        for x, y in zip(a, b):
            total = total + (x - y) * (x - y)
        return (total <= eps * eps,) * 2

    return _near_points(points, key, columns, [eps] * len(columns), fits)


def band_join(points: DataFrame, key: str, bands: dict[str, float]) -> DataFrame:
    """Pairs i <= j whose columns each differ by at most their band: a window join on a box, gridded on at most three columns."""

    def fits(a: list, b: list) -> tuple:
        both = []
        for one, two in ((a, b), (b, a)):  # the row of the smaller id has the window
            inside = F.lit(True)
            for x, y, w in zip(one, two, bands.values()):
                inside = inside & y.between(x - w, x + w)
            both.append(inside)
        return tuple(both)

    return _near_points(points, key, list(bands), list(bands.values()), fits)


#: Rows of equal coordinates that are joined as one, about.
COPIES = 256


def _near_points(points: DataFrame, key: str, columns: list[str], widths: list[float], fits: Callable) -> DataFrame:
    """Pairs i <= j of rows whose points fit. fits(a, b): whether they do if a has the smaller id, and if b has it.

    Rows of equal coordinates are put into runs of some COPIES rows. Runs meet by the cells of their point, so candidates are pairs of
    points, not of rows; pairs of runs are then dealt to all tasks and written out as pairs of rows.
    """
    names = [f"_c{k}" for k in range(len(columns))]
    cells = [f"_g{k}" for k in range(min(3, len(columns)))]
    rows = points.select(F.col(key).cast("long").alias("id"), *[F.col(c).cast("double").alias(n) for c, n in zip(columns, names)])
    for n in ("id", *names):
        rows = rows.where(F.col(n).isNotNull())
    rows = written(rows, "points")
    heavy = written(rows.groupBy(*names).agg(F.ceil(F.count(F.lit(1)) / COPIES).alias("_n")).where("_n > 1"), "points-heavy")
    dealt = rows.join(small(heavy), names, "left").withColumn("_k", F.pmod(F.xxhash64("id"), F.coalesce("_n", F.lit(1))))
    runs = dealt.groupBy(*names, "_k").agg(F.collect_list("id").alias("ids")).withColumn("run", F.monotonically_increasing_id())
    runs = written(runs.select("run", "ids", *names), "point-runs")
    most = float(1 << 62)
    wide = [(w or 1.0) * (1 + 2.0**-10) for w in widths]  # rounding never takes partners further than to the next cell
    side = runs.select("run", *names, *[F.floor(F.least(F.greatest(F.col(n) / w, F.lit(-most)), F.lit(most))).cast("long").alias(g) for g, n, w in zip(cells, names, wide)])
    ahead = [o for o in product((-1, 0, 1), repeat=len(cells)) if o >= (0,) * len(cells)]  # of two cells, one is ahead of the other
    steps = F.explode(F.array(*[F.struct(*[(F.col(g) - k).alias(g) for g, k in zip(cells, o)], F.lit(not any(o)).alias("same")) for o in ahead]))
    one = side.select(*cells, F.col("run").alias("a"), *[F.col(n).alias(f"a{n}") for n in names])
    two = side.select(F.col("run").alias("b"), *[F.col(n).alias(f"b{n}") for n in names], steps.alias("_s")).select("b", *[f"b{n}" for n in names], "_s.*")
    forth, back = fits([F.col(f"a{n}") for n in names], [F.col(f"b{n}") for n in names])
    met = one.join(two.hint("merge"), cells).where(~F.col("same") | (F.col("a") <= F.col("b"))).select("a", "b", forth.alias("forth"), back.alias("back"))
    met = written(met.where("forth OR back"), "run-pairs")
    return _met_rows(met, runs, not rows.groupBy("id").count().where("count > 1").isEmpty())


def _met_rows(met: DataFrame, runs: DataFrame, repeated: bool) -> DataFrame:
    """Pairs (i, j), i <= j, of the rows of runs that meet: (a, b, forth, back), whether they do if a has the smaller id, and if b has it. repeated: an id may have several rows."""
    ids = lambda s: small(runs.select(F.col("run").alias(s), F.col("ids").alias(f"{s}_ids")))
    parts = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(parts, "a", "b").join(ids("a"), "a").join(ids("b"), "b")
    each = met.select("a", "b", "forth", "back", F.explode("a_ids").alias("x"), "b_ids").select("a", "b", "forth", "back", "x", F.explode("b_ids").alias("y"))
    x, y = F.col("x"), F.col("y")
    wanted = ((x <= y) & F.col("forth")) | ((y < x) & F.col("back") & (F.col("a") != F.col("b")))
    pairs = each.where(wanted).select(F.least(x, y).alias("i"), F.greatest(x, y).alias("j"))
    if not repeated:
        return pairs
    # Rows of one id in different runs are partners in both directions; above, the first was counted.
    again = each.where((x == y) & F.col("back") & (F.col("a") != F.col("b")))
    return pairs.unionByName(again.select(x.alias("i"), y.alias("j")))


def by_points(points: DataFrame, found: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (i, j), i <= j, of rows (id, vec) whose points found(distinct points) pairs.

    found takes (id, vec) with a number for each distinct vec and gives each pair of these once, those of a point with itself too, as (i, j) or, where the
    test isn't the same in both directions, (i, j, forth, back): whether rows are partners if that of i has the smaller id, and if that of j has it. So pairs are
    looked for among distinct points. Rows of a point are put into runs of some COPIES rows, and pairs of runs are written out as pairs of rows.
    """
    rows = written(points.select("id", "vec").where("id IS NOT NULL"), "points")
    sizes = rows.groupBy("vec").agg(F.ceil(F.count(F.lit(1)) / COPIES).alias("_n"))
    sizes = written(sizes.select("vec", "_n", F.monotonically_increasing_id().alias("point")), "distinct-points")
    dealt = rows.join(small(sizes), "vec").withColumn("_k", F.pmod(F.xxhash64("id"), F.col("_n")))
    runs = dealt.groupBy("point", "_k").agg(F.collect_list("id").alias("ids")).select("point", "ids", F.monotonically_increasing_id().alias("run"))
    runs = written(runs, "point-runs")
    near = found(sizes.select(F.col("point").alias("id"), "vec"))
    ways = [F.col(c) if c in near.columns else F.lit(True).alias(c) for c in ("forth", "back")]
    near = written(near.select(F.col("i").alias("p"), F.col("j").alias("r"), *ways), "point-pairs")
    of = lambda point, run: small(runs.select(F.col("point").alias(point), F.col("run").alias(run)))
    met = near.join(of("p", "a"), "p").join(of("r", "b"), "r").where("p <> r OR a <= b").select("a", "b", "forth", "back")
    return _met_rows(met, runs, not rows.groupBy("id").count().where("count > 1").isEmpty())


def edit_distance_join(names: DataFrame, column: str, limit: int) -> DataFrame:
    """Pairs a <= b of distinct strings within an edit distance.

    Candidates agree on the length up to the limit and on one of limit + 1 parts of the longer string, found
    at a shifted place in the other: the parts are the key of an equi-join.
    """
    words = names.select(F.col(column).alias("w")).where("w IS NOT NULL").distinct().withColumn("n", F.length("w"))
    parts = limit + 1
    whole = F.floor(F.col("n") / parts).cast("int")
    left = words.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(limit)))).select(
        F.col("w").alias("x"), F.col("n").alias("nx"), "p", F.col("p").alias("_p"), (F.col("p") * whole).alias("at"), F.when(F.col("p") == limit, F.col("n") - limit * whole).otherwise(whole).alias("len")
    )
    left = left.withColumn("part", F.expr("substring(x, at + 1, len)")).select("x", "nx", "p", "at", "len", "part")
    right = words.select(F.col("w").alias("y"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("n") - limit), F.col("n") + limit)).alias("nx"), "n")
    shape = (F.floor(F.col("nx") / parts)).cast("int")
    right = right.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(limit)))).withColumn("_whole", shape)
    right = right.withColumn("len", F.when(F.col("p") == limit, F.col("nx") - limit * F.col("_whole")).otherwise(F.col("_whole")))
    right = right.withColumn("_at", F.explode(F.sequence(F.greatest(F.lit(0), F.col("p") * F.col("_whole") - limit), F.greatest(F.lit(0), F.col("p") * F.col("_whole") + limit))))
    right = right.withColumn("part", F.expr("substring(y, _at + 1, len)")).select("y", "nx", "p", "part").distinct()
    found = left.join(right, ["nx", "p", "part"]).select("x", "y").where(F.levenshtein("x", "y") <= limit)
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
