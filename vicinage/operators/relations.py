"""Joins over objects and graphs, calibration of thresholds, and operators on pair sets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinage.functions import metrics as M
from vicinage.operators.tiles import folded_at, over_tiles, pairs_within_groups, rough, smallest
from vicinage.plans.storage import written

# --- multi-vector objects


def nearest_cells(x, of_x, y, of_y):
    """Folded squared distances of those rows of x and y that can be the nearest of the other's object, infinite elsewhere. of_x, of_y: objects of the rows.

    A matrix product sifts, so that few distances are folded.
    """
    import numpy as np

    near, slack = rough("l2", x, y)
    few = np.zeros(near.shape, bool)
    order, upto = np.argsort(of_y, kind="stable"), np.argsort(of_x, kind="stable")
    for m, at, of, axis in ((near[:, order], order, of_y, 1), (near[upto], upto, of_x, 0)):
        _, begin, sizes = np.unique(of[at], return_index=True, return_counts=True)
        least = np.repeat(np.minimum.reduceat(m, begin, axis=axis), sizes, axis=axis)
        close = m <= least + (4 * slack + 1e-12 * np.abs(least))
        few[(slice(None), at) if axis else at] |= close
    cells = np.full(near.shape, np.inf)
    a, b = np.nonzero(few)
    cells[a, b] = folded_at("l2", x, y, a, b)
    return cells


def chamfer(queries: DataFrame, base: DataFrame) -> DataFrame:
    """(q, b, score): half the sum of mean nearest squared distances in both directions. Rows: obj, tok, vec.

    Tiles of tokens give, for each token and object of the other side, the nearest distance in the tile; a
    grouped minimum finishes it. Object and token numbers are below 2^31.
    """
    import numpy as np
    import pandas as pd

    named = lambda df: df.select((F.shiftleft(F.col("obj").cast("long"), 32) + F.col("tok")).alias("id"), "vec")

    def kernel(ids, x, others, y, same):
        parts = []
        if len(ids):
            cells, (of_x, of_y) = nearest_cells(x, ids >> 32, y, others >> 32), (np.argsort(o >> 32, kind="stable") for o in (ids, others))
            for forth, rows, cols, order in ((True, ids, others, of_y), (False, others, ids, of_x)):
                objects, begin = np.unique((cols >> 32)[order], return_index=True)
                least = np.minimum.reduceat(cells[:, order], begin, axis=1) if forth else np.minimum.reduceat(cells[order], begin, axis=0).T
                own, other = np.repeat(rows, len(objects)), np.tile(objects, len(rows))
                parts.append(pd.DataFrame({"forth": forth, "q": own >> 32 if forth else other, "b": other if forth else own >> 32, "tok": own, "m": least.ravel()}))
        return pd.concat(parts) if parts else pd.DataFrame({"forth": [], "q": [], "b": [], "tok": [], "m": []})

    nearest = over_tiles(named(queries), named(base), kernel, "forth boolean, q long, b long, tok long, m double")
    means = nearest.groupBy("forth", "q", "b", "tok").agg(F.min("m").alias("m")).groupBy("q", "b", "forth").agg(F.avg("m").alias("m"))
    return means.groupBy("q", "b").agg((0.5 * F.sum("m")).alias("score"))


def chamfer_join(queries: DataFrame, base: DataFrame, limit: float) -> DataFrame:
    """Object pairs with a Chamfer score of at most limit."""
    return chamfer(queries, base).where(F.col("score") <= limit).select("q", "b")


# --- graphs and factorised relations


def witness_pairs(edges: DataFrame) -> DataFrame:
    """(q, b, witnesses): pairs q < b of distinct (src, dst) edges with a common dst, and how many."""
    e = edges.select("src", "dst").distinct()
    a, b = e.toDF("q", "w"), e.toDF("b", "w")
    return a.join(b, "w").where("q < b").groupBy("q", "b").agg(F.count(F.lit(1)).alias("witnesses"))


def factorised_join(left: DataFrame, right: DataFrame, limit: float | None = None) -> DataFrame:
    """Distinct (q, b) that share a witness, of rows (w, q, qv) and (w, b, bv), and lie within the limit.

    Pairs are made unique before distances are taken: a pair's distance doesn't depend on the witness.
    """
    pairs = left.select("w", "q").join(right.select("w", "b"), "w").select("q", "b").distinct()
    if limit is None:
        return pairs
    qv, bv = left.groupBy("q").agg(F.first("qv").alias("qv")), right.groupBy("b").agg(F.first("bv").alias("bv"))
    return pairs.join(qv, "q").join(bv, "b").where(M.squared_l2("qv", "bv") <= limit).select("q", "b")


def factorised_self_join(rows: DataFrame, limit: float) -> DataFrame:
    """Distinct pairs (i, j), i < j, of rows (w, id, vec) that share a witness and lie within the limit.

    Witnesses with many rows are split into blocks, and pairs beyond the limit never leave their tile.
    """
    return pairs_within_groups(rows, "w", limit).where("i < j").distinct()


def neighbourhood_groups(pairs: DataFrame) -> DataFrame:
    """(size, rows): how many rows have each number of rows with the very same set of partners."""
    sets = pairs.groupBy("i").agg(F.sha2(F.array_join(F.sort_array(F.collect_set("j")).cast("array<string>"), ","), 256).alias("_set"))
    return sets.groupBy("_set").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.sum("size").alias("rows"))


# --- calibration


def _running(left: DataFrame, right: DataFrame | None, pairs: int) -> DataFrame:
    """(d, pairs, _to) of the smallest distances: _to is the number of pairs up to d. Sums run within ranges of d and over the sums of earlier ranges."""
    found = smallest(left, right, pairs)
    parts = max(1, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = written(found.repartitionByRange(parts, "d").withColumn("_p", F.spark_partition_id()), "distances")
    upto = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = ranged.groupBy("_p").agg(F.sum("pairs").alias("_s")).select("_p", F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_base"))
    own = F.sum("pairs").over(Window.partitionBy("_p").orderBy("d"))
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_p").select("d", "pairs", (F.col("_base") + F.col("_own")).alias("_to"))


def midgap(left: DataFrame, right: DataFrame | None, pairs: int) -> DataFrame:
    """One row, (threshold, pairs): midway between the distance of the pairs-th pair and the next larger; ties all count."""
    two = _running(left, right, pairs).where(F.col("_to") >= pairs).orderBy("d").limit(2)
    return two.agg(F.min("d").alias("_d"), F.max("d").alias("_next"), F.min("_to").alias("pairs"), F.count(F.lit(1)).alias("_n")).where("_n > 0").select(
        F.when(F.col("_n") == 2, (F.col("_d") + F.col("_next")) / 2).alias("threshold"), "pairs"
    )


def strict_gap(left: DataFrame, right: DataFrame | None, pairs: int) -> DataFrame:
    """As midgap, but no row if ties make the number of pairs differ from the one asked for."""
    return midgap(left, right, pairs).where(F.col("pairs") == pairs)


def order_statistic(left: DataFrame, right: DataFrame | None, pairs: int) -> DataFrame:
    """One row, threshold: the distance of the pairs-th pair."""
    return _running(left, right, pairs).where(F.col("_to") >= pairs).orderBy("d").limit(1).select(F.col("d").alias("threshold"))


# --- pair sets


def neighbour_table(pairs: DataFrame) -> DataFrame:
    """(i, neighbours): ordered list of partners in directed pairs."""
    return pairs.groupBy("i").agg(F.sort_array(F.collect_list("j")).alias("neighbours"))


def symmetry_violations(pairs: DataFrame) -> DataFrame:
    return pairs.join(pairs.select(F.col("j").alias("i"), F.col("i").alias("j")), ["i", "j"], "left_anti")


def duplicates(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("i", "j").count().where("count > 1").select("i", "j", F.col("count").alias("copies"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, ["i", "j"], "left_anti").unionByName(b.join(a, ["i", "j"], "left_anti"))


def f1(found: DataFrame, true: DataFrame) -> DataFrame:
    """precision, recall, f1 of one pair set against another; both are taken as sets."""
    both = found.distinct().withColumn("_f", F.lit(1)).join(true.distinct().withColumn("_t", F.lit(1)), ["i", "j"], "full")
    counts = both.agg(F.sum(F.when(F.col("_f").isNotNull() & F.col("_t").isNotNull(), 1).otherwise(0)).alias("tp"), F.count("_f").alias("n"), F.count("_t").alias("m"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    return counts.select(ratio(F.col("tp"), F.col("n")).alias("precision"), ratio(F.col("tp"), F.col("m")).alias("recall"), ratio(2 * F.col("tp"), F.col("n") + F.col("m")).alias("f1"))


def validation(pairs: DataFrame, rows: int) -> DataFrame:
    """One row about a directed self-join: pairs, self_pairs, repeated, one_way, out_of_range, digest. The digest ignores order."""
    i, j, forth = F.col("i"), F.col("j"), F.coalesce(F.col("i") <= F.col("j"), F.lit(False))
    either = pairs.select(F.when(forth, i).otherwise(j).alias("lo"), F.when(forth, j).otherwise(i).alias("hi"), forth.cast("long").alias("f"))
    once = either.groupBy("lo", "hi").agg(F.sum("f").alias("f"), F.sum(1 - F.col("f")).alias("b"))  # both directions of a pair meet in one shuffle
    lo, hi, f, b = (F.col(c) for c in ("lo", "hi", "f", "b"))
    ways = (f > 0).cast("long") + (b > 0).cast("long")
    hashed = lambda n, one, two: F.when(n > 0, F.xxhash64(one, two)).otherwise(0)
    return once.agg(
        F.sum(f + b).alias("pairs"),
        F.sum((lo == hi).cast("long")).alias("self_pairs"),
        F.sum((f > 1).cast("long") + (b > 1).cast("long")).alias("repeated"),
        F.sum(((lo < 0) | (hi < 0) | (lo >= rows) | (hi >= rows)).cast("long") * ways).alias("out_of_range"),
        F.bit_xor(hashed(f, lo, hi).bitwiseXOR(hashed(b, hi, lo))).alias("digest"),
        F.coalesce(F.sum((~F.coalesce(lo == hi, F.lit(False)) & (ways == 1)).cast("long")), F.lit(0)).alias("one_way"),
    )


def ordered_digest(rows: DataFrame, columns: list[str], chunk: int = 1024) -> DataFrame:
    """One row, (rows, digest): SHA-256 of rows in the order of the columns, whatever the partitioning.

    Rows are numbered in that order; the digest of each chunk of rows, as text of comma-joined columns and line feeds, is one line of the
    next level, until there is one. No rows: the digest of nothing.
    """
    from vicinage.operators.blocks import numbered

    text = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    level = numbered(rows.select(*columns), columns).select("_n", text.alias("_t"))
    count = level.count()
    left = count
    while True:
        lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_t"))), lambda x: x["_t"]), "\n")  # a chunk
        level = level.groupBy(F.floor(F.col("_n") / chunk).cast("long").alias("_m")).agg(F.sha2(lines, 256).alias("_t")).withColumnRenamed("_m", "_n")
        left = -(-left // chunk)
        if left <= 1:
            return level.agg(F.lit(count).cast("long").alias("rows"), F.coalesce(F.max("_t"), F.sha2(F.lit(""), 256)).alias("digest"))
        level = written(level, "digests")


def budget(scored: DataFrame, share: float) -> DataFrame:
    """The best share of rows by score, ties by id: rows id, score."""
    return scored.orderBy("score", "id").limit(math.ceil(round(scored.count() * share, 6)))


def seeded_sample(df: DataFrame, rows: int, seed: int, key: str = "id") -> DataFrame:
    """`rows` rows in an order that depends on the key and the seed only: smaller samples are prefixes of larger ones."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(rows)
