"""Calibration from sampled pairs, with a bound of its error, and estimates of how large a result will be."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinage.functions import metrics as M
from vicinage.operators.blocks import numbered
from vicinage.operators.tiles import pairs_within
from vicinage.plans.storage import small, written

GRID = 4096  # thresholds are whole multiples of 1 / GRID; their squares are exact doubles


def sampled_distances(points: DataFrame, samples: int, seed: int = 0) -> tuple[DataFrame, int]:
    """(d, the squared distance) of sampled pairs of different rows, drawn with replacement, and the number of rows.

    Sample t is the pair whose place among all pairs i < j is the hash of t; the place is turned into the pair.
    """
    rows = written(numbered(points.select("id", "vec"), ["id"]).select(F.col("_n").alias("n"), "vec"), "sampled-rows")
    n = rows.count()
    if n > 1 << 26:
        raise ValueError("places of pairs are inverted in doubles, up to 2^26 rows")
    spark, total = points.sparkSession, n * (n - 1) // 2
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, total)))
    i, j = M.condensed_pair(place, max(2, n))
    pairs = spark.range(0, samples if total else 0, 1, parts).select(i.alias("i"), j.alias("j"))
    met = pairs.join(small(rows.toDF("i", "_a")), "i").join(small(rows.toDF("j", "_b")), "j")
    return met.select(M.squared_l2("_a", "_b").alias("d")), n


def sampled_threshold(points: DataFrame, pairs: float, samples: int = 1 << 22, seed: int = 0, doubt: float = 1e-6) -> DataFrame:
    """One row: m, epsilon = m / GRID, threshold = epsilon squared, the smallest on the grid that a share of the samples lies within, which is the share of `pairs` among all.

    share is that of the samples within it. With a probability of 1 - doubt the number of all pairs within it lies between least_pairs and most_pairs:
    the share of samples is off by at most sqrt(ln(2 / doubt) / (2 samples)), at all thresholds at once (Dvoretzky, Kiefer and Wolfowitz).
    Less than two rows give no row.
    """
    found, n = sampled_distances(points, samples, seed)
    total = n * (n - 1) // 2
    off = math.sqrt(math.log(2 / doubt) / (2 * samples))
    m = F.ceil(F.sqrt("d") * GRID).cast("long")
    fits = lambda k: k.cast("double") * k.cast("double") / float(GRID * GRID) >= F.col("d")
    m = F.when(fits(m - 1) & (m > 0), m - 1).when(fits(m), m).otherwise(m + 1)  # the root is rounded
    counts = found.groupBy(m.alias("m")).agg(F.count(F.lit(1)).alias("k"))  # as many rows as the grid has steps
    upto = counts.withColumn("upto", F.sum("k").over(Window.orderBy("m")))
    wanted = pairs / total * samples if total else 0
    best = upto.where(F.col("upto") >= wanted).orderBy("m").limit(1)
    share = F.col("upto") / samples
    return best.select(
        "m",
        (F.col("m") / float(GRID)).alias("epsilon"),
        (F.col("m").cast("double") * F.col("m").cast("double") / float(GRID * GRID)).alias("threshold"),
        share.alias("share"),
        F.floor(F.greatest(F.lit(0.0), share - off) * total).cast("long").alias("least_pairs"),
        F.ceil(F.least(F.lit(1.0), share + off) * total).cast("long").alias("most_pairs"),
    )


def strict_score_gap(scores: DataFrame, count: int, score: str = "score") -> DataFrame:
    """One row, threshold: midway between the count-th smallest score and the next; a tie between them, or no next score, is an error."""
    placed = numbered(scores.select(F.col(score).alias("_v")), ["_v"])
    two = placed.where(F.col("_n").isin(count - 1, count)).agg(F.min("_v").alias("a"), F.max("_v").alias("b"), F.count(F.lit(1)).alias("n"))
    tied = F.raise_error(F.lit("no gap behind the score asked for"))
    return two.select(F.when((F.col("n") == 2) & (F.col("a") < F.col("b")), (F.col("a") + F.col("b")) / 2).otherwise(tied).alias("threshold"))


def batch_estimate(points: DataFrame, limit: float, asked: DataFrame, batch_pairs: int) -> DataFrame:
    """One row: sampled rows, their pairs, estimated pairs of all rows (directed), and how many batches of at most batch_pairs these make, one at least.

    asked: the sampled rows of points.
    """
    n = points.count()
    found = pairs_within(asked, points, limit).agg(F.count(F.lit(1)).alias("sampled_pairs"))
    estimate = F.ceil(F.col("sampled_pairs") * n / F.greatest(F.col("sampled"), F.lit(1))).cast("long")
    one = asked.agg(F.count(F.lit(1)).alias("sampled")).crossJoin(found).withColumn("estimated_pairs", estimate)  # one row each
    return one.withColumn("batches", F.greatest(F.lit(1), F.ceil(F.col("estimated_pairs") / batch_pairs)).cast("long"))
