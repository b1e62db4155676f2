"""Sampled thresholds against exact counts, gaps of scores, estimates, and witnesses that are hubs."""

from collections import Counter

import numpy as np
import pytest

from tests.conftest import rows
from tests.test_joins import frame
from vicinage.operators import sampling, witnesses


@pytest.mark.parametrize("pairs", [40, 4000, 19000])
def test_sampled_threshold_is_within_its_bound(spark, pairs):
    x = np.random.default_rng(4).normal(size=(200, 5))
    d = np.sort(((x[:, None] - x[None]) ** 2).sum(2)[np.triu_indices(200, 1)])
    r = sampling.sampled_threshold(frame(spark, x, "double"), pairs, 1 << 15).first()
    assert r["epsilon"] * sampling.GRID == r["m"] and r["threshold"] == r["epsilon"] ** 2
    assert r["least_pairs"] <= (d <= r["threshold"]).sum() <= r["most_pairs"] and r["most_pairs"] - r["least_pairs"] < 0.04 * len(d)
    below = ((r["m"] - 1) / sampling.GRID) ** 2
    assert (d <= below).sum() <= pairs + 0.02 * len(d)  # the smallest on the grid


def test_samples_are_pairs_of_different_rows_and_whole_numbers_fit(spark):
    found, n = sampling.sampled_distances(frame(spark, [[0.0], [3.0], [7.0]]), 600)
    counts = Counter(r["d"] for r in found.collect())
    assert n == 3 and set(counts) == {9.0, 16.0, 49.0} and min(counts.values()) > 120
    assert sampling.sampled_threshold(frame(spark, [[0.0], [3.0], [7.0]]), 1.5, 600).first()["epsilon"] == 4.0
    assert sampling.sampled_threshold(frame(spark, [[0.0]]), 1, 10).count() == 0


def test_strict_gap(spark):
    scores = spark.createDataFrame([(float(v),) for v in (3, 1, 2, 2, 9)], "score double")
    assert sampling.strict_score_gap(scores, 1).first()[0] == 1.5 and sampling.strict_score_gap(scores, 4).first()[0] == 6.0
    for count in (2, 5):
        with pytest.raises(Exception, match="no gap"):
            sampling.strict_score_gap(scores, count).collect()


@pytest.mark.parametrize("size", [1024, 7])
@pytest.mark.parametrize("bag", [False, True])
def test_witnesses_with_a_hub(spark, size, bag):
    r = np.random.default_rng(6)
    edges = [(k, 0) for k in range(60)] + [(int(a), int(b)) for a, b in r.integers(0, (40, 9), (200, 2))] + [(5, 0), (5, 0)]
    df = spark.createDataFrame(edges + [(None, 1), (1, None)], "src long, dst long").repartition(3)
    times, want = Counter(edges), Counter()
    for (a, w), m in times.items():
        for (b, v), n in times.items():
            if w == v and a < b:
                want[a, b] += m * n if bag else 1
    assert {(q, b): n for q, b, n in rows(witnesses.witness_counts(df, bag, size))} == want


def test_a_hub_is_many_rectangles(spark):
    df = spark.range(2000).selectExpr("id AS src", "0L AS dst")
    made = witnesses.rectangles(df, 100).selectExpr("a", "b", "size(left) AS n", "size(right) AS m").collect()
    assert len(made) == 20 * 21 // 2 and max(r["n"] for r in made) == max(r["m"] for r in made) == 100


def test_pairs_of_hubs_are_summed_without_a_shuffle(spark):
    """Sums over hubs are made in the task of a pair of blocks: no pair is shuffled, and all of them are there."""
    df = spark.range(1300).selectExpr("id AS src", "explode(array(0L, id % 2, 2L, 2L)) AS dst")
    found = witnesses.witness_counts(df, True, 100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and found.count() == 1300 * 1299 // 2
    times = lambda k: Counter([0, k % 2, 2, 2])
    want = lambda q, b: sum(n * times(b)[w] for w, n in times(q).items())
    assert all(r["witnesses"] == want(r["q"], r["b"]) and r["q"] < r["b"] for r in found.where("q % 97 = 5 OR b % 89 = 3").collect())
