"""Join strategies against NumPy on adversarial inputs; soundness of bounds; metamorphic relations."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.conftest import rows
from vicinage.functions import metrics as M
from vicinage.operators import blocks, joins, relations, tiles
from vicinage.plans import queries
from vicinage.streaming import updates


def frame(spark, x, kind="float"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"id long, vec array<{kind}>")


def expected(x, limit):
    x = np.asarray(x, np.float32).astype(np.float64)
    out = set()
    for i in range(len(x)):
        for j in range(i, len(x)):
            total = 0.0
            for v in (x[i] - x[j]) ** 2:
                total += v
            if total <= limit:
                out.add((i, j))
    return sorted(out)


rng = np.random.default_rng(5)
CASES = {
    "zeros": (np.zeros((31, 8)), 0.0),
    "two blocks": (np.repeat([[1.0] * 8, [-1.0] * 8], 16, 0), 0.0),
    "one hot": (np.eye(16)[rng.permutation(31) % 16], 1.0),
    "cancellation": (0.5 + rng.integers(-1, 2, (31, 64)) * 2.0**-12, 1e-6),
    "subnormal": (rng.integers(0, 3, (31, 64)) * 1e-45, 1e-80),
    "ragged dimension": (rng.normal(size=(70, 65)), 110.0),
    "one dimension": (rng.integers(0, 9, (40, 1)), 1.0),
    "clusters": (np.repeat(np.eye(8, 64), 32, 0) + rng.normal(size=(256, 64)) * 1e-4, 0.01),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("strategy", joins.STRATEGIES)
def test_strategies_agree(spark, name, strategy):
    x, limit = CASES[name]
    assert rows(joins.similarity_join(frame(spark, x), None, limit, strategy)) == expected(x, limit)


MAGNITUDES = {
    "huge": (np.array([[1.0, 2.0], [1.0, 2.0], [3.0, 1.0], [1.0, 2.5], [0.0, 0.0]]) * 5e153, 1e308),
    "beyond squares": (np.array([[1.0, 2.0], [1.0, 2.0], [-3.0, 1.0]]) * 1e200, 1e300),
    "tiny": (np.array([[1.0, 2.0], [1.0, 2.0], [3.0, 1.0], [0.0, 0.0]]) * 1e-170, 0.0),
    "subnormal squares": (np.array([[1.0, 2.0], [1.5, 2.0], [3.0, 1.0], [0.0, 0.0]]) * 1e-160, 1e-320),
    "mixed": (np.array([[1e200, 1.0], [1e200, 2.0], [1e-170, 0.0], [0.0, 1e-3], [1.0, 1.0]]), 1.0),
}


@pytest.mark.parametrize("name", MAGNITUDES)
def test_tiles_at_any_magnitude(spark, name):
    """Pairs, nearest rows and the cascade are those of the fold, equal rows and a row with itself included."""
    x, limit = MAGNITUDES[name]
    df, n = frame(spark, x, "double"), len(x)
    d = np.stack([tiles.folded("l2", np.repeat(x[i : i + 1], n, 0), x) for i in range(n)])
    want = [(i, j) for i in range(n) for j in range(i, n) if d[i, j] <= limit]
    for strategy in ("tiles", "naive", "cascade"):
        assert rows(joins.similarity_join(df, None, limit, strategy)) == want
    got = sorted((r["q"], r["rank"], r["id"]) for r in tiles.nearest(df, df, 2).collect())
    assert got == [(i, k + 1, int(j)) for i in range(n) for k, j in enumerate(np.lexsort((np.arange(n), d[i]))[:2])]


def test_cosine_of_zero_and_extreme_vectors(spark):
    """A zero vector has cosine 0 with all; scale doesn't matter, down to subnormal and up to the largest doubles."""
    x = np.array([[0.0, 0.0], [1e-170, 0.0], [3.0, 0.0], [0.0, 1e300], [1e300, 1e300], [-5e-324, 0.0]])
    df = frame(spark, x, "double")
    for limit in (0.0, 0.5, 1.0, 2.0):
        assert rows(joins.similarity_join(df, None, limit, "tiles", "cosine")) == rows(joins.similarity_join(df, None, limit, "naive", "cosine"))
    near = rows(joins.similarity_join(df, None, 0.3, "tiles", "cosine"))
    assert near == [(1, 1), (1, 2), (1, 4), (2, 2), (2, 4), (3, 3), (3, 4), (4, 4), (5, 5)]
    assert (0, 0) not in near and (0, 0) in rows(joins.similarity_join(df, None, 1.0, "tiles", "cosine"))


def test_admission_by_magnitude(spark):
    df = frame(spark, [[0.5, -1.0]])
    assert tiles.checked(df, "id", "vec", largest=1.0).count() == 1
    with pytest.raises(Exception, match="beyond 0.75"):
        tiles.checked(df, "id", "vec", largest=0.75).collect()


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.integers(-4, 4), min_size=3, max_size=3), min_size=1, max_size=30), st.integers(0, 20))
def test_strategies_on_integers(spark, x, limit):
    want = expected(x, limit)
    for strategy in ("tiles", "cascade", "pivot"):
        assert rows(joins.similarity_join(frame(spark, x), None, float(limit), strategy)) == want


def test_boundary_is_inclusive(spark):
    x = [[0.0, 0.0], [1.0, 0.0], [0.0, 1.0 + 2.0**-20]]
    got = rows(tiles.pairs_within(frame(spark, x), None, 1.0))
    assert (0, 1) in got and (0, 2) not in got


def test_metamorphic(spark):
    x = rng.normal(size=(60, 12)).astype(np.float32)
    base = rows(tiles.pairs_within(frame(spark, x), None, 14.0))
    assert rows(tiles.pairs_within(frame(spark, -x), None, 14.0)) == base
    assert rows(tiles.pairs_within(frame(spark, x * 256), None, 14.0 * 65536)) == base


def test_small_tiles_give_the_same(spark):
    x = rng.normal(size=(90, 5))
    df = frame(spark, x)
    tiles.BLOCK_ROWS, keep = 7, tiles.BLOCK_ROWS
    try:
        n = len(rows(tiles.over_tiles(df, None, lambda a, x, b, y, s: __import__("pandas").DataFrame({"n": [len(a)]}), "n long", rows=7)))
    finally:
        tiles.BLOCK_ROWS = keep
    assert n == 13 * 14 // 2
    got = rows(tiles.nearest(df, df, 3).select("q", "id"))
    d = ((x.astype(np.float32).astype(float)[:, None] - x.astype(np.float32).astype(float)[None]) ** 2).sum(2)
    assert got == sorted((i, int(j)) for i in range(90) for j in np.lexsort((np.arange(90), d[i]))[:3])


@pytest.mark.parametrize("bad", [[[float("nan"), 1.0]], [[float("inf"), 1.0]], [[]], [None]])
def test_bad_vectors_are_errors(spark, bad):
    df = spark.createDataFrame([(1, b) for b in bad], "k long, v array<float>")
    with pytest.raises(Exception):
        tiles.pairs_within(tiles.checked(df, "k", "v"), None, 1.0).collect()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, vec array<float>")
    for strategy in ("tiles", "naive", "cascade", "pivot"):
        assert rows(joins.similarity_join(empty, None, 1.0, strategy)) == []


@pytest.mark.parametrize("method", blocks.LAYOUTS)
@pytest.mark.parametrize("kind", ["box", "ball"])
def test_pruned_join_is_whole_and_prunes(spark, method, kind):
    x, limit = CASES["clusters"]
    x = x[np.random.default_rng(2).permutation(len(x))]
    points = blocks.written(blocks.layout(frame(spark, x), method, rows=16), "test")
    assert points.select("id").distinct().count() == len(x)
    assert rows(blocks.block_join(points, limit, kind)) == expected(x, limit)
    if method == "pca_sort":
        assert blocks.pruned_share(points, limit, kind).first()[0] > 0


def test_projection_bound(spark):
    x = rng.normal(size=(50, 10)).astype(np.float32)
    axes, scale = blocks.principal_axes(frame(spark, x), 4)
    d = ((x[:, None].astype(float) - x[None]) ** 2).sum(2)
    y = x.astype(float) @ axes
    assert (((y[:, None] - y[None]) ** 2).sum(2) / scale <= d + 1e-9).all()


def test_midgap_counts_ties(spark):
    x = [[0.0], [1.0], [2.0], [4.0]]  # squared gaps 1, 1, 4, 4, 9, 16
    assert rows(relations.midgap(frame(spark, x), None, 1)) == [(2.5, 2)]
    assert rows(relations.strict_gap(frame(spark, x), None, 1)) == []
    assert rows(relations.strict_gap(frame(spark, x), None, 2)) == [(2.5, 2)]
    assert rows(relations.order_statistic(frame(spark, x), None, 3)) == [(4.0,)]


def test_factorised_join_is_a_set(spark):
    left = spark.createDataFrame([(0, 1, [0.0]), (1, 1, [0.0]), (1, 2, [5.0])], "w int, q long, qv array<double>")
    right = spark.createDataFrame([(0, 7, [1.0]), (1, 7, [1.0])], "w int, b long, bv array<double>")
    assert rows(relations.factorised_join(left, right, 1.0)) == [(1, 7)]
    assert rows(relations.factorised_join(left, right, -1.0)) == []
    assert rows(relations.factorised_join(left, right)) == [(1, 7), (2, 7)]


def embeddings(spark, folder, x, labels=None):
    """A folder of tables that holds only embeddings, for registered queries."""
    made = [(i, [float(v) for v in r], int(labels[i]) if labels is not None else 0) for i, r in enumerate(x)]
    spark.createDataFrame(made, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_ranked_range_join_is_whole_beyond_k(spark, tmp_path):
    """Queries 0 and 100 have 31 and 8 rows within the limit, 200 and 300 fewer than k."""
    x = np.full((70, 2), 50.0) + np.arange(70)[:, None] * 3
    x = np.concatenate([x, np.full((250, 2), 900.0) + np.arange(250)[:, None] * 3])
    x[[0, *range(31, 61)]] = rng.normal(size=(31, 2)) * 0.05
    x[[100, *range(1, 8)]] = [-40.0, 0.0] + rng.normal(size=(8, 2)) * 0.05
    x[[200, 201]] = [[-80.0, 0.0], [-80.0, 1.0]]
    x = x.astype(np.float32)
    x[40] = x[41]
    d = ((x[:, None].astype(float) - x[None]) ** 2).sum(2)
    want = [(q, r + 1, int(j)) for q in range(0, 320, 100) for r, j in enumerate(j for j in np.lexsort((np.arange(320), d[q])) if d[q, j] <= queries.LIMIT)]
    got = rows(queries.QUERIES["knn_then_filter"](spark, embeddings(spark, tmp_path, x)))
    assert got == sorted(want) and sum(w[0] == 0 for w in want) > 8


@pytest.mark.parametrize("size", [512, 7])
def test_factorised_self_join_reads_all_rows(spark, tmp_path, size, monkeypatch):
    """A third of the rows has one label; residues of ids modulo 3 don't matter."""
    x, label = (rng.normal(size=(90, 5)) * 0.5).astype(np.float32), np.where(np.arange(90) < 30, 0, np.arange(90) % 7)
    want = [(i, j) for i, j in expected(x, 1.6) if i < j and label[i] == label[j]]
    monkeypatch.setattr(tiles.over_tiles_by, "__defaults__", (size,))
    folder = embeddings(spark, tmp_path, x, label)
    assert rows(queries.QUERIES["factorised_self_join"](spark, folder)) == want
    assert {i % 3 for p in want for i in p} == {0, 1, 2}
    twice = spark.createDataFrame([(w, i, [float(v) for v in x[i]]) for i in range(90) for w in (0, 1)], "w int, id long, vec array<float>")
    assert rows(relations.factorised_self_join(twice, 1.6)) == [(i, j) for i, j in expected(x, 1.6) if i < j]


@pytest.mark.parametrize("size", [512, 7])
def test_projected_scan_splits_labels(spark, tmp_path, size, monkeypatch):
    x, label = (rng.normal(size=(60, 20)) * 0.12).astype(np.float32), np.where(np.arange(60) < 30, 0, np.arange(60) % 3)
    monkeypatch.setattr(tiles.over_tiles_by, "__defaults__", (size,))
    want = [(i, j) for i, j in expected(x[:, :16], 0.3) if i < j and label[i] == label[j]]
    assert rows(queries.QUERIES["projected_scan"](spark, embeddings(spark, tmp_path, x, label))) == want and want


def test_progressive_scan_has_all_pairs_and_bands(spark, tmp_path):
    x = (rng.normal(size=(70, 64)) * rng.choice([0.02, 0.05, 0.09], (70, 1))).astype(np.float32)
    x[5] = x[50]
    want = []
    for limit in (0.2, 0.3):
        alive = [set(expected(x[:, :rank], limit)) for rank in (16, 32, 64)]
        want += [(i, j, limit, 64 if (i, j) in alive[2] else 32 if (i, j) in alive[1] else 16) for i, j in alive[0] if i < j]
    got = rows(queries.QUERIES["progressive_scan"](spark, embeddings(spark, tmp_path, x, np.arange(70) % 10)))
    assert got == sorted(want) and {w[3] for w in want} == {16, 32, 64} and len(want) < 70 * 69


def test_stage_state_counts_add_up(spark, tmp_path):
    """Every pair is decided once, by a stage whose decision is the fold's, and what a stage passes on is what later ones decide."""
    x = (rng.normal(size=(60, 8)) * 0.5).astype(np.float32)
    x[1], x[0] = 0.0, [1.4**0.5, 0, 0, 0, 0, 0, 0, 0]
    got = {(r.stage, r.state): r.pairs for r in queries.QUERIES["stage_state_counts"](spark, embeddings(spark, tmp_path, x)).collect()}
    assert got[1, 2] == sum(n for (s, t), n in got.items() if s > 1 and t < 2) and got[2, 2] == got.get((3, 0), 0) + got.get((3, 1), 0)
    assert got[1, 0] + got[1, 1] + got[1, 2] == 60 * 61 // 2
    assert sum(n for (_, t), n in got.items() if t == 1) == len(expected(x, queries.LIMIT))
    x = x.astype(np.float64)
    seen = set()
    for a, b, stage, state in joins.certified(np.arange(60), x, np.arange(60), x, True, queries.LIMIT):
        for i, j in zip(a.tolist(), b.tolist()):
            assert (i, j) not in seen and bool(state) == (float(tiles.folded("l2", x[i : i + 1], x[j : j + 1])[0]) <= queries.LIMIT)
            seen.add((i, j))
    assert len(seen) == 60 * 61 // 2 and got[1, 0] > got[2, 2] and got[2, 0] + got[2, 1] > 0


@pytest.mark.parametrize("offset", [0.0, 1e-6, 1.0, 1e3, 1e5, 1e7, 1e12])
@pytest.mark.parametrize("scale", [1e-150, 1e-6, 1.0, 1e7, 1e25])
def test_certificates_hold_at_any_scale_and_offset(offset, scale):
    """Doubles around a common offset: each stage decides as the fold does; limits on and between distances."""
    r = np.random.default_rng(int(offset) + 7)
    x = (offset + r.normal(size=(40, 4))) * scale
    x[1] = x[0]
    d = np.array([tiles.folded("l2", np.repeat(x[i : i + 1], 40, 0), x) for i in range(40)])
    for limit in (0.0, float(d[3, 5]), float(np.nextafter(d[3, 5], 0)), 0.5 * scale * scale, float(np.median(d))):
        n = 0
        for a, b, _, state in joins.certified(np.arange(40), x, np.arange(40), x, True, limit):
            assert ((d[a, b] <= limit) == bool(state)).all()
            n += len(a)
        assert n == 40 * 41 // 2


def test_cascade_equals_naive_around_an_offset(spark):
    x = 1e7 + np.random.default_rng(3).normal(size=(40, 4)) * 0.4
    df = frame(spark, x, "double")
    assert rows(joins.similarity_join(df, None, 0.5, "cascade")) == rows(joins.similarity_join(df, None, 0.5, "naive"))


def test_condensed_pairs(spark):
    n = 23
    from pyspark.sql import functions as F

    pairs = spark.range(n * (n - 1) // 2).select("id", *[c.alias(name) for c, name in zip(M.condensed_pair(F.col("id"), n), "ij")])
    assert [tuple(r)[1:] for r in pairs.orderBy("id").collect()] == [(a, b) for a in range(n) for b in range(a + 1, n)]


def test_update_log(spark):
    log = [(0, "insert", 3), (1, "query", 0), (2, "delete", 1), (3, "query", 0), (4, "delete", 1), (5, "insert", 1), (6, "insert", 3), (7, "query", 0), (8, "delete", 3), (9, "query", 3)]
    x = {0: 0.0, 1: 1.0, 2: 9.0, 3: 0.5}
    vec = spark.createDataFrame([(k, [v]) for k, v in x.items()], "id long, vec array<float>")
    base = {0, 1, 2}
    live, want = set(base), []
    for seq, op, k in log:
        if op == "insert":
            live.add(k)
        elif op == "delete":
            live.discard(k)
        else:
            want.append((seq, sum((x[k] - x[o]) ** 2 <= 1 for o in live)))
    events = spark.createDataFrame(log, "seq long, op string, id long")
    start = spark.createDataFrame([(k,) for k in base], "id long")
    assert rows(updates.replay(events, start, vec, 1.0)) == want
    assert {r[0] for r in rows(updates.live_ids(events, start))} == live


@pytest.mark.parametrize("cache", [0, 7, 1000])
def test_stream_equals_replay(spark, tmp_path, cache):
    """With a snapshot each batch, compaction on the way, and none; a batch that runs again gives the same."""
    log = [(k, ("insert", "query", "delete", "query")[k % 4], (k * 7) % 5) for k in range(40)]
    vec = spark.createDataFrame([(k, [float(k)]) for k in range(5)], "id long, vec array<float>")
    base = spark.createDataFrame([(0,)], "id long")
    out = {}
    index = updates.LiveIndex(vec, base, str(tmp_path / "state"), 1.0, lambda df, batch: out.__setitem__(batch, rows(df)), cache)
    for part in range(4):  # batches in order
        events = spark.createDataFrame(log[part * 10 : part * 10 + 10], "seq long, op string, id long").coalesce(1)
        index.on_batch(events, part)
        before = out[part]
        if part == 2:
            index.on_batch(events, part)
            assert out[part] == before
    events = spark.createDataFrame(log, "seq long, op string, id long")
    assert sorted(r for b in out.values() for r in b) == rows(updates.replay(events, base, vec, 1.0))
    assert {r[0] for r in rows(index.snapshot(3))} == {r[0] for r in rows(updates.live_ids(events, base))}
    assert index.state(3)[0] == {0: 3, 7: 3, 1000: -1}[cache]


def test_farthest_pivots(spark):
    x = rng.normal(size=(40, 3)).astype(np.float32).astype(np.float64)
    chosen = [0]
    while len(chosen) < 5:
        gap = ((x[:, None] - x[chosen][None]) ** 2).sum(2).min(1)
        chosen.append(int(gap.argmax()))
    assert np.allclose(blocks.farthest_pivots(frame(spark, x), 5), x[chosen])
    got = {r.id: r.pivot for r in blocks.nearest_pivot(frame(spark, x), x[chosen].tolist()).collect()}
    assert got == {k: int(((x[k] - x[chosen]) ** 2).sum(1).argmin()) for k in range(40)}


def test_hadamard_keeps_distances(spark):
    x = rng.normal(size=(12, 8))
    y = np.array([r[0] for r in frame(spark, x, "double").orderBy("id").select(M.hadamard("vec", 8)).collect()])
    assert np.allclose(((x[:, None] - x[None]) ** 2).sum(2), ((y[:, None] - y[None]) ** 2).sum(2))


def test_samples_are_nested(spark):
    df = spark.range(100)
    small, large = ({r.id for r in relations.seeded_sample(df, n, 3).collect()} for n in (10, 30))
    assert len(small) == 10 and small < large


@pytest.mark.parametrize("metric,limit", [("l2", 6.0), ("l1", 5.0), ("linf", 1.2), ("cosine", 0.8)])
def test_naive_takes_every_pair_in_slabs(spark, monkeypatch, metric, limit):
    """Slabs of a few rows give the fold's distances, and the nested loop doesn't sift."""
    monkeypatch.setattr(tiles, "SLAB_ROWS", 3)
    x = rng.normal(size=(40, 5)).astype(np.float32).astype(float)
    near = [(i, j) for i in range(40) for j in range(i, 40) if tiles.folded(metric, x[i : i + 1], x[j : j + 1])[0] <= limit]
    assert {at: d.shape for at, d in tiles.slabs(metric, x, x)} == {at: (min(3, 40 - at), 40) for at in range(0, 40, 3)}
    df = frame(spark, x)
    assert rows(tiles.every_pair(df, None, limit, metric)) == rows(joins.similarity_join(df, None, limit, "tiles", metric)) == near
    assert rows(tiles.every_pair(df, df, limit, metric)) == sorted({*near, *[(j, i) for i, j in near]})


def test_a_bin_of_pivots_is_many_blocks(spark, monkeypatch):
    """All rows in one bin: they meet block by block, in bounded partitions; ids may repeat."""
    monkeypatch.setattr(tiles, "block_rows", lambda count: 7)
    df = spark.createDataFrame([(k // 2, [1.0, float(k % 3)]) for k in range(60)] + [(0, [90.0, 0.0])], "id long, vec array<double>")
    made = df.collect()
    want = sorted((a["id"], b["id"]) for a in made for b in made if a["id"] <= b["id"] and sum((u - v) ** 2 for u, v in zip(a["vec"], b["vec"])) <= 1.0)
    assert rows(joins.similarity_join(df, None, 1.0, "pivot")) == want
    assert tiles.dealt_pairs(spark.range(3000)).rdd.getNumPartitions() == 3000 // 64


@pytest.mark.parametrize("kind", ["box", "ball"])
def test_blocks_meet_in_groups(spark, monkeypatch, kind):
    """Rows aren't copied for each pair of blocks: groups of blocks meet by number, each pair of groups once."""
    met, deal = [], tiles.dealt_pairs
    monkeypatch.setattr(tiles, "MOST_ROWS", 40)
    monkeypatch.setattr(tiles, "dealt_pairs", lambda pairs: met.append(pairs.count()) or deal(pairs))
    x = np.random.default_rng(4).normal(size=(70, 3)).astype(np.float32)
    points = frame(spark, x).selectExpr("id", "vec", "CASE WHEN id < 5 THEN 0 ELSE id div 10 + 1 END AS block")
    assert rows(blocks.block_join(points, 1.5, kind)) == expected(x, 1.5)
    assert met == [3]  # two groups of at most four blocks


@pytest.mark.parametrize("metric", ["l1", "linf"])
@pytest.mark.parametrize("scale, offset", [(1e-310, 0.0), (1e-150, 0.0), (1.0, 0.0), (1.0, 1e12), (1e25, 3.0), (1e300, 0.0)])
@pytest.mark.parametrize("dim", [1, 3, 64, 65, 784])
def test_codes_of_16_bits_hold_the_fold(metric, scale, offset, dim):
    """The sift of l1 and linf is made of short codes: what it may be off by holds on both sides, and is small."""
    r = np.random.default_rng(dim)
    x, y = r.normal(size=(9, dim)) * scale + offset, r.normal(size=(70, dim)) * scale + offset
    x[0] = y[1]
    with np.errstate(over="ignore"):
        d = tiles.folded(metric, x[:, None], y[None])
    near, slack = tiles.rough(metric, x, y)
    assert (near <= d + slack).all() and (d <= near + slack).all()
    assert slack > 0 and (offset == 1e12 or scale == 1e-310 or slack <= 0.02 * (dim if metric == "l1" else 1) * scale)


def test_smallest_sends_no_more_than_is_near_what_is_asked(spark):
    """Tiles don't send as many distances as are asked for each, but those up to a bound that all tiles have told."""
    x = np.random.default_rng(3).normal(size=(1500, 6))
    d = np.sort(((x[:, None] - x[None]) ** 2).sum(2)[np.triu_indices(1500, 1)])
    found = tiles.smallest(frame(spark, x, "double"), None, 2000)
    got = sorted(r["d"] for r in found.collect() for _ in range(r["pairs"]))
    assert len(got) < 2100 and np.allclose(got[:2001], d[:2001], rtol=1e-12) and len(d) > 21 * 2000
    assert abs(relations.order_statistic(frame(spark, x, "double"), None, 2000).first()[0] - d[1999]) < 1e-12
    assert relations.order_statistic(frame(spark, x, "double"), None, len(d)).first()[0] == pytest.approx(d[-1])


def test_pairs_are_looked_for_among_distinct_points(spark):
    """Rows of equal coordinates are one point for the search, and all their pairs are there; ids that repeat count as rows of their own."""
    x = np.random.default_rng(5).integers(0, 4, (700, 2)).astype(float)
    ids = list(range(699)) + [7]
    df = spark.createDataFrame([(i, v) for i, v in zip(ids, x.tolist())], "id long, vec array<double>")
    seen = []

    def found(points):
        seen.append(points.count())
        return joins.similarity_join(points, None, 1.0)

    got = rows(joins.by_points(df, found))
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    want = sorted((a, b) for r, a in enumerate(ids) for s, b in enumerate(ids) if a <= b and d[r, s] <= 1.0)
    assert got == want and seen == [16]


@pytest.mark.parametrize("scale, offset", [(1.0, 0.0), (1.0, 1e6), (1e-150, 0.0), (1e150, 0.0)])
def test_cells_of_chamfer_scores_are_folded_near_the_minima(scale, offset):
    r = np.random.default_rng(1)
    x, y = r.normal(size=(60, 32)) * scale + offset, r.normal(size=(90, 32)) * scale + offset
    x[3], y[5] = x[4], y[6]
    p, q = r.integers(0, 5, 60), r.integers(0, 7, 90)
    d, cells = tiles.folded("l2", x[:, None], y[None]), relations.nearest_cells(x, p, y, q)
    for o in range(7):
        assert (cells[:, q == o].min(1) == d[:, q == o].min(1)).all()
    for o in range(5):
        assert (cells[p == o].min(0) == d[p == o].min(0)).all()
    assert np.isfinite(cells).mean() < (0.25 if offset == 0 else 2) and (cells[np.isfinite(cells)] == d[np.isfinite(cells)]).all()


def test_validation_meets_both_directions_in_one_shuffle(spark):
    pairs = [(0, 0), (1, 2), (2, 1), (2, 1), (3, 1), (1, 9), (9, 1), (None, 2), (2, None), (None, None), (4, -1)]
    df = spark.createDataFrame(pairs, "i long, j long")
    found = relations.validation(df, 5)
    r = found.first()
    want = df.distinct().selectExpr("bit_xor(xxhash64(i, j))").first()[0]
    assert (r["pairs"], r["self_pairs"], r["repeated"], r["out_of_range"], r["one_way"], r["digest"]) == (11, 1, 1, 3, 5, want)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    none = relations.validation(df.where("false"), 5).first()
    assert none["pairs"] is None and none["one_way"] == 0 and none["digest"] is None


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_that_are_too_many_to_be_broadcast_are_dealt_by_groups(spark, monkeypatch):
    r = np.random.default_rng(11)
    x = np.round(r.normal(size=(900, 3)), 1)
    monkeypatch.setattr(tiles, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(tiles, "GROUP_BYTES", 1 << 12)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    df = frame(spark, x, "double")
    found = tiles.pairs_within(df, None, 0.5)
    i, j = np.nonzero(np.triu(d <= 0.5))
    assert rows(found) == list(zip(i.tolist(), j.tolist()))
    assert "Join" not in plan_of(found)  # a block is sent once a group of the other side, not once a block
    left = df.where("id % 3 = 0")
    i, j = np.nonzero(d[::3] <= 0.5)
    assert rows(tiles.pairs_within(left, df, 0.5)) == sorted(zip((3 * i).tolist(), j.tolist()))


@pytest.mark.parametrize("scale, offset", [(1.0, 0.0), (1e-30, 0.0), (1e25, 0.0), (1.0, 1e6), (1e-200, 0.0), (0.0, 1.0)])
def test_single_precision_sifts_on_the_safe_side(scale, offset):
    r = np.random.default_rng(5)
    x = r.normal(size=(80, 20)) * scale + offset
    y = np.concatenate([r.normal(size=(60, 20)) * scale + offset, x[:20]])
    d = tiles.folded("l2", x[:, None], y[None])
    for limit in [*np.quantile(d, [0.01, 0.3]), d[3, 5], 0.0]:
        a, b, sure = tiles.sifted("l2", x, y, float(limit))
        inside = tiles.settled(x, y, a, b, sure, float(limit))
        assert (d[a[sure], b[sure]] <= limit).all()
        got = np.zeros(d.shape, bool)
        got[a[inside], b[inside]] = True
        assert (got == (d <= limit)).all()


def test_tiles_count_bins_without_sorting_all_pairs():
    x = np.random.default_rng(6).normal(size=(64, 8))
    bins, pairs, slack = tiles._single_bins(x, x + 0.1, None)
    d = np.sort(tiles.folded("l2", x[:, None], x[None] + 0.1).ravel())
    low = tiles._begin(np.repeat(bins, pairs))
    assert pairs.sum() == d.size and (d <= tiles._begin(np.repeat(bins, pairs) + 1)).all() and (d >= low - 2 * slack).all()


@pytest.mark.parametrize("scale, offset", [(1.0, 0.0), (1.0, 1e6), (1e-150, 0.0), (1e25, 3.0)])
def test_stages_of_some_pairs_are_those_of_all(monkeypatch, scale, offset):
    """The cascade asks its stages of pairs that one product leaves, not of whole blocks; accepted pairs are the same."""
    r = np.random.default_rng(8)
    x, y = r.normal(size=(70, 24)) * scale + offset, r.normal(size=(50, 24)) * scale + offset
    x[3] = y[4]
    d = tiles.folded("l2", x[:, None], y[None])
    limit, ids, others = float(np.quantile(d, 0.05)), np.arange(70), np.arange(70, 120)
    near = tiles.sifted("l2", x, y, limit)[:2]
    if scale == 1.0 and offset == 0.0:
        assert len(near[0]) < 0.06 * d.size
    got = np.zeros(d.shape, int)
    for a, b, _, state in joins.certified(ids, x, others, y, False, limit, near):
        np.add.at(got, (a, b), 1 if state else 100)
    assert ((got == 1) == (d <= limit)).all() and (got[got > 1] == 100).all()
