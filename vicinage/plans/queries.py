"""The registered queries of the library and their DuckDB equivalents. Every query reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinage.functions import metrics as M
from vicinage.operators import blocks, certificates, hierarchy, joins, objects as objects_, relations, sampling, tiles, trees, windows, witnesses
from vicinage.plans.storage import place, written
from vicinage.sources import binary
from vicinage.streaming import updates

#: Squared-distance limit of the joins over embeddings; no pair lies within 1e-5 of it.
LIMIT = 1.4

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return tiles.checked(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", *extra)


def upper(spark: SparkSession, sf_dir: str, limit: float = LIMIT, strategy: str = "tiles", metric: str = "l2") -> DataFrame:
    return joins.similarity_join(vectors(spark, sf_dir), None, limit, strategy, metric)


def directed(spark: SparkSession, sf_dir: str, limit: float = LIMIT) -> DataFrame:
    return joins.mirrored(written(upper(spark, sf_dir, limit), "pairs"))


_Z = "list_zip({a}.embedding, {b}.embedding)"
_SUM = "list_reduce(list_transform(" + _Z + ", lambda z: {f}), lambda u, v: u + v)"
_D2 = _SUM.replace("{f}", "(z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)").format(a="a", b="b")
_ALL = f"WITH d AS (SELECT a.vec_id AS i, b.vec_id AS j, {_D2} AS d2 FROM embeddings a JOIN embeddings b ON a.vec_id <= b.vec_id), p AS (SELECT i, j FROM d WHERE d2 <= {LIMIT}), s AS (SELECT i, j FROM p UNION ALL SELECT j, i FROM p WHERE i < j)"
_CLOSE = _ALL.replace(f"<= {LIMIT}", "<= 1.3").replace("p AS", "p3 AS").replace("s AS (SELECT i, j FROM p UNION ALL SELECT j, i FROM p ", "s3 AS (SELECT i, j FROM p3 UNION ALL SELECT j, i FROM p3 ")
_TWO = _ALL + ", p3 AS (SELECT i, j FROM d WHERE d2 <= 1.3 OR (i + j) % 7 = 0 AND d2 <= 1.45)"


def second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another pair set, overlapping the first."""
    found = tiles.pairs_within(vectors(spark, sf_dir), None, 1.45, distances=True)
    return found.where((F.col("d") <= 1.3) | ((F.col("i") + F.col("j")) % 7 == 0)).select("i", "j")


@query(f"{_ALL} SELECT i, j FROM p")
def self_join_upper(spark, sf_dir):
    return upper(spark, sf_dir)


@query(f"{_ALL} SELECT i, j FROM s")
def self_join_directed(spark, sf_dir):
    return joins.mirrored(upper(spark, sf_dir))


@query(f"{_ALL} SELECT i, j FROM p")
def self_join_naive(spark, sf_dir):
    return upper(spark, sf_dir, strategy="naive")


@query(f"{_ALL} SELECT count(*) AS pairs FROM s")
def self_join_count(spark, sf_dir):
    return joins.mirrored(upper(spark, sf_dir)).agg(F.count(F.lit(1)).alias("pairs"))


@query(f"{_ALL} SELECT i, j FROM p")
def cascade_join(spark, sf_dir):
    return upper(spark, sf_dir, strategy="cascade")


@query(f"{_ALL} SELECT (SELECT count(*) FROM p) AS accepted, (SELECT count(*) FROM d) - (SELECT count(*) FROM p) AS rejected")
def stage_counts(spark, sf_dir):
    """Pairs that the stages of the cascade accept and reject, as each stage has counted its own."""
    found = joins.stage_state_counts(vectors(spark, sf_dir), LIMIT)
    total = lambda state: F.coalesce(F.sum(F.when(F.col("state") == state, F.col("pairs"))), F.lit(0))
    return found.agg(total(1).alias("accepted"), total(0).alias("rejected"))


@query()
def stage_state_counts(spark, sf_dir):
    """Pairs that each stage of the cascade rejects, accepts and passes on."""
    return joins.stage_state_counts(vectors(spark, sf_dir), LIMIT)


@query(f"{_ALL} SELECT i, j FROM p")
def refpoint_bin_join(spark, sf_dir):
    return upper(spark, sf_dir, strategy="pivot")


@query(f"{_ALL} SELECT i, count(*) AS neighbours FROM s GROUP BY i")
def neighbor_counts(spark, sf_dir):
    return directed(spark, sf_dir).groupBy("i").agg(F.count(F.lit(1)).alias("neighbours"))


@query(f"{_ALL} SELECT i, string_agg(j::VARCHAR, ',' ORDER BY j) AS neighbours FROM s GROUP BY i")
def neighbor_table(spark, sf_dir):
    return relations.neighbour_table(directed(spark, sf_dir)).select("i", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"))


@query(f"SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.label % 2 = 0 AND b.label % 2 = 1 WHERE {_D2} <= {LIMIT}")
def rs_join_by_label(spark, sf_dir):
    v = vectors(spark, sf_dir, "label")
    return joins.similarity_join(v.where("label % 2 = 0").select("id", "vec"), v.where("label % 2 = 1").select("id", "vec"), LIMIT)


@query(f"SELECT a.vec_id AS q, b.vec_id AS id FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 WHERE {_D2} <= {LIMIT}")
def range_query(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return tiles.pairs_within(v.where("id % 100 = 0"), v, LIMIT).toDF("q", "id")


_KNN = "SELECT q, rank, id FROM (SELECT a.vec_id AS q, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {d}, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON {on}) WHERE rank <= {k}"


@query(_KNN.format(d=_D2, on="a.vec_id % 100 = 0", k=8))
def knn_join(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return tiles.nearest(v.where("id % 100 = 0"), v, 8).select("q", F.col("rank").cast("long").alias("rank"), "id")


@query(_KNN.format(d=_D2, on="a.vec_id <> b.vec_id", k=3))
def knn_graph_without_self(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return tiles.nearest(v, v, 3, itself=False).select("q", F.col("rank").cast("long").alias("rank"), "id")


@query(f"SELECT q, row_number() OVER (PARTITION BY q ORDER BY d2, id) AS rank, id FROM (SELECT a.vec_id AS q, b.vec_id AS id, {_D2} AS d2 FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0) WHERE d2 <= {LIMIT}")
def knn_then_filter(spark, sf_dir):
    """A range join by nearest neighbours, whole however many rows a query has within the limit."""
    v = vectors(spark, sf_dir)
    return joins.ranked_range_join(v.where("id % 100 = 0"), v, 8, LIMIT).select("q", F.col("rank").cast("long").alias("rank"), "id")


@query(f"SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.vec_id <= b.vec_id WHERE {_SUM.format(a='a', b='b', f='abs(z[1]::DOUBLE - z[2]::DOUBLE)')} <= 7.0")
def l1_join(spark, sf_dir):
    return upper(spark, sf_dir, 7.0, metric="l1")


@query(f"SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.vec_id <= b.vec_id WHERE list_max(list_transform({_Z.format(a='a', b='b')}, lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))) <= 0.35")
def linf_join(spark, sf_dir):
    return upper(spark, sf_dir, 0.35, metric="linf")


@query(f"SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.vec_id <= b.vec_id WHERE 1 - {_SUM.format(a='a', b='b', f='z[1]::DOUBLE * z[2]::DOUBLE')} / (sqrt({_SUM.format(a='a', b='a', f='z[1]::DOUBLE * z[2]::DOUBLE')}) * sqrt({_SUM.format(a='b', b='b', f='z[1]::DOUBLE * z[2]::DOUBLE')})) <= 0.7")
def cosine_join(spark, sf_dir):
    return upper(spark, sf_dir, 0.7, metric="cosine")


@query("WITH w AS (SELECT DISTINCT p_name AS w FROM part) SELECT x.w AS a, y.w AS b FROM w x JOIN w y ON x.w <= y.w WHERE levenshtein(x.w, y.w) <= 4")
def edit_distance_join(spark, sf_dir):
    return joins.edit_distance_join(table(spark, sf_dir, "part"), "p_name", 4)


_STRICT = _ALL.replace("<= b.vec_id", "< b.vec_id")


@query(f"{_STRICT}, g AS (SELECT d2, sum(count(*)) OVER (ORDER BY d2) AS upto, lead(d2) OVER (ORDER BY d2) AS nxt FROM d GROUP BY d2) SELECT round((d2 + nxt) / 2, 9) AS threshold, upto::BIGINT AS pairs FROM g WHERE upto >= 1000 ORDER BY d2 LIMIT 1")
def midgap_threshold(spark, sf_dir):
    return relations.midgap(vectors(spark, sf_dir), None, 1000).select(F.round("threshold", 9).alias("threshold"), "pairs")


@query(f"{_STRICT} SELECT round(max(d2), 9) AS threshold FROM (SELECT d2 FROM d ORDER BY d2 LIMIT 1000)")
def order_statistic_threshold(spark, sf_dir):
    return relations.order_statistic(vectors(spark, sf_dir), None, 1000).select(F.round("threshold", 9).alias("threshold"))


@query(f"{_ALL} SELECT t.threshold, count(*) AS pairs FROM d JOIN (VALUES (1.25), (1.3), (1.35), (1.4)) AS t(threshold) ON d2 <= t.threshold GROUP BY 1".replace("VALUES (1.25), (1.3), (1.35), (1.4)", "VALUES (1.25::DOUBLE), (1.3::DOUBLE), (1.35::DOUBLE), (1.4::DOUBLE)"))
def threshold_sweep(spark, sf_dir):
    """Pairs once at the largest limit, smaller limits by a filter."""
    found = tiles.pairs_within(vectors(spark, sf_dir), None, 1.4, distances=True)
    limits = F.explode(F.array(*[F.lit(x) for x in (1.25, 1.3, 1.35, 1.4)]))
    return found.select("d", limits.alias("threshold")).where("d <= threshold").groupBy("threshold").agg(F.count(F.lit(1)).alias("pairs"))


@query(f"{_ALL} SELECT i, j FROM d WHERE i < j ORDER BY abs(d2 - {LIMIT}), i, j LIMIT 20")
def topk_closest_to_threshold(spark, sf_dir):
    found = tiles.pairs_within(vectors(spark, sf_dir), None, 1.5, distances=True).where("i < j")
    return found.orderBy(F.abs(F.col("d") - LIMIT), "i", "j").limit(20).select("i", "j")


@query("""WITH q AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) / 127 AS scale FROM embeddings)
SELECT vec_id AS id, array_to_string(list_transform(embedding, lambda x: round_even(x::DOUBLE / scale, 0)::INTEGER), ',') AS codes FROM q""")
def quantise_codes(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("s", M.quantisation_scale("vec"))
    return v.select("id", F.array_join(M.quantised("vec", F.col("s")).cast("array<string>"), ",").alias("codes"))


@query("""WITH f AS (SELECT unnest(embedding)::DOUBLE AS v, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings)
SELECT (k - 1)::BIGINT AS dim, row_number() OVER (ORDER BY round(var_pop(v), 12) DESC, k) AS place FROM f GROUP BY k""")
def dim_variance_order(spark, sf_dir):
    flat = vectors(spark, sf_dir).select(F.posexplode("vec").alias("k", "v")).groupBy("k").agg(F.round(F.var_pop(F.col("v").cast("double")), 12).alias("s"))
    place = F.row_number().over(Window.orderBy(F.desc("s"), "k"))  # one row a dimension
    return flat.select(F.col("k").cast("long").alias("dim"), place.cast("long").alias("place"))


_PART_D2 = "((a.p_size - b.p_size)::DOUBLE * (a.p_size - b.p_size)::DOUBLE + (a.p_retailprice - b.p_retailprice) * (a.p_retailprice - b.p_retailprice))"
_POINTS = "part a JOIN part b ON a.p_partkey <= b.p_partkey"


@query(f"SELECT a.p_partkey AS i, b.p_partkey AS j FROM {_POINTS} WHERE (a.p_size - b.p_size) * (a.p_size - b.p_size) + (a.p_retailprice - b.p_retailprice) * (a.p_retailprice - b.p_retailprice) <= 9.0")
def grid_join(spark, sf_dir):
    return joins.grid_join(table(spark, sf_dir, "part"), "p_partkey", ["p_size", "p_retailprice"], 3.0)


@query(f"SELECT a.p_partkey AS i, b.p_partkey AS j FROM {_POINTS} WHERE b.p_retailprice BETWEEN a.p_retailprice - 2 AND a.p_retailprice + 2 AND b.p_size BETWEEN a.p_size - 1 AND a.p_size + 1")
def band_join(spark, sf_dir):
    return joins.band_join(table(spark, sf_dir, "part"), "p_partkey", {"p_retailprice": 2.0, "p_size": 1.0})


@query("SELECT p_partkey, (floor(p_retailprice / 100) * 60 + floor(p_size / 1))::BIGINT AS cell FROM part")
def linear_cell_id(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", (M.cell(F.col("p_retailprice"), F.lit(0.0), F.lit(100.0)) * 60 + M.cell(F.col("p_size"), F.lit(0.0), F.lit(1.0))).alias("cell"))


@query(f"{_ALL} SELECT i, j FROM p")
def block_prune_join(spark, sf_dir):
    return blocks.block_join(blocks.layout(vectors(spark, sf_dir), "pca_sort"), LIMIT)


@query("SELECT vec_id AS id, ((row_number() OVER (ORDER BY vec_id) - 1) // 64)::BIGINT AS block FROM embeddings")
def block_layout(spark, sf_dir):
    return blocks.layout(vectors(spark, sf_dir), "original").select("id", "block")


@query("""WITH n AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1) // 64 AS block, embedding FROM embeddings), f AS (SELECT block, unnest(embedding)::DOUBLE AS v, unnest(range(1, len(embedding) + 1)) AS k FROM n)
SELECT block::BIGINT AS block, (k - 1)::BIGINT AS dim, min(v) AS low, max(v) AS high FROM f GROUP BY 1, 2""")
def block_boxes(spark, sf_dir):
    made = blocks.summaries(blocks.layout(vectors(spark, sf_dir), "original"))
    return made.select("block", F.posexplode(F.arrays_zip("low", "high")).alias("dim", "b")).select("block", F.col("dim").cast("long").alias("dim"), "b.low", "b.high")


@query("SELECT true AS sound")
def block_pruning_soundness(spark, sf_dir):
    """Whether no pair within the limit lies in a block pair that any bound rules out, in every layout."""
    out = None
    for method in blocks.LAYOUTS:
        points = written(blocks.layout(vectors(spark, sf_dir), method), "layout")
        pruned = blocks.ruled_out(points, LIMIT, "box").unionByName(blocks.ruled_out(points, LIMIT, "ball")).distinct()
        lost = hierarchy.Blocks(points).near_blocks(LIMIT, pruned)  # only what is ruled out is compared
        out = lost if out is None else out.unionByName(lost)
    return out.agg((F.count(F.lit(1)) == 0).alias("sound"))


@query(f"{_ALL} SELECT (i // 64)::BIGINT AS b1, (j // 64)::BIGINT AS b2, count(*) AS pairs FROM p GROUP BY 1, 2")
def block_histogram(spark, sf_dir):
    return blocks.tile_counts(upper(spark, sf_dir))


@query(f"{_ALL} SELECT (i // 128)::BIGINT AS b1, (j // 128)::BIGINT AS b2, count(*)::BIGINT AS pairs FROM p GROUP BY 1, 2")
def block_rollup(spark, sf_dir):
    return blocks.rolled_up(blocks.tile_counts(upper(spark, sf_dir)))


@query(f"{_ALL} SELECT count(DISTINCT (i // 64) * 1000000 + j // 64) AS occupied FROM p")
def tile_occupancy(spark, sf_dir):
    return blocks.tile_counts(upper(spark, sf_dir)).agg(F.count(F.lit(1)).alias("occupied"))


@query(f"SELECT b AS id, arg_min(a, (d2, a)) AS pivot FROM (SELECT a.vec_id AS a, b.vec_id AS b, {_D2} AS d2 FROM embeddings a JOIN embeddings b ON a.vec_id < 8) GROUP BY b".replace("arg_min(a, (d2, a)) AS pivot FROM", "min_by(a, d2) AS pivot FROM"))
def nearest_pivot_assignment(spark, sf_dir):
    v = vectors(spark, sf_dir)
    pivots = [r["vec"] for r in v.where("id < 8").orderBy("id").collect()]
    return blocks.nearest_pivot(v, pivots).select("id", F.col("pivot").cast("long").alias("pivot"))


@query()
def farthest_point_pivots(spark, sf_dir):
    """Sixteen pivots, each farthest from those before it."""
    v = vectors(spark, sf_dir)
    return spark.createDataFrame([(k, [float(x) for x in p]) for k, p in enumerate(blocks.farthest_pivots(v, 16))], "pivot int, vec array<double>")


_TOKENS = "tok AS (SELECT vec_id % 40 AS obj, vec_id AS t, embedding FROM embeddings)"
_CELLS = f"WITH {_TOKENS}, c AS (SELECT a.obj AS q, b.obj AS b, a.t AS qt, b.t AS bt, {_D2} AS d FROM tok a JOIN tok b ON a.obj < 20 AND b.obj >= 20), f AS (SELECT q, b, avg(m) AS f FROM (SELECT q, b, qt, min(d) AS m FROM c GROUP BY ALL) GROUP BY ALL), g AS (SELECT q, b, avg(m) AS g FROM (SELECT q, b, bt, min(d) AS m FROM c GROUP BY ALL) GROUP BY ALL)"


def objects(spark, sf_dir):
    v = vectors(spark, sf_dir).select((F.col("id") % 40).alias("obj"), F.col("id").alias("tok"), "vec")
    return v.where("obj < 20"), v.where("obj >= 20")


@query(f"{_CELLS} SELECT f.q, f.b, round(0.5 * (f + g), 9) AS score FROM f JOIN g ON f.q = g.q AND f.b = g.b")
def chamfer_scores(spark, sf_dir):
    return relations.chamfer(*objects(spark, sf_dir)).select("q", "b", F.round("score", 9).alias("score"))


@query(f"{_CELLS} SELECT f.q, f.b FROM f JOIN g ON f.q = g.q AND f.b = g.b WHERE 0.5 * (f + g) <= 1.6")
def chamfer_join(spark, sf_dir):
    return relations.chamfer_join(*objects(spark, sf_dir), 1.6)


_EDGES = "e AS (SELECT DISTINCT o_custkey AS src, l_partkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
_WITNESS = f"WITH {_EDGES}, p AS (SELECT a.src AS q, b.src AS b, count(*) AS witnesses FROM e a JOIN e b ON a.dst = b.dst AND a.src < b.src GROUP BY 1, 2)"


def edges(spark, sf_dir):
    o, line = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return o.join(line, o["o_orderkey"] == line["l_orderkey"]).select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst"))


@query(f"{_WITNESS} SELECT q, b, witnesses FROM p")
def witness_pairs(spark, sf_dir):
    return relations.witness_pairs(edges(spark, sf_dir))


@query(f"{_WITNESS} SELECT witnesses, count(*) AS pairs FROM p GROUP BY 1")
def witness_multiplicity(spark, sf_dir):
    return relations.witness_pairs(edges(spark, sf_dir)).groupBy("witnesses").agg(F.count(F.lit(1)).alias("pairs"))


_SHARED = f"FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_D2} <= 1.6"


@query(f"SELECT DISTINCT a.vec_id AS q, b.vec_id AS b {_SHARED}")
def factorised_join(spark, sf_dir):
    """All pairs of different rows that share a label and lie within the limit."""
    return relations.factorised_self_join(vectors(spark, sf_dir, F.col("label").alias("w")), 1.6).toDF("q", "b")


@query(f"SELECT DISTINCT a.vec_id AS i, b.vec_id AS j {_SHARED}")
def factorised_self_join(spark, sf_dir):
    return relations.factorised_self_join(vectors(spark, sf_dir, F.col("label").alias("w")), 1.6)


@query(f"{_ALL}, g AS (SELECT i, string_agg(j::VARCHAR, ',' ORDER BY j) AS n FROM s GROUP BY i), h AS (SELECT n, count(*) AS size FROM g GROUP BY n) SELECT size, sum(size)::BIGINT AS rows FROM h GROUP BY size")
def neighborhood_groups(spark, sf_dir):
    return relations.neighbourhood_groups(directed(spark, sf_dir))


@query(f"{_TWO} SELECT i, j FROM p UNION SELECT i, j FROM p3")
def pair_union(spark, sf_dir):
    return upper(spark, sf_dir).union(second(spark, sf_dir)).distinct()


@query(f"{_TWO} SELECT i, j FROM p EXCEPT SELECT i, j FROM p3")
def pair_except(spark, sf_dir):
    return upper(spark, sf_dir).subtract(second(spark, sf_dir))


@query(f"{_TWO} SELECT i, j FROM p INTERSECT SELECT i, j FROM p3")
def pair_intersect(spark, sf_dir):
    return upper(spark, sf_dir).intersect(second(spark, sf_dir))


@query(f"{_TWO} (SELECT i, j FROM p EXCEPT SELECT i, j FROM p3) UNION ALL (SELECT i, j FROM p3 EXCEPT SELECT i, j FROM p)")
def pair_symdiff(spark, sf_dir):
    return relations.symmetric_difference(upper(spark, sf_dir), second(spark, sf_dir))


@query(f"{_TWO} SELECT i, j FROM p3 WHERE i <> j")
def symmetry_violations(spark, sf_dir):
    """Pairs without their reverse, of a set that has one direction only."""
    return relations.symmetry_violations(second(spark, sf_dir))


@query(f"{_TWO} SELECT i, j, 2::BIGINT AS copies FROM (SELECT i, j FROM p INTERSECT SELECT i, j FROM p3)")
def duplicate_pairs(spark, sf_dir):
    return relations.duplicates(upper(spark, sf_dir).union(second(spark, sf_dir)))


@query(f"{_TWO}, c AS (SELECT (SELECT count(*) FROM (SELECT i, j FROM p INTERSECT SELECT i, j FROM p3)) AS tp, (SELECT count(*) FROM p3) AS n, (SELECT count(*) FROM p) AS m) SELECT round(tp / n, 9) AS precision, round(tp / m, 9) AS recall, round(2 * tp / (n + m), 9) AS f1 FROM c")
def pair_f1(spark, sf_dir):
    return relations.f1(second(spark, sf_dir), upper(spark, sf_dir)).select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"{_ALL} SELECT i * (SELECT max(vec_id) + 1 FROM embeddings) + j AS id FROM s")
def packed_pair_id(spark, sf_dir):
    n = table(spark, sf_dir, "embeddings").agg(F.max("vec_id") + 1).first()[0]
    return joins.mirrored(upper(spark, sf_dir)).select(M.packed_pair("i", "j", n).alias("id"))


@query(f"{_ALL} SELECT (SELECT count(*) FROM s) AS pairs, (SELECT count(*) FROM embeddings) AS self_pairs, 0::BIGINT AS repeated, 0::BIGINT AS out_of_range, 0::BIGINT AS one_way")
def pair_validation(spark, sf_dir):
    n = table(spark, sf_dir, "embeddings").agg(F.max("vec_id") + 1).first()[0]
    return relations.validation(directed(spark, sf_dir), n).drop("digest")


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY 1")
def quantile_summary(spark, sf_dir):
    q = lambda p, n: F.round(F.percentile("l_extendedprice", p), 6).alias(n)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(q(0.1, "p10"), q(0.5, "median"), q(0.9, "p90"))


@query("SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean, round(exp(avg(ln(l_extendedprice))), 4) AS geomean FROM lineitem GROUP BY 1")
def geomean_summary(spark, sf_dir):
    x = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(x), 4).alias("mean"), F.round(F.exp(F.avg(F.log(x))), 4).alias("geomean"))


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def lookup_join(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", "r_name")
    c = table(spark, sf_dir, "customer")
    return c.join(named, c["c_nationkey"] == named["n_nationkey"]).select("c_custkey", "n_name", "r_name")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def group_disjoint_split(spark, sf_dir):
    """Rows whose group the other side doesn't have."""
    taken = table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("s_nationkey"))
    return table(spark, sf_dir, "supplier").join(taken, "s_nationkey", "left_anti").select("s_suppkey")


@query(f"WITH d AS (SELECT a.vec_id AS i, b.vec_id AS j, list_zip(a.embedding[1:16], b.embedding[1:16]) AS z FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label = b.label) SELECT i, j FROM d WHERE list_reduce(list_transform(z, lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)), lambda u, v: u + v) <= 0.3")
def projected_scan(spark, sf_dir):
    """Pairs of one label that leading coordinates alone don't rule out. All pairs and bands: progressive_scan."""
    v = vectors(spark, sf_dir, "label").withColumn("vec", F.slice("vec", 1, 16))
    return tiles.pairs_within_groups(v, "label", 0.3).where("i < j")


_BAND = _SUM.replace("list_zip({a}.embedding, {b}.embedding)", "list_zip({a}.embedding[1:%d], {b}.embedding[1:%d])").format(a="a", b="b", f="(z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)")


@query(f"""WITH d AS (SELECT a.vec_id AS i, b.vec_id AS j, {_BAND % (16, 16)} AS d16, {_BAND % (32, 32)} AS d32, {_BAND % (64, 64)} AS d64 FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)
SELECT i, j, t.threshold, (CASE WHEN d64 <= t.threshold THEN 64 WHEN d32 <= t.threshold THEN 32 ELSE 16 END)::INTEGER AS rank FROM d JOIN (VALUES (0.2::DOUBLE), (0.3::DOUBLE)) AS t(threshold) ON d16 <= t.threshold""")
def progressive_scan(spark, sf_dir):
    """All pairs, by the bands 0-16, 16-32 and 32-64: the last rank that each survives, for each threshold."""
    return tiles.progressive(vectors(spark, sf_dir), (16, 32, 64), (0.2, 0.3))


_LOG = "CASE event_type WHEN 'purchase' THEN 'delete' WHEN 'click' THEN 'query' ELSE 'insert' END"
_LIFE = f"""WITH ev AS (SELECT event_id AS seq, {_LOG} AS op, user_id % (SELECT count(*) FROM embeddings) AS id FROM events),
l AS (SELECT -1 AS seq, 'insert' AS op, vec_id AS id FROM embeddings UNION ALL SELECT seq, op, id FROM ev WHERE op <> 'query'),
t AS (SELECT *, lag(op, 1, 'delete') OVER (PARTITION BY id ORDER BY seq) AS was FROM l), u AS (SELECT *, lead(seq) OVER (PARTITION BY id ORDER BY seq) AS dead FROM t WHERE op <> was)"""


def update_log(spark, sf_dir):
    n = table(spark, sf_dir, "embeddings").count()
    kind = F.when(F.col("event_type") == "purchase", "delete").when(F.col("event_type") == "click", "query").otherwise("insert")
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), kind.alias("op"), (F.col("user_id") % n).alias("id"))
    base = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return events, base


@query(f"{_LIFE} SELECT id FROM u WHERE op = 'insert' AND dead IS NULL")
def tombstone_live_ids(spark, sf_dir):
    return updates.live_ids(*update_log(spark, sf_dir))


@query(f"{_LIFE}, near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON {_D2} <= {LIMIT}) SELECT e.seq, count(u.id) AS matches FROM ev e LEFT JOIN near n ON n.a = e.id LEFT JOIN u ON u.id = n.b AND u.op = 'insert' AND u.seq < e.seq AND (u.dead IS NULL OR u.dead > e.seq) WHERE e.op = 'query' GROUP BY 1")
def stream_range_counts(spark, sf_dir):
    """For each query event, live rows within the limit of its vector: near pairs are found once, then joined in time."""
    events, base = update_log(spark, sf_dir)
    life = updates.lifetimes(events, base).select(F.col("id").alias("j"), "born", "dead")
    near = directed(spark, sf_dir)
    asked = events.where("op = 'query'").select("seq", F.col("id").alias("i"))
    hits = asked.join(near, "i", "left").join(life, "j", "left")
    live = (F.col("born") < F.col("seq")) & (F.col("dead").isNull() | (F.col("dead") > F.col("seq")))
    return hits.groupBy("seq").agg(F.count(F.when(live, 1)).alias("matches"))


@query(f"{_LIFE} SELECT row_number() OVER (ORDER BY id) - 1 AS position, id FROM u WHERE op = 'insert' AND dead IS NULL")
def live_positions(spark, sf_dir):
    """Places of the live ids, to which deletes by position refer."""
    return updates.positional(updates.live_ids(*update_log(spark, sf_dir)))


@query(f"{_LIFE}, p AS (SELECT row_number() OVER (ORDER BY id) - 1 AS position, id FROM u WHERE op = 'insert' AND dead IS NULL) SELECT id FROM p WHERE position NOT IN (SELECT l_linenumber * 3 FROM lineitem)")
def positional_deletes(spark, sf_dir):
    """Live ids after deletes by position."""
    live = written(updates.live_ids(*update_log(spark, sf_dir)), "live")
    return updates.delete_positions(live, table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") * 3).cast("long").alias("position")))


_DOT = _SUM.replace("{f}", "z[1]::DOUBLE * z[2]::DOUBLE")
_NORM = "sqrt(" + _DOT.replace("{b}", "{a}") + ")"


@query(f"SELECT a.vec_id AS i, round(degrees(acos(greatest(-1, least(1, {_DOT.format(a='a', b='b')} / ({_NORM.format(a='a')} * {_NORM.format(a='b')}))))), 6) AS angle FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def angle_to_next(spark, sf_dir):
    """Degrees between each vector and the next."""
    v = vectors(spark, sf_dir)
    other = v.select((F.col("id") - 1).alias("id"), F.col("vec").alias("next"))
    return v.join(other, "id").select(F.col("id").alias("i"), F.round(M.angle("vec", "next"), 6).alias("angle"))


@query(f"SELECT a.vec_id AS i, (generate_subscripts(a.embedding, 1) - 1)::BIGINT AS dim, round(unnest(a.embedding)::DOUBLE / {_NORM.format(a='a')}, 9) AS value FROM embeddings a")
def unit_vectors(spark, sf_dir):
    v = vectors(spark, sf_dir).select(F.col("id").alias("i"), F.posexplode(M.normalised("vec")).alias("dim", "value"))
    return v.select("i", F.col("dim").cast("long").alias("dim"), F.round("value", 9).alias("value"))


@query("SELECT p_partkey, list_sum(list_transform(range(10), lambda b: (((p_size >> b) & 1) << (3 * b)) + ((((p_partkey % 1024) >> b) & 1) << (3 * b + 1)) + ((((floor(p_retailprice)::BIGINT % 1024) >> b) & 1) << (3 * b + 2))))::BIGINT AS code FROM part")
def morton_codes(spark, sf_dir):
    """Interleaved bits of three numbers of each part."""
    price = F.floor("p_retailprice").cast("long") % 1024
    return table(spark, sf_dir, "part").select("p_partkey", M.morton3(F.col("p_size"), F.col("p_partkey") % 1024, price).alias("code"))


@query("SELECT a.p_partkey, ((a.p_size - b.p_size)::BIGINT * (a.p_size - b.p_size) + (round(a.p_retailprice * 100)::BIGINT - round(b.p_retailprice * 100)::BIGINT) * (round(a.p_retailprice * 100)::BIGINT - round(b.p_retailprice * 100)::BIGINT))::BIGINT AS d2 FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def integer_distances(spark, sf_dir):
    """Exact squared distances of whole-number vectors, from each part to the next."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_size").cast("long"), F.round(F.col("p_retailprice") * 100).cast("long")).alias("v"))
    other = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("v").alias("w"))
    return p.join(other, "p_partkey").select("p_partkey", M.integer_squared_l2("v", "w").alias("d2"))


@query("WITH f AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings) SELECT (a.k - 1)::BIGINT AS row, (b.k - 1)::BIGINT AS col, round(covar_pop(a.v, b.v), 9) AS covariance FROM f a JOIN f b USING (vec_id) GROUP BY 1, 2")
def covariance_matrix(spark, sf_dir):
    """The covariance of all coordinates: partial sums on the executors, one small matrix in the end."""
    _, c, _ = blocks.gram(vectors(spark, sf_dir))
    made = spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(c) for j, v in enumerate(r)], "row long, col long, covariance double")
    return made.select("row", "col", F.round("covariance", 9).alias("covariance"))


@query("SELECT p_partkey FROM part ORDER BY p_retailprice, p_partkey LIMIT (SELECT ceil(count(*) * 0.1)::BIGINT FROM part)")
def budget_selection(spark, sf_dir):
    """The best tenth by score, ties by id."""
    scored = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    return relations.budget(scored, 0.1).select(F.col("id").alias("p_partkey"))


@query(f"{_STRICT}, n AS (SELECT count(*) AS n FROM embeddings), k AS (SELECT d2, row_number() OVER (ORDER BY d2) AS r FROM d) SELECT round(d2, 9) AS threshold FROM k, n WHERE r = (n * 3 + 1) // 2")
def radius_for_results(spark, sf_dir):
    """The squared distance within which rows have four results on average, itself and both directions counted."""
    v = vectors(spark, sf_dir)
    return relations.order_statistic(v, None, (v.count() * 3 + 1) // 2).select(F.round("threshold", 9).alias("threshold"))


@query("SELECT user_id, count(*) FILTER (WHERE was IS NULL OR event_type <> was) AS runs, bool_and(before IS NULL OR ts >= before) AS in_order FROM (SELECT *, lag(event_type) OVER w AS was, lag(ts) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) GROUP BY 1")
def runs_and_order(spark, sf_dir):
    """Runs of equal events of each user, and whether their times never fall."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", F.lag("event_type").over(w).alias("was"), F.lag("ts").over(w).alias("before"))
    begins = F.col("was").isNull() | (F.col("event_type") != F.col("was"))
    return e.groupBy("user_id").agg(F.count(F.when(begins, 1)).alias("runs"), F.every(F.col("before").isNull() | (F.col("ts") >= F.col("before"))).alias("in_order"))


@query(f"{_TWO}, b AS (SELECT i, j FROM p UNION ALL SELECT i, j FROM p3) SELECT count(*) AS bag, count(DISTINCT i * 1000000 + j) AS pairs FROM b")
def bag_against_set(spark, sf_dir):
    """A bag of pairs has more rows than the set: the negative control of set comparisons."""
    both = upper(spark, sf_dir).union(second(spark, sf_dir)).groupBy("i", "j").count()
    return both.agg(F.sum("count").alias("bag"), F.count(F.lit(1)).alias("pairs"))


# --- balanced layouts and hierarchical bounds


@query(f"{_ALL} SELECT i, j FROM p")
def hierarchy_join(spark, sf_dir):
    """Pairs of a balanced layout, by bounds of all families from coarse blocks to fine ones."""
    return hierarchy.Hierarchy(hierarchy.balanced(vectors(spark, sf_dir), "two_means")).join(LIMIT)


@query(f"SELECT a.p_partkey AS i, b.p_partkey AS j FROM part a JOIN part b ON a.p_partkey <= b.p_partkey WHERE {_PART_D2} <= 9.0")
def hierarchy_part_join(spark, sf_dir):
    """All parts, in k-d blocks, where most pairs of blocks are never looked at."""
    return joins.by_points(part_points(spark, sf_dir), lambda p: hierarchy.Hierarchy(hierarchy.balanced(p, "kd"), ("box", "pivots")).join(9.0))


@query("SELECT size, count(*) AS blocks FROM (SELECT count(*) AS size FROM (SELECT (row_number() OVER (ORDER BY p_partkey) - 1) // 64 AS block FROM part) GROUP BY block) GROUP BY size")
def balanced_block_sizes(spark, sf_dir):
    """Blocks of each size that the k-d layout makes: all full but the last."""
    sizes = hierarchy.balanced(part_points(spark, sf_dir), "kd").groupBy("block").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("blocks"))


@query()
def hierarchy_levels(spark, sf_dir):
    """Pairs of blocks that each level of hierarchy_part_join looks at and keeps."""
    return hierarchy.Hierarchy(hierarchy.balanced(part_points(spark, sf_dir), "kd"), ("box", "pivots")).pairs(9.0)[1]


@query("SELECT true AS sound, true AS not_less_than_boxes")
def hierarchy_soundness(spark, sf_dir):
    """Whether no layout's hierarchy rules out a pair within the limit, and all families together prune no less than boxes."""
    v, out = vectors(spark, sf_dir), None
    for method in hierarchy.BALANCED:
        points = written(hierarchy.balanced(v, method), "layout")
        every, boxes = hierarchy.Hierarchy(points), hierarchy.Hierarchy(points, ("box",))
        kept = every.pairs(LIMIT)[0]
        lost = every.lost(LIMIT, kept).agg(F.count(F.lit(1)).alias("lost"))
        one = lost.crossJoin(every.pruned(LIMIT, kept).toDF("all_")).crossJoin(boxes.pruned(LIMIT).toDF("box"))  # one row each
        out = one if out is None else out.unionByName(one)
    return out.agg((F.sum("lost") == 0).alias("sound"), F.every(F.col("all_") >= F.col("box")).alias("not_less_than_boxes"))


# --- streams


@query(f"{_LIFE}, near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON {_D2} <= {LIMIT}) SELECT e.seq, count(u.id) AS matches FROM ev e LEFT JOIN near n ON n.a = e.id LEFT JOIN u ON u.id = n.b AND u.op = 'insert' AND u.seq < e.seq AND (u.dead IS NULL OR u.dead > e.seq) WHERE e.op = 'query' GROUP BY 1")
def live_stream_counts(spark, sf_dir):
    """stream_range_counts by a stateful stream: base rows and inserts arrive with their vectors, in three parts of events."""
    events, base = update_log(spark, sf_dir)
    v = vectors(spark, sf_dir)
    log = events.unionByName(base.select(F.lit(-1).cast("long").alias("seq"), F.lit("insert").alias("op"), "id"))
    brought = F.when(F.col("op") != "delete", F.col("vec").cast("array<double>"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    log = log.join(v, "id").select("seq", "op", "id", brought.alias("vec"))
    log = written(log.repartition(parts, "id").sortWithinPartitions("id", "seq"), "live-log")
    folder, shards = place(spark, "live-stream"), max(4, -(-v.count() // 8192))  # of bounded size
    last = events.agg(F.max("seq")).first()[0] or 0
    for k in range(3):  # what is new each time is a micro-batch
        log.where(f"seq >= {-1 if k == 0 else k * last // 3 + 1} AND seq <= {(k + 1) * last // 3}").write.mode("append").parquet(f"{folder}/events")
        stream = spark.readStream.schema("seq long, op string, id long, vec array<double>").parquet(f"{folder}/events")
        counts = updates.run_live_counts(stream, folder, LIMIT, shards)
    return counts


# --- sampled calibration, estimates, hubs


@query()
def sampled_calibration(spark, sf_dir):
    """A threshold on the grid for 1000 pairs, from 2^20 sampled pairs, with the bound of its error."""
    return sampling.sampled_threshold(vectors(spark, sf_dir), 1000, 1 << 20)


@query(f"{_CELLS}, r AS (SELECT 0.5 * (f + g) AS s, row_number() OVER (ORDER BY 0.5 * (f + g)) AS k FROM f JOIN g ON f.q = g.q AND f.b = g.b) SELECT round(avg(s), 9) AS threshold FROM r WHERE k IN (50, 51)")
def chamfer_gap(spark, sf_dir):
    """Midway between the fiftieth smallest Chamfer score and the next."""
    return sampling.strict_score_gap(relations.chamfer(*objects(spark, sf_dir)), 50).select(F.round("threshold", 9).alias("threshold"))


@query(f"WITH p AS (SELECT count(*) AS k FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 WHERE {_D2} <= {LIMIT}), q AS (SELECT count(*) AS n, count(*) FILTER (WHERE vec_id % 100 = 0) AS s FROM embeddings) SELECT s AS sampled, k AS sampled_pairs, ceil(k * n / s)::BIGINT AS estimated_pairs, greatest(1, ceil(ceil(k * n / s) / 1000))::BIGINT AS batches FROM p, q")
def batch_estimate(spark, sf_dir):
    """Pairs of all vectors and batches of a thousand, estimated from every hundredth vector."""
    v = vectors(spark, sf_dir)
    return sampling.batch_estimate(v, LIMIT, v.where("id % 100 = 0"), 1000)


@query(f"{_WITNESS} SELECT q, b, witnesses FROM p")
def witness_rectangles(spark, sf_dir):
    """witness_pairs by rectangles of runs, so that a hub is many tasks."""
    return witnesses.witness_counts(edges(spark, sf_dir))


@query("WITH e AS (SELECT o_custkey AS src, l_suppkey % 5 AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey) SELECT a.src AS q, b.src AS b, sum(a.n * b.n)::BIGINT AS witnesses FROM (SELECT src, dst, count(*) AS n FROM e GROUP BY ALL) a JOIN (SELECT src, dst, count(*) AS n FROM e GROUP BY ALL) b ON a.dst = b.dst AND a.src < b.src GROUP BY 1, 2")
def witness_bag_of_hubs(spark, sf_dir):
    """The bag of customers' common suppliers in five groups: each is a hub of nearly all customers."""
    o, line = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    e = o.join(line, o["o_orderkey"] == line["l_orderkey"]).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") % 5).alias("dst"))
    return witnesses.witness_counts(e, bag=True)


# --- files


@query("SELECT i, list_extract(embedding, 1) AS first, list_extract(embedding, len(embedding)) AS last FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, embedding FROM embeddings)")
def fvecs_round_trip(spark, sf_dir):
    """All vectors written as fvecs, one file a range, and read again by byte ranges."""
    path = place(spark, "fvecs")
    binary.write_vectors(vectors(spark, sf_dir), path)
    return binary.read_vectors(spark, path, "fvecs", range_bytes=1 << 14).select(F.col("id").alias("i"), F.get("vec", F.lit(0)).alias("first"), F.element_at("vec", -1).alias("last"))


@query("SELECT i, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) > 0 AS positive FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, embedding FROM embeddings) WHERE i BETWEEN 100 AND 299 AND i % 3 = 0")
def raw_file_pushdown(spark, sf_dir):
    """Vectors written as doubles; a range of ids is read, and nothing else of the files."""
    path = place(spark, "raw")
    binary.write_vectors(vectors(spark, sf_dir), path, "f8")
    rows = binary.read_vectors(spark, path, "f8", dimension=64, element="double").where("id >= 100 AND id < 300 AND id % 3 = 0")
    return rows.select(F.col("id").alias("i"), (F.aggregate("vec", F.lit(0.0), lambda t, x: t + x) > 0).alias("positive"))


@query(f"{_ALL}, k AS (SELECT i * (SELECT max(vec_id) + 1 FROM embeddings) + j AS value FROM s) SELECT row_number() OVER (ORDER BY value) - 1 AS id, value FROM k")
def pair_file_round_trip(spark, sf_dir):
    """Packed directed pairs in order, as 64-bit integers in one file a range, read again by their places."""
    n, path = table(spark, sf_dir, "embeddings").agg(F.max("vec_id") + 1).first()[0], place(spark, "pairs-u64")
    binary.write_numbers(directed(spark, sf_dir).select(M.packed_pair("i", "j", n).alias("value")), path)
    return binary.read_vectors(spark, path, "u64")


@query(f"""{_ALL}, n AS (SELECT i, j, row_number() OVER (ORDER BY i, j) - 1 AS n FROM s), c AS (SELECT n // 1024 AS m, sha256(string_agg(i || ',' || j, chr(10) ORDER BY n)) AS t FROM n GROUP BY 1)
SELECT (SELECT count(*) FROM n) AS rows, CASE WHEN count(*) = 1 THEN max(t) ELSE sha256(string_agg(t, chr(10) ORDER BY m)) END AS digest FROM c""")
def pair_digest(spark, sf_dir):
    """The digest of the directed pairs in order: of chunks, and of the chunks' digests."""
    return relations.ordered_digest(directed(spark, sf_dir), ["i", "j"])


# --- window joins


_BAND_PAIRS = f"FROM {_POINTS} WHERE b.p_retailprice BETWEEN a.p_retailprice - 2 AND a.p_retailprice + 2 AND b.p_size BETWEEN a.p_size - 1 AND a.p_size + 1"


@query(f"SELECT a.p_partkey AS i, b.p_partkey AS j {_BAND_PAIRS}")
def sweep_band_join(spark, sf_dir):
    """band_join by runs of sorted prices and binary search."""
    return windows.sweep_join(table(spark, sf_dir, "part"), "p_partkey", {"p_retailprice": 2.0, "p_size": 1.0})


@query(f"SELECT a.p_partkey AS i, b.p_partkey AS j FROM {_POINTS} WHERE b.p_size = a.p_size AND b.p_retailprice BETWEEN a.p_retailprice - 50 AND a.p_retailprice + 50")
def sweep_hot_join(spark, sf_dir):
    """Parts of one size and near prices: the swept column has few values, each in many rows."""
    return windows.sweep_join(table(spark, sf_dir, "part"), "p_partkey", {"p_size": 0.0, "p_retailprice": 50.0}, rows=128)


@query(f"SELECT a.o_orderkey AS i, b.o_orderkey AS j FROM orders a JOIN orders b ON a.o_orderkey <= b.o_orderkey AND b.o_custkey BETWEEN a.o_custkey - 3 AND a.o_custkey + 3 AND b.o_totalprice BETWEEN a.o_totalprice - 2000 AND a.o_totalprice + 2000 AND epoch(b.o_orderdate) / 86400 BETWEEN epoch(a.o_orderdate) / 86400 - 400 AND epoch(a.o_orderdate) / 86400 + 400")
def tree_window_join(spark, sf_dir):
    """Orders near each other in customer, price and date, by a tree of boxes."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", (F.unix_timestamp("o_orderdate") / 86400).alias("day"))
    return windows.tree_window_join(o, "o_orderkey", {"o_custkey": 3.0, "o_totalprice": 2000.0, "day": 400.0})


@query()
def sweep_run_copies(spark, sf_dir):
    """Runs of sweep_band_join, and how many each meets."""
    return windows.sweep_copies(table(spark, sf_dir, "part"), "p_partkey", {"p_retailprice": 2.0, "p_size": 1.0}, rows=256)


# --- multi-vector objects by intervals


@query(f"{_CELLS} SELECT f.q, f.b FROM f JOIN g ON f.q = g.q AND f.b = g.b WHERE 0.5 * (f + g) <= 1.6")
def chamfer_interval_join(spark, sf_dir):
    """chamfer_join by score intervals; only undecided pairs are computed, and of them only competitive cells."""
    return objects_.interval_join(*objects(spark, sf_dir), 1.6)


@query(f"{_CELLS} SELECT f.q, f.b FROM f JOIN g ON f.q = g.q AND f.b = g.b WHERE 0.5 * (f + g) <= 1.55")
def chamfer_half_precision_join(spark, sf_dir):
    return objects_.interval_join(*objects(spark, sf_dir), 1.55, "half")


@query()
def chamfer_interval_work(spark, sf_dir):
    """How many pairs the intervals decide, and the share of cells whose distance is computed."""
    return objects_.interval_work(*objects(spark, sf_dir), 1.6)


# --- metric tree


def part_points(spark, sf_dir):
    """Size and price of each part as a vector."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("long").alias("id"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")).alias("vec"))




@query(f"SELECT a.vec_id AS q, b.vec_id AS id FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 WHERE {_D2} <= {LIMIT}")
def tree_range(spark, sf_dir):
    """Every hundredth vector asks the tree of all vectors for those within the limit."""
    v = vectors(spark, sf_dir)
    return trees.range_search(trees.build(v), trees.query_blocks(v.where("id % 100 = 0"), LIMIT))


@query(f"SELECT a.p_partkey AS q, b.p_partkey AS id FROM part a JOIN part b ON {_PART_D2} <= 9.0")
def tree_self_range(spark, sf_dir):
    """All parts ask the tree of all parts, in which parts of equal size and price are one."""

    def found(points: DataFrame) -> DataFrame:
        tree = trees.build(points)
        return trees.range_search(tree, trees.own_blocks(tree, 9.0)).where("q <= id").toDF("i", "j")

    return joins.mirrored(joins.by_points(part_points(spark, sf_dir), found)).toDF("q", "id")


@query(f"SELECT a.p_partkey AS q, (row_number() OVER w)::BIGINT AS rank, b.p_partkey AS id FROM part a, part b WINDOW w AS (PARTITION BY a.p_partkey ORDER BY {_PART_D2}, b.p_partkey) QUALIFY row_number() OVER w <= 5")
def tree_nearest(spark, sf_dir):
    """The five nearest of each part, by the tree."""
    tree = trees.build(part_points(spark, sf_dir))
    found = trees.nearest_search(tree, trees.own_blocks(tree, float("inf")), 5)
    return found.select("q", F.col("rank").cast("long").alias("rank"), "id")


@query("""WITH RECURSIVE t(size) AS (SELECT count(*) FROM part UNION ALL
SELECT ((c + 1) * size + 9) // 10 - (c * size + 9) // 10 FROM t JOIN (SELECT unnest(range(10)) AS c) ON size > 64)
SELECT size::BIGINT AS size, count(*) AS leaves FROM t WHERE size BETWEEN 1 AND 64 GROUP BY 1""")
def tree_leaf_sizes(spark, sf_dir):
    """How many leaves of each size the equal splits of the tree make."""
    return trees.build(part_points(spark, sf_dir)).leaves.groupBy(F.col("n").cast("long").alias("size")).agg(F.count(F.lit(1)).alias("leaves"))


@query()
def tree_work(spark, sf_dir):
    """Distances that tree_self_range computes, and their share of all pairs."""
    tree = trees.build(part_points(spark, sf_dir))
    return trees.work(tree, trees.own_blocks(tree, 9.0))


# --- certificates in few bits


@query(f"{_ALL} SELECT i, j FROM p")
def two_limb_join(spark, sf_dir):
    """Pairs by exact inner products of two-limb integers, undecided ones by the folded distance."""
    return certificates.certificate_join(vectors(spark, sf_dir), None, LIMIT, "two_limb")


@query(f"{_ALL} SELECT i, j FROM p")
def half_precision_join(spark, sf_dir):
    return certificates.certificate_join(vectors(spark, sf_dir), None, LIMIT, "half")


@query(f"{_ALL} SELECT i, j FROM p")
def two_sided_join(spark, sf_dir):
    """Pairs by single precision between two rational cutoffs."""
    return certificates.certificate_join(vectors(spark, sf_dir), None, LIMIT, "two_sided")


@query(f"SELECT a.vec_id AS q, b.vec_id AS id FROM embeddings a JOIN embeddings b ON a.label % 2 = 0 AND b.label % 2 = 1 WHERE {_D2} <= {LIMIT}")
def two_limb_rs_join(spark, sf_dir):
    v = vectors(spark, sf_dir, "label")
    left, right = (v.where(f"label % 2 = {k}").select("id", "vec") for k in (0, 1))
    return certificates.certificate_join(left, right, LIMIT, "two_limb").toDF("q", "id")


@query()
def certificate_states(spark, sf_dir):
    """Pairs that each certificate accepts (1), rejects (0) and leaves undecided (2)."""
    out = None
    for kind in certificates.KINDS:
        one = certificates.certificate_counts(vectors(spark, sf_dir), LIMIT, kind).select(F.lit(kind).alias("kind"), "state", "pairs")
        out = one if out is None else out.unionByName(one)
    return out


_CODES = """WITH m AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS top FROM embeddings), p AS (SELECT *, (floor(log2(top)) - 13)::INTEGER AS e FROM m),
e AS (SELECT vec_id, embedding, CASE WHEN round_even(top / pow(2.0, e), 0) > 16319 THEN e + 1 ELSE e END AS exponent FROM p),
c AS (SELECT vec_id, exponent, list_transform(embedding, lambda x: round_even(x::DOUBLE / pow(2.0, exponent), 0)::BIGINT) AS code FROM e)"""


def two_limbs(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("exponent", certificates.code_exponent("vec"))
    return v.select("id", "exponent", certificates.codes("vec", F.col("exponent")).alias("code"))


@query(f"""{_CODES} SELECT vec_id AS id, exponent, array_to_string(list_transform(code, lambda q: floor((q + 64) / 128)::BIGINT), ',') AS high,
array_to_string(list_transform(code, lambda q: q - 128 * floor((q + 64) / 128)::BIGINT), ',') AS low FROM c""")
def two_limb_codes(spark, sf_dir):
    """Exponent and limbs of each vector's 15-bit integers."""
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return two_limbs(spark, sf_dir).select("id", "exponent", text(certificates.high_limbs("code")).alias("high"), text(certificates.low_limbs("code")).alias("low"))


@query(f"{_CODES} SELECT a.vec_id AS i, list_sum(list_transform(list_zip(a.code, b.code), lambda z: z[1] * z[2]))::BIGINT AS dot FROM c a JOIN c b ON b.vec_id = a.vec_id + 1")
def two_limb_dots(spark, sf_dir):
    """Exact inner products of the codes, limb by limb, of each vector and the next."""
    v = two_limbs(spark, sf_dir).select("id", certificates.high_limbs("code").alias("h"), certificates.low_limbs("code").alias("l"))
    other = v.select((F.col("id") - 1).alias("id"), F.col("h").alias("oh"), F.col("l").alias("ol"))
    sums = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda t, x: t + x)
    dot = 16384 * sums("h", "oh") + 128 * (sums("h", "ol") + sums("l", "oh")) + sums("l", "ol")
    return v.join(other, "id").select(F.col("id").alias("i"), dot.alias("dot"))
