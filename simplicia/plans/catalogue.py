"""Queries over the tables, and DuckDB SQL with the same results.

Shares and scores are rounded to six digits on both sides, so that sums in
another order agree.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simplicia.functions import columns as C
from simplicia.operators import complexes, eigen, hodge, pairs, reports, sampling, spectral, triplets
from simplicia.plans import fixtures as X
from simplicia.plans.register import ORACLE_SQL, QUERIES, query, rounded  # noqa: F401
from simplicia.sources import writers
from simplicia.streaming import log as stream
from simplicia.tables import read, shared_dir, written

_COUNTS = ("i", "j", "k", "total_count", "odd_i_count", "odd_j_count", "odd_k_count")


@query(f"{X.SLATES_SQL} SELECT i, j, k, total_count, odd_i_count, odd_j_count, odd_k_count FROM counts")
def slate_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triplets.slate_counts(X.slates(spark, sf_dir))


@query(f"{X.TRI_SQL} SELECT i, j, k, total_count, round(p_i, 6) AS p_i, round(p_j, 6) AS p_j, round(p_k, 6) AS p_k, round(shannon_entropy, 6) + 0.0 AS shannon_entropy, round(agreement, 6) + 0.0 AS agreement FROM tri")
def triangle_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.slate_triangles(spark, sf_dir), "p_i", "p_j", "p_k", "shannon_entropy", "agreement").select("i", "j", "k", "total_count", "p_i", "p_j", "p_k", "shannon_entropy", "agreement")


@query(f"{X.TRI_SQL} SELECT i, j, k, total_count, odd_i_count, odd_j_count, odd_k_count FROM tri WHERE total_count >= 20 AND agreement BETWEEN 0.1 AND 0.9")
def triangles_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    tri = triplets.triangles(triplets.slate_counts(X.slates(spark, sf_dir)), clamp=False, min_total=20)
    return complexes.filtered(tri, agreement=(0.1, 0.9)).select(*_COUNTS)


@query(f"{X.SLATES_SQL} SELECT i, j, k, total_count FROM counts WHERE i = 11 OR j = 11 OR k = 11")
def focus_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complexes.focus(triplets.slate_counts(X.slates(spark, sf_dir)), 11).select("i", "j", "k", "total_count")


@query("""
WITH items AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS item, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey, l_suppkey) AS bought FROM lineitem),
combos AS (
  SELECT x.item AS i, y.item AS j, z.item AS k, x.bought AS bi, y.bought AS bj, z.bought AS bk, CASE WHEN x.bought + y.bought + z.bought = 1 THEN 1 ELSE 0 END AS flag
  FROM items x JOIN items y ON x.o = y.o AND x.item < y.item JOIN items z ON x.o = z.o AND y.item < z.item WHERE x.bought + y.bought + z.bought IN (1, 2))
SELECT i, j, k, count(*) AS total_count, count(*) FILTER (bi = flag) AS odd_i_count, count(*) FILTER (bj = flag) AS odd_j_count, count(*) FILTER (bk = flag) AS odd_k_count
FROM combos GROUP BY i, j, k""")
def supplier_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triplets.slate_counts(X.slates(spark, sf_dir, "supplier"))


@query(f"{X.CHOICES_SQL} SELECT i, j, k, total_count, odd_i_count, odd_j_count, odd_k_count FROM counts")
def triplet_canonical_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triplets.canonical_counts(X.choices(spark, sf_dir))


@query("SELECT count(*) AS n_rows, count(*) FILTER (l_partkey % 5 = l_suppkey % 5 OR l_partkey % 5 = l_linenumber % 5 OR l_suppkey % 5 = l_linenumber % 5 OR l_linenumber % 4 = 0) AS n_rejected FROM lineitem")
def triplet_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 5).alias("a"), (F.col("l_suppkey") % 5).alias("b"), (F.col("l_linenumber") % 5).cast("long").alias("c"), (F.col("l_linenumber") % 4).alias("choice"))
    return triplets.rejected(rows)


@query(f"{X.TRI_SQL} SELECT count(*) AS n_triangles, count(*) FILTER (abs(p_i + p_j + p_k - 1) > 1e-5) AS bad_sums, count(*) FILTER (NOT (i < j AND j < k)) AS bad_order FROM tri")
def triangle_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triplets.violations(X.slate_triangles(spark, sf_dir))


@query(f"{X.SOFT_SQL} SELECT i, j, k, total_count, round(p_i, 6) AS p_i, round(p_j, 6) AS p_j, round(p_k, 6) AS p_k FROM tri")
def soft_triplets_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    tri = triplets.soft_triangles(X.soft_triples(spark, sf_dir))
    return rounded(tri, "p_i", "p_j", "p_k").select("i", "j", "k", "total_count", "p_i", "p_j", "p_k")


@query(f"{X.TRI_SQL} SELECT a, b, round(sum(total_count * excluded) / sum(total_count), 6) AS similarity, count(*) AS n_triangles FROM slots GROUP BY a, b")
def edge_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(complexes.edges(X.slate_triangles(spark, sf_dir)), "similarity")


_NODES_SQL = f"""{X.TRI_SQL},
ends AS (SELECT i AS id, p_i AS p FROM tri UNION ALL SELECT j, p_j FROM tri UNION ALL SELECT k, p_k FROM tri),
stats AS (SELECT id, avg(p) AS mu, var_pop(p) AS v, count(*) AS n FROM ends GROUP BY id),
cats AS (
  SELECT *, CASE WHEN n > 1 AND v > 0.1 THEN 'context_dependent' WHEN mu > 0.5 AND v < 0.05 THEN 'consistently_odd' WHEN mu < 0.2 AND v < 0.05 THEN 'consistently_similar' ELSE 'mixed' END AS category
  FROM stats)"""


@query(f"{_NODES_SQL} SELECT id, round(mu, 6) AS mean_oddness, round(v, 6) AS var_oddness, n AS n_triangles, category FROM cats")
def node_oddness_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(complexes.nodes(X.slate_triangles(spark, sf_dir)), "mean_oddness", "var_oddness")


@query(f"{_NODES_SQL} SELECT category, count(*) AS n FROM cats GROUP BY category")
def category_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complexes.nodes(X.slate_triangles(spark, sf_dir)).groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


@query(f"""{X.SOFT_SQL},
ends AS (SELECT i AS id, p_i AS p FROM tri UNION ALL SELECT j, p_j FROM tri UNION ALL SELECT k, p_k FROM tri),
stats AS (SELECT id, avg(p) AS mu, var_pop(p) AS v, count(*) AS n FROM ends GROUP BY id)
SELECT id, round(mu, 6) AS mean_oddness, n AS n_triangles,
       CASE WHEN n > 1 AND v > 0.02 THEN 'context_dependent' WHEN mu > 0.45 AND v < 0.02 THEN 'consistently_odd' WHEN mu < 0.28 AND v < 0.02 THEN 'consistently_similar' ELSE 'mixed' END AS category
FROM stats""")
def soft_node_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = complexes.nodes(triplets.soft_triangles(X.soft_triples(spark, sf_dir)), C.SOFT)
    return rounded(found, "mean_oddness").drop("var_oddness")


@query(f"{X.TRI_SQL} SELECT a, b, i, j, k, sign FROM slots")
def triangle_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complexes.triangle_boundary(X.slate_triangles(spark, sf_dir))


@query(f"{X.TRI_SQL}, e AS (SELECT DISTINCT a, b FROM slots) SELECT a AS node, a, b, 1 AS sign FROM e UNION ALL SELECT b, a, b, -1 FROM e")
def edge_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complexes.edge_boundary(complexes.edges(X.slate_triangles(spark, sf_dir)).select("a", "b"))


@query(f"""{X.TRI_SQL}, one AS (SELECT DISTINCT a AS node, a, b, 1 AS s FROM slots UNION ALL SELECT DISTINCT b, a, b, -1 FROM slots)
SELECT node, i, j, k, CAST(sum(sign * s) AS BIGINT) AS value FROM slots JOIN one USING (a, b) GROUP BY node, i, j, k HAVING sum(sign * s) <> 0""")
def boundary_of_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complexes.boundary_of_boundary(X.slate_triangles(spark, sf_dir))


@query(f"""{X.TRI_SQL}, e AS (SELECT a, b, count(*) AS n FROM slots GROUP BY a, b), c AS (SELECT count(*) AS n FROM slots GROUP BY i, j, k),
one AS (SELECT DISTINCT a AS node, a, b, 1 AS s FROM slots UNION ALL SELECT DISTINCT b, a, b, -1 FROM slots),
wrong AS (SELECT node, i, j, k FROM slots JOIN one USING (a, b) GROUP BY node, i, j, k HAVING sum(sign * s) <> 0)
SELECT (SELECT count(*) FROM tri) AS n_triangles, (SELECT count(*) FILTER (n <> 3) FROM c) AS bad_columns, count(*) AS n_edges, max(n) AS max_triangles_per_edge,
       count(*) FILTER (n >= 2) AS n_shared_edges, (SELECT count(*) FROM wrong) AS bad_products FROM e""")
def boundary_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complexes.boundary_checks(X.slate_triangles(spark, sf_dir))


@query(f"{X.CORRUPTED_SQL} SELECT node, i, j, k, value FROM wrong")
def corrupted_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the boundary of a boundary isn't 0, in a matrix with faults."""
    two = X.corrupted(spark, sf_dir)
    return complexes.products(two, complexes.edge_boundary(two.select("a", "b").distinct()))


@query(f"""{X.CORRUPTED_SQL}, e AS (SELECT a, b, count(*) AS n FROM two GROUP BY a, b), c AS (SELECT count(*) AS n FROM two GROUP BY i, j, k)
SELECT (SELECT count(*) FROM c) AS n_triangles, (SELECT count(*) FILTER (n <> 3) FROM c) AS bad_columns, count(*) AS n_edges, max(n) AS max_triangles_per_edge,
       count(*) FILTER (n >= 2) AS n_shared_edges, (SELECT count(*) FROM wrong) AS bad_products FROM e""")
def corrupted_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complexes.incidence_checks(X.corrupted(spark, sf_dir))


@query(f"{X.TRI_SQL}, e AS (SELECT a, b, count(*) AS n FROM slots GROUP BY a, b) SELECT n AS n_triangles, count(*) AS n_edges FROM e GROUP BY n")
def edge_degree_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complexes.edges(X.slate_triangles(spark, sf_dir)).groupBy("n_triangles").agg(F.count("*").alias("n_edges"))


@query(f"{X.TETS_SQL} SELECT a, b, c, d FROM tets")
def tetrahedra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complexes.tetrahedra(X.slate_triangles(spark, sf_dir))


@query(f"{X.TETS_SQL} SELECT i, j, k, a, b, c, d, sign FROM faces")
def tet_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complexes.tet_boundary(complexes.tetrahedra(X.slate_triangles(spark, sf_dir)))


@query(f"{X.TETS_SQL} SELECT a, b, c, d, round(s3, 6) + 0.0 AS s3 FROM scored")
def tet_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    tri = X.slate_triangles(spark, sf_dir)
    return rounded(complexes.tet_scores(tri, complexes.tetrahedra(tri)), "s3")


def _brand_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(X.slate_triangles(spark, sf_dir), "triangles")


@query(f"""{X.CLOSED_SQL}
SELECT (SELECT count(*) FROM tri) AS n_triangles, round(sum(s2_hat * s2_hat) / sum(s2 * s2), 6) AS gradient,
       round((SELECT sum(s3 * s3) FROM scored) / (SELECT n FROM size) / sum(s2 * s2), 6) AS curl, 0.0 AS harmonic, round(sqrt(sum(s2_hat * s2_hat) / sum(s2 * s2)), 6) AS rankability
FROM hats""")
def hodge_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL is the closed form of a complete complex, which sf0.01 and sf0.1 have; so is the gradient here, the curl is solved for."""
    return rounded(hodge.triangle_fractions(_brand_triangles(spark, sf_dir)), "gradient", "curl", "harmonic", "rankability")


@query(f"{X.CLOSED_SQL} SELECT a, b, round(s1_star, 6) + 0.0 AS s1_star FROM s1")
def hodge_edge_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hodge.edge_projection(_brand_triangles(spark, sf_dir))[0], "s1_star")


@query(f"{X.CLOSED_SQL} SELECT i, j, k, round(s2_hat, 6) + 0.0 AS s2_hat, round(s2 - s2_hat, 6) + 0.0 AS residual FROM hats")
def hodge_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hodge.edge_projection(_brand_triangles(spark, sf_dir))[1], "s2_hat", "residual").select("i", "j", "k", "s2_hat", "residual")


@query(f"{X.PAIRS_SQL} SELECT pair_id, left_item, right_item, left_score, right_score, gap, true_side, human_side, annotator, CASE WHEN true_side <> 'tie' AND human_side IS NOT NULL THEN CAST(human_side = true_side AS DOUBLE) END AS human_correct FROM pairs")
def pairs_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.supplier_pairs(spark, sf_dir).drop("human_choice")


@query(f"""{X.PAIRS_SQL}
SELECT CASE WHEN gap = 0 THEN '0 (tie)' WHEN gap BETWEEN 1 AND 3 THEN '1-3' WHEN gap BETWEEN 4 AND 7 THEN '4-7' WHEN gap BETWEEN 8 AND 15 THEN '8-15' WHEN gap BETWEEN 16 AND 30 THEN '16-30' WHEN gap BETWEEN 31 AND 200 THEN '31-200' ELSE '31+' END AS label,
       count(*) AS n FROM pairs GROUP BY 1""")
def gap_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.supplier_pairs(spark, sf_dir).groupBy(C.gap_label(F.col("gap")).alias("label")).agg(F.count("*").alias("n"))


@query(f"""{X.PAIRS_SQL}, bins AS (SELECT CASE WHEN gap BETWEEN 1 AND 3 THEN '1-3' WHEN gap BETWEEN 4 AND 7 THEN '4-7' WHEN gap BETWEEN 8 AND 15 THEN '8-15' WHEN gap BETWEEN 16 AND 30 THEN '16-30' WHEN gap BETWEEN 31 AND 200 THEN '31-200' END AS bin FROM pairs)
SELECT bin, least(count(*), 20) AS least_n, (SELECT least(count(*), 100) FROM pairs) AS total FROM bins WHERE bin IS NOT NULL GROUP BY bin""")
def pairs_stratified_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a sample of 100: each bin has its fifth, or all that it holds, at least."""
    picked = written(sampling.stratified(X.supplier_pairs(spark, sf_dir), 100), "stratified")
    total = picked.agg(F.count("*").alias("total"))
    bins = picked.withColumn("bin", C.gap_bin(F.col("gap"))).where("bin IS NOT NULL").groupBy("bin").agg(F.least(F.count("*"), F.lit(20)).alias("least_n"))
    return bins.crossJoin(total)  # one row of totals


def _uv(p: DataFrame) -> DataFrame:
    return p.select(F.col("left_item").cast("long").alias("u"), F.col("right_item").cast("long").alias("v"))


_SAMPLED_SQL = f"""{X.PAIRS_SQL},
keyed AS (
  SELECT *, md5('0|' || pair_id) AS key,
         CASE WHEN gap BETWEEN 1 AND 3 THEN '1-3' WHEN gap BETWEEN 4 AND 7 THEN '4-7' WHEN gap BETWEEN 8 AND 15 THEN '8-15' WHEN gap BETWEEN 16 AND 30 THEN '16-30' WHEN gap BETWEEN 31 AND 200 THEN '31-200' END AS bin
  FROM pairs)"""


@query(f"{_SAMPLED_SQL} SELECT pair_id, gap, true_side, human_side FROM keyed ORDER BY key, pair_id LIMIT 500")
def pairs_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 500 pairs, the same rows in any engine."""
    return sampling.uniform(X.supplier_pairs(spark, sf_dir), 500).select("pair_id", "gap", "true_side", "human_side")


@query(f"""{_SAMPLED_SQL},
strata AS (SELECT * FROM keyed WHERE bin IS NOT NULL QUALIFY row_number() OVER (PARTITION BY bin ORDER BY key, pair_id) <= 20),
more AS (
  SELECT * FROM keyed WHERE pair_id NOT IN (SELECT pair_id FROM strata)
  QUALIFY row_number() OVER (ORDER BY key, pair_id) <= 100 - (SELECT count(*) FROM strata))
SELECT pair_id, gap, bin FROM strata UNION ALL SELECT pair_id, gap, bin FROM more""")
def pairs_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a sample of 100: a fifth from each bin of gaps, as far as it goes, and others."""
    return sampling.stratified(X.supplier_pairs(spark, sf_dir), 100).select("pair_id", "gap", C.gap_bin(F.col("gap")).alias("bin"))


@query(f"""{X.PARTS_SQL} SELECT CAST(a AS VARCHAR) AS u, CAST(b AS VARCHAR) AS v, CASE WHEN substr(md5('0|' || a || '|' || b), 1, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS value FROM pairs""")
def null_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The random control flow on all part pairs that share an order."""
    p = _uv(X.part_pairs(spark, sf_dir))
    return pairs.random_flow(p.select(F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"))).drop("label")


@query("""
WITH items AS (SELECT CAST(n_nationkey AS VARCHAR) AS item FROM nation),
labels AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS l, CAST(s_nationkey AS VARCHAR) AS r, CAST(CASE WHEN (l_orderkey + l_linenumber) % 2 = 0 THEN c_nationkey ELSE s_nationkey END AS VARCHAR) AS choice,
         l_orderkey || '-' || l_linenumber AS annotator
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey),
known AS (
  SELECT least(l, r) AS a, greatest(l, r) AS b, choice, annotator FROM labels
  QUALIFY row_number() OVER (PARTITION BY least(l, r), greatest(l, r) ORDER BY annotator DESC, choice DESC) = 1),
ab AS (SELECT x.item AS a, y.item AS b FROM items x JOIN items y ON x.item < y.item),
kept AS (SELECT * FROM ab QUALIFY row_number() OVER (ORDER BY md5('0|' || a || '|' || b), a, b) <= greatest(3, CAST(floor((SELECT count(*) FROM ab) * 0.75) AS BIGINT)))
SELECT CASE WHEN substr(md5('1|' || a || '|' || b), 1, 1) >= '8' THEN b ELSE a END AS left, CASE WHEN substr(md5('1|' || a || '|' || b), 1, 1) >= '8' THEN a ELSE b END AS right, choice, annotator
FROM kept LEFT JOIN known USING (a, b)""")
def clique_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three quarters of all pairs of nations, judged by the lines that customers of the one bought from suppliers of the other."""
    line = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    line = line.join(read(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    c, s = F.col("c_nationkey").cast("string"), F.col("s_nationkey").cast("string")
    labels = line.select(c.alias("left"), s.alias("right"), F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 2 == 0, c).otherwise(s).alias("choice"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("annotator"))
    items = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("item"))
    return pairs.clique_pairs(items, labels, keep=0.75)


# each pair of pairs that meet is looked up once: the order of the joins is given by the steps
@query(f"""{X.PARTS_SQL},
keys AS MATERIALIZED (SELECT a, b, a * 100000000 + b AS key FROM pairs),
wedges AS MATERIALIZED (SELECT x.a AS u, x.b AS v, y.b AS w, x.a * 100000000 + y.b AS key FROM keys x JOIN keys y ON x.b = y.a)
SELECT u, v, w FROM wedges WHERE key IN (SELECT key FROM keys)""")
def pair_graph_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all parts that share orders: a graph that its data leaves incomplete."""
    return complexes.pair_triangles(_uv(X.part_pairs(spark, sf_dir)))


@query(f"{X.PARTS_SQL} SELECT node, count(*) AS degree FROM (SELECT a AS node FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY node")
def pair_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complexes.degrees(_uv(X.part_pairs(spark, sf_dir)))


@query(f"{X.PAIRS_SQL} SELECT pair_id, presentation FROM tasks WHERE a % 3 <> 0")
def tasks_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = written(X.supplier_pairs(spark, sf_dir), "pairs")
    done = X.judgement_log(spark, sf_dir, of=p).where("cast(left_item as bigint) % 3 = 0")
    todo = pairs.tasks(p)
    return pairs.open_tasks(todo, done).select("pair_id", "presentation")


@query("""
SELECT event_id, CASE event_id % 6 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE CAST(event_id % 2 + 1 AS INTEGER) END AS choice,
       CASE WHEN event_id % 6 IN (0, 1) THEN CAST('0.' || (event_id % 89 + 10) AS DOUBLE) END AS confidence FROM events""")
def reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    choice, confidence = C.parsed_reply(F.col("reply"))
    return X.replies(spark, sf_dir).select("event_id", choice.alias("choice"), confidence.alias("confidence"))


@query(f"""{X.PAIRS_SQL} SELECT "row", pair_id, presentation, model_side, CASE model_side WHEN 'left' THEN left_item WHEN 'right' THEN right_item END AS model_choice, CAST(model_correct AS DOUBLE) AS model_correct, CAST(agrees AS DOUBLE) AS model_agrees_with_human, error FROM log""")
def judgement_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.judgement_log(spark, sf_dir).select("row", "pair_id", "presentation", "model_side", "model_choice", "model_correct", "model_agrees_with_human", "error")


@query(f"""{X.PAIRS_SQL}
SELECT count(*) AS n_judgements, count(DISTINCT pair_id) AS n_pairs, round(avg(model_correct), 6) AS model_accuracy, round(avg(agrees), 6) AS model_human_agreement,
       round(avg(CAST(model_side = 'left' AS INTEGER)), 6) AS model_left_rate, (SELECT round(avg(h), 6) FROM (SELECT pair_id, max(human_correct) AS h FROM log WHERE model_side IS NOT NULL GROUP BY pair_id)) AS human_accuracy
FROM log WHERE model_side IS NOT NULL""")
def accuracy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.accuracy(X.judgement_log(spark, sf_dir)), "model_accuracy", "model_human_agreement", "model_left_rate", "human_accuracy")


@query(f"""{X.SCALED_SQL}, h AS (SELECT bin, pair_id, max(human_correct) AS c FROM log WHERE model_side IS NOT NULL AND human_correct IS NOT NULL AND bin IS NOT NULL GROUP BY 1, 2),
m AS (SELECT bin, count(*) AS n, CAST(sum(model_correct) AS BIGINT) AS n_correct FROM log WHERE model_correct IS NOT NULL AND bin IS NOT NULL GROUP BY 1)
SELECT m.bin, m.n, m.n_correct, g.human_n, g.human_correct FROM m LEFT JOIN (SELECT bin, count(*) AS human_n, CAST(sum(c) AS BIGINT) AS human_correct FROM h GROUP BY 1) g ON m.bin = g.bin""")
def accuracy_by_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores are scaled so that all gaps fall into the bins."""
    return reports.accuracy_by_gap(X.judgement_log(spark, sf_dir, scale=X.GAP_SCALE))


@query(f"""{X.PAIRS_SQL} SELECT count(*) AS n_swap_pairs, count(*) FILTER (x.model_side = y.model_side) AS n_same
FROM log x JOIN log y ON x.pair_id = y.pair_id AND x.swapped = 0 AND y.swapped = 1 WHERE x.model_side IS NOT NULL AND y.model_side IS NOT NULL""")
def order_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.order_consistency(X.judgement_log(spark, sf_dir))


@query(f"{X.PAIRS_SQL} SELECT label, u, v, round(value, 6) + 0.0 AS value FROM flows")
def edge_flow_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairs.flows(X.judgement_log(spark, sf_dir)), "value")


@query(f"""{X.PAIRS_SQL},
full_ AS (
  SELECT p.u, p.v, l.label, coalesce(f.value, 0.0) AS value
  FROM (SELECT least(left_item, right_item) AS u, greatest(left_item, right_item) AS v FROM pairs) p CROSS JOIN (VALUES ('model'), ('human'), ('oracle')) l(label)
  LEFT JOIN flows f ON f.u = p.u AND f.v = p.v AND f.label = l.label),
ends AS (SELECT label, u AS node, -value AS value FROM full_ UNION ALL SELECT label, v, value FROM full_),
div AS (SELECT label, sum(d * d) / count(*) AS g FROM (SELECT label, node, sum(value) AS d FROM ends GROUP BY 1, 2) GROUP BY label),
norm AS (SELECT label, sum(value * value) AS y FROM full_ GROUP BY label)
SELECT label, round(g / y, 6) AS gradient, round(1 - g / y, 6) AS curl, CAST(NULL AS DOUBLE) AS harmonic FROM div JOIN norm USING (label)""")
def hodge_degree1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All judges on the complete graph of supplier pairs, which has no holes; pairs without an answer have flow 0."""
    p = written(X.supplier_pairs(spark, sf_dir), "pairs")
    uv = p.select(F.least("left_item", "right_item").alias("u"), F.greatest("left_item", "right_item").alias("v"))
    found = pairs.flows(X.judgement_log(spark, sf_dir, of=p))
    every = uv.select("u", "v", F.explode(F.array(*map(F.lit, ("model", "human", "oracle")))).alias("label"))
    flow = every.join(found, ["label", "u", "v"], "left").select("label", "u", "v", F.coalesce("value", F.lit(0.0)).alias("value"))
    flow = written(flow.unionByName(pairs.random_flow(uv)), "flows")
    return rounded(hodge.flow_fractions(flow).where("label <> 'null'"), "gradient", "curl", "harmonic")


@query(f"""{X.PAIRS_SQL} SELECT "row", annotator, count(model_correct) OVER w AS n_scored, CAST(coalesce(sum(model_correct) OVER w, 0) AS BIGINT) AS n_correct
FROM log WINDOW w AS (PARTITION BY annotator ORDER BY "row" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.running_accuracy(X.judgement_log(spark, sf_dir), "annotator")


@query(f"""{X.PAIRS_SQL} SELECT "row", count(model_correct) OVER w AS n_scored, CAST(coalesce(sum(model_correct) OVER w, 0) AS BIGINT) AS n_correct
FROM log WINDOW w AS (ORDER BY "row" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_accuracy_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the whole log as one sequence, by sums of its ranges."""
    return reports.running_accuracy(X.judgement_log(spark, sf_dir))


@query(f"""{X.SLATES_SQL}, sizes AS (SELECT o, count(*) AS n FROM items GROUP BY o)
SELECT count(*) AS n_sessions, count(*) FILTER (n < 3) AS n_short, count(*) FILTER (n > 5) AS n_long, max(n) AS longest,
       (SELECT count(*) FROM items x JOIN items y ON x.o = y.o AND x.item < y.item JOIN items z ON x.o = z.o AND y.item < z.item JOIN sizes s ON s.o = x.o
        WHERE s.n <= 5 AND x.bought + y.bought + z.bought IN (1, 2)) AS n_decisive FROM sizes""")
def slate_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that are too short or too long for triangles, and the decisive triangles of the others."""
    slates = X.slates(spark, sf_dir)
    sizes = slates.agg(*(c.alias(name) for name, c in triplets.slate_counters(5).items()))
    decisive = triplets.slate_counts(slates, max_slate=5).agg(F.coalesce(F.sum("total_count"), F.lit(0)).alias("n_decisive"))
    return sizes.crossJoin(decisive)  # one row each


@query(f"""{X.SCALED_SQL}, one AS (
  SELECT 'mock-q4' AS m, 'q4' AS q, CAST(count(*) AS VARCHAR) AS a, CAST(count(error) AS VARCHAR) AS b, format('{{:.2f}}%', 100 * avg(model_correct)) AS c, format('{{:.2f}}%', 100 * avg(human_correct)) AS d,
         format('{{:.2f}}%', 100 * avg(agrees)) AS e, format('{{:.2f}}%', 100 * avg(CASE WHEN model_side = 'left' THEN 1 ELSE 0 END)) AS f, format('{{:.2f}}', median(latency_s)) AS g FROM log)
SELECT unnest(['model', 'quantization', 'judgements recorded', 'errors', 'model accuracy vs true order', 'human accuracy vs true order', 'model agrees with human', 'model left-side rate', 'median latency (s)']) AS metric, unnest([m, q, a, b, c, d, e, f, g]) AS value FROM one
UNION ALL SELECT 'model accuracy, gap ' || bin, format('{{:.2f}}% (n={{}})', 100 * avg(model_correct), count(*)) FROM log WHERE model_correct IS NOT NULL AND bin IS NOT NULL GROUP BY bin""")
def summary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = X.judgement_log(spark, sf_dir, scale=X.GAP_SCALE).withColumn("quantization", C.quantization(F.col("model_name")))
    return reports.summary(log).drop("place")


@query(f"{X.PAIRS_SQL} SELECT count(*) AS n_records, count(DISTINCT pair_id) AS n_pairs, count(error) AS n_errors, round(avg(model_correct), 6) AS model_accuracy FROM log")
def log_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.status(X.judgement_log(spark, sf_dir)), "model_accuracy")


@query("WITH ids AS (SELECT unnest(range(0, (SELECT max(n_nationkey) * 2 + 1 FROM nation))) AS id) SELECT id, replace(coalesce(n_name, '?'), '_', ' ') AS label FROM ids LEFT JOIN nation ON id = n_nationkey * 2")
def concept_labels_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complexes.dense_labels(read(spark, sf_dir, "nation").select((F.col("n_nationkey") * 2).cast("long").alias("id"), F.col("n_name").alias("label")))


@query(f"{X.PAIRS_SQL} SELECT 'mock-q4' AS model_name, count(*) AS n_records, count(model_correct) AS n_scored, CAST(sum(model_correct) AS DOUBLE) AS n_correct, count(error) AS n_errors FROM log")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as files that come twice, streamed into a table without repeats, and counted."""
    root = f"{shared_dir(spark)}/simplicia/stream-{uuid.uuid4().hex}"
    log = X.judgement_log(spark, sf_dir)
    for _ in range(2):
        writers.append_log(log, f"{root}/log", compression="gzip")
        stream.to_table(stream.read_log(spark, f"{root}/log"), f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return stream.counts(spark.read.parquet(f"{root}/table"))


_FRACTIONS = "gradient", "curl", "harmonic"


@query("SELECT 'tree' AS label, CAST(1 AS DOUBLE) AS gradient, CAST(0 AS DOUBLE) AS curl, CAST(0 AS DOUBLE) AS harmonic")
def hodge_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flow on a tree is all gradient, which the solver finds in as many steps as the tree has kinds of nodes."""
    return rounded(hodge.flow_fractions(written(X.tree(spark, sf_dir), "flows")), *_FRACTIONS)


@query("""
WITH f AS (SELECT n_nationkey AS n, coalesce(avg(c_acctbal) / 1000, 0) AS f FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1),
h AS (SELECT sum(f) * sum(f) / count(*) / sum(f * f) AS harmonic FROM f)
SELECT 'ring' AS label, round(1 - harmonic, 6) AS gradient, CAST(0 AS DOUBLE) AS curl, round(harmonic, 6) AS harmonic FROM h""")
def hodge_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Around a ring without triangles the mean flow is harmonic, the rest gradient."""
    return rounded(hodge.flow_fractions(written(X.ring(spark, sf_dir), "flows")), *_FRACTIONS)


@query(f"""{X.BLOCKS_SQL}, g AS (SELECT sum(d * d / size) AS g FROM div JOIN sizes USING (n)), y AS (SELECT sum(value * value) AS y FROM flow)
SELECT 'blocks' AS label, round(g / y, 6) AS gradient, round(1 - g / y, 6) AS curl, CAST(0 AS DOUBLE) AS harmonic FROM g, y WHERE y > 0""")
def hodge_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Separate complete graphs of different sizes, for which no first guess is right."""
    return rounded(hodge.flow_fractions(written(X.blocks(spark, sf_dir), "flows")), *_FRACTIONS)


@query(f"{X.BLOCKS_SQL} SELECT a, b, round(sum(v) / any_value(size), 6) + 0.0 AS s1_star FROM slots JOIN sizes USING (n) GROUP BY a, b")
def hodge_block_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge signal of separate complete complexes of different sizes."""
    return rounded(hodge.edge_projection(written(X.block_triangles(spark, sf_dir), "triangles"))[0], "s1_star")


@query()
def hodge_supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The general solver on a large complex that isn't complete."""
    tri = written(X.slate_triangles(spark, sf_dir, "supplier"), "triangles")
    return hodge.edge_projection(tri)[0]


@query()
def pairs_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.connected(X.part_pairs(spark, sf_dir), 200)


@query()
def clique_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = X.part_labels(spark, sf_dir).drop("a", "b")
    return pairs.clique_pairs(sampling.clique_items(X.part_pairs(spark, sf_dir), 70), labels, keep=0.75)


#: The four random graphs of the reference's run, and its fields from 0 to 50.
GRAPHS = (0.02, 0.05, 0.10, 0.30)
FIELDS = 3000


def _graphs(spark: SparkSession) -> DataFrame:
    """(graph, u, v): the largest component of each, under its probability."""
    return reduce(DataFrame.union, [written(spectral.largest_component(spectral.random_graph(spark, 100, p)), "graph").select(F.lit(f"{p:.2f}").alias("graph"), "u", "v") for p in GRAPHS])


def _laplacians(edges: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, [spectral.laplacian(edges.where(F.col("graph") == f"{p:.2f}")).select(F.lit(f"{p:.2f}").alias("graph"), "row", "col", "value") for p in GRAPHS])


@query()
def spectral_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.spectral_gaps(spectral.spectra(_laplacians(_graphs(spark))))


@query()
def butterfly(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _graphs(spark)
    places = spectral.embedding(_laplacians(edges))
    names = F.array(*(F.lit(f"{p:.2f}") for p in GRAPHS))
    rows = spark.range(FIELDS * len(GRAPHS)).select(F.get(names, (F.col("id") % len(GRAPHS)).cast("int")).alias("graph"), (F.floor(F.col("id") / len(GRAPHS)) * (50 / (FIELDS - 1))).alias("field"))
    return spectral.butterfly(spectral.phases(edges, places), rows)


def _part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, v), u < v: parts that share an order."""
    p = X.part_pairs(spark, sf_dir).select(F.col("left_item").cast("long").alias("x"), F.col("right_item").cast("long").alias("y"))
    return written(p.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "parts")


@query(f"""{X.PARTS_SQL}, d AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY node)
SELECT k, (SELECT count(*) FROM d) AS n_nodes, (SELECT CAST(sum(degree) AS DOUBLE) FROM d) AS trace, (SELECT min(degree) FROM d) AS least_degree, TRUE AS solves, TRUE AS unit, TRUE AS sums_to_0, TRUE AS in_bounds FROM (VALUES (CAST(1 AS BIGINT)), (2), (3)) t(k)""")
def part_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Laplacian of parts that share an order: its smallest pairs beside the constant one, with their checks.

    The residual is of the table of vectors and the Laplacian, made anew; values
    rise from 0, and the first is at most n / (n - 1) times the least degree.
    """
    matrix = written(spectral.laplacian(_part_graph(spark, sf_dir)), "laplacian")
    values, vectors = eigen.eigenpairs(matrix, 3, without_constant=True)
    found = values.join(eigen.residuals(matrix, values, vectors), "k")
    size = matrix.where("row = col").agg(F.count("*").alias("n_nodes"), F.sum("value").alias("trace"), F.min("value").cast("long").alias("least_degree"))
    before = F.coalesce(F.lag("eigenvalue").over(Window.orderBy("k")), F.lit(-1e-9))  # three rows
    bounds = (F.col("eigenvalue") >= before) & ((F.col("k") > 1) | (F.col("eigenvalue") <= F.col("n_nodes") / (F.col("n_nodes") - 1) * F.col("least_degree") + 1e-9))
    checks = {"solves": F.col("residual") < 1e-6, "unit": F.abs(F.col("length") - 1) < 1e-8, "sums_to_0": F.abs("total") < 1e-6, "in_bounds": bounds}
    return found.crossJoin(size).select("k", "n_nodes", "trace", "least_degree", *(c.alias(name) for name, c in checks.items()))  # one row of sizes


@query()
def part_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that share an order, placed by the second and third eigenvectors."""
    return eigen.placed(spectral.laplacian(_part_graph(spark, sf_dir)))


@query()
def part_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lowest levels of the magnetic Laplacian of parts that share an order, for some fields."""
    edges = _part_graph(spark, sf_dir)
    phased = written(spectral.phases(edges, eigen.placed(spectral.laplacian(edges))), "phased")
    return eigen.lowest_levels(phased, spark.createDataFrame([(float(b),) for b in (0, 10, 25, 50)], "field double"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS u, -(l_partkey * 1000000 + l_suppkey) - 1 AS v FROM lineitem),
both_ AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
label(node, component) USING KEY (node) AS (
  SELECT u, u FROM both_ GROUP BY u
  UNION
  SELECT b.v, min(l.component) FROM label l JOIN both_ b ON l.node = b.u JOIN recurring.label r ON r.node = b.v
  WHERE l.component < r.component GROUP BY b.v)
SELECT node, component FROM label""")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that share a part from one supplier, over every line; the SQL spreads labels until none changes."""
    return spectral.components(X.lines_graph(spark, sf_dir))
