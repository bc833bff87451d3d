"""Queries that write with the writers and read with the readers: what comes back is compared with SQL over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simplicia.functions import columns as C
from simplicia.operators import complexes, hodge, pairs, reports, triplets
from simplicia.plans import fixtures as X
from simplicia.plans.register import query, rounded
from simplicia.sources import readers, writers
from simplicia.tables import read, shared_dir, written

_COUNTS = "SELECT i, j, k, total_count, odd_i_count, odd_j_count, odd_k_count FROM counts"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/simplicia/{name}-{uuid.uuid4().hex}"


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


@query(f"{X.CHOICES_SQL} {_COUNTS}")
def file_triplet_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of three integers, the odd one last, among blank and torn lines."""
    path = _folder(spark, "triplets")
    c = X.choices(spark, sf_dir)
    odd = F.element_at(F.array("a", "b", "c"), F.col("choice"))
    others = F.filter(F.array("a", "b", "c"), lambda x: x != odd)
    lines = c.select(F.concat(F.lit(" "), others[0], F.lit("\t"), others[1], F.lit("  "), odd).alias("value"))
    bad = read(spark, sf_dir, "nation").select(F.explode(F.array(F.lit(""), F.lit("  "), F.lit("1 2"), F.lit("1 2 x"), F.lit("1 2 3 4"))).alias("value"))
    lines.union(bad).write.text(path)
    return triplets.canonical_counts(readers.triplet_text(spark, path, strict=False))


@query(f"{X.CHOICES_SQL} {_COUNTS}")
def file_judgement_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated files with a header and further columns, read strictly."""
    path = _folder(spark, "tsv")
    X.choices(spark, sf_dir).withColumn("more", F.lit("x y")).repartition(3).write.option("sep", "\t").option("header", True).csv(path)
    return triplets.canonical_counts(readers.judgement_tsv(spark, path))


@query("SELECT l_returnflag || '\t1\t2' AS value, count(*) AS n FROM lineitem GROUP BY 1")
def file_tsv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without three integers and a choice, counted; the good ones don't come back here."""
    path = _folder(spark, "tsv")
    lines = read(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", F.lit("\t1\t2")).alias("value"))
    good = X.choices(spark, sf_dir).select(F.concat_ws("\t", "a", "b", "c", "choice").alias("value"))
    lines.union(good).repartition(2).write.option("header", True).option("quote", "").option("sep", "\u0001").csv(path)
    return readers.tsv_rejects(spark, path).groupBy("value").agg(F.count("*").alias("n"))


@query(f"{X.SLATES_SQL} {_COUNTS}")
def file_slates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as lines of items and purchases."""
    path = _folder(spark, "slates")
    s = X.slates(spark, sf_dir)
    s.select(F.concat_ws(";", F.array_join("slate", " "), F.array_join("purchased", " ")).alias("value")).write.text(path)
    return triplets.slate_counts(readers.slate_text(spark, path))


@query(f"""{X.TRI_SQL}, rows_ AS (SELECT i, j, k, total_count, round(p_i, 6) AS p_i, round(p_j, 6) AS p_j, round(p_k, 6) AS p_k, round(agreement, 6) + 0.0 AS agreement FROM tri)
SELECT 'wide' AS layout, * FROM rows_ UNION ALL SELECT 'slim', * FROM rows_""")
def file_triangle_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical triplets in both layouts."""
    tri = written(X.slate_triangles(spark, sf_dir), "triangles")
    found = []
    for layout in ("wide", "slim"):
        path = _folder(spark, layout)
        writers.triangle_csv(tri, path, slim=layout == "slim")
        found.append(readers.triangle_csv(spark, path).select(F.lit(layout).alias("layout"), "i", "j", "k", "total_count", *((F.round(c, 6) + 0.0).alias(c) for c in ("p_i", "p_j", "p_k", "agreement"))))
    return found[0].union(found[1])


_IDS = f"""{X.TRI_SQL},
t AS (SELECT i, j, k, row_number() OVER (ORDER BY i, j, k) - 1 AS tri_id FROM tri),
ends AS (
  SELECT tri_id, 0 AS slot, i AS a, j AS b, 1 AS sign FROM t UNION ALL SELECT tri_id, 1, i, k, -1 FROM t UNION ALL SELECT tri_id, 2, j, k, 1 FROM t),
e AS (SELECT a, b, row_number() OVER (ORDER BY min(tri_id * 3 + slot)) - 1 AS edge_id FROM ends GROUP BY a, b)"""


@query(f"""{_IDS}, s AS (SELECT a, b, sum(total_count * excluded) / sum(total_count) AS similarity FROM slots GROUP BY a, b)
SELECT edge_id, a AS node_a, b AS node_b, round(similarity, 6) AS similarity FROM e JOIN s USING (a, b)""")
def file_edge_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges numbered by their first triangle."""
    path = _folder(spark, "edges")
    tri = written(X.slate_triangles(spark, sf_dir), "triangles")
    writers.edge_csv(tri, complexes.edges(tri), path)
    rows = spark.read.option("header", True).csv(path)
    return rows.select(*(F.col(c).cast("long").alias(c) for c in ("edge_id", "node_a", "node_b")), F.round(F.col("similarity").cast("double"), 6).alias("similarity"))


_ENTRIES = f"{_IDS} SELECT edge_id AS row, tri_id AS col, CAST(sign AS INTEGER) AS value FROM ends JOIN e USING (a, b)"


@query(_ENTRIES)
def file_matrix_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "matrix")
    writers.matrix_market(written(X.slate_triangles(spark, sf_dir), "triangles"), path)
    return readers.matrix_market(spark, path)


@query(_ENTRIES)
def file_matrix_npz(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark, 'matrix')}.npz"
    writers.matrix_npz(written(X.slate_triangles(spark, sf_dir), "triangles"), _local(path))
    return readers.matrix_npz(spark, path)


@query(_ENTRIES)
def file_matrix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "matrix")
    writers.matrix_table(written(X.slate_triangles(spark, sf_dir), "triangles"), path)
    return spark.read.parquet(path).select("row", "col", F.col("sign").alias("value"))


@query(f"{X.SOFT_SQL} SELECT i, j, k, total_count, round(p_i, 6) AS p_i, round(p_j, 6) AS p_j, round(p_k, 6) AS p_k FROM tri")
def file_image_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of image names and similarities; the classes are what the names begin with."""
    path = _folder(spark, "triples")
    rows = X.soft_triples(spark, sf_dir).select(*(F.concat(f"c{n}", F.lit(f"_image{n}")).alias(f"f{n}") for n in range(3)), "s01", "s02", "s12")
    writers.npz_triples(rows.repartition(3), _local(path))
    back = readers.npz_triples(spark, path)
    named = back.select(*(C.first_token(F.col(f"f{n}")).cast("long").alias(f"c{n}") for n in range(3)), "s01", "s02", "s12")
    return rounded(triplets.soft_triangles(named), "p_i", "p_j", "p_k").select("i", "j", "k", "total_count", "p_i", "p_j", "p_k")


@query(f"{X.PAIRS_SQL} SELECT pair_id, left_score, right_score, gap, true_side, human_side, annotator FROM pairs")
def file_scores_and_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and crowd labels as CSV with paths for items, to judged pairs."""
    scores, labels = _folder(spark, "scores"), _folder(spark, "labels")
    url = lambda c: F.concat(F.lit("https://images/of/"), F.col(c)).alias(c)
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("label"), F.floor("s_acctbal").alias("score"))
    rows.select(url("label"), "score").write.option("header", True).csv(scores)
    X.supplier_labels(spark, sf_dir).select(url("left"), url("right"), url("choice").alias("label"), F.col("annotator").alias("performer")).write.option("header", True).option("compression", "gzip").csv(labels)
    found = pairs.build_pairs(readers.label_csv(spark, labels), readers.score_csv(spark, scores))
    return found.select("pair_id", "left_score", "right_score", "gap", "true_side", "human_side", "annotator")


@query(f"""{X.PAIRS_SQL} SELECT (SELECT count(*) FROM nation) AS n_torn, CAST(0 AS BIGINT) AS n_left, count(*) AS n_records, count(DISTINCT pair_id) AS n_pairs, count(error) AS n_errors, round(avg(model_correct), 6) AS model_accuracy FROM log""")
def file_log_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of JSON lines with torn ones, written anew without them."""
    path = _folder(spark, "log")
    writers.append_log(X.judgement_log(spark, sf_dir), path, compression="gzip")
    read(spark, sf_dir, "nation").select(F.lit('{"row": 1, "pair_id": "1|').alias("value")).coalesce(1).write.mode("append").text(path)
    torn = readers.repair_log(spark, path)
    left = readers.torn_lines(spark, path).count()
    found = rounded(reports.status(readers.judgement_log(spark, path)), "model_accuracy")
    return found.select(F.lit(torn).cast("long").alias("n_torn"), F.lit(left).cast("long").alias("n_left"), "*")


@query(f"{X.PAIRS_SQL} SELECT pair_id, presentation, model_side FROM log")
def file_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log, twice put into a snapshot, which is there once."""
    log, path = _folder(spark, "log"), _folder(spark, "snapshot")
    writers.append_log(X.judgement_log(spark, sf_dir), log, compression="gzip")
    for _ in range(2):
        writers.snapshot(readers.judgement_log(spark, log), path)
    return spark.read.parquet(path).select("pair_id", "presentation", "model_side")


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, 'n' || n_nationkey AS code, n_name AS label FROM nation")
def file_class_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object of ids, codes and labels."""
    path = _folder(spark, "classes")
    n = read(spark, sf_dir, "nation")
    entry = F.struct(F.col("n_nationkey").cast("string"), F.array(F.concat(F.lit("n"), F.col("n_nationkey")), "n_name"))
    n.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).write.text(path)  # 25 nations
    return readers.class_index(spark, path)


@query("WITH ids AS (SELECT unnest(range(0, (SELECT max(n_nationkey) * 2 + 1 FROM nation))) AS id) SELECT id, replace(coalesce(n_name, '?'), '_', ' ') AS label FROM ids LEFT JOIN nation ON id = n_nationkey * 2")
def file_concept_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by dense id as one JSON array."""
    path = _folder(spark, "concepts")
    writers.concept_list(complexes.dense_labels(read(spark, sf_dir, "nation").select((F.col("n_nationkey") * 2).cast("long").alias("id"), F.col("n_name").alias("label"))), path)
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("id", "label"))
    return whole.select(F.col("id").cast("long").alias("id"), "label")


@query(f"""{X.CLOSED_SQL}, m AS (SELECT round(sum(s2_hat * s2_hat) / sum(s2 * s2), 6) AS g FROM hats)
SELECT (SELECT n FROM size) AS n_nodes, (SELECT count(*) FROM s1) AS n_edges, count(*) AS n_triangles, (SELECT count(*) FROM tets) AS n_tetrahedra, CAST(sum(total_count) AS BIGINT) AS n_judgments,
       (SELECT g FROM m) AS frac_explained, CAST(sum(total_count) AS BIGINT) AS in_triangles, round(sum(agreement), 1) AS agreements, round((SELECT sum(s1_star) FROM s1), 1) AS signals,
       (SELECT count(DISTINCT 'Brand ' || x) FROM (SELECT i AS x FROM tri UNION ALL SELECT j FROM tri UNION ALL SELECT k FROM tri)) AS n_labels, CAST(0 AS BIGINT) AS n_unplaced FROM tri""")
def file_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The viewer's document, packed, with labels and places of nodes, read back as one object."""
    path = _folder(spark, "payload")
    tri = written(X.slate_triangles(spark, sf_dir), "triangles")
    edges, tets = complexes.edges(tri), complexes.tetrahedra(tri)
    nodes = complexes.nodes(tri)
    labels = nodes.select("id", F.concat(F.lit("Brand "), "id").alias("label"))
    places = nodes.select(F.col("id").alias("node"), *((C.hash_unit(n, F.col("id")) * 300).alias(c) for n, c in enumerate("xyz")))
    fractions = written(hodge.triangle_fractions(tri), "fractions")
    writers.payload(tri, edges, complexes.placed(nodes, labels, places), tets, hodge.edge_projection(tri)[0], complexes.meta(tri, fractions, "brand slates"), path, gzip=True)
    p = readers.payload(spark, path)
    total = lambda c, n: F.aggregate(c, F.lit(0.0), lambda s, x: s + x[n])
    return p.select(
        *(F.size(c).cast("long").alias(f"n_{c}") for c in ("nodes", "edges", "triangles", "tetrahedra")),
        F.col("meta")["n_judgments"].cast("long").alias("n_judgments"),
        F.col("meta")["frac_explained"].cast("double").alias("frac_explained"),
        total("triangles", 4).cast("long").alias("in_triangles"),
        F.round(total("triangles", 3), 1).alias("agreements"),
        F.round(total("edges", 3), 1).alias("signals"),
        F.size(F.array_distinct(F.transform("nodes", lambda x: x["label"]))).cast("long").alias("n_labels"),
        F.size(F.filter("nodes", lambda x: x["x"].isNull())).cast("long").alias("n_unplaced"),
    )


@query(f"""{X.SCALED_SQL}, ok AS (SELECT * FROM log WHERE model_side IS NOT NULL), hum AS (SELECT pair_id, max(human_correct) AS h, any_value(bin) AS bin FROM ok WHERE human_correct IS NOT NULL GROUP BY 1),
swap AS (SELECT count(*) AS n, avg(CAST(x.model_side = y.model_side AS INTEGER)) AS same FROM ok x JOIN ok y ON x.pair_id = y.pair_id AND x.swapped = 0 AND y.swapped = 1)
SELECT count(*) AS n_judgements, count(DISTINCT pair_id) AS n_pairs, 'mock-q4' AS model, round(avg(model_correct), 4) AS model_accuracy, (SELECT round(avg(h), 4) FROM hum) AS human_accuracy,
       round(avg(agrees), 4) AS model_human_agreement, round(avg(CASE WHEN model_side = 'left' THEN 1 ELSE 0 END), 4) AS model_left_rate, (SELECT round(same, 4) FROM swap) AS order_consistency, (SELECT n FROM swap) AS n_swap_pairs,
       (SELECT round(avg(model_correct), 4) FROM ok WHERE bin = '8-15') AS model_8_15, (SELECT round(avg(h), 4) FROM hum WHERE bin = '8-15') AS human_8_15,
       (SELECT count(*) FROM ok WHERE bin = '8-15' AND model_correct IS NOT NULL) AS n_8_15, 'HUMAN MODEL NULL ORACLE' AS judges FROM ok""")
def file_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a run as one JSON object, read back."""
    path = _folder(spark, "analysis")
    writers.one_json(reports.analysis(X.judgement_log(spark, sf_dir, scale=X.GAP_SCALE)), path)
    a = spark.read.json(path)
    four = lambda c, name: F.col(c).cast("double").alias(name)
    return a.select(
        "n_judgements", "n_pairs", "model", *(four(c, c) for c in ("model_accuracy", "human_accuracy", "model_human_agreement", "model_left_rate", "order_consistency")), "n_swap_pairs",
        four("by_gap.`8-15`.model", "model_8_15"), four("by_gap.`8-15`.human", "human_8_15"), F.col("by_gap.`8-15`.n").alias("n_8_15"),
        F.array_join(F.array_sort(F.map_keys(F.from_json(F.to_json("hodge"), "map<string,string>"))), " ").alias("judges"),
    )
