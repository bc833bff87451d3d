"""Comparison data derived from the star-schema tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simplicia.operators import complexes, pairs, triplets
from simplicia.tables import read


def slates(spark: SparkSession, sf_dir: str, item: str = "brand") -> DataFrame:
    """An order's distinct brands (or suppliers); purchased are those with a returned line."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    if item == "brand":
        part = read(spark, sf_dir, "part").select("p_partkey", F.expr("cast(substr(p_brand, 7) as bigint)").alias("item"))
        lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    else:
        lines = lines.withColumn("item", F.col("l_suppkey"))
    return lines.groupBy(F.col("l_orderkey").alias("session_id")).agg(F.collect_set("item").alias("slate"), F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("item"))).alias("purchased"))


def slate_triangles(spark: SparkSession, sf_dir: str, item: str = "brand") -> DataFrame:
    return triplets.triangles(triplets.slate_counts(slates(spark, sf_dir, item)), clamp=False)


SLATES_SQL = """
WITH items AS (
  SELECT l_orderkey AS o, CAST(substr(p_brand, 7) AS BIGINT) AS item, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS bought
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
combos AS (
  SELECT x.item AS i, y.item AS j, z.item AS k, x.bought AS bi, y.bought AS bj, z.bought AS bk
  FROM items x JOIN items y ON x.o = y.o AND x.item < y.item JOIN items z ON x.o = z.o AND y.item < z.item
  WHERE x.bought + y.bought + z.bought IN (1, 2)),
flagged AS (SELECT *, CASE WHEN bi + bj + bk = 1 THEN 1 ELSE 0 END AS flag FROM combos),
counts AS (
  SELECT i, j, k, count(*) AS total_count, count(*) FILTER (bi = flag) AS odd_i_count, count(*) FILTER (bj = flag) AS odd_j_count, count(*) FILTER (bk = flag) AS odd_k_count
  FROM flagged GROUP BY i, j, k)"""

SHARES_SQL = """
shares AS (SELECT *, odd_i_count / total_count AS p_i, odd_j_count / total_count AS p_j, odd_k_count / total_count AS p_k FROM counts),
entropies AS (
  SELECT *, -(CASE WHEN p_i > 0 THEN p_i * ln(p_i) ELSE 0 END + CASE WHEN p_j > 0 THEN p_j * ln(p_j) ELSE 0 END + CASE WHEN p_k > 0 THEN p_k * ln(p_k) ELSE 0 END) AS h
  FROM shares),
tri AS (SELECT *, CASE WHEN abs(h) < 1e-15 THEN 0 ELSE h END AS shannon_entropy, 1 - (CASE WHEN abs(h) < 1e-15 THEN 0 ELSE h END) / ln(3) AS agreement FROM entropies),
slots AS (
  SELECT i, j, k, i AS a, j AS b, 1 AS sign, p_k AS excluded, total_count, agreement FROM tri
  UNION ALL SELECT i, j, k, i, k, -1, p_j, total_count, agreement FROM tri
  UNION ALL SELECT i, j, k, j, k, 1, p_i, total_count, agreement FROM tri)"""

TRI_SQL = f"{SLATES_SQL},{SHARES_SQL}"

TETS_SQL = f"""{TRI_SQL},
tets AS (
  SELECT t.i AS a, t.j AS b, t.k AS c, u.k AS d FROM tri t JOIN tri u ON t.i = u.i AND t.j = u.j AND t.k < u.k
  JOIN tri v ON v.i = t.i AND v.j = t.k AND v.k = u.k JOIN tri w ON w.i = t.j AND w.j = t.k AND w.k = u.k),
faces AS (
  SELECT a, b, c, d, b AS i, c AS j, d AS k, 1 AS sign FROM tets UNION ALL SELECT a, b, c, d, a, c, d, -1 FROM tets
  UNION ALL SELECT a, b, c, d, a, b, d, 1 FROM tets UNION ALL SELECT a, b, c, d, a, b, c, -1 FROM tets),
scored AS (SELECT f.a, f.b, f.c, f.d, sum(f.sign * t.agreement) AS s3 FROM faces f JOIN tri t ON f.i = t.i AND f.j = t.j AND f.k = t.k GROUP BY 1, 2, 3, 4)"""

CORRUPTED_SQL = f"""{TRI_SQL},
two AS (
  SELECT a, b, i, j, k, CASE WHEN (i + j + k) % 7 = 0 AND a = i AND b = k THEN -sign ELSE sign END AS sign FROM slots
  WHERE NOT ((i + j * 3 + k) % 11 = 0 AND a = j AND b = k)),
one AS (SELECT DISTINCT a AS node, a, b, 1 AS s FROM two UNION ALL SELECT DISTINCT b, a, b, -1 FROM two),
wrong AS (SELECT node, i, j, k, CAST(sum(sign * s) AS BIGINT) AS value FROM two JOIN one USING (a, b) GROUP BY node, i, j, k HAVING sum(sign * s) <> 0)"""

#: On a complete complex of n items the least-squares solution is the boundary of the signal over n.
CLOSED_SQL = f"""{TETS_SQL},
size AS (SELECT count(DISTINCT x) AS n FROM (SELECT i AS x FROM tri UNION ALL SELECT j FROM tri UNION ALL SELECT k FROM tri)),
s1 AS (SELECT a, b, sum(sign * agreement) / (SELECT n FROM size) AS s1_star FROM slots GROUP BY 1, 2),
hats AS (SELECT s.i, s.j, s.k, any_value(s.agreement) AS s2, sum(s.sign * e.s1_star) AS s2_hat FROM slots s JOIN s1 e ON s.a = e.a AND s.b = e.b GROUP BY 1, 2, 3)"""


def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements (a, b, c, choice): an order's first three brands; odd is that of the largest quantity, ties the smallest brand."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.expr("cast(substr(p_brand, 7) as bigint)").alias("item"))
    lines = read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    by_item = lines.groupBy("l_orderkey", "item").agg(F.min("l_linenumber").alias("first"), F.sum("l_quantity").alias("quantity"))
    # an order has few lines; its brands fit into a row
    order = by_item.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("first", "item", "quantity"))).alias("s")).where(F.size("s") >= 3)
    three = F.slice("s", 1, 3)
    odd = F.array_max(F.transform(three, lambda x: F.struct(x["quantity"].alias("q"), (-x["item"]).alias("m"))))["m"]
    items = F.transform(three, lambda x: x["item"])
    return order.select(*(F.get(items, F.lit(n)).alias(c) for n, c in enumerate("abc")), F.array_position(items, -odd).cast("int").alias("choice"))


CHOICES_SQL = """
WITH by_item AS (
  SELECT l_orderkey AS o, CAST(substr(p_brand, 7) AS BIGINT) AS item, min(l_linenumber) AS first, sum(l_quantity) AS q
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY first, item) AS r FROM by_item),
three AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY q DESC, item) AS place FROM ranked WHERE r <= 3),
triples AS (
  SELECT o, min(item) AS i, max(item) AS k, sum(item) - min(item) - max(item) AS j, max(CASE WHEN place = 1 THEN item END) AS odd
  FROM three GROUP BY o HAVING count(*) = 3),
counts AS (
  SELECT i, CAST(j AS BIGINT) AS j, k, count(*) AS total_count, count(*) FILTER (odd = i) AS odd_i_count, count(*) FILTER (odd = j) AS odd_j_count, count(*) FILTER (odd = k) AS odd_k_count
  FROM triples GROUP BY 1, 2, 3)"""


def soft_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three vectors in a row of ids: classes and inner products."""
    e = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("g"), (F.col("vec_id") % 3).alias("p"), F.struct("label", F.transform("embedding", lambda x: x.cast("double")).alias("v")).alias("x"))
    rows = e.groupBy("g").pivot("p", [0, 1, 2]).agg(F.first("x")).where("`0` IS NOT NULL AND `1` IS NOT NULL AND `2` IS NOT NULL")
    dot = lambda a, b: F.aggregate(F.zip_with(F.col(f"`{a}`.v"), F.col(f"`{b}`.v"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return rows.select(*(F.col(f"`{n}`.label").cast("long").alias(f"c{n}") for n in range(3)), dot(0, 1).alias("s01"), dot(0, 2).alias("s02"), dot(1, 2).alias("s12"))


SOFT_SQL = """
WITH e AS (SELECT vec_id // 3 AS g, vec_id % 3 AS p, CAST(label AS BIGINT) AS c, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
rows_ AS (
  SELECT x.c AS c0, y.c AS c1, z.c AS c2, list_dot_product(x.v, y.v) AS s01, list_dot_product(x.v, z.v) AS s02, list_dot_product(y.v, z.v) AS s12
  FROM e x JOIN e y ON x.g = y.g AND x.p = 0 AND y.p = 1 JOIN e z ON x.g = z.g AND z.p = 2 WHERE x.c <> y.c AND x.c <> z.c AND y.c <> z.c),
odds AS (
  SELECT *, greatest(s01, s02, s12) AS m FROM rows_),
soft AS (
  SELECT c0, c1, c2, exp(s12 - m) / (exp(s12 - m) + exp(s02 - m) + exp(s01 - m)) AS p0, exp(s02 - m) / (exp(s12 - m) + exp(s02 - m) + exp(s01 - m)) AS p1,
         exp(s01 - m) / (exp(s12 - m) + exp(s02 - m) + exp(s01 - m)) AS p2 FROM odds),
keyed AS (
  SELECT least(c0, c1, c2) AS i, c0 + c1 + c2 - least(c0, c1, c2) - greatest(c0, c1, c2) AS j, greatest(c0, c1, c2) AS k, * FROM soft),
means AS (
  SELECT i, j, k, count(*) AS total_count,
         avg(CASE WHEN c0 = i THEN p0 WHEN c1 = i THEN p1 ELSE p2 END) AS q_i, avg(CASE WHEN c0 = j THEN p0 WHEN c1 = j THEN p1 ELSE p2 END) AS q_j,
         avg(CASE WHEN c0 = k THEN p0 WHEN c1 = k THEN p1 ELSE p2 END) AS q_k
  FROM keyed GROUP BY 1, 2, 3),
tri AS (SELECT i, j, k, total_count, q_i / (q_i + q_j + q_k) AS p_i, q_j / (q_i + q_j + q_k) AS p_j, q_k / (q_i + q_j + q_k) AS p_k FROM means)"""


def supplier_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of supplier pairs that share a part; choices follow from the ids."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("group"), F.col("l_suppkey").alias("item"))
    return _labels(pairs.sharing_pairs(lines, read(spark, sf_dir, "supplier").count()).withColumnRenamed("first", "annotator"))


def _labels(ab: DataFrame) -> DataFrame:
    chosen = F.when((F.col("a") + F.col("b")) % 11 != 0, F.when((F.col("a") * 7 + F.col("b") * 13) % 10 < 6, F.col("a")).otherwise(F.col("b")))
    return ab.select("a", "b", F.col("a").cast("string").alias("left"), F.col("b").cast("string").alias("right"), chosen.cast("string").alias("choice"), F.col("annotator").cast("string").alias("annotator"))


def part_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of all part pairs that share an order, a graph that its data leaves incomplete."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).distinct()
    both = lines.withColumnRenamed("p", "a").join(lines.withColumnRenamed("p", "b"), "o").where("a < b")
    return _labels(both.groupBy("a", "b").agg(F.min("o").alias("annotator")))


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged pairs of parts."""
    scores = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("item"), F.floor("p_retailprice").cast("int").alias("score"))
    return pairs.build_pairs(part_labels(spark, sf_dir), scores)


#: Divided by this, account balances of -1,000 to 10,000 differ by 200 at most, where the last bin of gaps ends.
GAP_SCALE = 55


def supplier_pairs(spark: SparkSession, sf_dir: str, *, scale: int = 1) -> DataFrame:
    """Judged pairs of all suppliers that share a part; scale divides the scores."""
    scores = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("item"), F.floor(F.col("s_acctbal") / scale).cast("int").alias("score"))
    return pairs.build_pairs(supplier_labels(spark, sf_dir), scores)


def judgement_log(spark: SparkSession, sf_dir: str, *, scale: int = 1, of: DataFrame | None = None) -> DataFrame:
    """A log of answers that follow from the ids, with errors and leanings to the first item; ``of``: the supplier pairs, where they are there."""
    t = pairs.tasks(supplier_pairs(spark, sf_dir, scale=scale) if of is None else of)
    a, b = F.col("left_item").cast("long"), F.col("right_item").cast("long")
    swapped: Column = (F.col("presentation") == "swapped").cast("int")
    first, second = F.when(swapped == 1, F.col("right_score")).otherwise(F.col("left_score")), F.when(swapped == 1, F.col("left_score")).otherwise(F.col("right_score"))
    truth = F.when(first > second, 1).otherwise(2)
    choice = (
        F.when(a * b % 29 == 1, F.lit(None))
        .when((a + 2 * b + swapped) % 17 == 0, 1)
        .when((a * 5 + b * 3 + swapped) % 9 == 0, 3 - truth)
        .otherwise(truth)
    )
    answered = t.withColumns(
        {
            "choice": choice.cast("int"),
            "error": F.when(a * b % 29 == 1, "timeout"),
            "row": (a * 100000 + b) * 2 + swapped,
            "latency_s": (a + b) % 7 / 2 + 0.5,
            "model_name": F.lit("mock-q4"),
        }
    )
    return pairs.records(answered)


def _pairs_sql(score: str = "s_acctbal") -> str:
    return f"""
WITH sp AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem),
ab AS (SELECT x.s AS a, y.s AS b, min(x.p) AS part FROM sp x JOIN sp y ON x.p = y.p AND x.s < y.s GROUP BY 1, 2),
pairs AS (
  SELECT a, b, a || '|' || b AS pair_id, CAST(a AS VARCHAR) AS left_item, CAST(b AS VARCHAR) AS right_item,
         CAST(floor(l.{score}) AS INTEGER) AS left_score, CAST(floor(r.{score}) AS INTEGER) AS right_score,
         abs(CAST(floor(l.{score}) AS INTEGER) - CAST(floor(r.{score}) AS INTEGER)) AS gap,
         CASE WHEN floor(l.{score}) = floor(r.{score}) THEN 'tie' WHEN floor(l.{score}) > floor(r.{score}) THEN 'left' ELSE 'right' END AS true_side,
         CASE WHEN (a + b) % 11 <> 0 THEN CASE WHEN (a * 7 + b * 13) % 10 < 6 THEN 'left' ELSE 'right' END END AS human_side,
         CAST(part AS VARCHAR) AS annotator
  FROM ab JOIN supplier l ON l.s_suppkey = a JOIN supplier r ON r.s_suppkey = b),
tasks AS (SELECT *, 0 AS swapped, 'as_shown' AS presentation FROM pairs UNION ALL SELECT *, 1, 'swapped' FROM pairs),
truths AS (
  SELECT *, CASE WHEN CASE WHEN swapped = 1 THEN right_score ELSE left_score END > CASE WHEN swapped = 1 THEN left_score ELSE right_score END THEN 1 ELSE 2 END AS truth FROM tasks),
answers AS (
  SELECT *, CASE WHEN a * b % 29 = 1 THEN NULL WHEN (a + 2 * b + swapped) % 17 = 0 THEN 1 WHEN (a * 5 + b * 3 + swapped) % 9 = 0 THEN 3 - truth ELSE truth END AS choice,
         CASE WHEN a * b % 29 = 1 THEN 'timeout' END AS error, (a * 100000 + b) * 2 + swapped AS "row", (a + b) % 7 / 2 + 0.5 AS latency_s
  FROM truths),
sides AS (
  SELECT *, CASE WHEN choice = 1 THEN CASE WHEN swapped = 1 THEN 'right' ELSE 'left' END WHEN choice = 2 THEN CASE WHEN swapped = 1 THEN 'left' ELSE 'right' END END AS model_side FROM answers),
log AS (
  SELECT *, CASE WHEN true_side <> 'tie' AND model_side IS NOT NULL THEN CAST(model_side = true_side AS INTEGER) END AS model_correct,
         CASE WHEN true_side <> 'tie' AND human_side IS NOT NULL THEN CAST(human_side = true_side AS INTEGER) END AS human_correct,
         CASE WHEN human_side IS NOT NULL AND model_side IS NOT NULL THEN CAST(model_side = human_side AS INTEGER) END AS agrees,
         CASE WHEN gap BETWEEN 1 AND 3 THEN '1-3' WHEN gap BETWEEN 4 AND 7 THEN '4-7' WHEN gap BETWEEN 8 AND 15 THEN '8-15' WHEN gap BETWEEN 16 AND 30 THEN '16-30' WHEN gap BETWEEN 31 AND 200 THEN '31+' END AS bin
  FROM sides),
votes AS (
  SELECT pair_id, a, b, left_item, right_item, avg(CASE WHEN model_side = 'right' THEN 1.0 ELSE -1.0 END) AS model,
         CASE any_value(human_side) WHEN 'right' THEN 1.0 WHEN 'left' THEN -1.0 ELSE 0.0 END AS human, CAST(sign(any_value(right_score) - any_value(left_score)) AS DOUBLE) AS oracle
  FROM log WHERE model_side IS NOT NULL GROUP BY 1, 2, 3, 4, 5),
flows AS (
  SELECT least(left_item, right_item) AS u, greatest(left_item, right_item) AS v, label, CASE WHEN left_item < right_item THEN value ELSE -value END AS value
  FROM (UNPIVOT votes ON model, human, oracle INTO NAME label VALUE value))"""


PAIRS_SQL = _pairs_sql()
SCALED_SQL = _pairs_sql(f"s_acctbal / {GAP_SCALE}")

#: All part pairs that share an order.
PARTS_SQL = """
WITH op AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
pairs AS (SELECT DISTINCT x.p AS a, y.p AS b FROM op x JOIN op y ON x.o = y.o AND x.p < y.p)"""


def lines_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (u, v) of every line: its order, and its part from its supplier, numbered below 0."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("u"), (-(F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")) - 1).alias("v"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow (label, u, v, value) on a tree: every supplier but 0 from the one of a third of its number, by their balances' signs and sizes."""
    s = read(spark, sf_dir, "supplier").where("s_suppkey > 0")
    return s.select(F.lit("tree").alias("label"), F.expr("s_suppkey div 3").alias("u"), F.col("s_suppkey").alias("v"), (F.col("s_acctbal") / 1000).alias("value"))


def ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow on a ring of the nations: each to the next by the mean balance of its customers."""
    mean = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n")).agg((F.avg("c_acctbal") / 1000).alias("f"))
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n")).join(mean, "n", "left")
    last = F.col("n") == 24
    return n.select(F.lit("ring").alias("label"), F.when(last, 0).otherwise(F.col("n")).alias("u"), F.when(last, 24).otherwise(F.col("n") + 1).alias("v"), (F.coalesce("f", F.lit(0.0)) * F.when(last, -1).otherwise(1)).alias("value"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow on all pairs of suppliers of one nation: separate complete graphs of different sizes."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n"), F.col("s_suppkey").alias("x"), "s_acctbal")
    both = s.withColumnsRenamed({"x": "u", "s_acctbal": "bu"}).join(s.withColumnsRenamed({"x": "v", "s_acctbal": "bv"}), "n").where("u < v")
    return both.select(F.lit("blocks").alias("label"), "u", "v", ((F.col("bv") - F.col("bu")) / 1000 + (F.col("u") * 7 + F.col("v") * 13) % 10 - 4.5).alias("value"))


def block_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles (i, j, k, agreement) of all three suppliers of one nation."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n"), F.col("s_suppkey").alias("x"))
    i, j, k = (s.withColumnRenamed("x", c) for c in "ijk")
    two = i.join(j, "n").where("i < j").repartition(4 * spark.sparkContext.defaultParallelism, "i", "j")  # few rows that become many
    return two.join(k, "n").where("j < k").select("i", "j", "k", ((F.col("i") * 7 + F.col("j") * 13 + F.col("k") * 29) % 100 / 100).alias("agreement"))


BLOCKS_SQL = """
WITH s AS (SELECT s_nationkey AS n, s_suppkey AS x, s_acctbal AS b FROM supplier),
sizes AS (SELECT n, count(*) AS size FROM s GROUP BY n),
flow AS (
  SELECT u.n, u.x AS u, v.x AS v, (v.b - u.b) / 1000 + (u.x * 7 + v.x * 13) % 10 - 4.5 AS value FROM s u JOIN s v ON u.n = v.n AND u.x < v.x),
div AS (SELECT n, x, sum(d) AS d FROM (SELECT n, u AS x, -value AS d FROM flow UNION ALL SELECT n, v, value FROM flow) GROUP BY n, x),
tri AS (
  SELECT i.n, i.x AS i, j.x AS j, k.x AS k, (i.x * 7 + j.x * 13 + k.x * 29) % 100 / 100 AS agreement
  FROM s i JOIN s j ON i.n = j.n AND i.x < j.x JOIN s k ON i.n = k.n AND j.x < k.x),
slots AS (
  SELECT n, i AS a, j AS b, agreement AS v FROM tri UNION ALL SELECT n, i, k, -agreement FROM tri UNION ALL SELECT n, j, k, agreement FROM tri)"""


def corrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boundary of the brand triangles with faults: some entries have the wrong sign, some are lost."""
    two = complexes.triangle_boundary(slate_triangles(spark, sf_dir))
    wrong = (F.col("i") + F.col("j") + F.col("k")) % 7 == 0
    sign = F.when(wrong & (F.col("a") == F.col("i")) & (F.col("b") == F.col("k")), -F.col("sign")).otherwise(F.col("sign"))
    return two.withColumn("sign", sign).where("NOT ((i + j * 3 + k) % 11 = 0 AND a = j AND b = k)")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's reply for each event, of six kinds."""
    n = (F.col("event_id") % 2 + 1).cast("string")
    c = F.concat(F.lit("0."), (F.col("event_id") % 89 + 10).cast("string"))
    texts = [
        F.concat(F.lit('{"older": '), n, F.lit(', "confidence": '), c, F.lit("}")),
        F.concat(F.lit('I think {"older": '), n, F.lit(', "confidence": '), c, F.lit("} fits.")),
        F.concat(F.lit("The answer is "), n, F.lit(".")),
        F.lit("no idea"),
        F.lit('{"older": 7, "confidence": 0.5}'),
        F.concat(F.lit('{"older": "'), n, F.lit('"}')),
    ]
    chosen = F.element_at(F.array(*texts), (F.col("event_id") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", chosen.alias("reply"))
