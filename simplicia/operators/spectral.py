"""Graphs and their spectra."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simplicia.functions import columns as C
from simplicia.tables import forget, ranked, written


def random_graph(spark: SparkSession, n: int, p: float, *, seed: int = 42) -> DataFrame:
    """Edges (u, v), u < v, each present with probability p; by rows, so no task draws all of them."""
    u = spark.range(n).select(F.col("id").alias("u"))
    v = u.where(F.col("u") < n - 1).select("u", F.explode(F.sequence(F.col("u") + 1, F.lit(n - 1))).alias("v"))
    return v.where(C.hash_unit(seed, F.col("u"), F.col("v")) < p)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each can reach; labels spread, and jump to their labels' labels."""
    e = written(edges.select("u", "v").union(edges.select("v", "u")).distinct(), "graph")
    label = written(e.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while True:
        near = e.join(label.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("c"))
        step = label.join(near, "node").select("node", F.least("component", "c").alias("component"), (F.col("c") < F.col("component")).alias("moved"))
        step = written(step, "labels")
        forget(label)
        if step.where("moved").isEmpty():
            forget(e)
            return step.select("node", "component")
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("to"))
        label = written(step.join(jump, "component").select("node", F.least("component", "to").alias("component")), "labels")
        forget(step)


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges of the component of most nodes (ties: of the smallest node), nodes renumbered from 0 in order."""
    label = written(components(edges), "components")
    best = label.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    inside = written(ranked(label.join(best, "component", "left_semi").select("node"), ["node"], "place"), "places")
    a, b = inside.select(F.col("node").alias("u"), F.col("place").alias("pu")), inside.select(F.col("node").alias("v"), F.col("place").alias("pv"))
    return edges.join(a, "u").join(b, "v").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))


def laplacian(edges: DataFrame) -> DataFrame:
    """(row, col, value): degrees on the diagonal, -1 for each edge both ways."""
    both = edges.select("u", "v").union(edges.select("v", "u"))
    return both.groupBy(F.col("u").alias("row")).agg(F.count("*").cast("double").alias("value")).select("row", F.col("row").alias("col"), "value").union(both.select("u", "v", F.lit(-1.0)))


def _dense(rows: pd.DataFrame) -> np.ndarray:
    n = int(max(rows["row"].max(), rows["col"].max())) + 1 if len(rows) else 0
    m = np.zeros((n, n))
    m[rows["row"], rows["col"]] = rows["value"]
    return m


def spectra(matrices: DataFrame) -> DataFrame:
    """(graph, k, eigenvalue) of symmetric matrices (graph, row, col, value), a dense solver for each graph.

    A matrix has to fit into a task; graphs are solved side by side.
    """

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        values = np.linalg.eigvalsh(_dense(rows))
        return pd.DataFrame({"graph": rows["graph"].iloc[0], "k": np.arange(len(values)), "eigenvalue": values})

    return matrices.groupBy("graph").applyInPandas(solve, "graph string, k long, eigenvalue double")


def spectral_gaps(values: DataFrame, *, factor: float = 2.0) -> DataFrame:
    """Gaps (graph, k, gap) to the next eigenvalue that are larger than ``factor`` times the graph's mean gap."""
    order, all_ = Window.partitionBy("graph").orderBy("k"), Window.partitionBy("graph")
    gaps = values.select("graph", "k", (F.lead("eigenvalue").over(order) - F.col("eigenvalue")).alias("gap"))
    return gaps.withColumn("mean", F.avg("gap").over(all_)).where(F.col("gap") > factor * F.col("mean")).select("graph", "k", "gap")


def embedding(matrices: DataFrame) -> DataFrame:
    """(graph, node, x, y): second and third eigenvectors, each scaled to a largest entry of 1; signs are open."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        _, vectors = np.linalg.eigh(_dense(rows))
        xy = vectors[:, 1:3]
        top = np.abs(xy).max(0)
        xy = xy / np.where(top > 0, top, 1)
        return pd.DataFrame({"graph": rows["graph"].iloc[0], "node": np.arange(len(xy)), "x": xy[:, 0], "y": xy[:, 1]})

    return matrices.groupBy("graph").applyInPandas(solve, "graph string, node long, x double, y double")


def phases(edges: DataFrame, places: DataFrame) -> DataFrame:
    """(u, v, phase) for field 1: half of (y_v - y_u) (x_v + x_u); a field multiplies it.

    With a column graph in both tables, each graph has its own places.
    """
    keys = ["graph"] if "graph" in edges.columns else []
    a = places.select(*keys, F.col("node").alias("u"), F.col("x").alias("xu"), F.col("y").alias("yu"))
    b = places.select(*keys, F.col("node").alias("v"), F.col("x").alias("xv"), F.col("y").alias("yv"))
    return edges.join(a, [*keys, "u"]).join(b, [*keys, "v"]).select(*keys, "u", "v", ((F.col("yv") - F.col("yu")) * (F.col("xv") + F.col("xu")) / 2).alias("phase"))


def butterfly(phased: DataFrame, fields: DataFrame, *, most_edges: int = 200_000) -> DataFrame:
    """(field, k, eigenvalue) of the magnetic Laplacian for each row of ``fields`` (field).

    With a column graph in both tables, each row's field is for its graph, and
    graph comes first in the result.  Rows are independent and spread over
    tasks; the graphs go to all of them, so their size together is checked
    against ``most_edges`` first.
    """
    many = "graph" in phased.columns
    name = F.col("graph").cast("string") if many else F.lit("")
    rows = phased.select(name.alias("graph"), "u", "v", "phase").limit(most_edges + 1).toPandas()
    if len(rows) > most_edges:
        raise ValueError("the graphs are too large for dense spectra")
    shared = phased.sparkSession.sparkContext.broadcast({g: tuple(part[c].to_numpy() for c in ("u", "v", "phase")) for g, part in rows.groupby("graph")})

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nothing = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        for batch in batches:
            for graph, field in zip(batch["graph"], batch["field"]):
                u, v, phase = shared.value.get(graph, nothing)
                n = int(max(u.max(), v.max())) + 1 if len(u) else 0
                m = np.diag(np.bincount(np.concatenate([u, v]), minlength=n).astype(complex))
                m[u, v] = -np.exp(1j * field * phase)
                m[v, u] = -np.exp(-1j * field * phase)
                values = np.linalg.eigvalsh(m)
                yield pd.DataFrame({"graph": graph, "field": field, "k": np.arange(len(values)), "eigenvalue": values})

    found = fields.select(name.alias("graph"), F.col("field").cast("double").alias("field")).mapInPandas(solve, "graph string, field double, k long, eigenvalue double")
    return found if many else found.drop("graph")


def layout(edges: DataFrame, *, spring: float = 0.15, rounds: int = 50, seed: int = 42, scale: float = 300.0) -> DataFrame:
    """(node, x, y, z) by forces: neighbours attract, all nodes repel, steps shrink.

    Repulsion between all nodes is summed over a grid of cells' centres instead
    of all pairs, so a round is grouped sums and a join with the cells, whose
    number is fixed.
    """
    both = written(edges.select("u", "v").union(edges.select("v", "u")).distinct(), "layout")
    axes = ("x", "y", "z")
    at = both.select(F.col("u").alias("node")).distinct().select("node", *((2 * C.hash_unit(seed + n, F.col("node")) - 1).alias(c) for n, c in enumerate(axes)))
    at = written(at, "places")
    grid = 5
    for turn in range(rounds):
        step = 0.2 * (1 - turn / rounds)
        lows = at.agg(*(F.min(c).alias(f"lo_{c}") for c in axes), *(F.max(c).alias(f"hi_{c}") for c in axes)).first()
        cell = {f"c{c}": F.least(F.lit(grid - 1), F.floor((F.col(c) - lows[f"lo_{c}"]) / max(lows[f"hi_{c}"] - lows[f"lo_{c}"], 1e-9) * grid)) for c in axes}
        cells = at.withColumns(cell).groupBy(*cell).agg(F.count("*").alias("m"), *(F.avg(c).alias(f"g{c}") for c in axes)).select("m", *(f"g{c}" for c in axes))
        # at most grid**3 rows by construction
        far = at.join(F.broadcast(cells))
        square = sum((((F.col(c) - F.col(f"g{c}")) ** 2) for c in axes), F.lit(0.01 * spring**2))
        push = far.groupBy("node", *axes).agg(*(F.sum(F.col("m") * spring**2 * (F.col(c) - F.col(f"g{c}")) / square).alias(f"p{c}") for c in axes))
        other = at.select(F.col("node").alias("v"), *(F.col(c).alias(f"o{c}") for c in axes))
        length = F.sqrt(sum((((F.col(c) - F.col(f"o{c}")) ** 2) for c in axes), F.lit(0.0)))
        pull = both.join(at.withColumnRenamed("node", "u"), "u").join(other, "v").groupBy(F.col("u").alias("node")).agg(*(F.sum((F.col(f"o{c}") - F.col(c)) * length / spring).alias(f"q{c}") for c in axes))
        moved = push.join(pull, "node")
        force = F.sqrt(sum(((F.col(f"p{c}") + F.col(f"q{c}")) ** 2 for c in axes), F.lit(0.0)))
        at = written(moved.select("node", *((F.col(c) + (F.col(f"p{c}") + F.col(f"q{c}")) * F.least(F.lit(step), force) / F.greatest(force, F.lit(1e-9))).alias(c) for c in axes)), "places")
    top = at.agg(F.greatest(*(F.max(F.abs(c)) for c in axes))).first()[0] or 1.0
    return at.select("node", *(F.round(F.col(c) * scale / max(top, 1e-9), 2).alias(c) for c in axes))
