"""Simplicial complexes as tables: edges, nodes, tetrahedra and signed incidences.

Simplices are keyed by their items.  Dense ids are needed by matrix files only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simplicia.functions import columns as C
from simplicia.operators.spectral import components
from simplicia.tables import ranked, written


def _slots(tri: DataFrame, *more: str) -> DataFrame:
    """Three rows for each triangle: the edge (a, b), the slot, the sign in the boundary, the share of the third item."""
    parts = [("i", "j", 0, 1, "p_k"), ("i", "k", 1, -1, "p_j"), ("j", "k", 2, 1, "p_i")]
    cols = F.array(*(F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(slot).alias("slot"), F.lit(sign).alias("sign"), F.col(p).alias("excluded")) for a, b, slot, sign, p in parts))
    return tri.select("i", "j", "k", *more, F.explode(cols).alias("e")).select("i", "j", "k", *more, "e.*")


def edges(tri: DataFrame) -> DataFrame:
    """(a, b, similarity, n_triangles): how often the third item was odd, weighted by judgements."""
    rows = _slots(tri, "total_count")
    return rows.groupBy("a", "b").agg((F.sum(F.col("total_count") * F.col("excluded")) / F.sum("total_count")).alias("similarity"), F.count("*").alias("n_triangles"))


def nodes(tri: DataFrame, limits: C.Thresholds = C.HARD) -> DataFrame:
    """(id, mean and population variance of oddness over triangles, their number, category)."""
    cols = F.array(*(F.struct(F.col(c).alias("id"), F.col(f"p_{c}").alias("p")) for c in "ijk"))
    stats = (
        tri.select(F.explode(cols).alias("n"))
        .groupBy(F.col("n.id").alias("id"))
        .agg(F.avg("n.p").alias("mean_oddness"), F.var_pop("n.p").alias("var_oddness"), F.count("*").alias("n_triangles"))
    )
    return stats.withColumn("category", C.category(F.col("mean_oddness"), F.col("var_oddness"), F.col("n_triangles"), limits))


def triangle_boundary(tri: DataFrame) -> DataFrame:
    """Degree 2: (a, b, i, j, k, sign), +1 for ij and jk, -1 for ik."""
    return _slots(tri.withColumns({f"p_{c}": F.lit(0.0) for c in "ijk"})).select("a", "b", "i", "j", "k", "sign")


def edge_boundary(edge: DataFrame, *, first_sign: int = 1) -> DataFrame:
    """Degree 1: (node, a, b, sign); ``first_sign`` for a, the other for b."""
    ends = F.array(F.struct(F.col("a").alias("node"), F.lit(first_sign).alias("sign")), F.struct(F.col("b").alias("node"), F.lit(-first_sign).alias("sign")))
    return edge.select("a", "b", F.explode(ends).alias("e")).select("e.node", "a", "b", "e.sign")


def products(two: DataFrame, one: DataFrame) -> DataFrame:
    """Entries (node, i, j, k, value) of the product of both boundaries that are not 0: none in a complex.

    ``two`` has a, b, i, j, k, sign and ``one`` node, a, b, sign, as the
    functions above make them, or as a file says.
    """
    one = one.withColumnRenamed("sign", "sign1")
    return two.join(one, ["a", "b"]).groupBy("node", "i", "j", "k").agg(F.sum(F.col("sign") * F.col("sign1")).alias("value")).where("value <> 0")


def boundary_of_boundary(tri: DataFrame) -> DataFrame:
    two = triangle_boundary(tri)
    return products(two, edge_boundary(two.select("a", "b").distinct()))


def incidence_checks(two: DataFrame) -> DataFrame:
    """One row of structural checks of a degree-2 boundary: columns that haven't three entries, degrees of edges, products that are not 0."""
    columns = two.groupBy("i", "j", "k").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_triangles"), F.count_if(F.col("n") != 3).alias("bad_columns"))
    rows = two.groupBy("a", "b").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_edges"), F.max("n").alias("max_triangles_per_edge"), F.count_if(F.col("n") >= 2).alias("n_shared_edges"))
    wrong = products(two, edge_boundary(two.select("a", "b").distinct())).agg(F.count("*").alias("bad_products"))
    return columns.crossJoin(rows).crossJoin(wrong)  # one row each


def boundary_checks(tri: DataFrame) -> DataFrame:
    return incidence_checks(triangle_boundary(tri))


def tetrahedra(tri: DataFrame) -> DataFrame:
    """(a, b, c, d) with all four faces among the triangles, each once.

    A triangle is extended by a fourth item at the one of its edges that the
    fewest triangles share, so a hot edge is extended by few; the other faces
    are semi joins.
    """
    t = tri.select("i", "j", "k").distinct()
    edge = _slots(t.withColumns({f"p_{c}": F.lit(0.0) for c in "ijk"})).select("a", "b", "i", "j", "k")
    third = F.array_except(F.array("i", "j", "k"), F.array("a", "b"))[0]
    size = edge.groupBy("a", "b").agg(F.count("*").alias("n"))
    least = edge.join(size, ["a", "b"]).groupBy("i", "j", "k").agg(F.min(F.struct("n", "a", "b")).alias("e"))
    base = least.select("e.a", "e.b", "i", "j", "k")
    wing = edge.select("a", "b", third.alias("d"))
    four = base.join(wing, ["a", "b"]).where((F.col("d") != F.col("i")) & (F.col("d") != F.col("j")) & (F.col("d") != F.col("k")))
    four = four.select(F.array_sort(F.array("i", "j", "k", "d")).alias("s"))
    # found from each of its faces whose least edge leads to it
    found = four.select(*(F.col("s")[n].alias(c) for n, c in enumerate("abcd"))).distinct()
    for x, y, z in ("abc", "abd", "acd", "bcd"):
        face = t.select(F.col("i").alias(x), F.col("j").alias(y), F.col("k").alias(z))
        found = found.join(face, [x, y, z], "left_semi")
    return found.select("a", "b", "c", "d")


def tet_boundary(tets: DataFrame) -> DataFrame:
    """Degree 3: (i, j, k, a, b, c, d, sign), +1 for bcd and abd, -1 for acd and abc."""
    faces = [("b", "c", "d", 1), ("a", "c", "d", -1), ("a", "b", "d", 1), ("a", "b", "c", -1)]
    cols = F.array(*(F.struct(F.col(x).alias("i"), F.col(y).alias("j"), F.col(z).alias("k"), F.lit(s).alias("sign")) for x, y, z, s in faces))
    return tets.select("a", "b", "c", "d", F.explode(cols).alias("f")).select("f.i", "f.j", "f.k", "a", "b", "c", "d", "f.sign")


def tet_scores(tri: DataFrame, tets: DataFrame) -> DataFrame:
    """(a, b, c, d, s3): signed sums of the faces' agreements."""
    faces = tet_boundary(tets).join(tri.select("i", "j", "k", "agreement"), ["i", "j", "k"])
    return faces.groupBy("a", "b", "c", "d").agg(F.sum(F.col("sign") * F.col("agreement")).alias("s3"))


def numbered(tri: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triangles with tri_id in order of items and edges with edge_id in order of first appearance, for matrix files."""
    t = written(ranked(tri.select("i", "j", "k"), ["i", "j", "k"], "tri_id"), "tri-ids")
    first = _slots(t.withColumns({f"p_{c}": F.lit(0.0) for c in "ijk"}), "tri_id").groupBy("a", "b").agg(F.min(F.struct("tri_id", "slot")).alias("first"))
    first = first.select("a", "b", F.col("first.tri_id").alias("tri_id"), F.col("first.slot").alias("slot"))
    return t, written(ranked(first, ["tri_id", "slot"], "edge_id").select("a", "b", "edge_id"), "edge-ids")


def pair_triangles(pairs: DataFrame) -> DataFrame:
    """Triangles (u, v, w), u < v < w, of a graph of pairs (u, v), each once.

    Pairs point from the item of fewer pairs to the one of more; two pairs that
    leave one item are joined, of which even a hub has few, and a semi join
    closes them.
    """
    e = pairs.select("u", "v").where("u < v").distinct()
    degree = e.select(F.explode(F.array("u", "v")).alias("x")).groupBy("x").agg(F.count("*").alias("d"))
    near = e.join(degree.select(F.col("x").alias("u"), F.col("d").alias("du")), "u").join(degree.select(F.col("x").alias("v"), F.col("d").alias("dv")), "v")
    up = F.struct(F.col("du").alias("d"), F.col("u").alias("x")) < F.struct(F.col("dv").alias("d"), F.col("v").alias("x"))
    out = near.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("from"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("to"))
    wedge = out.withColumnRenamed("to", "x").join(out.withColumnRenamed("to", "y"), "from").where("x < y")
    closed = wedge.join(e.select(F.col("u").alias("x"), F.col("v").alias("y")), ["x", "y"], "left_semi")
    three = closed.select(F.array_sort(F.array("from", "x", "y")).alias("s"))
    return three.select(*(F.col("s")[n].alias(c) for n, c in enumerate("uvw")))


def cones(pairs: DataFrame) -> DataFrame:
    """(node, cone): an item that is paired with all others of the node's component; null where there is none.

    With its triangles filled, a component that has such an item is a cone over
    it and has no holes, so a flow without gradient is all curl there.  Each
    item looks for the one of most pairs among itself and its neighbours; in
    such a component all find the same, and where all do it is such a one.
    """
    e = written(pairs.select("u", "v").where("u <> v").distinct(), "graph")
    ends = e.union(e.select("v", "u"))
    degree = written(ends.groupBy("u").agg(F.count("*").alias("d")), "degrees")
    near = ends.join(degree.select(F.col("u").alias("v"), "d"), "v").groupBy("u").agg(F.max(F.struct("d", F.col("v").alias("x"))).alias("hub"))
    hub = near.join(degree, "u").select("u", F.greatest("hub", F.struct("d", F.col("u").alias("x")))["x"].alias("hub"))
    hub = written(hub, "hubs")
    torn = written(e.join(hub, "u").join(hub.select(F.col("u").alias("v"), F.col("hub").alias("other")), "v").where("hub <> other").select("u"), "torn")
    if torn.isEmpty():
        return hub.select(F.col("u").alias("node"), F.col("hub").alias("cone"))
    label = components(e).withColumnRenamed("node", "u")
    bad = label.join(torn, "u", "left_semi").select("component").distinct().withColumn("torn", F.lit(True))
    return hub.join(label, "u").join(bad, "component", "left").select(F.col("u").alias("node"), F.when(F.col("torn").isNull(), F.col("hub")).alias("cone"))


def triangle_count(pairs: DataFrame) -> DataFrame:
    """One row, n_triangles of a graph of pairs (u, v), exact.

    In a component that has more than half of all its pairs, those that it
    lacks are looked at: of n items with m pairs missing, d at an item, it is
    C(n, 3) - m (n - 2) + sum C(d, 2) - the triangles of the missing pairs.
    """
    e = written(pairs.select("u", "v").where("u < v").distinct(), "graph")
    label = written(components(e), "components")
    held = e.join(label.withColumnRenamed("node", "u"), "u")
    sizes = label.groupBy("component").agg(F.count("*").alias("n")).join(held.groupBy("component").agg(F.count("*").alias("m")), "component")
    dense = written(sizes.where("4 * m > n * (n - 1)").withColumn("missing", F.expr("n * (n - 1) div 2 - m")), "dense")
    node = label.join(dense.select("component"), "component")
    deals = 32  # a component's pairs are made by so many tasks
    one = node.select("component", F.col("node").alias("u"), F.pmod(F.hash("node"), F.lit(deals)).alias("deal"))
    two = node.select("component", F.col("node").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"))
    lacks = written(one.join(two, ["component", "deal"]).where("u < v").select("u", "v").join(e, ["u", "v"], "left_anti"), "missing")
    whole = dense.agg(F.coalesce(F.sum(F.expr("n * (n - 1) * (n - 2) div 6 - missing * (n - 2)")), F.lit(0)).alias("whole"))
    bent = degrees(lacks).agg(F.coalesce(F.sum(F.expr("degree * (degree - 1) div 2")), F.lit(0)).alias("bent"))
    none = pair_triangles(lacks).agg(F.count("*").alias("none"))
    sparse = pair_triangles(held.join(dense.select("component"), "component", "left_anti")).agg(F.count("*").alias("sparse"))
    return whole.crossJoin(bent).crossJoin(none).crossJoin(sparse).select(F.expr("whole + bent - none + sparse").alias("n_triangles"))  # one row each


def degrees(pairs: DataFrame) -> DataFrame:
    """(node, degree) over all pairs, both ends."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def dense_labels(labels: DataFrame) -> DataFrame:
    """(id, label) for all ids from 0 to the largest, ? in gaps, _ as spaces."""
    top = labels.agg(F.max("id").alias("top"))
    ids = top.select(F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("id"))
    return ids.join(labels, "id", "left").select("id", F.translate(F.coalesce("label", F.lit("?")), "_", " ").alias("label"))


def tet_edges(tets: DataFrame) -> DataFrame:
    """(u, v, a, b, c, d): the six edges of each tetrahedron."""
    ends = F.array(*(F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for n, x in enumerate("abcd") for y in "abcd"[n + 1 :]))
    return tets.select("a", "b", "c", "d", F.explode(ends).alias("e")).select("e.u", "e.v", "a", "b", "c", "d")


def placed(nodes: DataFrame, labels: DataFrame | None = None, places: DataFrame | None = None) -> DataFrame:
    """Nodes with their labels (id, label) and places (node, x, y, z); those without keep nulls."""
    if labels is not None:
        nodes = nodes.join(labels.select("id", "label"), "id", "left")
    if places is not None:
        nodes = nodes.join(places.select(F.col("node").alias("id"), "x", "y", "z"), "id", "left")
    return nodes


def ranges(df: DataFrame, *names: str) -> DataFrame:
    """(column, least, mean, most) of numeric columns."""
    one = df.agg(*(f(n).cast("double").alias(f"{k}|{n}") for n in names for k, f in (("least", F.min), ("mean", F.avg), ("most", F.max))))
    rows = F.array(*(F.struct(F.lit(n).alias("column"), *(F.col(f"{k}|{n}").alias(k) for k in ("least", "mean", "most"))) for n in names))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def meta(tri: DataFrame, fractions: DataFrame, source: str) -> DataFrame:
    """One row for the viewer: the total of judgements, and the shares of a decomposition (one row)."""
    total = tri.agg(F.sum("total_count").cast("long").alias("n_judgments"), F.count("*").alias("n_triangles"))
    parts = fractions.select(
        F.bround("gradient", 6).alias("frac_explained"),
        F.bround(F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("gradient"))), 6).alias("rel_residual"),
        F.bround("curl", 8).alias("curl_frac"),
        F.bround("harmonic", 8).alias("harmonic_frac"),
    )
    return total.crossJoin(parts).select(F.lit(source).alias("source"), "*", F.lit(True).alias("precomputed"))  # one row each


def isolated(tri: DataFrame, *items: int) -> DataFrame:
    """The triangles within three or four items: one triangle, or the faces of a tetrahedron."""
    return tri.where(F.col("i").isin(*items) & F.col("j").isin(*items) & F.col("k").isin(*items))


def focus(tri: DataFrame, node: int) -> DataFrame:
    """Triangles at one item."""
    return tri.where((F.col("i") == node) | (F.col("j") == node) | (F.col("k") == node))


def filtered(df: DataFrame, **limits: tuple[float, float]) -> DataFrame:
    """Rows whose columns lie within the given ends."""
    for name, (low, high) in limits.items():
        df = df.where(F.col(name).between(low, high))
    return df


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
