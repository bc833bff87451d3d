"""What queries move and write: it grows with what they read and return, not with what lies in between."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from simplicia.operators import complexes, eigen, hodge, pairs, reports, sampling, spectral
from simplicia.plans import catalogue, files, fixtures  # noqa: F401 - files adds its queries
from simplicia.sources import readers
from simplicia.streaming import log as stream


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def above(df, *nodes):
    """Shuffles above the first of some nodes: what comes out of it is moved so often."""
    lines = plan(df)
    first = next(n for n, line in enumerate(lines) if any(x in line for x in nodes))
    return [line for line in lines[:first] if "Exchange" in line and "BroadcastExchange" not in line]


def test_pairs_of_a_group_are_made_where_they_are_counted(spark, sf_dir):
    assert above(fixtures.supplier_labels(spark, sf_dir), "Generate", "Join") == []
    assert above(fixtures.supplier_pairs(spark, sf_dir).drop("left_score"), "Generate", "MergeJoin") == []


@pytest.mark.parametrize("width", [1, 3, 128])
def test_pairs_that_share_a_group(spark, width):
    draw = random.Random(3)
    rows = [(g, draw.randrange(-9, 30)) for g in range(40) for _ in range(draw.randrange(6))] + [(None, 1), (None, 2), (3, None)]
    groups = {}
    for g, x in rows:
        if g is not None and x is not None:
            groups.setdefault(g, set()).add(x)
    expected = {}
    for g in sorted(groups):
        for ab in itertools.combinations(sorted(groups[g]), 2):
            expected.setdefault(ab, g)
    table = spark.createDataFrame(rows, "group long, item long").repartition(5)
    found = pairs.sharing_pairs(table, 40, width=width).collect()
    assert len(found) == len(expected) and {(r["a"], r["b"]): r["first"] for r in found} == expected


def hashed(df):
    return [line for line in plan(df) if "Exchange hashpartitioning" in line]


@pytest.fixture
def tables(monkeypatch):
    """Names and columns of the tables that are written in between."""
    seen = []
    for module in (sampling, reports):
        inner = module.written
        monkeypatch.setattr(module, "written", lambda df, name, inner=inner: seen.append((name, df.columns)) or inner(df, name))
    return seen


def judged(spark, n=300):
    """A log, and how many of its rows were made."""
    made = spark.sparkContext.accumulator(0)

    def touch(x):
        made.add(1)
        return x

    rows = [(k, f"{k // 2 % 97}|x", ("as_shown", "swapped")[k % 2], ("left", "right", None)[k % 3], k * 7 % 40, float(k % 5 > 1), None if k % 11 == 0 else float(k % 4 > 0), float(k % 7 > 2), "m-q4", k % 9 / 2, "x" if k % 3 == 2 else None) for k in range(n)]
    names = "row long, pair_id string, presentation string, model_side string, gap int, model_correct double, human_correct double, model_agrees_with_human double, model_name string, latency_s double, error string"
    log = spark.createDataFrame(rows, names).withColumn("human_side", F.lit("left"))
    return log.withColumn("row", F.udf(touch, "long")("row")), made, rows


def test_small_samples_write_no_keys(spark, tables):
    table = spark.range(3000).select(F.concat("id", F.lit("|x")).alias("pair_id"), (F.col("id") % 50).cast("int").alias("gap"))
    assert sampling.uniform(table, 40).count() == 40 and not tables
    found = sampling.stratified(table, 100).collect()
    assert len(found) == len({r["pair_id"] for r in found}) == 100
    assert "unpicked-pairs" not in dict(tables) and "__key" not in dict(tables)["binned-pairs"]
    assert dict(tables)["near"] and sampling.stratified(table.where("false"), 100).count() == 0


def test_bins_of_one_digest_are_whole(spark):
    """Keys that aren't spread at all: every row of a bin has the same one."""
    table = spark.createDataFrame([("same", 2, str(n)) for n in range(90)] + [("other", 9, "x")], "pair_id string, gap int, annotator string")
    found = [(r["gap"], r["annotator"]) for r in sampling.stratified(table, 25).collect()]
    assert sorted(found) == sorted([(2, x) for x in sorted(map(str, range(90)))[:5]] + [(9, "x")])


def test_a_log_is_made_once_for_its_running_counts(spark):
    log, made, rows = judged(spark)
    assert reports.running_accuracy(log).count() == len(rows)
    assert made.value == len(rows)


def test_a_log_is_made_once_for_its_overview(spark):
    log, made, rows = judged(spark)
    assert reports.summary(log).count() >= 9
    assert made.value == len(rows)


def test_a_pair_is_moved_once_for_a_report(spark):
    log, _, rows = judged(spark)
    assert len(hashed(reports.order_consistency(log))) == 1
    assert len(hashed(reports.accuracy(log))) == 1
    assert len(hashed(reports.accuracy_by_gap(log))) == 2
    ok = [r for r in rows if r[3] is not None]
    first = {}
    for r in ok:
        if r[6] is not None:
            first.setdefault(r[1], r)
    bins = ((1, 3, "1-3"), (4, 7, "4-7"), (8, 15, "8-15"), (16, 30, "16-30"), (31, 200, "31+"))
    name = lambda gap: next((b for low, high, b in bins if low <= gap <= high), None)
    one = reports.accuracy(log).first()
    assert (one["n_judgements"], one["n_pairs"]) == (len(ok), len({r[1] for r in ok}))
    assert one["model_accuracy"] == pytest.approx(sum(r[5] for r in ok) / len(ok))
    assert one["human_accuracy"] == pytest.approx(sum(r[6] for r in first.values()) / len(first))
    assert reports.accuracy(log.where("false")).first().asDict() == {"n_judgements": 0, "n_pairs": 0, "model_accuracy": None, "model_human_agreement": None, "model_left_rate": None, "human_accuracy": None}
    firsts = {}
    for r in ok:
        if r[6] is not None and name(r[4]):
            firsts.setdefault(r[1], r)
    for r in reports.accuracy_by_gap(log).collect():
        inside = [x for x in ok if name(x[4]) == r["bin"]]
        people = [x[6] for x in firsts.values() if name(x[4]) == r["bin"]]
        assert (r["n"], r["n_correct"], r["human_n"] or 0, r["human_correct"] or 0) == (len(inside), sum(x[5] for x in inside), len(people), sum(people))


def test_flows_are_moved_once(spark, sf_dir):
    log = fixtures.judgement_log(spark, sf_dir, of=spark.read.schema(fixtures.supplier_pairs(spark, sf_dir).schema).parquet(f"{sf_dir}/nation.parquet"))
    assert len(hashed(pairs.flows(log))) == 1


def test_open_tasks_make_the_pairs_once(spark, sf_dir):
    assert not [line for line in plan(catalogue.tasks_open(spark, sf_dir)) if "lineitem" in line]


def test_no_triangles_are_made_where_there_are_no_holes(spark, monkeypatch):
    """Two cones and a graph with a hole: only the last one's triangles are needed."""
    cone = [(0, v) for v in range(1, 8)] + [(2, 5), (3, 4), (4, 5)]
    ring = [(20, 21), (21, 22), (22, 23), (20, 23), (20, 24), (21, 24)]
    graph = sorted(cone + [(u + 10, v + 10) for u, v in cone[:5]] + ring)
    draw = random.Random(5)
    flow = {label: [draw.gauss(0, 1) for _ in graph] for label in ("model", "null")}
    rows = [(k, u, v, y) for k, ys in flow.items() for (u, v), y in zip(graph, ys, strict=True)]
    seen = []
    inner = complexes.pair_triangles
    monkeypatch.setattr(complexes, "pair_triangles", lambda p: seen.append(sorted((r["u"], r["v"]) for r in p.collect())) or inner(p))
    found = {r["label"]: r for r in hodge.flow_fractions(spark.createDataFrame(rows, "label string, u long, v long, value double")).collect()}
    assert seen == [sorted(ring)]
    at = {e: n for n, e in enumerate(graph)}
    d1, tri = np.zeros((25, len(graph))), [t for t in itertools.combinations(range(25), 3) if {t[:2], t[1:], (t[0], t[2])} <= set(graph)]
    d2 = np.zeros((len(graph), len(tri)))
    for (u, v), n in at.items():
        d1[u, n], d1[v, n] = -1, 1
    for n, (a, b, c) in enumerate(tri):
        d2[at[a, b], n], d2[at[b, c], n], d2[at[a, c], n] = 1, 1, -1
    for label, y in flow.items():
        y = np.array(y)
        for name, m in (("gradient", d1.T), ("curl", d2)):
            fit = m @ np.linalg.lstsq(m, y, rcond=None)[0]
            assert found[label][name] == pytest.approx(fit @ fit / (y @ y), abs=1e-8)


def test_triangles_are_counted_by_missing_pairs(spark):
    draw = random.Random(6)
    for share in (0.0, 0.3, 0.8, 1.0):
        graph = [(f"{c}{u:02}", f"{c}{v:02}") for c in "ab" for u in range(14) for v in range(u) if draw.random() < (share if c == "a" else 0.9)]
        edges = {tuple(sorted(e)) for e in graph}
        names = sorted({x for e in edges for x in e})
        expected = sum({t[:2], t[1:], (t[0], t[2])} <= edges for t in itertools.combinations(names, 3))
        table = spark.createDataFrame(sorted(edges), "u string, v string")
        assert complexes.triangle_count(table).first()["n_triangles"] == expected
    assert complexes.triangle_count(table.where("false")).first()["n_triangles"] == 0


def test_whole_components_need_no_steps(spark, monkeypatch):
    """All triangles of four and of six items, and a part of those of five."""
    whole = [*itertools.combinations(range(4), 3), *itertools.combinations(range(10, 16), 3)]
    part = [t for t in itertools.combinations(range(20, 25), 3) if t != (20, 21, 22)]
    draw = random.Random(7)
    rows = [(*t, draw.random()) for t in (*whole, *part)]
    asked = []
    inner = hodge.project
    monkeypatch.setattr(hodge, "project", lambda m, *a, **k: asked.append(m.select("col").distinct().count()) or inner(m, *a, **k))
    s1, hats = hodge.edge_projection(spark.createDataFrame(rows, "i long, j long, k long, agreement double"))
    assert asked == [len(part)]
    edges = sorted({e for t in (*whole, *part) for e in itertools.combinations(t, 2)})
    d2, y = np.zeros((len(rows), len(edges))), np.array([r[3] for r in rows])
    for n, (i, j, k, _) in enumerate(rows):
        d2[n, edges.index((i, j))], d2[n, edges.index((j, k))], d2[n, edges.index((i, k))] = 1, 1, -1
    x = np.linalg.lstsq(d2, y, rcond=None)[0]
    assert {(r["a"], r["b"]): r["s1_star"] for r in s1.collect()} == pytest.approx(dict(zip(edges, x)), abs=1e-8)
    assert {(r["i"], r["j"], r["k"]): r["residual"] for r in hats.collect()} == pytest.approx({r[:3]: z for r, z in zip(rows, y - d2 @ x)}, abs=1e-8)


def test_components_give_the_kernel(spark, monkeypatch):
    """Four components: three pairs of value 0, and no steps."""
    graph = [(0, 1), (1, 2), (0, 2), (5, 6), (6, 7), (7, 8), (10, 11), (20, 21), (20, 22), (20, 23)]
    matrix = spectral.laplacian(spark.createDataFrame(graph, "u long, v long")).cache()
    values, vectors = eigen.eigenpairs(matrix, 3, without_constant=True)
    assert [(r["k"], r["eigenvalue"], r["steps"]) for r in values.orderBy("k").collect()] == [(1, 0, 0), (2, 0, 0), (3, 0, 0)]
    for r in eigen.residuals(matrix, values, vectors).collect():
        assert r["residual"] < 1e-12 and abs(r["length"] - 1) < 1e-12 and abs(r["total"]) < 1e-12
    found = vectors.toPandas().pivot(index="row", columns="k", values="value").to_numpy()
    assert found.shape == (13, 3) and np.allclose(found.T @ found, np.eye(3))
    values, _ = eigen.eigenpairs(matrix, 5, without_constant=True)  # more than the components give
    dense = np.zeros((24, 24))
    for r in matrix.collect():
        dense[r["row"], r["col"]] += r["value"]
    used = sorted({x for e in graph for x in e})
    expected = np.sort(np.linalg.eigvalsh(dense[np.ix_(used, used)]))[1:6]
    assert np.allclose([r["eigenvalue"] for r in values.orderBy("k").collect()], expected, atol=1e-8)


def test_levels_of_components_without_turns(spark, monkeypatch):
    asked = []
    inner = eigen.eigenpairs
    monkeypatch.setattr(eigen, "eigenpairs", lambda m, *a, **k: asked.append(sorted(r["graph"] for r in m.select("graph").distinct().collect())) or inner(m, *a, **k))
    rows = [(0, 1, 0.3), (1, 2, 0.1), (0, 2, 0.2), (5, 6, 0.0), (6, 7, 0.0), (8, 9, 0.0)]
    phased, fields = spark.createDataFrame(rows, "u long, v long, phase double"), spark.createDataFrame([(0.0,), (2.0,)], "field double")
    assert {(r["field"], r["k"]): r["eigenvalue"] for r in eigen.lowest_levels(phased, fields, 2).collect()} == {(f, k): 0.0 for f in (0.0, 2.0) for k in (0, 1)}
    assert not asked
    found = {(r["field"], r["k"]): r["eigenvalue"] for r in eigen.lowest_levels(phased, fields, 3).collect()}
    assert asked == [[2.0]] and len(found) == 6
    m = np.array([[2, -np.exp(0.6j), -np.exp(0.4j)], [-np.exp(-0.6j), 2, -np.exp(0.2j)], [-np.exp(-0.4j), -np.exp(-0.2j), 2]])
    assert found[2.0, 2] == pytest.approx(np.linalg.eigvalsh(m)[0], abs=1e-8) and found[0.0, 2] == 0


def packed(df):
    """Files of a query's last folder and how many of them are packed."""
    names = [f.rsplit("/", 1)[1] for f in df.inputFiles()]
    return len(names), sum(n.endswith(".gz") for n in names)


@pytest.mark.parametrize("name", ["file_scores_and_labels", "file_log_repair"])
def test_text_in_between_is_packed(spark, sf_dir, monkeypatch, name):
    seen = []
    for reader in ("label_csv", "judgement_log"):
        inner = getattr(readers, reader)
        monkeypatch.setattr(readers, reader, lambda s, path, inner=inner: seen.append(packed(s.read.text(path))) or inner(s, path))
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0
    assert seen and all(n and n == k for n, k in seen)


def test_a_batch_of_done_tasks_moves_no_records(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(n, f"{n % 40}|x", "as_shown") for n in range(80)], "row long, pair_id string, presentation string")
    table = str(tmp_path / "table")
    index = stream.DoneKeys(spark, table)
    first = stream._open(rows, index, 0).collect()
    assert sorted(r["row"] for r in first) == list(range(40))
    index.add(spark.createDataFrame(first), 0)
    again = stream._open(rows, index, 1)
    assert again.count() == 0 and not [line for line in plan(again) if "Join" in line]
    more = rows.union(spark.createDataFrame([(90, "new|x", "as_shown"), (89, "new|x", "as_shown")], rows.schema))
    more = more.union(spark.createDataFrame([(95, None, "as_shown")], rows.schema))
    assert sorted(r["row"] for r in stream._open(more, index, 1).collect()) == [89, 95]
