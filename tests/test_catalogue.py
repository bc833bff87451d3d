"""Every registered comparison query against its SQL."""

from __future__ import annotations

from collections import Counter

import duckdb
import numpy as np
import pytest

from simplicia.plans import catalogue, files, fixtures  # noqa: F401 - files adds its queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
#: Their SQL holds for complete complexes only, which the smallest tables lack.
COMPLETE = {"hodge_fractions", "hodge_edge_signal", "hodge_residuals", "file_payload"}
#: The smallest tables have no two suppliers of a nation.
LARGER = COMPLETE | {"hodge_blocks", "hodge_block_edges"}


def normal(row):
    return repr(tuple(round(x, 5) + 0.0 if isinstance(x, float) else float(x) if type(x).__name__ == "Decimal" else x for x in row))


@pytest.mark.parametrize("name", list(catalogue.ORACLE_SQL))
def test_query_is_its_sql(spark, name):
    sf = f"/root/testdata/{'sf0.01' if name in LARGER else 'sf0.001'}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    expected = con.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in expected.description]
    found = catalogue.QUERIES[name](spark, sf)
    assert sorted(found.columns) == sorted(columns)
    assert Counter(map(normal, found.select(columns).collect())) == Counter(map(normal, expected.fetchall()))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES.keys() - catalogue.ORACLE_SQL.keys()))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 2107
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_components_cover_every_line(spark):
    sf = "/root/testdata/sf0.001"
    up: dict[int, int] = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for o, p, s in duckdb.connect().execute(f"SELECT l_orderkey, l_partkey, l_suppkey FROM read_parquet('{sf}/lineitem.parquet')").fetchall():
        a, b = sorted((top(o), top(-(p * 1_000_000 + s) - 1)))
        up[b] = a
    found = {r["node"]: r["component"] for r in catalogue.QUERIES["graph_components"](spark, sf).collect()}
    assert found == {x: top(x) for x in up}


def test_all_pairs_are_judged(spark):
    sf = "/root/testdata/sf0.01"  # 100 suppliers, each pair of which shares a part
    n = 100 * 99 // 2
    assert catalogue.QUERIES["judgement_records"](spark, sf).count() == 2 * n
    assert catalogue.QUERIES["log_status"](spark, sf).first()["n_pairs"] == n
    ties = fixtures.supplier_pairs(spark, sf, scale=fixtures.GAP_SCALE).where("gap = 0").count()
    records = fixtures.judgement_log(spark, sf, scale=fixtures.GAP_SCALE)
    binned = sum(r["n"] for r in catalogue.QUERIES["accuracy_by_gap"](spark, sf).collect())
    assert 0 < ties < n / 10
    assert binned == records.where("model_side IS NOT NULL AND gap > 0").count()


def test_samples_of_a_graph_incomplete_by_its_data(spark, sf_dir):
    pairs = fixtures.part_pairs(spark, sf_dir).select("left_item", "right_item")
    con = duckdb.connect()
    n = con.execute(f"WITH l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM read_parquet('{sf_dir}/lineitem.parquet')) SELECT count(DISTINCT (x.p, y.p)) FROM l x JOIN l y ON x.o = y.o AND x.p < y.p").fetchall()[0][0]
    assert pairs.count() == pairs.distinct().count() == n
    sample = catalogue.QUERIES["pairs_connected"](spark, sf_dir).select("left_item", "right_item")
    assert sample.subtract(pairs).isEmpty() and 3 <= sample.count() <= 200
    assert catalogue.QUERIES["clique_pairs"](spark, sf_dir).count() == 1811  # three quarters of 2,415


def test_spectra_of_all_graphs_and_fields(spark, sf_dir):
    found = catalogue.QUERIES["butterfly"](spark, sf_dir).toPandas()
    each = found.groupby("graph").field.agg(["nunique", "min", "max"])
    assert each.index.tolist() == ["0.02", "0.05", "0.10", "0.30"]
    assert (each["nunique"] == 3000).all() and (each["min"] == 0).all() and np.allclose(each["max"], 50)
    plain = {}  # without a field it is the Laplacian's spectrum
    for r in catalogue.spectral.spectra(catalogue._laplacians(catalogue._graphs(spark))).collect():
        plain.setdefault(r["graph"], []).append(r["eigenvalue"])
    for graph, part in found[found.field == 0].groupby("graph"):
        assert np.allclose(np.sort(part.eigenvalue), np.sort(plain[graph]))
    assert {r["graph"] for r in catalogue.QUERIES["spectral_gaps"](spark, sf_dir).collect()} == set(plain)
