"""The command line from files to reports."""

from __future__ import annotations

import gzip
import hashlib
import json

import numpy as np
import pytest

from simplicia.__main__ import main
from simplicia.sources import readers


def test_pairs_to_reports(spark, tmp_path, capsys):
    items = [f"http://x/{n}.jpg" for n in range(8)]
    (tmp_path / "scores.csv").write_text("label,score\n" + "".join(f"{u},{(n * 5) % 9}\n" for n, u in enumerate(items)))
    rows = [(a, b, a if (i + j) % 3 else b) for i, a in enumerate(items) for j, b in enumerate(items) if i < j]
    (tmp_path / "labels.csv").write_text("left,right,label,performer\n" + "".join(f"{a},{b},{c},p\n" for a, b, c in rows))
    files = {k: str(tmp_path / k) for k in ("pairs", "log", "snap")}
    main(["pairs", "--labels", str(tmp_path / "labels.csv"), "--scores", str(tmp_path / "scores.csv"), "--n", "20", "--out", files["pairs"]])
    n = spark.read.parquet(files["pairs"]).count()
    assert 0 < n <= 20
    (tmp_path / "c.yaml").write_text("model:\n  name: mock-q8\n  provider: mock\nrun:\n  seed: 3\n")
    main(["run", "--pairs", files["pairs"], "--log", files["log"], "--limit", "10", "-c", str(tmp_path / "c.yaml"), "--workers", "2"])
    assert readers.judgement_log(spark, files["log"]).count() == 10
    spark.createDataFrame([('{"row": 11, "pair',)], "value string").coalesce(1).write.mode("append").text(files["log"])
    (tmp_path / "items.txt").write_text("".join(f"{n}.jpg\n" for n in range(7)))
    for _ in range(2):
        main(["run", "--pairs", files["pairs"], "--log", files["log"], "--mock", "--items", str(tmp_path / "items.txt")])
        log = readers.judgement_log(spark, files["log"])
        assert log.count() == 2 * n and readers.torn_lines(spark, files["log"]).count() == 0
    assert sorted(r["row"] for r in log.collect()) == list(range(1, 2 * n + 1))
    missing = log.where("error IS NOT NULL").select("error", "model_side").distinct().collect()
    assert not missing or [tuple(r) for r in missing] == [("missing item: 7.jpg", None)]
    main(["sync", "--log", files["log"], "--out", files["snap"]])
    main(["status", "--log", files["log"]])
    main(["analyze", "--log", files["log"], "--out", str(tmp_path / "report")])
    assert "order" in capsys.readouterr().out
    report = spark.read.json(str(tmp_path / "report" / "analysis.json")).first()
    assert set(report["hodge"].asDict()) == {"MODEL", "HUMAN", "ORACLE", "NULL"} and report["n_judgements"] <= 2 * n
    metrics = {r["metric"]: r["value"] for r in spark.read.option("header", True).csv(str(tmp_path / "report" / "summary.csv")).collect()}
    assert metrics["judgements recorded"] == str(2 * n) and "generated" in metrics


def test_slates_to_files(spark, tmp_path):
    (tmp_path / "s.txt").write_text("1 2 3 4;1\n2 3 4;2 3\n1 2 4;4\n")
    main(["convert", str(tmp_path / "s.txt"), "--out", str(tmp_path / "csv")])
    (tmp_path / "index.json").write_text('{"1": ["n1", "a_b"], "2": ["n2", "c"], "4": ["n4", "d"]}')
    main(["decompose", str(tmp_path / "csv"), "--format", "csv", "--labels", str(tmp_path / "index.json"), "--layout", "2", "--out", str(tmp_path / "out")])
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"edge_index", "s1_star", "D2", "D2.parquet", "graph", "concepts", "payload.json", "payload.json.gz"}
    text = "".join(p.read_text() for p in (tmp_path / "out" / "payload.json").glob("part-*"))
    whole = json.loads(text)
    assert list(whole) == ["nodes", "edges", "triangles", "tetrahedra", "meta"]
    assert [n.get("label") for n in whole["nodes"]] == ["a b", "c", "?", "d"] and all("x" in n for n in whole["nodes"])
    assert len(whole["edges"]) == 6 and all(len(t) == 8 for t in whole["triangles"]) and whole["meta"]["n_judgments"] == sum(t[4] for t in whole["triangles"])
    packed = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "out" / "payload.json.gz").glob("part-*.gz"))
    assert json.loads(packed) == whole
    assert json.loads("".join(p.read_text() for p in (tmp_path / "out" / "concepts").glob("part-*"))) == ["?", "a b", "c", "?", "d"]


def test_manifest(spark, tmp_path):
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.csv").write_text("label,score\n")
    digest = hashlib.sha256(b"label,score\n").hexdigest()
    (tmp_path / "m.txt").write_text(f"{digest.upper()}  a.csv\n")
    main(["verify", "--manifest", str(tmp_path / "m.txt"), "--files", str(tmp_path / "files")])
    (tmp_path / "m.txt").write_text(f"{digest}  a.csv\n{digest}  b.csv\n")
    with pytest.raises(SystemExit, match="differ"):
        main(["verify", "--manifest", str(tmp_path / "m.txt"), "--files", str(tmp_path / "files")])


def test_archives_to_payload(spark, tmp_path):
    names = np.array([["n1_0.jpg", "n9_1.jpg", "n3_2.jpg"], ["n3_3.jpg", "n1_4.jpg", "n9_5.jpg"], ["n3_3.jpg", "n3_4.jpg", "n9_5.jpg"], ["n8_0.jpg", "n1_1.jpg", "n3_2.jpg"]])
    np.savez(tmp_path / "a.npz", filenames=names[:2], similarities=np.array([[0.1, 0.9, 0.2], [0.8, 0.3, 0.1]]))
    np.savez(tmp_path / "b.npz", filenames=names[2:], similarities=np.array([[1.0, 0.0, 0.0], [0.5, 0.25, 0.0]]))
    (tmp_path / "index.json").write_text('{"5": ["n1", "a_b"], "2": ["n3", "c"], "7": ["n4", "d"]}')
    main(["decompose", str(tmp_path / "a.npz"), str(tmp_path / "b.npz"), "--format", "npz", "--labels", str(tmp_path / "index.json"), "--out", str(tmp_path / "out")])
    whole = json.loads("".join(p.read_text() for p in (tmp_path / "out" / "payload.json").glob("part-*")))
    # known classes have the index's ids, the others follow the largest among them in order: n8 is 6, n9 is 7
    assert [(n["id"], n["label"]) for n in whole["nodes"]] == [(2, "c"), (5, "a b"), (6, "n8"), (7, "n9")]
    assert [tuple(t[:3]) for t in whole["triangles"]] == [(2, 5, 6), (2, 5, 7)] and whole["meta"]["n_judgments"] == 3
    # the odd one's share is the softmax of the similarity of the other two
    soft = lambda *s: np.exp(s) / np.exp(s).sum()
    first, second = soft(0.1, 0.2, 0.9), soft(0.1, 0.3, 0.8)  # shares of n3, n1, n9: similarities n1-n9, n3-n9, n3-n1
    main(["convert", str(tmp_path / "a.npz"), "--format", "npz", "--labels", str(tmp_path / "index.json"), "--out", str(tmp_path / "csv")])
    row = readers.triangle_csv(spark, str(tmp_path / "csv")).first()
    assert (row["i"], row["j"], row["k"], row["total_count"]) == (2, 5, 6, 2)  # without n8, n9 follows
    expected = (first + second) / 2
    entropy = -(expected * np.log2(expected)).sum() / np.log2(3)
    assert abs(row["agreement"] - (1 - entropy)) < 1e-4
    assert json.loads("".join(p.read_text() for p in (tmp_path / "out" / "concepts").glob("part-*"))) == ["?", "?", "c", "?", "?", "a b", "n8", "n9"]


def test_settings_for_all_verbs(spark, tmp_path):
    items = [f"{n}.jpg" for n in range(6)]
    (tmp_path / "gt.csv").write_text("label,score\n" + "".join(f"{u},{n}\n" for n, u in enumerate(items)))
    (tmp_path / "crowd.csv").write_text("left,right,label,performer\n" + "".join(f"{a},{b},{a},p\n" for i, a in enumerate(items) for b in items[i + 1 :]))
    (tmp_path / "c.yaml").write_text("model:\n  name: mock-q8\ndata:\n  gt_csv: gt.csv\n  crowd_csv: crowd.csv\nrun:\n  seed: 3\n  n_pairs: 9\n  selection: uniform\n  stratify_by_gap: false\n  swap_repeat: false\noutput:\n  dir: here\n  jsonl: j.log\n  parquet: s.parquet\n")
    for verb in (["pairs"], ["run", "--mock"], ["sync"], ["status"], ["analyze"]):
        main([*verb, "-c", str(tmp_path / "c.yaml")])
    assert {p.name for p in (tmp_path / "here").iterdir()} == {"pairs.parquet", "j.log", "s.parquet", "analysis.json", "summary.csv"}
    assert spark.read.parquet(str(tmp_path / "here" / "pairs.parquet")).count() == 9 == spark.read.parquet(str(tmp_path / "here" / "s.parquet")).count()
    main(["pairs", "-c", str(tmp_path / "c.yaml"), "--out", str(tmp_path / "there"), "--n", "4", "--selection", "connected"])
    assert 0 < spark.read.parquet(str(tmp_path / "there" / "pairs.parquet")).count() <= 4
    with pytest.raises(SystemExit, match="--log"):
        main(["status"])
