"""Logs that are stopped in between, the index of a stream's table, samples drawn twice."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import signal
import subprocess
import sys
import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from simplicia.functions import columns as C
from simplicia.operators import reports, sampling, triplets
from simplicia.sources import readers
from simplicia.streaming.log import DoneKeys, IndexRules


@pytest.fixture
def log(tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    good = [json.dumps({"row": n, "pair_id": f"{n}|x", "presentation": "as_shown"}) for n in range(1, 4)]
    (folder / "part-0.json").write_text("\n".join([*good[:2], "", "5", '"x"', good[2], '{"row": 4, "pa']) + "\n")
    return folder


def rows(spark, log):
    return sorted(r["row"] for r in readers.judgement_log(spark, str(log)).collect())


def test_values_that_are_no_objects_are_torn(spark, log):
    assert readers.torn_lines(spark, str(log)).count() == 3 and rows(spark, log) == [1, 2, 3]
    assert readers.repair_log(spark, str(log)) == 3
    assert readers.torn_lines(spark, str(log)).count() == 0 and rows(spark, log) == [1, 2, 3]
    assert readers.repair_log(spark, str(log)) == 0
    assert sorted(p.name for p in log.parent.iterdir()) == ["log"]


@pytest.mark.parametrize("step", ["good lines unfinished", "good lines written", "log away", "good lines in place"])
def test_a_repair_that_is_stopped_goes_on(spark, log, step):
    """Whatever the point at which a repair ends, the next one finds all records."""
    beside, old = log.parent / "log.repaired", log.parent / "log.torn"
    spark.read.text(str(log)).where(F.col("value").startswith('{"row": ') & F.col("value").endswith("}")).write.text(str(beside))
    if step == "good lines unfinished":
        (beside / "_SUCCESS").unlink()
    if step in ("log away", "good lines in place"):
        shutil.move(log, old)
    if step == "good lines in place":
        shutil.move(beside, log)
    readers.repair_log(spark, str(log))
    assert rows(spark, log) == [1, 2, 3] and not beside.exists() and not old.exists()


def test_a_log_that_is_away_without_its_good_lines_comes_back(spark, log):
    old = log.parent / "log.torn"
    shutil.move(log, old)
    readers.recover_log(spark, str(log))
    assert rows(spark, log) == [1, 2, 3] and not old.exists()


def keys(spark, numbers):
    return spark.createDataFrame([(f"{n}|x", "as_shown") for n in numbers], "pair_id string, presentation string").coalesce(1)


def test_a_batch_reads_no_more_as_the_log_grows(spark, tmp_path):
    table, size = str(tmp_path / "table"), 10
    index = DoneKeys(spark, table, IndexRules(bucket_keys=16, least_buckets=4))
    read = []
    for batch in range(20):
        # half of a batch repeats keys from long ago or of the batch before
        old = [n * 7 % (batch * size) for n in range(size // 2)] if batch else []
        new = index.open_among(keys(spark, [*range(batch * size, (batch + 1) * size), *old]), batch)
        assert sorted(int(r["pair_id"].split("|")[0]) for r in new.collect()) == list(range(batch * size, (batch + 1) * size))
        read.append(index.last_read)
        if batch == 11:
            index.add(new.limit(4), batch)  # a try that ended early
            index = DoneKeys(spark, table, IndexRules(bucket_keys=16, least_buckets=4))
            new = index.open_among(keys(spark, range(batch * size, (batch + 1) * size)), batch)
            assert new.count() == size
        index.add(keys(spark, range(batch * size, (batch + 1) * size)), batch)
    assert index.keys >= 200 and index.buckets >= 16
    assert index._all().distinct().count() == index._all().count() == 200
    # the whole index is some fifty times a bucket; batches read buckets of their own keys, each of bounded size
    assert max(read[10:]) < 2.5 * max(read[3:10])


def test_samples_are_the_smallest_digests(spark):
    names = [f"p{n}" for n in range(3000)]
    table = spark.createDataFrame([(n,) for n in names], "pair_id string").repartition(5)
    digest = lambda n: hashlib.md5(f"3|{n}".encode()).hexdigest()
    for n in (0, 1, 40, 1500, 2999, 3000, 5000):
        found = [r["pair_id"] for r in sampling.uniform(table, n, seed=3).collect()]
        assert found == sorted(names, key=digest)[:n]
    units = {r["pair_id"]: r["u"] for r in table.select("pair_id", C.key_unit(C.sample_key(3, F.col("pair_id"))).alias("u")).collect()}
    assert all(abs(u - int(digest(n)[:8], 16) / 2**32) < 1e-15 for n, u in units.items())


def test_repeated_pairs_are_cut_in_order(spark):
    table = spark.createDataFrame([("same", str(n % 2), str(n)) for n in range(50)], "pair_id string, human_choice string, annotator string").repartition(4)
    found = sampling.uniform(table, 10).collect()
    expected = sorted(((str(n % 2), str(n)) for n in range(50)))[:10]
    assert sorted((r["human_choice"], r["annotator"]) for r in found) == expected


def test_running_accuracy_of_a_whole_log(spark):
    rows = [(n, None if n % 7 == 0 else float(n % 3 == 0)) for n in range(1, 2001)]
    log = spark.createDataFrame(rows, "row long, model_correct double").repartition(6)
    scored = correct = 0
    expected = []
    for n, x in rows:
        scored, correct = scored + (x is not None), correct + int(x or 0)
        expected.append((n, scored, correct))
    assert sorted(map(tuple, reports.running_accuracy(log).collect())) == expected
    assert reports.running_accuracy(log.where("false")).count() == 0


def test_slate_counters_are_observed(spark):
    sessions = spark.createDataFrame([([1, 2], [1]), ([1, 2, 3], [1]), ([1, 1, 2, 3, 4], [2]), (list(range(9)), [1])], "slate array<long>, purchased array<long>")
    seen = Observation()
    counts = triplets.slate_counts(sessions.observe(seen, *(c.alias(n) for n, c in triplets.slate_counters(5).items())), max_slate=5)
    assert counts.agg(F.sum("total_count")).first()[0] == 1 + 3
    assert seen.get == {"n_sessions": 4, "n_short": 1, "n_long": 1, "longest": 9}


STREAM = """
import pathlib, sys, time
from pyspark.sql import SparkSession
from simplicia.streaming import log
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
folder = pathlib.Path(sys.argv[1])
def slow(batch, number):
    (folder / f"begun-{number}").touch()
    time.sleep(5)
    (folder / f"ended-{number}").touch()
query = log.read_log(spark, str(folder / "log"), files_per_trigger=1).writeStream.foreachBatch(slow).option("checkpointLocation", str(folder / "check")).trigger(availableNow=True).start()
print("stopped", log.stop_on_signals(query), flush=True)
"""


@pytest.mark.parametrize("signals", [1, 2])
def test_the_first_signal_ends_after_the_batch_and_the_second_at_once(tmp_path, signals):
    (tmp_path / "log").mkdir()
    for n in range(6):
        (tmp_path / "log" / f"{n}.json").write_text(json.dumps({"row": n, "pair_id": str(n)}))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.Popen([sys.executable, "-c", STREAM, str(tmp_path)], env=os.environ | {"PYTHONPATH": root}, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True)
    try:
        until = time.time() + 120
        while not (tmp_path / "begun-0").exists() and time.time() < until:
            time.sleep(0.1)
        for _ in range(signals):
            run.send_signal(signal.SIGINT)
            time.sleep(1)
        out, _ = run.communicate(timeout=60)
    finally:
        run.kill()
    if signals == 1:
        assert run.returncode == 0 and "stopped True" in out
        assert (tmp_path / "ended-0").exists() and not (tmp_path / "ended-5").exists()
    else:
        assert run.returncode == 130 and not (tmp_path / "ended-0").exists()
