"""Memory that the text kernels take in a worker, and their results across slices."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from simplicia.llm import kernel, near_dedup, toxicity
from simplicia.llm.kernel import U64, words_of

TEXTS = [f"word{i % 977} of text {i} " * 60 for i in range(4000)]  # about 4 MB, 1 KB each


def peak_of(run) -> float:
    tracemalloc.start()
    run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


def without_tables(monkeypatch) -> None:
    """As in a new worker."""
    for name in ("_powers", "_inverses", "_prime_powers", "_prime_inverses"):
        monkeypatch.setattr(kernel, name, np.ones(1, getattr(kernel, name).dtype))


def test_words_of_many_texts_take_little_memory(monkeypatch):
    without_tables(monkeypatch)
    column = pa.array(TEXTS)
    assert peak_of(lambda: [w.counts.sum() for w in words_of(column, lower=True)]) < 60


def test_features_of_many_texts_take_little_memory(monkeypatch):
    without_tables(monkeypatch)
    column, known = pa.array(TEXTS), np.arange(2, 8000, 2, dtype=U64)
    assert peak_of(lambda: [toxicity._hits(w, known) for w in words_of(column, lower=True)]) < 100


def test_sketches_of_many_texts_take_little_memory(monkeypatch):
    without_tables(monkeypatch)
    column, rules = pa.array(TEXTS), near_dedup.DedupRules()

    def run():
        for w in words_of(column, lower=True):
            near_dedup.sketch(list(near_dedup.shingle_sets(w, rules.shingle_words)), rules.bands * rules.rows, rules.seed)

    assert peak_of(run) < 60


def test_tables_that_stay_in_a_worker_are_small(monkeypatch):
    without_tables(monkeypatch)
    for _ in words_of(pa.array(TEXTS), lower=True):
        pass
    assert sum(getattr(kernel, name).nbytes for name in ("_powers", "_inverses", "_prime_powers", "_prime_inverses")) < 16e6


def test_hashes_do_not_depend_on_slices_or_on_what_came_before(monkeypatch):
    long = "Fort und fort " * 60_000  # longer than a slice: whole, and beyond the tables so far
    column = pa.array(["short text", None, long, "", *TEXTS[:1500]])
    few = [w for w in words_of(column, lower=True)]
    assert len(few) > 2 and few[-1].last == len(column)
    without_tables(monkeypatch)
    one = [w for w in words_of(column, lower=True, max_bytes=1 << 30)]
    assert len(one) == 1
    assert np.array_equal(np.concatenate([w.hash for w in few]), one[0].hash)
    sets = [s for w in few for s in near_dedup.shingle_sets(w, 5)]
    for a, b in zip(sets, near_dedup.shingle_sets(one[0], 5), strict=True):
        assert np.array_equal(a, b)


def test_hashes_are_the_sums_that_are_documented(monkeypatch):
    without_tables(monkeypatch)
    text = b"ab abc " * 20_000
    start, end = np.array([0, 3, 70_000, 139_993]), np.array([2, 6, 70_002, 139_999])
    got = kernel.span_hashes(kernel.byte_prefix(np.frombuffer(text, np.uint8)), start, end)
    for a, b, h in zip(start.tolist(), end.tolist(), got.tolist()):
        wide = sum(int(kernel._WEIGHT[c]) * pow(kernel._BASE, k, 1 << 64) for k, c in enumerate(text[a:b])) % 2**64
        prime = sum(int(kernel._PRIME_WEIGHT[c]) * pow(kernel._PRIME_BASE, k, kernel._PRIME) for k, c in enumerate(text[a:b])) % kernel._PRIME
        inner = int(kernel.mix(np.array([wide], U64))[0]) + prime * 0xC2B2AE3D27D4EB4F
        assert h == int(kernel.mix(np.array([inner % 2**64], U64))[0])
