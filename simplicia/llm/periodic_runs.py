"""Periodic runs of words, after Ellert and Fischer's runs over ordered alphabets.

A run is a stretch of words that repeats with its smallest period and can't be
extended.  For each of two opposite orders of the words the Lyndon array is
computed: where, from each word on, the next smaller suffix begins.  Every run
is made of copies of such a longest Lyndon word, so extending these words
finds all runs.  The comparisons of suffixes go from left to right and reuse
the match that reaches furthest: within it the comparisons of its earlier copy
hold, so words are compared beyond its end only, and the work is linear.  No
suffix array, no fingerprints: words are numbered by their exact order.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from simplicia.llm.shared import fresh, with_columns_by

Run = tuple[int, int, int]  # start, length, period


@dataclass(frozen=True)
class RunRules:
    #: Words that a run has at least.
    min_length: int = 6
    #: Periods that a run has at least, a whole number from 2 on.
    min_repeats: int = 4


def lyndon_array(w: list[int]) -> tuple[list[int], list[int], int]:
    """For each place the place of the next smaller suffix (len(w) if none) and
    how far the two suffixes agree, and the number of equal words that were compared.

    The places whose next smaller suffix is open are a chain, each linked to the
    previous smaller suffix.  ``ahead`` holds the agreement with the next
    smaller suffix, ``back`` that with the previous smaller one.  The match of
    w[b:r] with w[b - d:r - d] that reaches furthest answers comparisons inside it.
    """
    n = len(w)
    smaller, ahead, previous, back = [n] * n, [0] * n, [-1] * n, [0] * n
    b = r = d = compared = 0
    for i in range(1, n):
        t, common, inside = i - 1, -1, i < r
        last = 0  # agreement of the place that was closed before with its previous smaller suffix
        while True:
            if inside:
                closed = smaller[t - d] == i - d
                found = ahead[t - d] if closed else back[i - d]
                if found < r - i:
                    common, look = found, False
                else:
                    common, look, inside = r - i, True, False
            elif common < 0:
                common, look = 0, True
            elif last != common:
                closed = last > common
                if not closed:
                    common = last
                look = False
            else:
                look = True
            if look:
                x, y = t + common, i + common
                while y < n and w[x] == w[y]:
                    x += 1
                    y += 1
                compared += y - i - common
                common = y - i
                closed = y == n or w[x] > w[y]
                if y >= r:
                    b, r, d = i, y, i - t
            if not closed:
                previous[i], back[i] = t, common
                break
            smaller[t], ahead[t] = i, common
            last, t = back[t], previous[t]
            if t < 0:
                break
            if inside and t < b:
                inside = False
    return smaller, ahead, compared


def runs_of(w: list[int], rules: RunRules = RunRules()) -> list[Run]:
    """All runs of the rules' length and repeats, by start and period.

    The leftmost copy of a run's Lyndon word begins less than a period after
    the run.  So a word is looked at if the text agrees with itself far enough
    after it, its run is extended to the left by less than a period, and later
    copies in the same run are passed over.
    """
    n, least, times = len(w), rules.min_length, rules.min_repeats
    found: set[Run] = set()
    for signed in (w, [-x for x in w]):
        smaller, ahead, _ = lyndon_array(signed)
        done: dict[int, int] = {}  # period: end of its last run
        for i, (j, right) in enumerate(zip(smaller, ahead)):
            p = j - i
            # with less than a period to come on the left
            if right + 2 * p <= max(least, times * p) or j + right <= done.get(p, -1):
                continue
            done[p] = j + right
            x, y = i - 1, j - 1
            while x >= 0 and w[x] == w[y]:
                x -= 1
                y -= 1
            length = j + right - x - 1
            if length >= max(least, times * p):
                found.add((x + 1, length, p))
    return sorted(found, key=lambda run: (run[0], run[2]))


def text_runs(words: list, rules: RunRules = RunRules()) -> list[Run]:
    """Runs of a text's words.

    A word of a run occurs ``min_repeats`` times in it, so words that occur less often
    in a stretch cut it in two, and a run's neighbours that are cut off can't extend it.
    The stretches that remain are searched, as are those that eight rounds of cuts leave,
    so counting stays linear too.
    """
    found: list[Run] = []
    stretches = [(0, words, 0)]
    while stretches:
        start, part, cuts = stretches.pop()
        if len(part) < rules.min_length:
            continue
        counts = Counter(part)
        often = {x for x, n in counts.items() if n >= rules.min_repeats} if cuts < 8 else set(counts)
        if not often:
            continue
        cut = np.flatnonzero(np.fromiter((x not in often for x in part), bool, len(part)))
        if len(cut):
            begin = np.concatenate([[0], cut + 1])
            end = np.concatenate([cut, [len(part)]])
            long = end - begin >= rules.min_length
            stretches += [(start + b, part[b:e], cuts + 1) for b, e in zip(begin[long].tolist(), end[long].tolist())]
        else:
            rank = {x: k for k, x in enumerate(sorted(often))}
            found += [(start + s, length, p) for s, length, p in runs_of([rank[x] for x in part], rules)]
    return sorted(found, key=lambda run: (run[0], run[2]))


def kept_words(words: list, runs: list[Run]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return [words[i] for i in np.flatnonzero(~gone).tolist()]


def strongest(runs: list[Run]) -> Run | None:
    """The run of most repeats, exactly; ties go to the smaller start, then period."""
    best: Run | None = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def repeated_tail(doc_id: int | None, words: list) -> list:
    """The words with the end of the text made periodic, in one of ten texts by crc32 of the id: known runs to find."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * (-(-(n - a) // p)))[: n - a]


RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
_RUN_TYPE = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


def _per_text(docs: DataFrame, added: list[T.StructField], kinds: list[pa.DataType], make: Callable[[list, list[Run]], tuple], rules: RunRules, rewrite: Callable[[int | None, list], list] | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            ids = batch.column(batch.schema.get_field_index("doc_id")) if rewrite is not None else None
            columns: list[list] = [[] for _ in kinds]
            for k in range(batch.num_rows):
                # split() of bytes cuts at the six ASCII white-space characters and nothing else
                words = (texts[k].as_py() or "").encode().split()
                if rewrite is not None:
                    words = rewrite(ids[k].as_py(), words)
                for column, value in zip(columns, make(words, text_runs(words, rules))):
                    column.append(value)
            yield batch, [pa.array(c, t) for c, t in zip(columns, kinds)]

    return with_columns_by(docs, added, run)


def find_runs(docs: DataFrame, rules: RunRules = RunRules(), *, rewrite: Callable[[int | None, list], list] | None = None) -> DataFrame:
    """All columns of ``docs`` with runs, an array of (start, length, period) by start and
    period, and collapsed, the text's words without those that a run repeats, joined by a space.

    Words are cut at ASCII white space, of whole texts.  A null or empty text
    has no runs and collapses to the empty string.  Every row is looked at by
    itself, so repeated rows and ids don't matter.  Where ``docs`` has columns
    of these names, or ones that begin with them, the new ones get underscores
    in front.  ``rewrite`` changes the words of a text before, given its doc_id.
    """
    fields = [T.StructField(fresh(docs, "runs"), RUNS), T.StructField(fresh(docs, "collapsed"), T.StringType())]

    def both(words: list, runs: list[Run]) -> tuple:
        return [{"start": s, "length": n, "period": p} for s, n, p in runs], b" ".join(kept_words(words, runs)).decode()

    return _per_text(docs, fields, [_RUN_TYPE, pa.string()], both, rules, rewrite)


DIGEST = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def run_digests(docs: DataFrame, rules: RunRules = RunRules(), *, rewrite: Callable[[int | None, list], list] | None = repeated_tail) -> DataFrame:
    """doc_id, the number of runs, the strongest run and digests of all runs and of the collapsed text, a row for each row.

    As ``find_runs``, without sending runs and texts on: n_runs; start, length,
    period and exponent_milli (1,000 times length by period, rounded down) of
    the strongest run, null without runs; runs_sha256 of the lines
    start,length,period; collapsed_sha256.  Rows without a doc_id aren't rewritten.
    """
    fields = [T.StructField(c, T.StringType() if c.endswith("sha256") else T.LongType()) for c in DIGEST]

    def digest(words: list, runs: list[Run]) -> tuple:
        best = strongest(runs)
        shown = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        return len(runs), *shown, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept_words(words, runs))).hexdigest()

    kinds = [pa.string() if c.endswith("sha256") else pa.int64() for c in DIGEST]
    return _per_text(docs.select("doc_id", "text"), fields, kinds, digest, rules, rewrite).select("doc_id", *DIGEST)
