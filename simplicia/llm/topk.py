"""Exact top-k search by inner product, with MaxScore.

A vector's dimensions are its terms.  Rows are dealt into shards, queries into
blocks; a cell is one shard and one block.  In a cell the largest and smallest
weight of each dimension bound what the dimension can add to a query's score.
For each query the dimensions with the smallest bounds are non-essential as
long as their bounds together stay below the score of the k-th best row found
so far.  The essential postings are traversed for all rows, for queries of
like essential dimensions together; only rows that stay competitive with the
bounds of the rest are probed in the non-essential ones.

Shards are searched in rounds, each of GROWTH times as many shards as all
before it.  The lists of a round are merged, and their k-th scores are the
thresholds that the next round begins with, so a cell sends on few rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simplicia.llm.shared import written

#: Bytes of a shard's and of a block's weights: what a task holds.
CELL_BYTES = 1 << 24
#: Rows of a shard at least, so that small tables still give every core a cell.
LEAST_ROWS = 2048
GROWTH = 16
#: Rows and queries that are multiplied at once.
STEP_ROWS, STEP_QUERIES = 2048, 256
#: Competitive rows are probed one by one where they are fewer than one in so many.
FEW = 256
#: Sums of integers below this are exact in float64.
EXACT = 2.0**53
#: Components beyond this are scaled down where scores are estimated.
HUGE = 2.0**480
MOST = (1 << 63) - 1


def weights(components: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x); infinite where the product is, which ``exact_weight`` is not."""
    with np.errstate(over="ignore"):
        return np.floor(components * scale)


def exact_weight(x: float, scale: float) -> int:
    """floor(scale * x) as an integer of any size."""
    w = np.floor(x * scale)
    return int(w) if np.isfinite(w) else int(x) * int(scale)


def scaled(components: np.ndarray, scale: float) -> tuple[np.ndarray, int]:
    """Weights over a power of two that leaves none beyond HUGE, and the power; 0 for all ordinary vectors."""
    top = float(np.abs(components).max(initial=0.0))
    if top <= HUGE / max(scale, 1.0):
        return weights(components, scale), 0
    shift = int(np.frexp(top)[1]) - 400
    return np.ldexp(components, -shift) * scale, shift


@dataclass
class Found:
    """The best rows so far: place of the query, row id, score (exact), and the score as estimated."""

    query: np.ndarray
    row: np.ndarray
    score: np.ndarray
    near: np.ndarray

    def best(self, k: int) -> "Found":
        """The k best of each query, best first, ties to smaller ids."""
        if self.score.dtype == object:
            order = np.array(sorted(range(len(self.query)), key=lambda i: (self.query[i], -self.score[i], self.row[i])), np.int64)
        else:
            order = np.lexsort((self.row, -self.score, self.query))
        q = self.query[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        order = order[rank < k]
        return Found(self.query[order], self.row[order], self.score[order], self.near[order])

    def raised(self, least: np.ndarray, k: int, error: np.ndarray) -> np.ndarray:
        """The thresholds, raised to the k-th score of the queries that have k rows (``self`` is ordered)."""
        n = np.bincount(self.query, minlength=len(least))
        full = np.flatnonzero(n >= k)
        last = np.cumsum(n)[full] - 1
        out = least.copy()
        out[full] = np.maximum(out[full], self.near[last] - error[full])
        return out


def search_cell(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int, scale: float) -> Found:
    """The k best rows of a shard for each query of a block that may reach its threshold.

    ``rows`` and ``queries`` are components by vector; ``least`` has a score
    below which a query needs no row (-inf for none).
    """
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    w, w_shift = scaled(rows, scale)
    q, q_shift = scaled(queries, scale)
    postings = np.ascontiguousarray(w.T)  # dimension, row
    bound = np.abs(q).sum(1) * np.abs(w).max(initial=0.0)
    # beyond 53 bits a score is only estimated, and computed again in integers where the estimate may do
    wide = bool(w_shift or q_shift or (bound >= EXACT).any())
    error = bound * (w.shape[1] + 8) * 2.0**-51 if wide else np.zeros(len(q))
    least = np.nextafter(np.ldexp(least, -(w_shift + q_shift)), -np.inf) if wide else least.copy()
    high = np.maximum(q * w.max(0), q * w.min(0))
    found = Found(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object if wide else np.int64), np.zeros(0))
    for first in range(0, len(ids), STEP_ROWS):
        part = slice(first, min(first + STEP_ROWS, len(ids)))
        places = np.argsort(high, axis=1, kind="stable")  # least bound first
        below = np.cumsum(np.take_along_axis(high, places, 1), 1) + error[:, None]
        spare = np.zeros(high.shape, bool)
        np.put_along_axis(spare, places, below < least[:, None], 1)
        # no row of the shard reaches the threshold of a query whose dimensions are all non-essential
        asked = np.flatnonzero(~spare.all(1))
        alike = asked[np.lexsort(np.packbits(spare[asked], axis=1).T[::-1])]
        for at in range(0, len(alike), STEP_QUERIES):
            mine = alike[at : at + STEP_QUERIES]
            got = _competitive(q[mine], postings[:, part], spare[mine], high[mine], least[mine], error[mine], ids[part], query_ids[mine], k)
            if not len(got[0]):
                continue
            of, row, near = mine[got[0]], part.start + got[1], got[2]
            score = _exact(queries, rows, of, row, scale) if wide else near.astype(np.int64)
            found = Found(np.concatenate([found.query, of]), np.concatenate([found.row, ids[row]]), np.concatenate([found.score, score]), np.concatenate([found.near, near]))
        found = found.best(k)
        least = found.raised(least, k, error)
    return found


def _competitive(q: np.ndarray, postings: np.ndarray, spare: np.ndarray, high: np.ndarray, least: np.ndarray, error: np.ndarray, ids: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the rows that may reach the thresholds, a query's own row aside."""
    used = ~spare.all(0)
    partial = np.where(spare, 0.0, q)[:, used] @ postings[used]
    first, last = np.searchsorted(ids, query_ids, "left"), np.searchsorted(ids, query_ids, "right")
    own = np.repeat(np.arange(len(q)), last - first)
    partial[own, np.arange(len(own)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + first[own]] = -np.inf
    open_ = np.where(spare, high, 0.0).sum(1)
    need = least - open_ - error
    fresh = np.isneginf(need)  # without a threshold all dimensions are essential, so the sums are whole
    if fresh.any() and partial.shape[1] > k:
        need[fresh] = np.partition(partial[fresh], -k, axis=1)[:, -k] - 2 * error[fresh]
    competitive = partial >= np.maximum(need, np.finfo(float).min)[:, None]
    rest = spare.any(0)
    if rest.any() and competitive.sum() * FEW > competitive.size:
        # many rows stay competitive: the other postings are probed for all of them at once
        partial += np.where(spare, q, 0.0)[:, rest] @ postings[rest]
        competitive = partial >= np.maximum(np.where(fresh, need, least - error), np.finfo(float).min)[:, None]
        rest[:] = False
    query, row = np.nonzero(competitive)
    score = partial[query, row]
    probed = np.flatnonzero(spare.any(1)[query]) if rest.any() else ()
    if len(probed):
        score[probed] += np.einsum("ij,ij->i", np.where(spare, q, 0.0)[query[probed]], postings.T[row[probed]])
        reach = score + error[query] >= least[query]
        query, row, score = query[reach], row[reach], score[reach]
    return query, row, score


def _exact(queries: np.ndarray, rows: np.ndarray, query: np.ndarray, row: np.ndarray, scale: float) -> np.ndarray:
    """Scores of pairs as integers of any size."""
    used_q, at_q = np.unique(query, return_inverse=True)
    used_r, at_r = np.unique(row, return_inverse=True)
    whole = lambda vectors: [[exact_weight(x, scale) for x in v] for v in vectors.tolist()]
    q, r = whole(queries[used_q]), whole(rows[used_r])
    out = np.empty(len(query), object)
    out[:] = [sum(map(int.__mul__, q[i], r[j])) for i, j in zip(at_q, at_r, strict=True)]
    return out


def beyond(score: int) -> bytes | None:
    """Bytes that sort as the scores do which 64 bits can't hold; None for all others."""
    if -MOST - 1 <= score <= MOST:
        return None
    size = abs(score).bit_length() // 8 + 1
    digits = size.to_bytes(2, "big") + abs(score).to_bytes(size, "big")
    return digits if score > 0 else bytes(255 - b for b in digits)


def _components(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with 0."""
    column = column.combine_chunks()
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), width))
    out[np.arange(width) < n[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _searcher(width: int, k: int, scale: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def search(shard: pa.Table, block: pa.Table) -> pa.Table:
        parts = {"q": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64(), "beyond": pa.binary()}
        if not shard.num_rows or not block.num_rows:
            return pa.table({c: pa.array([], t) for c, t in parts.items()})
        numbers = block.column("q").to_numpy()
        query_ids = block.column("query_id").to_numpy()
        least = block.column("least").to_numpy(zero_copy_only=False).astype(float)
        least = np.where(np.isnan(least), -np.inf, least)
        found = search_cell(shard.column("vec_id").to_numpy(), _components(shard.column("v"), width), query_ids, _components(block.column("v"), width), least, k, scale)
        if found.score.dtype == object:
            past = [beyond(s) for s in found.score]
            score = np.array([min(max(s, -MOST - 1), MOST) for s in found.score], np.int64)
        else:
            past, score = [None] * len(found.score), found.score
        arrays = [numbers[found.query], query_ids[found.query], found.row, score, past]
        return pa.table({c: pa.array(x, t) for (c, t), x in zip(parts.items(), arrays, strict=True)})

    return search


def _usable(df: DataFrame) -> DataFrame:
    v = F.transform("v", lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select("vec_id", F.when(finite, v).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query row; a score that 64 bits can't hold is ranked by all its bits."""
    high = F.coalesce(F.when(F.col("score") == MOST, F.col("beyond")), F.lit(b""))
    low = F.coalesce(F.when(F.col("score") == -MOST - 1, F.col("beyond")), F.lit(b"\xff\xff\xff"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.desc(high), F.desc(low), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def top_k(queries: DataFrame, rows: DataFrame, k: int = 20, scale: float = 64.0) -> DataFrame:
    """The k rows of highest integer inner product for each query row.

    Both tables have vec_id (long) and v (an array of numbers); other columns
    are ignored.  A component x weighs floor(scale * x), x and the product as
    double, of any size.  Vectors that are null or hold a null or a non-finite
    component, and rows with a null id, take no part; missing components of
    shorter vectors count as 0.  Rows with a query's vec_id are its own and
    never its answer.  Rows of ``rows`` that repeat are rows each; a vec_id
    that stands in several query rows gets a list of its own, with ranks from
    1, for each of them.

    Returns query_id, rank from 1, vec_id and score, best first, ties to the
    smaller vec_id; fewer than k rows are all returned; empty tables give no
    rows.  Sums are exact at any size; a score beyond 64 bits is ranked by its
    true value and shown as the nearest long.
    """
    spark = rows.sparkSession
    width, n_rows, n_queries = 1, 0, 0
    number = F.monotonically_increasing_id()
    rows = written(_usable(rows).withColumn("at", number), "vectors")
    queries = written(_usable(queries).withColumn("q", number), "queries")
    for df in (rows, queries):
        n, size = df.agg(F.count("*"), F.max(F.size("v"))).first()
        width = max(width, size or 0)
        n_rows, n_queries = (n, n_queries) if df is rows else (n_rows, n)
    most = max(1, CELL_BYTES // (8 * width))
    cores = max(1, spark.sparkContext.defaultParallelism)
    size = min(most, max(LEAST_ROWS, -(-n_rows // (2 * cores))))
    n_shards, n_blocks = max(1, -(-n_rows // size)), max(1, -(-n_queries // most))
    # dealt by place, so that repeated ids and vectors don't gather in one shard
    dealt = rows.select("vec_id", "v", F.pmod(F.xxhash64("at"), F.lit(n_shards)).alias("shard"))
    asked = queries.select("q", F.col("vec_id").alias("query_id"), "v", F.pmod(F.xxhash64("q"), F.lit(n_blocks)).alias("block"))
    best, first, step = None, 0, 1
    while first < n_shards:
        last = min(n_shards, first + step)
        known = asked.withColumn("least", F.lit(None).cast("long"))
        if best is not None:
            # the least long stands for any score below it
            kth = best.where((F.col("rank") == k) & (F.col("score") > -MOST - 1)).select(F.col("q").alias("of"), F.col("score").alias("least"))
            known = asked.join(kth, F.col("q") == F.col("of"), "left").select(*asked.columns, "least")
        cells = known.withColumn("shard", F.explode(F.sequence(F.lit(first), F.lit(last - 1)))).withColumn("shard", F.col("shard").cast("long"))
        held = dealt.where(F.col("shard").between(first, last - 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("block", F.col("block").cast("long"))
        pairs = held.groupBy("shard", "block").cogroup(cells.groupBy("shard", "block"))
        found = pairs.applyInArrow(_searcher(width, k, scale), "q long, query_id long, vec_id long, score long, beyond binary")
        if best is not None:
            found = best.drop("rank").unionByName(found)
        best, first, step = written(_ranked(found, k), "best"), last, last * (GROWTH - 1)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: DuckDB SQL for the registered query.
TOP_K_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM vectors q JOIN vectors r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
