"""Mixing sources to target weights.

Every document gets a hash-random key.  Within a source the documents are
ordered by that key; equal-width ranges of the key are the sort partitions, so
no sampling is needed and reruns agree.  Sums by range, prefix sums over the
ranges and prefix sums inside the one range that holds the cut find the key
before which a source's documents are taken once more than its whole epochs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simplicia.llm.shared import WORD, fresh, written

SEED = "mix-1"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Rows of a range of keys, about.
RANGE_ROWS = 64
#: Rows with the key of a cut that are numbered together.
TIED_ROWS = 4096
KEY_DIGITS = 32


def _keyed(docs: DataFrame, seed: str, name: str) -> DataFrame:
    """The rows with size and key, under ``name`` and their own names; a null text has size 0."""
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return docs.withColumns({f"{name}size": size, f"{name}key": key})


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> (source, source_size, target), one row per source.

    Sources in code point order, null last, have the given weights in turn.
    The total of all sizes is shared by weight; no target is above
    ``max_epochs`` times its source's size, and what is above goes to the
    others by weight.  In order of size over weight the sources that reach
    their limit come first, which gives the level in one pass.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    by_ratio = Window.orderBy("ratio", F.asc_nulls_last("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    return (
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
        .withColumn("ratio", max_epochs * F.col("source_size") / F.col("weight"))
        .withColumn(
            "level",
            (F.sum("source_size").over(everything) - F.coalesce(max_epochs * F.sum("source_size").over(before), F.lit(0)))
            / F.sum("weight").over(after),
        )
        .withColumn("level", F.max(F.when(F.col("ratio") >= F.col("level"), F.struct(-F.row_number().over(by_ratio), "level"))).over(everything)["level"])
        .select("source", "source_size", F.least(max_epochs * F.col("source_size").cast("double"), F.col("level") * F.col("weight")).alias("target"))
    )


def _holding(sums: DataFrame, found: DataFrame, digits: int) -> DataFrame:
    """(source, prefix, before, rest, words, n): of the longer prefixes within the ones found, the one that holds the cut.

    ``sums`` has source, key (or the beginnings of keys), words and n.
    """
    inside = sums.join(found.select(F.col("source").alias("of"), "prefix", F.col("before").alias("start"), "rest"), F.col("source").eqNullSafe(F.col("of")) & F.startswith("key", "prefix"))
    level = inside.groupBy("source", F.substring("key", 1, digits).alias("prefix")).agg(F.sum("words").alias("words"), F.sum("n").alias("n"), F.first("start").alias("start"), F.first("rest").alias("rest"))
    up_to = Window.partitionBy("source").orderBy("prefix")
    level = level.withColumn("before", F.col("start") + F.sum("words").over(up_to) - F.col("words"))
    return level.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))).select("source", "prefix", "before", "rest", "words", "n")


def _cuts(sized: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """(source, source_size, target, epochs, cut, n, m): keys before cut count once more, and m of the n rows with that key.

    The cut is looked for among the ranges of keys that begin alike, then among
    the ranges of the one that holds it, then among its keys, so a task never
    orders more than the square root of the rows of a source, or the few keys
    of a range.  Rows with one key have one size, and are counted first.
    """
    rows = sized.count()
    digits = max(2, math.ceil(math.log(max(rows, 1) / RANGE_ROWS, 16))) if rows > RANGE_ROWS else 2
    ranges = written(sized.groupBy("source", F.substring("key", 1, digits).alias("key")).agg(F.sum("size").alias("words"), F.count("*").alias("n")), "mix-ranges")
    sources = source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = written(sources.withColumn("epochs", whole).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-sources")
    found = sources.select("source", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"), "rest")
    for level in sorted({digits // 2, digits}):
        found = _holding(ranges, found, level)
    keys = _holding(sized.select("source", "key", F.col("size").alias("words"), F.lit(1).cast("long").alias("n")), written(found, "mix-found"), KEY_DIGITS)
    # a row counts where the middle of its words lies before the cut
    fit = F.floor((F.col("rest") - F.col("before")) / (F.col("words") / F.col("n")) + 0.5).cast("long")
    keys = keys.select(F.col("source").alias("of"), F.col("prefix").alias("cut"), "n", F.least(fit, F.col("n")).alias("m"))
    cuts = sources.join(keys, F.col("source").eqNullSafe(F.col("of")), "left")
    # rounding may leave a whole epoch as the rest
    more = F.when(F.col("cut").isNull() & (F.col("source_size") > 0) & (F.col("rest") >= F.col("source_size")), 1).otherwise(0)
    return cuts.select("source", "source_size", "target", (F.col("epochs") + more).alias("epochs"), "cut", "n", "m")


def _chosen(tied: DataFrame, name: str) -> DataFrame:
    """``tied`` (rows at the cut of their source) with a column ``name``chosen: 1 for m of each n, else 0.

    The rows are dealt into parts by place, m goes to whole parts as long as
    they fit, and the one part after them is numbered.
    """
    at, part, rank, before = (name + c for c in ("at", "part", "rank", "before"))
    tied = written(tied.withColumn(at, F.monotonically_increasing_id()), "mix-tied")
    parts = F.greatest(F.lit(1), F.ceil(F.col(f"{name}n") / F.lit(TIED_ROWS)))
    tied = tied.withColumn(part, F.pmod(F.xxhash64(at), parts))
    sizes = tied.groupBy(F.col(f"{name}source").alias(f"{name}of"), F.col(part).alias(f"{name}in")).agg(F.count("*").alias(f"{name}rows"))
    sizes = sizes.withColumn(before, F.sum(f"{name}rows").over(Window.partitionBy(f"{name}of").orderBy(f"{name}in")) - F.col(f"{name}rows"))
    joined = tied.join(sizes, F.col(f"{name}source").eqNullSafe(F.col(f"{name}of")) & (F.col(part) == F.col(f"{name}in")))
    joined = joined.withColumn(rank, F.row_number().over(Window.partitionBy(f"{name}of", part).orderBy(at)))
    return joined.withColumn(f"{name}chosen", F.when(F.col(before) + F.col(rank) <= F.col(f"{name}m"), 1).otherwise(0))


def _with_copies(keyed: DataFrame, cuts: DataFrame, name: str) -> DataFrame:
    """``keyed`` (rows with source, and size and key under ``name``) with source_size, target and copies under ``name``."""
    split = not cuts.where("m > 0 AND m < n").isEmpty()
    cuts = cuts.select(*(F.col(c).alias(name + c) for c in cuts.columns))
    key, cut, m, n = (F.col(name + c) for c in ("key", "cut", "m", "n"))
    joined = keyed.join(cuts, F.col("source").eqNullSafe(F.col(f"{name}source")))
    at_cut = F.coalesce((key == cut) & (m > 0) & (m < n), F.lit(False))
    plain = joined.withColumn(f"{name}chosen", F.when((key < cut) | ((key == cut) & (m == n)), 1).otherwise(0))
    if split:
        # several rows share the key at which a source is cut
        plain = plain.where(~at_cut).unionByName(_chosen(joined.where(at_cut), name).select(*(F.col(f"`{c}`") for c in plain.columns)))
    return plain.withColumn(f"{name}copies", F.col(f"{name}epochs") + F.col(f"{name}chosen"))


def plan_mix(docs: DataFrame, *, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """How many words of each document the mix takes.

    ``docs`` has doc_id, text and source; other columns are ignored.  Returns
    doc_id, size, source_size, target (the source's) and taken, one row for
    each input row.  The mix takes whole documents: ``floor(target/size)``
    times all of a source and once more those before the cut, so a source is
    at most half a document off its target.  A document without words has
    size and taken 0.  A null source is a source of its own.  Rows that agree
    in doc_id and text share a key; where the cut falls among them, as many of
    them as fit are taken once more, one like the other.  An empty table gives
    no rows.  The table of sources is one row per source and is ranked in one
    task.
    """
    keyed = _keyed(docs.select("doc_id", "text", "source"), seed, "__").drop("text")
    keyed = written(keyed, "mix-sizes")
    cuts = written(_cuts(keyed.select("source", F.col("__size").alias("size"), F.col("__key").alias("key")), weights, max_epochs), "mix-cuts")
    return _with_copies(keyed, cuts, "__").select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).cast("long").alias("taken"),
    )


def mix_documents(docs: DataFrame, *, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mixed documents themselves, with the columns of ``docs``; a document
    that is taken k times stands there k times.  Nulls, ties and repeated rows
    are as in ``plan_mix``; of rows that agree in doc_id and text but differ
    elsewhere, any may be the ones that are taken once more."""
    name = fresh(docs, "__mix_")
    keyed = _keyed(docs, seed, name)
    sized = written(keyed.select("source", F.col(f"{name}size").alias("size"), F.col(f"{name}key").alias("key")), "mix-sizes")
    cuts = written(_cuts(sized, weights, max_epochs), "mix-cuts")
    rows = _with_copies(keyed, cuts, name).where(F.col(f"{name}copies") > 0)
    return rows.withColumn(f"{name}copy", F.explode(F.sequence(F.lit(1), F.col(f"{name}copies").cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))


#: DuckDB SQL for plan_mix over the table documents.
PLAN_MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat_ws('|', 'mix-1', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))) AS key
  FROM documents),
ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 3 * source_size / weight AS ratio FROM ranked),
leveled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY ratio, source NULLS LAST) AS k
  FROM levels),
targets AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), (SELECT arg_min(level, k) FROM leveled WHERE ratio >= level) * weight) AS target
  FROM leveled),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets),
running AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN upto - size / 2 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM running
"""
