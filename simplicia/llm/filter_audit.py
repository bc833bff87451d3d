"""How filters that are applied one after the other interact.

Every document has a mask of the filters that it fails.  For each part and
label the signed parity sums of the masks are aggregated, one for each set of
filters: the sum of -1 to the number of the set's filters that a document
fails.  This is the Walsh-Hadamard transform of the numbers of documents with
each mask, so the same transform gives these numbers back exactly.  From them
follow all orders of the filters, and each filter's Shapley value: of the
orders of n filters, n! / k begin, among the k that a document fails, with a
given one.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simplicia.llm.shared import written


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def rules(text: Column) -> dict[str, Column]:
    """The filters of a text by name; true is a failure.  Texts mustn't be null."""
    ws = words(text)
    return {
        "A": F.size(ws) < 50,
        "B": 100 * F.size(F.array_distinct(ws)) < 65 * F.size(ws),
        "C": 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


#: The filter against exact copies, the last one of an audit.
COPIES = "E"
LABELS = ("good", "toxic")


def masks(docs: DataFrame, labels: DataFrame) -> tuple[list[str], DataFrame]:
    """The filters' names, and (part, mask, good, toxic) of every row of ``docs``: bit k of the mask is filter k's failure.

    Copies are told by SHA-256 of the text.  The first of a group is found by
    a grouped minimum; rows are joined to it by text and id together, so the
    rows of a large group go to as many tasks as they have ids.
    """
    text = F.coalesce("text", F.lit(""))
    found = rules(text)
    bits = sum((F.when(failed, 1 << k).otherwise(0) for k, failed in enumerate(found.values())), F.lit(0))
    rows = written(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), bits.alias("bits")), "audit-rows")
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    joined = rows.join(first, ["digest", "doc_id"], "left").join(known, "doc_id", "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return [*found, COPIES], joined.select("part", (F.col("bits") + F.when(copy, 1 << len(found)).otherwise(0)).alias("mask"), *(F.coalesce(c, F.lit(False)).alias(c) for c in LABELS))


def parity_sums(marked: DataFrame, n: int) -> DataFrame:
    """(part, all, good, toxic): for each set of the n filters the sum of the documents' signs, of all documents and of those with each label."""
    sign = [1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(F.lit(s))) % 2) for s in range(1 << n)]
    kinds = {"all": F.lit(True), **{c: F.col(c) for c in LABELS}}
    sums = marked.groupBy("part").agg(*(F.sum(F.when(belongs, x).otherwise(0).cast("long")).alias(f"{name}{s}") for name, belongs in kinds.items() for s, x in enumerate(sign)))
    return sums.select("part", *(F.array(*(F.col(f"{name}{s}") for s in range(1 << n))).alias(name) for name in kinds))


def inverted(sums: Column, n: int) -> Column:
    """Numbers of documents by mask, from the parity sums."""
    sets = F.sequence(F.lit(0), F.lit((1 << n) - 1))
    sign = lambda m, s: 1 - 2 * (F.bit_count(m.bitwiseAND(s)) % 2)
    return F.transform(sets, lambda m: F.shiftright(F.aggregate(sets, F.lit(0).cast("long"), lambda total, s: total + F.get(sums, s) * sign(m, s)), n))


def _summed(cells: Column, n: int, weight) -> Column:
    """For each set of filters the sum of ``weight(mask, set, number)`` over the masks."""
    sets = F.sequence(F.lit(0), F.lit((1 << n) - 1))
    return F.transform(sets, lambda s: F.aggregate(sets, F.lit(0).cast("long"), lambda total, m: total + weight(m, s, F.get(cells, m))))


def _orders(names: list[str]) -> Column:
    """Every step of every order: the filter's bit, and the sets of filters before and up to it."""
    steps = []
    for order in itertools.permutations(range(len(names))):
        before = 0
        for step, k in enumerate(order, 1):
            steps.append({"filter_order": "".join(names[x] for x in order), "step": step, "bit": 1 << k, "before": before, "upto": before | 1 << k})
            before |= 1 << k
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, bit: int, before: int, upto: int>>")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter does at each step of each order, by part.

    ``docs`` has doc_id, text and source, ``labels`` doc_id, quality and
    toxic; other columns are ignored.  A null text counts as empty; a part is
    a source, null and the empty string are one.  A row without a doc_id is no
    copy and nothing is a copy of it; of rows with one text, those with the
    smallest doc_id, repeated or not, are no copies.  Each row counts.  Of
    repeated labels of an id one that says 1 is enough; a null label says
    nothing.  An empty table has no parts.
    """
    names, marked = masks(docs, labels)
    n = len(names)
    sums = parity_sums(marked, n)
    cells = sums.select("part", *(inverted(F.col(c), n).alias(c) for c in ("all", *LABELS)))
    untouched = lambda m, s, count: F.when(m.bitwiseAND(s) == 0, count).otherwise(0)
    # of a set of one filter: each document that fails it with k - 1 others is its to remove in n! / k orders
    share = lambda m, s, count: F.when(m.bitwiseAND(s) != 0, count * (F.lit(math.factorial(n)) / F.bit_count(m)).cast("long")).otherwise(0)
    parts = cells.select(
        "part",
        F.col("all").alias("cells"),
        *(_summed(F.col(c), n, untouched).alias(f"left_{c}") for c in ("all", *LABELS)),
        _summed(F.col("all"), n, share).alias("shares"),
    )
    rows = parts.withColumn("s", F.explode(_orders(names))).select("*", "s.*")
    lost: Mapping[str, Column] = {c: F.get(f"left_{c}", F.col("before")) - F.get(f"left_{c}", F.col("upto")) for c in ("all", *LABELS)}
    failing = F.get("left_all", F.lit(0)) - F.get("left_all", F.col("bit"))
    return rows.select(
        "part",
        "filter_order",
        "step",
        F.get("left_all", F.col("upto")).alias("kept"),
        lost["all"].alias("removed"),
        (failing - lost["all"]).alias("redundant"),
        F.get("cells", F.col("bit")).alias("unique_fails"),
        lost["good"].alias("good_lost"),
        lost["toxic"].alias("toxic_lost"),
        F.get("shares", F.col("bit")).alias("shapley"),
    )


#: Counts every order and step from the rows of masks, without the transform.
AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN known USING (doc_id)),
cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) x(name, bit)),
orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a JOIN f b ON b.bit <> a.bit JOIN f c ON c.bit NOT IN (a.bit, b.bit) JOIN f d ON d.bit NOT IN (a.bit, b.bit, c.bit)
  JOIN f e ON e.bit = 31 - a.bit - b.bit - c.bit - d.bit),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit, list_sum(bits[1:step]) AS upto, list_sum(bits[1:step]) - bits[step] AS before
  FROM orders, range(1, 6) r(step)),
shares AS (
  SELECT part, bit, sum(CASE WHEN mask & bit <> 0 THEN n * CAST(120 / bit_count(mask) AS BIGINT) ELSE 0 END) AS shapley FROM cells, f GROUP BY part, bit)
SELECT c.part, filter_order, step, CAST(coalesce(sum(n) FILTER (mask & CAST(upto AS INTEGER) = 0), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER (mask & CAST(before AS INTEGER) = 0 AND mask & s.bit <> 0), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (mask & CAST(before AS INTEGER) <> 0 AND mask & s.bit <> 0), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (mask = s.bit), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(good) FILTER (mask & CAST(before AS INTEGER) = 0 AND mask & s.bit <> 0), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(toxic) FILTER (mask & CAST(before AS INTEGER) = 0 AND mask & s.bit <> 0), 0) AS BIGINT) AS toxic_lost,
       CAST(any_value(shapley) AS BIGINT) AS shapley
FROM steps s, cells c JOIN shares h ON h.part = c.part
WHERE h.bit = s.bit
GROUP BY c.part, filter_order, step"""
