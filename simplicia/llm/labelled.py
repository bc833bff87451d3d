"""Bounded samples of labelled texts, for the classifiers that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplicia.llm.hmm_lm import is_held_out
from simplicia.llm.shared import forget, written


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """text and the label as a boolean of labelled rows outside the held-out fold: a hash sample of ``most`` ids at most.

    A null label or id is ignored; repeated labels of an id count once, the largest.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("value"))
    known = written(known.where(~is_held_out(F.col("doc_id"), 5)).withColumn("key", F.xxhash64(F.lit(label), "doc_id")), "labels")
    # a threshold on the hash leaves slightly more rows than are asked for, so no task sorts many
    share = 1.05 * most / max(known.count(), 1)
    some = known.where(F.col("key") <= int(-(2**63) + share * 2**64)) if share < 1 else known
    some = some.orderBy("key", "doc_id").limit(most)
    # the limit bounds what is broadcast
    some = F.broadcast(some.select(F.col("doc_id").alias("labelled"), (F.col("value") > 0).alias(label)))
    out = written(docs.select("doc_id", "text").join(some, F.col("doc_id") == F.col("labelled")).select("text", label), "labelled-texts")
    forget(known)
    return out
