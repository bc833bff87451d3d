"""From judgements to triangles: i < j < k with counts or shares of each item being odd."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simplicia.functions import columns as C


def canonical_counts(judgements: DataFrame) -> DataFrame:
    """Rows (a, b, c, choice: 1-based place of the odd item) to i, j, k, total_count and counts by slot.

    Rows with a null, a choice outside 1..3, or fewer than three distinct items
    are no triangle and are left out; ``rejected`` counts them.
    """
    ok = judgements.where(_is_triangle())
    sorted_ = F.array_sort(F.array("a", "b", "c"))
    slot = F.array_position(F.col("t"), F.element_at(F.array("a", "b", "c"), F.col("choice")))
    rows = ok.withColumn("t", sorted_).select(*(F.col("t")[n].alias(c) for n, c in enumerate("ijk")), slot.alias("slot"))
    return rows.groupBy("i", "j", "k").agg(
        F.count("*").alias("total_count"), *(F.count_if(F.col("slot") == n).alias(f"odd_{c}_count") for n, c in enumerate("ijk", 1))
    )


def _is_triangle() -> Column:
    return F.coalesce((F.col("a") != F.col("b")) & (F.col("a") != F.col("c")) & (F.col("b") != F.col("c")) & F.col("choice").between(1, 3), F.lit(False))


def rejected(judgements: DataFrame) -> DataFrame:
    return judgements.agg(F.count("*").alias("n_rows"), F.count_if(~_is_triangle()).alias("n_rejected"))


def triangles(counts: DataFrame, *, clamp: bool = True, min_total: int = 1) -> DataFrame:
    """Counts to shares p_i, p_j, p_k, Shannon entropy and agreement."""
    shares = counts.where(F.col("total_count") >= min_total).withColumns({f"p_{c}": F.col(f"odd_{c}_count") / F.col("total_count") for c in "ijk"})
    return with_agreement(shares, clamp=clamp)


def with_agreement(shares: DataFrame, *, clamp: bool = True) -> DataFrame:
    h = C.snapped(C.entropy(F.col("p_i"), F.col("p_j"), F.col("p_k")))
    return shares.withColumn("shannon_entropy", h).withColumn("agreement", C.agreement(F.col("shannon_entropy"), clamp=clamp))


def _later(items: Column, of: Column) -> Column:
    """The items of a sorted array after one of them."""
    return F.filter(items, lambda y: y > of)


def slate_counts(slates: DataFrame, *, max_slate: int | None = None) -> DataFrame:
    """Sessions (slate, purchased arrays) to counts of decisive triangles.

    With one of three items purchased that item is odd, with two the third.
    Slates of fewer than three items, before repeats are dropped, and longer
    than ``max_slate`` are left out.  A session becomes a row for each first
    item, then for each pair, so a row never holds more than the slate.
    """
    fit = slates.where(F.size("slate") >= 3)
    if max_slate is not None:
        fit = fit.where(F.size("slate") <= max_slate)
    bought = lambda c: F.array_contains("purchased", F.col(c)).cast("int")
    one = fit.select(F.array_sort(F.array_distinct("slate")).alias("items"), "purchased")
    one = one.select("items", "purchased", F.explode("items").alias("i"))
    two = one.select(_later(F.col("items"), F.col("i")).alias("items"), "purchased", "i").select("items", "purchased", "i", F.explode("items").alias("j"))
    three = two.select(_later(F.col("items"), F.col("j")).alias("items"), "purchased", "i", "j").select("purchased", "i", "j", F.explode("items").alias("k"))
    rows = three.select("i", "j", "k", *(bought(c).alias(f"b{c}") for c in "ijk"))
    total = F.col("bi") + F.col("bj") + F.col("bk")
    decisive = rows.where(total.isin(1, 2)).withColumn("flag", F.when(total == 1, 1).otherwise(0))
    return decisive.groupBy("i", "j", "k").agg(F.count("*").alias("total_count"), *(F.count_if(F.col(f"b{c}") == F.col("flag")).alias(f"odd_{c}_count") for c in "ijk"))


def slate_counters(max_slate: int | None = None) -> dict[str, Column]:
    """Aggregates over sessions (slate, purchased): how many there are, how many are too short or too long, and the items of the longest.

    For ``agg``, or for ``observe`` on the sessions that slate_counts reads.
    """
    size = F.size("slate")
    long = size > max_slate if max_slate is not None else F.lit(False)
    return {"n_sessions": F.count(F.lit(1)), "n_short": F.count_if(size < 3), "n_long": F.count_if(long), "longest": F.coalesce(F.max(size), F.lit(0)).cast("long")}


def soft_triangles(triples: DataFrame, *, temperature: float = 1.0) -> DataFrame:
    """Rows (c0, c1, c2 classes; s01, s02, s12 similarities) to triangles of mean odd shares.

    Shares are softmaxes of similarities, put into the classes' order, averaged
    and made to add up to 1.  Rows with null or equal classes are left out.
    """
    ok = triples.where("c0 <> c1 AND c0 <> c2 AND c1 <> c2")
    p = C.odd_probabilities(*(F.col(s) / temperature for s in ("s01", "s02", "s12")))
    by_class = F.array_sort(F.array(*(F.struct(F.col(f"c{n}").alias("id"), p[n].alias("p")) for n in range(3))))
    rows = ok.select(by_class.alias("t")).select(*(F.col("t")[n]["id"].alias(c) for n, c in enumerate("ijk")), *(F.col("t")[n]["p"].alias(f"p_{c}") for n, c in enumerate("ijk")))
    mean = rows.groupBy("i", "j", "k").agg(F.count("*").alias("total_count"), *(F.avg(f"p_{c}").alias(f"p_{c}") for c in "ijk"))
    total = F.col("p_i") + F.col("p_j") + F.col("p_k")
    return with_agreement(mean.withColumns({f"p_{c}": F.col(f"p_{c}") / total for c in "ijk"}))


def violations(tri: DataFrame) -> DataFrame:
    """How many triangles break an invariant: shares add up to 1, i < j < k."""
    return tri.agg(
        F.count("*").alias("n_triangles"),
        F.count_if(F.abs(F.col("p_i") + F.col("p_j") + F.col("p_k") - 1) > 1e-5).alias("bad_sums"),
        F.count_if(~((F.col("i") < F.col("j")) & (F.col("j") < F.col("k")))).alias("bad_order"),
    )
