"""Samples of pairs.  Order comes from digests of the pair and a seed, so reruns agree on any cluster, and other engines can draw the same samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simplicia.functions import columns as C
from simplicia.tables import written


#: A sample of so many rows is the least of each task and then of all of them, in one pass that moves nothing else.
FEW = 10_000


def first_by_key(rows: DataFrame, n: int, key: str, *ties: str) -> DataFrame:
    """The n rows of the smallest sample keys, exactly, without sorting more than the few whose keys lie around the cut.

    Keys are evenly spread, so counts below two limits around n tell whether the
    cut lies between them; all rows below the lower one are taken as they are.
    """
    if n <= FEW:
        return rows.orderBy(key, *ties).limit(n)
    total = rows.count()
    if n >= total:
        return rows
    unit, around = C.key_unit(F.col(key)), 6 * n**0.5 + 10
    while True:
        low, high = max(0.0, (n - around) / total), min(1.0, (n + around) / total)
        below, upto = rows.agg(F.count_if(unit < low), F.count_if(unit < high)).first()
        if below <= n <= upto:
            break
        around *= 4
    cut = rows.where((unit >= low) & (unit < high)).orderBy(key, *ties).limit(n - below)
    return rows.where(unit < low).unionByName(cut)


def uniform(pairs: DataFrame, n: int | None, *, seed: int = 0) -> DataFrame:
    """n pairs; all of them, shuffled, for None or more than there are.

    Ties of keys, which are pairs of one pair_id, are taken in the order of their human choice and annotator.
    """
    keyed = pairs.withColumn("__key", C.sample_key(seed, F.col("pair_id")))
    if n is not None:
        if n > FEW:
            keyed = written(pairs, "pairs").withColumn("__key", C.sample_key(seed, F.col("pair_id")))
        keyed = first_by_key(keyed, n, "__key", "pair_id", *_ties(pairs))
    return keyed.orderBy("__key", "pair_id").drop("__key")


def _ties(pairs: DataFrame) -> list[str]:
    return [c for c in ("human_choice", "annotator") if c in pairs.columns]


def stratified(pairs: DataFrame, n: int, *, seed: int = 0) -> DataFrame:
    """n pairs, a fifth from each bin of gaps as far as a bin has them, the rest from all others, ties too."""
    ties, key = _ties(pairs), C.sample_key(seed, F.col("pair_id"))
    binned = written(pairs.withColumn("__bin", C.gap_bin(F.col("gap"))), "binned-pairs")
    near = _near_each(binned, n // len(C.GAP_BINS), key)
    ranked = near.withColumn("__n", F.row_number().over(Window.partitionBy("__bin").orderBy("__key", "pair_id", *ties)))
    first = written(ranked.where(F.col("__n") <= n // len(C.GAP_BINS)).drop("__n"), "strata")
    picked = first.select("pair_id")
    rest = binned.join(F.broadcast(picked) if n <= FEW else picked, "pair_id", "left_anti").select(*binned.columns)
    if n > FEW:
        rest = written(rest, "unpicked-pairs")
    more = first_by_key(rest.withColumn("__key", key), max(n - first.count(), 0), "__key", "pair_id", *ties)
    return first.unionByName(more).drop("__bin", "__key")


def _near_each(binned: DataFrame, k: int, key: Column) -> DataFrame:
    """Written rows with __key, among them the k of each bin's least keys, or all that it has, and few others: keys are evenly spread."""
    sizes = {r["__bin"]: r["n"] for r in binned.where("__bin IS NOT NULL").groupBy("__bin").agg(F.count("*").alias("n")).collect()}  # five bins
    around = 6 * k**0.5 + 10
    while True:
        limits = F.create_map(*(F.lit(x) for b, n in sizes.items() for x in (b, min(1.0, (k + around) / n)))) if sizes else F.lit(None).cast("map<string,double>")
        near = written(binned.where("__bin IS NOT NULL").withColumn("__key", key).where(C.key_unit(F.col("__key")) < limits[F.col("__bin")]), "near")
        held = {r["__bin"]: r["n"] for r in near.groupBy("__bin").agg(F.count("*").alias("n")).collect()}
        if all(held.get(b, 0) >= min(k, n) for b, n in sizes.items()):
            return near
        around *= 4


def connected(pairs: DataFrame, n: int, *, block: int = 40, fan_out: int = 20, seed: int = 0) -> DataFrame:
    """About n pairs that share items: a snowball from the item of most pairs.

    Each round accepts some items of the frontier, in hash order, and adds up
    to ``fan_out`` new neighbours of each; it ends once the accepted items
    have n pairs among them.  Then items of fewest pairs go until at most n
    pairs, or three items, are left.  ``n`` is the size of a sampling plan.
    """
    p = written(pairs.where("left_item <> right_item"), "snowball-pairs")
    ends = p.select(F.col("left_item").alias("x"), F.col("right_item").alias("y")).union(p.select(F.col("right_item").alias("x"), F.col("left_item").alias("y"))).distinct()
    ends = written(ends, "snowball-ends")
    seed_item = ends.groupBy("x").agg(F.count("*").alias("d")).orderBy(F.desc("d"), "x").limit(1).select("x")
    chosen = written(seed_item, "chosen")
    frontier = written(ends.join(seed_item, "x", "left_semi").select(F.col("y").alias("x")).distinct(), "frontier")

    def inside(items: DataFrame) -> DataFrame:
        return p.join(items.select(F.col("x").alias("left_item")), "left_item", "left_semi").join(items.select(F.col("x").alias("right_item")), "right_item", "left_semi")

    while inside(chosen).count() < n:
        taken = written(frontier.orderBy(C.sample_key(seed, F.col("x")), "x").limit(block), "taken")
        if taken.isEmpty():
            break
        chosen = written(chosen.union(taken), "chosen")
        fresh = ends.join(taken, "x", "left_semi").join(chosen.select(F.col("x").alias("y")), "y", "left_anti")
        few = fresh.withColumn("k", F.row_number().over(Window.partitionBy("x").orderBy(C.sample_key(seed + 1, F.col("x"), F.col("y")), "y"))).where(F.col("k") <= fan_out)
        frontier = written(frontier.join(taken, "x", "left_anti").union(few.select(F.col("y").alias("x"))).distinct(), "frontier")
    kept = written(inside(chosen), "kept")
    while (size := kept.count()) > n:
        degree = kept.select(F.explode(F.array("left_item", "right_item")).alias("x")).groupBy("x").agg(F.count("*").alias("d"))
        if degree.count() <= 3:
            break
        # drop items of fewest pairs together, as long as their pairs are too many
        order = Window.orderBy("d", "x")
        out = degree.orderBy("d", "x").limit(4 * block).withColumns({"gone": F.sum("d").over(order), "turn": F.row_number().over(order)}).where((F.col("gone") <= size - n) | (F.col("turn") == 1)).select("x")
        stay = degree.join(out, "x", "left_anti").select("x")
        kept = written(kept.join(stay.select(F.col("x").alias("left_item")), "left_item", "left_semi").join(stay.select(F.col("x").alias("right_item")), "right_item", "left_semi"), "kept")
    return kept


def clique_items(pairs: DataFrame, k: int) -> DataFrame:
    """k items with many pairs among them: from the item of most pairs on, always the one with most links to those taken.

    Ties go to the smaller item; if no neighbour is left, the items of most
    pairs follow.  One round an item; k is the size of a sampling plan.
    """
    both = pairs.select(F.col("left_item").alias("x"), F.col("right_item").alias("y")).where("x <> y")
    ends = written(both.union(both.select("y", "x")).distinct(), "clique-ends")
    degree = written(ends.groupBy("x").agg(F.count("*").alias("d")), "clique-degrees")
    taken: list = [r["x"] for r in degree.orderBy(F.desc("d"), "x").limit(1).collect()]
    while 0 < len(taken) < k:
        links = ends.where(F.col("y").isin(taken) & ~F.col("x").isin(taken)).groupBy("x").agg(F.count("*").alias("n"))
        best = links.orderBy(F.desc("n"), "x").limit(1).collect()
        if not best:
            best = degree.where(~F.col("x").isin(taken)).orderBy(F.desc("d"), "x").limit(k - len(taken)).collect()
            if not best:
                break
        taken += [r["x"] for r in best]
    return ends.where(F.col("x").isin(taken)).select(F.col("x").alias("item")).distinct()
