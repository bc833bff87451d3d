"""Judged pairs: building, tasks, records and flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simplicia.functions import columns as C


#: Items whose scores go to every task; pairs then stay where they are, and with more items both are shuffled.
MOST_SCORES = 500_000


def sharing_pairs(members: DataFrame, n_items: int, *, width: int = 128) -> DataFrame:
    """(a, b, first), a < b: all pairs of items that share a group, with the least one; members has group and item, a whole number.

    A group's items go as one sorted list to each block of ``width`` numbers
    that some of them lie in, from there on; all pairs that begin in a block
    are made and counted where it is.  So lists are shuffled, not the pairs of
    every group, of which most are repeats.  Pairs are sorted within a task.
    ``n_items`` is about how many items there are.
    """
    lists = members.where("group IS NOT NULL").groupBy("group").agg(F.array_sort(F.collect_set("item")).alias("m")).where(F.size("m") > 1)
    block = lambda x: F.floor(x / width)
    sent = lists.select("group", "m", F.explode(F.array_distinct(F.transform("m", block))).alias("block"))
    sent = sent.select("group", "block", F.filter("m", lambda x: x >= F.col("block") * width).alias("m"))
    sent = sent.withColumn("n", F.size(F.filter("m", lambda x: x < (F.col("block") + 1) * width)))
    dealt = sent.repartition(max(1, -(-n_items // width)), "block")
    begun = dealt.select("group", "block", "m", F.posexplode(F.slice("m", F.lit(1), F.col("n"))).alias("at", "a"))
    both = begun.select("group", "block", "a", F.explode(F.slice("m", F.col("at") + 2, F.size("m"))).alias("b"))
    return both.groupBy("block", "a", "b").agg(F.min("group").alias("first")).select("a", "b", "first").sortWithinPartitions("a", "b")


def build_pairs(labels: DataFrame, scores: DataFrame) -> DataFrame:
    """Labels (left, right, choice, annotator) with the scores (item, score) of both items.

    Pairs without both scores are left out.  A choice other than the left item
    counts as right; human_correct is null for ties and unjudged pairs.
    """
    if scores.limit(MOST_SCORES + 1).count() <= MOST_SCORES:
        scores = F.broadcast(scores)
    left = scores.select(F.col("item").alias("left_item"), F.col("score").alias("left_score"))
    right = scores.select(F.col("item").alias("right_item"), F.col("score").alias("right_score"))
    rows = labels.select(F.col("left").alias("left_item"), F.col("right").alias("right_item"), "choice", "annotator")
    rows = rows.join(left, "left_item").join(right, "right_item")
    side = F.when(F.col("choice").isNotNull(), F.when(F.col("choice") == F.col("left_item"), "left").otherwise("right"))
    out = rows.select(
        C.pair_id(F.col("left_item"), F.col("right_item")).alias("pair_id"),
        "left_item",
        "right_item",
        "left_score",
        "right_score",
        F.abs(F.col("left_score") - F.col("right_score")).alias("gap"),
        C.larger_side(F.col("left_score"), F.col("right_score")).alias("true_side"),
        side.alias("human_side"),
        F.col("choice").alias("human_choice"),
        "annotator",
    )
    return out.withColumn("human_correct", _correct("human_side"))


def _correct(side: str) -> Column:
    return F.when(F.col("true_side") != "tie", C.equal_or_null(F.col(side), F.col("true_side")))


def clique_pairs(items: DataFrame, labels: DataFrame, *, keep: float = 1.0, seed: int = 0) -> DataFrame:
    """All pairs of a bounded set of items (item), a share of them kept and sides chosen by digests, with labels where judged.

    Input for build_pairs.  The number of items is the size of a sampling plan,
    some hundreds; the pairs of all of them are what it asks for.
    """
    a, b = items.select(F.col("item").alias("a")), items.select(F.col("item").alias("b"))
    pairs = a.join(b, F.col("a") < F.col("b"))
    n = pairs.count()
    if keep < 1:
        pairs = pairs.orderBy(C.sample_key(seed, F.col("a"), F.col("b")), "a", "b").limit(max(3, int(n * keep)))
    swap = C.key_unit(C.sample_key(seed + 1, F.col("a"), F.col("b"))) >= 0.5
    known = labels.groupBy(F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b")).agg(F.max_by(F.struct("choice", "annotator"), F.struct("annotator", "choice")).alias("hit"))
    return pairs.join(known, ["a", "b"], "left").select(
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("left"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("right"), "hit.choice", "hit.annotator"
    )


def tasks(pairs: DataFrame, *, swap_repeat: bool = True) -> DataFrame:
    """One row for each pair and presentation."""
    kinds = ["as_shown", "swapped"] if swap_repeat else ["as_shown"]
    return pairs.withColumn("presentation", F.explode(F.array(*map(F.lit, kinds))))


def open_tasks(all_tasks: DataFrame, log: DataFrame, *, retry_errors: bool = False) -> DataFrame:
    """Tasks that the log doesn't hold; a record with an error counts as done unless it is to be retried."""
    done = log.where("error IS NULL") if retry_errors else log
    return all_tasks.join(done.select("pair_id", "presentation").distinct(), ["pair_id", "presentation"], "left_anti")


def side_of(choice: Column, presentation: Column) -> Column:
    """The side that the first or second shown item stood on."""
    swapped = presentation == "swapped"
    return F.when(choice == 1, F.when(swapped, "right").otherwise("left")).when(choice == 2, F.when(swapped, "left").otherwise("right"))


def records(answered: DataFrame) -> DataFrame:
    """Tasks with choice (1, 2 or null), confidence and error to judgement records."""
    rows = answered.withColumn("model_side", side_of(F.col("choice"), F.col("presentation")))
    return rows.withColumns(
        {
            "model_choice": F.when(F.col("model_side") == "left", F.col("left_item")).when(F.col("model_side") == "right", F.col("right_item")),
            "model_correct": _correct("model_side"),
            "model_agrees_with_human": C.equal_or_null(F.col("model_side"), F.col("human_side")),
        }
    ).drop("choice")


def mock_answers(all_tasks: DataFrame, *, accuracy: float = 0.78, bias: float = 0.06, seed: int = 0) -> DataFrame:
    """Answers of a judge that is right with a given probability and else wrong, and sometimes says 1 whatever it sees.

    Ties answer 2.  Draws are hashes of seed, pair and presentation, so reruns agree.
    """
    swapped = F.col("presentation") == "swapped"
    first, second = F.when(swapped, F.col("right_score")).otherwise(F.col("left_score")), F.when(swapped, F.col("left_score")).otherwise(F.col("right_score"))
    truth = F.when(first > second, 1).otherwise(2)
    draw = lambda k: C.hash_unit(seed + k, F.col("pair_id"), F.col("presentation"))
    answer = F.when(draw(1) < bias, 1).when(draw(0) < accuracy, truth).otherwise(3 - truth)
    return all_tasks.withColumns({"choice": answer, "model_confidence": F.round(0.5 + draw(2) / 2, 3), "error": F.lit(None).cast("string")})


def flows(log: DataFrame) -> DataFrame:
    """Flows (label, u, v, value), u < v, of the model's mean vote, the human's choice and the true order.

    Positive: the larger item is chosen.  Of two orientations of a pair the
    smaller pair_id counts; an unjudged pair has human flow 0.
    """
    vote = F.when(F.col("model_side") == "right", 1.0).otherwise(-1.0)
    human = F.min(F.struct("human_side")) if "row" not in log.columns else F.min_by("human_side", F.when(F.col("human_side").isNotNull(), F.col("row")))
    u, v = F.least("left_item", "right_item").alias("u"), F.greatest("left_item", "right_item").alias("v")
    used = [c for c in ("pair_id", "left_item", "right_item", "left_score", "right_score", "human_side", "model_side", "row") if c in log.columns]
    by_pair = (
        log.where("model_side IS NOT NULL AND left_item <> right_item")
        .select(*used, u, v)
        .repartition("u", "v")  # once, for both steps
        .groupBy("u", "v", "pair_id", "left_item", "right_item")
        .agg(F.avg(vote).alias("model"), F.min("left_score").alias("ls"), F.min("right_score").alias("rs"), human.alias("human_side"))
    )
    if "row" not in log.columns:
        by_pair = by_pair.withColumn("human_side", F.col("human_side.human_side"))
    flip = F.when(F.col("left_item") < F.col("right_item"), 1.0).otherwise(-1.0)
    judged = F.when(F.col("human_side") == "right", 1.0).when(F.col("human_side") == "left", -1.0).otherwise(0.0)
    both = by_pair.groupBy("u", "v").agg(
        F.min_by(F.struct((flip * F.col("model")).alias("model"), (flip * judged).alias("human"), (flip * F.signum(F.col("rs") - F.col("ls"))).alias("oracle")), "pair_id").alias("f")
    )
    parts = F.array(*(F.struct(F.lit(k).alias("label"), F.col(f"f.{k}").alias("value")) for k in ("model", "human", "oracle")))
    return both.select("u", "v", F.explode(parts).alias("p")).select("p.label", "u", "v", "p.value")


def random_flow(pairs: DataFrame, *, seed: int = 0) -> DataFrame:
    """+1 or -1 by a bit of each pair's (u, v) digest: the control of a report."""
    return pairs.select(F.lit("null").alias("label"), "u", "v", F.when(C.key_unit(C.sample_key(seed, F.col("u"), F.col("v"))) < 0.5, 1.0).otherwise(-1.0).alias("value"))
