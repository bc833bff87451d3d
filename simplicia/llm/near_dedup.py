"""MinHash near-deduplication with fast similarity sketches.

Every text becomes its set of five-word shingles.  Sketching throws all
shingles of a set into bins, round after round: in the first T rounds at
random, in round T + i all into bin i.  A bin keeps the smallest value of the
first round that reached it.  So all T coordinates are filled after 2T rounds
at most, a few rounds for most texts, and the share of equal coordinates of two
sets is concentrated around their similarity as with independent MinHash.

Bands of coordinates give candidate pairs, which are confirmed on the full
sets.  Texts with equal sets are one representative from the start.  A
bucket's texts are first compared with the bucket's smallest one; what that
connects needs no further comparison.  Of pairs that are still in different
components, those go on to the full sets that three bounds leave open: the
number of shingles that each shares with any other such text, the triangle
inequality, which the Jaccard distance obeys, with the distances to the
bucket's smallest text, and the sketches (a few bits of every coordinate, which
tell more than one band does).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplicia.llm.kernel import U64, Words, mix, windows, words_of
from simplicia.llm.shared import fresh, written


@dataclass(frozen=True)
class DedupRules:
    shingle_words: int = 5
    #: Link where 100 * intersection >= percent * union.
    percent: int = 75
    #: A pair at the limit is missed with probability (1 - 0.75**rows)**bands = 4e-6.
    bands: int = 64
    rows: int = 6
    seed: int = 7
    #: Bits of each coordinate that are compared.
    bits: int = 4
    #: A pair is given up if its sketches differ by so many standard deviations more than those
    #: of a pair at the limit; one at the limit is, with probability 3.4e-6.
    deviations: float = 4.5

    @property
    def most_bits(self) -> int:
        """How many bits of two sketches may differ."""
        n, j = self.bands * self.rows, self.percent / 100
        spread = math.sqrt(n * j * (1 - j)) * self.bits / 2, math.sqrt(n * (1 - j) * self.bits) / 2
        return math.floor(n * self.bits * (1 - j) / 2 + self.deviations * math.hypot(*spread))


def shingle_sets(w: Words, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text, as 64-bit hashes."""
    h, at = windows(w, width)
    cut = np.searchsorted(at, w.word_at)
    for i, n in enumerate(w.counts):
        if n >= width:
            s = np.sort(h[cut[i] : cut[i + 1]])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif n:
            few = np.full(1, n, U64)
            for x in w.hash[w.word_at[i] : w.word_at[i + 1]]:
                few = few * U64(0xD1342543DE82EF95) + x
            yield mix(few)
        else:
            yield np.zeros(0, U64)


def sketch(sets: list[np.ndarray], size: int, seed: int) -> np.ndarray:
    """A row of ``size`` filled coordinates for each set that isn't empty (empty sets: all zero)."""
    out = np.zeros((len(sets), size), U64)
    sizes = np.array([len(s) for s in sets], np.int64)
    items = np.concatenate(sets) if len(sets) else np.zeros(0, U64)
    of = np.repeat(np.arange(len(sets)), sizes)
    empty_cell = U64(2**64 - 1)
    cells = np.full(len(sets) * size, empty_cell, U64)
    for turn in range(2 * size):
        if not len(items):
            break
        h = mix(items + U64((turn + 1) * 0x9E3779B97F4A7C15 + seed & (2**64 - 1)))
        # the upper half chooses the bin, the lower half is the value within the round
        column = ((h >> U64(32)) * U64(size) >> U64(32)).astype(np.int64) if turn < size else turn - size
        cell = of * size + column
        value = U64(turn << 32) | (h & U64(0xFFFFFFFF))
        open_ = cells[cell] > U64(turn << 32)
        np.minimum.at(cells, cell[open_], value[open_])
        left = (cells == empty_cell).reshape(len(sets), size).any(1)
        still = left[of]
        items, of = items[still], of[still]
    filled = sizes > 0
    out[filled] = cells.reshape(len(sets), size)[filled]
    return out


def band_keys(sketches: np.ndarray, rows: int) -> np.ndarray:
    """One key for each band of ``rows`` coordinates; bands have different keys."""
    n, size = sketches.shape
    parts = mix(sketches).reshape(n, size // rows, rows)
    key = np.broadcast_to(mix(np.arange(1, size // rows + 1, dtype=U64)), parts.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * U64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key


def low_bits(sketches: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` bits of each coordinate, scrambled, packed into 64-bit words."""
    h = mix(sketches ^ U64(0xA24BAED4963EE407))
    planes = np.stack([(h >> U64(k)) & U64(1) for k in range(bits)], 2).astype(np.uint8).reshape(len(sketches), -1)
    return np.packbits(np.pad(planes, ((0, 0), (0, -planes.shape[1] % 64))), axis=1).view(U64)


def _list_array(rows: np.ndarray) -> pa.Array:
    n, k = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(rows.reshape(-1).view(np.int64)))


def _signatures(docs: DataFrame, rules: DedupRules) -> DataFrame:
    """doc_id, n_shingles, two digests of the set, band keys and low bits of the sketch (zero for an empty set)."""
    kind = dict(docs.dtypes)["doc_id"]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, keys, bits = [], [], [], [], []
            for w in words_of(batch.column("text"), lower=True):
                sets = list(shingle_sets(w, rules.shingle_words))
                for into, digest in zip((n, a, b), _digests(sets), strict=True):
                    into.append(digest)
                made = sketch(sets, rules.bands * rules.rows, rules.seed)
                keys.append(band_keys(made, rules.rows))
                bits.append(low_bits(made, rules.bits))
            n, a, b = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((n, np.int64), (a, U64), (b, U64)))
            keys, bits = (np.concatenate(x) if x else np.zeros((0, 1), U64) for x in (keys, bits))
            arrays = [batch.column("doc_id"), pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), _list_array(keys), _list_array(bits)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "a", "b", "bands", "bits"])

    return docs.select("doc_id", "text").mapInArrow(signed, f"doc_id {kind}, n long, a long, b long, bands array<long>, bits array<long>")


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two digests of each set."""
    return np.array([len(s) for s in sets], np.int64), np.array([mix(s).sum() for s in sets], U64), np.array([mix(s ^ U64(0x5851F42D4C957F2D)).sum() for s in sets], U64)


def _full_sets(docs: DataFrame, rules: DedupRules) -> DataFrame:
    """rep, shingles: the sorted set of each representative, from those of its texts that have its digests a and b."""
    kind = dict(docs.dtypes)["rep"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words_of(batch.column("text"), lower=True):
                sets = list(shingle_sets(w, rules.shingle_words))
                part = batch.slice(w.first, w.last - w.first)
                _, a, b = _digests(sets)
                mine = (a == part.column("a").to_numpy().view(U64)) & (b == part.column("b").to_numpy().view(U64))
                sets = [s for s, fits in zip(sets, mine, strict=True) if fits]
                at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                values = pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([part.column("rep").filter(pa.array(mine)), pa.ListArray.from_arrays(pa.array(at), values)], ["rep", "shingles"])

    return docs.select("rep", "a", "b", "text").mapInArrow(made, f"rep {kind}, shingles array<long>")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y), the size of their sets' intersection, both, and that of their union, all."""
    left = sets.select(F.col("rep").alias("x"), F.col("shingles").alias("sx"))
    right = sets.select(F.col("rep").alias("y"), F.col("shingles").alias("sy"))
    both = F.size(F.array_intersect("sx", "sy"))
    found = pairs.join(left, "x").join(right, "y").select("x", "y", both.alias("both"), (F.size("sx") + F.size("sy")).alias("all"))
    return found.withColumn("all", F.col("all") - F.col("both"))


def _linked(compared: DataFrame, percent: int) -> DataFrame:
    return compared.where(100 * F.col("both") >= percent * F.col("all")).select("x", "y")


def _across(rest: DataFrame, sets: DataFrame, bits: DataFrame, rules: DedupRules) -> DataFrame:
    """Pairs (x, y) of one bucket and two components that no bound rules out, each once.

    ``rest`` has bucket, rep, n, component, and distance, to the bucket's leader.
    """
    own = rest.groupBy("rep").agg(F.collect_list("bucket").alias("buckets"))
    items = sets.join(own.select("rep"), "rep").select("rep", F.explode("shingles").alias("shingle"))
    lone = items.groupBy("shingle").agg(F.count("*").alias("k"), F.min("rep").alias("rep")).where("k = 1").groupBy("rep").agg(F.count("*").alias("lone"))
    known = written(own.join(lone, "rep", "left").join(bits, "rep").withColumn("lone", F.coalesce("lone", F.lit(0))), "bounds")
    rest = rest.join(known, "rep").withColumn("held", F.col("n") - F.col("lone")).where(100 * F.col("held") >= rules.percent * F.col("n"))
    one, two = (rest.select("bucket", *(F.col(c).alias(f"{c}_{k}") for c in rest.columns if c != "bucket")) for k in "xy")
    words = -(-rules.bands * rules.rows * rules.bits // 64)
    differ = sum((F.bit_count(F.col("bits_x")[k].bitwiseXOR(F.col("bits_y")[k])) for k in range(words)), F.lit(0))
    most = F.least("held_x", "held_y")
    near = (
        (F.col("rep_x") < F.col("rep_y"))
        & (F.col("component_x") != F.col("component_y"))
        & (100 * most >= rules.percent * (F.col("n_x") + F.col("n_y") - most))
        & (F.abs(F.col("distance_x") - F.col("distance_y")) <= 1 - rules.percent / 100 + 1e-9)
        & (differ <= rules.most_bits)
        # of the buckets that both are in, the pair comes from the first
        & (F.array_min(F.array_intersect("buckets_x", "buckets_y")) == one["bucket"])
    )
    return one.join(two, (one["bucket"] == two["bucket"]) & near).select(F.col("rep_x").alias("x"), F.col("rep_y").alias("y"))


def components(edges: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(node, component): the smallest node that each node of an edge can reach.

    In turns, every node's larger neighbours are linked to its smallest one
    (large star), then its smaller neighbours with itself (small star), until
    nothing changes; the number of rounds grows with the logarithm of the
    longest chain.  Edges stay distributed and are written after each round.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            around = e.select("x", "y").union(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        else:
            around = e.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
        least = around.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("x", "m"))
        joined = around.join(least, "x")
        moved = joined.where(F.col("y") > F.col("x")) if large else joined
        out = moved.select(F.col("y").alias("x"), F.col("m").alias("y"))
        if not large:
            out = out.union(least.select("x", F.col("m").alias("y")))
        return out.where("x <> y").distinct()

    now = written(edges.select(F.greatest(x, y).alias("x"), F.least(x, y).alias("y")).where("x <> y").distinct(), "edges")
    seen = None
    while True:
        now = written(star(star(now, True), False), "stars")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("x").alias("node"), F.col("y").alias("component"))
        seen = mark


def find_components(docs: DataFrame, rules: DedupRules = DedupRules()) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    ``docs`` has doc_id and text; other columns are ignored.
    A-Z are lower-cased.  A text with fewer words than a shingle is one
    shingle; a null text or one without words has an empty set and is linked
    with nothing.  Two texts are linked where 100 * intersection >= percent *
    union; component_id is the smallest doc_id that links reach.  Repeated
    rows of a doc_id stay rows; where they hold different texts, the document
    is linked with whatever one of its texts is.  Rows with a null doc_id come
    back with a null component.  Shingles are compared by 64-bit hashes, sets by 128-bit
    digests.  No bucket is capped, and no pair of equal sets is ever made.
    """
    signed = written(_signatures(docs, rules), "signatures")
    filled = signed.where("n > 0 AND doc_id IS NOT NULL")
    reps = filled.groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("bands", "bits"), "doc_id").alias("sketch"))
    reps = written(reps.select("n", "a", "b", "rep", "sketch.bands", "sketch.bits"), "representatives")
    # a doc_id may stand for several texts; then the texts' digests tell them apart
    texts_of = filled.select("doc_id", "n", "a", "b").groupBy("doc_id").agg(F.min(F.struct("n", "a", "b")).alias("one"), F.max(F.struct("n", "a", "b")).alias("other")).where("one <> other")
    several = not texts_of.isEmpty()
    if several:
        reps = written(reps.withColumn("rep", F.struct(F.col("rep").alias("doc_id"), "a", "b")), "representatives")
    doc_id = F.col("rep.doc_id") if several else F.col("rep")

    # Buckets of one text alone need no comparison.
    rows = reps.where("n > 1").select("rep", "n", F.explode("bands").alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("k"), F.min("rep").alias("leader")).where("k > 1").drop("k")
    shared = written(rows.join(buckets, "bucket").select("bucket", "rep", "n", "leader"), "buckets")

    needed = reps.join(shared.select("rep").distinct(), "rep").select("rep", doc_id.alias("of"), "a", "b")
    texts = docs.select(F.col("doc_id").alias("of"), "text").join(needed, "of")
    sets = written(_full_sets(texts, rules).dropDuplicates(["rep"]), "sets")

    stars = shared.where("rep <> leader").select(F.col("leader").alias("x"), F.col("rep").alias("y")).distinct()
    compared = written(_compared(stars, sets), "stars")
    first = _linked(compared, rules.percent)
    label = components(first).select(F.col("node").alias("rep"), "component")
    marked = shared.join(label, "rep", "left").withColumn("component", F.coalesce("component", "rep"))

    # Only buckets that still hold several components are looked at again, and
    # in them only pairs across components that the leader has not settled.
    mixed = marked.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    distances = compared.select(F.col("x").alias("leader"), F.col("y").alias("rep"), (1 - F.col("both") / F.col("all")).alias("distance"))
    rest = marked.where("rep <> leader").join(mixed, "bucket").join(distances, ["leader", "rep"]).select("bucket", "rep", "n", "component", "distance")
    across = _across(written(rest, "unsettled"), sets, reps.select("rep", "bits"), rules)
    second = _linked(_compared(across, sets), rules.percent)
    links = first.union(second)
    if several:
        # all texts of a document with that of its smallest digests
        every = filled.join(texts_of, "doc_id").select("one", "n", "a", "b").distinct().join(reps.select("n", "a", "b", "rep"), ["n", "a", "b"])
        least = every.where(F.col("one") == F.struct("n", "a", "b")).select("one", F.col("rep").alias("x")).distinct()
        links = links.union(every.join(least, "one").where("x <> rep").select("x", F.col("rep").alias("y")))
    label = components(links).select(F.col("node").alias("rep"), "component")
    named = reps.select("n", "a", "b", "rep").join(label, "rep", "left").select("n", "a", "b", F.coalesce("component", "rep").alias("component"))
    if several:
        named = named.withColumn("component", F.col("component.doc_id"))
    found = signed.select("doc_id", "n", "a", "b").join(named, ["n", "a", "b"], "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, rules: DedupRules = DedupRules()) -> DataFrame:
    """find_components and kept: true for the document that stands for its component."""
    found = find_components(docs, rules)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, rules: DedupRules = DedupRules()) -> DataFrame:
    """One document of each component, with all columns of ``docs``.

    Rows with a null doc_id stay.
    """
    name = fresh(docs, "__gone")
    gone = near_duplicates(docs.select("doc_id", "text"), rules).where("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
