"""Language-model scores from a hidden Markov model.

Word counts of all training texts give every token a class: the most frequent
tokens are a class each, the others share buckets by hash, inside which a
token has its smoothed share of the bucket.  Latent states emit classes.
Baum-Welch runs over all training texts; each task sends its expected counts,
which Spark sums, and the driver holds only the model, whose size is fixed.
A text's score is its exact likelihood by the scaled forward recursion, times
the tokens' shares of their buckets.

Texts are split twice: for the counts, and once more to write what the counts
say of every text (its classes, sums over its tokens, the tokens that no task
holds), which all later steps read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simplicia.llm.kernel import U64, mix, text_buffers, words_of
from simplicia.llm.shared import written


@dataclass(frozen=True)
class HmmRules:
    states: int = 4
    #: Tokens with a class of their own, and buckets for all others.
    own: int = 2048
    buckets: int = 2048
    #: Baum-Welch steps; every step goes over all training texts, whatever their number.
    steps: int = 6
    #: Tokens whose counts every task holds, at most; counts of all others are joined.
    held: int = 1 << 18
    smooth: float = 0.1
    seed: int = 11
    #: Tokens of the texts that a task runs the recursions on at a time.
    together: int = 150_000


#: Bytes of text that are split at a time, and tokens that are counted at a time.
SLICE, COUNTED = 1 << 19, 1 << 18
#: Tasks that add up what all others expect; the driver gets a row from each.
ADDERS = 8
#: Steps of a recursion between two that are scaled; probabilities fall by 1e-22 a step at the most for 10^10 tokens.
SCALED = 4

END = int(mix(np.array([0x454E44], U64)).view(np.int64)[0])


def is_held_out(doc_id: Column, folds: int = 10) -> Column:
    """crc32 of the id as text, modulo folds, is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


@dataclass
class Model:
    """Fixed-size tables of the model."""

    total: int
    distinct: int
    held_hash: np.ndarray  # sorted
    held_count: np.ndarray
    own_class: np.ndarray  # class of each held token, -1 for those in buckets
    bucket_tokens: np.ndarray
    bucket_distinct: np.ndarray
    start: np.ndarray
    move: np.ndarray  # from state, to state
    emit: np.ndarray  # class, state
    rules: HmmRules
    likelihoods: tuple[float, ...] = ()  # of all training texts' classes before each step, natural logarithm

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each token, and its place among the held ones or -1."""
        n = len(self.held_hash)
        if n:
            at = np.searchsorted(self.held_hash, h)
            at[at == n] = 0
            at = np.where(self.held_hash[at] == h, at, -1)
            own = np.where(at >= 0, self.own_class[at], -1)
        else:
            at = own = np.full(len(h), -1)
        return np.where(own >= 0, own, self.rules.own + (h >> U64(20)).astype(np.int64) % self.rules.buckets), at


def _bucket(h: Column, buckets: int) -> Column:
    return (F.shiftrightunsigned(h, 20) % buckets).cast("int")


def _token_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first row, last row, tokens (each text's words, then its end), number of tokens of each text."""
    for w in words_of(batch.column("text"), lower=True, max_bytes=SLICE):
        n = w.counts + 1
        tokens = np.full(n.sum(), np.array([END]).view(U64)[0], U64)
        mask = np.ones(len(tokens), bool)
        mask[np.cumsum(n) - 1] = False
        tokens[mask] = w.hash
        yield w.first, w.last, tokens, n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        u, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, U64), np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "c"])

    for batch in batches:
        parts: list[np.ndarray] = []
        for _, _, t, _ in _token_rows(batch):
            parts.append(t)
            if sum(map(len, parts)) > COUNTED:
                yield counted(parts)
                parts = []
        yield counted(parts)


class Packed:
    """Texts side by side, longest first: entry (t, j) is token t of text j.

    At each time the texts that still go on are the first ones, so a step of a
    recursion is one operation on a slice.
    """

    def __init__(self, classes: np.ndarray, lengths: np.ndarray) -> None:
        self.order = np.argsort(-lengths, kind="stable")
        length = lengths[self.order]
        first = (np.cumsum(lengths) - lengths)[self.order]
        self.active = np.searchsorted(-length, -np.arange(1, length.max() + 1), side="right")
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        self.text = np.arange(len(classes)) - np.repeat(self.at[:-1], self.active)
        time = np.repeat(np.arange(len(self.active)), self.active)
        self.classes = classes[first[self.text] + time]
        self.last = self.at[length - 1] + np.arange(len(length))  # entry of each text's last token

    def forward(self, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward probabilities, emissions over scales, and scales of all entries.

        Every fourth step is scaled, and the last one of each text; a scale in between is 1.
        """
        b = np.take(m.emit, self.classes, axis=0, mode="clip")  # a class is always in range; this mode is faster
        alpha, scale = np.empty_like(b), np.ones(len(b))
        at, active = self.at.tolist(), self.active.tolist()
        one = np.ones(b.shape[1])
        np.multiply(b[: at[1]], m.start, out=alpha[: at[1]])
        a = alpha[: at[1]]
        for t in range(1, len(active)):
            i, j = at[t], at[t + 1]
            x = alpha[i:j]
            np.dot(a[: j - i], m.move, out=x)
            x *= b[i:j]
            if t % SCALED == 0:
                s = scale[i:j] = x @ one
                x /= s[:, None]
                b[i:j] /= s[:, None]
            a = x
        s = alpha[self.last] @ one
        alpha[self.last] /= s[:, None]
        b[self.last] /= s[:, None]
        scale[self.last] *= s
        return alpha, b, scale

    def log_likelihood(self, scale: np.ndarray) -> np.ndarray:
        """Natural logarithm for each text, in the order they were given."""
        out = np.empty(len(self.order))
        out[self.order] = np.bincount(self.text, weights=np.log(scale), minlength=len(self.order))
        return out

    def expected(self, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, moves and emissions."""
        alpha, b, scale = self.forward(m)
        self.likelihood = float(np.log(scale).sum())
        at = self.at.tolist()
        beta = np.ones_like(b)
        move_t = m.move.T.copy()
        for t in range(len(at) - 3, -1, -1):
            i, j = at[t + 1], at[t + 2]
            x = b[i:j]
            x *= beta[i:j]
            np.dot(x, move_t, out=beta[at[t] : at[t] + j - i])
        later = np.arange(at[1], len(b))
        before = later - np.repeat(self.active[:-1], self.active[1:])
        moves = (np.take(alpha, before, axis=0, mode="clip").T @ b[at[1] :]) * m.move
        alpha *= beta
        emits = np.stack([np.bincount(self.classes, weights=alpha[:, s], minlength=len(m.emit)) for s in range(b.shape[1])], 1)
        return alpha[: at[1]].sum(0), moves, emits


def _groups(lengths: np.ndarray, together: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts of like length together, longest first: their numbers, and the places of their tokens."""
    order = np.argsort(-lengths, kind="stable")
    first = np.cumsum(lengths) - lengths
    ends = np.cumsum(lengths[order])
    i = 0
    while i < len(order):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + together, side="right")))
        rows = order[i:j]
        n = lengths[rows]
        yield rows, np.arange(n.sum()) + np.repeat(first[rows] - (np.cumsum(n) - n), n)
        i = j


def _batch_tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    parts = list(_token_rows(batch))
    if not parts:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])


def _encoded(docs: DataFrame, model: Model) -> DataFrame:
    """What the counts say of each text, so that no later step need split texts again.

    ``classes`` has a text's classes as bytes; ``base`` and ``within`` are sums
    over its tokens of which a task holds the counts (n_held of n_tokens);
    ``open`` has the others, each once, with their numbers.  Columns other than
    text are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != "text"]
    schema = [f"{c} {kind}" for c, kind in docs.dtypes if c != "text"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        r = m.rules
        in_all = np.log10(m.total + r.smooth * (m.distinct + 1))
        in_bucket = np.log10(m.bucket_tokens + r.smooth * (m.bucket_distinct + 1))
        log_count = np.log10(m.held_count + r.smooth)
        for batch in batches:
            for first, last, tokens, n in _token_rows(batch):
                # each different token is looked up once
                distinct, which = np.unique(tokens, return_inverse=True)
                classes, held = m.lookup(distinct)
                count = np.where(held >= 0, log_count[held], 0.0) if len(log_count) else np.zeros(len(held))
                shared_class = classes >= r.own
                within = np.where(shared_class, count - in_bucket[np.where(shared_class, classes - r.own, 0)], 0.0)
                of = np.repeat(np.arange(len(n)), n)
                rare = (held < 0)[which]
                open_ = np.bincount(of[rare], minlength=len(n))
                arrays = [
                    *(batch.column(c).slice(first, last - first) for c in kept),
                    pa.array(n.astype(np.int64)),
                    pa.array((n - open_).astype(np.int64)),
                    pa.array(np.bincount(of, weights=(count - in_all)[which], minlength=len(n))),
                    pa.array(np.bincount(of, weights=within[which], minlength=len(n))),
                    _binaries(classes.astype(_class_type(m))[which], n),
                    _numbers(of[rare], tokens[rare], len(n)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, [*kept, "n_tokens", "n_held", "base", "within", "classes", "open"])

    return docs.mapInArrow(encode, ", ".join([*schema, "n_tokens long, n_held long, base double, within double, classes binary, open array<struct<token: long, n: long>>"]))


def _binaries(values: np.ndarray, n: np.ndarray) -> pa.Array:
    """Binary values of n numbers each."""
    at = np.concatenate([[0], np.cumsum(n)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(of: np.ndarray, tokens: np.ndarray, texts: int) -> pa.Array:
    """Lists of the different tokens of each text, with how often each occurs."""
    order = np.lexsort((tokens, of))
    tokens, of = tokens[order], of[order]
    new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (of[1:] != of[:-1])])[: len(tokens)]
    at = np.flatnonzero(new)
    n = np.diff(np.concatenate([at, [len(tokens)]]))
    rows = pa.StructArray.from_arrays([pa.array(tokens[at].view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of[at], np.arange(texts + 1)).astype(np.int32)), rows)


def _texts(column: pa.Array, m: Model) -> Iterator[tuple[np.ndarray, Packed]]:
    """Texts of like length together, from their classes as bytes: their numbers, and the texts side by side."""
    kind = np.dtype(_class_type(m))
    data, at = text_buffers(column)
    classes, n = np.frombuffer(data.tobytes(), kind), np.diff(at) // kind.itemsize
    for rows, places in _groups(n, m.rules.together):
        yield rows, Packed(classes[places].astype(np.int64), n[rows])


def _class_type(m: Model) -> type:
    return np.uint16 if len(m.emit) <= 1 << 16 else np.uint32


def _improve(encoded: DataFrame, model: Model) -> Model:
    """One Baum-Welch step over all training texts."""
    held = encoded.sparkSession.sparkContext.broadcast(model)
    s, k = model.rules.states, len(model.emit)
    size = s + s * s + k * s

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        total = np.zeros(size + 1)
        for batch in batches:
            for _, packed in _texts(batch.column("classes"), m):
                start, moves, emits = packed.expected(m)
                total += np.concatenate([start, moves.ravel(), emits.ravel(), [packed.likelihood]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1)
        for batch in batches:
            for part in batch.column("sums"):
                total += np.frombuffer(part.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    # a row for each task, of fixed size; a few tasks add them up
    rows = encoded.mapInArrow(expect, "sums binary").repartition(ADDERS).mapInArrow(add, "sums binary").collect()
    total = np.sum([np.frombuffer(r["sums"]) for r in rows], axis=0)
    held.unpersist()
    better = _normalised(model, total[:s], total[s : s + s * s].reshape(s, s), total[s + s * s : size].reshape(k, s))
    better.likelihoods = (*model.likelihoods, float(total[size]))
    return better


def _normalised(m: Model, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
    start, move, emit = start + 0.1, move + 0.1, emit + m.rules.smooth
    return Model(m.total, m.distinct, m.held_hash, m.held_count, m.own_class, m.bucket_tokens, m.bucket_distinct, start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0), m.rules)


def _most_frequent(counts: DataFrame, most: int) -> pd.DataFrame:
    """The ``most`` most frequent tokens, ties to the smaller hash, in order of count.

    How many tokens have each count, in steps of 1/64 of a power of two, gives
    the steps that fit whole; only the next step is sorted, for what is left.
    The driver gets some thousand rows, and then ``most`` at most.
    """
    step = F.floor(F.log2("c") * 64).cast("int")
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).toPandas().sort_values("step", ascending=False)
    whole = steps["n"].cumsum() <= most
    left = most - int(steps["n"][whole].sum())
    parts = [counts.where(step >= int(steps["step"][whole].min())).toPandas()] if whole.any() else []
    if left and not whole.all():
        parts.append(counts.where(step == int(steps["step"][~whole].max())).orderBy(F.desc("c"), "token").limit(left).toPandas())
    top = pd.concat(parts) if parts else counts.limit(0).toPandas()
    return top.sort_values(["c", "token"], ascending=[False, True], ignore_index=True)


def _initial(counts: DataFrame, rules: HmmRules) -> Model:
    """Tables of counts, and lasting states that differ at random from the classes' shares."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = _most_frequent(counts, rules.held)
    own = np.where(np.arange(len(top)) < rules.own, np.arange(len(top)), -1)
    h = top["token"].to_numpy(np.int64).view(U64)
    order = np.argsort(h)
    table = np.zeros((rules.buckets, 2))
    by_bucket = counts.groupBy(_bucket(F.col("token"), rules.buckets).alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).toPandas()
    table[by_bucket["b"].to_numpy(int)] = by_bucket[["c", "v"]].to_numpy(float)
    mine = top["token"].to_numpy(np.int64)[: rules.own].view(U64)
    np.subtract.at(table, (mine >> U64(20)).astype(np.int64) % rules.buckets, np.stack([top["c"].to_numpy(float)[: rules.own], np.ones(len(mine))], 1))
    share = np.concatenate([top["c"].to_numpy(float)[: rules.own], np.zeros(rules.own - len(mine)), table[:, 0]])
    rng = np.random.default_rng(rules.seed)
    s = rules.states
    emit = (share[:, None] + rules.smooth) * rng.exponential(1.0, (len(share), s))
    m = Model(int(total), int(distinct), h[order], top["c"].to_numpy(np.int64)[order], own[order], table[:, 0], table[:, 1], np.zeros(s), np.zeros((s, s)), emit, rules)
    return _normalised(m, np.ones(s), np.ones((s, s)) + 200 * np.eye(s), emit)


def _counted(docs: DataFrame) -> DataFrame:
    """(token, c) of all texts of ``docs``."""
    return written(docs.select("text").mapInArrow(_count, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")), "token-counts")


def _fitted(encoded: DataFrame, model: Model) -> Model:
    """All Baum-Welch steps over the texts of ``encoded``."""
    for _ in range(model.rules.steps):
        model = _improve(encoded.select("classes"), model)
    return model


def train(docs: DataFrame, rules: HmmRules = HmmRules()) -> tuple[Model, DataFrame]:
    """The model and the counts (token, c) of all texts of ``docs``, whose column is text."""
    counts = _counted(docs)
    model = _initial(counts, rules)
    return _fitted(written(_encoded(docs.select("text"), model), "classes"), model), counts


def _partial_scores(encoded: DataFrame, model: Model) -> DataFrame:
    """What the held tables and the states say; tokens without a held count are left open."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    kept = ["doc_id", "key", "held_out", "n_tokens", "n_held", "base"]
    kinds = dict(encoded.dtypes)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            full = batch.column("within").to_numpy().copy()
            for rows, packed in _texts(batch.column("classes"), m):
                full[rows] += packed.log_likelihood(packed.forward(m)[2]) / np.log(10)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(full)], [*kept, "full"])

    return encoded.select(*kept, "within", "classes").mapInArrow(score, ", ".join([*(f"{c} {kinds[c]}" for c in kept), "full double"]))


def score_texts(docs: DataFrame, rules: HmmRules = HmmRules()) -> DataFrame:
    """Score every whole text; learn from those that aren't held out.

    ``docs`` has doc_id and text; other columns are ignored.  A text's tokens
    are its words, A-Z lower-cased, and one end; a null or empty text is one
    end.  Returns doc_id, held_out, n_tokens, n_known (tokens that occur in
    training), train_tokens, base_score (the smoothed unigram score) and score
    (log10 of the model's probability), one row for each input row.  Repeated
    rows have equal scores.  With nothing to learn from, counts are 0 and
    scores stay finite.  Tokens are told apart by 64-bit hashes.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("key"), is_held_out(F.col("doc_id")).alias("held_out"))
    counts = _counted(rows.where(~F.col("held_out")))
    model = _initial(counts, rules)
    encoded = written(_encoded(rows, model), "classes")
    model = _fitted(encoded.where(~F.col("held_out")), model)
    tokens = encoded.select(F.col("doc_id").alias("of"), F.col("key").alias("rest_key"), F.inline("open")).join(counts, "token", "left")
    rest = tokens.groupBy("of", "rest_key").agg(
        F.sum("n").alias("all_n"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known_n"),
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(rules.smooth))).alias("log_n"),
    )
    parts = _partial_scores(encoded, model)
    joined = parts.join(rest, parts["doc_id"].eqNullSafe(rest["of"]) & (parts["key"] == rest["rest_key"]), "left")
    times = F.col("all_n") / (F.col("n_tokens") - F.col("n_held"))  # rows that repeat add up in the sums
    # a token outside the held ones always stands in a bucket, so both scores gain the same sum
    more = F.coalesce(F.col("log_n") / times, F.lit(0.0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_held") + F.coalesce(F.round(F.col("known_n") / times).cast("long"), F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("full") + more).alias("score"),
    )
