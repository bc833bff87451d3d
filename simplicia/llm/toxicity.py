"""Toxicity by weak supervision.

Voters are lexicon entries (words, beginnings of words, and beginnings that two
different words share, which labelled toxic texts hold more often than others)
and fixed patterns of shouting and symbols.
Labels choose the entries and have no vote.  A generative label model
estimates from the votes of all training documents, labelled or not, how often
each voter fires on toxic and on other texts, and how voters depend on each
other: toxic texts are of several kinds, of a language or a tone, in which
voters fire together.  A linear classifier over text features is trained on
the model's posteriors and scores all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simplicia.llm.hmm_lm import is_held_out
from simplicia.llm.kernel import U64, Words, mix, words_of
from simplicia.llm.labelled import labelled_sample
from simplicia.llm.shared import forget, fresh, with_columns_by, written


@dataclass(frozen=True)
class ToxicityRules:
    #: Documented bound: voters are chosen, and the classifier fitted, on a hash sample of so many labelled rows.
    max_labelled: int = 50_000
    #: A feature is looked at if so many toxic texts of the sample, and this share of them, hold it.
    min_texts: int = 3
    min_share: float = 0.005
    #: Log-likelihood ratio of voters and of the classifier's features, and their most.
    voter_ratio: float = 24.0
    feature_ratio: float = 10.0
    #: Lexicon entries at most; with the other voters a text's votes fit into 64 bits.
    voters: int = 60
    #: If so few reach the voters' ratio, features that reach the other one are entries too.
    least_voters: int = 12
    features: int = 4096
    #: Share of toxic texts among those that a lexicon entry fires on, at least.
    precision: float = 0.9
    #: Kinds of texts in the label model, beside that of ordinary ones.
    kinds: int = 6
    em_rounds: int = 12
    l2: float = 1e-5
    #: Steps of the fit, each over so many texts of the sample.
    fit_steps: int = 800
    fit_batch: int = 512
    seed: int = 5


#: Bytes of the beginnings of words that count as features, beside whole words (0).
BEGINNINGS = (4, 5, 6, 7, 0)
PATTERNS = ("shouting", "exclaiming", "symbols")
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def text_features(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, feature, word) for each word, kind of beginning by kind, punctuation at the word's ends aside.

    A feature is an even hash; the odd one beside it stands for two different words of this beginning in one text.
    """
    of, start, end = w.text_of_word(), w.start.copy(), w.end.copy()
    for _ in range(3):
        start += _PUNCTUATION[w.data[start]] & (start < end - 1)
        end -= _PUNCTUATION[w.data[end - 1]] & (end > start + 1)
    whole = w.span_hash(start, end)
    for k, n in enumerate(BEGINNINGS):
        long = end - start > n if n else np.ones(len(start), bool)
        h = w.span_hash(start[long], start[long] + n) if n else whole
        yield of[long], mix(h + U64(k + 1)) & ~U64(1), whole[long]


def patterns(w: Words) -> np.ndarray:
    """Text by pattern: whether it shouts, exclaims or is full of symbols."""
    n = w.last - w.first
    count = lambda flags: np.bincount(np.repeat(np.arange(n), np.diff(w.text_at))[flags], minlength=n)
    size = np.maximum(np.diff(w.text_at), 1)
    return np.stack([count(_UPPER[w.data]) > 0.3 * size, count(w.data == 0x21) > 0.02 * size, count(_SYMBOL[w.data]) > 0.05 * size], 1)


def _distinct(text: np.ndarray, feature: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, feature), sorted, and the number of different words of each."""
    order = np.lexsort((word, feature, text))
    text, feature, word = text[order], feature[order], word[order]
    other = np.ones(len(text), bool)
    other[1:] = (text[1:] != text[:-1]) | (feature[1:] != feature[:-1])
    new = other.copy()
    new[1:] |= word[1:] != word[:-1]
    first = np.flatnonzero(other)
    return text[first], feature[first], np.add.reduceat(new, first) if len(first) else first


def _hits(w: Words, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, place in ``known``) of the features of the texts; ``known`` is sorted."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    once = np.unique(known & ~U64(1))
    found = []
    for of, h, word in text_features(w):
        at = np.searchsorted(once, h)
        at[at == len(once)] = 0
        hit = once[at] == h
        found.append((of[hit], h[hit], word[hit]))
    text, feature, words = _distinct(*(np.concatenate(x) for x in zip(*found)))
    twice = words > 1
    text, feature = np.concatenate([text, text[twice]]), np.concatenate([feature, feature[twice] | U64(1)])
    at = np.searchsorted(known, feature)
    at[at == len(known)] = 0
    hit = known[at] == feature
    pairs = np.sort(text[hit] * len(known) + at[hit])
    return pairs // len(known), pairs % len(known)


def _feature_counts(sample: DataFrame, known: np.ndarray | None) -> DataFrame:
    """(feature, n): texts that hold each feature, or each of ``known``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words_of(batch.column("text"), lower=True):
                if known is None:
                    found = []
                    for of, h, word in text_features(w):
                        _, feature, words = _distinct(of, h, word)
                        found += [feature, feature[words > 1] | U64(1)]
                    found = np.concatenate(found)
                else:
                    found = known[_hits(w, known)[1]]
                u, n = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], ["feature", "n"])

    return sample.select("text").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def log_likelihood_ratio(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """How far a feature's shares among the two groups of texts differ (G squared)."""

    def part(x: np.ndarray, n: float) -> np.ndarray:
        p = np.clip(x / max(n, 1), 1e-12, 1 - 1e-12)
        return x * np.log(p) + (n - x) * np.log(1 - p)

    def at(x: np.ndarray, n: float, p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return x * np.log(p) + (n - x) * np.log(1 - p)

    both = (pos + neg) / max(n_pos + n_neg, 1)
    return 2 * (part(pos, n_pos) + part(neg, n_neg) - at(pos, n_pos, both) - at(neg, n_neg, both))


@dataclass
class LabelModel:
    """Shares of kinds of texts, how often each voter fires on them, how many texts of a kind are toxic, and the entries' precision."""

    share: np.ndarray  # kind
    fires: np.ndarray  # kind, voter
    toxic: np.ndarray  # kind
    precision: np.ndarray  # lexicon entry

    def kinds(self, votes: np.ndarray) -> np.ndarray:
        """Probability of each kind for each text; within a kind voters are independent."""
        z = np.log(self.share) + votes @ np.log(self.fires).T + (1 - votes) @ np.log(1 - self.fires).T
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability that a text is toxic: by its kind, or as one of its own entries is right."""
        return 1 - (1 - self.kinds(votes) @ self.toxic) * (1 - suspicion(votes, self.precision))

    def accuracies(self) -> np.ndarray:
        """How often each voter is right: fires on a toxic text, or doesn't on another."""
        return (self.share * self.toxic) @ self.fires + (self.share * (1 - self.toxic)) @ (1 - self.fires)

    def correlations(self) -> np.ndarray:
        """How voters correlate on toxic texts, by the kinds that they have in common."""
        share, fires = self.share * self.toxic, self.fires
        share = share / share.sum()
        mean = share @ fires
        both = (fires * share[:, None]).T @ fires
        np.fill_diagonal(both, mean)
        spread = np.sqrt(mean * (1 - mean))
        return (both - np.outer(mean, mean)) / np.outer(spread, spread)


def _distinct_voters(text: np.ndarray, feature: np.ndarray, ratio: np.ndarray, n: int, rules: ToxicityRules) -> np.ndarray:
    """The features of highest ratio, without those that fire on nearly the same texts as one before."""
    best = np.argsort(-ratio, kind="stable")[: 10 * rules.voters]
    mine = np.isin(feature, best)
    text, feature = text[mine], feature[mine]
    chosen: list[int] = []
    fires: list[np.ndarray] = []
    for f in best:
        # a small sample may have few features beyond the higher limit: the best of the others make up for them
        if ratio[f] < (rules.voter_ratio if len(chosen) >= rules.least_voters else rules.feature_ratio) or len(chosen) == rules.voters:
            break
        held = np.zeros(n, bool)
        held[text[feature == f]] = True
        if all((held & other).sum() < 0.8 * (held | other).sum() for other in fires):
            chosen.append(int(f))
            fires.append(held)
    return np.array(chosen, np.int64)


def _votes(patterns_: np.ndarray, voters: int) -> np.ndarray:
    """Text by voter, 0 or 1, of the bits of each text."""
    return ((patterns_.view(U64)[:, None] >> np.arange(voters).astype(U64)) & U64(1)).astype(float)


def _bits(hits: tuple[np.ndarray, np.ndarray], shown: np.ndarray, entries: int) -> np.ndarray:
    """The votes of each text as bits: lexicon entries, then patterns."""
    out = np.zeros(len(shown), U64)
    np.bitwise_or.at(out, hits[0], U64(1) << hits[1].astype(U64))
    for k in range(shown.shape[1]):
        out |= shown[:, k].astype(U64) << U64(entries + k)
    return out.view(np.int64)


def _vote_patterns(docs: DataFrame, entries: np.ndarray) -> DataFrame:
    """(votes, n): how many texts vote alike."""
    shared = docs.sparkSession.sparkContext.broadcast(entries)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words_of(batch.column("text"), lower=True):
                u, n = np.unique(_bits(_hits(w, shared.value), patterns(w), len(shared.value)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n.astype(np.int64))], ["votes", "n"])

    return docs.select("text").mapInArrow(vote, "votes long, n long").groupBy("votes").agg(F.sum("n").alias("n"))


def suspicion(votes: np.ndarray, precision: np.ndarray) -> np.ndarray:
    """Probability that one of the lexicon entries that fire on a text is right, each by its precision; 0 if none fires."""
    return 1 - np.exp(votes[:, : len(precision)] @ np.log(1 - precision))


def first_guess(votes: np.ndarray, precision: np.ndarray, rules: ToxicityRules) -> np.ndarray:
    """Kinds to begin with: a suspicious text is of a kind beyond the first, and each lexicon entry that fires speaks for some of these at random."""
    toxic = np.clip(suspicion(votes, precision), 0.02, 0.98)
    liking = np.log(np.random.default_rng(rules.seed).exponential(1.0, (len(precision), rules.kinds)))
    kind = votes[:, : len(precision)] @ liking
    kind = np.exp(kind - kind.max(1, keepdims=True))
    return np.column_stack([1 - toxic, kind / kind.sum(1, keepdims=True) * toxic[:, None]])


def label_model(stats: np.ndarray, precision: np.ndarray) -> LabelModel:
    """The model that expected counts (kind: texts, toxic ones, then texts that each voter fires on) lead to."""
    texts, toxic, fired = stats[:, :1], stats[:, 1], stats[:, 2:]
    share = (texts[:, 0] + 1) / (texts.sum() + len(stats))
    return LabelModel(share, np.clip((fired + 0.05) / (texts + 1), 1e-4, 1 - 1e-4), np.clip(toxic / np.maximum(texts[:, 0], 1e-9), 0, 1), precision)


def fit_label_model(patterns_: DataFrame, precision: np.ndarray, rules: ToxicityRules) -> LabelModel:
    """Expectation maximisation over the vote patterns (votes, n), which stay distributed; a task sends sums of fixed size.

    A kind is as toxic as its texts are suspicious on the average, so texts on
    which no entry fires are as toxic as others of their kind.
    """
    entries = len(precision)
    voters, kinds = entries + len(PATTERNS), rules.kinds + 1
    model: LabelModel | None = None
    for _ in range(rules.em_rounds + 1):
        now = patterns_.sparkSession.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = np.zeros((kinds, voters + 2))
            for batch in batches:
                votes = _votes(batch.column("votes").to_numpy(), voters)
                belong = first_guess(votes, precision, rules) if now.value is None else now.value.kinds(votes)
                belong = belong * batch.column("n").to_numpy()[:, None]
                total += np.column_stack([belong.sum(0), belong.T @ suspicion(votes, precision), belong.T @ votes])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["slot", "value"])

        rows = patterns_.mapInArrow(expect, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).toPandas()
        stats = np.zeros((kinds, voters + 2))
        stats.ravel()[rows["slot"].to_numpy()] = rows["value"].to_numpy()
        model = label_model(stats, precision)
    return model


@dataclass
class Classifier:
    """Logistic regression over known features and patterns; without features it says 0."""

    known: np.ndarray
    weight: np.ndarray
    pattern_weight: np.ndarray
    bias: float
    trained: bool = True

    def score(self, w: Words) -> np.ndarray:
        n = w.last - w.first
        if not self.trained:
            return np.zeros(n)
        of, at = _hits(w, self.known)
        z = self.bias + np.bincount(of, weights=self.weight[at], minlength=n) + patterns(w) @ self.pattern_weight
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit_linear(cut: np.ndarray, feature: np.ndarray, dense: np.ndarray, target: np.ndarray, width: int, rules: ToxicityRules) -> tuple[np.ndarray, np.ndarray, float]:
    """Steps on the logistic loss of soft targets over batches of texts, scaled for each weight by its gradients so far (Adam).

    Text i holds the features ``feature[cut[i]:cut[i + 1]]``.
    """
    n, d = len(target), width + dense.shape[1] + 1
    rng = np.random.default_rng(rules.seed)
    x, first, second, mean = np.zeros(d), np.zeros(d), np.zeros(d), np.zeros(d)
    share = np.clip(target.mean(), 1e-3, 1 - 1e-3)
    x[-1] = np.log(share / (1 - share))
    penalty = np.full(d, rules.l2)
    penalty[-1] = 0
    queue = np.zeros(0, np.int64)
    for t in range(1, rules.fit_steps + 1):
        if len(queue) < min(rules.fit_batch, n):
            queue = np.concatenate([queue, rng.permutation(n)])
        batch, queue = queue[: rules.fit_batch], queue[rules.fit_batch :]
        sizes = cut[batch + 1] - cut[batch]
        row = np.repeat(np.arange(len(batch)), sizes)
        held = feature[np.arange(len(row)) + np.repeat(cut[batch] - np.cumsum(sizes) + sizes, sizes)]
        z = np.bincount(row, weights=x[held], minlength=len(batch)) + dense[batch] @ x[width:-1] + x[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[batch]
        gradient = np.concatenate([np.bincount(held, weights=error[row], minlength=width), dense[batch].T @ error, [error.sum()]]) / len(batch) + penalty * x
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        x = x - 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-10)
        if 2 * t > rules.fit_steps:  # the mean of the second half of the steps
            mean += x
    x = mean / (rules.fit_steps - rules.fit_steps // 2)
    return x[:width], x[width:-1], float(x[-1])


def train(docs: DataFrame, labels: DataFrame, rules: ToxicityRules = ToxicityRules()) -> Classifier:
    """Learn from the labelled rows of doc_id, text and doc_id, toxic outside the held-out fold."""
    sample = labelled_sample(docs, labels, "toxic", rules.max_labelled)
    sizes = {bool(r["toxic"]): r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = sizes.get(True, 0), sizes.get(False, 0)
    none = Classifier(np.zeros(0, U64), np.zeros(0), np.zeros(len(PATTERNS)), 0.0, trained=False)
    if not n_pos or not n_neg:
        return none
    least = max(rules.min_texts, rules.min_share * n_pos)
    pos = _feature_counts(sample.where("toxic"), None).where(F.col("n") >= least).toPandas()
    known = np.sort(pos["feature"].to_numpy(np.int64).view(U64))
    n_held = dict(zip(pos["feature"], pos["n"], strict=True))
    neg = _feature_counts(sample.where("NOT toxic"), known).toPandas()
    n_other = dict(zip(neg["feature"], neg["n"], strict=True))
    in_toxic = np.array([n_held[f] for f in known.view(np.int64)], float)
    in_other = np.array([n_other.get(f, 0) for f in known.view(np.int64)], float)
    ratio = log_likelihood_ratio(in_toxic, in_other, n_pos, n_neg) * np.sign(in_toxic / n_pos - in_other / n_neg)
    kept = np.sort(np.argsort(-ratio, kind="stable")[: rules.features])
    kept = kept[ratio[kept] >= rules.feature_ratio]
    if not len(kept):
        return none
    known, ratio = known[kept], ratio[kept]

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words_of(batch.column("text"), lower=True):
                of, at = _hits(w, known)
                n = w.last - w.first
                cut = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
                shown = patterns(w) @ (1 << np.arange(len(PATTERNS)))
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(w.first, n), pa.ListArray.from_arrays(pa.array(cut), pa.array(at.astype(np.int32))), pa.array(shown.astype(np.int32))], ["toxic", "held", "shown"])

    # bounded by max_labelled texts times their distinct known features
    rows = sample.mapInArrow(featured, "toxic boolean, held array<int>, shown int").toArrow().combine_chunks()
    held = rows.column("held").combine_chunks()
    at = held.flatten().to_numpy()
    cut = np.concatenate([[0], np.cumsum(held.value_lengths().to_numpy())])
    n = rows.num_rows
    of = np.repeat(np.arange(n, dtype=np.int32), np.diff(cut))
    dense = ((rows.column("shown").to_numpy()[:, None] >> np.arange(len(PATTERNS))) & 1).astype(float)

    good = np.where(in_toxic[kept] >= rules.precision * (in_toxic + in_other)[kept], ratio, 0)
    entries = np.sort(_distinct_voters(of, at, good, n, rules))
    place = np.full(len(known), -1)
    place[entries] = np.arange(len(entries))
    mine = place[at] >= 0
    bits = _bits((of[mine], place[at][mine]), dense > 0, len(entries))
    del of, mine
    voting = written(_vote_patterns(docs.where(~is_held_out(F.col("doc_id"), 5)), known[entries]), "votes")
    precision = (in_toxic[kept][entries] + 0.5) / ((in_toxic + in_other)[kept][entries] + 1)
    model = fit_label_model(voting, precision, rules)
    forget(voting)
    posterior = model.posterior(_votes(bits, len(entries) + len(PATTERNS)))
    forget(sample)
    weight, pattern_weight, bias = _fit_linear(cut, at, dense, posterior, len(known), rules)
    return Classifier(known, weight, pattern_weight, bias)


def _scored(docs: DataFrame, classifier: Classifier, name: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for w in words_of(batch.column("text"), lower=True):
                out[w.first : w.last] = shared.value.score(w)
            yield batch, [pa.array(out)]

    return with_columns_by(docs, [T.StructField(name, T.DoubleType())], score)


def _predicted(score: Column) -> Column:
    return F.when(score >= 0.5, 1).otherwise(0)


def score_toxicity(docs: DataFrame, labels: DataFrame, rules: ToxicityRules = ToxicityRules()) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on) of every whole text.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic; other columns
    are ignored, and only the text is an input of a score.  Labels are learned
    from rows whose crc32(doc_id) modulo 5 is not 0; a null label or id is
    ignored, repeated labels of an id count once, the largest.  A null or empty
    text has a score like any other: that of a text without features.  Without
    labels of both kinds all scores are 0.  One row for each input row.
    """
    rows = _scored(docs.select("doc_id", "text"), train(docs, labels, rules), "score")
    return rows.select("doc_id", is_held_out(F.col("doc_id"), 5).alias("held_out"), "score", _predicted(F.col("score")).alias("predicted"))


def keep_harmless(docs: DataFrame, labels: DataFrame, rules: ToxicityRules = ToxicityRules()) -> DataFrame:
    """The documents that aren't predicted toxic, with all their columns."""
    name = fresh(docs, "__toxicity")
    rows = _scored(docs, train(docs, labels, rules), name)
    return rows.where(_predicted(F.col(name)) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))
