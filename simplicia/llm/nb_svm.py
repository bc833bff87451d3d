"""Quality by naive Bayes support vectors.

Features are n-grams of words and of the words' shapes, each counted once a
text.  An n-gram's log-count ratio says how much more often texts of the one
class hold it than texts of the other; the indicators are scaled by it, texts
to length one, and a linear hinge-loss model is fitted to them by coordinate
descent in the dual.  A logistic curve turns its margins into probabilities,
fitted to labelled texts that the model hasn't seen.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simplicia.llm.hmm_lm import is_held_out
from simplicia.llm.kernel import U64, Words, mix, words_of
from simplicia.llm.labelled import labelled_sample
from simplicia.llm.shared import forget, fresh, with_columns_by


@dataclass(frozen=True)
class NbSvmRules:
    #: Documented bound: the classifier is fitted on a hash sample of so many labelled rows, a fifth of them for the logistic curve.
    max_labelled: int = 12_000
    #: n-grams are dealt by their hashes to 2 to the power of so many features.
    feature_bits: int = 18
    word_grams: int = 2
    shape_grams: int = 3
    #: Added to each feature's counts.
    smoothing: float = 1.0
    #: Most that a text's dual variable may be.
    cost: float = 1.0
    most_epochs: int = 60
    #: The fit ends once no dual variable is further than this from its best place.
    tolerance: float = 0.01
    seed: int = 12
    keep_from: float = 0.3


#: Class of each byte in a shape: letters of either case, digits and bytes beyond ASCII are one class each, every other byte its own.
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 97, 65, 48, 128


def shapes(w: Words) -> np.ndarray:
    """A number for each word's shape: the classes of its first and its last two bytes, and whether it repeats the word before."""
    of = w.text_of_word()
    again = np.zeros(len(of), U64)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (of[1:] == of[:-1])
    first, last, before = (_CLASS[w.data[at]] for at in (w.start, w.end - 1, np.maximum(w.end - 2, w.start)))
    return mix(first | last << U64(8) | before << U64(16) | again << U64(24))


def gram_features(w: Words, rules: NbSvmRules) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) of all n-grams of words and shapes, sorted."""
    of, found = w.text_of_word(), []
    for kind, (units, most) in enumerate(((w.hash, rules.word_grams), (shapes(w), rules.shape_grams))):
        gram = mix(units + U64(kind))
        for n in range(1, most + 1):
            if n > 1:
                gram = mix(gram[:-1] * U64(3) + units[n - 1 :])
            inside = of[: len(gram)] == of[n - 1 :]
            feature = (mix(gram[inside] + U64(2 * n + kind)) >> U64(64 - rules.feature_bits)).astype(np.int64)
            found.append(of[: len(gram)][inside] << rules.feature_bits | feature)
            if len(gram) < 2:
                break
    pairs = np.unique(np.concatenate(found))
    return pairs >> rules.feature_bits, pairs & (1 << rules.feature_bits) - 1


@dataclass
class LabelledGrams:
    """Labelled texts: text i holds the features feature[cut[i]:cut[i + 1]]."""

    cut: np.ndarray
    feature: np.ndarray
    good: np.ndarray  # whether the label is 1
    shown: np.ndarray  # whether the text is for the logistic curve

    def of(self, i: int) -> np.ndarray:
        return self.feature[self.cut[i] : self.cut[i + 1]]


@dataclass
class NbSvm:
    """Ratios of features and the linear model over them; without labels of both classes the score is the share of ones."""

    ratio: np.ndarray
    weight: np.ndarray  # of the scaled indicators, times the ratio
    bias: float
    slope: float
    offset: float

    def margins(self, of: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """Of n texts with the distinct features (of, feature)."""
        length = np.sqrt(np.bincount(of, weights=self.ratio[feature] ** 2, minlength=n))
        return np.bincount(of, weights=self.weight[feature], minlength=n) / np.maximum(length, 1e-9) + self.bias

    def score(self, w: Words, rules: NbSvmRules) -> np.ndarray:
        n = w.last - w.first
        of, feature = gram_features(w, rules)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(of, feature, n) + self.offset, -40, 40)))


def log_count_ratio(texts: LabelledGrams, fitted: np.ndarray, rules: NbSvmRules) -> np.ndarray:
    """log of (share of a feature in the counts of good texts) over (that of the others); 0 for features that no text holds."""
    size = 1 << rules.feature_bits
    sizes = np.diff(texts.cut)
    counts = []
    for wanted in (fitted & texts.good, fitted & ~texts.good):
        counts.append(np.bincount(texts.feature[np.repeat(wanted, sizes)], minlength=size).astype(float))
    p, q = (c + rules.smoothing for c in counts)
    return np.where(counts[0] + counts[1] > 0, np.log(p / p.sum()) - np.log(q / q.sum()), 0.0)


def dual_coordinate_descent(texts: LabelledGrams, fitted: np.ndarray, ratio: np.ndarray, rules: NbSvmRules) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights and bias that minimise half their square and ``cost`` times the hinge losses, and the dual variables.

    One text's dual variable at a time goes to its best place, the texts in a
    new random order in each epoch; the bias is the weight of a feature that
    every text has.
    """
    rows = np.flatnonzero(fitted)
    rng = np.random.default_rng(rules.seed)
    weight, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(texts.good))
    sign = np.where(texts.good, 1.0, -1.0)
    length = np.zeros(len(alpha))
    for i in rows:
        length[i] = max(np.linalg.norm(ratio[texts.of(i)]), 1e-9)
    for _ in range(rules.most_epochs):
        off = 0.0
        for i in rng.permutation(rows):
            f = texts.of(i)
            x = ratio[f] / length[i]
            gradient = sign[i] * (weight[f] @ x + bias) - 1
            best = min(max(alpha[i] - gradient / (x @ x + 1.0), 0.0), rules.cost)
            step = best - alpha[i]
            if step:
                weight[f] += step * sign[i] * x
                bias += step * sign[i]
                alpha[i] = best
                off = max(off, abs(step))
        if off < rules.tolerance:
            break
    return weight, bias, alpha


def logistic_curve(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the most likely logistic curve, with targets drawn in by one text a class, by Newton's method."""
    n_good, n_bad = good.sum(), (~good).sum()
    target = np.where(good, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
    x = np.column_stack([margin, np.ones(len(margin))])
    at = np.array([1.0, 0.0])
    loss = lambda v: np.logaddexp(0, x @ v).sum() - target @ (x @ v) + 1e-4 * v @ v
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -40, 40)))
        gradient = x.T @ (p - target) + 2e-4 * at
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 2e-4 * np.eye(2)
        step, scale = np.linalg.solve(hessian, gradient), 1.0
        while scale > 1e-6 and loss(at - scale * step) > loss(at):
            scale /= 2
        at = at - scale * step
        if np.abs(scale * step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


def fit(texts: LabelledGrams, rules: NbSvmRules = NbSvmRules()) -> NbSvm:
    """The classifier of labelled texts; texts for the curve lend it only if they are of both classes."""
    size, n = 1 << rules.feature_bits, len(texts.good)
    curve = texts.shown if texts.good[texts.shown].any() and (~texts.good[texts.shown]).any() else np.zeros(n, bool)
    fitted = ~curve
    if not texts.good[fitted].any() or texts.good[fitted].all():
        share = (texts.good.sum() + 1) / (n + 2)
        return NbSvm(np.zeros(size), np.zeros(size), 0.0, 0.0, float(np.log(share / (1 - share))))
    ratio = log_count_ratio(texts, fitted, rules)
    weight, bias, _ = dual_coordinate_descent(texts, fitted, ratio, rules)
    model = NbSvm(ratio, weight * ratio, bias, 1.0, 0.0)
    if curve.any():
        margin = model.margins(np.repeat(np.arange(n), np.diff(texts.cut)), texts.feature, n)
        model.slope, model.offset = logistic_curve(margin[curve], texts.good[curve])
    return model


def train(docs: DataFrame, labels: DataFrame, rules: NbSvmRules = NbSvmRules()) -> NbSvm:
    """Learn from the labelled rows of doc_id, text and doc_id, quality outside the held-out fold."""
    sample = labelled_sample(docs, labels, "quality", rules.max_labelled)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words_of(batch.column("text"), lower=False):
                of, feature = gram_features(w, rules)
                n = w.last - w.first
                cut = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
                # by the text itself, so copies are on one side
                shown = [zlib.crc32(w.data[a:b]) % 5 == 0 for a, b in zip(w.text_at[:-1], w.text_at[1:])]
                held = pa.ListArray.from_arrays(pa.array(cut), pa.array(feature.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("quality").slice(w.first, n), pa.array(shown), held], ["good", "shown", "held"])

    # bounded by max_labelled texts times their distinct features; sorted, so that the fit doesn't depend on the order of tasks
    rows = sample.mapInArrow(featured, "good boolean, shown boolean, held array<int>").toArrow().combine_chunks()
    forget(sample)
    held = rows.column("held").combine_chunks()
    cut = np.concatenate([[0], np.cumsum(held.value_lengths().to_numpy())]).astype(np.int64)
    feature = held.flatten().to_numpy()
    good, shown = (rows.column(c).to_numpy().astype(bool) for c in ("good", "shown"))
    key = np.array([zlib.crc32(feature[a:b]) * 2 + g for a, b, g in zip(cut[:-1], cut[1:], good)], np.int64)
    order = np.argsort(key, kind="stable")
    sizes = np.diff(cut)[order]
    moved = np.arange(len(feature)) + np.repeat(cut[order] - np.cumsum(sizes) + sizes, sizes)
    return fit(LabelledGrams(np.concatenate([[0], np.cumsum(sizes)]), feature[moved], good[order], shown[order]), rules)


def _scored(docs: DataFrame, model: NbSvm, rules: NbSvmRules, name: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for w in words_of(batch.column(batch.schema.get_field_index("text")), lower=False):
                out[w.first : w.last] = shared.value.score(w, rules)
            yield batch, [pa.array(out)]

    return with_columns_by(docs, [T.StructField(name, T.DoubleType())], score)


def score_quality(docs: DataFrame, labels: DataFrame, rules: NbSvmRules = NbSvmRules()) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from ``keep_from`` on) of every whole text.

    ``docs`` has doc_id and text, ``labels`` doc_id and quality; other columns
    are ignored, and only the text is an input of a score.  Labels are learned
    from rows whose crc32(doc_id) modulo 5 is not 0; a null label or id is
    ignored, repeated labels of an id count once, the largest, repeated rows of
    a labelled id once each.  A null or empty text has the score of a text
    without n-grams.  With labels of one class, or none, all scores are
    (ones + 1) / (labels + 2).  One row for each input row.
    """
    rows = _scored(docs.select("doc_id", "text"), train(docs, labels, rules), rules, "score")
    return rows.select("doc_id", is_held_out(F.col("doc_id"), 5).alias("held_out"), "score", F.when(F.col("score") >= rules.keep_from, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, rules: NbSvmRules = NbSvmRules()) -> DataFrame:
    """The documents whose score is ``keep_from`` or more, with all their columns."""
    name = fresh(docs, "__quality")
    rows = _scored(docs, train(docs, labels, rules), rules, name)
    return rows.where(F.col(name) >= rules.keep_from).select(*(F.col(f"`{c}`") for c in docs.columns))
