"""Quality rules: base counts and distribution divergence.

Two histograms of a text, of character classes and of its language's common
words, are compared with the language's own, taken over the whole corpus, by
Jensen-Shannon distance.  Short texts are not held to distances that their
length alone explains.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simplicia.llm.kernel import U64, Words, mix, windows, words_of
from simplicia.llm.shared import fresh, with_columns_by, written


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules."""

    min_words: int = 10
    max_repeat_percent: int = 20
    #: Words from which on a text is held to distances.
    guard_words: int = 50
    max_char_distance: float = 0.28
    #: The limit for words is this plus word_slack / sqrt(number of words).
    max_word_distance: float = 0.30
    word_slack: float = 1.2
    #: A word is common in a language from this share on, so a language has 625 at most.
    common_share: float = 0.0016
    #: References of so many languages, the largest, go to every task; those of all others are joined to their texts.
    max_languages: int = 500


CLASSES = 8
_CONTINUATION = 8
_CLASS = np.full(256, 6, np.int8)  # symbols and the rest
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[0x20, 0x09]] = 3
_CLASS[[0x0A, 0x0B, 0x0C, 0x0D]] = 4
_CLASS[list(b".,;:!?'\"-()")] = 5
_CLASS[0xC0:] = 7  # first byte of a character beyond ASCII
_CLASS[0x80:0xC0] = _CONTINUATION
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACES = (_CLASS == 3) | (_CLASS == 4)
#: Languages are told apart by their names after this sign; no name at all is null, which is not the empty name.
_NAMED, _NO_LANGUAGE = "=", ""

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def char_classes(w: Words) -> np.ndarray:
    """Texts by class: how many characters of each class."""
    n = w.last - w.first
    of = np.repeat(np.arange(n) * (CLASSES + 1), np.diff(w.text_at))
    return np.bincount(of + _CLASS[w.data], minlength=n * (CLASSES + 1)).reshape(n, CLASSES + 1)[:, :CLASSES]


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[at[1:]] - total[at[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which of the keys stand there twice or more."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def repeat_words(w: Words, width: int = 5) -> np.ndarray:
    """Words of each text that lie in a window of ``width`` words found twice or more in the text."""
    h, at = windows(w, width)
    if not len(h):
        return np.zeros(w.last - w.first, np.int64)
    again = at[_repeated(h ^ mix(w.text_of_word()[at].astype(U64)))]
    n = len(w.hash)
    cover = np.cumsum(np.bincount(again, minlength=n + 1) - np.bincount(again + width, minlength=n + 1)[: n + 1])[:n] > 0
    return _sums(cover, w.word_at)


def dup_lines(w: Words) -> np.ndarray:
    """Lines of each text that hold a word and equal an earlier line of it."""
    n = w.last - w.first
    breaks = np.flatnonzero(w.data == 10)
    start = np.sort(np.concatenate([w.text_at[:-1], breaks + 1]))
    end = np.sort(np.concatenate([breaks, w.text_at[1:]]))
    of = np.repeat(np.arange(n), 1 + _sums(w.data == 10, w.text_at))
    worded = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, of = start[worded], end[worded], of[worded]
    keys = w.span_hash(start, end) ^ mix(of.astype(U64))
    order = np.argsort(keys, kind="stable")
    again = order[1:][keys[order][1:] == keys[order][:-1]]
    return np.bincount(of[again], minlength=n)


def base_counts(w: Words) -> dict[str, np.ndarray]:
    chars = (_CLASS[w.data] != _CONTINUATION) & ~_SPACES[w.data]
    return {
        "n_words": w.counts,
        "word_chars": _sums(chars, w.text_at),
        "n_symbols": _sums(_SYMBOL[w.data], w.text_at),
        "n_dup_lines": dup_lines(w),
        "n_repeat_words": repeat_words(w),
    }


def _entropy_terms(p: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.where(p > 0, p * np.log2(np.where(p > 0, p, 1) / np.where(m > 0, m, 1)), 0)


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of counts to the reference; 0 for a row without counts."""
    total = counts.sum(1, keepdims=True)
    p = counts / np.maximum(total, 1)
    q = reference / max(reference.sum(), 1)
    m = (p + q) / 2
    divergence = (_entropy_terms(p, m).sum(1) + _entropy_terms(np.broadcast_to(q, p.shape), m).sum(1)) / 2
    return np.where(total[:, 0] > 0, np.sqrt(np.maximum(divergence, 0)), 0.0)


def _languages(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([_NO_LANGUAGE if x is None else _NAMED + x for x in batch.column("lang").to_pylist()], object)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, item, n): characters by class as items -8..-1 under kind 0, words by hash under kind 1."""
    for batch in batches:
        languages = _languages(batch)
        names, of = np.unique(languages, return_inverse=True)
        lang, kind, item, count = [], [], [], []
        chars = np.zeros((len(names), CLASSES), np.int64)
        hashes, groups = [], []
        for w in words_of(batch.column("text"), lower=False):
            np.add.at(chars, of[w.first : w.last], char_classes(w))
            hashes.append(w.hash)
            groups.append(np.repeat(of[w.first : w.last], w.counts))
        hashes, groups = (np.concatenate(x) if x else np.zeros(0, U64) for x in (hashes, groups))
        for i, name in enumerate(names):
            u, n = np.unique(hashes[groups == i], return_counts=True)
            lang += [name] * (CLASSES + len(u))
            kind.append(np.repeat(np.array([0, 1], np.int32), [CLASSES, len(u)]))
            item.append(np.concatenate([np.arange(CLASSES), u.view(np.int64)]))
            count.append(np.concatenate([chars[i], n]))
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(cat(kind, np.int32)), pa.array(cat(item, np.int64)), pa.array(cat(count, np.int64))], ["lang", "kind", "item", "n"])


Reference = tuple[np.ndarray, np.ndarray, np.ndarray]


def language_references(docs: DataFrame, rules: QualityRules) -> tuple[dict[str, Reference], DataFrame | None]:
    """For each language: characters by class, its common words' hashes in order, and
    their counts with all other words' last.

    Counts cover all documents.  Those of the largest languages come to the
    driver, whose size is bounded by languages times 1 / common_share; those of
    all others, if there are any, are a table (lang, chars, words, counts).
    """
    counts = written(docs.select("lang", "text").mapInArrow(_tally, "lang string, kind int, item long, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")), "quality-counts")
    totals = written(counts.where("kind = 1").groupBy("lang").agg(F.sum("n").alias("total")), "quality-totals")
    largest = totals.orderBy(F.desc("total"), "lang").limit(rules.max_languages)
    common = (F.col("kind") == 0) | (F.col("n") >= rules.common_share * F.col("total"))
    references: dict[str, Reference] = {}
    rows = counts.join(F.broadcast(largest), "lang").where(common).toPandas()
    for lang, part in rows.groupby("lang"):
        chars = part[part.kind == 0].set_index("item").n.reindex(range(CLASSES), fill_value=0).to_numpy(float)
        words = part[part.kind == 1]
        references[str(lang)] = _reference(chars, words["item"].to_numpy(np.int64), words["n"].to_numpy(float), float(part.total.iloc[0]))
    if totals.count() <= rules.max_languages:
        return references, None
    others = counts.join(totals.where(~F.col("lang").isin(list(references))), "lang").where(common)
    pick = lambda kind, of: F.collect_list(F.when(F.col("kind") == kind, of))
    # at most CLASSES and 1 / common_share items
    return references, written(others.groupBy("lang").agg(pick(0, F.struct("item", "n")).alias("chars"), pick(1, F.struct("item", "n")).alias("words"), F.first("total").alias("total")), "quality-references")


def _reference(chars: np.ndarray, items: np.ndarray, n: np.ndarray, total: float) -> Reference:
    u = items.view(U64)
    order = np.argsort(u)
    return chars, u[order], np.append(n[order], total - n.sum())


def _joined_reference(chars: list[dict], words: list[dict], total: int) -> Reference:
    by_class = np.zeros(CLASSES)
    by_class[[x["item"] for x in chars]] = [x["n"] for x in chars]
    return _reference(by_class, np.array([x["item"] for x in words], np.int64), np.array([x["n"] for x in words], float), float(total))


def _measured(docs: DataFrame, rules: QualityRules, name: str) -> DataFrame:
    """All columns of ``docs`` and the counts and distances, under ``name`` and their own names."""
    largest, others = language_references(docs, rules)
    references = docs.sparkSession.sparkContext.broadcast(largest)
    side = fresh(docs, "__r_")
    added = [T.StructField(name + c, T.LongType()) for c in COUNTS] + [T.StructField(name + c, T.DoubleType()) for c in ("char_distance", "word_distance")]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for batch in batches:
            n = batch.num_rows
            out = {c: np.zeros(n, np.int64) for c in COUNTS}
            char_distance, word_distance = np.zeros(n), np.zeros(n)
            languages = _languages(batch)
            known = references.value
            if f"{side}total" in batch.schema.names:  # the join gives all texts of a language the same
                names, first = np.unique(languages, return_index=True)
                parts = [batch.column(side + c).take(pa.array(first)).to_pylist() for c in ("chars", "words", "total")]
                known = {name: _joined_reference(*x) for name, *x in zip(names, *parts, strict=True) if x[2] is not None}
            for w in words_of(batch.column("text"), lower=False):
                rows = slice(w.first, w.last)
                for c, x in base_counts(w).items():
                    out[c][rows] = x
                classes, of_word = char_classes(w), w.text_of_word()
                for lang in set(languages[rows]) & known.keys():
                    chars, common, counts = known[lang]
                    mine = np.flatnonzero(languages[rows] == lang)
                    char_distance[w.first + mine] = js_distance(classes[mine], chars)
                    k = len(common)
                    at = np.searchsorted(common, w.hash)
                    at[at == k] = 0
                    item = np.where(common[at] == w.hash, at, k) if k else np.zeros(len(w.hash), np.int64)
                    histogram = np.bincount(of_word * (k + 1) + item, minlength=(w.last - w.first) * (k + 1)).reshape(-1, k + 1)
                    word_distance[w.first + mine] = js_distance(histogram[mine], counts)
            yield batch, [*(pa.array(out[c]) for c in COUNTS), pa.array(char_distance), pa.array(word_distance)]

    if others is None:
        return with_columns_by(docs, added, measure)
    own = F.coalesce(F.concat(F.lit(_NAMED), "lang"), F.lit(_NO_LANGUAGE))
    large = with_columns_by(docs.where(own.isin(list(largest))), added, measure)
    joined = docs.where(~own.isin(list(largest))).join(others.toDF(*(side + c for c in others.columns)), own == F.col(f"{side}lang"), "left")
    small = with_columns_by(joined, added, measure).drop(*(side + c for c in others.columns))
    return large.union(small)


def _base_failed(rules: QualityRules, name: str):
    return (F.col(f"{name}n_words") < rules.min_words) | (100 * F.col(f"{name}n_repeat_words") > rules.max_repeat_percent * F.col(f"{name}n_words"))


def _diverges(rules: QualityRules, name: str):
    n = F.col(f"{name}n_words")
    far = (F.col(f"{name}char_distance") > rules.max_char_distance) | (
        F.col(f"{name}word_distance") > rules.max_word_distance + rules.word_slack / F.sqrt(F.greatest(n, F.lit(1)))
    )
    return (n >= rules.guard_words) & far


def judge_quality(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Counts, distances and verdict of every whole text.

    ``docs`` has doc_id, text and lang; other columns are ignored.  Returns
    doc_id, the counts, base_failed, kept, char_distance and word_distance, one
    row for each input row.  A null or empty text has no words, so it fails
    the base rules; a null language is a language of its own, and so is the
    empty one.  Repeated rows are judged alike, and count in the references as
    often as they stand.  Words, lines and windows are compared by 64-bit hashes.
    """
    m = _measured(docs.select("doc_id", "text", "lang"), rules, "")
    failed = _base_failed(rules, "")
    return m.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & ~_diverges(rules, "")).alias("kept"), "char_distance", "word_distance")


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that pass, with all their columns."""
    name = fresh(docs, "__q_")
    m = _measured(docs, rules, name)
    return m.where(~_base_failed(rules, name) & ~_diverges(rules, name)).select(*(F.col(f"`{c}`") for c in docs.columns))
