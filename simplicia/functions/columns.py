"""Scalar expressions of the engine; all of them stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

LN3 = math.log(3)


def entropy(*shares: Column) -> Column:
    """-sum p ln p over the positive shares."""
    return -sum((F.when(p > 0, p * F.ln(p)).otherwise(0.0) for p in shares), F.lit(0.0))


def snapped(x: Column, least: float = 1e-15) -> Column:
    """0 for values that rounding alone keeps from it."""
    return F.when(F.abs(x) < least, 0.0).otherwise(x)


def agreement(h: Column, *, clamp: bool = True) -> Column:
    """1 for unanimous judgements, 0 for three equal shares."""
    score = 1 - h / LN3
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) if clamp else score


def odd_probabilities(s01: Column, s02: Column, s12: Column) -> list[Column]:
    """Softmax: an item is odd as the other two are similar."""
    top = F.greatest(s01, s02, s12)
    parts = [F.exp(s - top) for s in (s12, s02, s01)]
    total = parts[0] + parts[1] + parts[2]
    return [p / total for p in parts]


@dataclass(frozen=True)
class Thresholds:
    """Limits of the node categories; the spread counts only above ``min_triangles`` triangles."""

    spread: float
    odd: float
    similar: float
    calm: float
    min_triangles: int


HARD = Thresholds(spread=0.1, odd=0.5, similar=0.2, calm=0.05, min_triangles=1)
SOFT = Thresholds(spread=0.02, odd=0.45, similar=0.28, calm=0.02, min_triangles=1)


def category(mean: Column, variance: Column, triangles: Column, t: Thresholds = HARD) -> Column:
    """The first rule that fits, with strict limits."""
    return (
        F.when((triangles > t.min_triangles) & (variance > t.spread), "context_dependent")
        .when((mean > t.odd) & (variance < t.calm), "consistently_odd")
        .when((mean < t.similar) & (variance < t.calm), "consistently_similar")
        .otherwise("mixed")
    )


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def first_token(name: Column, separator: str = "_") -> Column:
    return F.substring_index(name, separator, 1)


def pair_id(left: Column, right: Column) -> Column:
    return F.concat(left.cast("string"), F.lit("|"), right.cast("string"))


#: Bins of the gap between two scores, both ends included.
GAP_BINS = ((1, 3), (4, 7), (8, 15), (16, 30), (31, 200))


def gap_bin(gap: Column, last: str = "31-200") -> Column:
    """Name of the bin; null for 0 and beyond the last bin."""
    found = F.lit(None).cast("string")
    for low, high in reversed(GAP_BINS):
        name = last if low == GAP_BINS[-1][0] else f"{low}-{high}"
        found = F.when(gap.between(low, high), name).otherwise(found)
    return found


def gap_label(gap: Column) -> Column:
    """The bin's name, one of its own for ties and for gaps beyond the bins."""
    return F.when(gap == 0, "0 (tie)").otherwise(F.coalesce(gap_bin(gap), F.lit("31+")))


def larger_side(left: Column, right: Column) -> Column:
    return F.when(left == right, "tie").when(left > right, "left").otherwise("right")


def equal_or_null(a: Column, b: Column) -> Column:
    """1.0 or 0.0; null if either is null."""
    return (a == b).cast("double")


#: Tags of quantised models, in order of precedence.
TAGS = ("nvfp4", "mxfp8", "bf16", "q4", "q8", "fp8", "mlx")


def quantization(model: Column) -> Column:
    found = F.lit("unknown")
    for tag in reversed(TAGS):
        found = F.when(F.lower(model).contains(tag), tag).otherwise(found)
    return found


def parsed_reply(text: Column, key: str = "older") -> tuple[Column, Column]:
    """(choice 1 or 2, confidence) of a model's reply, null where it has none.

    The reply is JSON, or holds an object in prose, or else the first bare 1
    or 2.  A reply that is JSON but no object has no choice.  Numbers are cut
    to integers, booleans count as 0 and 1, strings have to be integers.
    """
    whole = F.try_parse_json(text)
    inside = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    value = F.when(whole.isNotNull(), whole).when(inside != "", F.try_parse_json(inside))
    kind = F.schema_of_variant(value)
    is_object = kind.startswith("OBJECT")

    def field(path: str, to: str) -> Column:
        return F.try_variant_get(value, path, to)

    kind_of_choice = F.schema_of_variant(F.try_variant_get(value, f"$.{key}", "variant"))
    as_text = field(f"$.{key}", "string")
    number = (
        F.when(kind_of_choice == "STRING", as_text.try_cast("bigint"))
        .when(kind_of_choice == "BOOLEAN", F.when(as_text == "true", 1).otherwise(0))
        .otherwise(field(f"$.{key}", "double").try_cast("bigint"))
    )
    number = F.when(number.isin(1, 2), number)
    bare = F.regexp_extract(text, r"\b([12])\b", 1)
    choice = F.when(is_object, number).when(whole.isNull() & (inside == "") & (bare != ""), bare.try_cast("bigint"))
    confidence = F.when(is_object & number.isNotNull(), F.round(field("$.confidence", "double"), 4))
    return choice.cast("int"), confidence


def hash_unit(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) that only the seed and the columns decide."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) / float(1 << 52)


def sample_key(seed: int, *columns: Column) -> Column:
    """A key of 32 hexadecimal digits that only the seed and the columns' texts decide, the same in any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(c.cast("string") for c in columns)))


def key_unit(key: Column) -> Column:
    """A sample key's first eight digits as a number in [0, 1)."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long") / float(1 << 32)
