"""Judges: the interface, a mock and a factory; a task judges its rows with one judge."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Answer = dict[str, Any]


class Judge(Protocol):
    """Compares two items; ``older`` of an answer is 1, 2 or None.

    An answer has older, confidence, raw, latency_s and error.
    """

    def health(self) -> tuple[bool, str]:
        """Whether the judge can be asked, and why not."""
        ...

    def judge(self, first: str, second: str) -> Answer: ...


class MockJudge:
    """Right with a given probability, else wrong, and sometimes 1 whatever it sees; draws are hashes, so reruns agree."""

    def __init__(self, scores: dict[str, float], *, accuracy: float = 0.78, bias: float = 0.06, seed: int = 0) -> None:
        self.scores, self.accuracy, self.bias, self.seed = scores, accuracy, bias, seed

    def health(self) -> tuple[bool, str]:
        return bool(self.scores), "" if self.scores else "no scores"

    def _draw(self, k: int, first: str, second: str) -> float:
        return xxhash.xxh64_intdigest(f"{first}|{second}", seed=self.seed + k) / 2**64

    def judge(self, first: str, second: str) -> Answer:
        begun = time.monotonic()
        a, b = self.scores.get(first), self.scores.get(second)
        if a is None or b is None:
            return {"older": None, "confidence": None, "raw": "", "latency_s": 0.0, "error": f"no score: {first if a is None else second}"}
        right = 1 if a > b else 2
        choice = right if self._draw(0, first, second) < self.accuracy else 3 - right
        if self._draw(1, first, second) < self.bias:
            choice = 1
        sure = round(0.5 + self._draw(2, first, second) / 2, 3)
        return {"older": choice, "confidence": sure, "raw": f'{{"older": {choice}, "confidence": {sure}}}', "latency_s": round(time.monotonic() - begun, 3), "error": None}


#: Judges by provider; another one is added by ``register``.
_PROVIDERS: dict[str, Callable[..., Judge]] = {"mock": MockJudge}


def register(provider: str, make: Callable[..., Judge]) -> None:
    _PROVIDERS[provider] = make


def make_judge(provider: str, **settings: Any) -> Judge:
    if provider not in _PROVIDERS:
        raise ValueError(f"no judge of this name: {provider}")
    return _PROVIDERS[provider](**settings)


def without_items(tasks: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks whose items (item) both are there, and those that lack one, with choice null and an error that names it.

    Of two items that are missing the one shown first is named.
    """
    here = items.select("item").distinct()
    swapped = F.col("presentation") == "swapped"
    shown = tasks.withColumns({"__1": F.when(swapped, F.col("right_item")).otherwise(F.col("left_item")), "__2": F.when(swapped, F.col("left_item")).otherwise(F.col("right_item"))})
    marked = shown
    for k in "12":
        marked = marked.join(here.select(F.col("item").alias(f"__h{k}")), F.col(f"__{k}") == F.col(f"__h{k}"), "left")
    lacking = F.when(F.col("__h1").isNull(), F.col("__1")).when(F.col("__h2").isNull(), F.col("__2"))
    marked = marked.withColumn("__lacking", lacking)
    good = marked.where("__lacking IS NULL").select(*tasks.columns)
    bad = marked.where("__lacking IS NOT NULL").withColumns({"choice": F.lit(None).cast("int"), "model_confidence": F.lit(None).cast("double"), "error": F.concat(F.lit("missing item: "), "__lacking")})
    return good, bad.select(*tasks.columns, "choice", "model_confidence", "error")


def judged(tasks: DataFrame, make: Callable[[], Judge]) -> DataFrame:
    """Tasks with choice, model_confidence, raw_response, latency_s and error; each task of Spark makes one judge.

    A judge that isn't well gives every row its reason as the error; one that
    raises gives the exception's text, and goes on.
    """
    fields = f"{', '.join(f'`{c}` {t}' for c, t in tasks.dtypes)}, choice int, model_confidence double, raw_response string, latency_s double, error string"

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = make()
        well, reason = judge.health()
        for batch in batches:
            swapped = batch["presentation"] == "swapped"
            first, second = batch["right_item"].where(swapped, batch["left_item"]), batch["left_item"].where(swapped, batch["right_item"])
            answers = []
            for a, b in zip(first, second):
                try:
                    answers.append(judge.judge(a, b) if well else {"error": reason})
                except Exception as e:  # a record of the failure, as for any other answer
                    answers.append({"error": f"{type(e).__name__}: {e}"})
            more = {"choice": "older", "model_confidence": "confidence", "raw_response": "raw", "latency_s": "latency_s", "error": "error"}
            out = batch.assign(**{c: pd.array([x.get(k) for x in answers], "Int32") if c == "choice" else [x.get(k) for x in answers] for c, k in more.items()})
            yield out.astype({"model_confidence": "float64", "latency_s": "float64"})

    return tasks.mapInPandas(ask, fields)
