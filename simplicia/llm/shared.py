"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simplicia.tables import forget, read, shared_dir, written  # noqa: F401

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays as it is."""
    return F.translate(text, UPPER, LOWER)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one where ``df`` has a column that begins with it (in any case of letters)."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name = "_" + name
    return name


def with_columns_by(df: DataFrame, added: list[T.StructField], make: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list[pa.Array]]]]) -> DataFrame:
    """All columns of ``df``, whatever their names, and those that ``make`` gives for (parts of) its batches."""
    # dots in names would be read as fields of structs
    plain = [c if "." not in c and "`" not in c else f"column {i}" for i, c in enumerate(df.columns)]
    fields = [T.StructField(c, f.dataType) for c, f in zip(plain, df.schema.fields, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, arrays in make(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*plain, *(f.name for f in added)])

    return df.toDF(*plain).mapInArrow(run, T.StructType([*fields, *added])).toDF(*df.columns, *(f.name for f in added))
