"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_once  # noqa: F401 - re-exported for the operators

#: Stands in for a null id inside an operator, so that joins and grouping keep the row.
NULL_ID = -(2 ** 63)
#: The white space of the text contracts, `[\x20\x09-\x0D]`.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def isolate(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Rename the columns by position, so that no extra column can clash with
    an operator's own. Returns the frame and the first internal name of each."""
    at: dict[str, str] = {}
    for i, c in enumerate(df.columns):
        at.setdefault(c, f"_c{i}")
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))]), at


def restore(df: DataFrame, columns: list[str]) -> DataFrame:
    """Back to the names (and order) that ``isolate`` replaced; drops the rest."""
    return df.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)])


def row_id(c: str) -> Column:
    return F.coalesce(F.col(c).cast("long"), F.lit(NULL_ID))


def ascii_lower(c: Column) -> Column:
    """A-Z only. ``lower`` does that for pure ASCII and is far cheaper than ``translate``."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def fold(c: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % folds


#: Spark gives a plan over rows it can't see (a local list, an RDD) an enormous default size.
UNKNOWN_BYTES, ROW_BYTES, MOST_SLOTS = 1 << 50, 4096, 1 << 24


def planned_bytes(df: DataFrame) -> int:
    """Spark's own size estimate of a plan: for a plain read, the bytes of its files. Where it has none, rows are counted."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.count() * ROW_BYTES if size >= UNKNOWN_BYTES else size


def slots(df: DataFrame, mb: float) -> int:
    """How many parts of about ``mb`` MB the frame's input makes; grows with it."""
    return min(max(8, -(-planned_bytes(df) // int(mb * 1e6))), MOST_SLOTS)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Sorted values that a bucket works on at once.
AT_ONCE = 400_000


def value_ranges(pieces: list[np.ndarray], most: int = AT_ONCE):
    """Cut sorted arrays of hashes at common values, so that about ``most`` values come at a time
    and equal ones together: yields the (start, stop) of each array."""
    total = sum(len(p) for p in pieces)
    if not total:
        return
    low, high = int(min(p[0] for p in pieces if len(p))), int(max(p[-1] for p in pieces if len(p)))
    parts = -(-total // most)
    cuts = [low + (high - low) * k // parts for k in range(1, parts)]
    starts = [0] * len(pieces)
    for cut in [*cuts, None]:
        stops = [len(p) if cut is None else int(np.searchsorted(p, p.dtype.type(cut))) for p in pieces]
        if any(a < b for a, b in zip(starts, stops, strict=True)):
            yield list(zip(starts, stops, strict=True))
        starts = stops
