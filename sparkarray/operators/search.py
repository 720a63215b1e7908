"""First, last and extremal positions; ties go to the smallest index, nulls are never extremal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def find(df: DataFrame, predicate: Column, last: bool = False, idx: str = "idx", name: str = "idx") -> DataFrame:
    """One row: the first (last) index that fits, or null."""
    return df.filter(predicate).agg((F.max if last else F.min)(idx).alias(name))


def coordinates(df: DataFrame, at: str, *shape: int) -> DataFrame:
    """A linear index as column-major coordinates, null if there is none."""
    rest, out = F.col(at), []
    for k, size in enumerate(shape, 1):
        out.append(F.pmod(rest, F.lit(size)).cast("long").alias(f"d{k}"))
        rest = F.floor(rest / size).cast("long")
    return df.select(*out, rest.alias(f"d{len(shape) + 1}"))


def argbest(df: DataFrame, keys: Sequence[Column], idx: str = "idx", name: str = "idx") -> DataFrame:
    """The index of the best row under ordered sort keys (e.g. ``F.desc("v")``)."""
    return df.orderBy(*keys, F.asc(idx)).limit(1).select(F.col(idx).alias(name))


def argmax(df: DataFrame, value: Column, **kw) -> DataFrame:
    return argbest(df, [value.desc_nulls_last()], **kw)


def argmin(df: DataFrame, value: Column, **kw) -> DataFrame:
    return argbest(df, [value.asc_nulls_last()], **kw)
