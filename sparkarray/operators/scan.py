"""Inclusive prefix scans in index order.

A window without partitions would put the whole array in one task.  Here blocks
of ``BLOCK`` consecutive elements are scanned each in its own window, blocks of
block totals likewise, and only the totals of these, one for each ``BLOCK``
times ``BLOCK`` elements, are scanned together.  Each part gets its
predecessor's total by a join on its number.  The earlier part is always the
left operand, so operators need not commute.

A null element changes nothing: its prefix is that of the element before (null
while there is none), for named operators and for others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tables
from .reduce import skipping_nulls

BLOCK = 4096
FOLD_BLOCK = 32
NAMED: dict[str, tuple[Callable, Callable]] = {
    "+": (F.sum, lambda a, b: a + b),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "*": (F.product, lambda a, b: a * b),
}


def scan_many(df: DataFrame, parts: dict[str, tuple[Column, str]], idx: str = "idx", block: int = BLOCK) -> DataFrame:
    """Several scans (result name: (mapped value, operator)) over one ordering."""
    cut = df.withColumn("_b", F.floor(F.col(idx) / block).cast("long"))
    inside = Window.partitionBy("_b").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    totals = cut.groupBy("_b").agg(*[NAMED[op][0](f).alias(f"_t_{k}") for k, (f, op) in parts.items()])
    offsets = _before(totals, {k: op for k, (_, op) in parts.items()}, block)
    local = cut.select("*", *[NAMED[op][0](f).over(inside).alias(f"_l_{k}") for k, (f, op) in parts.items()]).join(offsets, "_b")
    return local.select(*df.columns, *[_after(F.col(f"_o_{k}"), F.col(f"_l_{k}"), NAMED[op][1]).alias(k) for k, (_, op) in parts.items()])


def _after(offset: Column, value: Column, op: Callable[[Column, Column], Column]) -> Column:
    return F.when(offset.isNull(), value).when(value.isNull(), offset).otherwise(op(offset, value))


def _before(totals: DataFrame, ops: dict[str, str], block: int) -> DataFrame:
    """(_b, _o_...): what comes before each block, by blocks of blocks."""
    far = totals.withColumn("_far", F.floor(F.col("_b") / block).cast("long"))
    sums = far.groupBy("_far").agg(*[NAMED[op][0](f"_t_{k}").alias(f"_f_{k}") for k, op in ops.items()])
    all_ = Window.orderBy("_far").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block of blocks
    near = Window.partitionBy("_far").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_far", *[NAMED[op][0](f"_f_{k}").over(all_).alias(f"_g_{k}") for k, op in ops.items()])
    found = far.select("_b", "_far", *[NAMED[op][0](f"_t_{k}").over(near).alias(f"_h_{k}") for k, op in ops.items()]).join(sums, "_far")
    return found.select("_b", *[_after(F.col(f"_g_{k}"), F.col(f"_h_{k}"), NAMED[op][1]).alias(f"_o_{k}") for k, op in ops.items()])


def scan(df: DataFrame, f: Column, op: str | Callable, g: Callable[[Column], Column] = lambda x: x, name: str = "value", idx: str = "idx") -> DataFrame:
    """(idx, g(prefix)) of a named or an arbitrary associative operator."""
    if callable(op):
        out = _fold_scan(df.select(F.col(idx).alias("idx"), f.alias("_v")), skipping_nulls(op), df.agg(F.max(idx)).first()[0] or 0)
        return out.select(F.col("idx").alias(idx), g(F.col("_v")).alias(name))
    return scan_many(df, {"_s": (f, op)}, idx).select(idx, g(F.col("_s")).alias(name))


def scan_into(target: DataFrame, df: DataFrame, f: Column, op: str | Callable, g: Callable[[Column], Column] = lambda x: x, first: int = 0, col: str = "v", idx: str = "idx") -> DataFrame:
    """A scan written into a target array from position ``first`` on; the rest of the target stays."""
    return tables.write_into(target, scan(df, f, op, g, col, idx), first, col)


def _fold_scan(df: DataFrame, op: Callable[[Column, Column], Column], last: int) -> DataFrame:
    """Scans blocks by an ordered fold, then the block totals by the same, recursively.

    A fold appends to an array that it copies, so blocks are short.
    """
    runs = df.groupBy(F.floor(F.col("idx") / FOLD_BLOCK).cast("long").alias("_b")).agg(F.array_sort(F.collect_list(F.struct("idx", "_v"))).alias("_a"))
    grow = lambda acc, x: F.concat(acc, F.array(F.struct(x["idx"].alias("idx"), op(F.element_at(acc, -1)["_v"], x["_v"]).alias("_v"))))
    runs = runs.select("_b", F.aggregate(F.slice("_a", F.lit(2), F.greatest(F.size("_a") - 1, F.lit(0))), F.slice("_a", 1, 1), grow).alias("_a"))
    if last < FOLD_BLOCK:
        return runs.select(F.inline("_a"))
    totals = _fold_scan(runs.select(F.col("_b").alias("idx"), F.element_at("_a", -1)["_v"].alias("_v")), op, last // FOLD_BLOCK)
    moved = runs.join(totals.select((F.col("idx") + 1).alias("_b"), F.col("_v").alias("_o")), "_b", "left").select("_o", F.inline("_a"))
    return moved.select("idx", op(F.col("_o"), F.col("_v")).alias("_v"))
