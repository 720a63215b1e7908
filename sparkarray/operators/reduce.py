"""Map-reduce: full, over dimensions, over several arrays, with any operator.

Named operators become Catalyst aggregates (partial and final, no ordering).
Any other associative operator, commutative or not, is folded in index order:
blocks of ``BLOCK`` elements are folded first, then the block results, level by
level, so no task ever holds more than one block.  Null elements are passed over.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import tables

NAMED: dict[str, Callable[[Column], Column]] = {"+": F.sum, "*": F.product, "max": F.max, "min": F.min, "and": F.bit_and, "or": F.bit_or, "xor": F.bit_xor, "count": F.count, "mean": F.avg, "var": F.var_pop}
BLOCK = 256


def wrap(total: Column, bits: int, signed: bool = False) -> Column:
    """An integer sum as it would be at an element width of ``bits``."""
    size = F.lit(1 << bits)
    return F.pmod(total + F.lit(1 << (bits - 1)), size) - F.lit(1 << (bits - 1)) if signed else F.pmod(total, size)


def skipping_nulls(op: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """The operator for elements that may be null: these change nothing."""
    return lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(op(a, b))


def dims_of(dims: int | Sequence[int] | None, rank: int) -> list[int]:
    """Dimensions from 1, sorted; negative ones count from the end; checked."""
    if dims is None:
        return list(range(1, rank + 1))
    found = sorted(rank + d + 1 if d < 0 else d for d in ([dims] if isinstance(dims, int) else dims))
    if any(not 1 <= d <= rank for d in found):
        raise ValueError(f"dimensions {dims} are out of range for rank {rank}")
    if len(set(found)) < len(found):
        raise ValueError(f"dimensions {dims} repeat")
    return found


def mapreduce(df: DataFrame, f: Column, op: str | Callable, g: Callable[[Column], Column] = lambda x: x, keys: Sequence[str] = (), name: str = "value") -> DataFrame:
    """g(op over f) for each combination of ``keys`` (none: the whole array)."""
    if callable(op):
        return fold(df, f, op, keys, name).select(*keys, g(F.col(name)).alias(name))
    return df.groupBy(*keys).agg(g(NAMED[op](f)).alias(name))


def mapreduce_struct(df: DataFrame, parts: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """A struct-valued reduction: one aggregate a component."""
    return df.groupBy(*keys).agg(*[c.alias(k) for k, c in parts.items()])


def mapreduce_arrays(df: DataFrame, f: Callable[..., Column], op: str | Callable, *arrays: str, dims=None, g: Callable[[Column], Column] = lambda x: x, name: str = "value") -> DataFrame:
    """op over f of several zipped arrays; over all elements only."""
    if dims is not None:
        raise ValueError("several arrays are reduced as a whole, not over dimensions")
    return mapreduce(df, f(*[F.col(a) for a in arrays]), op, g, name=name)


def mapreduce2d(coo: DataFrame, f: Column, op: str | Callable, dim: int, g: Callable[[Column], Column] = lambda x: x, name: str = "value") -> DataFrame:
    """A matrix (i, j, v) reduced over its first dimension (a value each j) or its second (a value each i)."""
    if dim not in (1, 2):
        raise ValueError(f"dim must be 1 or 2, not {dim}")
    kept, gone = ("j", "i") if dim == 1 else ("i", "j")
    if callable(op):
        return fold(coo, f, op, [kept], name, gone).select(kept, g(F.col(name)).alias(name))
    return mapreduce(coo, f, op, g, [kept], name)


def mapreduce_into(target: DataFrame, df: DataFrame, f: Column, op: str | Callable, g: Callable[[Column], Column] = lambda x: x, at: int = 0, col: str = "v") -> DataFrame:
    """A reduction written into a target array at position ``at``; the rest of the target stays."""
    return tables.write_into(target, mapreduce(df, f, op, g, name=col).select(F.lit(0).cast("long").alias("idx"), col), at, col)


def mapreduce_dims(tensor: DataFrame, f: Column, op: str | Callable, dims, rank: int, g: Callable[[Column], Column] = lambda x: x, name: str = "value") -> DataFrame:
    """Reduces over ``dims``; the reduced coordinates stay, as 0."""
    gone = dims_of(dims, rank)
    kept = [f"d{k}" for k in range(1, rank + 1) if k not in gone]
    out = mapreduce(tensor, f, op, g, kept, name)
    return out.select(*[F.col(f"d{k}") if f"d{k}" in kept else F.lit(0).cast("long").alias(f"d{k}") for k in range(1, rank + 1)], name)


def multi_reduce(tensor: DataFrame, agg: Column, sets: Sequence[Sequence[str]], coords: Sequence[str], name: str = "value") -> DataFrame:
    """Several choices of kept coordinates in one pass (grouping sets)."""
    return tensor.groupingSets([[F.col(c) for c in s] for s in sets], *coords).agg(agg.alias(name))


def fold(df: DataFrame, f: Column, op: Callable[[Column, Column], Column], keys: Sequence[str] = (), name: str = "value", idx: str = "idx") -> DataFrame:
    """Ordered fold by any associative operator, without an identity element."""
    op = skipping_nulls(op)
    level = df.select(*keys, F.col(idx).alias("_i"), f.alias("_v"))
    rest = df.agg(F.max(idx)).first()[0]
    while True:
        block = F.floor(F.col("_i") / BLOCK).cast("long")
        run = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"])
        level = level.groupBy(*keys, block.alias("_b")).agg(run.alias("_a")).select(*keys, F.col("_b").alias("_i"), F.aggregate(F.slice("_a", F.lit(2), F.greatest(F.size("_a") - 1, F.lit(0))), F.col("_a")[0], op).alias("_v"))
        rest = (rest or 0) // BLOCK
        if not rest:
            return level.select(*keys, F.col("_v").alias(name))


def extremum(df: DataFrame, value: Column, largest: bool = True, name: str = "value") -> DataFrame:
    return df.agg((F.max if largest else F.min)(value).alias(name))


def maximum(df: DataFrame, value: Column, rel: Callable[[Column, Column], Column], name: str = "value") -> DataFrame:
    """The largest value under a strict relation ``rel(x, y)``: x is less than y; of equal ones the first."""
    return fold(df, value, lambda x, y: F.when(rel(x, y), y).otherwise(x), name=name)
