"""Matrix-vector and vector-matrix products over any map and operator.

A matrix in row form keeps a row's values in one array; a vector of the row's
length, up to ``MOST``, then goes along as a literal and the product needs no
shuffle.  A longer vector, or a matrix in coordinate form, is joined on the
shared index and aggregated; the join strategy is left to Catalyst.

A vector of another length than the rows is an error: where the matrix has an
index that the vector has not as the product is computed, where the vector is
longer as ``check_shapes`` compares the largest indices.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import tables
from .reduce import NAMED, fold as ordered_fold

MOST = 1 << 16
FOLDS: dict[str, Callable[[Column, Column], Column]] = {"+": lambda a, b: a + b, "max": lambda a, b: F.greatest(a, b), "min": lambda a, b: F.least(a, b), "*": lambda a, b: a * b}


def matvec_rows(rows: DataFrame, values: Column, x: Sequence | None, f: Callable[..., Column] = lambda a, b: a * b, op: str | Callable = "+", g: Callable[[Column], Column] = lambda v: v, name: str = "value", keep: Sequence[str] = ("i",)) -> DataFrame:
    """y[i] = g(op over j of f(A[i, j], x[j])), row by row; without x, f has one argument."""
    if x is not None and len(x) > MOST:
        long = rows.sparkSession.createDataFrame(list(enumerate(x)), "j long, x " + dict(rows.select(values.alias("a")).dtypes)["a"].removeprefix("array<").removesuffix(">"))
        coo = rows.select(*keep, F.posexplode(values).alias("j", "v"))
        return matvec(coo, long, f, op, g, name, keep)
    fold = op if callable(op) else FOLDS[op]
    if x is not None:
        other = F.raise_error(F.concat(F.lit(f"a vector of {len(x)} values against a row of "), F.size(values)))
        values = F.when(values.isNull() | (F.size(values) == len(x)), values).otherwise(other)
    mapped = F.transform(values, f) if x is None else F.zip_with(values, F.lit(list(x)), f)
    first = F.aggregate(F.slice(mapped, 2, 1 << 30), mapped[0], fold)
    return rows.select(*keep, g(first).alias(name))


def check_shapes(coo: DataFrame, x: DataFrame, on: str) -> None:
    """Raises where the vector's last index is not that of the matrix."""
    ends = [a.agg(F.max(on)).first()[0] for a in (coo, x)]
    if ends[0] != ends[1]:
        raise ValueError(f"a vector up to {on} = {ends[1]} against a matrix up to {on} = {ends[0]}")


def _joined(coo: DataFrame, x: DataFrame, on: str) -> DataFrame:
    """Every element with the vector's, which must be there."""
    known = x.select(on, "x", F.lit(True).alias("_there"))
    missing = F.raise_error(F.concat(F.lit(f"the vector has no {on} = "), F.col(on).cast("string")))
    return coo.join(known, on, "left").withColumn("x", F.when(F.col("_there"), F.col("x")).otherwise(missing.cast(x.schema["x"].dataType)))


def _reduced(df: DataFrame, value: Column, op: str | Callable, g: Callable[[Column], Column], keys: Sequence[str], name: str, along: str) -> DataFrame:
    if callable(op):
        return ordered_fold(df, value, op, keys, name, along).select(*keys, g(F.col(name)).alias(name))
    return df.groupBy(*keys).agg(g(NAMED[op](value)).alias(name))


def matvec(coo: DataFrame, x: DataFrame, f: Callable[[Column, Column], Column], op: str | Callable, g: Callable[[Column], Column] = lambda v: v, name: str = "value", keep: Sequence[str] = ("i",)) -> DataFrame:
    """The same in coordinate form: A(i, j, v), x(j, x); any other operator folds in the order of j."""
    return _reduced(_joined(coo, x, "j"), f(F.col("v"), F.col("x")), op, g, keep, name, "j")


def vecmat(x: DataFrame | None, coo: DataFrame, f: Callable[..., Column], op: str | Callable, g: Callable[[Column], Column] = lambda v: v, name: str = "value") -> DataFrame:
    """y[j] = g(op over i of f(x[i], A[i, j])); without x a reduction of each column."""
    if x is None:
        return _reduced(coo, f(F.col("v")), op, g, ["j"], name, "i")
    return _reduced(_joined(coo, x, "i"), f(F.col("x"), F.col("v")), op, g, ["j"], name, "i")


def matvec_into(target: DataFrame, coo: DataFrame, x: DataFrame, f: Callable[[Column, Column], Column], op: str | Callable, g: Callable[[Column], Column] = lambda v: v, first: int = 0, col: str = "v") -> DataFrame:
    """A product written into a target array from position ``first`` on; the rest of the target stays."""
    return tables.write_into(target, matvec(coo, x, f, op, g, col).withColumnRenamed("i", "idx"), first, col)


def vecmat_into(target: DataFrame, x: DataFrame | None, coo: DataFrame, f: Callable[..., Column], op: str | Callable, g: Callable[[Column], Column] = lambda v: v, first: int = 0, col: str = "v") -> DataFrame:
    """The same for the vector-matrix product."""
    return tables.write_into(target, vecmat(x, coo, f, op, g, col).withColumnRenamed("j", "idx"), first, col)
