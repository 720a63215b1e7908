"""Arrays from tables: a dense index column ``idx`` and value columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector(df: DataFrame, idx: str | Column, **values: str | Column) -> DataFrame:
    """A vector (idx from 0, then one column a value); several values are zipped arrays."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(col(idx).cast("long").alias("idx"), *[col(v).alias(k) for k, v in values.items()])


def matrix(df: DataFrame, row: str, values: str) -> DataFrame:
    """A matrix in row form (i, row) as coordinates (i, j, v)."""
    return df.select(F.col(row).alias("i"), F.posexplode(values).alias("j", "v"))


def tensor(vec: DataFrame, *shape: int) -> DataFrame:
    """A column-major view of a vector: coordinates d1, d2, ... (the last one open)."""
    rest, out = F.col("idx"), vec
    for k, size in enumerate(shape, 1):
        out = out.withColumn(f"d{k}", F.pmod(rest, F.lit(size)).cast("long"))
        rest = F.floor(rest / size).cast("long")
    return out.withColumn(f"d{len(shape) + 1}", rest)


def view(vec: DataFrame, first: int, last: int, step: int = 1) -> DataFrame:
    """The slice first..last (inclusive, from 0) by step, with a new dense index."""
    at = F.col("idx") - first
    inside = F.col("idx").between(first, last)
    return vec.filter(inside & (F.pmod(at, F.lit(step)) == 0) if step > 1 else inside).withColumn("idx", F.floor(at / step).cast("long"))


def reversed_view(vec: DataFrame, n: int) -> DataFrame:
    return vec.withColumn("idx", F.lit(n - 1) - F.col("idx"))


def fill(vec: DataFrame, value, kind: str, col: str = "v") -> DataFrame:
    return vec.withColumn(col, F.lit(value).cast(kind))


def iota(spark: SparkSession, n: int) -> DataFrame:
    """1..n at positions 0..n-1."""
    return spark.range(n).select(F.col("id").alias("idx"), (F.col("id") + 1).alias("v"))


def write_into(target: DataFrame, part: DataFrame, first: int, col: str = "v") -> DataFrame:
    """Writes a vector through a view that starts at ``first``; the outside stays."""
    new = part.select((F.col("idx") + first).alias("idx"), F.col(col).alias("_new"), F.lit(True).alias("_hit"))
    return target.join(new, "idx", "left").withColumn(col, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(col))).drop("_new", "_hit")
