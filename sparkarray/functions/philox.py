"""Counter-based random numbers: value i depends on (seed, i) alone.

Philox4x32 with ten rounds, as expressions: each round is a projection of its
own, so that no round's inputs are computed twice.  Products of 32-bit numbers
are split at 16 bits and never leave a signed 64-bit integer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the generator.
M0, M1, W0, W1, ROUNDS, U32 = 0xD2511F53, 0xCD9E8D57, 0x9E3779B9, 0xBB67AE85, 10, 0xFFFFFFFF


def _mul(m: int, x: Column) -> tuple[Column, Column]:
    """High and low 32 bits of a product of 32-bit numbers."""
    low, high = x * F.lit(m & 0xFFFF), x * F.lit(m >> 16)
    total = low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)
    return F.shiftright(high, 16) + F.shiftright(total, 32), total.bitwiseAND(F.lit(U32))


def with_philox(df: DataFrame, seed: int, block: Column) -> DataFrame:
    """Adds r0..r3, the four 32-bit outputs (as longs) of a counter block."""
    cols = df.columns
    block = block.cast("long")
    out = df.select(*cols, block.bitwiseAND(F.lit(U32)).alias("r0"), F.shiftright(block, 32).alias("r1"), F.lit(0).cast("long").alias("r2"), F.lit(0).cast("long").alias("r3"))
    k0, k1 = seed & U32, seed >> 32 & U32
    for _ in range(ROUNDS):
        (h0, l0), (h1, l1) = _mul(M0, F.col("r0")), _mul(M1, F.col("r2"))
        out = out.select(*cols, h1.bitwiseXOR(F.col("r1")).bitwiseXOR(F.lit(k0).cast("long")).alias("r0"), l1.alias("r1"), h0.bitwiseXOR(F.col("r3")).bitwiseXOR(F.lit(k1).cast("long")).alias("r2"), l0.alias("r3"))
        k0, k1 = k0 + W0 & U32, k1 + W1 & U32
    return out


def _lanes(df: DataFrame, seed: int, per: int, idx: str) -> tuple[DataFrame, Column]:
    return with_philox(df, seed, F.floor(F.col(idx) / per)), F.pmod(F.col(idx), F.lit(per))


def uniform_u32(df: DataFrame, seed: int, idx: str = "idx", name: str = "u") -> DataFrame:
    """32 random bits for each index (from 0): four a block."""
    out, lane = _lanes(df, seed, 4, idx)
    picked = F.when(lane == 0, F.col("r0")).when(lane == 1, F.col("r1")).when(lane == 2, F.col("r2")).otherwise(F.col("r3"))
    return out.select(*df.columns, picked.alias(name))


def uniform_u64(df: DataFrame, seed: int, idx: str = "idx", name: str = "u") -> DataFrame:
    """64 random bits for each index: two a block; a long whose bits are those of the unsigned number."""
    out, lane = _lanes(df, seed, 2, idx)
    high, low = (F.when(lane == 0, F.col(a)).otherwise(F.col(b)) for a, b in (("r1", "r3"), ("r0", "r2")))
    return out.select(*df.columns, F.shiftleft(high, 32).bitwiseOR(low).alias(name))


def uniform_f32(df: DataFrame, seed: int, idx: str = "idx", name: str = "u") -> DataFrame:
    """Uniform on [0, 1) with 23 bits."""
    out = uniform_u32(df, seed, idx, "_u")
    return out.select(*df.columns, (F.shiftright("_u", 9) / F.lit(8388608.0)).alias(name))


def uniform_f64(df: DataFrame, seed: int, idx: str = "idx", name: str = "u") -> DataFrame:
    """Uniform on [0, 1) with 52 bits: two a block."""
    out, lane = _lanes(df, seed, 2, idx)
    high, low = (F.when(lane == 0, F.col(a)).otherwise(F.col(b)) for a, b in (("r1", "r3"), ("r0", "r2")))
    return out.select(*df.columns, ((high.cast("double") * F.lit(1048576.0) + F.shiftright(low, 12)) / F.lit(4503599627370496.0)).alias(name))


class Distribution:
    """A distribution as an expression of uniforms; subclass it for others."""

    def sample(self, df: DataFrame, seed: int, idx: str = "idx", name: str = "v") -> DataFrame:
        return uniform_f32(df, seed, idx, "_u01").withColumn(name, self.of(F.col("_u01"))).drop("_u01")

    def of(self, u: Column) -> Column:
        raise NotImplementedError


class Uniform(Distribution):
    def __init__(self, a: float, b: float) -> None:
        self.a, self.b = a, b

    def of(self, u: Column) -> Column:
        return u * F.lit(self.b - self.a) + F.lit(self.a)


class Bernoulli(Distribution):
    def __init__(self, p: float) -> None:
        self.p = p

    def of(self, u: Column) -> Column:
        return u < F.lit(self.p)


class Exponential(Distribution):
    def __init__(self, rate: float) -> None:
        self.rate = rate

    def of(self, u: Column) -> Column:
        return -F.log(F.lit(1.0) - u) / F.lit(self.rate)


class Categorical(Distribution):
    def __init__(self, cumulative: Sequence[float]) -> None:
        self.cumulative = list(cumulative)

    def of(self, u: Column) -> Column:
        return sum(((u >= F.lit(c)).cast("int") for c in self.cumulative), F.lit(1))


class Normal(Distribution):
    """Pairs of normals from pairs of uniforms (Box and Muller)."""

    def __init__(self, mean: float = 0.0, sd: float = 1.0) -> None:
        self.mean, self.sd = mean, sd

    def sample(self, df: DataFrame, seed: int, idx: str = "idx", name: str = "v") -> DataFrame:
        cols = df.columns
        out = with_philox(df, seed, F.floor(F.col(idx) / 4)).withColumn("_two", F.pmod(F.floor(F.col(idx) / 2), F.lit(2)))
        unit = lambda a, b: F.shiftright(F.when(F.col("_two") == 0, F.col(a)).otherwise(F.col(b)), 9) / F.lit(8388608.0)
        out = out.select(*cols, F.greatest(unit("r0", "r2"), F.lit(1e-38)).alias("_u"), (unit("r1", "r3") * F.lit(6.283185307179586)).alias("_t"))
        side = F.when(F.pmod(F.col(idx), F.lit(2)) == 0, F.cos("_t")).otherwise(F.sin("_t"))
        return out.select(*cols, (F.lit(self.mean) + F.lit(self.sd) * F.sqrt(F.lit(-2.0) * F.log("_u")) * side).alias(name))


def rand(df: DataFrame, seed: int, idx: str = "idx", name: str = "v", kind: str = "double") -> DataFrame:
    """Uniform numbers in [0, 1): ``float`` (23 bits) or ``double`` (52 bits)."""
    return (uniform_f32 if kind == "float" else uniform_f64)(df, seed, idx, name)


def randn(df: DataFrame, seed: int, idx: str = "idx", name: str = "v") -> DataFrame:
    """Standard normal numbers."""
    return Normal().sample(df, seed, idx, name)


def philox_sql(source: str, idx: str, seed: int, per: int) -> str:
    """DuckDB SQL that gives ``source``'s rows with r0..r3 (UBIGINT)."""
    sql = f"SELECT *, (({idx} // {per}) & {U32})::UBIGINT AS r0, (({idx} // {per}) >> 32)::UBIGINT AS r1, 0::UBIGINT AS r2, 0::UBIGINT AS r3 FROM {source}"
    k0, k1 = seed & U32, seed >> 32 & U32
    for _ in range(ROUNDS):
        a, b = f"({M0}::UBIGINT * r0)", f"({M1}::UBIGINT * r2)"
        sql = f"SELECT * REPLACE (xor(xor({b} >> 32, r1), {k0}::UBIGINT) AS r0, {b} & {U32}::UBIGINT AS r1, xor(xor({a} >> 32, r3), {k1}::UBIGINT) AS r2, {a} & {U32}::UBIGINT AS r3) FROM ({sql})"
        k0, k1 = k0 + W0 & U32, k1 + W1 & U32
    return f"({sql})"
