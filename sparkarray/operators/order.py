"""Stable sorts, sort permutations and per-column sorts; every result has a position.

The order is total (keys, then index).  Positions come from a range exchange and
two levels of counting, never from a window over everything in one task: each
range is sorted and numbered by itself and gets the number of rows before it.
Both read the ranges of one exchange, which is made once and not cached.

Any strict order ``lt`` can be given instead of keys (:func:`sort_lt`): splitters
from a sample cut the elements into buckets by ``lt`` itself, and each bucket is
sorted by it.  Ties count by index, so equal elements do not share one bucket.

Nulls come first in ascending keys unless the keys say otherwise
(``asc_nulls_last``); an array as such has none.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import store

ALGORITHMS = ("auto", "radix", "sample")
#: Elements of a bucket of a sort by ``lt``, and sampled elements a bucket.
BUCKET, PER_BUCKET = 16_384, 16


def order_key(value: Column) -> list[Column]:
    """Ascending keys of a floating value: -0.0 before +0.0, NaN last."""
    return [value.asc(), F.when((value == 0) & (value.cast("string") == "-0.0"), 0).otherwise(1).asc()]


#: What values of a kind are ordered by, by the name of their Spark type; a type that is not here orders itself. Users may add theirs.
ORDER_KEYS: dict[str, Callable[[Column], list[Column]]] = {"float": order_key, "double": order_key}


def keys_of(df: DataFrame, value: str = "v") -> list[Column]:
    """The ascending keys of a column's values, by its type."""
    return ORDER_KEYS.get(df.schema[value].dataType.simpleString(), lambda v: [v.asc()])(F.col(value))


def check_options(algorithm: str = "auto", comparator: bool = False, keys: bool = False) -> None:
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    if algorithm == "radix" and comparator:
        raise ValueError("a radix sort takes no comparator")
    if algorithm == "sample" and keys:
        raise ValueError("a sample sort takes no separate keys")


def _ranges(df: DataFrame, n: int, by: Sequence[Column]) -> DataFrame:
    """``df`` in n ranges that stay as they are, however often they are read.

    A second plan of the same exchange would sample other borders; so the exchange
    is planned here, and what follows reads its output.
    """
    spark, dealt = df.sparkSession, df.repartitionByRange(n, *by)
    rows = dealt._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, dealt._jdf.schema(), False), spark)


def sort(df: DataFrame, keys: Sequence[Column], idx: str = "idx", pos: str = "pos", algorithm: str = "auto", partitions: int | None = None, separate: bool = False) -> DataFrame:
    """``df`` with ``pos`` from 1 in the order of ``keys``, ties by index; ``separate``: the keys are an array of their own.

    ``algorithm`` is checked as named; all of them are Spark's range exchange and sort.
    """
    check_options(algorithm, keys=separate)
    by = [*keys, F.asc(idx)]
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _ranges(df, n, by)
    sizes = dealt.groupBy(F.spark_partition_id().alias("_p")).agg(F.count(F.lit(1)).alias("_n"))  # a row a range
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    numbered = dealt.sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id())
    range_, nth = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn("_p", range_).join(F.broadcast(starts), "_p").withColumn(pos, (F.col("_s") + nth + 1).cast("long")).drop("_p", "_s", "_m")


def sort_keyval(values: DataFrame, keys: DataFrame, by: Callable[[Column], Column] = lambda k: k.asc(), value: str = "v", key: str = "k", idx: str = "idx") -> DataFrame:
    """Two arrays sorted together by the second: (pos, value, key); they must be of one length."""
    lengths = [a.agg(F.count(F.lit(1)), F.max(idx)).first() for a in (values, keys)]
    if lengths[0] != lengths[1]:
        raise ValueError(f"{lengths[0][0]} values against {lengths[1][0]} keys")
    both = values.select(idx, value).join(keys.select(idx, key), idx)
    return sort(both, [by(F.col(key))], idx, separate=True).select("pos", value, key)


def mirrored(df: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """A sorted array from its end: descending order in which ties are mirrored, too."""
    return df.withColumn(pos, F.lit(n + 1) - F.col(pos))


def sortperm(df: DataFrame, keys: Sequence[Column], idx: str = "idx", **kw) -> DataFrame:
    """(pos, perm): the 1-based index of the element that comes at each position."""
    return sort(df, keys, idx, **kw).select("pos", (F.col(idx) + 1).alias("perm"))


def sort_lt(df: DataFrame, lt: Callable[[Column, Column], Column], value: str = "v", idx: str = "idx", pos: str = "pos", algorithm: str = "auto", bucket: int = BUCKET) -> DataFrame:
    """(pos, idx, value) by a strict order of two values, ties by index."""
    check_options(algorithm, comparator=True)
    before = lambda a, b: lt(a["v"], b["v"]) | (~lt(b["v"], a["v"]) & (a["i"] < b["i"]))
    compare = lambda a, b: F.when(before(a, b), -1).when(before(b, a), 1).otherwise(0)
    pairs = df.select(F.struct(F.col(value).alias("v"), F.col(idx).alias("i")).alias("_e"))
    buckets = df.count() // bucket + 1
    cuts = _splitters(pairs, compare, buckets, df.schema[value].dataType.simpleString())
    at = F.lit(0)
    if cuts is not None:
        # How many of the sorted splitters come before the element, by binary search; past the last one there is nothing.
        known = F.from_json(F.lit(cuts[0]), f"array<struct<v:{df.schema[value].dataType.simpleString()},i:bigint>>")
        steps = F.lit([1 << k for k in reversed(range(cuts[1].bit_length()))])
        at = F.aggregate(steps, F.lit(0), lambda p, k: F.when((p + k <= cuts[1]) & before(F.get(known, p + k - 1), F.col("_e")), p + k).otherwise(p))
    runs = pairs.groupBy(at.alias("_b")).agg(F.array_sort(F.collect_list("_e"), compare).alias("_a"))
    runs = store(runs, "sorted-buckets")
    earlier = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("_b", F.coalesce(F.sum(F.size("_a")).over(earlier), F.lit(0)).alias("_s"))  # a row a bucket
    out = runs.join(F.broadcast(starts), "_b").select("_s", F.posexplode("_a").alias("_k", "_e"))
    return out.select((F.col("_s") + F.col("_k") + 1).cast("long").alias(pos), F.col("_e.i").alias(idx), F.col("_e.v").alias(value))


def _splitters(pairs: DataFrame, compare: Callable[[Column, Column], Column], buckets: int, kind: str) -> tuple[str, int] | None:
    """Quantiles of about ``PER_BUCKET`` sampled elements a bucket, as JSON, and their number."""
    if buckets == 1:
        return None
    wanted = PER_BUCKET * buckets
    drawn = pairs.filter(F.pmod(F.xxhash64("_e.i"), F.lit(1 << 30)) < F.lit(int(min(1.0, wanted / (pairs.count() + 1)) * (1 << 30))))
    ordered = drawn.agg(F.array_sort(F.collect_list("_e"), compare).alias("_a"))
    every = F.transform(F.sequence(F.lit(1), F.lit(buckets - 1)), lambda k: F.get(F.col("_a"), F.floor(k * F.size("_a") / buckets).cast("int")))
    found = ordered.select(F.to_json(F.filter(every, lambda e: e.isNotNull())).alias("c"), F.size(F.filter(every, lambda e: e.isNotNull())).alias("n")).first()
    return (found["c"], found["n"]) if found["n"] else None


def sort_columns(coo: DataFrame, descending: bool = False, key: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each column j of (i, j, v) sorted on its own, by a key of v if one is given: (pos, j, v), pos from 1.

    All columns are sorted at once, by column first, so a long column is many
    ranges.  A position counts from the column's first element of the same range,
    behind those of the ranges before.
    """
    value = F.col("v") if key is None else key(F.col("v"))
    by = [F.asc("j"), value.desc() if descending else value.asc(), F.asc("i")]
    dealt = _ranges(coo.select("i", "j", "v"), int(coo.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)
    parts = dealt.groupBy(F.spark_partition_id().alias("_p"), "j").agg(F.count(F.lit(1)).alias("_n"))  # a row a column and range
    before = lambda one, then: F.coalesce(F.sum("_n").over(Window.partitionBy(one).orderBy(then).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("_p", "j", (before("j", "_p") - before("_p", "j")).alias("_s"))
    numbered = dealt.sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33))
    return numbered.join(starts, ["_p", "j"]).select("j", "v", (F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_s") + 1).alias("pos"))


def sort_arrays(df: DataFrame, col: str, descending: bool = False, lt: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The same where each column is held as one array, also by any strict order."""
    if lt is not None:
        return df.withColumn(col, F.array_sort(col, lambda a, b: F.when(lt(a, b), -1).when(lt(b, a), 1).otherwise(0)))
    return df.withColumn(col, F.sort_array(col, not descending))
