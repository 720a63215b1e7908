"""Size-balanced shards by sampled splitters.  Law: ``bytes``.

Records are ordered by key (MD5 of the text, then the id), so equal texts stand
together.  Size-weighted samples of the keys give splitters, which cut the key
space into many fine ranges of near equal bytes; a range that turns out overfull
is subdivided by splitters drawn from itself.  The ranges' totals, prefix-summed,
place each range on the byte line, and a running sum within a range places each
record.  A shard is an equal share of the byte line.  A group of equal texts
smaller than ``GLUE`` of a shard (and than a range) stays whole on one side of a
border; a larger one is cut by id.  Borders of ranges cut only groups that are
several ranges large, so where records go does not depend on what was drawn.

No task sees more than one range.  Ranges grow in number with the table, and the
sample has a fixed expected size a range (less for very many), so the splitters
that go to the executors have a proven bound: ``MOST_RANGES`` of 16 bytes.

Cases: a null text weighs ``OVERHEAD`` bytes, a very long one its bytes (a shard
is as much too large as half of it at most); null ids come first in their group;
rows that share an id, and repeated rows, are separate records; with fewer
records than shards some shards stay empty; an empty table gives an empty
result; :func:`shard` leaves out other columns, :func:`write_shards` keeps them
beside ``shard`` and ``slot``, which replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scope, spread, stored, table

OVERHEAD, GLUE, PER = 8, 0.005, 16
#: Ranges: one for so many rows, within these bounds (more rows make longer ranges, which sort on disk).
ROWS_PER_RANGE, LEAST_RANGES, MOST_RANGES = 2_000, 96, 1 << 18
#: Draws that the driver sorts; a range is subdivided while it has so many times its share of the bytes.
MOST_DRAWS, OVERFULL = 1 << 21, 3


def _draws(size: Column, rate: float, seed: int) -> Column:
    """How many of a record's size-weighted draws fall on it."""
    u = F.pmod(F.xxhash64("_h", "_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(size * F.lit(rate) + u)


def _splitters(rows: DataFrame, ranges: int, total: int, seed: int) -> list[tuple[int, int]]:
    """Quantile borders of about ``ranges * PER`` size-weighted key samples."""
    draws = min(ranges * PER, MOST_DRAWS)
    drawn = rows.withColumn("_d", _draws(F.col("_size"), draws / max(1, total), seed)).filter("_d > 0")
    keys = drawn.select("_h", F.coalesce("_id", F.lit(-(1 << 63))).alias("_id"), F.least("_d", F.lit(draws)).alias("_d")).toPandas()
    if not len(keys):
        return []
    keys = keys.sort_values(["_h", "_id"], kind="stable")
    upto, at = keys["_d"].cumsum().to_numpy(), np.arange(1, ranges)
    picked = keys.iloc[np.unique(np.searchsorted(upto, at * upto[-1] / ranges, side="left"))]
    # Only a text that gets several borders is cut by id, at its second one and on; another's border stands before it.
    nth, many = picked.groupby("_h").cumcount(), picked.groupby("_h")["_h"].transform("size")
    at = picked["_id"].where((many >= 3) & (nth > 0), -(1 << 63))
    return sorted(set(zip(picked["_h"].tolist(), at.tolist(), strict=True)))


def _ranged(rows: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """Adds _range: how many splitters are at or below the record's key."""
    shared = rows.sparkSession.sparkContext.broadcast((np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)))
    schema = ", ".join(f"{c} {k}" for c, k in rows.dtypes) + ", _range int"
    at_h, at_id = rows.columns.index("_h"), rows.columns.index("_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, ids = shared.value
        for b in batches:
            h = b.column(at_h).to_numpy(zero_copy_only=False)
            i = b.column(at_id).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(hs, h, side="left"), np.searchsorted(hs, h, side="right")
            place = low.copy()
            for k in np.flatnonzero(high > low):  # the key's hash is a splitter's
                place[k] = low[k] + np.searchsorted(ids[low[k] : high[k]], i[k], side="right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place, pa.int32())], [*b.schema.names, "_range"])

    return rows.mapInArrow(run, schema)


def _numbered(docs: DataFrame, id_col: str, text_col: str, whole: bool) -> DataFrame:
    """Each row's number and key, stored; with the row itself if it will be asked for."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    keys = [F.col(id_col).cast("long").alias("_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("_size"), F.crc32(text).alias("_crc"), spread(text, 15).alias("_h")]
    rows = docs.select(*keys, *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole")] if whole else []))
    return stored(rows.withColumn("_nr", F.monotonically_increasing_id()), "shard-keys")


def _placed(rows: DataFrame, shards: int, seed: int) -> DataFrame:
    """_nr, _id, _size, _crc, shard and slot of each row."""
    rows = rows.select("_id", "_size", "_crc", "_h", "_nr")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    ranges = int(min(MOST_RANGES, max(LEAST_RANGES, n // ROWS_PER_RANGE, 4 * shards)))
    cuts, fair, key = _splitters(rows, ranges, total, seed), total / ranges, F.struct("_h", "_id")
    while True:
        by_range, seed = _ranged(rows, cuts), seed + 1
        sums = by_range.groupBy("_range").agg(F.sum("_size").alias("s"), (F.min(key) != F.max(key)).alias("many")).toPandas().sort_values("_range")  # a row a range
        over = sums[(sums["s"] > OVERFULL * fair) & sums["many"].astype(bool)]
        if not len(over):
            break
        # Overfull ranges are cut again by samples of their own; single keys cannot be.
        inside = by_range.filter(F.col("_range").isin(over["_range"].tolist())).drop("_range")
        more = sorted(set(cuts) | set(_splitters(inside, int(over["s"].sum() / fair) + 4, int(over["s"].sum()), seed)))
        if len(more) == len(cuts):
            break
        cuts = more
    starts = F.broadcast(rows.sparkSession.createDataFrame(list(zip(sums["_range"].tolist(), (sums["s"].cumsum() - sums["s"]).tolist(), strict=True)), "_range int, _start long"))
    order = Window.partitionBy("_range").orderBy("_h", "_id", "_size", "_nr")
    group = Window.partitionBy("_range", "_h")
    fill = F.lit(total / shards)
    at = (
        by_range.join(starts, "_range")
        .withColumn("_upto", F.col("_start") + F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_group", F.sum("_size").over(group))
        .withColumn("_first", F.min(F.col("_upto") - F.col("_size")).over(group))
        .withColumn("_middle", F.when(F.col("_group") <= F.lit(min(total / shards * GLUE, fair)), F.col("_first") + F.col("_group") / 2).otherwise(F.col("_upto") - F.col("_size") / 2))
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("_middle") / fill)).cast("int"))
    )
    at = stored(at.withColumn("_nth", F.row_number().over(Window.partitionBy("_range", "shard").orderBy("_h", "_id", "_size", "_nr"))).select("_nr", "_id", "_size", "_crc", "_range", "shard", "_nth"), "shard-places")
    parts = at.groupBy("_range", "shard").agg(F.count(F.lit(1)).alias("c")).toPandas().sort_values(["shard", "_range"])  # a row a range, and one more a border
    parts["f"] = parts.groupby("shard")["c"].cumsum() - parts["c"]
    first = F.broadcast(rows.sparkSession.createDataFrame([tuple(map(int, x)) for x in parts[["_range", "shard", "f"]].to_numpy()], "_range int, shard int, _first long"))
    return at.join(first, ["_range", "shard"]).select("_nr", "_id", "_size", "_crc", "shard", (F.col("_first") + F.col("_nth") - 1).cast("long").alias("slot"))


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 5) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard."""
    found = _placed(_numbered(docs, id_col, text_col, False), shards, seed)
    return found.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, shards: int, path: str, id_col: str = "doc_id", text_col: str = "text", seed: int = 5) -> None:
    """The shards as folders of Parquet files, in slot order within each file; every row once."""
    with Scope():
        rows = _numbered(docs, id_col, text_col, True)
        found = rows.select("_nr", "_whole").join(_placed(rows, shards, seed).select("_nr", "shard", "slot"), "_nr")
        own = [F.col(f"_whole.`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")]
        found.select(*own, "shard", "slot").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    return shard(table(spark, sf_dir, "documents"), 24)


QUERIES = {"op2_shard_documents": op2_shard_documents}
ORACLE_SQL = {
    "op2_shard_documents": """
        WITH steps AS (SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc_of FROM (SELECT unnest(range(256)) AS i)),
        b AS (SELECT doc_id, encode(coalesce(text, '')) AS bytes, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
        r AS (SELECT doc_id, h, CAST(octet_length(bytes) + 8 AS BIGINT) AS size, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(bytes), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(c >> 8, crc_of[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, steps),
        p AS (SELECT *, sum(size) OVER (ORDER BY h, doc_id, size) AS upto, sum(size) OVER (PARTITION BY h) AS whole, sum(size) OVER () / 24 AS fill, sum(size) OVER () / greatest(96, count(*) OVER () // 2000) AS fair FROM r),
        m AS (SELECT *, least(23, floor(CASE WHEN whole <= least(fill * 0.005::DOUBLE, fair) THEN min(upto - size) OVER (PARTITION BY h) + whole / 2 ELSE upto - size / 2 END / fill))::INTEGER AS shard FROM p)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM m"""
}
