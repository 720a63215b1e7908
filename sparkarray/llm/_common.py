"""Shared plumbing: tables in the cluster's shared folder, and table reading."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DEFAULT = "/tmp/checkpoints"
#: While a frame is stored, batches that go to Python hold so many bytes at most, whatever the length of texts.
BATCH_BYTES = 8 << 20
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only on one machine (tests), and only where that is unset, a folder under /tmp serves.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or f"file://{_LOCAL_DEFAULT}").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; what lies there is deleted at exit, or by :class:`Scope`."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder as Parquet and read it back.

    This cuts the lineage: an executor lost later costs a re-read, not a
    recomputation, and no row depends on which attempt produced it.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    path, before = new_path(spark, name), spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


class Scope:
    """Drops what was stored since it began; ``keep`` names frames that live on."""

    def __enter__(self) -> "Scope":
        self._from, self._kept = len(_made), set()
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self._kept.add(df._stored_at)
        return df

    def __exit__(self, *_) -> None:
        for spark, path in _made[self._from :]:
            if path not in self._kept:
                _delete(spark, path)
        _made[self._from :] = [m for m in _made[self._from :] if m[1] in self._kept]


def drop_stored(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`stored`."""
    _delete(df.sparkSession, df._stored_at)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


@atexit.register
def _clear() -> None:
    for spark, path in _made:
        try:
            if spark._jsc is not None and spark._jsc.sc().isStopped() is False:
                _delete(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone at exit; the other folders still get their turn
            continue


def row_hash(df: DataFrame) -> "F.Column":
    """A hash of a row's columns, for ties between rows that agree in all that counts."""
    plain = [f.name for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain]) if plain else F.lit(0).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def one_each(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row for each combination of ``keys``, that with the least hash; rows of a hot one are combined where they are read."""
    best = fresh(df, "_best")
    rows = F.struct(*[F.col(f"`{c}`") for c in columns])
    return df.groupBy(*keys).agg(F.min_by(rows, row_hash(df.select(*[F.col(f"`{c}`") for c in columns]))).alias(best)).select(f"{best}.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_text(col) -> "F.Column":
    """crc32 (unsigned, long) of a value's text in UTF-8."""
    return F.crc32(col.cast("string").cast("binary"))


def spread(col: "F.Column", digits: int) -> "F.Column":
    """A whole number below 16^digits, even over values, from the MD5 of a value's text; SQL elsewhere has the same."""
    text = F.coalesce(col.cast("string"), F.lit("")).cast("binary")
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def parallelism(spark: SparkSession) -> int:
    """Partitions to deal shuffled rows to: the session's shuffle setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
