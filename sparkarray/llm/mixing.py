"""Mixing sources to target weights by systematic sampling (DataFrame only).

Each source gets a target number of words.  Every document of a source has the
same expected number of copies, ``target / source size``.  Documents stand in a
fixed order within their source; the expected copies are summed along it, one
random offset per source is added, and a document is emitted once for every
integer the running sum crosses.

The running sum never gathers a source in one task: a source is cut into blocks
(size class x hash of the id), blocks are summed first, and each document only
needs its place within its block plus its block's start.  Sources, too, may be
many: they are numbered by a distributed sort, and the common level of the
targets is found by a few aggregates over them.

Cases: a null text has size 0, a very long one its whole size; a null source is a
source of its own, last in order; sources of size 0 have target 0 and take
nothing; null ids are sampled like others; rows that share an id, and repeated
rows, are sampled each on its own (equal rows are interchangeable); an empty
table gives an empty result; :func:`mix` leaves out other columns, :func:`emit`
keeps the input's columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import order
from ._common import Scope, spread, stored, table

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """Targets by water filling: ``sources`` has _src, _size, one row per source.

    All sources but the full ones get a common level times their weight; one is
    full at ``most`` times its size.  What full sources leave raises the level of
    the others, which may fill more of them, until no more fill.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = order.sort(sources, [F.col("_src").isNull().asc()], idx="_src", pos="_rank")
    ranked = stored(ranked.withColumn("_weight", weight).withColumn("_cap", F.lit(float(most)) * F.col("_size")), "mix-sources")
    total = float(share) * (ranked.agg(F.sum("_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        fills = F.col("_cap") <= F.lit(level) * F.col("_weight")
        now, caps, free = ranked.agg(F.count_if(fills), F.sum(F.when(fills, F.col("_cap"))), F.sum(F.when(~fills, F.col("_weight")))).first()
        if now == full or not free:  # the same ones are full as before, or all are
            break
        full, level = now, max(level, (total - (caps or 0.0)) / free)
    return ranked.select("_src", "_size", F.least("_cap", F.lit(level) * F.col("_weight")).alias("_target"))


def _numbered(docs: DataFrame, id_col: str, text_col: str, source_col: str, whole: bool) -> DataFrame:
    """Each row's number, id, source and size, stored; with the row itself if it will be asked for."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_src"), word_count(F.col(text_col)).alias("_n"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole")] if whole else []))
    return stored(rows.withColumn("_nr", F.monotonically_increasing_id()), "mix-rows")


def _mixed(rows: DataFrame, weights: list[int], share: float, most: float, seed: int) -> DataFrame:
    """_nr, _id, _n, _size, _target and copies of each row."""
    # Blocks grow with the square root of the table: neither the blocks of one
    # source nor the documents of one block are ever many.
    salts = int(rows.count() ** 0.5 / 4) + 1
    keys = ["_no", "_name", "_class", "_salt"]
    rows = rows.select(
        "_nr", "_id", "_n", "_src", F.col("_src").isNull().alias("_no"), F.coalesce("_src", F.lit("")).alias("_name"),
        F.length(F.bin(F.col("_n") + 1)).alias("_class"), F.pmod(spread(F.concat_ws("-", F.lit(seed), F.col("_id")), 7), F.lit(salts)).cast("int").alias("_salt"),
    )
    blocks = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_docs"), F.sum("_n").alias("_words")), "mix-blocks")
    sources = blocks.groupBy("_no", "_name").agg(F.sum("_words").alias("_size")).select(F.when(~F.col("_no"), F.col("_name")).alias("_src"), "_size")
    targets = source_targets(sources, weights, share, most).select(F.col("_src").isNull().alias("_no"), F.coalesce("_src", F.lit("")).alias("_name"), "_size", "_target")
    earlier = Window.partitionBy("_no", "_name").orderBy("_class", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("_start", F.coalesce(F.sum("_docs").over(earlier), F.lit(0))).join(targets, ["_no", "_name"]).drop("_docs", "_words")
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy("_n", "_id"))).join(starts, keys)
    rate = F.when(F.col("_size") > 0, F.least(F.lit(float(most)), F.col("_target") / F.col("_size"))).otherwise(0.0)
    offset = spread(F.concat_ws("-", F.lit(seed), F.col("_src")), 5) / F.lit(float(1 << 20))
    rank = F.col("_start") + F.col("_place")
    copies = F.floor(rank * F.col("_rate") + F.col("_offset")) - F.floor((rank - 1) * F.col("_rate") + F.col("_offset"))
    # A double's last bit may not add a copy.
    return placed.withColumn("_rate", rate).withColumn("_offset", offset).select("_nr", "_id", "_n", "_size", "_target", F.least(copies, F.floor(F.lit(most))).cast("long").alias("copies"))


def mix(docs: DataFrame, weights: list[int] | None = None, share: float = 1.5, most: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, size, source_size, target, copies, taken."""
    found = _mixed(_numbered(docs, id_col, text_col, source_col, False), weights or [3, 1, 2], share, most, seed)
    return found.select(F.col("_id").alias(id_col), F.col("_n").alias("size"), F.col("_size").alias("source_size"), F.col("_target").alias("target"), "copies", (F.col("copies") * F.col("_n")).alias("taken"))


def emit(docs: DataFrame, weights: list[int] | None = None, share: float = 1.5, most: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row as often as it was taken, with the input's columns."""
    with Scope() as scope:
        rows = _numbered(docs, id_col, text_col, source_col, True)
        scope.keep(rows)
        copies = scope.keep(stored(_mixed(rows, weights or [3, 1, 2], share, most, seed).filter("copies > 0").select("_nr", F.col("copies").cast("int").alias("_copies")), "mix-copies"))
    found = rows.select("_nr", "_whole").join(copies, "_nr")
    return found.select("_whole", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_whole.*")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their source's target and the words the mix takes."""
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op1_mix_sources": op1_mix_sources}
ORACLE_SQL = {
    "op1_mix_sources": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
        -- Sources in the order in which they fill; while those before a source are full, the level is what their caps leave, by the weights of the others.
        f AS (SELECT *, 2.0::DOUBLE * n AS cap, (1.5::DOUBLE * sum(n) OVER () - coalesce(sum(2.0::DOUBLE * n) OVER (ORDER BY n / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY n / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
        t AS (SELECT source, n, least(cap, coalesce((SELECT level FROM f WHERE level * weight < cap ORDER BY n / weight, source LIMIT 1), 'inf'::DOUBLE) * weight) AS target FROM f),
        r AS (SELECT d.*, t.n, t.target, CASE WHEN t.n > 0 THEN least(2.0::DOUBLE, t.target / t.n) ELSE 0 END AS rate,
                ('0x' || substr(md5('17' || coalesce('-' || d.source, '')), 1, 5))::BIGINT / 1048576.0::DOUBLE AS shift,
                row_number() OVER (PARTITION BY d.source ORDER BY length(bin(size + 1)), ('0x' || substr(md5('17-' || doc_id), 1, 7))::BIGINT % (SELECT CAST(floor(sqrt(count(*)) / 4) AS BIGINT) + 1 FROM d), size, doc_id) AS nth
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        c AS (SELECT *, CAST(least(floor(nth * rate + shift) - floor((nth - 1) * rate + shift), 2) AS BIGINT) AS copies FROM r)
        SELECT doc_id, size, n AS source_size, target, copies, copies * size AS taken FROM c"""
}
