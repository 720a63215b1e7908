"""Exact deduplication by content-defined chunk recipes (DataFrame only).

A text is cut into chunks where its content says so: behind a line end that
follows certain letters.  The cut depends on the characters around it alone, so
equal passages give equal chunks wherever they stand.  A chunk is named by a 64-bit key; a name counts only once
it is verified: the chunk table gathers, for each key, the smallest and largest
SHA-256 of the chunks that bear it, and a key borne by different chunks is
replaced by names made from the SHA-256.  A text's recipe is the ordered list of
its chunks' names, and texts are equal when their recipes are: groups are formed
by recipe alone, and the digest of the whole text only goes along.  Only keys and
digests move; the long texts stay where they are read.

Cases: a null text equals the empty text (an empty recipe); a very long text has
a long recipe, of a name for some thousand characters at most and a dozen at
least; of rows with equal text the one with the largest id stays (null ids
last); of repeated rows with the same id exactly one stays, that with the least
hash of all its columns; different texts under one id are different documents;
other columns, whatever their names, stay as they are (:func:`keep`) or are left
out (:func:`groups`); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scope, fresh, one_each, stored, table

#: A chunk ends behind one of these letters, at most a full stop, and a line end; without one, at this length.
CUT, MOST = "a-m", 8192


def chunks(text: Column, cut: str = CUT, most: int = MOST) -> Column:
    """The chunks of a text, in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{0,{most - 3}}}?[{cut}]\.?\n|.{{1,{most}}}"), F.lit(0))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256; ``key`` gives a chunk's 64-bit name."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = F.transform(chunks(text), lambda c: F.struct(key(c).alias("key"), F.unhex(F.sha2(c, 256)).alias("proof")))
    with Scope() as scope:
        rows = stored(docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), named.alias("_chunks"), F.sha2(text, 256).alias("_sha")), "dedup-recipes")
        table_ = rows.select(F.explode("_chunks").alias("c")).groupBy("c.key").agg(F.min("c.proof").alias("low"), F.max("c.proof").alias("high"))
        shared = stored(table_.filter("low <> high").select("key"), "dedup-unsafe")
        plain = F.transform("_chunks", lambda c: F.unhex(F.lpad(F.hex(c["key"]), 16, "0")))
        if shared.isEmpty():
            recipes = rows.withColumn("_recipe", plain)
        else:
            unsafe = rows.select("_row", F.explode("_chunks.key").alias("key")).join(shared, "key", "left_semi").select("_row").distinct()
            proofs = F.transform("_chunks", lambda c: c["proof"])
            recipes = rows.join(unsafe.withColumn("_unsafe", F.lit(True)), "_row", "left").withColumn("_recipe", F.when(F.col("_unsafe"), proofs).otherwise(plain))
        best = F.max(F.struct(F.col("_id").isNotNull().alias("a"), F.col("_id").alias("id"), F.col("_row").alias("row")))
        # Stored, so that the join below has two plain inputs and a hot group can be split.
        kept = stored(recipes.groupBy("_recipe").agg(best.alias("_best"), F.count(F.lit(1)).alias("_size")), "dedup-groups")
        found = recipes.join(kept, "_recipe").select(
            F.col("_id").alias(id_col), F.col("_best.id").alias("keep_id"), F.col("_size").alias("group_size"), (F.col("_row") == F.col("_best.row")).alias("kept"), F.col("_sha").alias("text_sha256")
        )
        return scope.keep(stored(found, "dedup-found"))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with their own columns; texts move once."""
    ids = groups(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias("_dedup_id"), F.col("text_sha256").alias("_dedup_sha"))
    own = fresh(docs, "_dedup_own")
    found = docs.withColumn(own, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    found = found.join(ids.toDF(fresh(docs, "_dedup_id"), fresh(docs, "_dedup_sha")), F.col(id_col).eqNullSafe(F.col(fresh(docs, "_dedup_id"))) & (F.col(own) == F.col(fresh(docs, "_dedup_sha"))), "left_semi")
    return one_each(found, [id_col, own], docs.columns)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the id of the equal one that stays."""
    return groups(table(spark, sf_dir, "documents"))


QUERIES = {"op10_exact_dedup": op10_exact_dedup}
ORACLE_SQL = {
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""
}
