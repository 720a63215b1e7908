"""Document fingerprints: invertible Bloom lookup sketches (DataFrame only).

A text is a set of paragraph digests (a paragraph: a line, or part of a long one
up to a sentence end).  A digest is 48 bits of hash and 16 check bits.  A sketch
has segments, each with three tables of ``CELLS`` cells; a digest goes to one
segment and there into one cell of each table.  A cell holds the XOR of its
digests and their number.  Two versions' sketches are subtracted cell by cell:
common digests vanish.  Peeling takes cells that hold a single digest, removes
it everywhere, and goes on until nothing is left; what came out are the digests
in which the versions differ.  If peeling gets stuck, both are sketched again
with four times the cells, and at last the digests themselves are compared.

The likeness is the Jaccard similarity of the digest sets, from the sizes and
the peeled digests: 1 for equal texts, 1 for two empty texts.

The next document (by falling id) is found without one global sort: ids are cut
into blocks at quantiles, each block is one window, and the first row of a block
is also sent, as a sentinel, to the block before.

Cases: a null text is empty; null ids come last in the falling order; rows that
share an id are ordered by text, so repeated rows stand together; very long texts
are read whole, in as many segments as they need; a single document is its own
next one; an empty table gives an empty result; other columns, whatever their
names, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import table

PARAGRAPH = r"[^\n]{1,120}[^\n.!?]{0,240}[.!?]*\n*|\n+"
CELLS, PER_SEGMENT, ROUNDS, LARGER = 16, 10, 24, 4
#: Blocks: one for so many rows, up to a number whose borders each task can hold; a longer block is sorted on disk.
ROWS_PER_BLOCK, MOST_BLOCKS = 500, 1 << 16


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _ushift(x: Column, by: Column | int) -> Column:
    return F.call_function("shiftrightunsigned", x, by if isinstance(by, Column) else F.lit(by))


def _check(body: Column) -> Column:
    return F.xxhash64(body).bitwiseAND(F.lit(65535))


def digests(text: Column) -> Column:
    """The distinct paragraph digests of a text."""
    one = lambda p: _let(_ushift(F.xxhash64(p), 16), lambda b: F.shiftleft(b, 16).bitwiseOR(_check(b)))
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), one))


def segments(n: Column) -> Column:
    """How many segments n digests get: a power of two."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n, F.lit(PER_SEGMENT)) / F.lit(float(PER_SEGMENT))))).cast("int")


def _mask(d: Column) -> Column:
    """A digest's cells in its segment, one in each of three tables of 16, as bits 0 to 47."""
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), _ushift(d, 36 + 8 * t).bitwiseAND(F.lit(CELLS - 1)).cast("int") + F.lit(CELLS * t))
    return bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2))


def _in_cell(m: Column, i: Column) -> Column:
    return F.call_function("getbit", m, i) == 1


def _upto(n: Column | int) -> Column:
    return F.sequence(F.lit(0), (n if isinstance(n, Column) else F.lit(n)) - 1)


def _segment(found: Column, s: Column, segs: Column) -> Column:
    return F.filter(found, lambda d: F.pmod(_ushift(d, 16), segs) == s)


def segment_cells(found: Column, s: Column, segs: Column) -> Column:
    """The cells of one segment: array of (k, c)."""
    cell = lambda xs: F.struct(F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x["d"])).alias("k"), F.size(xs).alias("c"))
    mine = F.transform(_segment(found, s, segs), lambda d: F.struct(d.alias("d"), _mask(d).alias("m")))
    return _let(mine, lambda ds: F.transform(_upto(3 * CELLS), lambda i: _let(F.filter(ds, lambda x: _in_cell(x["m"], i)), cell)))


def sketch(found: Column, segs: Column) -> Column:
    """The cells of all segments."""
    return F.flatten(F.transform(_upto(segs), lambda s: segment_cells(found, s, segs)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(x["k"].bitwiseXOR(y["k"]).alias("k"), (x["c"] - y["c"]).alias("c")))


def _pure(cells: Column) -> Column:
    """The single digests that cells hold, with the side they are on and their cells."""
    single = F.filter(cells, lambda x: (F.abs(x["c"]) == 1) & (_check(_ushift(x["k"], 16)) == x["k"].bitwiseAND(F.lit(65535))))
    return F.transform(F.array_distinct(single), lambda x: F.struct(x["k"].alias("k"), x["c"].alias("c"), _mask(x["k"]).alias("m")))


def peel(cells: Column) -> Column:
    """(ok, a, b): whether all came out, and how many digests only the first or second version has."""

    def without(st: Column) -> Column:
        drop = lambda a, p: F.struct(a["k"].bitwiseXOR(p["k"]).alias("k"), (a["c"] - p["c"]).alias("c"))
        return F.transform(st["cells"], lambda x, i: F.aggregate(F.filter(st["pure"], lambda p: _in_cell(p["m"], i)), x, drop))

    side = lambda pure, s: F.size(F.filter(pure, lambda p: p["c"] == s))

    def step(st: Column, _: Column) -> Column:
        state = lambda cs: F.struct(cs.alias("cells"), _pure(cs).alias("pure"), (st["a"] + side(st["pure"], 1)).alias("a"), (st["b"] + side(st["pure"], -1)).alias("b"))
        return F.when(F.size(st["pure"]) == 0, st).otherwise(_let(without(st), state))

    start = F.struct(cells.alias("cells"), _pure(cells).alias("pure"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    end = lambda st: F.struct(F.forall(st["cells"], lambda x: (x["c"] == 0) & (x["k"] == 0)).alias("ok"), st["a"].alias("a"), st["b"].alias("b"))
    return F.aggregate(_upto(ROUNDS), start, step, end)


def _jaccard(only_a: Column, only_b: Column, n_a: Column) -> Column:
    union = n_a + only_b
    return F.when(union == 0, F.lit(1.0)).otherwise((n_a - only_a) / union)


def _outcome(ok: Column, a: Column, b: Column) -> Column:
    return F.struct(ok.alias("ok"), a.alias("a"), b.alias("b"))


def _total(parts: Column, side: str) -> Column:
    return F.aggregate(parts, F.lit(0), lambda a, p: a + p[side])


def likeness(a: str, b: str) -> Column:
    """Likeness of two versions, from columns X (digests), X_n (their number), X_s (segments) and X_k (sketch).

    A segment that gets stuck is sketched again as ``LARGER`` segments; if one of
    those is stuck too, the segment's digests are compared themselves.
    """
    d_a, d_b, n_a, pair, width = F.col(a), F.col(b), F.col(f"{a}_n"), F.col(f"{a}{b}_s"), 3 * CELLS
    fit = lambda v: F.when(F.col(f"{v}_s") == pair, F.col(f"{v}_k")).otherwise(sketch(F.col(v), pair))
    more = pair * LARGER

    def listed(s: Column) -> Column:
        here, there = _segment(d_a, s, pair), _segment(d_b, s, pair)
        return _outcome(F.lit(True), F.size(F.array_except(here, there)), F.size(F.array_except(there, here)))

    def again(s: Column) -> Column:
        parts = F.transform(_upto(LARGER), lambda j: peel(subtract(segment_cells(d_a, s + pair * j, more), segment_cells(d_b, s + pair * j, more))))
        return _let(parts, lambda ps: F.when(F.forall(ps, lambda p: p["ok"]), _outcome(F.lit(True), _total(ps, "a"), _total(ps, "b"))).otherwise(listed(s)))

    def peeled(diff: Column) -> Column:
        return F.transform(_upto(pair), lambda s: _let(peel(F.slice(diff, s * width + 1, F.lit(width))), lambda p: F.when(p["ok"], p).otherwise(again(s))))

    parts = _let(subtract(fit(a), fit(b)), peeled)
    return _let(parts, lambda ps: _jaccard(_total(ps, "a"), _total(ps, "b"), n_a))


def as_text(cells: Column) -> Column:
    """A sketch as text: its cells, empty ones as nothing."""
    return F.array_join(F.transform(cells, lambda x: F.when(x["c"] == 0, F.lit("")).otherwise(F.concat(F.hex(x["k"]), F.lit("x"), x["c"].cast("string")))), ",")


def block_of(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at or below the value, by binary search."""
    steps = max(1, len(cuts).bit_length())
    padded = [*cuts, *[2**63 - 1] * (2**steps - 1 - len(cuts))]
    known = F.split(F.lit(",".join(map(str, padded))), ",").cast("array<bigint>")
    powers = F.array(*[F.lit(1 << k) for k in reversed(range(steps))])
    return F.aggregate(powers, F.lit(0), lambda p, k: F.when(F.element_at(known, p + k) <= value, p + k).otherwise(p))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _text and _next: the text of the document that follows by falling id, the first one after the last."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    ids = rows.select("_id")
    blocks = int(min(MOST_BLOCKS, max(1, ids.count() // ROWS_PER_BLOCK)))
    cuts = ids.approxQuantile("_id", [k / blocks for k in range(1, blocks)], 0.25 / blocks) if blocks > 1 else []
    block = F.when(F.col("_id").isNull(), F.lit(0)).otherwise(block_of(F.col("_id"), sorted({int(c) for c in cuts})))
    # Heads: the first id of each block that has rows; there are at most ``blocks``, a proven bound.
    heads = ids.select("_id", block.alias("_block")).groupBy("_block").agg(F.max("_id").alias("_head"))
    around = Window.orderBy("_block")
    before = F.coalesce(F.lead("_block").over(around), F.first("_block").over(around))  # the block before in falling order; the last one's is the first's
    heads = heads.select(F.col("_block").alias("_hb"), "_head", before.alias("_to"))
    marked = rows.withColumn("_block", block).join(F.broadcast(heads), (F.col("_block") == F.col("_hb")) & F.col("_id").eqNullSafe(F.col("_head")), "left")
    places = F.array(F.struct(F.col("_block").alias("b"), F.lit(False).alias("s")), F.struct(F.col("_to").alias("b"), F.lit(True).alias("s")))
    sent = marked.select("_id", "_text", F.explode(F.when(F.col("_hb").isNull(), F.slice(places, 1, 1)).otherwise(places)).alias("p"))
    falling = Window.partitionBy("p.b").orderBy("p.s", F.desc_nulls_last("_id"), "_text")
    return sent.withColumn("_next", F.lead("_text").over(falling)).filter(~F.col("p.s")).select("_id", "_text", "_next")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and their likeness."""
    n = F.length("_text")
    third = F.floor(n / 3).cast("int")
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", n.cast("long")).withColumn("_edited", F.concat(F.substring("_text", F.lit(1), n - third), F.substring("_next", F.lit(1), third)))
    rows = rows.select(F.col("_id").alias(id_col), "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), digests(F.col("_text")).alias("d"), digests(F.col("_edited")).alias("e"), digests(F.col("_next")).alias("x"))
    # Each step is a projection of its own, so that nothing is computed inside a loop over cells.
    rows = rows.select("*", *[F.size(v).alias(f"{v}_n") for v in "dex"]).select("*", *[segments(F.col(f"{v}_n")).alias(f"{v}_s") for v in "dex"])
    rows = rows.select("*", *[F.greatest("d_s", f"{v}_s").alias(f"d{v}_s") for v in "ex"], *[sketch(F.col(v), F.col(f"{v}_s")).alias(f"{v}_k") for v in "dex"])
    return rows.select(id_col, "n_chars", "edited_sha256", as_text(F.col("d_k")).alias("fingerprint"), as_text(F.col("e_k")).alias("edited_fingerprint"), likeness("d", "e").alias("near_edited"), likeness("d", "x").alias("near_next"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts."""
    return fingerprint(table(spark, sf_dir, "documents"))


QUERIES = {"op3_fingerprints": op3_fingerprints}
