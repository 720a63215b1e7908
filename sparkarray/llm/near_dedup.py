"""Near-duplicate classes by ProbMinHash, banding and verification.

A text is the set of its five-word shingles.  Every shingle is a Poisson process
whose rate is its weight; each arrival draws a register, and a register keeps the
shingle that arrives first.  Arrivals come in time order per shingle, so one ends
as soon as it is later than all registers.  Two signatures agree in a register
with the probability Jaccard of the sets.  All weights are 1, however often a
shingle occurs: then that is the Jaccard of the plain sets, by which links are
verified.  Bands of registers give candidate buckets.

Candidates are verified exactly (Jaccard of the sets of shingles >= 0.8), and
classes are the connected components of verified links.  A bucket never emits
all its pairs at once.  Texts go whose own shingles, those that no other candidate
has, are too many for any link.  Then each member meets the bucket's leader, the
member with the least share of own shingles; buckets that still hold several
classes go on with more leaders a round, members of one class and pairs that
their own shingles or their bitmaps keep apart never being compared, until each member has met
every other one that it may link to.  Equal texts share one node, so copies are never compared.

A node is a distinct text, numbered when texts are stored; ids only name rows.

Cases: a null text is empty; texts without words are only equal to each other;
texts under five words are one shingle; very long texts are read whole, in
slices of their own; rows without an id are compared like all others; different
texts under one id are different documents, each in its own class; of a class
the row with the least id stays (null ids last; ties by the text's digest, then
by a hash of all columns), so of repeated rows exactly one; a class is named by
its least id, one without ids, or whose name an earlier class has, by a negative
number; other columns, whatever their names, stay as they are (:func:`keep`) or
are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scope, drop_stored, fresh, one_each, stored, table
from ._text import GOLDEN, distinct, give_back, mix64, shingles, slices

WORDS, SIMILARITY, BANDS, ROWS, LEADERS = 5, 0.8, 20, 5, 16
#: 64-bit words of a set's bitmap.
BITMAP = 16


def _draw(k: int) -> np.uint64:
    """What the k-th draw of a process adds to its element."""
    return np.uint64(k * int(GOLDEN) % (1 << 64))


def prob_minhash(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, texts: int, m: int) -> np.ndarray:
    """Signatures (texts x m) of weighted sets; all texts' processes run side by side."""
    times, winners = np.full(texts * m, np.inf), np.zeros(texts * m, np.uint64)
    latest = np.full(texts, np.inf)
    now, step = np.zeros(len(elements)), 0
    while len(elements):
        u = (mix64(elements + _draw(2 * step + 1)) >> np.uint64(11)).astype(np.float64)
        now = now - np.log((u + 0.5) / 9007199254740992.0) / weights
        early = now < latest[owner]
        elements, weights, owner, now = elements[early], weights[early], owner[early], now[early]
        register = (mix64(elements + _draw(2 * step + 2)) % np.uint64(m)).astype(np.int64)
        at = owner * m + register
        np.minimum.at(times, at, now)
        won = times[at] == now
        winners[at[won]] = elements[won]
        some = np.unique(owner)
        latest[some] = times.reshape(texts, m)[some].max(axis=1)
        step += 1
    return winners.reshape(texts, m)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band."""
    keys = np.zeros((len(signatures), bands), np.uint64)
    for r in range(rows):
        keys = mix64(keys * np.uint64(31) + signatures.reshape(-1, bands, rows)[:, :, r] + np.uint64(r))
    return mix64(keys + np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN)


def _lists(values: np.ndarray, lens: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32()), pa.array(values, kind))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, 1):
            values, owner, _ = distinct(*shingles(b.column(1), WORDS))
            keys = band_keys(prob_minhash(values, np.ones(len(values)), owner, b.num_rows, BANDS * ROWS), BANDS, ROWS)
            size = np.bincount(owner, minlength=b.num_rows)
            keys = keys[size > 0]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(size, pa.int32()), _lists(keys.ravel().view(np.int64), np.where(size > 0, BANDS, 0), pa.int64())], ["_id", "_sha", "_n", "_keys"])
    give_back()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, 1):
            values, owner, _ = distinct(*shingles(b.column(1), WORDS))
            bits = np.zeros(b.num_rows * BITMAP, np.uint64)
            place = values % np.uint64(64 * BITMAP)
            np.bitwise_or.at(bits, owner * BITMAP + (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
            sets = _lists(values.view(np.int64), np.bincount(owner, minlength=b.num_rows), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), sets, _lists(bits.view(np.int64), np.full(b.num_rows, BITMAP), pa.int64())], ["_node", "_set", "_bits"])
    give_back()


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets are similar enough, counted exactly."""
    a, b = sets.select(F.col("_node").alias("a"), F.col("_set").alias("_a")), sets.select(F.col("_node").alias("b"), F.col("_set").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    return pairs.join(a, "a").join(b, "b").filter(both >= F.lit(similarity) * (F.size("_a") + F.size("_b") - both)).select("a", "b")


def _may_link(of: str, to: str, similarity: float) -> F.Column:
    """Whether two sets can reach the similarity at all; ``of`` and ``to`` are structs of _n, _own, _ones and _bits.

    They must share s / (1 + s) of both sizes together.  Shingles that no other
    candidate has are never shared, nor are those whose place in the other's
    bitmap is empty: each place in one bitmap alone has a shingle that the other
    set lacks.  The cheap bound comes first.
    """
    both = F.lit(similarity / (1 + similarity)) * (F.col(f"{of}._n") + F.col(f"{to}._n")) - F.lit(1e-6)
    shareable = F.least(*(F.col(f"{x}._n") - F.col(f"{x}._own") for x in (of, to)))
    crowded = F.least(*(F.col(f"{x}._n") - F.col(f"{x}._ones") for x in (of, to)))
    here, there = F.col(f"{of}._bits"), F.col(f"{to}._bits")
    common = F.bit_count(here[0].bitwiseAND(there[0]))
    for k in range(1, BITMAP):
        common = common + F.bit_count(here[k].bitwiseAND(there[k]))
    return (shareable >= both) & (common >= both - crowded)


def _linkable(sets: DataFrame, similarity: float) -> DataFrame:
    """(_node, _n, _own, _bits) of the texts that can have a link: _own counts their shingles that no other candidate has.

    With x of n shingles its own, a text shares at most n - x with any other, and
    the union has n at least, so its similarity is at most (n - x) / n.
    """
    owners = sets.select("_node", F.explode("_set").alias("_s")).groupBy("_s").agg(F.count(F.lit(1)).alias("_c"), F.min("_node").alias("_node"))
    own = owners.filter("_c = 1").groupBy("_node").agg(F.count(F.lit(1)).alias("_own"))
    known = sets.select("_node", F.size("_set").alias("_n"), "_bits").join(own, "_node", "left").withColumn("_own", F.coalesce("_own", F.lit(0)))
    return known.filter(F.col("_n") - F.col("_own") >= F.lit(similarity) * F.col("_n"))


def components(edges: DataFrame) -> DataFrame:
    """(_node, _class): the least node of each node's component; nodes with an edge only.

    Each class hooks to its least neighbour, pointers are shortened, and edges
    are rewritten between classes, until no edge is left.
    """
    names = edges.select(F.col("a").alias("_node")).union(edges.select(F.col("b").alias("_node"))).distinct().withColumn("_class", F.col("_node"))
    names, edges = stored(names, "near-names"), stored(edges.distinct(), "near-edges")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        # Stored, so that the joins have two plain inputs: most members of a class hook to one node, and that key can be split.
        near = stored(both.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("y")).select("x", F.least("x", "y").alias("y")), "near-hooks")
        far = near.select(F.col("x").alias("y"), F.col("y").alias("z"))
        hook = stored(near.join(far, "y", "left").select("x", F.coalesce("z", "y").alias("y")), "near-hooks")
        to = lambda c: hook.select(F.col("x").alias(c), F.col("y").alias(f"{c}_to"))
        moved = edges.join(to("a"), "a").join(to("b"), "b").filter("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct()
        old = names, edges
        names = stored(names.join(to("_class"), "_class", "left").select("_node", F.coalesce("_class_to", "_class").alias("_class")), "near-names")
        edges = stored(moved, "near-edges")
        for frame in (*old, near, hook):
            drop_stored(frame)
    return names


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: id, class_id, text_sha256, kept (the class's row that stays)."""
    with Scope() as scope:
        return scope.keep(stored(_classes(docs, id_col, text_col, similarity), "near-found"))


def _classes(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text"), F.sha2(text, 256).alias("_sha"))
    signed = stored(rows.mapInArrow(_signed, "_id long, _sha string, _n int, _keys array<long>").withColumn("_row", F.monotonically_increasing_id()), "near-signatures")
    # One node for each distinct text; its text is that of the row with the least id.
    nodes = signed.groupBy("_sha").agg(F.min("_id").alias("_id"), F.first("_n").alias("_n"), F.first("_keys").alias("_keys"))
    nodes = stored(nodes.withColumn("_node", F.monotonically_increasing_id()), "near-nodes")
    postings = nodes.select("_node", F.explode("_keys").alias("_key"))
    buckets = postings.groupBy("_key").agg(F.count(F.lit(1)).alias("_many")).filter("_many > 1").select("_key")
    members = stored(postings.join(stored(buckets, "near-buckets"), "_key"), "near-members")
    needed = stored(members.select("_node").distinct().join(nodes.select("_node", F.col("_sha").alias("_its"), F.col("_id").alias("_of")), "_node"), "near-needed")
    texts = rows.join(needed, (F.col("_sha") == F.col("_its")) & F.col("_id").eqNullSafe(F.col("_of"))).select("_node", "_text").dropDuplicates(["_node"])
    sets = stored(texts.mapInArrow(_sets, "_node long, _set array<long>, _bits array<long>"), "near-sets")
    _ones = F.aggregate("_bits", F.lit(0), lambda n, x: n + F.bit_count(x)).alias("_ones")
    core = stored(_linkable(sets, similarity).select("_node", F.struct("_n", "_own", _ones, "_bits").alias("_of")), "near-core")
    members = members.join(core, "_node")
    central = F.min(F.struct((F.col("_of._own") / F.col("_of._n")).alias("r"), "_node", "_of")).alias("_lead")
    leads = stored(members.groupBy("_key").agg(F.count(F.lit(1)).alias("_many"), central).filter("_many > 1"), "near-leaders")
    members = stored(members.join(leads, "_key"), "near-members")
    led = members.filter((F.col("_node") != F.col("_lead._node")) & _may_link("_of", "_lead._of", similarity))
    tested = stored(led.select(F.least("_lead._node", "_node").alias("a"), F.greatest("_lead._node", "_node").alias("b")).distinct(), "near-pairs")
    links = stored(_verified(tested, sets, similarity), "near-links")
    named = components(links)
    most = LEADERS
    while True:
        open_ = members.join(named, "_node", "left").withColumn("_class", F.coalesce("_class", "_node"))
        # Stored, so that the join has two plain inputs and a hot bucket can be split.
        still = stored(open_.groupBy("_key").agg(F.min("_class").alias("_low"), F.max("_class").alias("_high")).filter("_low <> _high").select("_key"), "near-still")
        # About ``most`` leaders a bucket, drawn by hash; all members of smaller ones.
        drawn = F.pmod(F.xxhash64("_node", "_key", F.lit(most)), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("_many") < most
        open_ = stored(open_.join(still, "_key", "left_semi").select("_key", "_node", "_of", "_class", "_many", drawn.alias("_leads")), "near-open")
        leaders = open_.filter("_leads").select("_key", F.col("_node").alias("_l"), F.col("_of").alias("_to"), F.col("_class").alias("_lc"))
        once = ~F.col("_leads") | (F.col("_node") < F.col("_l"))  # two leaders meet once
        met = open_.join(leaders, "_key").filter((F.col("_class") != F.col("_lc")) & once & _may_link("_of", "_to", similarity))
        pairs = met.select(F.least("_node", "_l").alias("a"), F.greatest("_node", "_l").alias("b")).distinct()
        pairs = stored(pairs.join(tested, ["a", "b"], "left_anti"), "near-pairs")
        largest = open_.agg(F.max("_many")).first()[0] or 0
        if not pairs.isEmpty():
            new = stored(_verified(pairs, sets, similarity), "near-links")
            tested = stored(tested.union(pairs), "near-pairs")
            if not new.isEmpty():
                links = stored(links.union(new), "near-links")
                named = components(links)
        if largest <= most:  # every pair of different classes that may link has met
            break
        most *= 256
    found = signed.select("_id", "_row", "_sha").join(nodes.select("_sha", "_node"), "_sha").join(named, "_node", "left")
    found = stored(found.select("_id", "_row", "_sha", F.coalesce("_class", "_node").alias("_class")), "near-rows")
    best = F.min(F.struct(F.col("_id").isNull().alias("no"), F.col("_id").alias("id"), F.col("_sha").alias("sha"), F.col("_row").alias("row")))
    kept = found.groupBy("_class").agg(best.alias("_best")).select("_class", F.col("_best.id").alias("_least"), F.col("_best.row").alias("_kept"))
    nth = F.row_number().over(Window.partitionBy(F.col("_least").isNull(), F.coalesce("_least", "_class")).orderBy("_class"))
    kept = stored(kept.withColumn("_name", F.when(F.col("_least").isNotNull() & (nth == 1), F.col("_least")).otherwise(-1 - F.col("_class"))), "near-kept")
    return found.join(kept, "_class").select(F.col("_id").alias(id_col), F.col("_name").alias("class_id"), F.col("_sha").alias("text_sha256"), (F.col("_row") == F.col("_kept")).alias("kept"))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, with its own columns; texts move once."""
    own, its, of = fresh(docs, "_near_own"), fresh(docs, "_near_its"), fresh(docs, "_near_of")
    ids = classes(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias(of), F.col("text_sha256").alias(its))
    found = docs.withColumn(own, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    found = found.join(ids, F.col(id_col).cast("long").eqNullSafe(F.col(of)) & (F.col(own) == F.col(its)), "left_semi")
    return one_each(found, [id_col, own], docs.columns)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate class."""
    return classes(table(spark, sf_dir, "documents"))


QUERIES = {"op6_near_dedup": op6_near_dedup}
ORACLE_SQL = {
    "op6_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [t] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8::DOUBLE * (x.n + y.n - c)),
        reach(doc_id, root) AS (
          SELECT doc_id, doc_id FROM documents
          UNION SELECT e.b, r.root FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) e ON e.a = r.doc_id)
        SELECT w.doc_id, min(root) AS class_id, sha256(any_value(t)) AS text_sha256, w.doc_id = min(root) AS kept FROM w JOIN reach USING (doc_id) GROUP BY w.doc_id"""
}
