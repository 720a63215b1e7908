"""LM scoring with Elias-Fano n-gram tries.

The model is a bigram model over words, the end of a text being a word too, with
a word model below it (Witten and Bell's smoothing at both joints):

    p(w | v) = (c(v, w) + t(v) p0(w)) / (c(v) + t(v))

c counts in the training texts, t(v) is the number of different words behind v.
p0 takes from each training word's count what words seen once have on average,
and gives it to one event, "a word that training has not": the same events as in
the base score, which also has one place for all unknown words.

Training (:func:`train`).  Batches of texts send their bigrams and counts to
shards, by ranges of (context hash, word hash) with borders drawn from a sample,
so a frequent context is cut into several ranges and no shard is large.  Each
shard becomes one :class:`~.elias_fano.Trie` in the shared folder: monotone
contexts, pointers, running counts and successors, and one byte a bigram for its
smoothed probability.  The model is that folder and the borders.

Scoring (:func:`score`).  Any texts, of the training or not, send their distinct
(context, word) pairs to the shards, where the trie is mapped and asked by
successor search within the context's range.  Answers (a context's count and
number of successors, a bigram's code) go back to the batch, where texts are
summed up.  A context that borders cut is asked for in all its ranges, so its
counts are whole.  No shard is sent to other machines and nothing is pruned: the
model grows with the training texts, tasks do not.

Words are told apart by 56-bit hashes as contexts (of a billion words, seven pairs
are expected to share one) and by 32 bits of these behind a context.

Cases: a null text is empty: one end token; very long texts are batches of their
own; repeated rows and rows that share an id are scored alike and counted each;
a null id stays null; without training texts p0 is 1 and all scores are 0; an
empty table gives an empty result; other columns of the input, whatever their
names, are left out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scope, crc_text, new_path, stored, table
from ._text import give_back, hash_strings, mix64, slices, split_words
from .elias_fano import Trie, map_shared, write_shared

#: Rows and bytes of text in a batch; bytes of training text a shard; sampled pairs a shard.
BATCH, BATCH_BYTES, SHARD_BYTES, PER_SHARD = 8192, 7 << 20, 12 << 20, 32
END = np.uint64(0x5851F42D4C957F)  # the end token's hash
#: Bits of a word's hash that tell words apart, and those of them that do so behind a context.
WORD_BITS, BEHIND_BITS = 56, 32
NO_ID = -(1 << 63)
COLUMNS = ["shard", "batch", "contexts", "lens", "words", "counts", "texts"]
MESSAGE = "shard int, batch long, " + ", ".join(f"{c} binary" for c in COLUMNS[2:])
ANSWER = "batch long, shard int, counts binary, successors binary, codes binary, step double, texts binary"


@dataclass
class Borders:
    """Where shards 1, 2, ... begin: sorted (context hash, word hash)."""

    context: np.ndarray
    word: np.ndarray

    @property
    def shards(self) -> int:
        return len(self.context) + 1

    def of(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The shard of each pair."""
        low, high = np.searchsorted(self.context, context, "left"), np.searchsorted(self.context, context, "right")
        for c in np.unique(context[high > low]):
            at = context == c
            a, b = np.searchsorted(self.context, c, "left"), np.searchsorted(self.context, c, "right")
            low[at] = a + np.searchsorted(self.word[a:b], word[at], "right")
        return low


@dataclass
class Model:
    """A trained model: the tries' folder, the shards that have one, and the totals of the word model."""

    path: str
    borders: Borders
    present: np.ndarray
    total: int
    words: int
    once: int

    def p0(self, count: np.ndarray) -> np.ndarray:
        """The word model, by a word's training count."""
        taken = (self.once + 0.5) / (self.words + 1)
        total = max(1, self.total)
        return np.where(count > 0, (count - taken) / total, taken * self.words / total if self.total else 1.0)


def _squeeze(x: np.ndarray) -> bytes:
    """Whole numbers as bytes: all first bytes, all second ones and so on, compressed."""
    return np.int64(len(x)).tobytes() + pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def _unsqueeze(blob: bytes, kind: type) -> np.ndarray:
    n, size = int(np.frombuffer(blob, np.int64, 1)[0]), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(blob[8:], n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def _steps(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences within runs; a run's first value stays."""
    out = x.copy()
    out[1:] -= x[:-1]
    out[starts] = x[starts]
    return out


def _sums(x: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The inverse of :func:`_steps`, from the runs' lengths (some may be empty)."""
    starts = np.cumsum(lens, dtype=np.int64) - lens
    upto = np.concatenate([[0], np.cumsum(x, dtype=np.uint64)]).astype(np.uint64)
    return (upto[1:] - np.repeat(upto[starts], lens)).astype(x.dtype)


class Texts:
    """A batch's tokens: numbers of words in the batch's sorted vocabulary of hashes, text after text, each with its end."""

    def __init__(self, vocabulary: np.ndarray, tokens: np.ndarray, starts: np.ndarray, end: int) -> None:
        self.vocabulary, self.tokens, self.starts, self.end = vocabulary, tokens, starts, end

    @classmethod
    def read(cls, texts: pa.Array) -> Texts:
        words, offsets = split_words(texts)
        coded = words.dictionary_encode()
        del words
        vocabulary, to = np.unique(np.append(hash_strings(coded.dictionary) >> np.uint64(64 - WORD_BITS), END), return_inverse=True)
        lens = np.diff(offsets)
        ends = offsets[1:] + np.arange(len(lens))
        tokens = np.full(int(offsets[-1]) + len(lens), to[-1], np.int32)
        inner = np.ones(len(tokens), bool)
        inner[ends] = False
        tokens[inner] = to[coded.indices.to_numpy()]
        return cls(vocabulary, tokens, ends - lens, int(to[-1]))


class Bigrams:
    """The distinct (context, word) pairs of tokens, in order, and where each token's pair stands among them."""

    def __init__(self, tokens: np.ndarray, starts: np.ndarray, end: int, size: int) -> None:
        before = np.empty(len(tokens), np.int64)
        before[1:] = tokens[:-1]
        before[starts] = end
        keys, self.of_token, self.often = np.unique(before * size + tokens, return_inverse=True, return_counts=True)
        self.first, self.second = keys // size, keys % size


class Asked:
    """What a batch asks the shards: its bigrams, and what makes a cut context whole.

    Where a border cuts a context, pairs are added so that each shard with a part
    of that context is asked.  ``added`` has their places and contexts, ``again``
    where a context begins once more, in another shard.
    """

    def __init__(self, texts: Texts, bigrams: Bigrams, borders: Borders) -> None:
        v, first = texts.vocabulary, bigrams.first
        context, word, self.often = v[first], (v[bigrams.second] >> np.uint64(WORD_BITS - BEHIND_BITS)).astype(np.uint32), bigrams.often
        self.added = np.empty((2, 0), np.int64)
        cut = np.flatnonzero(np.isin(borders.context, v))
        if len(cut):
            c = np.concatenate([context, borders.context[cut], borders.context[cut]])
            w = np.concatenate([word, borders.word[cut], np.zeros(len(cut), np.uint32)])
            order = np.lexsort((w, c))
            places = np.flatnonzero(order >= len(context))
            context, word, self.often = c[order], w[order], np.append(self.often, np.zeros(2 * len(cut), np.int64))[order]
            self.added = np.stack([places, np.searchsorted(v, context[places])])
        shard = borders.of(context, word)
        new = np.append(True, context[1:] != context[:-1])[: len(context)]
        other = np.append(True, shard[1:] != shard[:-1])[: len(context)]
        self.again = np.flatnonzero(other & ~new)
        self.starts = np.flatnonzero(new | other)
        self.word, self.context, self.lens = word, context[self.starts], np.diff(np.append(self.starts, len(context)))
        self.shard, self.word_cuts = shard[other], np.append(np.flatnonzero(other), len(shard))
        self.context_cuts = np.searchsorted(self.starts, self.word_cuts)

    def message(self, batch: int, counts: bool, texts: bytes | None) -> pa.RecordBatch:
        """A row a shard; one of them, drawn by the batch's number, carries ``texts``."""
        n, at = len(self.shard), int(mix64(np.array([batch], np.uint64))[0] % np.uint64(len(self.shard)))
        cut = lambda x, cuts: pa.array([_squeeze(x[a:b]) for a, b in pairwise(cuts)], pa.binary())
        steps = _steps(self.context, self.context_cuts[:-1])
        columns = [pa.array(self.shard.astype(np.int32)), pa.array(np.full(n, batch)), cut(steps, self.context_cuts), cut(self.lens.astype(np.uint32), self.context_cuts)]
        columns += [cut(_steps(self.word, self.starts), self.word_cuts), cut(self.often.astype(np.uint32), self.word_cuts) if counts else pa.nulls(n, pa.binary())]
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.binary()) if texts is None else pa.array([texts if k == at else None for k in range(n)], pa.binary())], COLUMNS)


def _read_message(contexts: bytes, lens: bytes, words: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = _unsqueeze(lens, np.uint32)
    return np.cumsum(_unsqueeze(contexts, np.uint64), dtype=np.uint64), n, _sums(_unsqueeze(words, np.uint32), n)


def _sent(borders, training: bool):
    """Batches (id, text) to messages by shard; with counts for training, else with the batch's tokens, which a shard hands on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = TaskContext.get().partitionId() << 32
        for whole in batches:
            for b in slices(whole, 1, BATCH, BATCH_BYTES):
                tag += 1
                texts = Texts.read(b.column(1))
                bigrams = Bigrams(texts.tokens, texts.starts, texts.end, len(texts.vocabulary))
                asked, blob = Asked(texts, bigrams, borders.value), None
                del bigrams
                if not training:
                    ids = b.column(0).fill_null(NO_ID).to_numpy().astype(np.int64)
                    head = np.array([len(texts.vocabulary), texts.end], np.int64)
                    blob = pickle.dumps([_squeeze(x) for x in (head, texts.tokens, texts.starts.astype(np.int32), ids, asked.added[0], asked.added[1], asked.again)])
                del texts
                yield asked.message(tag, training, blob)
                del asked
        give_back()

    return run


def _sampled(rate: float):
    """Some distinct pairs of each batch, drawn by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nowhere = Borders(np.empty(0, np.uint64), np.empty(0, np.uint32))
        for whole in batches:
            for b in slices(whole, 0, 256, 1 << 20):
                texts = Texts.read(b.column(0))
                asked = Asked(texts, Bigrams(texts.tokens, texts.starts, texts.end, len(texts.vocabulary)), nowhere)
                context = np.repeat(asked.context, asked.lens)
                drawn = np.flatnonzero(mix64(context ^ mix64(asked.word.astype(np.uint64) + np.uint64(b.num_rows))) < np.uint64(min(rate, 1.0) * (2**64 - 2048)))
                yield pa.RecordBatch.from_arrays([pa.array(context[drawn].view(np.int64)), pa.array(asked.word[drawn].astype(np.int64))], ["c", "w"])
        give_back()

    return run


def _borders(rows: DataFrame, size: int, shards: int) -> Borders:
    """Quantiles of sampled pairs: about ``PER_SHARD`` a shard, whatever the size of the table."""
    if shards < 2:
        return Borders(np.empty(0, np.uint64), np.empty(0, np.uint32))
    wanted = PER_SHARD * shards
    # Whole texts first, drawn with their size in mind, then pairs of these; eight bytes of text have about one pair.
    part = min(1.0, 64 * 8 * wanted / max(1, size))
    texts = rows.filter(F.pmod(F.xxhash64("_text", "_id"), F.lit(1 << 30)) < F.lit(int(part * (1 << 30)))).select("_text")
    found = texts.mapInArrow(_sampled(8 * wanted / max(1.0, part * size)), "c long, w long").toPandas()  # about ``wanted`` rows
    context, word = found.c.to_numpy(np.int64).view(np.uint64), found.w.to_numpy(np.uint32)
    order = np.lexsort((word, context))[np.arange(1, shards) * len(found) // shards] if len(found) >= shards else np.empty(0, np.int64)
    new = [k for j, k in enumerate(order) if not j or (context[k], word[k]) != (context[order[j - 1]], word[order[j - 1]])]
    return Borders(context[new], word[new])


def _built(path: str, borders):
    """A shard's messages to its trie; returns what the totals need."""

    def run(messages: pa.Table) -> pa.Table:
        shard = messages.column("shard")[0].as_py()
        parts: list[list[np.ndarray]] = [[], [], []]
        for *three, counts in zip(*(messages.column(c).to_pylist() for c in COLUMNS[2:6]), strict=True):
            context, lens, word = _read_message(*three)
            for to, x in zip(parts, (np.repeat(context, lens), word, _unsqueeze(counts, np.uint32)), strict=True):
                to.append(x)
        del messages
        context, word, count = (np.concatenate(x) for x in parts)
        del parts
        asked = count > 0
        context, word, count = context[asked], word[asked], count[asked]
        order = np.lexsort((word, context))
        context, word, count = context[order], word[order], count[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (word[1:] != word[:-1]))[: len(context)])
        context, word, count = context[first], word[first], np.add.reduceat(count, first) if len(first) else count
        if len(first):
            write_shared(f"{path}/{shard}.trie", Trie.build(context, word, count))
        starts = np.flatnonzero(np.append(True, context[1:] != context[:-1])[: len(context)])
        sums = np.add.reduceat(count, starts) if len(starts) else np.empty(0, np.int64)
        # Contexts that a border cuts are counted by the driver, from their parts: two a shard at most.
        parted = np.isin(context[starts], borders.value.context)
        edges = [{"c": int(c), "n": int(n)} for c, n in zip(context[starts][parted].view(np.int64), sums[parted], strict=True)]
        out = pa.table({"shard": pa.array([shard], pa.int32()), "total": [int(sums.sum())], "words": [int((~parted).sum())], "once": [int((sums[~parted] == 1).sum())], "edges": pa.array([edges], pa.list_(pa.struct({"c": pa.int64(), "n": pa.int64()})))})
        give_back()
        return out

    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Model:
    """A model of all these texts, stored in the shared folder."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    size = rows.agg(F.sum(F.octet_length("_text") + 1)).first()[0] or 0
    borders = _borders(rows, size, size // shard_bytes + 1)
    shared, path = spark.sparkContext.broadcast(borders), new_path(spark, "lm-trie")
    sent = rows.mapInArrow(_sent(shared, True), MESSAGE)
    # A row a shard.
    built = sent.groupBy("shard").applyInArrow(_built(path, shared), "shard int, total long, words long, once long, edges array<struct<c:long,n:long>>").collect()
    present, cut = np.zeros(borders.shards, bool), {}
    for r in built:
        present[r["shard"]] = r["total"] > 0
        for e in r["edges"]:
            cut[e["c"]] = cut.get(e["c"], 0) + e["n"]
    sums = [sum(r[k] for r in built) for k in ("total", "words", "once")]
    return Model(path, borders, present, sums[0], sums[1] + len(cut), sums[2] + sum(n == 1 for n in cut.values()))


def _answered(shared):
    """A shard's messages to answers from its trie, many messages at once; tokens are handed on."""

    def run(messages: pa.Table) -> pa.Table:
        model: Model = shared.value
        shard = messages.column("shard")[0].as_py()
        trie = Trie(map_shared(f"{model.path}/{shard}.trie")) if model.present[shard] else None
        columns: list[list] = [[], [], []]
        for at in range(0, messages.num_rows, 64):
            some = messages.slice(at, 64)
            context, lens, word = zip(*map(_read_message, *(some.column(c).to_pylist() for c in COLUMNS[2:5])), strict=True)
            contexts, words = (np.concatenate([[0], np.cumsum([len(x) for x in xs])]) for xs in (context, word))
            context, lens, word = np.concatenate(context), np.concatenate(lens), np.concatenate(word)
            zeros = np.zeros(len(context), np.int64)
            count, successors, codes = trie.look(context, lens, word) if trie else (zeros, zeros, np.zeros(len(word), np.uint8))
            for to, values, cuts in zip(columns, (count, successors.astype(np.uint32), codes), (contexts, contexts, words), strict=True):
                to += [_squeeze(values[a:b]) for a, b in pairwise(cuts)]
        n = messages.num_rows
        out = [messages.column("batch"), messages.column("shard"), *(pa.array(c, pa.binary()) for c in columns), pa.array(np.full(n, trie.step if trie else 0.0)), messages.column("texts")]
        del trie
        give_back()
        return pa.Table.from_arrays(out, ["batch", "shard", "counts", "successors", "codes", "step", "texts"])

    return run


def _summed(shared):
    """A batch's answers and tokens to one row a text."""

    def run(answers: pa.Table) -> pa.Table:
        model: Model = shared.value
        answers = answers.sort_by("shard")
        (size, end), tokens, starts, ids, places, contexts, again = map(_unsqueeze, pickle.loads(next(x for x in answers.column("texts").to_pylist() if x is not None)), (np.int64, np.int32, np.int32, np.int64, np.int64, np.int64, np.int64))
        bigrams = Bigrams(tokens, starts, end, size)
        whole = lambda c, kind: np.concatenate([_unsqueeze(x, kind) for x in answers.column(c).to_pylist()])
        part, follow, codes = whole("counts", np.int64), whole("successors", np.uint32).astype(np.int64), whole("codes", np.uint8)
        # The asked pairs' contexts; each begins an entry, and does so again in each further shard.
        asked = np.ones(len(bigrams.first) + len(places), bool)
        asked[places] = False
        context = np.empty(len(asked), np.int64)
        context[asked], context[places] = bigrams.first, contexts
        entry = np.append(True, context[1:] != context[:-1])
        entry[again] = True
        if len(codes) != len(asked) or len(part) != entry.sum():
            raise RuntimeError("a batch's answers are not whole")
        step = np.repeat(answers.column("step").to_numpy(), [int(np.frombuffer(x, np.int64, 1)[0]) for x in answers.column("codes").to_pylist()])
        mass = np.where(codes > 0, 2.0 ** (-(codes.astype(np.float64) - 1) * step) * (part + follow)[np.cumsum(entry) - 1], 0.0)[asked]
        c, t = (np.bincount(context[entry], x, size) for x in (part, follow))
        p0, c_v, t_v = model.p0(c)[bigrams.second], c[bigrams.first], t[bigrams.first]
        p = np.where(c_v > 0, (mass + t_v * p0) / np.maximum(c_v + t_v, 1), p0)
        over = lambda x: np.add.reduceat(x, starts)
        seen, n = c[tokens], np.diff(np.append(starts, len(tokens))).astype(np.int64)
        out = pa.table({"_id": pa.array(ids, mask=ids == NO_ID), "_n": n, "_k": over((seen > 0).astype(np.int64)), "_b": over(np.log10(seen + 1)), "_s": over(np.log10(p)[bigrams.of_token])})
        give_back()
        return out

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, n_known, train_tokens, base_score, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    sent = rows.mapInArrow(_sent(docs.sparkSession.sparkContext.broadcast(model.borders), False), MESSAGE)
    found = sent.groupBy("shard").applyInArrow(_answered(shared), ANSWER).groupBy("batch").applyInArrow(_summed(shared), "_id long, _n long, _k long, _b double, _s double")
    each = F.lit(float(np.log10(model.total + model.words + 1)))
    return found.select(F.col("_id").alias(id_col), F.col("_n").alias("n_tokens"), F.col("_k").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("_b") - F.col("_n") * each).alias("base_score"), F.col("_s").alias("score"))


def train_and_score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Scores of all texts by a model of those that ``training`` holds for; the model goes when they are stored."""
    with Scope() as scope:
        model = train(docs.filter(F.coalesce(training, F.lit(False))), id_col, text_col, shard_bytes)
        return scope.keep(stored(score(docs, model, id_col, text_col), "lm-scores"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those whose hash of the id leaves another remainder than 2."""
    remainder = crc_text(F.col("doc_id")) % 7
    found = train_and_score(table(spark, sf_dir, "documents"), remainder != 2)
    return found.select("doc_id", (remainder == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op9_lm_scoring": op9_lm_scoring}
