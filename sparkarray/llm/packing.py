"""Best-fit packing of token sequences by length patterns.

Texts become token ids; only documents longer than a sequence are cut.  Packing
looks at the histogram of piece lengths alone, which has one entry a length and
so at most ``capacity`` entries, whatever the size of the table:

1. lengths are grouped: long ones into bins of a ``BINS``-th of a sequence, short
   ones (a ``SHORT``-th of it at most) into classes that shrink by a third.  Patterns
   are enumerated: two or three long bins that fill a sequence, or up to two long
   bins and as many pieces of one short class as the rest takes; what then is left
   is filled from smaller classes, by their mean lengths.  Non-negative
   least squares fits how often each pattern is needed to use up the whole
   histogram, in tokens;
2. the counts are rounded down and realised with actual lengths, the largest
   that fits first, as long as the histogram has them;
3. the residual pieces, and the room left in patterns, are packed best fit.

The plan is a list of runs: "the n-th to m-th pieces of length L stand at offset
o of sequences s, s+1, ...".  Each piece finds its run by its number among the
pieces of its length; that number comes from block counts, so a length that a
third of all pieces share is still numbered by many tasks.

Cases: a null text is empty; an empty text is the end id alone; repeated rows are
separate pieces (equal ids: numbered in any order), as are texts that share an
id; null ids stay null; a very long text is a batch of its own and many pieces;
other columns of the input, whatever their names, are left out; an empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scope, stored, table
from ._text import give_back, slices

CAPACITY, END_ID, BINS, SHORT, CACHE = 4096, 1, 128, 4, 600_000
#: Patterns take this share of what the fit gives them, and leave at most a ``WASTE``-th of a sequence empty: the rest needs short pieces, too.
TAKEN, WASTE = 0.95, 1024
#: Texts and bytes of text that are encoded at once.
BATCH, BATCH_BYTES = 4096, 8 << 20


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Words that every step of the tokenizer leaves as one lower-case word: their ids can be told apart in one encoding.
_PLAIN = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+")
_TAILS = (".", ",")
#: Ids (as bytes) by word, per tokenizer; a worker keeps them from task to task: the words since the last turn, and those used before it.
#: A turn comes with ``CACHE`` words; what the texts then still use moves over, the rest goes with the next turn.
_known: dict[str, list[dict[str, bytes]]] = {}


def _bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Encoder:
    """Ids of texts.  Words repeat, so each distinct one is encoded once.

    Encoding word by word equals encoding the whole text where the tokenizer
    splits at ASCII white space and drops it, and a comma or full stop behind a
    letter is a word of its own (``splits``); for others the whole text is encoded.
    """

    def __init__(self, path: str, splits: bool = True) -> None:
        self.path, self.splits, self.kept = path, splits, _known.setdefault(path, [{}, {}])

    def learn(self, words: list[str]) -> None:
        tokenizer = _tokenizer(self.path)
        words = list(dict.fromkeys(words))
        plain = [w for w in words if _PLAIN.fullmatch(w)]
        for k in range(0, len(plain), 512):
            some = plain[k : k + 512]
            e = tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids, place = np.array(e.ids, "<u4"), np.array(e.word_ids, np.int64)
            cuts = np.searchsorted(place, np.arange(len(some) + 1))
            data = ids.tobytes()
            self.kept[0].update((w, data[4 * a : 4 * b]) for w, a, b in zip(some, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        rest = [w for w in words if w not in self.kept[0]]
        for w, e in zip(rest, tokenizer.encode_batch(rest, add_special_tokens=False), strict=True):
            self.kept[0][w] = _bytes(e.ids)

    def coded(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as bytes."""
        if len(self.kept[0]) > CACHE:
            self.kept[:] = {}, self.kept[0]
        known, before = self.kept
        own = [known.get(w) for w in words]
        missing = []
        for k, found in enumerate(own):
            if found is None:
                if (found := before.get(words[k])) is None:
                    missing.append(k)
                else:
                    own[k] = known[words[k]] = found
        parts = [(w[:-1], w[-1]) if w[-1:] in _TAILS and w[-2:-1].isalpha() else (w, "") for w in (words[k] for k in missing)]
        for p in (*(p for p, _ in parts), *_TAILS):
            if p in before and p not in known:
                known[p] = before[p]
        self.learn([p for p in (*(p for p, _ in parts), *_TAILS) if p not in known])
        for k, (stem, tail) in zip(missing, parts, strict=True):
            own[k] = known[stem] + known[tail] if tail else known[stem]
        return own

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        if not self.splits:
            return [np.array(e.ids, "<u4") for e in _tokenizer(self.path).encode_batch(texts.to_pylist(), add_special_tokens=False)]
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # lower case comes anyway, but behind special tokens
            texts = pc.ascii_lower(texts)
        parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = parts.flatten().dictionary_encode()
        own = self.coded(coded.dictionary.to_pylist())
        lens = np.fromiter(map(len, own), np.int64, len(own)) // 4
        flat, first = np.frombuffer(b"".join(own), "<u4"), np.cumsum(lens) - lens
        at = coded.indices.to_numpy().astype(np.int64)
        n = lens[at]
        ends = np.cumsum(n)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[at] - (ends - n), n)
        ids, upto = flat[take], np.concatenate([[0], ends])
        cuts = upto[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", splits: bool = True) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path, splits)
        for whole in batches:
            for b in slices(whole, 1, BATCH, BATCH_BYTES):
                rows: list[list[int]] = [[], [], [], [], []]
                for r, ids in enumerate(encode(b.column(1))):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        for to, v in zip(rows, (r, piece, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                            to.append(v)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])], [id_col, "piece", "start", "length", "ids_crc32"])
        give_back()

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(id_col, text.alias("_text")).mapInArrow(run, f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min |ax - b| over x >= 0 by the active-set method of Lawson and Hanson, for many more columns than rows."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    least = 1e-9 * max(1e-300, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(rounds):
        w = a.T @ (b - a[:, passive] @ x[passive])
        w[passive] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= least:
            break
        passive[j] = True
        while passive.any():
            p = np.flatnonzero(passive)
            s = np.linalg.lstsq(a[:, p], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[p] = s
                break
            bad = s <= 0
            step = np.min(x[p][bad] / np.maximum(x[p][bad] - s[bad], 1e-300))
            x[p] += step * (s - x[p])
            passive[p[x[p] <= 1e-12]] = False
            x[~passive] = 0
    return x


def long_patterns(there: list[int], bins: int) -> tuple[list[tuple[int, ...]], list[tuple[int, ...]]]:
    """Of the bins that have pieces: pairs and triples that fill ``bins`` exactly, and up to two bins that leave room."""
    have = set(there)
    pairs = [(a, b) for a, b in combinations_with_replacement(there, 2) if a + b <= bins]
    full = [p for p in pairs if sum(p) == bins] + [(a, b, bins - a - b) for a, b in pairs if bins - a - b >= b and bins - a - b in have]
    return full, [(), *((a,) for a in there), *(p for p in pairs if sum(p) < bins)]


class Lengths:
    """What is left of the histogram, by group of lengths."""

    def __init__(self, histogram: dict[int, int], capacity: int, bins: int) -> None:
        self.left, self.width, self.bins = dict(histogram), capacity / bins, bins
        self.ends = [capacity / SHORT]  # of short classes, the largest first; the last one takes all shorter lengths
        while self.ends[-1] > 2 * self.width / SHORT:
            self.ends.append(self.ends[-1] / 1.5)
        self.groups: dict[int, list[int]] = {}
        self.groups[0] = sorted(histogram)  # all lengths
        for k in self.groups[0]:
            self.groups.setdefault(self.group(k), []).append(k)

    def group(self, k: int) -> int:
        """A long bin from 1, or a short class as -1, -2, ..."""
        if k > self.ends[0]:
            return int(np.ceil(k / self.width))
        return -max(i for i, end in enumerate(self.ends, 1) if k <= end)

    def largest(self, group: int, room: int, used: Counter) -> int | None:
        """The largest length of a group (0: of all) that fits and that these sequences have not used up."""
        known = self.groups.get(group, [])
        at = bisect.bisect_right(known, room) - 1
        while at >= 0 and self.left[known[at]] <= used[known[at]]:
            at -= 1
        return known[at] if at >= 0 else None

    def nearest(self, group: int, wanted: float, room: int, used: Counter) -> int | None:
        """The length of a group nearest to the wanted one that fits and is not used up."""
        known = self.groups.get(group, [])
        end = bisect.bisect_right(known, room)
        high = min(bisect.bisect_left(known, wanted), end)
        low = high - 1
        while high < end and self.left[known[high]] <= used[known[high]]:
            high += 1
        while low >= 0 and self.left[known[low]] <= used[known[low]]:
            low -= 1
        if high < end and (low < 0 or known[high] - wanted < wanted - known[low]):
            return known[high]
        return known[low] if low >= 0 else None

    def filling(self, room: int, used: Counter) -> list[int]:
        """Two lengths that fill the room exactly, of those that are left; or the largest that fits."""
        known = self.groups[0]
        for at in range(bisect.bisect_right(known, room) - 1, bisect.bisect_left(known, room / 2) - 1, -1):
            k, other = known[at], room - known[at]
            if self.left[k] > used[k] and (not other or self.left.get(other, 0) > used[other] + (k == other)):
                return [k, other] if other else [k]
        k = self.largest(0, room, used)
        return [] if k is None else [k]

    def take(self, used: Counter, times: int) -> None:
        for k, c in used.items():
            self.left[k] -= times * c
            if not self.left[k]:
                for known in (self.groups[0], self.groups[self.group(k)]):
                    known.pop(bisect.bisect_left(known, k))


def plan(histogram: dict[int, int], capacity: int = CAPACITY, bins: int = BINS) -> tuple[list[tuple[list[int], int]], int]:
    """(lengths that share a sequence, how many such sequences) for the whole histogram; and how many pieces patterns placed."""
    runs: list[tuple[list[int], int]] = [([capacity], histogram[capacity])] if histogram.get(capacity) else []
    lengths = Lengths({k: v for k, v in histogram.items() if v and k < capacity}, capacity, bins)
    if not lengths.left:
        return runs, 0
    groups = sorted(g for g in lengths.groups if g)
    count = {g: sum(lengths.left[k] for k in lengths.groups[g]) for g in groups}
    size = {g: sum(k * lengths.left[k] for k in lengths.groups[g]) / count[g] for g in groups}
    short = sorted((g for g in groups if g < 0), key=lambda g: -size[g])
    full, open_ = long_patterns([g for g in groups if g > 0], bins)
    patterns = [(p, _fills(capacity - sum(size[g] for g in p), short, size)) for p in full]
    for p in open_:
        room = capacity - sum(size[g] for g in p)
        patterns += [(p, _fills(room, [g, *short], size)) for g in short if room >= size[g]]
    opened: list[tuple[list[int], int]] = []
    placed = 0
    if patterns:
        row = {g: k for k, g in enumerate(groups)}
        a = np.zeros((len(groups), len(patterns)))
        for j, (p, fills) in enumerate(patterns):
            for g, n in (*((g, 1) for g in p), *fills):
                a[row[g], j] += n
        tokens = np.array([size[g] / capacity for g in groups])
        need = np.array([count[g] for g in groups], float)
        scale = need @ tokens
        times = np.floor(nnls(a * tokens[:, None], need * tokens / scale) * scale * TAKEN + 1e-6).astype(np.int64)
        for j in np.argsort(-times, kind="stable"):
            for chosen, own, m in _realised(lengths, *patterns[j], size, int(times[j]), capacity):
                opened.append((chosen, m))
                placed += own * m
    return runs + _best_fit(lengths.left, opened, capacity), placed


def _fills(room: float, classes: list[int], size: dict[int, float]) -> list[tuple[int, int]]:
    """(class, copies): as many of each class in turn as the room takes."""
    out = []
    for g in classes:
        if n := int(max(0.0, room) // size[g]):
            out.append((g, n))
            room -= n * size[g]
    return out


def _realised(lengths: Lengths, long: tuple[int, ...], fills: list[tuple[int, int]], size: dict[int, float], times: int, capacity: int) -> list[tuple[list[int], int, int]]:
    """A pattern's sequences with actual lengths; fewer than ``times`` if the histogram has no more that fill them.

    (lengths, how many of these are the pattern's own, sequences).  Lengths are chosen
    so that a class takes the room that the fit gave it; what is left in the end, one
    of them takes by being a little longer, or else the best fitting pieces.
    """
    out = []
    while times > 0:
        used: Counter = Counter()
        room, chosen = capacity, []
        for g, copies in (*((g, 1) for g in sorted(long, reverse=True)), *fills):
            share = copies * size[g]
            while copies and (k := lengths.nearest(g, share / copies, room, used)) is not None:
                chosen.append(k)
                used[k] += 1
                room -= k
                share -= k
                copies -= 1
            if copies and g > 0:  # the fit took more of this bin than there is
                return out
        own = len(chosen)
        longer = [(k, new) for k in set(chosen) if (new := lengths.largest(0, k + room, used)) is not None]
        k, new = max(longer, key=lambda x: (x[1] - x[0], -x[0]), default=(0, 0))
        if new > k:
            chosen[chosen.index(k)] = new
            used[k] -= 1
            used[new] += 1
            used = +used
            room -= new - k
        while found := lengths.filling(room, used):
            chosen += found
            used.update(found)
            room -= sum(found)
        if room * WASTE > capacity:
            return out
        m = min(times, *(lengths.left[k] // c for k, c in used.items()))
        lengths.take(used, m)
        out.append((chosen, own, m))
        times -= m
    return out


def _best_fit(left: dict[int, int], opened: list[tuple[list[int], int]], capacity: int) -> list[tuple[list[int], int]]:
    """Best fit, longest first, over the room in opened sequences and in new ones.

    Sequences with the same room are handled as one run, so the work depends on
    the number of distinct lengths and rooms, not on the number of pieces.
    """
    rooms: dict[int, list[tuple[list[int], int]]] = {}
    order: list[int] = []

    def put(lengths: list[int], n: int) -> None:
        room = capacity - sum(lengths)
        if room not in rooms:
            rooms[room] = []
            bisect.insort(order, room)
        rooms[room].append((lengths, n))

    for lengths, n in opened:
        put(lengths, n)
    for k in sorted((k for k, v in left.items() if v), reverse=True):
        n = left[k]
        while n:
            at = bisect.bisect_left(order, k)
            if at == len(order):
                each = capacity // k
                if n // each:
                    put([k] * each, n // each)
                if n % each:
                    put([k] * (n % each), 1)
                break
            room = order[at]
            lengths, m = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(at)
            each = min(room // k, n)
            fit = min(m, n // each)
            if fit < m:
                put(lengths, m - fit)
            put(lengths + [k] * each, fit)
            n -= fit * each
    return [run for room in order for run in rooms[room]]


def plan_runs(sequences: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """The plan as runs sorted by length and first number: length, first, sequence, offset."""
    rows, used, base = [], {}, 0
    for lengths, n in sequences:
        offset = 0
        for k in lengths:
            rows.append((k, used.get(k, 0), base, offset))
            used[k] = used.get(k, 0) + n
            offset += k
        base += n
    found = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "first", "sequence", "offset"), found.T, strict=True))


def place(cut: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to stored pieces."""
    spark = cut.sparkSession
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs = spark.sparkContext.broadcast(plan_runs(plan(counts, capacity)[0]))
    blocks = int(sum(counts.values()) ** 0.5 / 4) + 1
    cut = cut.withColumn("_block", F.pmod(F.xxhash64(id_col, "piece"), F.lit(blocks)).cast("int"))
    sums = cut.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("length", "_block", "_before")
    numbered = cut.withColumn("_nth", F.row_number().over(Window.partitionBy("length", "_block").orderBy(id_col, "piece"))).join(starts, ["length", "_block"])
    names = [id_col, "piece", "start", "length", "ids_crc32"]
    rows = numbered.select(*names, (F.col("_before") + F.col("_nth") - 1).alias("_number"))
    schema = ", ".join(f"{c} {k}" for c, k in rows.dtypes if c != "_number") + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = runs.value
        most = int(r["first"].max(initial=0)) + 1
        keys = r["length"] * most + r["first"]
        for b in batches:
            length, number = (b.column(k).to_numpy() for k in (3, 5))
            at = np.searchsorted(keys, length * most + np.minimum(number, most - 1), side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(r["sequence"][at] + number - r["first"][at]), pa.array(r["offset"][at])], [*names, "sequence_id", "offset"])

    return rows.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its sequence and its place there."""
    return place(stored(pieces(docs, path, capacity, id_col=id_col, text_col=text_col), "pack-pieces"), capacity, id_col)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op5_best_fit_packing": op5_best_fit_packing}
