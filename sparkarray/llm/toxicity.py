"""Toxicity by a weighted finite-state pattern grammar.

A clause is read word by word by a cascade of small weighted transducers.  The
lexicon turns a word into a class with a weight; negation, reported speech,
target and threat each rewrite the symbols that come from the one before, and
multiply weights: an insult behind a negation becomes a negated one, an insult
with a target an aimed one, a threat verb with somebody it is meant for a threat.
The last machine takes the gravest kind that it reads.  The cascade's composition
is built state by state as it is needed.  A text is scored by its matched clauses
(their kinds and weights), never by words alone.

The lexicon of insults starts from a short list of fixed words and is learned
from labelled texts: whole words, and word beginnings that one, two, three or five
different words of a text must have, which toxic texts have more often than
others.  A feature counts if the likelihood ratio says so and if it is in ``LEAST``
toxic texts that no better one explains (copies of a text share all their words);
its weight is its log odds, less as the evidence is thin.  There is
no limit to their number or to how rare a family of insults may be among the toxic
texts.  Logistic regression over the clause kinds, with a prior that follows the
grammar, turns them into a score; what it learns from is each text as a lexicon of
the other ``FOLDS`` - 1 parts of the sample reads it, so that chance features of
the text itself don't count.  Training sees a sample of at most ``SAMPLE``
labelled rows (the smallest by a hash of id and text), a documented bound; labels,
language, source and id never enter a score.

Cases: a null text is empty; an empty text gets the score of a text without
matches; a very long one is read whole, and its matches count by their share;
null or missing labels, and rows without an id, are not learned from but scored;
rows that share an id share its label; without any label of either kind the
prior alone scores; repeated rows score alike; other columns, whatever their
names, stay; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Scope, crc_text, fresh, stored, table
from ._text import give_back, slices

SAMPLE = 12_000
#: A learned feature: in so many toxic texts without a better one, and such a share of all that have it; with these log odds, and with the likelihood ratio that :func:`evidence` asks for.
LEAST, LEAST_NEW, LEAST_LOD = 3, 0.05, 2.0
PREFIXES, DIFFERENT, FOLDS = range(3, 9), (1, 2, 3, 5), 5
#: Rows and bytes of text that Python handles at once.
BATCH, BATCH_BYTES = 4096, 4 << 20

# Seed words of the grammar's classes, in English, French, German and Spanish.
INSULTS = "idiot moron stupid scum trash loser worthless pathetic disgusting clown imbecile cretin dumbass vermin filth imbécile crétin connard ordure abruti dummkopf vollidiot abschaum trottel versager estúpido imbécil basura escoria inútil".split()
THREATS = "kill hurt destroy beat burn shoot stab crush tuer frapper détruire brûler töten schlagen vernichten verbrennen matar golpear destruir quemar".split()
MODALS = "will gonna shall should must going deserve vais va dois werde wird soll muss voy va debo deberías".split()
TARGETS = "you your yours yourself u ur he she him her they them their those these people tu te toi vous votre il elle eux leur du dich dir dein deine ihr euch er sie tú usted te ti tus ellos ellas él ella".split()
NEGATIONS = "not no never isn aren wasn don doesn didn without neither nor ne pas jamais non sans nicht kein keine nie ohne nunca sin tampoco".split()
REPORTS = "said says say told called calls wrote quoted quote alleged reported according word term dit dite appelé écrit selon sagte nannte schrieb laut dijo llamó escribió según".split()

INSULT, THREAT, MODAL, TARGET, NEGATION, REPORT, OTHER = "ITMYNRO"
CLASSES = {w: c for words, c in ((TARGETS, TARGET), (MODALS, MODAL), (REPORTS, REPORT), (NEGATIONS, NEGATION)) for w in words}

#: Symbols that machines write: negated and reported insults and threats, aimed insults, threats that are meant for somebody.
NEG_INSULT, NEG_THREAT, REP_INSULT, REP_THREAT, AIMED, MEANT = "itqrAH"

#: A transducer: (state, read) -> (state, written, weight); for what is missing the state stays and the symbol passes. State 0 starts.
NEGATION_FST = {
    (0, NEGATION): (1, NEGATION, 1.0),
    **{(k, c): ((k + 1) % 4, c, 1.0) for k in (1, 2, 3) for c in (OTHER, TARGET, MODAL)},
    **{(k, INSULT): (0, NEG_INSULT, 0.5) for k in (1, 2, 3)},
    **{(k, THREAT): (0, NEG_THREAT, 0.5) for k in (1, 2, 3)},
}
REPORT_FST = {(0, REPORT): (1, REPORT, 1.0), (1, INSULT): (1, REP_INSULT, 0.7), (1, THREAT): (1, REP_THREAT, 0.7)}
TARGET_FST = {(0, TARGET): (1, TARGET, 1.0), (0, INSULT): (2, INSULT, 1.0), (1, INSULT): (1, AIMED, 1.2), (2, TARGET): (1, AIMED, 1.0)}
THREAT_FST = {(0, MODAL): (1, MODAL, 1.0), (0, THREAT): (2, THREAT, 1.0), (1, THREAT): (1, MEANT, 1.0), (2, TARGET): (1, MEANT, 1.0), (2, AIMED): (1, MEANT, 1.0)}
#: The gravest kind so far; states are those of ``KINDS``, from 1.
KIND_FST = {(k, c): (max(k, to), c, 1.0) for k in range(6) for c, to in ((INSULT, 1), (AIMED, 2), (MEANT, 3), (NEG_INSULT, 4), (NEG_THREAT, 4), (REP_INSULT, 5), (REP_THREAT, 5))}
MACHINES = (NEGATION_FST, REPORT_FST, TARGET_FST, THREAT_FST, KIND_FST)

KINDS = ("plain", "targeted", "threat", "negated", "reported")
FEATURES = (*KINDS, "heaviest", "clauses", "density")
#: Prior means of the coefficients; what no labelled text shows stays there.
PRIOR = np.array([0.5, 0.7, 0.9, 0.05, 0.15, 0.3, 0.1, 0.3])
PRIOR_BIAS = -4.0


class Cascade:
    """The composition of transducers: each reads what the one before writes; states are made as they are met."""

    def __init__(self, machines: tuple[dict, ...] = MACHINES) -> None:
        self.machines, self.arcs = machines, {}

    def step(self, state: tuple[int, ...], symbol: str) -> tuple[tuple[int, ...], float]:
        """The next state, and the weight of the arcs on the way."""
        found = self.arcs.get((state, symbol))
        if found is None:
            states, weight, read = [], 1.0, symbol
            for machine, s in zip(self.machines, state, strict=True):
                s, read, w = machine.get((s, read), (s, read, 1.0))
                states.append(s)
                weight *= w
            found = self.arcs[state, symbol] = tuple(states), weight
        return found

    def clause(self, words: list[tuple[str, float]]) -> tuple[int, float]:
        """The kind of a clause (its place in ``KINDS``, or -1 if no pattern matches) and its weight, from classes and weights."""
        state, total = (0,) * len(self.machines), 0.0
        for symbol, own in words:
            state, weight = self.step(state, symbol)
            total += own * weight
        return state[-1] - 1, total


@dataclass
class Model:
    """Weights of insults (whole words; word beginnings, with how many different words must have them) and of the clause kinds."""

    words: dict[str, float]
    prefixes: dict[str, tuple[float, int]]
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(FEATURES)))
    coefficients: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    bias: float = PRIOR_BIAS


_CLAUSE_END = re.compile(r"[.!?;\n|]")
_WORD = re.compile(r"\w+")


class Scorer:
    """Finds clauses that hold an insult or threat, and runs the grammar over them."""

    def __init__(self, model: Model) -> None:
        import ahocorasick

        self.model, self.grammar = model, Cascade()
        self.trie = ahocorasick.Automaton()
        for word in {*model.words, *model.prefixes, *THREATS}:
            self.trie.add_word(word, len(word))
        self.trie.make_automaton()

    def weigh(self, word: str, live: dict[str, float]) -> tuple[str, float]:
        """A word's class and weight; ``live``: the word beginnings that enough of the text's words have."""
        weight = self.model.words.get(word)
        for k in PREFIXES:
            if len(word) >= k and (found := live.get(word[:k])) is not None:
                weight = max(weight or 0.0, found)
        if weight is not None:
            return INSULT, weight
        return (THREAT, 2.0) if word in _THREATS else (CLASSES.get(word, OTHER), 0.0)

    def features(self, text: str) -> np.ndarray:
        out = np.zeros(len(FEATURES))
        low, done, found, having = text.lower(), -1, [], {}
        for end, size in self.trie.iter(low):
            start = end - size + 1
            if start and (low[start - 1].isalnum() or low[start - 1] == "_"):
                continue
            found.append((start, end))
            stem = low[start : end + 1]
            if stem in self.model.prefixes:
                having.setdefault(stem, set()).add(_WORD.match(low, start).group())
        live = {p: self.model.prefixes[p][0] for p, words in having.items() if len(words) >= self.model.prefixes[p][1]}
        for start, end in found:
            if start <= done:
                continue
            first = max(low.rfind(c, 0, start) for c in ".!?;\n|") + 1
            last = m.start() if (m := _CLAUSE_END.search(low, end)) else len(low)
            done = last
            kind, weight = self.grammar.clause([self.weigh(w, live) for w in _WORD.findall(low, first, last)])
            if kind >= 0:
                out[kind] += weight
                out[5] = max(out[5], weight)
                out[6] += 1
        if out[6]:
            out[7] = out[:5].sum() / math.log2(8 + len(low) / 6)
            out[:5] = np.log1p(out[:5])
            out[5:7] = np.log1p(out[5:7])
        return out

    def score(self, text: str) -> float:
        z = self.model.bias + float((self.features(text) / self.model.scale) @ self.model.coefficients)
        return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, z))))


_THREATS = frozenset(THREATS)


def log_odds(a: float, b: float, pos: int, neg: int) -> float:
    return math.log((a + 0.5) / (pos - a + 0.5)) - math.log((b + 0.5) / (neg - b + 0.5))


def g2(a: float, b: float, pos: int, neg: int) -> float:
    """Likelihood ratio of a feature that a of pos toxic and b of neg other texts have."""
    total = 0.0
    n = pos + neg
    cells = ((a, (a + b) * pos / n), (b, (a + b) * neg / n), (pos - a, (n - a - b) * pos / n), (neg - b, (n - a - b) * neg / n))
    for seen, expected in cells:
        if seen > 0 and expected > 0:
            total += seen * math.log(seen / expected)
    return 2 * total


def evidence(texts: int) -> float:
    """The least likelihood ratio of a feature; more texts have more features that fit by chance. Twice as much counts in full."""
    return 2 * math.log(max(texts, 50))


def parse_feature(f: str) -> tuple[str, int]:
    """The word or word beginning of a feature, and how many different words must have the beginning (0: a whole word)."""
    return (f[2:], int(f[1])) if f[0] == "^" else (f, 0)


def lexicon(counts: list[tuple[str, int, int]], pos: int, neg: int, texts: Sequence[Sequence[str]] = ()) -> Model:
    """Words and word beginnings (as ``^2stem``) that tell toxic texts, with the fixed ones; ``texts``: the counted features of each toxic text."""
    having: dict[str, list[int]] = {}
    for k, own in enumerate(texts):
        for f in own:
            having.setdefault(f, []).append(k)
    explained = [False] * len(texts)
    known = {f: (a, b) for f, a, b in counts}
    rated = []
    for f, (a, b) in known.items():
        lod = log_odds(a, b, pos, neg)
        if a >= LEAST and lod >= LEAST_LOD and (g := g2(a, b, pos, neg)) >= evidence(pos + neg):
            stem, many = parse_feature(f)
            rated.append((-round(g, 6), -len(stem), many, stem, f, lod * min(1.0, g / (2 * evidence(pos + neg)))))
    words: dict[str, float] = {}
    prefixes: dict[str, tuple[float, int]] = {}
    longer: set[str] = set()  # all beginnings of what is chosen
    for w in INSULTS:
        seen = known.get(w)
        words[w] = max(0.5, log_odds(*seen, pos, neg)) if seen and seen[0] + seen[1] >= 5 else 2.0
        longer.update(w[:k] for k in range(1, len(w) + 1))
        for k in having.get(w, ()):
            explained[k] = True
    for _, _, many, stem, f, weight in sorted(rated):
        if stem in longer or any(stem[:k] in prefixes for k in PREFIXES if k <= len(stem)):
            continue
        held = having.get(f, ())
        if sum(not explained[k] for k in held) < max(LEAST, LEAST_NEW * len(held)):
            continue
        for k in held:
            explained[k] = True
        if many:
            prefixes[stem] = (weight, many)
        else:
            words[stem] = weight
        longer.update(stem[:k] for k in range(1, len(stem) + 1))
    return Model(words, prefixes)


def lexicons(counts: list[tuple[str, list[int], list[int]]], pos: list[int], neg: list[int], texts: list[tuple[int, list[str]]]) -> tuple[Model, list[Model]]:
    """The lexicon of all parts of the sample, and for each part that of the others; counts, totals and toxic texts come by part."""
    whole = lexicon([(f, sum(a), sum(b)) for f, a, b in counts], sum(pos), sum(neg), [held for _, held in texts])
    others = []
    for k in range(FOLDS):
        p, n = sum(pos) - pos[k], sum(neg) - neg[k]
        others.append(lexicon([(f, sum(a) - a[k], sum(b) - b[k]) for f, a, b in counts], p, n, [held for part, held in texts if part != k]) if p and n else lexicon([], 1, 1))
    return whole, others


def fit(model: Model, x: np.ndarray, y: np.ndarray, strength: float = 2.0) -> Model:
    """Logistic regression by Newton's method, drawn towards the prior."""
    model.scale = np.maximum(x[x.any(axis=1)].std(axis=0) if x.any() else np.ones(x.shape[1]), 0.25)
    z = np.hstack([x / model.scale, np.ones((len(x), 1))])
    mean = np.append(PRIOR, PRIOR_BIAS)
    pull = np.append(np.full(x.shape[1], strength), 0.05)
    w = mean.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (p - y) + pull * (w - mean))
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    model.coefficients, model.bias = w[:-1], float(w[-1])
    return model


def text_features(text: str) -> set[str]:
    """A text's words, and the word beginnings that one, two, three or five of its different words have."""
    words = set(_WORD.findall(text.lower()))
    starts = Counter(w[:k] for w in words for k in PREFIXES if len(w) >= k)
    return words | {f"^{m}{p}" for p, n in starts.items() for m in DIFFERENT if n >= m}


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each feature: how many toxic and how many other texts have it, by part of the sample."""

    def out(counts: dict[str, np.ndarray]) -> pa.RecordBatch:
        sums = np.concatenate([x[None] for x in counts.values()])
        return pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), *(pa.array(x) for x in sums.T)], ["feature", *PARTS])

    counts: dict[str, np.ndarray] = {}
    for b in batches:
        for text, y, part in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            for f in text_features(text):
                if f not in counts:
                    counts[f] = np.zeros(2 * FOLDS, np.int64)
                counts[f][part + FOLDS * (1 - y)] += 1
            if len(counts) > 200_000:
                yield out(counts)
                counts = {}
    if counts:
        yield out(counts)
    del counts
    give_back()


#: Columns of counts: of toxic texts by part of the sample, then of others.
PARTS = [f"{c}{k}" for c in "ab" for k in range(FOLDS)]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Lexicon and weights from at most ``sample`` labelled rows outside the held-out fifth."""
    spark = docs.sparkSession
    usable = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(crc_text(F.col("doc_id")) % 5 != 0)
    usable = usable.groupBy(F.col("doc_id").alias("_of")).agg((F.max("toxic") > 0).cast("int").alias("_y"))
    # Twice a bound: so many ids are broadcast, and so many rows are learned from, however many rows share an id.
    ids = usable.orderBy(F.xxhash64("_of"), "_of").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text")).join(F.broadcast(ids), F.col("_id") == F.col("_of")).select("_text", "_y").distinct()
    with Scope():
        rows = stored(rows.withColumn("_h", F.xxhash64("_text", "_y")), "toxicity-sample")
        if rows.count() > sample:  # rows share ids: those with the least hashes stay
            rows = rows.filter(F.col("_h") <= rows.select("_h").orderBy("_h").limit(sample).agg(F.max("_h")).first()[0])
        rows = rows.select("_text", "_y", F.pmod(F.xxhash64("_text"), F.lit(FOLDS)).cast("int").alias("_part")).repartition(max(2, spark.sparkContext.defaultParallelism))
        per = {(r["_y"], r["_part"]): r["count"] for r in rows.groupBy("_y", "_part").count().collect()}
        pos, neg = ([per.get((y, k), 0) for k in range(FOLDS)] for y in (1, 0))
        if not sum(pos) or not sum(neg):
            return lexicon([], 1, 1)
        counts = rows.mapInArrow(_count_features, "feature string, " + ", ".join(f"{c} long" for c in PARTS)).groupBy("feature").agg(*[F.sum(c).alias(c) for c in PARTS])
        # The likelihood ratio as :func:`g2` has it, loosely: only what may pass comes to the driver, and a text has few such features.
        a, b = (sum((F.col(c) for c in PARTS[k + 1 : k + FOLDS]), F.col(PARTS[k])) for k in (0, FOLDS))
        p, n = sum(pos), sum(pos) + sum(neg)
        part = lambda seen, all_, of: F.when(seen > 0, seen * F.log(seen / (all_ * F.lit(of / n)))).otherwise(0.0)
        ratio = 2 * (part(a, a + b, p) + part(b, a + b, n - p) + part(p - a, n - a - b, p) + part(n - p - b, n - a - b, n - p))
        telling = (a >= LEAST) & (a / p > 2 * b / (n - p)) & (ratio > evidence(n) * 0.8)
        found = counts.filter(telling | F.col("feature").isin(INSULTS)).collect()
        names = spark.sparkContext.broadcast(frozenset(r["feature"] for r in found))

        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = [sorted(text_features(t) & names.value) for t in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(2), pa.array(own, pa.list_(pa.string()))], ["part", "held"])
            give_back()

        # The toxic texts' own features among those found: ``sample`` rows at most, in an order of their own.
        texts = sorted((r["part"], r["held"]) for r in rows.filter("_y = 1").mapInArrow(held, "part int, held array<string>").collect())
        model, others = lexicons([(r["feature"], [r[c] for c in PARTS[:FOLDS]], [r[c] for c in PARTS[FOLDS:]]) for r in found], pos, neg, texts)
        shared = spark.sparkContext.broadcast(others)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorers = [Scorer(m) for m in shared.value]
            for b in batches:
                x = [scorers[part].features(t).tolist() for t, part in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], ["x", "y"])
            give_back()

        seen = rows.mapInArrow(run, "x array<double>, y int").toPandas()  # ``sample`` rows at most
    seen = seen.assign(k=seen.x.map(tuple)).sort_values(["k", "y"])  # the same sums whatever the order of rows
    return fit(model, np.array(seen.x.tolist(), float), seen.y.to_numpy(float))


def scored(docs: DataFrame, model: Model, text_col: str = "text", as_col: str = "toxicity_score") -> DataFrame:
    """``docs`` with a score column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            for b in slices(whole, at, BATCH, BATCH_BYTES):
                scores = [scorer.score(t.as_py() or "") for t in b.column(at)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, as_col])
        give_back()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(as_col, T.DoubleType())]))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is under the threshold."""
    as_col = fresh(docs, "_toxicity")
    return scored(docs, train(docs, labels), as_col=as_col).filter(F.col(as_col) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    found = scored(docs.select("doc_id", "text"), model, as_col="score")
    return found.select("doc_id", (crc_text(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
