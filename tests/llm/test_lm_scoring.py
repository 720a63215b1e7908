"""The n-gram trie and LM scoring against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkarray.llm import lm_scoring
from sparkarray.llm.elias_fano import EliasFano, Trie, map_shared, write_shared


@pytest.mark.parametrize("kind", ["spread", "dense", "close to 2^64", "zero", "largest", "none", "every"])
def test_sequences_select_and_find(kind):
    rng = np.random.default_rng(1)
    values = {
        "spread": rng.integers(0, 1 << 62, 5000, dtype=np.uint64),
        "dense": rng.integers(0, 50, 5000, dtype=np.uint64),
        "close to 2^64": rng.integers((1 << 64) - 100, (1 << 64) - 1, 3, dtype=np.uint64),
        "zero": np.zeros(1, np.uint64),
        "largest": np.array([(1 << 64) - 1], np.uint64),
        "none": np.empty(0, np.uint64),
        "every": np.arange(1000, dtype=np.uint64),
    }[kind]
    values = np.sort(values)
    coded = EliasFano(*EliasFano.build(values))
    assert not len(values) or (coded.get(np.arange(len(values))) == values).all()
    asked = np.concatenate([values, values + np.uint64(1), rng.integers(0, 1 << 63, 500, dtype=np.uint64)])
    for x, k in zip(asked.tolist(), coded.find(asked).tolist(), strict=True):
        assert (k >= 0) == (x in set(values.tolist())) and (k < 0 or values[k] == x)


def test_trie_in_a_file(tmp_path):
    rng = np.random.default_rng(2)
    counts = Counter(zip(rng.zipf(1.4, 20000).clip(1, 300).tolist(), rng.integers(0, 4000, 20000).tolist(), strict=True))
    keys = sorted(counts)
    context, word, count = (np.array(x) for x in zip(*[(c, w, counts[c, w]) for c, w in keys], strict=True))
    write_shared(f"file://{tmp_path}/a/0.trie", Trie.build(context.astype(np.uint64), word.astype(np.uint32), count))
    trie = Trie(map_shared(f"file://{tmp_path}/a/0.trie"))
    asked = [(c, w) for c in (*sorted({c for c, _ in keys}), 5000) for w in range(0, 4000, 7)]
    contexts, lens = np.unique([c for c, _ in asked], return_counts=True)
    n, t, codes = trie.look(contexts.astype(np.uint64), lens, np.array([w for _, w in asked], np.uint32))
    for k, c in enumerate(contexts.tolist()):
        own = {w: m for (x, w), m in counts.items() if x == c}
        assert (n[k], t[k]) == (sum(own.values()), len(own))
        for (_, w), code in zip(asked[k * len(range(0, 4000, 7)) :], codes[k * len(range(0, 4000, 7)) : (k + 1) * len(range(0, 4000, 7))].tolist(), strict=False):
            assert (code > 0) == (w in own)
            assert not code or abs(-(code - 1) * trie.step - math.log2(own[w] / (n[k] + t[k]))) <= trie.step / 2 + 1e-9


def tokens_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})), None]


def brute_force(rows, training):
    tokens = [(i, tokens_of(t)) for i, t in rows]
    train = [ws for i, ws in tokens if training(i)]
    seen, pairs = Counter(w for ws in train for w in ws), Counter(p for ws in train for p in zip([None, *ws[:-1]], ws, strict=True))
    follow = Counter(v for v, _ in pairs)
    n, v = sum(seen.values()), len(seen)
    taken = (sum(c == 1 for c in seen.values()) + 0.5) / (v + 1)
    p0 = lambda w: 1.0 if not n else (seen[w] - taken) / n if seen[w] else taken * v / n
    p = lambda a, w: (pairs[a, w] + follow[a] * p0(w)) / (seen[a] + follow[a]) if seen[a] else p0(w)
    return Counter((i, len(ws), sum(seen[w] > 0 for w in ws), n, round(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens), {
        (i, len(ws)): sum(math.log10(p(a, w)) for a, w in zip([None, *ws[:-1]], ws, strict=True)) for i, ws in tokens
    }


def awkward():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    text = lambda n: " ".join(rng.choices(words, [1 / (k + 1) for k in range(300)], k=n))
    rows = [(i, text(rng.randrange(1, 90)) + (" new" if i % 5 == 0 else "")) for i in range(60)]
    return [*rows, (60, None), (61, ""), (62, " \n\t "), (63, text(20000)), (64, "ONE Two\x0btwo x"), rows[3], rows[3], (7, text(31)), (None, text(17)), (None, None), (None, text(23))]


@pytest.mark.parametrize("shard_bytes", [lm_scoring.SHARD_BYTES, 4000])
@pytest.mark.parametrize("training", ["i IS NOT NULL AND i % 5 <> 0", "true", "false", "i"])
def test_scores_against_brute_force(spark, shard_bytes, training):
    """One shard and many (borders cut the frequent contexts); part of the rows, all or none train, a null condition does not."""
    rows = awkward()
    frame = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "i long, text string, _id string, _text double").repartition(3)
    holds = {"true": lambda i: True, "false": lambda i: False, "i": lambda i: i is not None and i != 0}.get(training, lambda i: i is not None and i % 5 != 0)
    exact, scores = brute_force(rows, holds)
    condition = F.col("i") != 0 if training == "i" else F.expr(training)
    got = lm_scoring.train_and_score(frame, condition, "i", shard_bytes=shard_bytes).collect()
    assert Counter((r.i, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == exact
    for r in got:
        assert r.score == pytest.approx(scores[r.i, r.n_tokens], abs=0.02 * r.n_tokens)


def test_a_model_scores_other_texts(spark):
    seen = spark.createDataFrame([(1, "a b c a b"), (2, "b c")], "doc_id long, text string")
    model = lm_scoring.train(seen)
    got = {r.doc_id: r for r in lm_scoring.score(spark.createDataFrame([(7, "a b"), (8, "c a"), (9, "zz zz")], "doc_id long, text string"), model).collect()}
    _, want = brute_force([(1, "a b c a b"), (2, "b c"), (7, "a b"), (8, "c a"), (9, "zz zz")], lambda i: i < 3)
    assert all(r.score == pytest.approx(want[i, 3], abs=0.05) for i, r in got.items())
    assert got[7].score > got[8].score > got[9].score


def test_borders_cut_a_frequent_context():
    borders = lm_scoring.Borders(np.array([5, 9, 9, 9, 12], np.uint64), np.array([3, 0, 10, 20, 0], np.uint32))
    context, word = np.array([1, 5, 5, 9, 9, 9, 9, 10, 12], np.uint64), np.array([0, 2, 3, 0, 9, 10, 25, 0, 5], np.uint32)
    assert borders.of(context, word).tolist() == [sum((b, w0) <= (c, w) for b, w0 in zip(borders.context.tolist(), borders.word.tolist(), strict=True)) for c, w in zip(context.tolist(), word.tolist(), strict=True)]


def test_held_out_texts_are_likelier_than_by_the_base(spark):
    got = lm_scoring.op9_lm_scoring(spark, "/root/testdata/sf0.01").filter("held_out").collect()
    assert sum(r.score > r.base_score for r in got) >= 0.9 * len(got)
