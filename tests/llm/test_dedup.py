"""Exact and near deduplication: identity of rows, clashes, ties, other columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkarray.llm import exact_dedup, near_dedup

SCHEMA = "doc_id long, text string, lang string, _id string, _sha string, _row long, _best string, _near_own string, _dedup_own string"


def texts(n, rng, k=40):
    return " ".join(f"w{rng.randrange(n)}" for _ in range(k))


def table_of(rows):
    return [(i, t, lang, *["x"] * 2, 7, *["y"] * 3) for i, t, lang in rows]


def identities():
    """Different texts under one id, null ids, repeated rows, rows that differ in another column only, near copies."""
    rng = random.Random(6)
    a, b, c = (texts(500, rng) for _ in range(3))
    near = " ".join([*a.split()[:-1], "other"])
    long = texts(3000, rng, 30000)
    rows = [(1, a, "en"), (1, b, "en"), (1, b, "fr"), (2, near, "en"), (None, a, "en"), (None, c, "en"), (None, c, "en"), (None, None, "en"), (3, "", "en"), (4, None, "de"), (4, None, "de"), (5, long, "en"), (6, long + " end", "en"), (7, long, "en"), (8, "two words", None), (9, "two  words", None), (10, " \n ", "en")]
    return rows + [(20 + k, c, "en") for k in range(40)] + [(77, b, "en")] * 30


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else {text or ""}


def by_brute_force(rows):
    """The class number of each row."""
    distinct = sorted({t or "" for _, t, _ in rows})
    sets, low = [shingles(t) for t in distinct], list(range(len(distinct)))

    def root(k):
        while low[k] != k:
            k = low[k]
        return k

    for a in range(len(distinct)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                low[y] = x
    return [root(distinct.index(t or "")) for _, t, _ in rows]


def test_near_classes_of_shared_and_missing_ids(spark):
    rows = identities()
    got = near_dedup.classes(spark.createDataFrame(table_of(rows), SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    want, members = defaultdict(list), defaultdict(list)
    for (i, t, _), k in zip(rows, by_brute_force(rows), strict=True):
        want[k].append((i, hashlib.sha256((t or "").encode()).hexdigest()))
    for r in got:
        members[r.class_id].append((r.doc_id, r.text_sha256))
    assert sorted(map(lambda m: sorted(m, key=str), members.values()), key=str) == sorted(map(lambda m: sorted(m, key=str), want.values()), key=str)
    assert sum(r.kept for r in got) == len(want)
    for name, m in members.items():
        ids = [i for i, _ in m if i is not None]
        assert name < 0 or name == min(ids)


@pytest.mark.parametrize("keep", [near_dedup.keep, exact_dedup.keep])
def test_kept_rows_are_input_rows(spark, keep):
    rows = identities()
    frame = spark.createDataFrame(table_of(rows), SCHEMA)
    got = [keep(frame.repartition(n)).collect() for n in (1, 5)]
    assert Counter(got[0]) == Counter(got[1])  # ties by content, not by arrival
    assert got[0][0].__fields__ == frame.columns
    classes = by_brute_force(rows) if keep is near_dedup.keep else [t or "" for _, t, _ in rows]
    assert len(got[0]) == len(set(classes)) and not Counter(got[0]) - Counter(map(tuple, table_of(rows)))
    of = {t or "": k for (_, t, _), k in zip(rows, classes, strict=True)}
    assert {of[r.text or ""] for r in got[0]} == set(classes)
    first = min if keep is near_dedup.keep else max
    for r in got[0]:
        ids = [i for (i, _, _), k in zip(rows, classes, strict=True) if k == of[r.text or ""] and i is not None]
        assert r.doc_id == first(ids, default=None)


@pytest.mark.parametrize("bits", [0, 3, 64])
def test_recipes_decide_even_if_names_clash(spark, bits):
    """With names of few bits almost all chunks clash; groups are the same."""
    rows = identities()
    name = F.xxhash64 if bits == 64 else lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    got = exact_dedup.groups(spark.createDataFrame(table_of(rows), SCHEMA), key=name).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    for r in got:
        own = groups[r.text_sha256]
        assert (r.group_size, r.keep_id) == (len(own), max((i for i in own if i is not None), default=None))


def test_a_bucket_of_many_classes(spark, monkeypatch):
    """Few leaders a round, so that buckets of many classes go on for several rounds."""
    monkeypatch.setattr(near_dedup, "LEADERS", 2)
    rng, base = random.Random(12), [f"w{k}" for k in range(100)]
    rows = []
    for i in range(70):
        words = list(base)
        for k in rng.sample(range(100), rng.randrange(1, 6)):
            words[k] = f"y{rng.randrange(4)}"
        rows.append((i, " ".join(words), "en"))
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(table_of(rows), SCHEMA)).collect()}
    classes = by_brute_force(rows)
    assert got == {i: min(j for j, k in enumerate(classes) if k == classes[i]) for i in range(70)}
