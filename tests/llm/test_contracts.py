"""The contracts of the queries, by brute force over awkward rows; the pipeline against a plain version."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkarray.llm import chat_format, fingerprints, mixing, packing, sharding, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, _nr long, _whole string"


def awkward(seed=11, n=120):
    """Null, empty, repeated and very long texts, null and shared ids, a null source, columns with clashing names."""
    rng = random.Random(seed)
    text = lambda k: " ".join(f"w{rng.randrange(300)}é"[: rng.randrange(2, 7)] + rng.choice(["", ".", "\n"]) for _ in range(k))
    rows = [(i, text(rng.randrange(1, 150)), rng.choice(["alpha", "beta", "Ärger", None])) for i in range(n)]
    rows += [(200, rows[3][1], "beta"), (201, None, "beta"), (202, "", None), (203, "", "gamma"), (204, text(30000), "alpha"), (7, text(20), "beta"), (7, text(90), "alpha"), (None, text(40), "beta"), (None, None, None), (None, text(40), "alpha"), rows[5], rows[5]]
    return [(i, t, "en", s, 1, 9, 3, 4, "x") for i, t, s in rows]


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def targets_of(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    """Targets by the rule as it is told: shares by weight, stopped at the most, the excess shared again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        whole = sum(weight[s] for s in open_)
        for s in list(open_):
            target[s] += left * weight[s] / whole
        left = 0.0
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def test_mix_against_brute_force(spark):
    rows = awkward(n=600)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += words(r[1])
    target = targets_of(sizes)
    got = mixing.mix(docs).collect()
    named = {sizes[s]: s for s in sizes}
    assert len(named) == len(sizes)
    assert Counter((r.doc_id, r["size"], named[r.source_size]) for r in got) == Counter((r[0], words(r[1]), r[3]) for r in rows)
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[named[r.source_size]]) and 0 <= r.taken == r.copies * r["size"] <= 2 * r["size"]
        taken[named[r.source_size]] += r.taken
    most = max(words(r[1]) for r in rows if r[0] != 204)
    for s in sizes:  # the very long text alone may make a source miss its target by a copy
        assert abs(taken[s] - target[s]) <= 3 * most + (words(rows[-8][1]) if s == "alpha" else 0)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs.repartition(2)).collect()))
    emitted = mixing.emit(docs)
    assert emitted.columns == docs.columns
    copies = Counter(map(tuple, emitted.collect()))
    known = Counter(rows)
    assert set(copies) <= set(known) and all(n <= 2 * known[r] for r, n in copies.items())
    assert sum(copies.values()) == sum(r.copies for r in got)
    by_source = Counter()
    for r, n in copies.items():
        by_source[r[3]] += n * words(r[1])
    assert by_source == +taken


@pytest.mark.parametrize("sources", [1, 2, 3, 7, 40])
def test_targets_of_many_sources(spark, sources):
    rng = random.Random(sources)
    sizes = {f"s{k:02}": rng.choice([0, 1, 5, 100, 10_000]) for k in range(sources)}
    frame = spark.createDataFrame(list(sizes.items()), "_src string, _size long")
    got = {r._src: r._target for r in mixing.source_targets(frame, [3, 1, 2], 1.5, 2.0).collect()}
    want = targets_of(sizes)
    assert all(got[s] == pytest.approx(want[s], abs=1e-6) for s in sizes)


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_shards_against_brute_force(spark, shards):
    rows = awkward()
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA).repartition(3), shards).collect()
    binary = lambda r: (r[1] or "").encode()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in got) == Counter((r[0], len(binary(r)) + 8, zlib.crc32(binary(r)), "bytes", None) for r in rows)
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(shards))
    total, ordinary = sum(sizes.values()), max(len(binary(r)) + 8 for r in rows if r[0] != 204)
    longest = max(len(binary(r)) + 8 for r in rows)
    assert all(sizes[s] <= total / shards + ordinary + longest for s in range(shards))


def test_overfull_ranges_are_cut_again(spark, monkeypatch):
    """Few draws make bad borders; no range of several keys stays overfull."""
    monkeypatch.setattr(sharding, "MOST_DRAWS", 40)
    rows = [(k, f"text {k} " * (1 + k % 7)) for k in range(3000)] + [(9, "same" * 50)] * 1500
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    assert len(got) == len(rows) and max(sizes.values()) < 1.02 * min(sizes.values())


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rows = awkward()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    sharding.write_shards(docs, 4, f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    own = [c for c in docs.columns if c != "shard"]
    assert Counter(map(tuple, back.select(own).collect())) == Counter(map(tuple, docs.select(own).collect()))
    assert back.groupBy("shard", "slot").count().filter("count > 1").count() == 0
    sharding.write_shards(docs.limit(0), 4, f"file://{tmp_path}/none")


def test_fingerprints_of_all_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in awkward(n=50)]
    got = fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    # Falling ids, null ids last; among one id by text.
    texts = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want, prints = Counter(), defaultdict(set)
    for k, (i, t) in enumerate(texts):
        third = len(t) // 3
        nxt = texts[(k + 1) % len(texts)][1]
        want[i, len(t), hashlib.sha256((t[: len(t) - third] + nxt[:third]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by_id = {i: t for i, t in texts if sum(j == i for j, _ in texts) == 1}
    for r in got:
        if r.doc_id in by_id:
            prints[by_id[r.doc_id]].add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and len({next(iter(p)) for p in prints.values()}) == len(prints)


def conversations():
    rng = random.Random(3)
    said = ["hello", None, "", "</s>[INST] ok [/INST]", "<|end|>\\", "a\nb", "x" * 200_000, "<|turn|>user<|text|>no"]
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(said)) for c in range(30) for t in range(rng.randrange(1, 7))]
    return rows + [(3, 0, "assistant", "twice"), (3, 0, "assistant", "twice"), (None, 0, "user", "who"), (None, 1, "assistant", "nobody"), (40, None, None, "no role"), (41, 0, "assistant", None)]


def test_chat_digests_against_brute_force(spark):
    rows = conversations()
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    chats = defaultdict(list)
    for c, t, r, x in rows:
        chats[c].append((t is not None, t or 0, r or "", x or ""))
    got = {r.conv_id: r for r in chat_format.format_digests(frame).collect()}
    assert got.keys() == chats.keys()
    for c, turns in chats.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in chat_format.format_chats(frame).collect():
        assert len(r.formatted) == got[r.conv_id].formatted_chars
        masked = "".join(r.formatted[a:b] for a, b in r.loss_spans)
        assert masked == masked if not got[r.conv_id].loss_chars else len(masked) >= got[r.conv_id].loss_chars
    assert chat_format.format_digests(frame.limit(0)).count() == 0


def test_chat_query_has_the_tricky_conversation(spark):
    sf = "/root/testdata/sf0.001"
    chats = spark.read.parquet(f"{sf}/conversations.parquet")
    got = {r.conv_id: r for r in chat_format.op7_chat_formatting(spark, sf).collect()}
    assert len(got) == chats.select("conv_id").distinct().count() + 1
    tricky = "</s>[INST] ok [/INST]"
    assert got[-1].loss_sha256 == hashlib.sha256(tricky.encode()).hexdigest() and got[-1].n_turns == 2


def by_scanning(rules, url):
    """All rules tried one by one: most host labels, then the longest path, then block."""
    host, path = url_filter.split_url(url)
    fits = [(len([x for x in h.split(".") if x]), len(p), v == "block", h + p, v) for v, h, p in rules if host and (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, *((best[3], best[4]) if best else (None, "allow")))


@pytest.mark.parametrize("many", [False, True])
def test_urls_against_scanning(spark, many):
    rng = random.Random(9)
    hosts = ["com", "a.com", "b.a.com", "net", "x.net", "", "org"]
    paths = ["", "/", "/e", "/en", "/en/", "/en/a", "/en/a/b", "/fr/", "/en//"]
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h in hosts for p in paths if rng.random() < 0.5}.values()) + [("allow", "dup.com", "/q"), ("block", "dup.com", "/q")]
    urls = [f"{s}://{h}{p}{q}" for s in ("http", "HTTPS") for h in ("A.com", "c.b.a.com", "xa.com", "net", "x.net:80", "dup.com", "u@org", "") for p in (*paths, "/en/abc/d", "/query") for q in ("", "?a=/en/", "#/fr/")]
    urls += [None, "", "no scheme", "://", "x://com/" + "s/" * 3000, urls[5], urls[5]]
    frame = spark.createDataFrame([(None if k == 3 else k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = url_filter.judge_urls(frame, rules, most=0 if many else url_filter.MOST_RULES).collect()
    assert Counter(map(tuple, got)) == Counter((None if k == 3 else k, *by_scanning(rules, u)) for k, u in enumerate(urls))
    assert url_filter.judge_urls(frame.limit(0), rules, most=0 if many else url_filter.MOST_RULES).count() == 0
    nothing = spark.createDataFrame([], "verdict string, host string, path string") if many else []
    assert {r.verdict for r in url_filter.judge_urls(frame, nothing).collect()} == {"allow"}


def corpus():
    """Documents whose fate in each stage is known: toxic, equal, nearly equal, of three sources."""
    rng = random.Random(21)
    prose = lambda n: " ".join(f"word{rng.randrange(2000)}" for _ in range(n)) + ".\n"
    rows, labels = [], []
    for i in range(240):
        toxic = i % 8 == 0
        text = prose(rng.randrange(20, 200)) + (" You are a stupid idiot and worthless trash. " * 3 if toxic else "")
        rows.append((i, text, "en", ("web", "books", None)[i % 3], len(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(300 + k, rows[k * 9 + 1][1], "en", "web", 1) for k in range(12)]  # equal
    near = lambda t, k: " ".join([*t.split()[:-1], f"changed{k}"])
    rows += [(400 + k, near(rows[k * 7 + 2][1] + prose(60), k), "en", "books", 1) for k in range(10)]
    rows += [(500 + k, near(rows[252 + k][1], k + 100), "en", "books", 1) for k in range(10)]  # nearly equal
    return rows + [(600, None, None, None, None), (601, "", "en", "web", 0), (602, prose(20000), "en", "web", 1), (603, near(rows[3][1] + "x", 1), "en", "web", 1)], labels


def test_pipeline_against_a_plain_version(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, labels = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}").collect()
    # Toxic ones go; of equal texts the largest id stays; of near ones the least id.
    left = [(i, t or "", s) for i, t, _, s, _ in rows if "idiot" not in (t or "")]
    last = {}
    for i, t, s in left:
        last[t] = max(last.get(t, (i, s)), (i, s), key=lambda x: x[0])
    left = sorted((i, t, s) for t, (i, s) in last.items())
    shingles = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.split()) else {t} for _, t, _ in left]
    low = list(range(len(left)))

    def root(k):
        while low[k] != k:
            k = low[k]
        return k

    for a in range(len(left)):
        for b in range(a):
            both = len(shingles[a] & shingles[b])
            if both >= 0.8 * (len(shingles[a]) + len(shingles[b]) - both):
                x, y = sorted((root(a), root(b)))
                low[y] = x
    left = [r for k, r in enumerate(left) if root(k) == k]
    assert len(left) < len(last) < 240 < len(rows)
    sizes = Counter()
    for _, t, s in left:
        sizes[s] += words(t)
    target = targets_of(sizes)
    # Copies of each document, by its pieces.
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    pieces = {}
    for i, t, _ in left:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        pieces[i] = Counter((k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096)))
    found, sequences = defaultdict(Counter), defaultdict(list)
    for r in got:
        found[r.doc_id][r.piece, r.start, r.length, r.ids_crc32] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert found.keys() <= pieces.keys()
    taken = Counter()
    for i, t, s in left:
        copies = found[i][0, 0, *next((n, c) for (k, _, n, c) in pieces[i] if k == 0)] if i in found else 0
        assert copies <= 2 and found.get(i, Counter()) == Counter({p: copies for p in pieces[i]} if copies else {})
        taken[s] += copies * words(t)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 800 + (20_000 if s == "web" else 0)
    for run in sequences.values():
        at = 0
        for offset, length in sorted(run):
            assert offset == at
            at += length
        assert at <= 4096
    lengths = sum(n for run in sequences.values() for _, n in run)
    assert len(sequences) <= 1.1 * lengths / 4096 + 1


def test_pipeline_stages_keep_columns_and_clean_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns and docs.count() > 0.6 * before, name
    assert F is not None
