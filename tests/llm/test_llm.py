"""The training-data operators against brute force, on small and awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkarray.llm import _text, chat_format, exact_dedup, fingerprints, lm_scoring, mixing, near_dedup, packing, sharding, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, _id string"
RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdeéñ") for _ in range(RNG.randrange(2, 8))) for _ in range(400)]


def prose(n, rng):
    return "".join(rng.choice(VOCABULARY) + rng.choice([" ", " ", " ", ". ", "\n", ", "]) for _ in range(n))


def awkward():
    rng = random.Random(11)
    rows = [(i, prose(rng.randrange(1, 160), rng), "en", rng.choice(["a", "b", None]), 1, 9, "x") for i in range(60)]
    words = rows[3][1].split(" ")
    near = " ".join([*words[:-1], "changed"])
    rows += [(100, rows[3][1], None, "a", None, None, None), (101, near, "en", "b", 1, 1, "y"), (102, None, None, None, None, None, None), (103, "", "en", "a", 0, 0, ""), (104, "", "en", "a", 0, 0, ""), (105, prose(9000, rng), "en", "b", 1, 1, "z"), (106, "\n \t ", "en", "c", 1, 1, ""), (None, "text without an id", "en", "a", 1, 1, "")]
    return rows + [rows[7], rows[7]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for found in (mixing.mix(nothing), sharding.shard(nothing, 4), fingerprints.fingerprint(nothing), toxicity.keep_clean(nothing, labels), packing.pack(nothing, packing.tokenizer_path()), near_dedup.classes(nothing), exact_dedup.groups(nothing), lm_scoring.train_and_score(nothing, F.lit(True)), mixing.emit(nothing), near_dedup.keep(nothing), exact_dedup.keep(nothing)):
        assert found.count() == 0


def test_exact_groups(docs):
    got = exact_dedup.groups(docs).collect()
    groups = defaultdict(list)
    for r in awkward():
        groups[r[1] or ""].append(r[0])
    assert sum(r.kept for r in got) == len(groups) and len(got) == len(awkward())
    for r in got:
        own = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(own) and r.keep_id == max((x for x in own if x is not None), default=None)
    assert exact_dedup.keep(docs).count() == len(groups)


def test_fingerprints_against_sets(spark):
    rows = [(i, t) for i, t in enumerate([r[1] for r in awkward()][:40] + ["", "one"])]
    got = {r.doc_id: r for r in fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = [(i, t or "") for i, t in rows][::-1]
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    for k, (i, t) in enumerate(texts):
        nxt = texts[(k + 1) % len(texts)][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        sets = [set(re.findall(fingerprints.PARAGRAPH, x)) for x in (t, edited, nxt)]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].near_edited == pytest.approx(like(sets[0], sets[1])) and got[i].near_next == pytest.approx(like(sets[0], sets[2]))


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for r in awkward():
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((r[0], k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096)))
    got = packing.pack(docs, packing.tokenizer_path()).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for rows in by.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 4096


def test_encoder_forgets_words_and_stays_right(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHE", 40)
    rng, path = random.Random(7), packing.tokenizer_path()
    encode, tokenizer = packing.Encoder(path), Tokenizer.from_file(path)
    for _ in range(30):
        texts = [prose(rng.randrange(0, 60), rng) for _ in range(4)]
        for text, ids in zip(texts, encode(pa.array(texts)), strict=True):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_plan_is_near_the_bound():
    rng = random.Random(2)
    histogram = Counter(min(4096, int(rng.lognormvariate(6.5, 1)) + 1) for _ in range(5000))
    runs, placed = packing.plan(dict(histogram))
    assert placed >= 0.5 * sum(n for k, n in histogram.items() if k < 4096)
    assert Counter({k: n for k, n in histogram.items()}) == sum((Counter({k: n * c for k, c in Counter(ls).items()}) for ls, n in runs), Counter())
    assert sum(n for _, n in runs) <= 1.02 * (sum(k * n for k, n in histogram.items()) / 4096) + 1


def test_near_classes_against_all_pairs(spark):
    rng = random.Random(4)
    base = [prose(120, rng).split() for _ in range(8)]
    rows = []
    for i in range(120):
        words = list(base[i % 8])
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(len(words))] = rng.choice(VOCABULARY) + "x"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [{tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    root = list(range(120))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(120):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in range(120)}


def test_near_classes_of_awkward_rows(docs):
    got = near_dedup.classes(docs).collect()
    assert len(got) == len(awkward())
    named = {r.doc_id: r.class_id for r in got}
    assert named[100] == named[3] == 3 and named[102] == named[103] == named[104]


def test_template_round_trip():
    render = chat_format.compile_template(chat_format.TEMPLATE)
    texts = ["</s>[INST] ok [/INST]", "a\\b<|end|>", "", "<\\|turn|>", "<|turn|>user<|text|>x<|end|>"]
    turns = [{"role": r, "text": t} for t in texts for r in ("user", "assistant")]
    back = list(chat_format.read_turns(render({"turns": turns})))
    assert [(r, t) for r, t, _ in back] == [(x["role"], x["text"]) for x in turns]
    assert [m for r, _, m in back] == [x["text"] if x["role"] == "assistant" else "" for x in turns]
    assert chat_format.fold(chat_format.parse("a{{ 'b' + 'c' }}{% if 'x' == 'y' %}no{% else %}d{% endif %}")) == [("text", "abcd")]
    for bad in ("{{ x.__class__ }}", "{{ open('f') }}", "{% for x in y %}", "{{ x | nothing }}"):
        with pytest.raises(chat_format.TemplateError):
            chat_format.parse(bad)


def test_urls():
    trie = url_filter.UrlTrie(url_filter.RULES)
    for url, want in (("http://a.example.com/en/1", ("example.com/en/", "block")), ("http://www.example.com/en/", ("www.example.com/en/", "allow")), ("http://x.net/es/?q", ("net/es/", "block")), ("http://net/fr", (None, "allow")), ("http://EXAMPLE.com", (None, "allow"))):
        assert trie.judge(*url_filter.split_url(url)) == want
    assert url_filter.split_url(None) == url_filter.split_url("no host") == ("", "")


def test_near_classes_of_variants_without_their_base(spark):
    """Many texts a few words off one unseen base: links between some pairs only, against brute force."""
    rng, base = random.Random(3), [f"w{k}" for k in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for k in rng.sample(range(0, 120, 8), 1 + i % 3):
            words[k] = f"x{rng.randrange(6)}"
        rows.append((i, " ".join(words)))
    runs = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    low = {i: i for i in runs}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a in runs:
        for b in range(a):
            if len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b]):
                x, y = sorted((root(a), root(b)))
                low[y] = x
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: root(i) for i in runs}


def test_slices_hold_all_rows_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 5, None, "", "y" * 50, "z" * 3, "w" * 10, None])], ["t"])
    for part in (batch, batch.slice(2), batch.slice(0, 0)):
        found = list(_text.slices(part, 0, 3, 10))
        assert [v for b in found for v in b.column(0).to_pylist()] == part.column(0).to_pylist()
        assert all(b.num_rows == 1 or b.num_rows <= 3 and sum(len(v or "") for v in b.column(0).to_pylist()) <= 10 for b in found)


def test_near_classes_of_texts_that_differ_in_repeats():
    """Sets of shingles nearly equal, but one text repeats its last line often: some band agrees."""
    rows = []
    for i in range(16):
        intro, line = " ".join(f"i{i}x{k}" for k in range(40)), " ".join(f"l{i}x{k}" for k in range(15))
        rows += [(f"{intro} {line}"), (" ".join([intro, *[line] * 200]))]
    runs = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in rows)]
    assert all(len(a & b) >= 0.8 * len(a | b) for a, b in zip(runs[::2], runs[1::2], strict=True))
    batch = pa.RecordBatch.from_arrays([pa.array(range(32)), pa.array(rows), pa.array([""] * 32)], ["_id", "_text", "_sha"])
    keys = [set(k) for b in near_dedup._signed(iter([batch])) for k in b.column(3).to_pylist()]
    assert all(a & b for a, b in zip(keys[::2], keys[1::2], strict=True))
