"""Toxicity: the cascade of transducers, learning, held-out accuracy, awkward rows."""

import zlib

import pytest

from sparkarray.llm import toxicity
from sparkarray.llm.toxicity import INSULT, MODAL, NEGATION, OTHER, REPORT, TARGET, THREAT


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def one_by_one(machines, symbols):
    """Each machine over the whole output of the one before: what a composition must equal."""
    weights = [1.0] * len(symbols)
    state = 0
    for machine in machines:
        state, out = 0, []
        for k, c in enumerate(symbols):
            state, written, w = machine.get((state, c), (state, c, 1.0))
            out.append(written)
            weights[k] *= w
        symbols = out
    return state, weights


@pytest.mark.parametrize("seed", range(5))
def test_composition_equals_the_machines_in_turn(seed):
    import random

    rng, cascade = random.Random(seed), toxicity.Cascade()
    for _ in range(200):
        symbols = rng.choices([INSULT, THREAT, MODAL, TARGET, NEGATION, REPORT, OTHER], k=rng.randrange(9))
        own = [rng.random() for _ in symbols]
        state, weights = one_by_one(toxicity.MACHINES, list(symbols))
        kind, total = cascade.clause(list(zip(symbols, own, strict=True)))
        assert kind == state - 1 and total == pytest.approx(sum(a * b for a, b in zip(own, weights, strict=True)))


def test_clauses():
    scorer = toxicity.Scorer(toxicity.Model({"idiot": 3.0}, {"zork": (3.0, 1), "blub": (3.0, 2)}))
    score = scorer.score
    kinds = lambda t: [toxicity.KINDS[k] for k in range(5) if scorer.features(t)[k]]
    assert score("") < 0.5 and score("a fine day") == score("")
    assert score("you are an idiot") > score("he said you are an idiot") > score("")
    assert score("you are an idiot") > score("you are not an idiot")
    assert kinds("an idiot") == ["plain"] and kinds("you idiot") == ["targeted"] and kinds("idiot, you") == ["targeted"]
    assert kinds("I will kill you") == ["threat"] and kinds("kill you") == ["threat"] and not kinds("they kill time") and not kinds("kill the light")
    assert kinds("not an idiot") == ["negated"] and kinds("he said idiot") == ["reported"] and kinds("he said not an idiot") == ["negated"]
    assert kinds("not one of these many fools, an idiot") == ["targeted"]  # the negation does not reach that far
    assert scorer.features("zorkling").any() and not scorer.features("azork").any() and not scorer.features("we will see you").any()
    assert not scorer.features("blubber blubber").any() and scorer.features("blubber blubbing").any()


def rows_of(n):
    """Toxic texts of three families, one of them rare; others share words with them."""
    rows, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        family = "snarl" if i % 30 == 0 else ("grump", "fribb")[i % 2]
        text = f"alpha beta w{i % 17} gamma." + (f" you {family}{'abcdefg'[i % 7]}t and {family}{'hijklmn'[i % 7]}s!" if toxic else f" fine {'xyz'[i % 3]} day")
        rows.append((i, text))
        labels.append((i, 0, int(toxic)))
    return rows, labels


def test_learns_every_family_and_not_from_held_out_rows(spark):
    rows, labels = rows_of(600)
    labels = [(i, q, t if not held_out(i) else 1 - t) for i, q, t in labels]  # held-out labels are wrong: they must not matter
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, table)
    got = {r.doc_id: r.s for r in toxicity.scored(docs, model, as_col="s").collect()}
    assert all((got[i] >= 0.5) == (i % 3 == 0) for i in got)
    again = toxicity.train(docs.repartition(5), table.repartition(2))
    assert (again.words, again.prefixes, again.bias) == (model.words, model.prefixes, model.bias)


def test_sample_is_a_bound(spark):
    rows, labels = rows_of(300)
    docs = spark.createDataFrame([*rows, *[(7, f"other text {k} under a shared id") for k in range(500)]], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), sample=100)
    assert isinstance(model, toxicity.Model)


def test_awkward_rows(spark):
    rows, labels = rows_of(200)
    awkward = [(1000, None), (1001, ""), (1002, " \n"), (None, "you grumpat and grumpbs!"), (1003, "a b " * 50_000 + " you grumpat and grumpbs!"), rows[0], rows[0], (1004, "you grumpat and grumpbs!\x00 \ud7ff")]
    docs = spark.createDataFrame([(*r, "x", 0.5) for r in rows + awkward], "doc_id long, text string, _toxicity string, score double")
    table = spark.createDataFrame([*labels, (1000, None, None), (None, 1, 1), (0, 0, 1), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    kept = toxicity.keep_clean(docs, table)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    assert texts.count(None) == 1 and "" in texts and " \n" in texts and not any("grump" in (t or "") for t in texts)
    scores = {r.text: r.s for r in toxicity.scored(docs, toxicity.train(docs, table), as_col="s").collect()}
    assert scores[None] == scores[""] == scores[" \n"] < 0.5
    for nothing in (table.limit(0), table.filter("toxic = 0")):
        assert toxicity.keep_clean(docs, nothing).count() == docs.count()
    assert toxicity.keep_clean(docs.limit(0), table).count() == 0


@pytest.mark.parametrize("sf, least", [("sf0.01", 0.9), ("sf0.1", 0.95)])
def test_held_out_accuracy(spark, sf, least):
    path = f"/root/testdata/{sf}"
    got = toxicity.op4_toxicity(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").filter("held_out AND toxic IS NOT NULL").collect()
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    a, b = ([r.score for r in got if r.toxic == y] for y in (1, 0))
    assert sum((x > y) + 0.5 * (x == y) for x in a for y in b) / (len(a) * len(b)) >= least
    assert sum(y >= 0.5 for y in b) <= 0.01 * len(b) + 1
