"""Toxicity: the machine against its formula, pairs that tell only together, held-out rows, odd inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from sparloom.llm import toxicity
from sparloom.llm.words import Words

SF = "/root/testdata/sf0.01"


def slow_margin(machine, text):
    """The formula over all pairs of a text's terms."""
    _, buckets = toxicity._terms(Words([text.encode()], prefix_bytes=toxicity.PREFIXES))
    slots = [s for s in machine.slot[buckets].tolist() if s >= 0]
    pairs = sum(float(machine.factors[i] @ machine.factors[j]) for n, i in enumerate(slots) for j in slots[:n])
    return machine.bias + sum(machine.weights[s] for s in slots) + pairs


def log_loss(p, y):
    return -np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-9, 1)).mean()


@pytest.fixture(scope="module")
def flat(spark):
    """Documents of label 1 where two words match; each word alone is as frequent with either label."""
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(1600):
        words = [f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(40)]
        a, b = rng.randrange(2), rng.randrange(2)
        words += [("alpha", "gamma")[a], ("beta", "delta")[b]]
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(a == b)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(docs), dict(labels)


def test_pairs_with_flat_shares_are_learned_by_fit(flat):
    docs, labels, texts, truth = flat
    machine = toxicity.fit(docs.where("doc_id < 1200"), labels.where("doc_id < 1200"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, machine).where("doc_id >= 1200").collect()}
    y = np.array([truth[i] for i in got])
    p = np.array(list(got.values()))
    assert ((p >= 0.5) == y).mean() > 0.97
    share = np.mean([truth[i] for i in range(1200)])
    alone = [1 / (1 + math.exp(-(machine.bias + machine.weights[machine.slot[b][machine.slot[b] >= 0]].sum()))) for b in (toxicity._terms(Words([texts[i].encode()], prefix_bytes=toxicity.PREFIXES))[1] for i in got)]
    assert log_loss(p, y) < 0.2 < min(log_loss(np.array(alone), y), log_loss(np.full(len(y), share), y))
    for i in list(got)[:20]:
        assert math.isclose(got[i], 1 / (1 + math.exp(-slow_margin(machine, texts[i]))), rel_tol=1e-6)


def test_held_out(spark):
    got = toxicity.op4_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    seen, held = got[~got.held_out], got[got.held_out]
    assert (seen.predicted == seen.toxic).mean() > 0.97 and (held[held.toxic == 0].predicted == 0).mean() > 0.95


def test_odd(spark, odd):
    labels = spark.createDataFrame([(1, None, 1), (5, 7, 1), (9, 1, 1)], "doc_id long, toxic int, _id int")
    rows = toxicity.score(odd, toxicity.fit(odd, labels)).collect()
    assert len(rows) == 8 and all(r["score"] < 0.5 for r in rows)
    labels = spark.createDataFrame([(5, 1, 1), (4, 0, 1), (2, 0, 1), (7, 0, 1)], "doc_id long, toxic int, _id int")
    machine = toxicity.fit(odd, labels)
    kept = toxicity.drop_toxic(odd, machine)
    assert kept.columns == odd.columns and kept.where("_score = 0.9 and _label = 9 and score = 0.1").count() == kept.count() > 0
    assert toxicity.score(odd.limit(0), machine).count() == toxicity.drop_toxic(odd.limit(0), machine).count() == 0
    none = toxicity.fit(odd.limit(0), labels.limit(0))
    assert toxicity.score(odd, none).agg(F.max("score")).first()[0] < 0.01
