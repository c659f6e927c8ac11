"""Perplexities against a plain modified Kneser-Ney model, whatever the ids and their order; quantiles; odd inputs."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from sparloom.llm import quality

SF = "/root/testdata/sf0.01"


def units(text):
    return np.frombuffer(text.encode("utf-16-le"), "<u2").tolist()


def slow_perplexities(train, texts, order=4):
    counts = {order: Counter()}
    padded = lambda t: [0] * (order - 1) + units(t) + [1]
    for t in train:
        s = padded(t)
        counts[order].update(tuple(s[i - order + 1 : i + 1]) for i in range(order - 1, len(s)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount, total, mass = {}, {}, {}
    for k, c in counts.items():
        n = [0] + [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        discount[k] = [0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0), i) if n[i] and n[i + 1] else 0.5 * i for i in (1, 2, 3)]
        total[k], mass[k] = Counter(), Counter()
        for g, v in c.items():
            total[k][g[:-1]] += v
            mass[k][g[:-1]] += discount[k][min(v, 3)]

    def p(g):
        k, h = len(g), g[:-1]
        lower = p(g[1:]) if k > 1 else 1 / (len(counts[1]) + 1)
        if not total[k][h]:
            return lower
        v = counts[k].get(g, 0)
        return (v - discount[k][min(v, 3)]) / total[k][h] + mass[k][h] / total[k][h] * lower

    out = []
    for t in texts:
        s = padded(t)
        logs = [math.log(p(tuple(s[i - order + 1 : i + 1]))) for i in range(order - 1, len(s))]
        out.append(math.exp(-sum(logs) / len(logs)))
    return out


@pytest.mark.parametrize("kind", ["long", "string"])
def test_perplexities(spark, kind):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdé 中丁𠀀😀") for _ in range(rng.randrange(80))) for _ in range(120)]
    numbers = rng.sample(range(10**12), 120)
    ids = [n if kind == "long" else f"id {n}" for n in numbers]
    trusted = set(range(0, 120, 3))
    docs = spark.createDataFrame(list(zip(ids, texts, ["x"] * 120)), f"doc_id {kind}, text string, batch string")
    if kind == "long":
        docs = docs.repartition(7, "doc_id")
    got = quality.perplexities(docs, spark.createDataFrame([(ids[i],) for i in trusted], f"doc_id {kind}"), hold=0)
    want = slow_perplexities([texts[i] for i in trusted], texts)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert got.columns == ["doc_id", "batch", "trusted", "trained", "perplexity"] and len(rows) == 120
    for i, w in zip(ids, want):
        assert math.isclose(rows[i]["perplexity"], w, rel_tol=1e-9) and rows[i]["batch"] == "x"


def test_odd(spark, odd):
    got = quality.classify(odd, spark.createDataFrame([(2,), (5,), (None,)], "doc_id long"))
    assert got.count() == 8 and got.where("perplexity is null or keep is null or _n <> 3 or _trusted <> 1 or batch <> 'x' and batch is not null").count() == 0
    assert quality.classify(odd, spark.createDataFrame([], "doc_id long")).where("keep").count() == 8
    assert quality.classify(odd.limit(0), spark.createDataFrame([(2,)], "doc_id long")).count() == 0


def test_quality_separates(spark):
    got = quality.op8_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert got[got.quality == 1].keep.mean() > 0.97 and got[got.quality == 0].keep.mean() < 0.15
