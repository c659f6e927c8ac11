"""Folds, table functions, hooks, interval joins, clusters and searches against plain versions."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from sparloom.functions import tables
from sparloom.operators import clusters, folds, hooks, intervals, tpe
from sparloom.plans import custom
from sparloom.streaming import runs as streams


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_folds_of_a_skewed_table(spark, monkeypatch):
    rows = [("hot", float(i % 7)) for i in range(3000)] + [(f"k{i}", float(i)) for i in range(300)] + [(None, 1.0), (None, None), ("none", None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "key string, value double").repartition(6)
    got = {r.key: r.value for r in folds.aggregate(df, ["key"], "mean", "double").collect()}
    assert got == {r.key: r.m for r in df.groupBy("key").agg(F.avg("value").alias("m")).collect()} and got[None] == 1.0 and got["none"] is None
    states = folds.partial_states(df, ["key"], folds.of_name("mean")).groupBy("key").count().collect()
    assert {r["key"]: r["count"] for r in states}["hot"] <= 6  # one state a task, whatever the number of rows
    monkeypatch.setattr(folds, "KEYS_HELD", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert {r.key: r.value for r in folds.aggregate(df, ["key"], "mean", "double").collect()} == got
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert folds.aggregate(df.limit(0), ["key"], "mean", "double").count() == 0


def test_a_users_fold_is_registered_and_keeps_order(spark):
    name = "joined in order"
    folds.register(name, folds.Fold(list, lambda s, r: [*s, (r["pos"], r["text"])], lambda a, b: a + b, lambda s: "".join(t for _, t in sorted(s))))
    df = spark.createDataFrame([(i % 3, i, chr(97 + i)) for i in range(26)], "doc int, pos int, text string").repartition(5)
    assert {r.doc: r.value for r in folds.aggregate(df, ["doc"], name, "string").collect()} == {d: "".join(chr(97 + i) for i in range(26) if i % 3 == d) for d in range(3)}
    with pytest.raises(ValueError, match="already"):
        folds.register(name, folds.of_name("mean"))
    with pytest.raises(ValueError, match="no fold"):
        folds.of_name("unknown")


def test_table_functions_check_their_arguments(spark):
    tables.register(spark)
    spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.9), (1, "c", 0.9), (2, "d", None)], "query int, uri string, score double").createOrReplaceTempView("loom_t")
    got = spark.sql("select * from rank_rows(table(loom_t), 'query', 2)").collect()
    assert sorted((r.query, r.uri, r["rank"]) for r in got) == [(1, "b", 1), (1, "c", 2), (2, "d", 1)]
    assert [tuple(r) for r in spark.sql("select s.* from values ('abcde'), (null), ('') t(x), lateral split_text(x, 3, 1) s").collect()] == [(0, 0, 3, "abc"), (1, 2, 5, "cde")]
    for wrong in ("select * from split_text(5, 3)", "select * from split_text('x', 3, 3)", "select * from rank_rows(table(loom_t), 'nothing', 2)", "select * from find_entities(1)"):
        with pytest.raises(Exception, match="split_text|rank_rows|find_entities"):
            spark.sql(wrong).collect()


def test_hooks_of_a_stream(spark, tmp_path):
    rows = [(i, "error" if i % 4 == 0 else "ok") for i in range(30)]
    for lo in range(0, 30, 10):
        spark.createDataFrame(rows[lo : lo + 10], "i int, status string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    told = []
    mine = hooks.Hooks(before=lambda n: told.append(("before", n)), progress=lambda n, b, m: told.append((b, m["n_items"], m["n_done"], m["n_failed"])), after=lambda n, e: 1 / 0)
    job = hooks.watched_stream(streams.stream_items(spark, f"{tmp_path}/in", "i int, status string"), f"{tmp_path}/out", f"{tmp_path}/check", mine, "watched")
    job.awaitTermination()
    hooks.settle(spark, mine, lambda: bool(mine.failures))
    assert told[0] == ("before", "watched") and sorted(set(told[1:])) == [(0, 10, 7, 3), (1, 10, 8, 2), (2, 10, 7, 3)]
    assert mine.failures == ["ZeroDivisionError: division by zero"] and spark.read.parquet(f"{tmp_path}/out").count() == 30


def test_intervals(spark):
    dice = random.Random(6)
    day = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(hours=n)
    claims = []
    for i in range(300):
        a = dice.randrange(5000)
        claims.append((i, i % 3, day(a), dice.choice([None, day(a), day(a + 1), day(a + dice.randrange(2000)), day(a - 5)])))
    claims += [(300, 0, None, day(9)), (301, None, day(1), None), (302, 0, day(-10**5), day(10**5)), (5, 2, claims[5][2], claims[5][3])]
    instants = [(dice.randrange(3), day(dice.randrange(5200))) for _ in range(80)] + [(0, None), (1, claims[4][2]), (None, day(7))]
    c, i = spark.createDataFrame(claims, "id int, part int, a timestamp, b timestamp"), spark.createDataFrame(instants, "part int, at timestamp")
    holds = lambda x, t: x[2] is not None and t is not None and x[2] <= t and (x[3] is None or t < x[3])
    got = intervals.valid_pairs(c, i.drop("part"), "a", "b", "at")
    assert sorted((r.id, r["at"]) for r in got.collect()) == sorted((x[0], t) for x in claims for _, t in instants if holds(x, t))
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
    keyed = intervals.valid_pairs(c, i, "a", "b", "at", ["part"])
    assert keyed.columns == ["id", "part", "a", "b", "at"]
    assert sorted((r.id, r["at"]) for r in keyed.collect()) == sorted((x[0], t) for x in claims for p, t in instants if p == x[1] and p is not None and holds(x, t))
    assert intervals.valid_pairs(c, i.limit(0), "a", "b", "at", ["part"]).count() == 0 and intervals.valid_pairs(c.limit(0), i, "a", "b", "at", ["part"]).count() == 0


def plain_clusters(leaves, k, draw):
    """Seeds and k-means of one document: leaves {pos: vector}, draw: its first place."""
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    pos = sorted(leaves)
    e = np.array([unit(np.array(leaves[p], float)) for p in pos])
    n = len(pos)
    k = min(k or max(2, min(round(n**0.5), 8)), n)
    centres = [e[pos.index(draw)]]
    while len(centres) < k:
        like = (e @ np.array(centres).T).round(12).max(axis=1)
        at = int(np.argmin(like))
        if like[at] >= 1 - 1e-12:
            break
        centres.append(e[at])
    centres = np.array(centres)
    for _ in range(10):
        label = (e @ centres.T).round(12).argmax(axis=1)
        new = np.array([unit(e[label == c].sum(axis=0)) if (label == c).any() and np.linalg.norm(e[label == c].sum(axis=0)) > 0 else centres[c] for c in range(len(centres))])
        if np.abs(new - centres).max() < 1e-12:
            break
        centres = new
    label = (e @ centres.T).round(12).argmax(axis=1).tolist()
    order = list(dict.fromkeys(label))
    return {p: order.index(c) for p, c in zip(pos, label)}


@pytest.mark.parametrize("k", [None, 3])
def test_clusters_by_document(spark, monkeypatch, k):
    monkeypatch.setattr(clusters, "CELL", 20)
    monkeypatch.setattr(clusters, "PIECE", 8)  # documents lie in several cells
    rng = np.random.default_rng(2)
    rows = [(d, p, (rng.normal(size=4) + 4 * np.eye(4)[rng.integers(4)]).tolist()) for d in range(6) for p in range(int(rng.integers(1, 40)))]
    rows += [(50, p, [1.0, 0.0, 0.0, 0.0]) for p in range(9)] + [(51, 0, None), (51, 1, [0.0] * 4), (51, 2, [0.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "doc long, pos long, embedding array<double>")
    got = {(r.doc, r.pos): r.cluster for r in clusters.cluster_leaves(df, k).collect()}
    draws = {r.doc: r.first for r in df.where("embedding is not null").groupBy("doc").agg(F.min_by("pos", F.struct(F.xxhash64("pos", F.lit(42)), "pos")).alias("first")).collect()}
    want = {(51, 0): -1}
    for d in {r[0] for r in rows}:
        want |= {(d, p): c for p, c in plain_clusters({p: e for x, p, e in rows if x == d and e is not None}, k, draws[d]).items()}
    assert got == want


def test_search_is_reproducible_goes_on_and_finds_the_best(spark, tmp_path):
    examples = spark.createDataFrame([(i, i % 2) for i in range(50)], "x int, y int")
    space = {"t": list(range(10)), "u": list(range(10)), "flip": [0, 1]}
    score = lambda c: F.lit(1 - (abs(c["t"] - 7) + abs(c["u"] - 2)) / 18 - 0.1 * c["flip"])
    found, reason = tpe.search(examples, space, score, f"{tmp_path}/a", tpe.Limits(trials=60), batch=6, seed=1, price=0.01)
    rows = found.orderBy("trial").collect()
    assert reason == "trials" and [r.trial for r in rows] == list(range(60)) and len({r.config for r in rows}) == 60 and rows[0].n == 50
    value = lambda c: 1 - (abs(c["t"] - 7) + abs(c["u"] - 2)) / 18 - 0.1 * c["flip"]
    assert all(abs(r["mean"] - value(json.loads(r.config))) < 1e-9 and abs(r.cost - 0.5) < 1e-9 for r in rows)
    best = -1
    for r in rows:
        assert r.improves == (r["mean"] > best)
        best = max(best, r["mean"])
    assert best > 0.94 and np.mean([r["mean"] for r in rows[30:]]) > np.mean([r["mean"] for r in rows[:8]]) + 0.05  # random draws have 0.6
    half, why = tpe.search(examples, space, score, f"{tmp_path}/b", tpe.Limits(trials=30), batch=6, seed=1, price=0.01)
    assert why == "trials" and half.count() == 30
    calls = []
    whole, _ = tpe.search(examples, space, lambda c: calls.append(c) or score(c), f"{tmp_path}/b", tpe.Limits(trials=60), batch=6, seed=1, price=0.01)
    assert [tuple(r) for r in whole.orderBy("trial").collect()] == [tuple(r) for r in rows] and len(calls) == 30  # the first half isn't scored again
    assert tpe.search(examples, space, score, f"{tmp_path}/c", tpe.Limits(trials=60, cost=5.9), batch=6, seed=1, price=0.01)[1] == "cost"
    assert tpe.search(examples, space, score, f"{tmp_path}/d", tpe.Limits(trials=60, target=0.8), batch=6, seed=1)[1] == "target"
    assert tpe.search(examples, {"t": [1, 2, 3]}, lambda c: F.lit(None), f"{tmp_path}/e", tpe.Limits(trials=60), seed=1)[1] == "exhausted"
    assert tpe.search(examples, space, lambda c: F.lit(0.5), f"{tmp_path}/f", tpe.Limits(trials=60, patience=10), batch=6, seed=1)[1] == "patience"


def test_search_over_documents_scores_as_plainly(spark, tmp_path):
    rows = [tuple(r) for r in custom.tpe_search(spark, "/root/testdata/sf0.001").select("config", "mean", "n").collect()]
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()
    for config, mean, n in rows:
        c, right = json.loads(config), 0
        for r in labels:
            t = docs[r.doc_id].text
            w = t.lower().split(" ")
            marks = sum(not (x.isalnum() or x in " \t\n\v\f\r") for x in t) / max(1, len(t))
            right += (c["least"] <= docs[r.doc_id].n_chars <= c["most"] and len(set(w)) / len(w) >= c["words"] and marks <= c["marks"]) == bool(r.quality)
        assert n == len(labels) and abs(mean - right / n) < 0.011  # letters by Java's and Python's tables
    assert len(rows) == 24
