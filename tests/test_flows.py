"""Whole programs, stretches of long runs and damaged logs against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F
from sparloom.operators import chunks, flows, rubric, trials
from sparloom.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_grounded_keeps_the_fewest_errors(spark):
    def run(found, attempts):
        outputs = F.array(*[F.lit(None if n is None else f"o{i}") for i, n in enumerate(found)])
        errors = F.create_map(*[F.lit(x) for i, n in enumerate(found) if n is not None for x in (f"o{i}", n)])
        return tuple(one(spark, flows.grounded(lambda i: F.get(outputs, i), lambda o: errors[o], attempts)))

    assert run([3, 0, 0], 3) == ("o1", 0, 2)
    assert run([3, 2, 2], 3) == ("o1", 2, 3)
    assert run([1, 5, 4], 3) == ("o0", 1, 3)
    assert run([None, 4, None], 3) == ("o1", 4, 3)
    assert run([0, 1, 1], 3) == ("o0", 0, 1)
    assert run([2, 0, 0], 1) == ("o0", 2, 1)
    assert run([None, None, 7], 2) == (None, 2**31 - 1, 2)


def test_envelopes_check_their_pointers(spark):
    programs = {"f": lambda x: F.upper(x["a"])}
    rows = spark.createDataFrame([("x",), (None,)], "a string")
    good = [flows.Step("s1", "f", {"a": "$.inputs.a"}), flows.Step("s2", "f", {"a": "$.steps.s1.output.result"})]
    assert [tuple(r.output) for r in flows.run_envelope(rows, ["a"], good, {"o": "$.steps.s2.output.result", "i": "$.inputs.a"}, programs).collect()] == [("X", "x"), (None, None)]
    for steps, output in [
        ([flows.Step("s1", "g", {"a": "$.inputs.a"})], {}), ([flows.Step("s1", "f", {"a": "$.inputs.b"})], {}), ([flows.Step("s1", "f", {"a": "$.steps.s2.output.result"}), good[1]], {}), (good, {"o": "$.steps.s3.output.x"}), ([good[0], good[0]], {}),
    ]:
        with pytest.raises(ValueError):
            flows.run_envelope(rows, ["a"], steps, output, programs)


def test_chunked_answers_and_provenance(spark):
    docs = spark.createDataFrame([(1, "aaaa bbbb aaaa"), (2, "cc"), (3, ""), (4, None), (5, "zz")], "doc_id long, text string")
    kinds = lambda c: F.filter(F.array(*[F.when(F.contains(c, F.lit(x)), F.struct(F.lit(x).alias("label"), F.lit(w).alias("score"))) for x, w in (("a", 0.5), ("b", 0.9), ("c", 0.2), ("z", 1.0))]), lambda x: x.isNotNull())
    split = lambda d: chunks.hard_split(d, 5)
    answers, told = flows.chunked_classify(docs, split, kinds, ["a", "b", "c"], "vote")
    assert sorted((r.doc, r.label, r.votes) for r in answers.collect()) == [(1, "a", 2), (2, "c", 1)]
    by = {r.doc: r for r in told.collect()}
    assert set(by) == {1, 2} and by[1].chunks_used == [0, 1, 2] and [tuple(s)[1:] for s in by[1].spans] == [(0, 5), (5, 10), (10, 14)] and by[1].picked == {"a": 2, "b": 1}
    heavy, _ = flows.chunked_classify(docs, split, kinds, ["a", "b", "c"], "max_score")
    assert {r.doc: r.label for r in heavy.collect()} == {1: "b", 2: "c"}


def test_extraction_in_four_steps(spark):
    texts = [(1, "k=1 " + "x" * 30), (2, "y" * 30 + "k=2" + "z" * 30 + "k=3"), (3, "rule r"), (4, "rule r rule s"), (5, None), (6, "k=1")]
    docs = spark.createDataFrame(texts, "id long, text string")
    found = lambda t: F.nullif(F.regexp_extract(F.substring(t, 1, 33), "k=([0-9])", 1), F.lit(""))
    rules = {"k": lambda t: F.regexp_extract_all(t, F.lit("rule ([a-z])"), 1)}
    whole, kept, lineage = flows.extract_whole(docs, "id", {"k": found}, rules, {"k": "number"}, 33)
    assert {r.doc: (r.status, r.value, r.confidence) for r in whole.collect()} == {1: ("extracted", "1", 1.0), 2: ("extracted", "2", 1.0), 3: ("extracted", "r", 0.8), 4: ("refused", None, 1.0), 5: ("refused", None, 1.0), 6: ("extracted", "1", 1.0)}
    assert sorted(r.doc for r in kept.collect()) == [1, 2, 3, 4, 5] and {(r.first_doc, r.n) for r in lineage.collect()} == {(1, 2), (2, 1), (3, 1)}
    late, _, _ = flows.extract_whole(docs, "id", {"k": lambda t: F.nullif(F.regexp_extract(F.substring(t, 1, 20), "k=([0-9])", 1), F.lit(""))}, {}, {}, 20)
    assert {r.doc: (r.value, r.confidence) for r in late.collect() if r.doc == 2} == {2: ("2", 0.7)}
    with pytest.raises(Exception, match="refused"):
        flows.extract_whole(docs, "id", {"k": found}, rules, {}, 33, policy="never")[0].collect()


def test_stretches_of_runs(spark, monkeypatch):
    monkeypatch.setattr(trials, "STRETCH", 5)
    dice = random.Random(3)
    log = [(r, t, dice.choice("abc"), float(dice.choice([1, 1, 2, 3, 5])) if r else 7.0) for r in range(4) for t in dice.sample(range(90), [40, 25, 3, 1][r])]
    df = spark.createDataFrame(log, "run int, trial int, strategy string, after double")
    chain = {(r.run, r.trial): (r.card, r.parent) for r in trials.mutation_chain(df).collect()}
    good = {(r.run, r.trial) for r in trials.best_share(df, 0.3).where("good").collect()}
    for run in range(4):
        own = sorted(t for r, t, *_ in log if r == run)
        assert [chain[run, t] for t in own] == [(i, own[i - 1] if i else -1) for i in range(len(own))]
        ranked = sorted((-a, t) for r, t, _, a in log if r == run)
        assert {t for r, t in good if r == run} == {t for _, t in ranked[: min(math.ceil(0.3 * len(own)), len(own) - 1)]}


def test_cards_show_what_changed(spark):
    rows = [(1, 3, 0.5, 0.7, '{"k": 1}'), (1, 9, 0.7, 0.6, '{"k": 2}'), (1, 11, 0.7, 0.9, '{"k": 2}'), (2, 1, 0.0, 0.1, None)]
    cards = {(r.run, r.trial): r for r in trials.trial_cards(spark.createDataFrame(rows, "run int, trial int, before double, after double, s string"), "s").collect()}
    assert [(cards[k].card, cards[k].parent, cards[k].gain, cards[k].improves) for k in sorted(cards)] == [(0, -1, 0.2, True), (1, 3, -0.1, False), (2, 9, 0.2, True), (0, -1, 0.1, True)]
    assert cards[1, 9].diff.splitlines()[-4:] == [" {", '-  "k": 1', '+  "k": 2', " }"] and cards[1, 11].diff == "" and cards[2, 1].diff == ""


def test_logs_tell_a_cut_end_from_a_damaged_middle(spark, tmp_path):
    (tmp_path / "a.txt").write_text('{"n": 1}\n\nbroken\n{"n": 2}\n{"n": 3, "x\n')
    (tmp_path / "b.txt").write_text('{"n": 4}\n[1]\n{"n": 5}')
    rows, bad = readers.load_log(spark, f"{tmp_path}/*.txt", "n int")
    assert sorted(r.n for r in rows.collect()) == [1, 2, 4, 5]
    assert sorted((r.line, r.text, r.final) for r in bad.collect()) == [(2, "[1]", False), (3, "broken", False), (5, '{"n": 3, "x', True)]


def test_routes(spark):
    t = F.lit("x" * 11)
    assert [one(spark, rubric.size_route(t, n, long, F.lit(asked))) for n, long, asked in ((11, "tree", "auto"), (10, "tree", "auto"), (10, "chunk", "auto"), (10, "chunk", "single"))] == ["single", "tree", "chunk", "single"]


def test_configurations_are_counted_before_they_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(trials, "CONFIGS", 3)
    configs = spark.range(4).withColumnRenamed("id", "config")
    with pytest.raises(ValueError, match="over 3"):
        trials.evaluate_configs(spark.range(5), configs, F.lit(1))
    assert trials.evaluate_configs(spark.range(5), configs.limit(3), F.lit(1)).count() == 3


def test_reducers_by_name(spark):
    leaves = spark.createDataFrame([(1, i, chr(97 + i)) for i in range(5)], "doc int, pos int, value string")
    joined = lambda v: F.array_join(v, "")
    assert chunks.reduce_by("tree", leaves, merge=joined, fan=2).first().value == "abcde"
    chunks.register_reducer("last", lambda rows, **_: rows.groupBy("doc").agg(F.max_by("value", "pos").alias("value")))
    assert chunks.reduce_by("last", leaves).first().value == "e"
    with pytest.raises(ValueError, match="already"):
        chunks.register_reducer("last", None)
    with pytest.raises(ValueError, match="no reducer"):
        chunks.reduce_by("first", leaves)


def test_fuzzy_stretches_reach_the_threshold_as_their_share_says(spark):
    from sparloom.functions import grounding

    dice = random.Random(8)
    rows = [("".join(dice.choice("ab ") for _ in range(dice.randrange(12))), "".join(dice.choice("ab ") for _ in range(dice.randrange(12)))) for _ in range(400)] + [(None, "a"), ("a", None), ("", ""), ("a", "")]
    df = spark.createDataFrame(rows, "s string, q string")
    for t in (0.1, 0.5, 0.7, 0.8, 1.0):
        assert df.where(F.coalesce(grounding.fuzzy_char_reaches(F.col("s"), F.col("q"), t), F.lit(False)) != (grounding.fuzzy_char(F.col("s"), F.col("q")) >= t)).count() == 0
