"""Small cases of the operators: nulls, ties, empty tables and known values."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from sparloom.functions import arrays, codecs, extractors, grounding, metrics, verdicts
from sparloom.operators import cells, chunks, programs, rubric, runs, taxonomy, trials, vectors, votes
from sparloom.sources import readers
from sparloom.streaming import runs as streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_metrics_of_nulls_and_known_values(spark):
    n = F.lit(None).cast("string")
    assert one(spark, metrics.exact_match(n, n)) == 0
    assert one(spark, metrics.case_insensitive_match(F.lit("ÉCOLE"), F.lit("école"))) == 1
    assert one(spark, metrics.normalized_match(F.lit("\t a  b. "), F.lit("a b"))) == 1
    for p, g, want in ((5, 5, 1.0), (3, 5, 0.6), (100, 1, 0.0)):
        assert one(spark, metrics.numeric_ratio(F.lit(p), F.lit(g))) == pytest.approx(want)


def test_verdicts_take_the_earliest_label_on_ties(spark):
    assert one(spark, verdicts.verdict(F.lit(0.4), F.lit(0.4), F.lit(0.2)))["label"] == "entailment"
    assert one(spark, verdicts.verdict(F.lit(0.2), F.lit(0.4), F.lit(0.4)))["label"] == "neutral"
    j = one(spark, verdicts.judged(F.lit(" Refuted "), F.lit(0.8)))
    assert j["label"] == "contradiction" and j["entailment"] == pytest.approx(0.1)
    assert one(spark, verdicts.judged(F.lit("maybe"), F.lit(0.8))) is None
    assert not one(spark, verdicts.refused(F.lit(0), F.lit(0), 0.5)) and one(spark, verdicts.refused(F.lit(1), F.lit(4), 0.5))


def test_ensemble_and_promotion_ties(spark):
    r = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, "b"), (1, 4, "a"), (2, 1, None)], "doc long, pos long, value string")
    assert {tuple(x) for x in votes.ensemble(r).collect()} == {(1, "a", 2, 4), (2, None, 1, 1)}
    c = spark.createDataFrame([(1, 1, 0.5, 0.7, 0.7), (1, 2, 0.9, 0.7, 0.7), (1, 3, 0.4, 0.9, 0.7)], "run long, candidate long, mini double, full double, baseline double")
    assert [tuple(x) for x in trials.promote_top_n(c, 2).collect()] == [(1, 2, 0.7, False)]
    assert votes.ensemble(r.limit(0)).count() == trials.promote_top_n(c.limit(0), 2).count() == 0


def test_pareto_keeps_equal_points(spark):
    rows = spark.createDataFrame([("a", 0.9, 0.01), ("b", 0.85, 0.05), ("c", 0.95, 0.2), ("d", 0.9, 0.01)], "name string, metric double, cost double")
    assert {r["name"] for r in trials.pareto_frontier(rows, "metric", "cost").collect()} == {"a", "c", "d"}


def test_list_cells_take_what_they_lack(spark):
    own = spark.createDataFrame([(1, "c", "extracted", ["Acme "]), (2, "c", "not_in_document", None), (3, "c", "extracted", ["x"])], "doc long, col string, status string, values array<string>")
    hits = spark.createDataFrame([(1, "c", 5, "ACME"), (1, "c", 9, "Bolt"), (1, "c", 7, "bolt"), (2, "c", 1, "Core")], "doc long, col string, pos long, key string")
    got = {r["doc"]: (r["status"], r["values"], r["added"]) for r in cells.merge_list_hits(own, hits).collect()}
    assert got == {1: ("extracted", ["Acme ", "bolt"], 1), 2: ("extracted", ["Core"], 1), 3: ("extracted", ["x"], 0)}


def test_passage_uris(spark):
    n = F.lit(None).cast("string")
    uri = lambda doc, explicit=n, block=n, start=n: one(spark, chunks.passage_uri(F.lit(doc), F.lit("text"), explicit, block, start))
    assert uri("d", F.lit("x:1")) == "x:1" and uri("d#p", block=F.lit("#/b/2")) == "d#p" and uri("d", block=F.lit("#/body/2")) == "d#/body/2"
    assert uri("d", block=F.lit("#/body/0"), start=F.lit(7)) == "d#c7" and uri("d").startswith("d#h")


def test_chunks_round_trip(spark):
    text = "One sentence here. Another one follows! " * 40 + "x" * 300
    spans = chunks.pack_text(text, 200, 50)
    assert "".join(text[a:b] for a, b in spans) == text and all(b - a <= 250 for a, b in spans) and chunks.pack_text("", 200, 50) == []
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    assert {r["doc_id"] for r in chunks.hard_split(docs, 100).collect()} == {1}


def test_taxonomy_leaves_cycles_out(spark):
    labels = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "name string, parent string")
    assert {tuple(r) for r in taxonomy.paths(labels).collect()} == {("a", 0, "a", False), ("b", 1, "a/b", False), ("c", 2, "a/b/c", True)}


def test_search_within_keys(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.1], "b"), (3, [0.5, 0.5], "a"), (4, [0.0, 0.0], "a")], "vec_id long, embedding array<float>, label string")
    near = vectors.top_k(rows.where("vec_id = 1"), rows, 2, within=["label"]).collect()
    assert [r["vec_id"] for r in sorted(near, key=lambda r: r["rank"])] == [3, 4]
    assert vectors.top_k(rows.limit(0), rows, 2).count() == 0


def test_envelope_and_shortening(spark):
    v = one(spark, codecs.decode_envelope(F.lit('{"kind": "r", "payload": {"k": 3}}'), "k long"))
    assert v["kind"] == "r" and v["payload"]["k"] == 3
    assert one(spark, codecs.shorten(F.lit("abc"), 3)) == "abc" and one(spark, codecs.shorten(F.lit("abcd"), 3, 2)).startswith("ab ... [TRUNCATED 4 chars; sha256=")


def test_resumed_stream_over_many_batches(spark, tmp_path):
    rows = spark.createDataFrame([(str(i % 7), i) for i in range(40)], "custom_id string, seq long")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    done = spark.createDataFrame([("3",)], "custom_id string")
    for _ in range(2):
        items = streams.stream_items(spark, str(tmp_path / "in"), rows.schema)
        streams.run_incrementally(items, lambda fresh: fresh, str(tmp_path / "out"), str(tmp_path / "check"), done=done).awaitTermination()
    assert sorted(r["custom_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list("012456")
    changes = streams.newest_of_key(streams.stream_items(spark, str(tmp_path / "in"), rows.schema), "custom_id", "seq", 3)
    streams.write_changes(changes, str(tmp_path / "state"), str(tmp_path / "check2")).awaitTermination()
    last = spark.read.parquet(str(tmp_path / "state")).groupBy("custom_id").agg(F.max_by("seqs", "batch").alias("s"))
    assert {r["custom_id"]: list(r["s"]) for r in last.collect()} == {str(k): [i for i in range(40) if i % 7 == k][-3:] for k in range(7)}


def test_resume_counts_of_an_empty_log(spark):
    items = spark.createDataFrame([("a",), ("b",)], "custom_id string")
    assert tuple(runs.resume_counts(items, items.limit(0)).first()) == (2, 0, 2)


def listed(spark, column, *fields):
    return [tuple(str(x[f]) for f in fields) for x in one(spark, column)]


def test_running_values_and_spans(spark):
    values = [3, 0, 7, 7, 1, 2] * 9
    column = F.array(*[F.lit(v) for v in values])
    assert one(spark, arrays.scan(column, lambda a, b: a + b)) == [sum(values[: i + 1]) for i in range(len(values))]
    assert one(spark, arrays.scan(column, lambda a, b: F.greatest(a, b))) == [max(values[: i + 1]) for i in range(len(values))]
    assert one(spark, arrays.starts(F.array(F.lit(2), F.lit(0), F.lit(5)))) == [0, 2, 2] and one(spark, arrays.scan(F.array().cast("array<int>"), lambda a, b: a + b)) == []
    text = "é ab 😀 cab " * 40 + "ab"
    want = [(m.start(), m.end(), m.group()) for m in re.finditer("c?ab", text)]
    assert [tuple(s) for s in one(spark, arrays.spans(F.lit(text), "c?ab"))] == want and one(spark, arrays.spans(F.lit(None).cast("string"), "a")) == []


MONEY = [("Cost €250 in Paris", "250", "EUR"), ("¥5000 in Tokyo.", "5000", "JPY"), ("Owed ₹10000.", "10000", "INR"), ("Ten million dollars total.", "1000000", "USD"), ("Fined 500 euros.", "500", "EUR"), ("The price was 100$ total.", "100", "USD"), ("13.50 pounds", "13.50", "GBP")]
DATES = [("Date: 12/31/99.", "1999-12-31"), ("Date: 3.1.2011.", "2011-03-01"), ("on 19 May, 2010,", "2010-05-19"), ("dated Feb. 17, 1999", "1999-02-17"), ("the 1st May 2020", "2020-05-01"), ("the first day of May 2020", "2020-05-01"), ("13/1/2025", "2025-01-13"), ("Bad 123/456/789", None), ("19 May 10.", None), ("first of May 2020", None), ("2/30/2025", None), ("15 May 2100", None)]


def test_extractors(spark):
    for text, amount, currency in MONEY:
        assert listed(spark, extractors.money(F.lit(text)), "amount", "currency") == [(amount, currency)]
    for text, day in DATES:
        assert listed(spark, extractors.dates(F.lit(text)), "value") == ([(day,)] if day else [])
    for text, value in (("30%", 0.3), ("50bps", 0.005), ("100 basis points", 0.01), ("5‰", 0.005), ("7‱", 0.0007), ("30％", 0.3), ("5 ppm", 5e-6), ("ten percent", 0.1)):
        assert [x["value"] for x in one(spark, extractors.percentages(F.lit(text)))] == [pytest.approx(value)]
    for text, values in (("II", ["2"]), ("XCIX", ["99"]), ("I", []), ("1,23", []), ("1.2.3", []), ("1,234,567 and 0.01", ["1234567", "0.01"]), ("seven", ["7"]), ("Chapter IIII", [])):
        assert [v for (v,) in listed(spark, extractors.numbers(F.lit(text)), "value")] == values
    for text, want in (("ninety days", ("90", "days", "7776000.0")), ("an hour", ("1", "hour", "3600.0")), ("1.5 hours", ("1.5", "hours", "5400.0")), ("3 business days", None), ("days", None)):
        assert listed(spark, extractors.durations(F.lit(text)), "quantity", "unit", "seconds") == ([want] if want else [])
    assert listed(spark, extractors.entities(F.lit("with Acme Trading, Inc. and Foo GmbH")), "name") == [("Acme Trading, Inc.",), ("Foo GmbH",)]
    assert all(one(spark, f(F.lit(None).cast("string"))) == one(spark, f(F.lit(""))) == [] for f in extractors.EXTRACTORS.values())


def test_grounding(spark):
    lit = lambda *x: [F.lit(v) for v in x]
    assert one(spark, grounding.fuzzy_char(*lit("a contrqct here", "contract"))) == pytest.approx(5 / 8)
    assert one(spark, grounding.fuzzy_char(*lit("abcdefgh", "abcdefgx"))) == pytest.approx(7 / 8) and one(spark, grounding.fuzzy_char(*lit("x", ""))) == 0
    assert one(spark, grounding.normalized_token(*lit("the “eﬃcient—ﬁrst” rule", "'the\u00a0\"eﬃcient-first\" rule,"))) and not one(spark, grounding.normalized_token(*lit("don't stop", "dont stop")))
    verdict = lambda source, quote, **o: one(spark, grounding.verify(F.lit(source).cast("string"), F.lit(0), F.lit(len(quote)), F.lit(quote), **o))
    assert verdict("abc def", "abc") == "strict" and verdict(None, "abc") == "source_missing" and verdict("ab", "abc", strategies=("strict",)) == "out_of_range"
    assert verdict("xyz", "abc", strategies=("strict",)) == verdict("xyz", "abc", strategies=("substring", "case_insensitive")) == "quote_mismatch" and verdict("xyz", "abc") == "similarity_below_threshold"
    assert verdict("beta alpha", "alpha beta", strategies=("normalized_token", "fuzzy_token")) == "fuzzy_token"
    with pytest.raises(ValueError):
        grounding.verify(*lit("a", 0, 1, "a"), strategies=("guess",))


def test_answers(spark):
    for text, want in (('{"text": "t", "answer": "a"}', "a"), ('{"answer": null, "text": "t"}', None), ('{"x": 1}', '{"x": 1}'), ("plain", "plain"), (None, None)):
        assert one(spark, metrics.first_key(F.lit(text).cast("string"))) == want
    for text, want in (("true", 1.0), ('{"value": "2.5"}', 2.5), ("1_0", 10.0), ("x", None), (None, None)):
        assert one(spark, metrics.to_number(F.lit(text).cast("string"))) == want
    assert one(spark, metrics.normalize(F.lit("\t\n 'A  b.' \u00a0"))) == "a b" and one(spark, metrics.refs(F.lit("one"))) == ["one"] and one(spark, metrics.refs(F.lit('["a", "a", "b"]'))) == ["a", "b"]
    r = one(spark, metrics.rouge(F.lit("the cat the mat"), F.lit("the cat"), 2))
    assert (r["precision"], r["recall"]) == (pytest.approx(1 / 3), 1.0)
    assert one(spark, metrics.metric("numeric_close:0.1")(F.lit("1.05"), F.lit("1"))) == 1 and one(spark, metrics.metric("regex:a+")(F.lit("aa"), F.lit(None))) == 1
    with pytest.raises(ValueError):
        metrics.metric("none")


def test_votes_of_few_chunks(spark):
    picks = spark.createDataFrame([(1, i, i, x, 0.5, 1) for i, x in enumerate("aaab")] + [(2, i, 10 + i, x, 0.5, 1) for i, x in enumerate("abc")], "doc long, chunk long, pos long, label string, score double, weight long")
    got = {r["doc"]: (r["label"], r["abstained"]) for r in votes.majority(picks, 0.75).collect()}
    assert got == {1: ("a", False), 2: (None, True)}
    assert {r["doc"]: r["label"] for r in votes.max_score(picks).collect()} == {1: "a", 2: "a"} and {r["label"] for r in votes.max_score(picks, 0.9).collect()} == {None}
    assert {r["doc"]: r["labels"] for r in votes.aggregate(picks, exclusive=False, labels=["c", "b", "a"]).collect()} == {1: "b,a", 2: "c,b,a"}
    for bad in (0, 1.5):
        with pytest.raises(ValueError):
            votes.majority(picks, bad)
    with pytest.raises(ValueError):
        votes.aggregate(picks, "most")
    with pytest.raises(Exception, match="not a label: z"):
        one(spark, votes.demand_known(F.array(F.lit("a"), F.lit("z")), ["a"]))


def test_cells_of_types(spark):
    rows = [(1, "d", "extracted", "2020-05-19", 1), (1, "d", "extracted", "19 May 2020", 2), (2, "d", "extracted", "5/19/2020", 3), (2, "n", "extracted", "Acme, Inc.", 4), (3, "n", "extracted", "ACME", 5), (3, "d", "unclear", "2020-05-19", 6), (4, "n", "extracted", None, 7)]
    long = spark.createDataFrame(rows, "doc long, col string, status string, value string, pos long")
    kind = F.when(F.col("col") == "d", "date").otherwise("entity")
    kept, lineage = cells.dedup_cells(long, cells.canonical_value(F.col("value"), kind))
    assert sorted(r["pos"] for r in kept.collect()) == [1, 4, 6, 7] and sorted((r["col"], r["first_doc"], r["n"]) for r in lineage.collect()) == [("d", 1, 3), ("n", 2, 2)]
    assert cells.lineage_documents(long, cells.canonical_value(F.col("value"), kind)).count() == 4
    for text, kind, key in (("$1,000.50", "money", "1000.50:USD"), ("1000", "money", "1000:USD"), ("+1,2.0", "number", "12.0"), ("two weeks", "duration", "1209600"), ("  Other ", "date", "other")):
        assert one(spark, cells.canonical_value(F.lit(text), F.lit(kind))) == key
    with pytest.raises(Exception, match="refused: 3 d"):
        cells.refusal_policy(long, "never").collect()
    with pytest.raises(Exception, match="missing fields: k"):
        one(spark, cells.declared_fields(F.lit('{"x": 1}'), {"k": "long"}, ["k"]))
    assert cells.check_pointers([("a", ["$.inputs.x", "$.steps.b.output.y"]), ("b", ["$.steps.a.output.y", "x"])], ["x"]) == ["a: $.steps.b.output.y", "b: x"]


def test_paragraphs_and_tags(spark):
    text = "short\n\n\nA paragraph of some length.\n\n  And another that is long.  "
    docs = spark.createDataFrame([("c", text), ("e", ""), ("n", None)], "doc_id string, text string")
    rows = chunks.paragraphs(docs).collect()
    assert [(r["pos"], r["start"], r["end"]) for r in sorted(rows, key=lambda r: r["pos"])] == [(0, 8, 35), (1, 37, 66)] and all(text[r["start"] : r["end"]] == r["chunk"] for r in rows)
    tagged = {r["doc_id"]: r for r in chunks.tagged_text(docs).collect()}
    assert tagged["c"]["tagged"] == "short\n\n\n[SRC:doc:c#p0] A paragraph of some length.\n\n[SRC:doc:c#p1]   And another that is long.  " and tuple(tagged["c"]["tags"]["doc:c#p1"]) == (37, 66)
    assert tagged["e"]["tagged"] == "" and "n" not in tagged


def test_truncated_json(spark):
    whole = '{"a": [1, {"b": "x\\"]"}], "c": {"d": null}}'
    for n in range(1, len(whole) + 1):
        out = one(spark, codecs.close_truncated_json(F.lit(whole[:n])))
        if out is not None:
            json.loads(out)
    assert one(spark, codecs.close_truncated_json(F.lit('{"a": [1, 2'))) == '{"a": [1, 2]}' and one(spark, codecs.close_truncated_json(F.lit(None).cast("string"))) is None


def test_programs(spark):
    rows = spark.range(3)
    none = programs.best_of_n(rows, "id", 3, lambda i: i, lambda out: F.lit(None)).collect()
    assert all(r["index"] == 0 and r["failed"] == 3 for r in none)
    r = one(spark, programs.refine(F.lit(0), lambda out, n: F.when(n == 2, -5).otherwise(out + 3), lambda out: out, 100.0, 3))
    assert (r["output"], r["score"], r["rounds"]) == (3, 3.0, 3)
    with pytest.raises(ValueError):
        rubric.checked([], 0.5, 0.5, 1)
    assert trials.trial_count(2, 1) == 1 and trials.trial_count(2, 8) == 12 and len(trials.random_draws({"a": [1, 2]}, 5)) == 5
    with pytest.raises(ValueError):
        trials.stop_reasons(rows)


def test_lines_over_blocks(spark, tmp_path):
    lines = [json.dumps({"n": i}) if i % 3 else "" for i in range(1, 400)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        got = readers.text_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r["line"], r["text"]) for r in got} == {(i, t) for i, t in enumerate(lines, 1) if t}
    with pytest.raises(Exception, match="no object in line 1"):
        readers.jsonl_items(spark.createDataFrame([("p", 1, "[1]")], "path string, line long, text string"), "n int").collect()


def items(part, parts):
    for i in range(part, 10, parts):
        yield {"custom_id": str(i), "inputs": {"n": i}}


def test_items_of_a_generator(spark):
    spark.dataSource.register(readers.ItemSource)
    rows = spark.read.format("items").option("factory", "tests.test_kernels:items").option("parts", "3").load()
    assert sorted(json.loads(r["inputs"])["n"] for r in rows.collect()) == list(range(10)) and rows.rdd.getNumPartitions() == 3


def test_logs_of_other_programs_are_refused(spark, tmp_path):
    path = str(tmp_path / "log")
    readers.write_header(spark, path, "r", "sha256:a", "s")
    readers.append_log(spark.createDataFrame([("1",)], "custom_id string"), path)
    log = readers.read_log(spark, path, readers.HEADER_DDL + ", custom_id string")
    assert [r["custom_id"] for r in runs.checked_log(log, "sha256:a").collect()] == ["1"]
    with pytest.raises(ValueError):
        runs.checked_log(log, "sha256:b")


def test_error_policies(spark, tmp_path):
    spark.createDataFrame([(i,) for i in range(20)], "n long").repartition(4).write.parquet(str(tmp_path / "in"))
    work = lambda b: b.select("n", F.lit("error").alias("status"))
    for policy, stops in (("continue", False), ("stop", True), ("stop_after_n", True)):
        rows = streams.stream_items(spark, str(tmp_path / "in"), "n long")
        run = streams.run_with_policy(rows, work, str(tmp_path / policy), str(tmp_path / f"{policy}-check"), policy, 8)
        if stops:
            with pytest.raises(Exception, match="TooManyErrors"):
                run.awaitTermination()
        else:
            run.awaitTermination()
        written = spark.read.parquet(str(tmp_path / policy)).count()
        assert written == 20 if policy == "continue" else written < 20


def test_kmeans_against_plain_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    centres = u[: vectors.cluster_count(60)]
    for _ in range(10):
        at = (u @ centres.T).argmax(axis=1)
        sums = np.stack([u[at == k].sum(axis=0) for k in range(len(centres))])
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    assert {r["vec_id"]: r["cluster"] for r in vectors.spherical_kmeans(rows).collect()} == dict(enumerate((u @ centres.T).argmax(axis=1).tolist()))
    assert [vectors.cluster_count(n) for n in (1, 9, 20, 400)] == [2, 3, 4, 8]


def test_packing_against_a_plain_walk(spark):
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["word ", "longerword", ". ", "! ", "\n\n", "x" * 30]) for _ in range(rng.randrange(60)))
        spans = chunks.pack_text(text, 80, 15)
        assert "".join(text[a:b] for a, b in spans) == text and all(a < b for a, b in spans) and all(b - a <= 80 for a, b in spans[:-1]) and (not spans or spans[-1][1] - spans[-1][0] < 95)
        ends = set(chunks.segments(text))
        for (a, b), (_, e) in zip(spans, spans[1:]):
            if b - a < 80:  # it ends with a segment, and the next one wouldn't have fitted
                assert b in ends and min((x for x in ends if x > b), default=e) - a > 80
    docs = spark.createDataFrame([(1, "a. " * 50), (2, ""), (3, None)], "doc_id long, text string")
    assert [(r["pos"], r["start"], r["end"]) for r in chunks.pack_sentences(docs, 60, 10).orderBy("pos").collect()] == [(i, a, b) for i, (a, b) in enumerate(chunks.pack_text("a. " * 50, 60, 10))]
