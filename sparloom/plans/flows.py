"""Queries of whole programs, logs and routes, each with its SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from sparloom.functions import grounding, metrics, verdicts
from sparloom.operators import chunks, flows, rubric, runs, trials
from sparloom.plans.queries import query, table
from sparloom.sources import readers
from sparloom.sources.scratch import shared_folder

_CHUNKS = "select doc_id, p as pos, substr(text, p * 1000 + 1, 1000) as chunk from (select doc_id, text, unnest(range(0, (length(text) - 1) // 1000 + 1)) as p from documents where length(text) > 0)"
_MARKS = {"en": " the ", "de": " die ", "fr": " le ", "es": " la "}


@query(
    f"""with c as ({_CHUNKS}), p as (select doc_id as doc, pos, unnest(list_filter([{", ".join(f"case when contains(lower(chunk), '{m}') then '{k}' end" for k, m in _MARKS.items())}], lambda x: x is not null)) as label from c),
n as (select doc, count(distinct pos) as n from p group by doc), v as (select doc, label, count(distinct pos) as votes, min(pos * 1000 + list_position(['en', 'de', 'fr', 'es'], label)) as f from p group by all)
select doc, case when votes >= 0.5 * n then label end as label, votes < 0.5 * n as abstained from v join n using (doc) qualify row_number() over (partition by doc order by votes desc, f) = 1"""
)
def chunked_classify(spark, d):
    """Languages that words give away: chunks of 1,000 characters, labels of each, the majority of a document's chunks."""

    def classify(chunk):
        found = [F.when(F.contains(F.lower(chunk), F.lit(m)), F.struct(F.lit(k).alias("label"), F.lit(1.0).alias("score"))) for k, m in _MARKS.items()]
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    answers, _ = flows.chunked_classify(table(spark, d, "documents"), lambda docs: chunks.hard_split(docs, 1000), classify, list(_MARKS), "majority", threshold=0.5)
    return answers


@query("select doc_id, case when doc_id % 4 = 3 then null when doc_id % 4 = 2 then 'no such quote' else substr(text, 2, 30) end as quote, case when doc_id % 4 = 2 then 1 when doc_id % 4 = 3 then 2147483647 else 0 end::int as errors, case doc_id % 4 when 0 then 1 when 1 then 3 else 3 end::int as attempts from documents where length(text) > 40")
def grounded_answers(spark, d):
    """Quotes that are made up to three times until they stand in their text."""
    right, wrong = F.substring("text", 2, 30), F.lit("no such quote")
    m = F.col("doc_id") % 4
    produce = lambda i: F.when(m == 0, right).when(m == 1, F.when(i < 2, wrong).otherwise(right)).when(m == 2, wrong)
    rows = table(spark, d, "documents").where("length(text) > 40")
    made = rows.select("doc_id", flows.grounded(produce, lambda q: (~F.contains("text", q)).cast("int"), 3).alias("g"))
    return made.select("doc_id", F.col("g.output").alias("quote"), "g.errors", "g.attempts")


@query("select conv_id as doc, string_agg(text, ' ' order by turn) as extract, '> ' || substr(string_agg(text, ' ' order by turn), 1, 80) as summary, count(*) as n from (select *, row_number() over (partition by conv_id order by length(text) desc, turn) as k from conversations) where k <= 2 group by conv_id")
def hybrid_summary(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), F.lit(0).alias("start"), F.length("text").alias("end"), "text")
    made = flows.hybrid_summary(rows, F.length("text"), 2, lambda text: F.concat(F.lit("> "), F.substring(text, 1, 80)))
    return made.select("doc", "extract", "summary", F.size("spans").cast("long").alias("n"))


@query("select event_id, event_type || '!' as said, length(event_type || '!')::int as size, (event_id % 3 + length(event_type || '!'))::bigint as total from events")
def envelope_run(spark, d):
    """Three steps, wired by pointers: two read what the first made, one an input too."""
    programs = {"shout": lambda x: F.struct(F.concat(x["text"], F.lit("!")).alias("text")), "measure": lambda x: F.length(x["of"]), "add": lambda x: (x["a"] + x["b"]).cast("long")}
    steps = [flows.Step("s1", "shout", {"text": "$.inputs.kind"}), flows.Step("s2", "measure", {"of": "$.steps.s1.output.text"}), flows.Step("s3", "add", {"a": "$.inputs.n", "b": "$.steps.s2.output.result"})]
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), (F.col("event_id") % 3).alias("n"))
    out = flows.run_envelope(rows, ["kind", "n"], steps, {"said": "$.steps.s1.output.text", "size": "$.steps.s2.output.result", "total": "$.steps.s3.output.result"}, programs)
    return out.select("event_id", "output.*")


_KEY, _MAIL = "[0-9][0-9 -]{7,}[0-9]", "[a-z0-9._]+@[a-z0-9.-]+"


@query(
    f"""with base as (select doc_id as doc, text from documents), c as ({_CHUNKS}),
e as (select doc, 'key' as col, 0 as n, nullif(regexp_extract(substr(text, 1, 1000), '{_KEY}'), '') as value, null as hit from base union all select doc, 'mail', 1, nullif(regexp_extract(substr(text, 1, 1000), '{_MAIL}'), ''), null from base
union all select doc, 'lang', 2, null, case when contains(text, ' the ') and not contains(text, ' die ') then 'en' when contains(text, ' die ') and not contains(text, ' the ') then 'de' end from base),
r as (select doc_id as doc, col, arg_min(value, pos) as value from (select doc_id, pos, 'key' as col, nullif(regexp_extract(chunk, '{_KEY}'), '') as value from c union all select doc_id, pos, 'mail', nullif(regexp_extract(chunk, '{_MAIL}'), '') from c) where value is not null group by all),
w as (select e.doc, e.col, e.n, coalesce(e.value, e.hit, r.value) as value, case when e.value is not null then 1.0 when e.hit is not null then 0.8 when r.value is not null then 0.7 else 1.0 end::double as confidence from e left join r on r.doc = e.doc and r.col = e.col)
select doc, col, case when value is null then 'refused' else 'extracted' end as status, value, confidence from w qualify value is null or row_number() over (partition by col, lower(trim(value)) order by doc, n) = 1"""
)
def extract_whole(spark, d):
    """Numbers, addresses and languages of all documents: an extractor that sees 1,000 characters, rules, chunks tried again, equal values told."""
    first = lambda p: lambda t: F.nullif(F.regexp_extract(F.substring(t, 1, 1000), p, 0), F.lit(""))
    en, de = (lambda t, w=w: F.contains(t, F.lit(w)) for w in (" the ", " die "))
    rules = {"lang": lambda t: F.filter(F.array(F.when(en(t), "en"), F.when(de(t), "de")), lambda x: x.isNotNull())}
    extractors = {"key": first(_KEY), "mail": first(_MAIL), "lang": lambda t: F.lit(None).cast("string")}
    _, kept, _ = flows.extract_whole(table(spark, d, "documents"), "doc_id", extractors, rules, {}, 1000)
    return kept.select("doc", "col", "status", "value", "confidence")


@query("select doc_id, case when doc_id % 5 = 0 then 'tree' when length(text) <= 12000 then 'single' else 'tree' end as summary, case when doc_id % 5 = 0 then 'tree' when length(text) <= 12000 then 'single' else 'chunk' end as classify from documents")
def size_routes(spark, d):
    asked = F.when(F.col("doc_id") % 5 == 0, "tree").otherwise("auto")
    return table(spark, d, "documents").select("doc_id", rubric.size_route(F.col("text"), long="tree", requested=asked).alias("summary"), rubric.size_route(F.col("text"), long="chunk", requested=asked).alias("classify"))


@query(
    """with t as (select user_id as run, event_id as trial, value as after, '{"event": "' || event_type || '"}' as s, lag('{"event": "' || event_type || '"}') over w as b, row_number() over w - 1 as card, coalesce(lag(event_id) over w, -1) as parent, max(value) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as m from events window w as (partition by user_id order by event_id))
select run, trial, card, parent, round(after - 50, 4) as gain, coalesce(after > m, true) as improves, case when b is null then '--- before' || chr(10) || '+++ after' || chr(10) || '@@ -0,0 +1,3 @@' || chr(10) || '+{' || chr(10) || '+  ' || s[2:-2] || chr(10) || '+}' when b = s then ''
else '--- before' || chr(10) || '+++ after' || chr(10) || '@@ -1,3 +1,3 @@' || chr(10) || ' {' || chr(10) || '-  ' || b[2:-2] || chr(10) || '+  ' || s[2:-2] || chr(10) || ' }' end as diff from t"""
)
def trial_cards(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("trial"), F.col("value").alias("after"), F.lit(50.0).alias("before"), F.concat(F.lit('{"event": "'), "event_type", F.lit('"}')).alias("settings"))
    return trials.trial_cards(log, "settings")


@query("select (count(*) filter (where event_id % 50 <> 7))::bigint as loaded, (count(*) filter (where event_id % 50 = 7))::bigint as bad, count(distinct event_type)::bigint as cut from events")
def mutation_log(spark, d):
    """A log with broken lines and, at the end of each of its files, one that was cut off in writing."""
    path = shared_folder(spark, "mutations")
    e = table(spark, d, "events")
    line = F.when(F.col("event_id") % 50 == 7, F.lit('{"trial": oops')).otherwise(F.to_json(F.struct(F.col("event_id").alias("trial"), "value")))
    last = e.groupBy("event_type").agg(F.max("event_id").alias("m")).select("event_type", (F.col("m") + 1).alias("event_id"), F.lit('{"trial": 12, "val').alias("value"))
    rows = e.select("event_type", "event_id", line.alias("value")).unionByName(last)
    rows.repartition("event_type").sortWithinPartitions("event_type", "event_id").drop("event_id").write.partitionBy("event_type").text(path)
    loaded, bad = readers.load_log(spark, f"{path}/*/*.txt", "trial long, value double")
    return loaded.agg(F.count("*").alias("loaded")).join(bad.agg(F.count_if(~F.col("final")).alias("bad"), F.count_if("final").alias("cut")))


@query("select event_type, count(*) as lines, sum(length(event_id::varchar) + 1)::bigint as bytes from events group by event_type")
def binary_files(spark, d):
    """Files read as they are: their sizes and line ends."""
    path = shared_folder(spark, "files")
    table(spark, d, "events").select("event_type", F.col("event_id").cast("string").alias("value")).write.partitionBy("event_type").text(path)
    files = readers.open_source(spark, {"type": "binary", "path": f"{path}/*", "glob": "*.txt"})
    lines = F.length(F.regexp_replace(F.decode("content", "utf-8"), "[^\n]", ""))
    return files.groupBy(F.regexp_extract("path", "event_type=([^/]*)", 1).alias("event_type")).agg(F.sum(lines).alias("lines"), F.sum("length").alias("bytes"))


@query("""with p as (select user_id, list(event_id order by event_id) as ids, list(event_id % 10 order by event_id) as k from events group by user_id)
select user_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(k), lambda x: {'at': list_position(k, x), 'k': x})), lambda s: s.k), ',') as pooled, len(list_distinct(k))::int as spans from p""")
def pooled_ids(spark, d):
    """Chunk ids and spans of several results, each once, in order of first use, with the source stamped."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x % 10).alias("k"))
    lists = F.array(F.slice("k", 1, 3), F.slice("k", 4, 1_000_000))
    span = lambda a: F.transform(a, lambda x: F.struct(F.lit("old").alias("source_uri"), x.alias("start"), (x + 1).alias("end")))
    spans = grounding.stamp_source(chunks.pooled_spans(span(F.col("k")), span(F.reverse("k"))), F.lit("doc:1"))
    right = F.forall(spans, lambda s: s["source_uri"] == "doc:1")
    return e.select("user_id", F.array_join(F.transform(chunks.pooled_chunks(lists), lambda x: x.cast("string")), ",").alias("pooled"), F.when(right, F.size(spans)).alias("spans"))


@query("select event_id::varchar as custom_id, case when value < 0.5 then 'error' else 'succeeded' end as status, case when value < 0.5 then 'ValueError' end as error_type from events")
def program_run(spark, d):
    """A program over Arrow batches, whose failures are rows."""
    items = table(spark, d, "events").select(F.col("event_id").cast("string").alias("custom_id"), "value")
    return runs.execute(items, _program).select("custom_id", "status", "error_type")


def _program(batches):
    for batch in batches:
        rows = []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            try:
                if v < 0.5:
                    raise ValueError("too small")
                rows.append((i, "succeeded", str(v), None, 1, 0.0))
            except ValueError as e:
                rows.append((i, "error", None, type(e).__name__, 0, 0.0))
        columns = [[r[i] for r in rows] for i in range(6)]
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["custom_id", "status", "output", "error_type", "tokens", "cost"])


_NEXT = "with v as (select vec_id, embedding::double[] as e, lead(embedding::double[]) over (order by vec_id) as f from embeddings) "


@query(_NEXT + "select vec_id, case when f is not null and least(greatest(list_cosine_similarity(e, f), 0), 1) >= 0.1 then 1.0 else 0.0 end::double as score from v")
def semantic_match(spark, d):
    v = table(spark, d, "embeddings")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return v.join(after, "vec_id", "left").select("vec_id", metrics.semantic_match(F.col("embedding"), F.col("next"), 0.1).alias("score"))


@query("select event_type as model, count(*) as n, 1.0::double as precision_answerable, 1.0::double as refusal_recall, 0.9::double as mean_confidence, 0.0::double as mean_latency, 0::bigint as errors from events group by event_type")
def dry_run_report(spark, d):
    """Reports of runs without calls: one model for each type of event, whose events are its questions."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 3 > 0).alias("answerable"), "event_type")
    return runs.calibration(runs.dry_run(e, "m").join(e.select("id", "event_type"), "id").withColumn("model", F.col("event_type")))


@query("select run, arg_min(trial, trial) as stopped_at, 'time' as reason from (select user_id as run, event_id as trial, sum(value) over (partition by user_id order by event_id) as s from events) where s >= 500 group by run union all select user_id, max(event_id), 'completed' from events group by user_id having sum(value) < 500")
def stop_by_time(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("trial"), F.col("value").alias("seconds"))
    return trials.stop_reasons(log, seconds=500.0)


@query("select conv_id as doc, 'tree' as reducer, string_agg(turn::varchar, '' order by turn) as turns from conversations group by conv_id union all select conv_id, 'map_reduce', string_agg(turn::varchar, '' order by turn) from conversations group by conv_id union all select conv_id, 'refine', string_agg(turn::varchar, '' order by turn) from conversations group by conv_id")
def reduce_by_name(spark, d):
    """Three reducers by their names: their merges differ, the turns that went in don't."""
    leaves = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), F.col("turn").cast("string").alias("value"))
    joined = lambda values: F.concat(F.lit("("), F.array_join(values, ","), F.lit(")"))
    options = {"tree": {"merge": joined, "fan": 2}, "map_reduce": {"merge": joined}, "refine": {"start": F.lit(""), "step": lambda a, x: F.concat(a, F.lit("/"), x)}}
    parts = [chunks.reduce_by(name, leaves, **o).select("doc", F.lit(name).alias("reducer"), F.regexp_replace("value", "[^0-9]", "").alias("turns")) for name, o in options.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query(
    """with v as (select vec_id as i, embedding::double[] as x, lead(embedding::double[]) over (order by vec_id) as y from embeddings), n as (select i, i % 5 / 8.0::double as e, i % 3 / 8.0::double as n, i % 7 / 8.0::double as c, case when y is not null then list_cosine_similarity(x, y) end as sim from v),
l as (select *, greatest(e, n, c) as confidence, case when e = greatest(e, n, c) then 'entailment' when n = greatest(e, n, c) then 'neutral' else 'contradiction' end as label from n),
g as (select *, (n >= 0.25 or (label <> 'neutral' and confidence < 0.5)) and coalesce(sim >= 0.05, false) and i % 4 <> 3 as judged from l)
select i as vec_id, case when judged then case i % 4 when 0 then 'entailment' when 1 then 'contradiction' else 'neutral' end else label end as label, case when judged then 0.75 else confidence end::double as confidence, case when judged then 'llm_judge' else 'nli' end as method from g"""
)
def claims_judged(spark, d):
    """Claims whose verdict is unsure and whose evidence is near enough go to a judge; one that doesn't answer changes nothing."""
    v = table(spark, d, "embeddings")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    i = F.col("vec_id")
    rows = v.join(after, "vec_id", "left").select(i, *[(i % m / 8.0).alias(c) for c, m in (("e", 5), ("n", 3), ("c", 7))], F.when(F.col("next").isNotNull(), metrics.cosine(F.col("embedding"), F.col("next"))).alias("near"))
    rows = rows.withColumn("v", verdicts.verdict(F.col("e"), F.col("n"), F.col("c")))
    asked = verdicts.escalates(F.col("v"), F.col("n"), 0.25, 0.5, F.col("near"), 0.05)
    word = F.when(i % 4 == 0, "supported").when(i % 4 == 1, "refuted").when(i % 4 == 2, "neutral").otherwise("unsure")
    return rows.select(i, verdicts.settled(F.col("v"), asked, verdicts.judged(word, F.lit(0.75))).alias("s")).select("vec_id", "s.*")
