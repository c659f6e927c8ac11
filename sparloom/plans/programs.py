"""More named queries: ensembles, promotion, verdicts, passages, taxonomies, caches and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparloom.functions import codecs, metrics, verdicts
from sparloom.operators import cells, chunks, runs, taxonomy, trials, vectors, votes
from sparloom.plans.queries import _KNN, _LOG, _SETS, _log, _near, _records, _sets, query, table
from sparloom.sources.scratch import shared_folder
from sparloom.streaming import runs as streams


@query(_SETS + "select user_id, pr::double as score from m")
def metric_context_precision(spark, d):
    return _sets(spark, d).select("user_id", metrics.set_precision(F.col("p"), F.col("g")).alias("score"))


@query(_SETS + "select user_id, re::double as score from m")
def metric_context_recall(spark, d):
    return _sets(spark, d).select("user_id", metrics.set_recall(F.col("p"), F.col("g")).alias("score"))


@query("select doc, value, votes, members from (select user_id as doc, event_type as value, count(*) as votes, min(event_id) as f, (sum(count(*)) over (partition by user_id))::bigint as members from events group by user_id, event_type) qualify row_number() over (partition by doc order by votes desc, f) = 1")
def ensemble_vote(spark, d):
    return votes.ensemble(table(spark, d, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("pos"), F.col("event_type").alias("value")))


# Trials


@query("with p as (select user_id % 10 as run, event_id as candidate, value as full_, row_number() over (partition by user_id % 10 order by event_id * 7919 % 101 desc, event_id) as r from events qualify r <= 20) select run, candidate, full_ as full, full_ > 95 as accepted from p qualify row_number() over (partition by run order by full_ desc, r) = 1")
def promote_topn(spark, d):
    i = F.col("event_id")
    return trials.promote_top_n(table(spark, d, "events").select((F.col("user_id") % 10).alias("run"), i.alias("candidate"), (i * 7919 % 101).alias("mini"), F.col("value").alias("full"), F.lit(95.0).alias("baseline")), 20)


@query(_LOG[:-2] + " select run, trial from log where after >= 50 and error is null qualify row_number() over (partition by run order by trial) <= 4")
def bootstrap_demos(spark, d):
    return trials.first_demos(_log(spark, d), 50, 4)


@query("select event_type, codec, shots, count(*) as n, round(avg((event_id % 4 >= shots and length(codec) > 3)::int), 6) as mean from events, (select unnest(['json', 'chat', 'xml']) as codec), (select unnest([0, 2, 4]) as shots) group by event_type, codec, shots")
def grid_configs(spark, d):
    """Every combination of codec and shots over the events of each type."""
    configs = trials.grid(spark, {"codec": ["json", "chat", "xml"], "shots": [0, 2, 4]}).withColumn("config", F.struct("codec", "shots"))
    e = table(spark, d, "events")
    kinds = [r["event_type"] for r in e.select("event_type").distinct().collect()]
    score = ((F.col("event_id") % 4 >= F.col("shots")) & (F.length("codec") > 3)).cast("int")
    parts = [trials.evaluate_configs(e.where(F.col("event_type") == k), configs, score).select(F.lit(k).alias("event_type"), "config.codec", "config.shots", "n", "mean") for k in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


# Cells and claims


@query("""with h as (select l_orderkey as doc, l_linestatus as key, min(l_linenumber) as p from lineitem group by all)
select o_orderkey as doc, case when o_orderkey % 5 <> 0 or count(key) > 0 then 'extracted' else 'not_in_document' end as status, concat_ws('|', case when o_orderkey % 5 <> 0 then o_orderstatus end, string_agg(key, '|' order by p, key) filter (where o_orderkey % 5 = 0 or key <> o_orderstatus)) as items,
(count(key) filter (where o_orderkey % 5 = 0 or key <> o_orderstatus))::int as added from orders left join h on doc = o_orderkey group by o_orderkey, o_orderstatus""")
def alpha_merge_list(spark, d):
    known = F.col("o_orderkey") % 5 != 0
    own = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.lit("status").alias("col"), F.when(known, "extracted").otherwise("not_in_document").alias("status"), F.when(known, F.array("o_orderstatus")).alias("values"))
    hits = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.lit("status").alias("col"), F.col("l_linenumber").cast("long").alias("pos"), F.col("l_linestatus").alias("key"))
    return cells.merge_list_hits(own, hits).select("doc", "status", F.array_join("values", "|").alias("items"), "added")


@query("select o_orderstatus, count(*) as n from orders where o_orderdate <= timestamp '1996-06-01' and (o_orderkey % 5 = 0 or timestamp '1996-06-01' < o_orderdate + interval 90 day) group by o_orderstatus")
def claim_valid_at(spark, d):
    o = table(spark, d, "orders")
    end = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate") + F.expr("interval 90 day"))
    return o.where(cells.valid_at(F.col("o_orderdate"), end, F.expr("timestamp_ntz '1996-06-01'"))).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


_NLI = "with n as (select event_id, event_id % 5 / 8.0::double as e, event_id % 3 / 8.0::double as n, event_id % 7 / 8.0::double as c from events), v as (select *, greatest(e, n, c) as confidence, case when e = greatest(e, n, c) then 'entailment' when n = greatest(e, n, c) then 'neutral' else 'contradiction' end as label from n) "


def _verdicts(spark, d):
    i = F.col("event_id")
    scores = table(spark, d, "events").select(i, *[(i % k / 8.0).alias(x) for x, k in (("e", 5), ("n", 3), ("c", 7))])
    return scores.withColumn("v", verdicts.verdict(F.col("e"), F.col("n"), F.col("c")))


@query(_NLI + "select event_id, label, confidence from v")
def nli_verdict(spark, d):
    return _verdicts(spark, d).select("event_id", "v.label", "v.confidence")


@query(_NLI + "select event_id, n >= 0.25 or (label <> 'neutral' and confidence < 0.5) as escalates from v")
def nli_escalation(spark, d):
    return _verdicts(spark, d).select("event_id", verdicts.escalates(F.col("v"), F.col("n"), 0.25, 0.5).alias("escalates"))


@query("""with j as (select event_id, case event_id % 4 when 0 then 'entailment' when 1 then 'contradiction' when 2 then 'neutral' end as label, event_id % 9 / 8.0::double as p from events)
select event_id, label, case when label = 'entailment' then p else (1 - p) / 2 end as entailment, case when label = 'neutral' then p else (1 - p) / 2 end as neutral, case when label = 'contradiction' then p else (1 - p) / 2 end as contradiction from j where label is not null""")
def judge_verdict(spark, d):
    i = F.col("event_id")
    words = F.when(i % 4 == 0, " Supported").when(i % 4 == 1, "refuted").when(i % 4 == 2, "NEUTRAL").otherwise("unsure")
    return table(spark, d, "events").select(i, verdicts.judged(words, i % 9 / 8.0).alias("v")).where("v is not null").select("event_id", "v.*")


@query("select user_id, count(*) filter (where value > 50) / count(*) < 0.5 as refused from events group by user_id")
def refuse_floor(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(verdicts.refused(F.count_if(F.col("value") > 50), F.count("*"), 0.5).alias("refused"))


# Passages and retrieval


def _passages(spark, d):
    t = F.col("turn")
    doc = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.when(t % 5 == 0, "#t").otherwise(""))
    block = F.when(t % 4 == 1, "#/body/0").when(t % 4 == 2, F.concat(F.lit("#/body/"), t.cast("string")))
    uri = chunks.passage_uri(doc, F.col("text"), F.when(t % 7 == 3, F.concat(F.lit("x:"), t.cast("string"))), block, F.when(t % 3 == 0, t * 100))
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), t.alias("pos"), uri.alias("uri"), "text")


_URI = """with p as (select conv_id as doc, turn as pos, text, case when turn % 7 = 3 then 'x:' || turn when turn % 5 = 0 then 'c' || conv_id || '#t' when turn % 4 = 2 then 'c' || conv_id || '#/body/' || turn when turn % 3 = 0 then 'c' || conv_id || '#c' || turn * 100
else 'c' || conv_id || '#h' || substr(sha256(text), 1, 8) end as uri from conversations) """


@query(_URI + "select doc, pos, uri from p")
def passage_uri(spark, d):
    return _passages(spark, d).select("doc", "pos", "uri")


@query(_URI + "select doc, string_agg('=== SOURCE: ' || uri || ' ===' || chr(10) || chr(10) || text, chr(10) || chr(10) order by pos) as context from p group by doc")
def tag_passages(spark, d):
    return chunks.tag_passages(_passages(spark, d))


@query("select query, uri, score from (select user_id % 10 as query, event_id as pos, event_type as uri, case when event_id % 11 = 0 then 0 else least(greatest((value - 20) / 64, 0), 1) end::double as score from events) qualify row_number() over (partition by query order by score desc, pos) <= 5")
def rerank(spark, d):
    score = F.when(F.col("event_id") % 11 != 0, (F.col("value") - 20) / 64)
    return chunks.rerank(table(spark, d, "events").select((F.col("user_id") % 10).alias("query"), F.col("event_id").alias("pos"), F.col("event_type").alias("uri"), score.alias("score")), 5)


@query(_KNN + """, w as (select query_id, label, sum(greatest(score, 0)) as w from n group by all), s as (select query_id, label, w / sum(w) over (partition by query_id) as share from w), r as (select *, row_number() over (partition by query_id order by share desc, label) as k, coalesce(lead(share) over (partition by query_id order by share desc, label), 0) as nxt from s)
select query_id, label as predicted, round(share - nxt, 4) < 0.2 as close_call from r where k = 1""")
def knn_close_call(spark, d):
    near = vectors.knn_classify(_near(spark, d), table(spark, d, "embeddings").select("vec_id", "label"))
    return near.select("query_id", "predicted", (F.col("margin") < 0.2).alias("close_call"))


@query("""with v as (select vec_id, label, embedding::double[] as e from embeddings) select a.vec_id as query_id, b.vec_id, round(list_cosine_similarity(a.e, b.e), 4) as score from v a join v b using (label) where a.vec_id % 20 = 0 and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.2
qualify row_number() over (partition by a.vec_id order by list_cosine_similarity(a.e, b.e) desc, b.vec_id) = 1""")
def semantic_cache_lookup(spark, d):
    v = table(spark, d, "embeddings")
    return vectors.top_k(v.where("vec_id % 20 = 0"), v, 1, within=["label"]).where("score >= 0.2").select("query_id", "vec_id", F.round("score", 4).alias("score"))


# Labels, batches, codecs


@query("""with recursive l as (select r_name as name, null as parent from region union all select n_name, r_name from nation join region on r_regionkey = n_regionkey union all select s_name, n_name from supplier join nation on n_nationkey = s_nationkey),
t as (select name, 0 as depth, name as path from l where parent is null union all select l.name, t.depth + 1, t.path || '/' || l.name from l join t on l.parent = t.name) select name, depth, path, name not in (select parent from l where parent is not null) as leaf from t""")
def taxonomy_paths(spark, d):
    r, n, s = (table(spark, d, x) for x in ("region", "nation", "supplier"))
    labels = r.select(F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"))
    labels = labels.union(n.join(r, F.col("r_regionkey") == F.col("n_regionkey")).select("n_name", "r_name")).union(s.join(n, F.col("n_nationkey") == F.col("s_nationkey")).select("s_name", "n_name"))
    return taxonomy.paths(labels)


@query("select count(*) as n_items, count(*) filter (where event_id % 3 = 0) as n_skipped, count(*) filter (where event_id % 3 <> 0) as n_pending from events")
def resume_counts(spark, d):
    items = table(spark, d, "events").select(F.col("event_id").cast("string").alias("custom_id"))
    return runs.resume_counts(items, _records(spark, d).where(F.col("custom_id").cast("long") % 3 == 0))


@query("select o_orderkey as batch, strftime(o_orderdate, '%Y-%m-%d') as created_at, o_orderstatus as status from orders order by created_at desc, batch limit 50")
def list_batches(spark, d):
    return runs.list_batches(table(spark, d, "orders").select(F.col("o_orderkey").alias("batch"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"), F.col("o_orderstatus").alias("status")))


@query("select event_id, event_type as kind, (props::json ->> '$.k')::bigint as k from events")
def envelope_two_step(spark, d):
    text = F.concat(F.lit('{"kind": "'), "event_type", F.lit('", "payload": '), "props", F.lit("}"))
    return table(spark, d, "events").select("event_id", codecs.decode_envelope(text, "k long").alias("v")).select("event_id", "v.kind", "v.payload.k")


@query("select doc_id, case when length(text) <= 2000 then text else substr(text, 1, 64) || ' ... [TRUNCATED ' || length(text) || ' chars; sha256=' || substr(sha256(text), 1, 16) || ']' end as text from documents")
def env_redact(spark, d):
    return table(spark, d, "documents").select("doc_id", codecs.shorten(F.col("text"), 2000).alias("text"))


# Streams: each is run to the end of its input and its written result read


def _stream(spark, d):
    # a pattern, as a plain path of a stream has to be a folder
    return streams.stream_items(spark, f"{d}/events.parquet*", table(spark, d, "events").schema)


@query("select event_type, count(*) as n, round(sum(value), 2) as total from events group by event_type")
def stream_progress(spark, d):
    out = shared_folder(spark, "progress")
    totals = _stream(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    streams.write_snapshots(totals, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query("select distinct user_id, event_type from events")
def stream_dedup(spark, d):
    out = shared_folder(spark, "dedup")
    streams.write_first(_stream(spark, d).select("user_id", "event_type"), ["user_id", "event_type"], f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query("select event_id::varchar as custom_id, value, case when event_id % 3 = 0 then 'before' else 'stream' end as run from events")
def stream_resume(spark, d):
    out = shared_folder(spark, "resume")
    item = [F.col("event_id").cast("string").alias("custom_id"), "value"]
    table(spark, d, "events").where("event_id % 3 = 0").select(*item, F.lit("before").alias("run")).write.parquet(f"{out}/before")
    done = spark.read.parquet(f"{out}/before")
    streams.run_incrementally(_stream(spark, d).select(*item), lambda fresh: fresh.withColumn("run", F.lit("stream")), f"{out}/rows", f"{out}/checkpoint", done=done).awaitTermination()
    return done.unionByName(spark.read.parquet(f"{out}/rows").drop("batch"))


@query("select event_type, event_id as seq from events qualify row_number() over (partition by event_type order by event_id desc) <= 20")
def stream_fifo_state(spark, d):
    out = shared_folder(spark, "fifo")
    changes = streams.newest_of_key(_stream(spark, d).select("event_type", "event_id"), "event_type", "event_id", 20)
    streams.write_changes(changes, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    last = spark.read.parquet(f"{out}/rows").groupBy("event_type").agg(F.max_by("seqs", "batch").alias("seqs"))
    return last.select("event_type", F.explode("seqs").alias("seq"))
