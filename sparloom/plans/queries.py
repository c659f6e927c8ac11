"""Named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparloom.functions import codecs, extractors, grounding, metrics
from sparloom.operators import cells, chunks, rubric, runs, sentences, trials, vectors, votes
from sparloom.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Sources and the flagship


@query("select doc_id, lang, source, n_chars from documents")
def scan_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")


@query("""with e as (select lang, doc_id % 17 = 0 as failed, (n_chars >= 1000)::int = quality as ok from documents join labels using (doc_id)) select lang, count(*) as n_total, count(*) filter (where ok and not failed) as n_correct, count(*) filter (where failed) as n_errors, round(count(*) filter (where ok and not failed) / count(*), 4) as accuracy, round(count(*) filter (where ok and not failed) / count(*), 4) as mean_score, round(count(*) filter (where failed) / count(*), 4) as error_rate from e group by lang""")
def eval_summary(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")
    score = metrics.exact_match((F.col("n_chars") >= 1000).cast("int"), F.col("quality"))
    return metrics.evaluate(rows, score, ["lang"], error=F.when(F.col("doc_id") % 17 == 0, F.lit("timeout")))


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' order by o_totalprice desc, o_orderkey limit 500")
def sql_entry_tabular(spark, d):
    sql = "select o_orderkey, o_totalprice from $TABLE where o_orderstatus = 'F'"
    return readers.tabular_source(spark, f"{d}/orders.parquet", sql, [F.desc("o_totalprice"), "o_orderkey"], 500)


@query("select conv_id as doc, string_agg(text, chr(10) || chr(10) order by turn) as text from conversations group by conv_id")
def corpus_source(spark, d):
    return readers.corpus_source(table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), "text"))


# Metrics: c_name and market segments in several spellings stand for predictions


def _answers(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(". "))).when(F.col("c_custkey") % 3 == 1, F.lower("c_mktsegment")).when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("p"), F.col("c_mktsegment").alias("g"))


_ANSWERS = "with a as (select c_custkey, case when c_custkey % 3 = 0 then ' ' || lower(c_mktsegment) || '. ' when c_custkey % 3 = 1 then lower(c_mktsegment) when c_custkey % 7 <> 0 then c_mktsegment end as p, c_mktsegment as g from customer) select c_custkey, "
_TEXT_METRICS = {
    "metric_exact_match": (lambda p, g: metrics.exact_match(p, g), "p = g"),
    "metric_case_insensitive": (lambda p, g: metrics.case_insensitive_match(p, g), "lower(p) = lower(g)"),
    "metric_normalized": (lambda p, g: metrics.normalized_match(F.concat(F.lit("\t\n'"), p, F.lit("' \n")), g), "trim(regexp_replace(lower(trim(p)), '[.,;:!?\\s]+$', '')) = lower(g) and not contains(p, '. ')"),
    "metric_contains": (lambda p, g: metrics.contains(p, g), "contains(lower(p), lower(g))"),
    "metric_regex": (lambda p, g: metrics.regex_match(p, "[A-Z]+"), "regexp_full_match(p, '[A-Z]+')"),
}
for _name, (_f, _sql) in _TEXT_METRICS.items():
    QUERIES[_name] = lambda spark, d, f=_f: _answers(spark, d).select("c_custkey", f(F.col("p"), F.col("g")).alias("score"))
    ORACLE[_name] = f"{_ANSWERS} coalesce(({_sql})::int, 0)::double as score from a"


@query("select p_partkey, coalesce((abs(p_retailprice - (900 + p_size)) <= 50)::int, 0)::double as score from part")
def metric_numeric_close(spark, d):
    return table(spark, d, "part").select("p_partkey", metrics.numeric_close(F.col("p_retailprice"), 900 + F.col("p_size"), 50).alias("score"))


@query("select p_partkey, 1 - least(abs(p_retailprice - (900 + p_size)) / greatest(abs(900.0::double + p_size), 1.0), 1.0) as score from part")
def metric_numeric_ratio(spark, d):
    return table(spark, d, "part").select("p_partkey", metrics.numeric_ratio(F.col("p_retailprice"), 900 + F.col("p_size")).alias("score"))


@query("select event_id, ((props::json ->> '$.k') = (event_id % 100)::varchar)::int::double as score from events")
def metric_json_field(spark, d):
    gold = F.to_json(F.struct((F.col("event_id") % 100).alias("k")))
    return table(spark, d, "events").select("event_id", metrics.json_field_match(F.col("props"), gold, "k").alias("score"))


def _sets(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.collect_list(F.when(F.col("value") > 60, F.col("event_type"))).alias("p"), F.collect_list(F.when(F.col("event_id") % 4 == 0, F.col("event_type"))).alias("g"))


_SETS = """with s as (select user_id, coalesce(list_distinct(list(event_type) filter (where value > 60)), []) as p, coalesce(list_distinct(list(event_type) filter (where event_id % 4 = 0)), []) as g from events group by user_id),
m as (select user_id, case when len(p) > 0 then len(list_intersect(p, g)) / len(p) else 0 end as pr, case when len(g) > 0 then len(list_intersect(p, g)) / len(g) else 0 end as re from s) """


@query(_SETS + "select user_id, pr::double as set_precision, re::double as set_recall, case when pr + re > 0 then 2 * pr * re / (pr + re) else 0 end::double as f1 from m")
def metric_prf_set(spark, d):
    p, g = F.col("p"), F.col("g")
    pr, re = metrics.set_precision(p, g), metrics.set_recall(p, g)
    return _sets(spark, d).select("user_id", pr.alias("set_precision"), re.alias("set_recall"), metrics.f1(pr, re).alias("f1"))


@query("""with c as (select user_id, event_type, count(*) filter (where value > 60) as cp, count(*) filter (where event_id % 4 = 0) as cg from events group by all)
select user_id, sum(least(cp, cg))::bigint as tp, (sum(cp) - sum(least(cp, cg)))::bigint as fp, (sum(cg) - sum(least(cp, cg)))::bigint as fn from c group by user_id""")
def metric_prf_multiset(spark, d):
    return metrics.multiset_counts(table(spark, d, "events"), ["user_id"], "event_type", F.col("value") > 60, F.col("event_id") % 4 == 0)


@query(_SETS + "select user_id, pr::double as context_precision, re::double as context_recall, (pr * 0.5 + re * 0.25 + 0.25)::double as composite from m")
def metric_ragas_composite(spark, d):
    parts = _sets(spark, d).select("user_id", metrics.set_precision(F.col("p"), F.col("g")).alias("context_precision"), metrics.set_recall(F.col("p"), F.col("g")).alias("context_recall"), F.lit(1.0).alias("faithfulness"))
    return parts.select("user_id", "context_precision", "context_recall", metrics.weighted_composite({"context_precision": 2, "context_recall": 1, "faithfulness": 1}).alias("composite"))


@query("""with t as (select user_id, count(*) filter (where value > 60 and event_id % 4 = 0) / greatest(count(*) filter (where value > 60), 1) as a, count(*) filter (where value > 30 and event_id % 4 = 0) / greatest(count(*) filter (where value > 30), 1) as b from events group by user_id)
select user_id, round(b - a, 4) as lift from t""")
def metric_expansion_lift(spark, d):
    return metrics.precision_lift(table(spark, d, "events"), ["user_id"], F.col("value") > 60, F.col("value") > 30, F.col("event_id") % 4 == 0)


@query("select event_type, round(count(*) filter (where value < 10) / count(*), 4) as refusal_rate from events group by event_type")
def metric_refusal_rate(spark, d):
    return metrics.refusal_rate(table(spark, d, "events"), ["event_type"], F.col("value") < 10)


@query("select quality as gold, (n_chars >= 1000)::int as predicted, count(*) as n from documents join labels using (doc_id) group by all")
def confusion_matrix(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return metrics.confusion(rows, "quality", (F.col("n_chars") >= 1000).cast("int"))


@query("""with c as (select quality as g, (n_chars >= 1000)::int as p from documents join labels using (doc_id)), l as (select unnest([0, 1]) as label),
f as (select label, count(*) filter (where g = label and p = label) as tp, count(*) filter (where g <> label and p = label) as fp, count(*) filter (where g = label and p <> label) as fn from c, l group by label)
select round(avg(case when tp > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end), 4) as macro_f1, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 4) as micro_f1 from f""")
def f1_macro_micro(spark, d):
    return metrics.f1_scores(confusion_matrix(spark, d))


# Votes: users are documents, events chunks, event types labels


def _picks(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("doc"), (F.col("event_id") % 5).alias("chunk"), F.col("event_id").alias("pos"), F.col("event_type").alias("label"), F.col("value").alias("score"), (1 + F.col("event_id") % 3).alias("weight"))


_PICKS = "with picks as (select user_id as doc, event_id % 5 as chunk, event_id as pos, event_type as label, value as score, 1 + event_id % 3 as weight from events), v as (select doc, label, count(*) as votes, min(pos) as f from picks group by all), w as (select doc, label, votes from v qualify row_number() over (partition by doc order by votes desc, f) = 1) "


@query(_PICKS + "select doc, label, votes from w")
def agg_vote(spark, d):
    return votes.vote(_picks(spark, d))


@query("""with v as (select user_id as doc, event_type as label, count(*) as votes, min(event_id) as f from events group by user_id, event_type), c as (select *, sum(votes) over (partition by doc) as n from v)
select doc, case when votes >= 0.26 * n then label end as label, votes < 0.26 * n as abstained from c qualify row_number() over (partition by doc order by votes desc, f) = 1""")
def agg_majority(spark, d):
    return votes.majority(_picks(spark, d).withColumn("chunk", F.col("pos")), 0.26)


_LABELS = ["view", "signup", "purchase", "click"]  # error is no label


@query("select user_id as doc, concat_ws(',', case when bool_or(event_type = 'view') then 'view' end, case when bool_or(event_type = 'signup') then 'signup' end, case when bool_or(event_type = 'purchase') then 'purchase' end, case when bool_or(event_type = 'click') then 'click' end) as labels from events group by user_id")
def agg_union(spark, d):
    return votes.aggregate(_picks(spark, d), exclusive=False, labels=_LABELS)


@query("""with v as (select user_id, event_type as label, count(*) as n, min(event_id) as f from events group by user_id, event_type), c as (select * from v qualify row_number() over (partition by user_id order by n desc, f) = 1)
select user_id as doc, case when label <> 'error' then label end as label, label = 'error' as abstained from c""")
def agg_abstain(spark, d):
    won = votes.vote(_picks(spark, d))
    return won.select("doc", *votes.decided(F.col("label"), _LABELS)).select("doc", F.get("labels", F.lit(0)).alias("label"), "abstained")


@query("select doc, label, weight from (select user_id as doc, event_type as label, sum(1 + event_id % 3)::bigint as weight, min(event_id) as f from events group by user_id, event_type) qualify row_number() over (partition by doc order by weight desc, f) = 1")
def agg_weighted_exclusive(spark, d):
    return votes.weighted(_picks(spark, d), exclusive=True)


@query("select user_id as doc, event_type as label, max(value) as score from events group by all having max(value) >= 95")
def agg_max_score_multi(spark, d):
    return votes.max_score(_picks(spark, d), 95, exclusive=False)


@query("""with p as (select user_id, event_id % 5 as chunk, min(event_id) as f from events group by all), s as (select distinct user_id, 'd' || user_id % 3 as source, (event_id % 40)::int as a from events where event_id % 4 = 0),
h as (select user_id, event_type, count(*) as n from events group by all)
select user_id as doc, (select string_agg(chunk, ',' order by f) from p where p.user_id = u.user_id) as chunks_used, (select count(*) from p where p.user_id = u.user_id) as input_chunks,
coalesce((select string_agg(source || ':' || a, ',' order by a) from s where s.user_id = u.user_id), '') as spans, (select string_agg(event_type || '=' || n, ',' order by event_type) from h where h.user_id = u.user_id) as picked from (select distinct user_id from events) u""")
def agg_provenance(spark, d):
    at = F.when(F.col("pos") % 4 == 0, (F.col("pos") % 40).cast("int"))
    pooled = votes.provenance(_picks(spark, d).select("*", F.concat(F.lit("d"), (F.col("doc") % 3).cast("string")).alias("source"), at.alias("start"), (at + 5).alias("end")))
    spans = F.transform("spans", lambda s: F.concat(s["source"], F.lit(":"), s["start"].cast("string")))
    picked = F.transform(F.map_entries("picked"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return pooled.select("doc", F.array_join("chunks_used", ",").alias("chunks_used"), "input_chunks", F.array_join(spans, ",").alias("spans"), F.array_join(picked, ",").alias("picked"))


@query(_PICKS + "select doc, label from (select doc, label, count(distinct chunk) as k from picks group by all) join (select doc, count(distinct chunk) as n from picks group by doc) using (doc) where k = n")
def agg_intersection(spark, d):
    return votes.intersection(_picks(spark, d))


@query(_PICKS + "select doc, label, weight from (select doc, label, sum(weight)::bigint as weight from picks group by all) join (select doc, sum(weight) as n from picks group by doc) using (doc) where weight >= 0.25 * n")
def agg_weighted(spark, d):
    return votes.weighted(_picks(spark, d), 0.25)


@query(_PICKS + "select doc, label, score from (select doc, label, max(score) as score, min(pos) as f from picks group by all) qualify row_number() over (partition by doc order by score desc, f) = 1")
def agg_max_score(spark, d):
    return votes.max_score(_picks(spark, d))


@query(_PICKS + "select doc, label, count(*) as n from picks group by all")
def agg_histogram(spark, d):
    return votes.histogram(_picks(spark, d))


# Trials: events are trials of the run user_id % 10


def _log(spark, d):
    e = table(spark, d, "events")
    return e.select((F.col("user_id") % 10).alias("run"), F.col("event_id").alias("trial"), F.col("event_type").alias("strategy"), (F.get_json_object("props", "$.k").cast("int") + 0.0).alias("before"), F.col("value").alias("after"), (F.col("event_id") % 7 / 4.0).alias("cost"), (F.col("event_id") % 13).alias("tokens"), (F.col("event_id") % 3 == 0).alias("accepted"), F.when(F.col("event_id") % 11 == 0, F.col("event_type")).alias("error"), F.col("props").alias("message"))


_LOG = "with log as (select user_id % 10 as run, event_id as trial, event_type as strategy, (props::json ->> '$.k')::double as before, value as after, event_id % 7 / 4.0::double as cost, event_id % 13 as tokens, event_id % 3 = 0 as accepted, case when event_id % 11 = 0 then event_type end as error, props as message from events), "
_BEST = "b as (select run, trial, after, coalesce(after > max(after) over (partition by run order by trial rows between unbounded preceding and 1 preceding), true) as improves from log) "


@query(_LOG[:-2] + " select strategy, count(*) as trials, count(*) filter (where after > before) as wins, round(coalesce(sum(after - before) filter (where after > before), 0), 4) as gain, round(avg(cost), 4) as mean_cost from log group by strategy")
def strategy_contributions(spark, d):
    return trials.strategy_contributions(_log(spark, d))


@query(_LOG[:-2] + " select run, count(*) as trials, count(*) filter (where accepted) as accepted, round(sum(cost), 4) as cost, sum(tokens)::bigint as tokens, max(after) as best, greatest(0, max(after - before)) as best_improvement from log group by run")
def run_summary(spark, d):
    return trials.run_summary(_log(spark, d))


@query(_LOG[:-2] + " select run, error, count(*) as n, substr(arg_min(message, trial), 1, 120) as sample from log where error is not null group by run, error qualify row_number() over (partition by run order by count(*) desc, error) = 1")
def dominant_error(spark, d):
    return trials.dominant_error(_log(spark, d))


@query(_LOG + _BEST + "select * from b")
def best_so_far(spark, d):
    return trials.best_so_far(_log(spark, d))


@query(_LOG + _BEST + ", i as (select *, sum(improves::int) over (partition by run order by trial) as island from b), m as (select *, sum((not improves)::int) over (partition by run, island order by trial) as k from i) select run, min(trial) as stopped_at from m where k >= 5 group by run")
def patience_stop(spark, d):
    return trials.patience_stop(_log(spark, d), 5)


@query(_LOG + "s as (select *, sum(cost) over (partition by run order by trial) as spent from log) select run, min(trial) as stopped_at from s where spent >= 20 group by run")
def budget_stop(spark, d):
    return trials.budget_stop(_log(spark, d), 20)


@query(_LOG + "s as (select *, count(error) over (partition by run order by trial) as n from log) select run, min(trial) as stopped_at from s where n >= 3 group by run")
def stop_after_n(spark, d):
    return trials.stop_after_errors(_log(spark, d), 3)


@query(_LOG[:-2] + " select run, trial, (row_number() over (partition by run order by trial) - 1)::int as card, coalesce(lag(trial) over (partition by run order by trial), -1) as parent from log")
def mutation_chain(spark, d):
    return trials.mutation_chain(_log(spark, d))


@query("select p_partkey, p_size, p_retailprice from part a where not exists (select 1 from part b where b.p_size >= a.p_size and b.p_retailprice <= a.p_retailprice and (b.p_size > a.p_size or b.p_retailprice < a.p_retailprice))")
def pareto_frontier(spark, d):
    return trials.pareto_frontier(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_retailprice")


_SCORES = "with s as (select o_custkey as task, o_orderpriority as model, max(o_totalprice) as score, min(o_orderkey) as cost, min(o_orderkey) as ord from orders group by all) "


def _scores(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("task"), F.col("o_orderpriority").alias("model")).agg(F.max("o_totalprice").alias("score"), F.min("o_orderkey").alias("cost"), F.min("o_orderkey").alias("ord"))


@query(_SCORES + "select task, model, score, cost from s qualify row_number() over (partition by task order by score >= 200000 desc, case when score >= 200000 then cost end, case when not score >= 200000 then -score end, ord) = 1")
def model_select(spark, d):
    return trials.select_model(_scores(spark, d), 200_000)


@query(_LOG + "m as (select run, strategy, round(avg(after), 4) as mean from log group by all) select * from m where strategy <> 'view' qualify row_number() over (partition by run order by mean desc, strategy) = 1")
def promote_best_mean(spark, d):
    log = _log(spark, d)
    return trials.promote_best_mean(log, log.where("strategy = 'view'").select("run", "strategy").distinct())


@query(_LOG + """r as (select *, row_number() over (partition by run order by after desc, trial) as k, count(*) over (partition by run) as n from log), s as (select *, k <= least(ceil(n * 0.25), n - 1) as good from r),
z as (select run, count(*) filter (where good) as g, count(*) filter (where not good) as b from s group by run), c as (select run, strategy, count(*) filter (where good) as cg, count(*) filter (where not good) as cb from s group by all), t as (select count(distinct strategy) as k from log)
select run, strategy, round((cg + 1.0) / (g + k * 1.0), 6)::double as good, round((cb + 1.0) / (b + k * 1.0), 6)::double as bad from c join z using (run), t""")
def tpe_density(spark, d):
    return trials.tpe_density(_log(spark, d))


# Costs and runs


def _nodes(spark, d):
    c = table(spark, d, "conversations")
    calls = c.select(F.col("conv_id").alias("root"), F.concat_ws("-", "conv_id", "turn").alias("trace"), F.col("conv_id").cast("string").alias("parent"), F.length("text").cast("long").alias("tokens"), (F.length("text") / 8.0).alias("cost"))
    roots = c.select(F.col("conv_id").alias("root"), F.col("conv_id").cast("string").alias("trace"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("tokens"), F.lit(0.0).alias("cost")).distinct()
    return calls.union(roots)


@query("select conv_id as root, count(*) as leaves, sum(length(text))::bigint as tokens, round(sum(length(text) / 8.0::double), 4) as cost from conversations group by conv_id")
def trace_flatten_rollup(spark, d):
    return runs.trace_rollup(_nodes(spark, d))


@query("""select role, count(*) as calls, round(sum(case role when 'user' then length(text) * 2.0 + turn * 6.0 when 'assistant' then length(text) * 8.0 + turn * 24.0 else 0 end / 1e6)::double, 6) as cost from conversations group by role""")
def cost_by_model(spark, d):
    prices = spark.createDataFrame([("small", ["user"], 2.0, 6.0), ("large", ["assistant", "big"], 8.0, 24.0)], "model string, aliases array<string>, price_in double, price_out double")
    calls = table(spark, d, "conversations").select("role", F.concat(F.lit("acme/"), "role").alias("model"), F.length("text").alias("tokens_in"), F.col("turn").alias("tokens_out"))
    return runs.with_prices(calls, prices).groupBy("role").agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 6).alias("cost"))


def _records(spark, d):
    return table(spark, d, "events").select(F.col("event_id").cast("string").alias("custom_id"), F.when(F.col("event_type") == "error", "error").otherwise("succeeded").alias("status"), F.lit(None).cast("string").alias("output"), F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, "timeout").otherwise("other")).alias("error_type"), (F.col("event_id") % 9).alias("tokens"), (F.col("event_id") % 8 / 8.0).alias("cost"))


@query("select count(*) as n_total, count(*) filter (where event_type <> 'error') as n_succeeded, count(*) filter (where event_type = 'error') as n_errors, sum(event_id % 9)::bigint as tokens, round(sum(event_id % 8 / 8.0::double), 4) as cost from events")
def manifest(spark, d):
    return runs.manifest(_records(spark, d))


@query("select case when event_id % 2 = 0 then 'timeout' else 'other' end as error_type, count(*) as n from events where event_type = 'error' group by all")
def errors_by_type(spark, d):
    return runs.errors_by_type(_records(spark, d))


@query("select event_id::varchar as custom_id, value from events where event_id % 3 <> 0")
def resume_skip(spark, d):
    items = table(spark, d, "events").select(F.col("event_id").cast("string").alias("custom_id"), "value")
    return runs.pending(items, _records(spark, d).where(F.col("custom_id").cast("long") % 3 == 0))


@query("select event_id, substr(sha256('event_type=' || event_type || chr(31) || 'props=' || props || chr(31) || 'p1'), 1, 16) as custom_id from events")
def deterministic_id(spark, d):
    return table(spark, d, "events").select("event_id", runs.content_id(["event_type", "props"], "p1").alias("custom_id"))


@query("select event_type, event_id as seq, value from events qualify row_number() over (partition by event_type order by event_id desc) <= 20")
def fifo_evict(spark, d):
    return runs.evict_fifo(table(spark, d, "events").select("event_type", F.col("event_id").alias("seq"), "value"), 20, ["event_type"])


@query("""with c as (select user_id, event_type, arg_max(value, event_id) as result from events where event_id % 2 = 0 group by all) select event_id, user_id, event_type, result from events join c using (user_id, event_type) where event_id % 2 = 1""")
def cache_lookup(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    cache = e.where("event_id % 2 = 0").select("user_id", "event_type", F.col("event_id").alias("seq"), F.col("value").alias("result"))
    return runs.cache_lookup(e.where("event_id % 2 = 1").drop("value"), cache, ["user_id", "event_type"])[0]


@query("""with r as (select event_type as model, event_id % 3 <> 0 as answerable, case when value < 15 then 'insufficient_evidence' when event_id % 10 = 9 then 'error' else 'answer' end as outcome, event_id % 4 = 1 as verified, event_id % 16 / 16.0::double as confidence, value as latency from events)
select model, count(*) as n, round(count(*) filter (where answerable and outcome = 'answer' and verified) / count(*) filter (where answerable), 4) as precision_answerable, round(count(*) filter (where not answerable and outcome = 'insufficient_evidence') / count(*) filter (where not answerable), 4) as refusal_recall,
round(avg(confidence) filter (where outcome = 'answer'), 4) as mean_confidence, round(avg(latency), 4) as mean_latency, count(*) filter (where outcome = 'error') as errors from r group by model""")
def calibration_report(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    outcome = F.when(F.col("value") < 15, "insufficient_evidence").when(i % 10 == 9, "error").otherwise("answer")
    return runs.calibration(e.select(F.col("event_type").alias("model"), (i % 3 != 0).alias("answerable"), outcome.alias("outcome"), (i % 4 == 1).alias("verified"), (i % 16 / 16.0).alias("confidence"), F.col("value").alias("latency")))


# Cells: orders are documents

_COLUMNS = ["o_orderstatus", "o_orderpriority", "o_custkey"]


def _cells(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("o_orderstatus"), "o_orderpriority", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("o_custkey"))
    return cells.project_cells(rows, "o_orderkey", _COLUMNS)


_CELLS = """with cells as (select o_orderkey as doc, col, case when value is null then 'not_in_document' else 'extracted' end as status, value from (
select o_orderkey, unnest(['o_orderstatus', 'o_orderpriority', 'o_custkey']) as col, unnest([case when o_orderkey % 5 <> 0 then o_orderstatus end, o_orderpriority, case when o_orderkey % 7 <> 0 then o_custkey::varchar end]) as value from orders)) """


@query(_CELLS + "select * from cells")
def project_cells(spark, d):
    return _cells(spark, d)


@query("select o_orderkey as doc, case when o_orderkey % 5 <> 0 then o_orderstatus end as o_orderstatus, o_orderpriority, case when o_orderkey % 7 <> 0 then o_custkey::varchar end as o_custkey from orders")
def pivot_cells(spark, d):
    return cells.pivot_cells(_cells(spark, d), _COLUMNS)


# amounts, days and names in several spellings; what is equal in truth has one number

_SPELLINGS = """with b as (select o_orderkey as doc, o_custkey % 40 as k, o_orderkey % 3 as s, o_orderkey % 11 = 0 as gone from orders),
c as (select doc, 0 as n, 'amount' as col, k + 1 || '.50:USD' as truth, case s when 0 then '$' || (k + 1) || '.50' when 1 then (k + 1) || '.50 USD' else (k + 1) || '.50' end as value, gone from b
union all select doc, 1, 'day', '2020-05-' || lpad((k % 28 + 1)::varchar, 2, '0'), case s when 0 then '2020-05-' || lpad((k % 28 + 1)::varchar, 2, '0') when 1 then '5/' || (k % 28 + 1) || '/2020' else 'May ' || (k % 28 + 1) || ', 2020' end, gone from b
union all select doc, 2, 'name', 'firm' || k, case s when 0 then ' Firm' || k || ', Inc.' when 1 then 'FIRM' || k || ' LLC' else 'firm' || k end, gone from b
union all select doc, 3, 'term', (k + 1) * 86400 || '', case s when 0 then (k + 1) || ' days' when 1 then (k + 1) || ' day' else (k + 1) * 24 || ' hours' end, gone from b),
m as (select *, case when not gone then min(doc * 10 + n) over (partition by col, truth, gone) end as first from c) """


def _spellings(spark, d):
    k, s = F.col("o_custkey") % 40, F.col("o_orderkey") % 3
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    n, day = (k + 1).cast("string"), (k % 28 + 1).cast("string")
    three = lambda a, b, c: F.when(s == 0, a).when(s == 1, b).otherwise(c)
    values = {
        "amount": three(text("$", n, ".50"), text(n, ".50 USD"), text(n, ".50")), "day": three(text("2020-05-", F.lpad(day, 2, "0")), text("5/", day, "/2020"), text("May ", day, ", 2020")),
        "name": three(text(" Firm", k.cast("string"), ", Inc."), text("FIRM", k.cast("string"), " LLC"), text("firm", k.cast("string"))), "term": three(text(n, " days"), text(n, " day"), text(((k + 1) * 24).cast("string"), " hours")),
    }
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), *[F.when(F.col("o_orderkey") % 11 != 0, v).alias(c) for c, v in values.items()])
    long = cells.project_cells(rows, "doc", list(values))
    place = F.create_map(*[F.lit(x) for i, c in enumerate(values) for x in (c, i)])
    return long.withColumn("pos", F.col("doc") * 10 + place[F.col("col")])


_KINDS = {"amount": "money", "day": "date", "name": "entity", "term": "duration"}


def _typed(spark, d):
    columns = spark.createDataFrame(list(_KINDS.items()), "col string, kind string")
    return cells.with_columns(_spellings(spark, d), columns), cells.canonical_value(F.col("value"), F.col("kind"))


@query(_SPELLINGS + "select doc, col, case when gone then 'not_in_document' else 'extracted' end as status, case when not gone then value end as value, doc * 10 + n as pos from m where gone or first = doc * 10 + n")
def dedup_cells(spark, d):
    return cells.dedup_cells(*_typed(spark, d))[0].drop("kind")


@query(_SPELLINGS + "select col, min(doc) as first_doc, count(*) as n from m where not gone group by col, truth")
def dedup_lineage(spark, d):
    return cells.dedup_cells(*_typed(spark, d))[1].drop("hash")


@query(_SPELLINGS + "select col, count(distinct doc) as docs, sum(distinct doc)::bigint as doc_sum from m where not gone group by col, truth")
def lineage_documents(spark, d):
    return cells.lineage_documents(*_typed(spark, d)).groupBy("col", "hash").agg(F.count("*").alias("docs"), F.sum("doc").alias("doc_sum")).drop("hash")


@query(_CELLS + ", g as (select *, max((status <> 'extracted')::int) over (partition by doc) = 1 as gone from cells) select doc, col, case when gone then 'refused' else status end as status, case when not gone then value end as value from g")
def refusal_policy_row(spark, d):
    return cells.refusal_policy(_cells(spark, d))


@query(_CELLS + """, hits as (select l_orderkey as doc, 'o_orderstatus' as col, l_linestatus as key from lineitem), k as (select doc, col, key, count(*) as n from hits group by all), s as (select doc, col, count(*) as kinds, min(key) as only_ from k group by all)
select c.doc, c.col, case when c.status <> 'extracted' and kinds = 1 then 'extracted' else c.status end as status, case when c.status <> 'extracted' and kinds = 1 then only_ else c.value end as value, case when c.status <> 'extracted' and kinds = 1 then 0.8 else 1.0 end::double as confidence,
coalesce(case when c.status = 'extracted' and n is not null then least(n, 5) end, 0)::bigint as cited from cells c left join k on c.doc = k.doc and c.col = k.col and c.value = k.key left join s on c.doc = s.doc and c.col = s.col""")
def alpha_merge_scalar(spark, d):
    hits = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.lit("o_orderstatus").alias("col"), F.col("l_linestatus").alias("key"))
    return cells.merge_hits(_cells(spark, d), hits)


@query("select l_orderkey as doc, 'flag' as col, arg_min(l_returnflag, row(l_linenumber, l_returnflag)) as value, 0.7::double as confidence, count(distinct l_returnflag) as n from lineitem group by l_orderkey")
def chunk_retry_promote(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.lit("flag").alias("col"), F.col("l_linenumber").alias("chunk"), F.col("l_returnflag").alias("value"))
    return cells.promote_retries(rows)


# Grounding: quotes are cut from documents, some of them moved, altered or re-cased


def _quotes(spark, d):
    i, t = F.col("doc_id"), F.col("text")
    cut = F.substring(t, 11, 40)
    quote = F.when(i % 6 == 0, cut).when(i % 6 == 1, F.substring(t, 14, 40)).when(i % 6 == 2, F.translate(cut, string.ascii_lowercase, string.ascii_uppercase)).when(i % 6 == 3, F.replace(F.replace(cut, F.lit(" "), F.lit("\u00a0 ")), F.lit("fi"), F.lit("\ufb01"))).when(i % 6 == 4, F.concat(F.substring(t, 11, 36), F.lit("#@%&"))).otherwise(F.concat(F.lit("no such quote "), i.cast("string")))
    return table(spark, d, "documents").select("doc_id", "text", F.lit(10).alias("s"), F.lit(50).alias("e"), quote.alias("quote"))


_QUOTES = """with q as (select doc_id, text, case doc_id % 6 when 0 then substr(text, 11, 40) when 1 then substr(text, 14, 40) when 2 then translate(substr(text, 11, 40), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') when 3 then replace(replace(substr(text, 11, 40), ' ', chr(160) || ' '), 'fi', chr(64257)) when 4 then substr(text, 11, 36) || '#@%&' else 'no such quote ' || doc_id end as quote from documents) """


@query(_QUOTES + "select doc_id, length(text) >= 50 and substr(text, 11, 40) = quote as ok from q")
def span_strict(spark, d):
    return _quotes(spark, d).select("doc_id", grounding.strict(F.col("text"), F.col("s"), F.col("e"), F.col("quote")).alias("ok"))


@query(_QUOTES + "select doc_id, contains(text, quote) as ok from q")
def span_substring(spark, d):
    return _quotes(spark, d).select("doc_id", F.contains("text", "quote").alias("ok"))


@query(_QUOTES + "select doc_id, contains(lower(text), lower(quote)) as ok from q")
def span_casefold(spark, d):
    return _quotes(spark, d).select("doc_id", F.contains(F.lower("text"), F.lower("quote")).alias("ok"))


_TOKENS = "list_filter(list_transform(string_split(trim(regexp_replace(replace(lower(replace({0}, chr(160), ' ')), chr(64257), 'fi'), '\\s+', ' ', 'g')), ' '), lambda w: regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')), lambda w: w <> '')"
_T, _Q = _TOKENS.format("text"), _TOKENS.format("quote")


@query(_QUOTES + f"select doc_id, len({_Q}) > 0 and contains(' ' || array_to_string({_T}, ' ') || ' ', ' ' || array_to_string({_Q}, ' ') || ' ') as ok from q")
def span_normalized_token(spark, d):
    return _quotes(spark, d).select("doc_id", grounding.normalized_token(F.col("text"), F.col("quote")).alias("ok"))


@query(_QUOTES + f"select doc_id, len(list_intersect({_T}, {_Q})) / len(list_distinct(list_concat({_T}, {_Q}))) as score from q")
def span_fuzzy_token(spark, d):
    return _quotes(spark, d).select("doc_id", grounding.token_jaccard(F.col("text"), F.col("quote")).alias("score"))


_COMMON = "coalesce((select max(n) from (select unnest(range(1, length(quote) + 1)) as i) a, (select unnest(range(1, 41)) as n) b where i + n - 1 <= length(quote) and contains(text, substr(quote, i, n))), 0)"
_VERDICT = f"""case when text is null then 'source_missing' when length(text) >= 50 and substr(text, 11, 40) = quote then 'strict' when contains(text, quote) then 'substring' when contains(lower(text), lower(quote)) then 'case_insensitive'
when len({_Q}) > 0 and contains(' ' || array_to_string({_T}, ' ') || ' ', ' ' || array_to_string({_Q}, ' ') || ' ') then 'normalized_token' when length(quote) > 0 and {_COMMON} / length(quote) >= 0.8 then 'fuzzy_char'
when len(list_intersect({_T}, {_Q})) / greatest(len(list_distinct(list_concat({_T}, {_Q}))), 1) >= 0.8 then 'fuzzy_token' else 'similarity_below_threshold' end"""


@query(_QUOTES + f"select doc_id, {_VERDICT} as verdict from q")
def span_cascade(spark, d):
    return _quotes(spark, d).select("doc_id", grounding.verify(F.col("text"), F.col("s"), F.col("e"), F.col("quote")).alias("verdict"))


@query(_QUOTES + f"select doc_id, coalesce(case when length(quote) > 0 then round({_COMMON} / length(quote), 4) end, 0)::double as score from q")
def span_fuzzy_char(spark, d):
    return _quotes(spark, d).select("doc_id", F.round(grounding.fuzzy_char(F.col("text"), F.col("quote")), 4).alias("score"))


@query(_QUOTES + "select doc_id, case when text is null or doc_id % 5 = 0 then 'source_missing' when substr(text, 11, 40) = quote and length(text) >= 50 then 'strict' when length(text) < 50 then 'out_of_range' else 'quote_mismatch' end as verdict from q")
def span_sources(spark, d):
    uri = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    corpus = table(spark, d, "documents").where("doc_id % 5 <> 0").select(uri.alias("source_uri"), "text")
    spans = _quotes(spark, d).select("doc_id", uri.alias("source_uri"), F.col("s").alias("start"), F.col("e").alias("end"), "quote")
    return grounding.verify_spans(spans, corpus, strategies=("strict",)).select("doc_id", "verdict")


@query(_QUOTES + f"select doc_id, coalesce(length(text) >= 50 and substr(text, 11, 40) = quote, false) as strict, coalesce(contains(text, quote), false) as substring, coalesce({_COMMON} / length(quote) >= 0.8 and length(quote) > 0, false) as fuzzy_char from q")
def span_diagnostics(spark, d):
    m = grounding.diagnostics(F.col("text"), F.col("s"), F.col("e"), F.col("quote"))
    return _quotes(spark, d).select("doc_id", m.alias("m")).select("doc_id", *[F.col("m")[k].alias(k) for k in ("strict", "substring", "fuzzy_char")])


@query("select item_id, substr(sha256(text), 1, 16) as quote_hash from benchmark")
def quote_hash(spark, d):
    return table(spark, d, "benchmark").select("item_id", grounding.quote_hash(F.col("text")).alias("quote_hash"))


@query(_QUOTES + ", c as (select doc_id % 50 as answer, doc_id % 100 as claim, bool_and(coalesce(contains(lower(text), lower(quote)), false)) as ok from q group by all), s as (select answer, avg(ok::int) as share from c group by answer) select i as answer, round(case when i % 7 = 0 then 1 else coalesce(share, 0) end, 4)::double as faithfulness from range(60) r(i) left join s on i = answer")
def claim_faithfulness(spark, d):
    spans = _quotes(spark, d).select((F.col("doc_id") % 50).alias("answer"), (F.col("doc_id") % 100).alias("claim"), F.contains(F.lower("text"), F.lower("quote")).alias("ok"))
    return metrics.faithfulness(spans, spark.range(60).select(F.col("id").alias("answer"), (F.col("id") % 7 == 0).alias("refused")))


# Rubrics and routing

_CRITERIA = [rubric.Criterion("o_totalprice", "gt", 150_000.0, 0.5), rubric.Criterion("o_orderstatus", "in", ["F", "O"], 0.25), rubric.Criterion("o_orderpriority", "contains", "URGENT", -0.25), rubric.Criterion("o_orderstatus", "neq", "P", 0.5), rubric.Criterion("o_custkey", "truthy", None, 0.125)]
_HARD = "((case when o_totalprice > 150000 then 0.5 else 0 end + case when o_orderstatus in ('F', 'O') then 0.25 else 0 end + case when contains(o_orderpriority, 'URGENT') then -0.25 else 0 end + case when o_orderstatus <> 'P' then 0.5 else 0 end + case when o_custkey <> 0 then 0.125 else 0 end)::double / 1.625::double + 1) / 2"


@query(f"select o_orderkey, {_HARD} as score from orders")
def rubric_hard_score(spark, d):
    return table(spark, d, "orders").select("o_orderkey", rubric.hard_score(_CRITERIA).alias("score"))


@query(f"select o_orderkey, round(least(greatest({_HARD} * 0.75 + coalesce(case when o_orderkey % 3 = 0 then 0.25 end, 0.5) * 0.25, 0), 1), 4)::double as score from orders")
def rubric_aggregate(spark, d):
    soft = F.when(F.col("o_orderkey") % 3 == 0, F.lit(0.25))
    return table(spark, d, "orders").select("o_orderkey", F.round(rubric.aggregate_score(rubric.hard_score(_CRITERIA), soft, 0.75, 0.25), 4).alias("score"))


@query("select o_orderkey, case when o_orderpriority = '1-URGENT' and o_orderstatus = 'O' then 'large' when o_totalprice > 200000 then 'medium' else 'small' end as model from orders")
def rule_router(spark, d):
    rules = [((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O"), "large"), (F.col("o_totalprice") > 200_000, "medium")]
    return table(spark, d, "orders").select("o_orderkey", rubric.route(rules, "small").alias("model"))


@query("select o_orderkey, case when o_orderkey % 4 <> 0 and o_totalprice < 50000 then 'small' when o_totalprice < 150000 then 'medium' else 'large' end as model, case when o_orderkey % 4 <> 0 and o_totalprice < 50000 then o_totalprice when o_totalprice < 150000 then o_totalprice + 1 else o_totalprice + 2 end as answer from orders")
def cascade_router(spark, d):
    p = F.col("o_totalprice")
    name, answer = rubric.cascade([("small", F.when(F.col("o_orderkey") % 4 != 0, p), p < 50_000), ("medium", p + 1, p < 150_000), ("large", p + 2, F.lit(True))])
    return table(spark, d, "orders").select("o_orderkey", name.alias("model"), answer.alias("answer"))


@query("select doc_id, case when length(text) <= 12000 then 'single' else 'chunked' end as strategy from documents")
def size_route(spark, d):
    return table(spark, d, "documents").select("doc_id", rubric.size_route(F.col("text")).alias("strategy"))


# Vectors: the mean vector of each label stands for its prompt's embedding

_PROTO = """with v as (select vec_id, label, embedding::double[] as e from embeddings), x as (select label, unnest(e) as x, unnest(range(1, len(e) + 1)) as i from v), p as (select label, list(m order by i) as e from (select label, i, avg(x) as m from x group by all) group by label),
s as (select v.vec_id, p.label, list_cosine_similarity(v.e, p.e) as score from v, p) """


@query(_PROTO + "select vec_id, arg_max(label, score) as predicted, round(max(score), 4) as score from s group by vec_id")
def prototype_classify(spark, d):
    v = table(spark, d, "embeddings")
    return vectors.prototype_classify(vectors.prototype_scores(v, vectors.prototypes(v)), -1.0)


@query(_PROTO + "select vec_id, label from s where score >= 0.1")
def prototype_multilabel(spark, d):
    v = table(spark, d, "embeddings")
    return vectors.prototype_scores(v, vectors.prototypes(v)).where("score >= 0.1").select("vec_id", "label")


_KNN = """with v as (select vec_id, label, embedding::double[] as e from embeddings), n as (select a.vec_id as query_id, b.vec_id, b.label, list_cosine_similarity(a.e, b.e) as score, row_number() over (partition by a.vec_id order by list_cosine_similarity(a.e, b.e) desc, b.vec_id) as rank
from v a, v b where a.vec_id % 20 = 0 and a.vec_id <> b.vec_id qualify rank <= 10) """


def _near(spark, d):
    v = table(spark, d, "embeddings")
    return vectors.top_k(v.where("vec_id % 20 = 0"), v, 10)


@query(_KNN + "select query_id, vec_id, round(score, 4) as score, rank::int as rank from n")
def cosine_topk(spark, d):
    return _near(spark, d).select("query_id", "vec_id", F.round("score", 4).alias("score"), "rank")


@query(_KNN + """, w as (select query_id, label, sum(greatest(score, 0)) as w from n group by all), s as (select query_id, label, w / sum(w) over (partition by query_id) as share from w), r as (select *, row_number() over (partition by query_id order by share desc, label) as k, coalesce(lead(share) over (partition by query_id order by share desc, label), 0) as nxt from s)
select query_id, label as predicted, round(share, 4) as share, round(share - nxt, 4) as margin from r where k = 1""")
def knn_classify(spark, d):
    return vectors.knn_classify(_near(spark, d), table(spark, d, "embeddings").select("vec_id", "label"))


@query()
def spherical_kmeans(spark, d):
    return vectors.spherical_kmeans(table(spark, d, "embeddings"), 8)


# Chunks and retrieval


@query("select doc_id, p::int as pos, (p * 2000)::int as start, least(p * 2000 + 2000, length(text))::int as end, substr(text, p * 2000 + 1, 2000) as chunk from (select doc_id, text, unnest(range(0, (length(text) - 1) // 2000 + 1)) as p from documents where length(text) > 0)")
def hard_split(spark, d):
    return chunks.hard_split(table(spark, d, "documents"), 2000)


@query("""with g as (select conv_id as doc, turn, text, case when row_number() over (partition by conv_id order by turn desc) > 1 then chr(10) || chr(10) || case when turn % 3 = 0 then chr(10) else '' end else '' end as gap from conversations), p as (select doc, string_agg(text || gap, '' order by turn) as text from g group by doc), w as (select doc, string_split_regex(text, '\\n{2,}') as parts, regexp_extract_all(text, '\\n{2,}') as gaps from p),
x as (select doc, (i - 1)::int as pos, (coalesce(list_sum(list_transform(parts[1:i - 1], lambda z: length(z))), 0) + coalesce(list_sum(list_transform(gaps[1:i - 1], lambda z: length(z))), 0))::int as start, parts[i] as chunk from (select *, unnest(range(1, len(parts) + 1)) as i from w))
select doc, (row_number() over (partition by doc order by pos) - 1)::int as pos, start, start + length(chunk) as end, chunk from x where length(trim(chunk)) >= 20""")
def paragraph_offsets(spark, d):
    c = table(spark, d, "conversations")
    gap = F.concat(F.lit("\n\n"), F.when(F.col("turn") % 3 == 0, "\n").otherwise(""))
    parts = F.array_sort(F.collect_list(F.struct("turn", "text", gap.alias("gap"))))
    text = F.array_join(F.transform(parts, lambda s, i: F.concat(F.when(i > 0, F.get(parts, i - 1)["gap"]).otherwise(F.lit("")), s["text"])), "")
    return chunks.paragraphs(c.groupBy(F.col("conv_id").alias("doc")).agg(text.alias("text")), "doc")


@query()
def chunk_pack(spark, d):
    docs = table(spark, d, "documents")
    return chunks.pack_sentences(docs, model=sentences.model_of(sentences.train(docs)))


@query("""with w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda z: z <> '') as w from documents), s as (select doc_id, len(w) as n, w from w), a as (select count(*) as total, avg(n) as mean from s),
t as (select doc_id, n, term, count(*) as tf from (select doc_id, n, unnest(list_filter(w, lambda z: z in ('idiot', 'password', 'license'))) as term from s) group by all), f as (select term, count(*) as df from t group by term)
select doc_id, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 4) as score from t join f using (term), a group by doc_id order by score desc, doc_id limit 20""")
def bm25_topk(spark, d):
    return chunks.bm25(table(spark, d, "documents"), ["idiot", "password", "license"], 20)


_HITS = "with h as (select user_id as query, event_type || (event_id % 4) as uri, value as score from events) "


@query(_HITS + "select query, uri, score from (select query, uri, max(score) as score from h group by all) qualify row_number() over (partition by query order by score desc, uri) <= 5")
def merge_retrieval(spark, d):
    hits = table(spark, d, "events").select(F.col("user_id").alias("query"), F.concat("event_type", (F.col("event_id") % 4).cast("string")).alias("uri"), F.col("value").alias("score"))
    return chunks.merge_retrieval(hits, 5)


@query("select query, doc, pos from (select conv_id % 20 as query, conv_id as doc, turn as pos, sum(length(text)) over w as s, row_number() over w as n from conversations window w as (partition by conv_id % 20 order by conv_id, turn rows unbounded preceding)) where s <= 1500 or n = 1")
def context_budget(spark, d):
    rows = table(spark, d, "conversations").select((F.col("conv_id") % 20).alias("query"), F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), "text")
    return chunks.context_budget(rows, 1500).select("query", "doc", "pos")


@query("select conv_id as doc, string_agg(text, ' ' order by turn) as summary from (select *, row_number() over (partition by conv_id order by length(text) desc, turn) as k from conversations) where k <= 2 group by conv_id")
def extractive_topk(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), "text")
    return chunks.extractive_top_k(rows, F.length("text"), 2)


@query("select query, pos, variant from (select user_id as query, event_id as pos, event_type as variant from events qualify row_number() over (partition by user_id, event_type order by event_id) = 1) qualify row_number() over (partition by query order by pos) <= 3")
def query_expand_dedup(spark, d):
    return chunks.expand_dedup(table(spark, d, "events").select(F.col("user_id").alias("query"), F.col("event_id").alias("pos"), F.col("event_type").alias("variant")), 3)


# Reducers


def _leaves(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), F.col("text").alias("value"))


@query("select conv_id as doc, '>' || string_agg(text, '|' order by turn) || '|' as value from conversations group by conv_id")
def reduce_refine_fold(spark, d):
    return chunks.refine_fold(_leaves(spark, d), F.lit(">"), lambda a, v: F.concat(a, v, F.lit("|")))


@query("select conv_id as doc, string_agg(text, '|' order by turn) as value from conversations group by conv_id")
def reduce_tree_levels(spark, d):
    return chunks.tree_levels(_leaves(spark, d), 2, lambda values: F.array_join(values, "|")).select("doc", "value")


# Extractors: sentences are made from tabular columns, whose values are what must be found


_K = "o_orderkey % 6"


def _told(spark, d, *forms):
    """orders with a sentence by o_orderkey % 6."""
    text = F.lit("Nothing is said here.")
    for i, parts in enumerate(forms):
        text = F.when(F.col("o_orderkey") % 6 == i, F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])).otherwise(text)
    return table(spark, d, "orders").select("o_orderkey", text.alias("text"))


def _totals(rows, found, field):
    """How many were found and their sum."""
    made = rows.select("o_orderkey", F.transform(found, lambda s: s[field].cast("double")).alias("f"))
    return made.select("o_orderkey", F.round(F.aggregate("f", F.lit(0.0), lambda a, x: a + x), 9).alias("total"), F.size("f").alias("n"))


def _listed(rows, found, *fields):
    return rows.select("o_orderkey", F.array_join(F.transform(found, lambda s: F.concat_ws(" ", *[s[f].cast("string") for f in fields])), ";").alias("found"))


@query(f"select o_orderkey, case {_K} when 0 then printf('%.2f USD', o_totalprice) when 1 then o_custkey || ' EUR;20 GBP' when 2 then o_custkey || ' JPY' when 3 then '10 USD' when 4 then printf('%.2f EUR', o_totalprice) else '' end as found from orders")
def alpha_money(spark, d):
    p, c = F.format_string("%,.2f", "o_totalprice"), F.col("o_custkey").cast("string")
    rows = _told(spark, d, ("The cap is $", p, " per claim."), ("Cost ", c, "€ at retail and 20 pounds."), ("Paid ¥", c, " in 1999."), ("I paid ten dollars for it.",), ("Total ", p, " EUR now."))
    return _listed(rows, extractors.money(F.col("text")), "amount", "currency")


@query(f"select o_orderkey, case {_K} when 0 then (o_custkey % 100) / 100.0 when 1 then (o_custkey % 100) / 10000.0 when 2 then (o_custkey % 100) / 1000.0 when 3 then 0.1 when 4 then (o_custkey % 100) / 10000.0 else 0 end::double as total, ({_K} <> 5)::int as n from orders")
def alpha_percent(spark, d):
    n = (F.col("o_custkey") % 100).cast("string")
    rows = _told(spark, d, ("I spent ", n, "% of it in 1999."), ("It widened by ", n, "bps."), (n, "‰ of all; 7 basis for it."), ("ten percent of 20 people",), ("by ", n, " basis  points"))
    return _totals(rows, extractors.percentages(F.col("text")), "value")


@query(f"select o_orderkey, case {_K} when 0 then o_custkey || ';100' when 1 then '14;4' when 2 then '7;0.01' when 3 then '' when 4 then o_custkey * 1000 || '' else '' end as found from orders")
def alpha_number(spark, d):
    c = F.col("o_custkey")
    rows = _told(spark, d, ("Room ", c.cast("string"), " has 100 chairs."), ("Chapter XIV and I said IV.",), ("seven of 0.01.",), ("In 1.2.3 and 1,23 and A1.",), ("Sold for ", F.format_number(c * 1000, 0), " dollars."))
    return _listed(rows, extractors.numbers(F.col("text")), "value")


@query(f"select o_orderkey, case {_K} when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%Y-%m-%d') when 2 then strftime(o_orderdate, '%Y-%m-%d') when 3 then strftime(o_orderdate, '%Y-%m-%d') || ';2020-05-01' when 4 then '' else '' end as found from orders")
def alpha_date(spark, d):
    o, f = F.col("o_orderdate"), lambda p: F.date_format("o_orderdate", p)
    rows = _told(spark, d, ("Dated ", f("M/d/yyyy"), "."), ("Executed on ", f("d MMMM yyyy"), " at noon"), ("As of ", f("MMMM d, yyyy"), ", by"), ("On ", o.cast("date").cast("string"), " and the first day of May 2020"), ("on 2/30/2025, 15 May 1850, 123/456/789 and the first of May 2020",))
    return _listed(rows, extractors.dates(F.col("text")), "value")


@query(f"select o_orderkey, case {_K} when 0 then (o_custkey % 50) * 86400.0 when 1 then 33696000.0 when 2 then 3600.0 when 4 then 5400.0 else 0 end::double as total, ({_K} in (0, 1, 2, 4))::int as n from orders")
def alpha_duration(spark, d):
    rows = _told(spark, d, ("Within ", (F.col("o_custkey") % 50).cast("string"), " days of it"), ("I worked for thirteen months.",), ("It took an hour.",), ("3 business days, some days",), ("1.5 hours",))
    return _totals(rows, extractors.durations(F.col("text")), "seconds")


@query(f"select o_orderkey, case {_K} when 0 then 'Customer#' || o_custkey || ' Trading, Inc.' when 1 then 'Foo Bar GmbH' when 2 then 'Alfa S.p.A.;Beta Holdings' else '' end as found from orders")
def alpha_entity(spark, d):
    rows = _told(spark, d, ("between Customer#", F.col("o_custkey").cast("string"), " Trading, Inc. and others"), ("a deal with Foo Bar GmbH"[:25],), ("of Alfa S.p.A. and Beta Holdings, signed",), ("No company is named here",))
    return _listed(rows, extractors.entities(F.col("text")), "name")


@query(f"select o_orderkey, case when {_K} = 0 then '$' || printf('%.2f', o_totalprice) || ';20 pounds' else '' end as found from orders")
def alpha_spans(spark, d):
    """Every span, cut out of its text by its place."""
    rows = _told(spark, d, ("é It is $", F.format_string("%.2f", "o_totalprice"), " for 😀 all, or 20 pounds 😀"))
    cut = F.transform(extractors.money(F.col("text")), lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]))
    return rows.select("o_orderkey", F.array_join(cut, ";").alias("found"))


# Codecs


@query("select page_id, regexp_extract(html, '(?s)<title(?:\\s[^>]*)?>\\s*(.*?)\\s*</title>', 1) as title from pages where regexp_matches(html, '(?s)<title(?:\\s[^>]*)?>.*?</title>')")
def decode_xml(spark, d):
    return table(spark, d, "pages").select("page_id", codecs.xml_field(F.col("html"), "title").alias("title")).where("title is not null")


@query("select event_id, (props::json ->> '$.k')::bigint as k from events")
def decode_json(spark, d):
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("so "), "props", F.lit(" it is")))
    return table(spark, d, "events").select("event_id", codecs.decode_json(text, "k long")["k"].alias("k"))


@query("select event_id, event_type as answer, value::varchar as reason from events")
def decode_chat(spark, d):
    text = F.concat(F.lit("[reason]\n"), F.col("value").cast("string"), F.lit("\n[answer] "), "event_type", F.lit("\n"))
    return table(spark, d, "events").select("event_id", codecs.chat_field(text, "answer").alias("answer"), codecs.chat_field(text, "reason").alias("reason"))


@query("select p_partkey, array_to_string([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_type], '|') as items from part")
def list_coerce(spark, d):
    text = F.concat(F.lit("- "), F.regexp_replace("p_name", " ", "\n- "), F.lit("\n\n'"), "p_type", F.lit("'"))
    return table(spark, d, "part").select("p_partkey", F.array_join(codecs.coerce_list(text), "|").alias("items"))


_CUT = "substr('{\"a\": [1, 2], \"b\": \"' || event_type || '\"}', 1, (12 + event_id % 20)::int)"


@query(f"""with c as (select event_id, {_CUT} as c from events), e as (select event_id, c, case when contains(c, '"b') then case when length(c) - length(replace(c, '"', '')) in (3, 5) then c || '"}}' when c like '%}}' then c else regexp_replace(c, '[,:\\s]+$', '') || '}}' end when c like '%]%' then regexp_replace(c, '[,:\\s"]+$', '') || case when c like '%"' then ', ""}}' else '}}' end else regexp_replace(c, '[,\\s]+$', '') || ']}}' end as j from c)
select event_id, case when json_valid(j) then j end as json from e""")
def truncation_salvage(spark, d):
    cut = F.expr("substring(concat('{\"a\": [1, 2], \"b\": \"', event_type, '\"}'), 1, 12 + event_id % 20)")
    return table(spark, d, "events").select("event_id", codecs.close_truncated_json(cut).alias("json"))
