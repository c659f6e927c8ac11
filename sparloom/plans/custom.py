"""Queries of user-made folds, table functions, observed runs, intervals, clusters and searches, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparloom.functions import tables
from sparloom.operators import chunks, clusters, folds, hooks, intervals, tpe
from sparloom.plans.queries import query, table
from sparloom.sources.scratch import shared_folder
from sparloom.streaming import runs as streams


@query("select event_type, round(avg(value), 6) as mean from events group by event_type")
def fold_mean(spark, d):
    rows = table(spark, d, "events").select("event_type", "value")
    return folds.aggregate(rows, ["event_type"], "mean", "double").select("event_type", F.round("value", 6).alias("mean"))


@query("select lang, source, first(text order by length(text) desc, text) as text from documents group by lang, source")
def fold_longest(spark, d):
    """The longest text of each language and source, by a fold that keeps one."""
    rows = table(spark, d, "documents").select("lang", "source", F.col("text").alias("value"))
    return folds.aggregate(rows, ["lang", "source"], "longest", "string", "text")


@query("select doc_id, p::int as pos, (p * 450)::int as start, least(p * 450 + 500, length(text))::int as end from (select doc_id, text, unnest(range(0, greatest(0, (length(text) - 51) // 450) + 1)) as p from documents where length(text) > 0)")
def udtf_split(spark, d):
    """Overlapping chunks through LATERAL."""
    tables.register(spark)
    table(spark, d, "documents").createOrReplaceTempView("loom_documents")
    return spark.sql("select doc_id, c.pos, c.start, c.end from loom_documents, lateral split_text(text, 500, 50) c")


@query(
    "select query, uri, score, row_number() over (partition by query order by score desc, uri) as rank from (select user_id as query, event_type || '/' || event_id as uri, value as score from events) qualify rank <= 4"
)
def udtf_rank(spark, d):
    """The best hits of each query by a ranker that partitions its own table."""
    tables.register(spark)
    table(spark, d, "events").select(F.col("user_id").alias("query"), F.concat_ws("/", "event_type", "event_id").alias("uri"), F.col("value").alias("score")).createOrReplaceTempView("loom_hits")
    return spark.sql("select query, uri, score, rank from rank_rows(table(loom_hits), 'query', 4)")


@query("select doc_id, length(text) + 1 + strpos(p, initcap_source) - 1 as start, initcap_source || ' & Sons' as name, 'Ltd.' as form from (select doc_id, text, 'Signed by ' || upper(source[1:1]) || source[2:] || ' & Sons Ltd. here' as p, upper(source[1:1]) || source[2:] as initcap_source from documents)")
def udtf_entities(spark, d):
    """Signers that a line at the end of each document names, by a table function in SQL."""
    tables.register(spark)
    docs = table(spark, d, "documents")
    docs.select("doc_id", F.length("text").alias("n"), F.concat("text", F.lit("\nSigned by "), F.initcap("source"), F.lit(" & Sons Ltd. here")).alias("text")).createOrReplaceTempView("loom_signed")
    return spark.sql("select doc_id, cast(e.start as bigint) as start, e.name, e.form from loom_signed, lateral find_entities(text) e where e.start > n")


@query("select count(*) as n_items, count(*) filter (where event_type <> 'error') as n_done, count(*) filter (where event_type = 'error') as n_failed, round(sum(value), 4) as total from events")
def observed_run(spark, d):
    """Counts of a batch job, taken while its rows are written."""
    e = table(spark, d, "events").withColumn("status", F.when(F.col("event_type") == "error", "error").otherwise("ok"))
    metrics = hooks.run_metrics() | {"total": F.round(F.sum("value"), 4)}
    return hooks.observed(e, metrics, lambda rows: rows.write.parquet(shared_folder(spark, "run")))


@query("select (event_id % 5)::int as part, count(*) as n_items, count(*) filter (where event_type = 'error') as n_failed from events group by 1")
def observed_stream(spark, d):
    """Counts that hooks were told of each micro-batch: one for each of five files."""
    folder, seen = shared_folder(spark, "stream"), []
    e = table(spark, d, "events").withColumn("status", F.when(F.col("event_type") == "error", "error").otherwise("ok")).withColumn("part", (F.col("event_id") % 5).cast("int"))
    for p in range(5):
        e.where(F.col("part") == p).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    told = hooks.Hooks(progress=lambda name, batch, m: seen.append((batch, m["n_items"], m["n_failed"])))
    items = streams.stream_items(spark, f"{folder}/in", e.schema)
    job = hooks.watched_stream(items, f"{folder}/out", f"{folder}/check", told, f"observed_{folder[-8:]}")
    job.awaitTermination()
    hooks.settle(spark, told, lambda: len({b for b, *_ in seen}) >= 5)
    # files come in the order in which they were written
    return spark.createDataFrame(sorted(set(seen)), "part int, n_items long, n_failed long")


_CLAIMS = "select o_orderkey, o_orderdate as f, case when o_orderkey % 9 <> 0 then o_orderdate + to_days((o_orderkey % 400)::int) end as t from orders"


@query(f"with c as ({_CLAIMS}), i as (select distinct date_trunc('month', l_shipdate) as m from lineitem) select strftime(m, '%Y-%m') as month, count(*) as n, sum(o_orderkey)::bigint as keys from c join i on f <= m and (t is null or m < t) group by m")
def claims_by_month(spark, d):
    o = table(spark, d, "orders")
    end = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 400).cast("int")))
    claims = o.select("o_orderkey", F.col("o_orderdate").alias("f"), end.alias("t"))
    months = table(spark, d, "lineitem").select(F.date_trunc("month", "l_shipdate").alias("month")).distinct()
    return intervals.valid_pairs(claims, months, "f", "t", "month").groupBy(F.date_format("month", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query()
def cluster_reduce_vectors(spark, d):
    """Leaves of 25 documents, clustered by their vectors and reduced cluster by cluster."""
    v = table(spark, d, "embeddings").select((F.col("vec_id") % 25).alias("doc"), F.expr("vec_id div 25").alias("pos"), "embedding", F.col("vec_id").cast("string").alias("value"))
    found = clusters.cluster_leaves(v).join(v.select("doc", "pos", "value"), ["doc", "pos"])
    return chunks.cluster_reduce(found, lambda values: F.array_join(values, "+"), lambda values: F.array_join(values, "|"))


SPACE = {"least": [0, 50, 100, 200, 400, 800], "most": [2000, 5000, 20000, 1000000], "words": [0.0, 0.2, 0.4, 0.6], "marks": [0.02, 0.05, 0.1, 1.0]}


def quality_score(c: dict):
    """1 where the rule of a configuration gives the label: enough characters, not too many, few repeated words, few marks."""
    good = (F.col("n_chars") >= c["least"]) & (F.col("n_chars") <= c["most"]) & (F.col("distinct") >= c["words"]) & (F.col("marks") <= c["marks"])
    return (good.cast("int") == F.col("quality")).cast("int")


@query()
def tpe_search(spark, d):
    """24 configurations of a quality rule over the labelled documents, eight at a time."""
    w = F.split(F.lower("text"), " ")
    docs = table(spark, d, "documents").select("doc_id", "n_chars", (F.size(F.array_distinct(w)) / F.size(w)).alias("distinct"), (F.length(F.regexp_replace("text", r"[\p{L}\p{N}\s]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("marks"))
    folder = shared_folder(spark, "search")
    docs.join(table(spark, d, "labels"), "doc_id").write.parquet(f"{folder}/examples")
    found, reason = tpe.search(spark.read.parquet(f"{folder}/examples"), SPACE, quality_score, f"{folder}/trials", tpe.Limits(trials=24), seed=3)
    return found.withColumn("reason", F.lit(reason))
