"""Queries of sources and logs, answers, programs, searches and costs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparloom.functions import codecs, grounding, metrics
from sparloom.operators import cells, chunks, programs, rubric, runs, trials, votes
from sparloom.plans.queries import _log, _sets, query, table
from sparloom.sources import readers
from sparloom.sources.scratch import shared_folder
from sparloom.streaming import runs as streams

# Sources and logs: events are written as lines and read again


def _lines(spark, d):
    """A file for each type of event; every third line is structured, the others flat, with an empty line after each."""
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    flat = F.to_json(F.struct("event_type", "value"))
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"inputs": '), flat, F.lit(', "custom_id": "e'), F.col("event_id").cast("string"), F.lit('", "metadata": {"source_line": "own"}}'))).otherwise(flat)
    path = shared_folder(spark, "lines")
    lines = e.select("event_type", "event_id", F.concat(text, F.lit("\n")).alias("value")).repartition("event_type").sortWithinPartitions("event_type", "event_id")
    lines.select("event_type", "value").write.partitionBy("event_type").text(path)
    return readers.text_lines(spark, path)


@query("select event_type, value, case when event_id % 3 = 0 then 'e' || event_id end as custom_id, case when event_id % 3 = 0 then 'own' else (2 * row_number() over (partition by event_type order by event_id) - 1)::varchar end as source_line from events")
def jsonl_source(spark, d):
    items = readers.jsonl_items(_lines(spark, d), "event_type string, value double")
    return items.select("inputs.event_type", "inputs.value", "custom_id", F.col("metadata")["source_line"].alias("source_line"))


@query("select n_name as t, n_nationkey::int as n, case when n_nationkey % 2 = 0 then 'given-' || n_nationkey else substr(sha256('n=' || n_nationkey || chr(31) || 't=' || n_name || chr(31) || 'p'), 1, 16) end as custom_id, case when n_nationkey % 2 = 0 then r_name end as tag from nation join region on r_regionkey = n_regionkey")
def list_source(spark, d):
    """Nations as a driver's list of rows, every other with an id and metadata of its own."""
    known = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name").collect()
    items = [{"t": r.n_name, "n": r.n_nationkey} | ({"__custom_id__": f"given-{r.n_nationkey}", "__metadata__": {"tag": r.r_name}} if r.n_nationkey % 2 == 0 else {}) for r in known]
    rows = readers.open_source(spark, {"type": "list", "rows": items, "schema": "t string, n int", "program_hash": "p"})
    return rows.select("t", "n", "custom_id", F.col("metadata")["tag"].alias("tag"))


@query("select 'q' || event_id as id, event_id % 2 = 0 as answerable, event_type as question, (event_id % 7)::int as span_start from events")
def questions_source(spark, d):
    path = shared_folder(spark, "questions")
    i = F.col("event_id")
    table(spark, d, "events").select(F.concat(F.lit("q"), i.cast("string")).alias("id"), (i % 2 == 0).alias("answerable"), F.col("event_type").alias("question"), F.array((i % 7).cast("int"), (i % 7 + 5).cast("int")).alias("diagnostic_char_span")).write.json(path)
    return readers.questions_source(spark, path).select("id", "answerable", "question", F.get("diagnostic_char_span", F.lit(0)).alias("span_start"))


@query("select event_id::varchar as custom_id, case when event_type = 'error' then 'error' else 'succeeded' end as status from events where event_id % 2 = 0")
def resume_log(spark, d):
    path = shared_folder(spark, "log")
    readers.write_header(spark, path, runs.run_id("sha256:1", "events"), "sha256:1", "events")
    done = table(spark, d, "events").where("event_id % 2 = 0").select(F.col("event_id").cast("string").alias("custom_id"), F.when(F.col("event_type") == "error", "error").otherwise("succeeded").alias("status"))
    readers.append_log(done, path)
    spark.createDataFrame([('{"kind": "item", "custom_id": "cut o',)], "value string").coalesce(1).write.mode("append").text(path)
    log = readers.read_log(spark, path, readers.HEADER_DDL + ", custom_id string, status string")
    return runs.checked_log(log, "sha256:1").select("custom_id", "status")


@query("select 't' || conv_id as root, case when turn is null then 't' || conv_id else 't' || conv_id || '.' || turn end as trace, case when turn is null then null else 't' || conv_id end as parent, coalesce(n, 0)::bigint as tokens, case when turn is null then 0 else 1 end as level from (select conv_id, turn, length(text) as n from conversations union all select distinct conv_id, null, null from conversations)")
def trace_source(spark, d):
    name = F.concat(F.lit("t"), F.col("conv_id").cast("string"))
    child = F.struct(F.concat(name, F.lit("."), F.col("turn").cast("string")).alias("trace_id"), F.col("role").alias("call_name"), F.length("text").alias("total_tokens"), F.lit(0.0).alias("cost_usd"))
    trees = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(child).alias("children"))
    lines = trees.select(F.to_json(F.struct(name.alias("trace_id"), F.lit(0).alias("total_tokens"), "children")).alias("text"))
    return readers.trace_nodes(lines, 3).select("root", "trace", "parent", "tokens", "level")


@query("select event_id, 'open' as mode, '[REDACTED]' as api_key, '[REDACTED]' as my_token from events")
def env_redact_names(spark, d):
    env = F.create_map(F.lit("mode"), F.lit("open"), F.lit("API_KEY"), F.col("props"), F.lit("my_token"), F.col("event_type"))
    return table(spark, d, "events").select("event_id", codecs.redact(env).alias("m")).select("event_id", *[F.col("m")[k].alias(k.lower()) for k in ("mode", "API_KEY", "my_token")])


# Projections and answers


@query("select event_id, event_type as x, (props::json ->> '$.k')::bigint as k from events")
def pointer_projection(spark, d):
    steps = F.struct(F.struct(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k")).alias("output")).alias("parse"))
    row = F.struct(F.struct(F.col("event_type").alias("x")).alias("inputs"), steps.alias("steps"))
    wrong = cells.check_pointers([("parse", ["$.inputs.x"]), ("use", ["$.steps.parse.output.k"])], ["x"])
    if wrong:
        raise ValueError(wrong)
    return table(spark, d, "events").select("event_id", row.alias("r")).select("event_id", cells.pointed(F.col("r"), "$.inputs.x").alias("x"), cells.pointed(F.col("r"), "$.steps.parse.output.k").alias("k"))


@query("select event_id, event_type as kind, (props::json ->> '$.k')::bigint as k from events")
def output_fields(spark, d):
    text = F.to_json(F.struct(F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("k"), F.lit("dropped").alias("extra")))
    return table(spark, d, "events").select("event_id", cells.declared_fields(text, {"kind": "string", "k": "long"}, ["kind", "k"]).alias("v")).select("event_id", "v.*")


@query("select user_id, coalesce(string_agg(distinct event_type, ',' order by event_type) filter (where event_type in ('click', 'view')), '') as labels from events group by user_id")
def label_picks(spark, d):
    picks = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("p"))
    return picks.select("user_id", F.array_join(votes.demand_known(votes.known_picks(F.col("p"), ["view", "click"]), ["view", "click"]), ",").alias("labels"))


@query("select event_id, case event_id % 4 when 0 then event_type when 1 then null when 2 then event_type when 3 then event_type end as answer from events")
def coerce_answer(spark, d):
    t = F.concat(F.lit('"'), "event_type", F.lit('"'))
    text = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"text": "no", "value": '), t, F.lit("}"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"output": '), t, F.lit(', "answer": null}'))).when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"x": 1, "output": '), t, F.lit("}"))).otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", metrics.first_key(text).alias("answer"))


@query("select event_id, case event_id % 5 when 0 then (event_id % 100)::double when 1 then 1 when 2 then 1000 when 3 then null else 0.5 end::double as x from events")
def to_number(spark, d):
    n = (F.col("event_id") % 100).cast("string")
    i = F.col("event_id") % 5
    text = F.when(i == 0, F.concat(F.lit('{"score": '), n, F.lit("}"))).when(i == 1, "true").when(i == 2, "1_000").when(i == 3, "many").otherwise(" 0.5 ")
    return table(spark, d, "events").select("event_id", metrics.to_number(text).alias("x"))


@query("""with a as (select a.vec_id, a.embedding::double[] as p, b.embedding::double[] as q from embeddings a left join embeddings b on b.vec_id = a.vec_id + 1) select vec_id, round(coalesce(least(greatest(list_cosine_similarity(p, q), 0), 1), 0), 6)::double as score from a""")
def answer_relevancy(spark, d):
    v = table(spark, d, "embeddings")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("q"))
    return v.join(after, "vec_id", "left").select("vec_id", F.round(metrics.answer_relevancy(F.col("embedding"), F.col("q")), 6).alias("score"))


@query("""with w as (select conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') as w from conversations), p as (select a.conv_id, a.turn, a.w as p, b.w as g from w a join w b on a.conv_id = b.conv_id and b.turn = a.turn + 1),
x as (select conv_id, turn, unnest(p) as t, 1 as a, 0 as b from p union all select conv_id, turn, unnest(g), 0, 1 from p), c as (select conv_id, turn, t, least(sum(a), sum(b)) as k from x group by conv_id, turn, t), s as (select conv_id, turn, sum(k) as k from c group by conv_id, turn)
select conv_id, turn, round(case when len(p) > 0 then coalesce(k, 0) / len(p) else 0 end, 9)::double as precision, round(case when len(g) > 0 then coalesce(k, 0) / len(g) else 0 end, 9)::double as recall, round(case when coalesce(k, 0) > 0 then 2 * k / (len(p) + len(g)) else 0 end, 9)::double as f1 from p left join s using (conv_id, turn)""")
def rouge_1(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    pairs = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold")), ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", metrics.rouge(F.col("text"), F.col("gold")).alias("r")).select("conv_id", "turn", *[F.round(f"r.{x}", 9).alias(x) for x in ("precision", "recall", "f1")])


@query("select event_id, case when event_id % 4 = 1 then '' when event_id % 4 = 2 then '+ \"b\": 2' else '- \"a\": ' || event_type || chr(10) || '+ \"a\": x' end as diff from events")
def json_diff(spark, d):
    i = F.col("event_id") % 4
    old = F.concat(F.lit('{"a": "'), "event_type", F.lit('"}'))
    new = F.when(i == 1, old).when(i == 2, F.concat(F.lit('{"b": 2, "a": "'), "event_type", F.lit('"}'))).otherwise(F.lit('{"a": "x"}'))
    return table(spark, d, "events").select("event_id", codecs.json_diff(old, new).alias("diff"))


@query("select event_id, case event_id % 4 when 0 then '1234.50' when 1 then '-7' when 3 then '12' end as key from events")
def number_canonical(spark, d):
    i = F.col("event_id") % 4
    return table(spark, d, "events").select("event_id", codecs.number_key(F.when(i == 0, " 1,234.50").when(i == 1, "-7").when(i == 2, "true").otherwise("+12")).alias("key"))


# Tagged paragraphs and citations


def _articles(spark, d):
    """Each conversation's turns as paragraphs."""
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "\n\n")
    return table(spark, d, "conversations").groupBy("conv_id").agg(texts.alias("text"))


_ARTICLES = r"""with t as (select conv_id, string_agg(text, chr(10) || chr(10) order by turn) as text from conversations group by conv_id),
x as (select conv_id, text, regexp_split_to_array(text, '\n{2,}') as parts, regexp_extract_all(text, '\n{2,}') as gaps from t), i as (select *, unnest(range(1, len(parts) + 1)) as k from x),
s as (select conv_id, text, k, parts[k] as part, coalesce(gaps[k], '') as gap, length(regexp_replace(parts[k], '^\s+|\s+$', '', 'g')) >= 20 as long, coalesce(list_sum(list_transform(parts[1:k - 1], lambda z: length(z))), 0)::int + coalesce(list_sum(list_transform(gaps[1:k - 1], lambda z: length(z))), 0)::int as start from i),
n as (select *, sum(long::int) over (partition by conv_id order by k) - 1 as p from s) """


@query(_ARTICLES + "select conv_id, string_agg(case when long then '[SRC:doc:' || conv_id || '#p' || p || '] ' else '' end || part || gap, '' order by k) as tagged from n group by conv_id")
def tag_paragraphs(spark, d):
    return chunks.tagged_text(_articles(spark, d), "conv_id").select("conv_id", "tagged")


@query(_ARTICLES + """, q as (select conv_id, any_value(text) as text, max(part) filter (where long and p = 0) as first from n group by conv_id)
select conv_id, case when conv_id % 4 = 0 then 'source_missing' when conv_id % 4 = 1 and first is null then 'source_missing' when conv_id % 4 = 3 then 'quote_mismatch' when conv_id % 4 = 1 then 'strict' when length(text) >= 15 then 'strict' else 'out_of_range' end as verdict from q""")
def cited_output(spark, d):
    """Quotes of all conversations: of a paragraph that isn't there, of the first, of the text, and made-up ones."""
    docs = _articles(spark, d)
    name = lambda c: F.concat(F.lit("doc:"), c.cast("string"))
    found = chunks.paragraphs(docs, "conv_id")
    tags = found.select(F.concat(name(F.col("conv_id")), F.lit("#p"), F.col("pos").cast("string")).alias("uri"), name(F.col("conv_id")).alias("source_uri"), "start", "end")
    first = found.where("pos = 0").select("conv_id", F.substring("chunk", 4, 12).alias("of_first"))
    i = F.col("conv_id")
    uri = F.concat(name(i), F.when(i % 4 == 0, "#p99").when(i % 4 == 1, "#p0").otherwise(""))
    quote = F.when(i % 4 == 3, "no such words").when(i % 4 == 1, F.coalesce("of_first", F.lit("none"))).otherwise(F.substring("text", 4, 12))
    spans = docs.join(first, "conv_id", "left").select(i, uri.alias("source_uri"), F.lit(3).alias("start"), F.lit(15).alias("end"), quote.alias("quote"))
    return grounding.verify_cited(spans, tags, docs.select(name(i).alias("source_uri"), "text"), strategies=("strict",)).select("conv_id", "verdict")


@query("select doc_id, p::int as pos, substr(sha256(concat_ws(chr(31), doc_id, p * 2000, least(p * 2000 + 2000, length(text)), substr(text, p * 2000 + 1, 2000))), 1, 16) as chunk_id from (select doc_id, text, unnest(range(0, (length(text) - 1) // 2000 + 1)) as p from documents where length(text) > 0)")
def chunk_ids(spark, d):
    return chunks.with_chunk_ids(chunks.hard_split(table(spark, d, "documents"), 2000)).select("doc_id", "pos", "chunk_id")


@query("select string_agg(substr(text, 1, 500), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by item_id) as sample from benchmark")
def sample_text(spark, d):
    return cells.sample_text(table(spark, d, "benchmark"), key="item_id")


# Programs: a model's call is a Column of what the row says


@query("with t as (select event_id, i, case when (event_id + i) % 4 = 3 then null else (event_id * (i + 3)) % 11 end as s from events, range(5) r(i)) select event_id, i::int as index, s::double as score, (select count(*) from t u where u.event_id = t.event_id and u.s is null) as failed from t where s is not null qualify row_number() over (partition by event_id order by s desc, i) = 1")
def best_of_n(spark, d):
    i = F.col("event_id")
    score = lambda out: F.when((i + out) % 4 != 3, i * (out + 3) % 11)
    return programs.best_of_n(table(spark, d, "events"), "event_id", 5, lambda n: n, score).select("event_id", "index", "score", "failed")


@query("select event_id, case when event_id % 10 >= 6 then event_id % 10 else least(9, (event_id % 10) + 2 * ceil((6 - event_id % 10) / 2))::bigint end as output, case when event_id % 10 >= 6 then 0 else least(3, ceil((6 - event_id % 10) / 2)) end::int as rounds from events")
def refine_loop(spark, d):
    r = programs.refine(F.col("event_id") % 10, lambda out, n: out + 2, lambda out: out, 6.0, 3)
    return table(spark, d, "events").select("event_id", r.alias("r")).select("event_id", "r.output", "r.rounds")


@query("select event_id, (event_id % 7) || '-' || (event_id % 7 + 1) || '-' || (event_id % 7 + 2) as output from events")
def compare_chains(spark, d):
    rows = table(spark, d, "events").select("event_id")
    return programs.compare_chains(rows, "event_id", 3, lambda n: F.col("event_id") % 7 + n, lambda outs: F.array_join(F.transform(outs, lambda x: x.cast("string")), "-"))


@query("""with s as (select o_custkey as doc, n_name as child, r_name as root, o_orderkey % 97 as x from orders join customer on o_custkey = c_custkey join nation on n_nationkey = o_orderkey % 25 join region on r_regionkey = n_regionkey), c as (select doc, child, root, max(x) as x from s group by all),
r as (select doc, root, max(x) as x from s group by all), b as (select doc, root from r qualify row_number() over (partition by doc order by x desc, root) = 1), k as (select c.doc, child, x from c join b using (doc, root) qualify row_number() over (partition by c.doc order by x desc, child) = 1)
select b.doc, case when k.x >= 20 then child else root end as label, case when k.x >= 20 then 1 else 0 end as level from b join r using (doc, root) join k on k.doc = b.doc where r.x >= 20""")
def hierarchical_descent(spark, d):
    o, n, r = (table(spark, d, x) for x in ("orders", "nation", "region"))
    hits = o.join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").join(n, F.col("n_nationkey") == F.col("o_orderkey") % 25).join(r, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("o_custkey").alias("doc"), "n_name", "r_name", (F.col("o_orderkey") % 97).alias("x"))
    scores = hits.select("doc", F.explode(F.array("n_name", "r_name")).alias("label"), "x").groupBy("doc", "label").agg(F.max("x").alias("score"))
    labels = r.select(F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent")).union(n.join(r, F.col("r_regionkey") == F.col("n_regionkey")).select("n_name", "r_name"))
    return programs.descend(scores, labels, 3, 20)


@query("""with v as (select vec_id, label, embedding::double[] as e from embeddings), q as (select e from v where vec_id = 0), s as (select label as doc, vec_id, list_cosine_similarity(v.e, q.e) as s from v, q), t as (select *, row_number() over (partition by doc order by s desc, vec_id) as r from s)
select doc, string_agg('s' || vec_id, ' ' order by vec_id) as context, string_agg(r, ',' order by vec_id) as ranks from t where r <= 4 group by doc""")
def query_focused(spark, d):
    v = table(spark, d, "embeddings")
    given = F.broadcast(v.where("vec_id = 0").select(F.col("embedding").alias("_q")))  # one row
    sentences = v.join(given, how="cross").select(F.col("label").alias("doc"), F.col("vec_id").alias("start"), (F.col("vec_id") + 1).alias("end"), F.concat(F.lit("s"), F.col("vec_id").cast("string")).alias("text"), F.col("embedding").alias("vector"), "_q")
    return programs.query_focused(sentences, F.col("_q"), 4).select("doc", "context", F.array_join(F.transform("ranks", lambda x: x.cast("string")), ",").alias("ranks"))


@query("select o_orderkey as doc, case when o_orderkey % 5 <> 0 then printf('%.2f:USD', o_totalprice) end as amount, strftime(o_orderdate, '%Y-%m-%d') as day from orders")
def extract_corpus(spark, d):
    text = F.concat(F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("Paid $"), F.format_string("%,.2f", "o_totalprice"), F.lit(" on "))).otherwise(F.lit("Signed ")), F.date_format("o_orderdate", "MMMM d, yyyy"))
    found = {"amount": codecs.money_text_key, "day": codecs.date_text_key}
    _, rows, _ = programs.extract_corpus(table(spark, d, "orders").select("o_orderkey", text.alias("text")), "o_orderkey", found, {"amount": "money", "day": "date"})
    return rows.select("doc", F.nullif("amount", F.lit("refused")).alias("amount"), "day")


@query("select event_id, case when event_id % 5 = 0 then 'error' when event_id % 3 = 0 or event_id % 7 = 0 then 'insufficient_evidence' else 'answer' end as outcome, case event_id % 5 when 0 then case when event_id % 2 = 0 then 'timeout' else 'schema_validation_failed' end end as kind from events")
def question_outcomes(spark, d):
    i = F.col("event_id")
    rows = table(spark, d, "events").select(i, F.when(i % 7 == 0, "  ").otherwise("yes").alias("answer"), (i % 3 == 0).alias("refused"), F.when(i % 5 == 0, F.when(i % 2 == 0, "ReadTimeout").otherwise("ValidationError")).alias("error"))
    return runs.question_outcomes(rows).select("event_id", "outcome", F.when(F.col("error").isNotNull(), runs.classify_error(F.col("error"))).alias("kind"))


@query("select event_id, event_id % 8 / 8.0::double < 0.7 or event_id % 3 = 0 or event_id % 5 = 0 as refused from events")
def refusal_rules(spark, d):
    i = F.col("event_id")
    counts = F.array(F.lit(2), (i % 3).cast("int"))
    verdicts = F.array(F.lit("strict"), F.when(i % 5 == 0, "quote_mismatch").otherwise("substring"))
    return table(spark, d, "events").select("event_id", grounding.refuses(i % 8 / 8.0, counts, verdicts).alias("refused"))


# Searches and costs


@query("""with l as (select user_id % 10 as run, event_id as trial, event_id % 7 / 4.0::double as cost, event_id % 13 as tokens, case when event_id % 11 = 0 then 1 end as e from events), s as (select run, trial, sum(cost) over w as c, sum(tokens) over w as t, count(e) over w as n, count(*) over w as k from l window w as (partition by run order by trial)),
x as (select run, min(trial) as t_, 'cost' as reason, 1 as o from s where c >= 30 group by run union all select run, min(trial), 'tokens', 2 from s where t >= 200 group by run union all select run, min(trial), 'errors', 3 from s where n >= 4 group by run union all select run, min(trial), 'trials', 0 from s where k >= 33 group by run union all select run, max(trial), 'completed', 4 from s group by run)
select run, t_ as stopped_at, reason from x qualify row_number() over (partition by run order by t_, o) = 1""")
def stop_reasons(spark, d):
    return trials.stop_reasons(_log(spark, d), trials=33, cost=30, tokens=200, errors=4)


@query("""with c as (select * from (values (0, 10.0), (1, 30.0), (2, 50.0), (3, 30.0)) v(config, least)), m as (select config, round(avg(((value >= least) = (event_id % 2 = 0))::int), 6) as mean from events, c group by config) select config, mean, mean > 0.4 as accepted from m qualify row_number() over (order by mean desc, config) = 1""")
def config_search(spark, d):
    configs = spark.createDataFrame([(0, 10.0), (1, 30.0), (2, 50.0), (3, 30.0)], "config int, least double")
    score = ((F.col("value") >= F.col("least")) == (F.col("event_id") % 2 == 0)).cast("double")
    return trials.first_best(trials.evaluate_configs(table(spark, d, "events").select("event_id", "value"), configs, score), "config", 0.4)


@query("select conv_id % 9 as trial, count(*) as calls, sum(length(text))::bigint as tokens, round(sum(length(text) / 8.0::double), 4) as cost from conversations group by all")
def trial_attribution(spark, d):
    c = table(spark, d, "conversations")
    t = (F.col("conv_id") % 9).alias("trial")
    calls = c.select(t, F.concat_ws("-", "conv_id", "turn").alias("trace"), F.col("conv_id").cast("string").alias("parent"), F.length("text").cast("long").alias("tokens"), (F.length("text") / 8.0).alias("cost"))
    above = c.groupBy(t, F.col("conv_id").cast("string").alias("trace")).agg(F.sum(F.length("text")).alias("tokens"), F.sum(F.length("text") / 8.0).alias("cost")).select("trial", "trace", F.lit(None).cast("string").alias("parent"), "tokens", "cost")
    return trials.trial_costs(calls.union(above))


@query("select conv_id as root, t as trace, level, round(cost, 6)::double as cost from (select conv_id, 'c' || conv_id as t, 0 as level, sum(length(text)) / 8.0::double as cost from conversations group by conv_id union all select conv_id, 'c' || conv_id || role, 1, sum(length(text)) / 8.0::double from conversations group by conv_id, role union all select conv_id, 'c' || conv_id || role || turn, 2, length(text) / 8.0::double from conversations)")
def cost_tree(spark, d):
    c = table(spark, d, "conversations")
    top = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    leaves = c.select(F.col("conv_id").alias("root"), F.concat(top, "role", F.col("turn").cast("string")).alias("trace"), F.concat(top, "role").alias("parent"), (F.length("text") / 8.0).alias("cost"))
    none = F.lit(None).cast("double")
    middle = c.select(F.col("conv_id").alias("root"), F.concat(top, "role"), top, none).distinct()
    roots = c.select(F.col("conv_id").alias("root"), top, F.lit(None).cast("string"), none).distinct()
    return runs.tree_costs(leaves.union(middle).union(roots), 4).select("root", "trace", "level", "cost")


@query("select event_id, round((event_id % 1000) * 0.7 * 2.0 / 1e6 + (event_id % 1000) * 0.3 * 8.0 / 1e6, 9)::double as cost, substr(sha256('do it' || chr(31) || '' || chr(31) || 'k=' || event_type || ',t=0'), 1, 16) as fingerprint from events")
def fallback_cost(spark, d):
    prices = F.lit(2.0), F.lit(8.0)
    settings = F.create_map(F.lit("t"), F.lit("0"), F.lit("k"), F.col("event_type"))
    return table(spark, d, "events").select("event_id", F.round(runs.split_cost(F.col("event_id") % 1000, *prices), 9).alias("cost"), runs.config_fingerprint(F.lit("do it"), F.lit(None).cast("string"), settings).alias("fingerprint"))


@query("select temperature, count(*) as n, round(avg((value > temperature * 100)::int), 6) as mean from events, (select unnest([0.0, 0.3, 0.7, 1.0]) as temperature) group by temperature")
def latin_draws(spark, d):
    """Drawn thresholds, each as often as any other, over all events."""
    drawn = trials.latin_draws({"temperature": [0.0, 0.3, 0.7, 1.0], "codec": ["json", "xml"]}, 20, seed=3)
    configs = spark.createDataFrame([(c["temperature"], i) for i, c in enumerate(drawn)], "temperature double, draw int")
    even = configs.groupBy("temperature").agg(F.min(F.struct("draw", "temperature")).alias("config"), F.count("*").alias("times")).where("times = 5").select("config", "temperature")
    found = trials.evaluate_configs(table(spark, d, "events"), even, (F.col("value") > F.col("temperature") * 100).cast("int"))
    return found.select("config.temperature", "n", "mean")


@query("""with e as (select event_id % 8 as f, count(*) as n, count(*) filter (where event_type = 'error') as bad from events group by 1), r as (select f, n, sum(bad) over (order by f) as seen, coalesce(sum(bad) over (order by f rows between unbounded preceding and 1 preceding), 0) as before from e),
p as (select unnest(['continue', 'stop', 'stop_after_n']) as policy, unnest([1000000000, 1, (select sum(bad)::bigint // 2 from e)]) as most) select policy, max(seen) >= any_value(most) as stopped, sum(n) filter (where before < most)::bigint as written from r, p group by policy""")
def stream_error_policy(spark, d):
    """Eight files, one a micro-batch: all are written, or those up to the first error, or to half of all errors."""
    out = shared_folder(spark, "policy")
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", "error").otherwise("succeeded").alias("status")).withColumn("f", F.col("event_id") % 8)
    for f in range(8):  # in this order, as a stream takes older files first
        e.where(F.col("f") == f).coalesce(1).write.mode("append").parquet(f"{out}/in")
    half = e.where("status = 'error'").count() // 2
    rows = None
    for policy in ("continue", "stop", "stop_after_n"):
        items = streams.stream_items(spark, f"{out}/in", e.schema)
        run = streams.run_with_policy(items, lambda b: b, f"{out}/{policy}/rows", f"{out}/{policy}/checkpoint", policy, half)
        try:
            run.awaitTermination()
            stopped = False
        except Exception as x:
            if "TooManyErrors" not in str(x):
                raise
            stopped = True
        part = spark.read.parquet(f"{out}/{policy}/rows").agg(F.lit(policy).alias("policy"), F.lit(stopped).alias("stopped"), F.count("*").alias("written"))
        rows = part if rows is None else rows.union(part)
    return rows


@query("select o_orderkey, case when o_totalprice > 150000 then 1.0 else 0.5 end as score from orders")
def rubric_checked(spark, d):
    criteria = rubric.checked([rubric.Criterion("o_totalprice", "gt", 150_000.0, 1.0)], 1.0, 0.0, soft=0)
    return table(spark, d, "orders").select("o_orderkey", rubric.aggregate_score(rubric.hard_score(criteria), F.lit(None), 1.0, 0.0).alias("score"))


@query("select user_id, len(list_distinct(list(event_type) filter (where value > 60))) as n from events group by user_id")
def reference_sets(spark, d):
    return _sets(spark, d).select("user_id", F.size(metrics.refs(F.to_json("p"))).cast("long").alias("n"))


@query("""with c as (select conv_id as doc, role, string_agg(turn::varchar, '+' order by turn) as v, min(turn) as f from conversations group by conv_id, role)
select doc, case when count(*) = 1 then any_value(v) else string_agg(v, '|' order by f) end as value, count(*) as clusters, case when count(*) = 1 then 1 else 2 end as depth from c group by doc""")
def reduce_clusters(spark, d):
    leaves = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), F.col("role").alias("cluster"), F.col("turn").cast("string").alias("value"))
    return chunks.cluster_reduce(leaves, lambda values: F.array_join(values, "+"), lambda values: F.array_join(values, "|"))
