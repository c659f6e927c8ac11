"""Queries of sentences, subsequences, repaired answers and company names, with their SQL where it can tell."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparloom.functions import codecs, lcs
from sparloom.operators import chunks, entities, sentences
from sparloom.plans.queries import query, table

_XLOG = "(case when {0} > 0 then {0} * ln(greatest({1}, 1e-300)) else 0 end)"


def _ratio(a: str, b: str, joint: str, n: str) -> str:
    """SQL of sentences.together()."""
    p, p1, p2 = f"({b} / {n})", f"({joint} / {a})", f"(({b} - {joint}) / ({n} - {a}))"
    cells = [(joint, p, p1), (f"({a} - {joint})", f"(1 - {p})", f"(1 - {p1})"), (f"({b} - {joint})", p, p2), (f"({n} - {a} - {b} + {joint})", f"(1 - {p})", f"(1 - {p2})")]
    return "-2 * (" + " + ".join(f"{_XLOG.format(c, x)} - {_XLOG.format(c, y)}" for c, x, y in cells) + ")"


_WORD = r"case when regexp_matches({0}, '^\p{{N}}[\p{{N}}.,]*$') then '#' else lower(regexp_replace({0}, '[.?!]+$', '')) end"


@query(
    r"""with c as (select list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda t: regexp_replace(t, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}.?!]+$', '', 'g')), lambda t: t <> '') as c from documents),
x as (select c[i] as t, c[i + 1] as nx from (select c, unnest(range(1, len(c) + 1)) as i from c)),
k as (select """
    + _WORD.format("t")
    + r""" as word, t like '%.' as dot, regexp_matches(t, '[?!]$') as ends, """
    + _WORD.format("nx")
    + r""" as after, count(*)::double as n from x group by all having word <> ''),
w as (select word, sum(n) as n, coalesce(sum(n) filter (where dot), 0) as dots from k group by word), z as (select sum(n) as total, sum(n) filter (where dot) as all_dots from k),
l as (select word, dots, n - dots as rest, length(replace(word, '.', ''))::double as letters, length(word) - length(replace(word, '.', '')) + 1 as marks, all_dots / total as p from w, z where dots > 0 and word <> '#'),
s as (select word, -2 * (dots * ln(p) + """
    + _XLOG.format("rest", "(1 - p)")
    + " - dots * ln(0.99) - "
    + _XLOG.format("rest", "0.01")
    + r""") * exp(-letters) * marks / pow(letters, rest) as score from l where letters > 0),
ab as (select word, score from s where score >= 0.3), m as (select k.*, ab.word is not null or k.word = '#' or regexp_matches(k.word, '^\p{L}$') as short from k left join ab using (word)),
br as (select coalesce(sum(n) filter (where (dot and not short) or ends), 0) as breaks, sum(n) as total from m), f as (select after, sum(n) as joint from m where ((dot and not short) or ends) and regexp_matches(after, '^\p{L}') group by after),
st as (select after as word, """
    + _ratio("breaks", "n", "least(joint, n)", "total")
    + r""" as score from f join w on w.word = f.after, br where joint / breaks > n / total),
pr as (select word, after, sum(n) as joint from m where dot and short and regexp_matches(after, '^\p{L}') group by all),
co as (select pr.word, pr.after, joint, """
    + _ratio("w1.n", "w2.n", "least(joint, w1.n, w2.n)", "total")
    + r""" as score from pr join w w1 on w1.word = pr.word join w w2 on w2.word = pr.after, br where joint > 1 and joint / w1.n > w2.n / total)
select 'abbreviation' as kind, word, null as after, round(score, 4) as score from ab union all select 'starter', word, null, round(score, 4) from st where score >= 30 union all select 'collocation', word, after, round(score, 4) from co where score >= 7.88"""
)
def sentence_model(spark, d):
    return sentences.train(table(spark, d, "documents")).withColumn("score", F.round("score", 4))


def _model(spark, d):
    return sentences.model_of(sentences.train(table(spark, d, "documents")))


@query()
def sentence_spans(spark, d):
    return sentences.sentences(table(spark, d, "documents"), _model(spark, d)).select("doc_id", "pos", "start", "end")


@query()
def extractive_sentences(spark, d):
    """The three sentences of the most words of each document, in its order."""
    rows = sentences.sentences(table(spark, d, "documents").withColumnRenamed("doc_id", "doc"), _model(spark, d), "doc").withColumn("text", F.rtrim("text"))
    return chunks.extractive_top_k(rows, F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)), 3)


@query()
def rouge_l(spark, d):
    """Each turn of a conversation against the one before it."""
    c = table(spark, d, "conversations")
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    rows = c.select("conv_id", "turn", lcs.rouge_l("text", before).alias("s"))
    return rows.select("conv_id", "turn", *[F.round(f"s.{x}", 4).alias(x) for x in ("precision", "recall", "f1")])


@query()
def rouge_stemmed(spark, d):
    """Stemmed words and pairs of words of each turn of a conversation against the one before it."""
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", lcs.rouge_n("text", before).alias("one"), lcs.rouge_n("text", before, 2).alias("two"), lcs.rouge_l("text", before, True).alias("long"))
    return rows.select("conv_id", "turn", *[F.round(f"{s}.f1", 4).alias(s) for s in ("one", "two", "long")])


@query(
    r"""with e as (select event_id, user_id, (props::json ->> '$.k')::bigint as k, lag((props::json ->> '$.k')::bigint) over (partition by user_id order by event_id) as b from events)
select event_id, case when b is null then '--- before' || chr(10) || '+++ after' || chr(10) || '@@ -0,0 +1,4 @@' || chr(10) || '+{' || chr(10) || '+  "k": ' || k || ',' || chr(10) || '+  "user": ' || user_id || chr(10) || '+}'
when k = b then '' else '--- before' || chr(10) || '+++ after' || chr(10) || '@@ -1,4 +1,4 @@' || chr(10) || ' {' || chr(10) || '-  "k": ' || b || ',' || chr(10) || '+  "k": ' || k || ',' || chr(10) || '   "user": ' || user_id || chr(10) || ' }' end as diff from e"""
)
def trial_diffs(spark, d):
    """Cards' diffs: each event's settings against those of the user's event before."""
    e = table(spark, d, "events").withColumn("props", F.to_json(F.struct("user_id", F.from_json("props", "k long").alias("p"))))
    settings = F.concat(F.lit('{"user": '), F.get_json_object("props", "$.user_id"), F.lit(', "k": '), F.get_json_object("props", "$.p.k"), F.lit("}"))
    e = e.select("event_id", "user_id", settings.alias("after"))
    before = F.lag("after").over(W.partitionBy("user_id").orderBy("event_id"))
    return e.withColumn("before", before).select("event_id", lcs.unified_diff("before", "after").alias("diff"))


@query(
    """with c as (select event_id, event_id % 6 as m, event_type as t, value as v from events) select event_id, case when m = 5 then null when m in (1, 2) then 'said "' || t || '" twice' when m = 4 then t || ' [cut' else t end as memo, case when m in (3, 4, 5) then null else v end as value from c"""
)
def json_repair(spark, d):
    """Answers with quotes inside strings, in fences, cut off within a string or a list, and without JSON."""
    m, t, v = F.col("event_id") % 6, F.col("event_type"), F.col("value").cast("string")
    bad = F.concat(F.lit('{"memo": "said "'), t, F.lit('" twice", "value": '), v, F.lit("}"))
    text = (
        F.when(m == 0, F.concat(F.lit('Here: {"memo": "'), t, F.lit('", "value": '), v, F.lit("} and no more"))).when(m == 1, bad).when(m == 2, F.concat(F.lit("```json\n"), bad, F.lit("\n```")))
        .when(m == 3, F.concat(F.lit('{"memo": "'), t, F.lit('", "items": [1, {"a": "x"'))).when(m == 4, F.concat(F.lit('{"memo": "'), t, F.lit(" [cut"))).otherwise(F.concat(t, F.lit(" {no json]")))
    )
    return table(spark, d, "events").select("event_id", F.from_json(codecs.extract_json(text), "memo string, value double").alias("j")).select("event_id", "j.memo", "j.value")


@query()
def company_names(spark, d):
    """Companies in all texts, each with a line of parties after it."""
    docs = table(spark, d, "documents")
    parties = F.concat(F.lit("\nBetween "), F.initcap("source"), F.lit(" & Sons Holdings Ltd., The "), F.upper("lang"), F.lit(" Print Shop, Inc. and Kappa GmbH of old."))
    return entities.entities(docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")), parties).alias("text")))
