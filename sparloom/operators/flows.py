"""Whole programs with the model calls injected: chunked classification, grounded answers, hybrid summaries, envelopes, corpus extraction."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparloom.operators import cells, chunks, votes


def chunked_classify(docs: DataFrame, split: Callable[[DataFrame], DataFrame], classify: Callable[[Column], Column], labels: list[str], aggregator: str | None = None, exclusive: bool = True, key: str = "doc_id", **options) -> tuple[DataFrame, DataFrame]:
    """(answers, provenance): documents are split into chunks (key, pos, start, end, chunk), classify gives each an array of struct(label, score), and an aggregator makes one answer of a document's picks.

    Picks that are no label are left out. Documents without chunks, or whose chunks pick
    nothing, have no answer row. provenance: the chunks used and spans, see votes.provenance().
    """
    parts = split(docs)
    picked = parts.select(F.col(key).alias("doc"), F.col("pos").alias("chunk"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.posexplode(classify(F.col("chunk"))).alias("n", "p"))
    picks = picked.where(F.col("p.label").isin(*labels)).select("doc", "chunk", (F.col("chunk").cast("long") * 1000 + F.col("n")).alias("pos"), F.col("p.label").alias("label"), F.col("p.score").cast("double").alias("score"), F.col("p.score").cast("double").alias("weight"), F.col("doc").cast("string").alias("source"), "start", "end")
    return votes.aggregate(picks, aggregator, exclusive, **options), votes.provenance(picks)


def grounded(produce: Callable[[Column], Column], errors: Callable[[Column], Column], attempts: int) -> Column:
    """struct(output, errors, attempts): outputs are made and verified until one has no errors, `attempts` at most; the one of the fewest errors is kept, the earliest on ties.

    produce(attempt, from 0 on) may use what was found wrong before by way of the
    attempt; an output that is null counts as having more errors than any other.
    """
    worst = F.lit(2**31 - 1)

    def judged(i: Column) -> Column:
        return F.struct(produce(i).alias("output"), i.alias("i"))

    def step(a: Column, i: Column) -> Column:
        new = judged(i)["output"]
        found = F.when(new.isNull(), worst).otherwise(F.coalesce(errors(new).cast("int"), worst))
        better = found < a["errors"]
        tried = F.struct(F.when(better, new).otherwise(a["output"]).alias("output"), F.least(found, a["errors"]).alias("errors"), (i + 1).alias("attempts"))
        return F.when(a["errors"] == 0, a).otherwise(tried)

    begin = produce(F.lit(0))
    first = F.struct(begin.alias("output"), F.when(begin.isNull(), worst).otherwise(F.coalesce(errors(begin).cast("int"), worst)).alias("errors"), F.lit(1).alias("attempts"))
    if attempts < 2:
        return first
    return F.aggregate(F.sequence(F.lit(1), F.lit(attempts - 1)), first, step)


def hybrid_summary(sentences: DataFrame, score: Column, k: int, summarise: Callable[[Column], Column], joiner: str = " ") -> DataFrame:
    """(doc, extract, spans, summary): the k best sentences (doc, pos, start, end, text) of a document, in its order, are what the summariser is given; spans are theirs.

    Ties go to the earlier sentence; a null score is the lowest. Documents without sentences have no row.
    """
    rank = F.row_number().over(W.partitionBy("doc").orderBy(F.desc_nulls_last("_s"), "pos"))
    top = sentences.withColumn("_s", score).withColumn("_r", rank).where(F.col("_r") <= k)
    listed = top.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "start", "end", "text"))).alias("x"))
    made = listed.select("doc", F.array_join(F.transform("x", lambda s: s["text"]), joiner).alias("extract"), F.transform("x", lambda s: F.struct(s["start"], s["end"])).alias("spans"))
    return made.withColumn("summary", summarise(F.col("extract")))


@dataclass(frozen=True)
class Step:
    """A step of an envelope: its id, the program that runs, and where each of its inputs comes from (`$.inputs.x`, `$.steps.id.output.y`)."""

    id: str
    program: str
    inputs: dict[str, str]


def run_envelope(rows: DataFrame, inputs: list[str], steps: list[Step], output: dict[str, str], programs: dict[str, Callable[[dict[str, Column]], Column]]) -> DataFrame:
    """rows with `output`, a struct: the steps run in order, each program (inputs by name to a Column) by its name; a result that is no struct is {result: it}.

    Pointers are checked first: only declared inputs and outputs of earlier steps may be named.
    """
    unknown = [s.program for s in steps if s.program not in programs]
    wrong = cells.check_pointers([(s.id, list(s.inputs.values())) for s in steps] + [("output", list(output.values()))], inputs)
    if unknown or wrong or len({s.id for s in steps}) < len(steps):
        raise ValueError(f"unknown programs {unknown}, wrong pointers {wrong}, or an id twice")
    out = rows.withColumn("_env", F.struct(*[F.col(c) for c in inputs]))
    done: dict[str, str] = {}

    def at(pointer: str) -> Column:
        parts = pointer.split(".")
        return cells.pointed(F.struct(F.col("_env").alias("inputs")), pointer) if parts[1] == "inputs" else cells.pointed(F.struct(F.struct(F.col(done[parts[2]]).alias("output")).alias(parts[2])), f"$.{'.'.join(parts[2:])}")

    for n, step in enumerate(steps):
        made = programs[step.program]({name: at(p) for name, p in step.inputs.items()})
        name = f"_step{n}"
        out = out.withColumn(name, made)
        if out.schema[name].dataType.typeName() != "struct":
            out = out.withColumn(name, F.struct(F.col(name).alias("result")))
        done[step.id] = name
    return out.withColumn("output", F.struct(*[at(p).alias(k) for k, p in output.items()])).drop("_env", *done.values())


def extract_whole(docs: DataFrame, key: str, extractors: dict[str, Callable[[Column], Column]], rules: dict[str, Callable[[Column], Column]], kinds: dict[str, str], width: int = 2000, text: str = "text", policy: str = "cell") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, kept, lineage): extraction of a corpus in four steps.

    1. Each extractor (text to a value or null) gives a cell (doc, col, status, value).
    2. Rule-based hits (text to an array of values) confirm cells, and a refused cell with
       exactly one distinct hit takes it (confidence 0.8).
    3. What is refused still is tried again on chunks of `width` characters; the first
       chunk's value is taken (confidence 0.7). Only documents with such cells are split.
    4. Refusals follow the policy; kept: of equal values of a column, told by kind, the first
       document's cell; lineage: (col, hash, first_doc, n).

    cells: (doc, col, status, value, confidence, cited). key is unique.
    """
    base = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    values = base.select("doc", *[f(F.col("_text")).cast("string").alias(c) for c, f in extractors.items()])
    long = cells.project_cells(values, "doc", list(extractors))
    named = lambda c: lambda v: F.struct(F.lit(c).alias("col"), v.cast("string").alias("key"))
    hits = F.explode(F.flatten(F.array(*[F.transform(f(F.col("_text")), named(c)) for c, f in rules.items()]))) if rules else None
    told = base.select("doc", hits.alias("h")).select("doc", "h.col", "h.key") if rules else base.select("doc", F.lit("").alias("col"), F.lit("").alias("key")).limit(0)
    merged = cells.merge_hits(long, told)
    open_cells = merged.where(F.col("status").isin("not_in_document", "unclear")).select("doc", "col")
    again = base.join(open_cells.select("doc").distinct(), "doc", "left_semi").where(F.length("_text") > width)
    parts = chunks.hard_split(again, width, "doc", "_text")
    tried = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), f(F.col("chunk")).cast("string").alias("value")) for c, f in extractors.items()]))
    found = parts.select("doc", F.col("pos").alias("chunk"), tried.alias("t")).select("doc", "chunk", "t.*").where("value is not null").join(open_cells, ["doc", "col"], "left_semi")
    retried = cells.promote_retries(found).select("doc", "col", F.col("value").alias("_value"), F.col("confidence").alias("_confidence"))
    whole = merged.join(retried, ["doc", "col"], "left")
    new = F.col("_value").isNotNull()
    whole = whole.select("doc", "col", F.when(new, "extracted").otherwise(F.col("status")).alias("status"), F.coalesce("_value", "value").alias("value"), F.when(new, F.col("_confidence")).otherwise(F.col("confidence")).alias("confidence"), "cited")
    whole = cells.refusal_policy(whole, policy)
    place = F.create_map(*[F.lit(x) for n, c in enumerate(extractors) for x in (c, n)])
    placed = whole.withColumn("pos", F.struct("doc", place[F.col("col")].alias("n")))
    kind = F.create_map(*[F.lit(x) for c in extractors for x in (c, kinds.get(c, "plain"))])[F.col("col")]
    kept, lineage = cells.dedup_cells(placed, cells.canonical_value(F.col("value"), kind))
    return whole, kept.drop("pos"), lineage
