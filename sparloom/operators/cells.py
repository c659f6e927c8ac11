"""Extraction cells in long form: (doc, col, status, value, confidence)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparloom.functions import codecs
from sparloom.functions.arrays import let


def project_cells(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One cell for each row and column; null is not_in_document."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.select(F.col(key).alias("doc"), cells.alias("c")).select("doc", "c.col", F.when(F.col("c.value").isNull(), "not_in_document").otherwise("extracted").alias("status"), "c.value")


def pivot_cells(cells: DataFrame, columns: list[str]) -> DataFrame:
    return cells.groupBy("doc").pivot("col", columns).agg(F.first("value", ignorenulls=True))


def canonical_value(value: Column, kind: Column) -> Column:
    """The form in which equal values of a kind (date, entity, money, number, duration, text) are the same; a value that has none counts as its trimmed lower case. Text is treated like entities."""
    plain = F.lower(F.trim(value))
    of = {"date": codecs.date_text_key(value), "money": codecs.money_text_key(value), "number": codecs.number_key(value), "duration": codecs.duration_text_key(value)}
    out = F.when(kind.isin("entity", "text"), codecs.entity_key(value))
    for k, c in of.items():
        out = out.when(kind == k, c)
    return let(out, lambda key: F.when(key != "", key).otherwise(plain))


def dedup_cells(cells: DataFrame, canonical: Column) -> tuple[DataFrame, DataFrame]:
    """(cells, lineage): of each column and canonical value the extracted cell of the smallest pos; all others pass. lineage: (col, hash, first_doc, n); lineage_documents() lists its documents.

    cells: (doc, col, status, value, pos), pos being their order, which the result keeps as a column.
    """
    takes_part = F.coalesce((F.col("status") == "extracted") & F.col("value").isNotNull(), F.lit(False))
    own = cells.where(takes_part).select(F.struct(*[F.col(f"`{c}`") for c in cells.columns]).alias("_cell"), "col", "doc", "pos", F.substring(F.sha2(canonical, 256), 1, 16).alias("_hash"))
    first = own.groupBy("col", "_hash").agg(F.min_by("_cell", "pos").alias("_cell"), F.min_by("doc", "pos").alias("first_doc"), F.count("*").alias("n"))
    kept = first.select("_cell.*").unionByName(cells.where(~takes_part))
    return kept, first.select("col", F.col("_hash").alias("hash"), "first_doc", "n")


def lineage_documents(cells: DataFrame, canonical: Column) -> DataFrame:
    """(col, hash, doc): the documents of each column's canonical values, a row each, however many have one value."""
    takes_part = (F.col("status") == "extracted") & F.col("value").isNotNull()
    return cells.where(takes_part).select("col", F.substring(F.sha2(canonical, 256), 1, 16).alias("hash"), "doc").distinct()


def refusal_policy(cells: DataFrame, policy: str = "row") -> DataFrame:
    """row: a document with any refused cell loses all its values; cell: only refused cells do; never: a refused cell is an error."""
    refused = F.col("status").isin("not_in_document", "unclear")
    if policy == "never":
        return cells.withColumn("status", F.when(refused, F.raise_error(F.concat(F.lit("refused: "), F.col("doc").cast("string"), F.lit(" "), F.col("col"))).cast("string")).otherwise(F.col("status")))
    gone = F.max(refused).over(W.partitionBy("doc")) if policy == "row" else refused
    return cells.withColumn("value", F.when(~gone, F.col("value"))).withColumn("status", F.when(gone, "refused").otherwise(F.col("status")))


def with_columns(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """cells with what columns (col, ...) says of their column; a cell of an unknown column keeps nulls. Columns are as many as a schema has."""
    return cells.join(columns, "col", "left")


def pointed(row: Column, pointer: str) -> Column:
    """The value that a pointer such as `$.inputs.x` or `$.steps.id.output.f` names in a struct; Spark reads only the fields that are named."""
    parts = pointer.split(".")
    if parts[0] != "$" or len(parts) < 2 or not all(parts):
        raise ValueError(f"{pointer!r} is no pointer")
    for p in parts[1:]:
        row = row[p]
    return row


def check_pointers(steps: list[tuple[str, list[str]]], inputs: list[str]) -> list[str]:
    """What is wrong with the pointers of steps (id, pointers) in order: only inputs and the output of earlier steps may be named."""
    known: set[str] = set()
    wrong = []
    for name, pointers in steps:
        for p in pointers:
            parts = p.split(".")
            if not (len(parts) >= 3 and parts[0] == "$" and ((parts[1] == "inputs" and parts[2] in inputs) or (len(parts) >= 5 and parts[1] == "steps" and parts[2] in known and parts[3] == "output"))):
                wrong.append(f"{name}: {p}")
        known.add(name)
    return wrong


def declared_fields(c: Column, fields: dict[str, str], required: list[str] = ()) -> Column:
    """Of a JSON object the declared fields, others dropped; an object that lacks a required one is an error."""
    ddl = ", ".join(f"{k} {t}" for k, t in fields.items())
    held = F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))
    lacks = F.filter(F.array(*[F.lit(r) for r in required]).cast("array<string>"), lambda r: ~F.array_contains(held, r))
    error = F.raise_error(F.concat(F.lit("missing fields: "), F.array_join(lacks, ", "))).cast("string")
    return F.from_json(F.when(F.size(lacks) > 0, error).otherwise(c), ddl)


def sample_text(docs: DataFrame, chars: int = 500, separator: str = "\n\n---\n\n", key: str = "doc", text: str = "text") -> DataFrame:
    """(sample): each document's first characters, as a schema is designed from, in order of key. For a stated few documents: the result is one row."""
    parts = F.array_sort(F.collect_list(F.struct(key, F.substring(text, 1, chars).alias("t"))))
    return docs.agg(F.array_join(F.transform(parts, lambda s: s["t"]), separator).alias("sample"))


def merge_hits(cells: DataFrame, hits: DataFrame, citations: int = 5, confidence: float = 0.8) -> DataFrame:
    """Cells with rule-based hits (doc, col, key): agreeing hits are cited, a refused cell with exactly one distinct hit takes it.

    hits are reduced to counts before the join, so a document with many hits moves one row.
    """
    by_key = hits.groupBy("doc", "col", "key").agg(F.count("*").alias("_n"))
    summary = by_key.groupBy("doc", "col").agg(F.count("*").alias("_kinds"), F.min("key").alias("_only"))
    agree = by_key.select("doc", "col", F.col("key").alias("value"), F.least("_n", F.lit(citations)).alias("cited"))
    out = cells.join(agree, ["doc", "col", "value"], "left").join(summary, ["doc", "col"], "left")
    promoted = F.col("status").isin("not_in_document", "unclear") & (F.col("_kinds") == 1)
    return out.select("doc", "col", F.when(promoted, "extracted").otherwise(F.col("status")).alias("status"), F.when(promoted, F.col("_only")).otherwise(F.col("value")).alias("value"), F.when(promoted, F.lit(confidence)).otherwise(F.lit(1.0)).alias("confidence"), F.coalesce(F.when(F.col("status") == "extracted", F.col("cited")), F.lit(0)).cast("long").alias("cited"))


def promote_retries(candidates: DataFrame, confidence: float = 0.7) -> DataFrame:
    """(doc, col, value, confidence, n): the first chunk's value of each refused cell and how many distinct ones there were."""
    return candidates.groupBy("doc", "col").agg(F.min_by("value", F.struct("chunk", "value")).alias("value"), F.lit(confidence).alias("confidence"), F.count_distinct("value").alias("n"))


def merge_list_hits(cells: DataFrame, hits: DataFrame, canonical: Callable[[Column], Column] = lambda c: F.lower(F.trim(c))) -> DataFrame:
    """(doc, col, status, values, added): list cells with the rule-based hits (doc, col, pos, key) that they lack, in order of appearance.

    A refused cell with a hit becomes extracted. Repeated hits are reduced to one before they are gathered.
    """
    first = hits.withColumn("_c", canonical(F.col("key"))).groupBy("doc", "col", "_c").agg(F.min(F.struct("pos", "key")).alias("_hit"))
    found = first.groupBy("doc", "col").agg(F.array_sort(F.collect_list("_hit")).alias("_hits"))
    own = F.when(F.col("status") == "extracted", F.col("values")).otherwise(F.array().cast("array<string>"))
    known = F.transform(own, canonical)
    new = F.filter(F.transform(F.coalesce("_hits", F.array().cast("array<struct<pos:bigint,key:string>>")), lambda h: h["key"]), lambda k: ~F.array_contains(known, canonical(k)))
    out = cells.join(found, ["doc", "col"], "left").withColumn("_new", new)
    return out.select("doc", "col", F.when(F.size("_new") > 0, "extracted").otherwise(F.col("status")).alias("status"), F.concat(own, "_new").alias("values"), F.size("_new").alias("added"))


def valid_at(start: Column, end: Column, instant: Column) -> Column:
    """Whether a claim holds at an instant: from its start on, before its end if it has one."""
    return (start <= instant) & (end.isNull() | (instant < end))
