"""Sources and sinks of batch items. Schemas are always given; malformed lines are kept apart or raise."""

from __future__ import annotations

import json
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sparloom.operators.runs import content_id


def list_source(spark: SparkSession, rows: list[dict], schema: str, program_hash: str | None = None) -> DataFrame:
    """Rows of the driver. __custom_id__ and __metadata__ (map) of a row become custom_id and metadata; with a program's hash a row without id gets one from its inputs."""
    inputs = T.StructType.fromDDL(schema)
    full = T.StructType([*inputs.fields, T.StructField("custom_id", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])
    data = [(*(r.get(f.name) for f in inputs.fields), r.get("__custom_id__"), r.get("__metadata__")) for r in rows]
    out = spark.createDataFrame(data, full)
    return out if program_hash is None else out.withColumn("custom_id", F.coalesce("custom_id", content_id([f.name for f in inputs.fields], program_hash)))


class ItemSource(DataSource):
    """`spark.read.format("items")`: what a user's generator yields. Options: factory, `module:function`, called in a task with (part, parts), and parts.

    Its rows are (custom_id, inputs as JSON text, metadata as JSON text), so that any source of items needs no more than a generator.
    """

    @classmethod
    def name(cls) -> str:
        return "items"

    def schema(self) -> str:
        return "custom_id string, inputs string, metadata string"

    def reader(self, schema) -> DataSourceReader:
        return _ItemReader(self.options["factory"], int(self.options.get("parts", "1")))


class _ItemReader(DataSourceReader):
    def __init__(self, factory: str, parts: int):
        self.factory, self.parts = factory, parts

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.parts)]

    def read(self, partition):
        module, _, name = self.factory.partition(":")
        for item in getattr(import_module(module), name)(partition.value, self.parts):
            yield item.get("custom_id"), json.dumps(item["inputs"], sort_keys=True), json.dumps(item.get("metadata", {}), sort_keys=True)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text): the lines of text files that aren't blank, counted from 1 in each file.

    Lines are counted by block of a file and numbered from the sums of the blocks before, so a file is read in as many tasks as it has blocks.
    """
    block = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
    rows = spark.read.text(path).select(block.alias("b"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))
    blocks = rows.groupBy("b").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("b.path").orderBy("b.at").rowsBetween(W.unboundedPreceding, -1))
    placed = blocks.select("b", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    return rows.join(placed, "b").select("b.path", (F.col("id") + F.col("shift")).alias("line"), "text").where(F.trim("text") != "")


def jsonl_source(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One item for each line that isn't blank. strict: a malformed line raises; else it is left out."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(schema + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).where("_corrupt is null").drop("_corrupt")


def jsonl_items(lines: DataFrame, schema: str) -> DataFrame:
    """(inputs struct, custom_id, metadata map) of lines (path, line, text): structured ones hold an object `inputs`, flat ones are the inputs and have their line as metadata.source_line. A line that isn't an object is an error."""
    text = F.col("text")
    outer = F.from_json(text, "inputs string, custom_id string, metadata map<string,string>")
    structured = F.coalesce(F.json_object_keys(outer["inputs"]).isNotNull(), F.lit(False))
    checked = F.when(F.json_object_keys(text).isNull(), F.raise_error(F.concat(F.lit("no object in line "), F.col("line").cast("string"))).cast("string")).otherwise(text)
    inputs = F.from_json(F.when(structured, outer["inputs"]).otherwise(checked), schema)
    given = F.coalesce(outer["metadata"], F.create_map().cast("map<string,string>"))
    metadata = F.when(structured, given).otherwise(F.create_map(F.lit("source_line"), F.col("line").cast("string")))
    return lines.select(inputs.alias("inputs"), F.when(structured, outer["custom_id"]).alias("custom_id"), metadata.alias("metadata"))


def tabular_source(spark: SparkSession, path: str, sql: str | None = None, order_by: list[str] | None = None, max_rows: int | None = 10_000, format: str = "parquet", **options) -> DataFrame:
    """A file or folder as rows, through an optional SQL query over $TABLE, at most max_rows in the given order."""
    table = spark.read.format(format).options(**options).load(path)
    if sql:
        table = spark.sql(sql.replace("$TABLE", "{data}"), data=table)
    if order_by:
        table = table.orderBy(*order_by)
    return table.limit(max_rows) if max_rows is not None else table


def corpus_source(passages: DataFrame) -> DataFrame:
    """(doc, text): passages (doc, pos, text) in order, an empty line between."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"])
    return passages.groupBy("doc").agg(F.array_join(ordered, "\n\n").alias("text"))


def binary_source(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", "content")


def open_source(spark: SparkSession, descriptor: dict) -> DataFrame:
    """By descriptor: {"type": "list" | "jsonl" | "tabular" | "binary", ...}."""
    kinds = {"list": list_source, "jsonl": jsonl_source, "tabular": tabular_source, "binary": binary_source}
    rest = {k: v for k, v in descriptor.items() if k != "type"}
    return kinds[descriptor["type"]](spark, **rest)


HEADER_DDL = "kind string, run_id string, program_hash string, source string"


def write_header(spark: SparkSession, path: str, run_id: str, program_hash: str, source: str) -> None:
    """Begins a log folder; a folder that has records of another program must not be gone on with (runs.checked_log)."""
    spark.createDataFrame([("header", run_id, program_hash, source)], HEADER_DDL).coalesce(1).write.mode("append").json(path)


def append_log(records: DataFrame, path: str, kind: str = "item") -> None:
    """Adds records to a log folder; files appear when all of the job's tasks are done."""
    records.withColumn("kind", F.lit(kind)).write.mode("append").json(path)


def load_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, bad): the sound lines of log files as rows of schema, and the others (path, line, text, final).

    A bad last line of a file (final) was cut off in writing, as happens when a run dies; one
    before it means that the log is damaged, and counts made of it miss a record.
    """
    lines = text_lines(spark, path)
    sound = F.json_object_keys("text").isNotNull()
    ends = lines.groupBy("path").agg(F.max("line").alias("_last"))
    bad = lines.where(~sound).join(ends, "path").select("path", "line", "text", (F.col("line") == F.col("_last")).alias("final"))
    return lines.where(sound).select(F.from_json("text", schema).alias("r")).select("r.*"), bad


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All sound records of a log folder, cut-off lines left out."""
    return jsonl_source(spark, path, schema, strict=False)


def questions_source(spark: SparkSession, path: str) -> DataFrame:
    """A calibration set: one question a line."""
    return jsonl_source(spark, path, "id string, answerable boolean, question string, expected_doc_id string, expected_answer_hint string, diagnostic_char_span array<int>, reason string")


def trace_nodes(lines: DataFrame, depth: int = 8) -> DataFrame:
    """(root, trace, parent, call_name, tokens, cost, level) of trace trees (text), one JSON object with nested `children` a row; deeper nodes than `depth` are an error."""
    node = "trace_id string, call_name string, total_tokens long, cost_usd double, children array<string>"
    level = lines.select(F.from_json("text", node).alias("n")).select(F.col("n.trace_id").alias("root"), F.lit(None).cast("string").alias("parent"), "n")
    out = None
    for i in range(depth + 1):
        part = level.select("root", F.col("n.trace_id").alias("trace"), "parent", "n.call_name", F.col("n.total_tokens").alias("tokens"), F.col("n.cost_usd").alias("cost"), F.lit(i).alias("level"))
        out = part if out is None else out.union(part)
        level = level.select("root", F.col("n.trace_id").alias("parent"), F.explode("n.children").alias("c")).select("root", "parent", F.from_json("c", node).alias("n"))
    rest = level.select("root", F.lit(None).cast("string"), "parent", F.raise_error(F.lit(f"a trace is deeper than {depth}")).cast("string"), F.lit(0).cast("long"), F.lit(0.0), F.lit(depth + 1))
    return out.union(rest)
