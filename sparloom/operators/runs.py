"""Batch runs of a program over a table: identity, resuming, results, manifests, costs and caches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A program: Arrow batches with custom_id and input columns to batches with custom_id, status, output, error_type, tokens, cost.
Program = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
RESULT_DDL = "custom_id string, status string, output string, error_type string, tokens long, cost double"


def content_id(inputs: list[str], program_hash: str) -> Column:
    """First 16 hex digits of the SHA-256 of the inputs, in order of name, and the program."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("\0"))) for c in sorted(inputs)], F.lit(program_hash)), 256), 1, 16)


def program_hash(description: str) -> str:
    import hashlib

    return "sha256:" + hashlib.sha256(description.encode()).hexdigest()


def run_id(hash_: str, source: str) -> str:
    import hashlib

    return "batch-" + hashlib.sha256((hash_ + source).encode()).hexdigest()[:12]


def pending(items: DataFrame, log: DataFrame, retry_errors: bool = False) -> DataFrame:
    """Items without a record in the log; with retry_errors, failed ones again."""
    done = log.where("status = 'succeeded'") if retry_errors else log
    return items.join(done.select("custom_id"), "custom_id", "left_anti")


def execute(items: DataFrame, program: Program) -> DataFrame:
    """Runs the program in tasks over Arrow batches. Model clients are made inside the tasks, and a row's failure is a row of status error."""
    return items.mapInArrow(program, RESULT_DDL)


def manifest(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("n_total"), F.count_if(F.col("status") == "succeeded").alias("n_succeeded"), F.count_if(F.col("status") == "error").alias("n_errors"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("cost"))


def errors_by_type(log: DataFrame) -> DataFrame:
    return log.where("status = 'error'").groupBy("error_type").agg(F.count("*").alias("n"))


def classify_error(error: Column) -> Column:
    return F.when(error.rlike("(?i)timeout"), "timeout").when(error.rlike("(?i)valid|schema|decode"), "schema_validation_failed").when(error.rlike("(?i)api|provider|http"), "model_api_error").otherwise("other")


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Prices are per million tokens; unknown ones cost nothing."""
    return F.coalesce(tokens_in * price_in / 1e6 + tokens_out * price_out / 1e6, F.lit(0.0))


def trace_rollup(nodes: DataFrame) -> DataFrame:
    """(root, leaves, tokens, cost): sums over leaves only, so parents' own totals don't count twice. nodes: (root, trace, parent, tokens, cost)."""
    parents = nodes.where(F.col("parent").isNotNull()).select(F.col("parent").alias("trace")).distinct()
    leaves = nodes.join(parents, "trace", "left_anti")
    return leaves.groupBy("root").agg(F.count("*").alias("leaves"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 4).alias("cost"))


def evict_fifo(entries: DataFrame, most: int, partition: list[str]) -> DataFrame:
    """The newest `most` entries (seq) of each partition of the cache."""
    return entries.withColumn("_r", F.row_number().over(W.partitionBy(*partition).orderBy(F.desc("seq")))).where(F.col("_r") <= most).drop("_r")


def cache_lookup(requests: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached result, misses)."""
    newest = cache.groupBy(*keys).agg(F.max_by("result", "seq").alias("result"))
    return requests.join(newest, keys), requests.join(newest.select(*keys), keys, "left_anti")


def calibration(results: DataFrame) -> DataFrame:
    """(model, ...): precision on answerable questions, refusal recall, mean confidence and latency. results: (model, answerable, outcome, verified, confidence, latency)."""
    n_answerable, n_other = F.count_if("answerable"), F.count_if(~F.col("answerable"))
    verified = F.count_if(F.col("answerable") & (F.col("outcome") == "answer") & F.col("verified"))
    refused = F.count_if(~F.col("answerable") & (F.col("outcome") == "insufficient_evidence"))
    return results.groupBy("model").agg(
        F.count("*").alias("n"), F.round(F.when(n_answerable > 0, verified / n_answerable).otherwise(0.0), 4).alias("precision_answerable"), F.round(F.when(n_other > 0, refused / n_other).otherwise(0.0), 4).alias("refusal_recall"),
        F.round(F.coalesce(F.avg(F.when(F.col("outcome") == "answer", F.col("confidence"))), F.lit(0.0)), 4).alias("mean_confidence"), F.round(F.avg("latency"), 4).alias("mean_latency"), F.count_if(F.col("outcome") == "error").alias("errors"),
    )


def resume_counts(items: DataFrame, log: DataFrame) -> DataFrame:
    """(n_items, n_skipped, n_pending): what a resumed run would do."""
    done = log.select("custom_id").distinct().withColumn("_done", F.lit(True))
    return items.join(done, "custom_id", "left").agg(F.count("*").alias("n_items"), F.count("_done").alias("n_skipped"), F.count_if(F.col("_done").isNull()).alias("n_pending"))


def list_batches(batches: DataFrame, most: int = 50) -> DataFrame:
    """The newest batches (batch, created_at, ...)."""
    return batches.orderBy(F.desc("created_at"), "batch").limit(most)


def with_prices(calls: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """calls with cost: prices (model, aliases array, price_in, price_out) by model or alias, `provider/model` too; unknown models cost nothing."""
    names = prices.select(F.explode(F.array_union(F.array("model"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_name"), "price_in", "price_out")
    bare = F.regexp_replace(model, "^[^/]*/", "")
    joined = calls.withColumn("_name", F.coalesce(bare, F.lit(""))).join(names, "_name", "left")
    return joined.withColumn("cost", cost(F.col("tokens_in"), F.col("tokens_out"), F.col("price_in"), F.col("price_out"))).drop("_name", "price_in", "price_out")


def split_cost(tokens: Column, price_in: Column, price_out: Column, share_in: float = 0.7) -> Column:
    """Cost where only the total is known: seven tenths count as input."""
    return cost(tokens * share_in, tokens * (1 - share_in), price_in, price_out)


def tree_costs(nodes: DataFrame, depth: int = 16) -> DataFrame:
    """(trace, root, level, cost): each node's cost with all below it, filled bottom up; a node without cost of its own is the sum of its children.

    nodes: (root, trace, parent, cost). Levels are counted from the root; deeper ones than `depth` are an error.
    """
    level = nodes.where("parent is null").select("root", "trace", F.lit(0).alias("level"))
    out = level
    for i in range(1, depth + 1):
        level = nodes.join(level.select("root", F.col("trace").alias("parent")), ["root", "parent"]).select("root", "trace", F.lit(i).alias("level"))
        if level.isEmpty():
            break
        out = out.union(level)
    else:
        raise ValueError(f"a trace is deeper than {depth}")
    held = nodes.join(out, ["root", "trace"])
    pairs = held.select("root", F.col("trace").alias("above"), "trace")
    step = held.select("root", F.col("trace").alias("_t"), F.col("parent").alias("_p")).where("_p is not null")
    reach = pairs
    for _ in range(i):
        pairs = pairs.join(step, (pairs["root"] == step["root"]) & (pairs["above"] == step["_t"])).select(pairs["root"], F.col("_p").alias("above"), "trace")
        reach = reach.union(pairs)
    leaf = nodes.join(nodes.where("parent is not null").select("root", F.col("parent").alias("trace")).distinct(), ["root", "trace"], "left_anti").select("root", "trace", "cost")
    sums = reach.join(leaf, ["root", "trace"]).groupBy("root", "above").agg(F.round(F.sum("cost"), 6).alias("cost"))
    return out.join(sums.withColumnRenamed("above", "trace"), ["root", "trace"]).select("trace", "root", "level", "cost")


def config_fingerprint(instructions: Column, examples: Column, settings: Column) -> Column:
    """First 16 digits of a hash of instructions, examples and settings (a map, by key)."""
    listed = F.array_join(F.transform(F.array_sort(F.map_entries(settings)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return F.substring(F.sha2(F.concat_ws("\x1f", F.coalesce(instructions, F.lit("")), F.coalesce(examples, F.lit("")), listed), 256), 1, 16)


def checked_log(log: DataFrame, program: str) -> DataFrame:
    """The item records of a log (kind, program_hash, custom_id, ...) whose headers all have the program's hash; another hash is an error."""
    wrong = F.max(F.when((F.col("kind") == "header") & (F.col("program_hash") != program), F.col("program_hash")))
    found = log.agg(wrong.alias("x")).first()["x"]
    if found is not None:
        raise ValueError(f"the log is of another program: {found}")
    return log.where("kind = 'item'")


def question_outcomes(answers: DataFrame) -> DataFrame:
    """answers with outcome: error where there is one, insufficient_evidence for a refusal or an empty answer, else answer."""
    empty = F.trim(F.coalesce("answer", F.lit(""))) == ""
    return answers.withColumn("outcome", F.when(F.col("error").isNotNull(), "error").when(F.coalesce("refused", F.lit(False)) | empty, "insufficient_evidence").otherwise("answer"))


def dry_run(questions: DataFrame, model: str) -> DataFrame:
    """What calibration() takes, of a run without calls in which every answerable question (id, answerable) is answered, verified and every other refused."""
    can = F.coalesce("answerable", F.lit(False))
    return questions.select("id", F.lit(model).alias("model"), can.alias("answerable"), F.when(can, "answer").otherwise("insufficient_evidence").alias("outcome"), can.alias("verified"), F.when(can, 0.9).otherwise(0.0).alias("confidence"), F.lit(0.0).alias("latency"))
