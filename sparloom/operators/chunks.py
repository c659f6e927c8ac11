"""Chunking, retrieval and reduction of long texts. Offsets are code points, end exclusive; source[start:end] is the chunk."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from sparloom.functions.arrays import let, starts
from sparloom.operators.sentences import Model, boundaries
from sparloom.sources.scratch import shared_folder


def hard_split(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, start, end, chunk) of fixed width."""
    at = F.explode(F.when(F.length(text) > 0, F.sequence(F.lit(0), F.floor((F.length(text) - 1) / width).cast("int"))).otherwise(F.array().cast("array<int>")))
    rows = docs.select(key, text, at.alias("pos"))
    start = F.col("pos") * width
    return rows.select(key, "pos", start.alias("start"), F.least(start + width, F.length(text)).alias("end"), F.substring(F.col(text), start + 1, F.lit(width)).alias("chunk"))


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text", separator: str = r"\n{2,}", least: int = 20) -> DataFrame:
    """(key, pos, start, end, chunk): the stretches between separators (a regex) that have at least `least` characters but outer white space, counted by pos."""

    def of(gaps: Column) -> Column:
        parts = F.split(F.col(text), separator, -1)
        return let(parts, lambda p: let(starts(F.zip_with(F.transform(p, lambda x: F.length(x)), gaps, lambda n, g: n + F.coalesce(F.length(g), F.lit(0)))), lambda at: F.transform(p, lambda x, i: F.struct(at[i].alias("start"), (at[i] + F.length(x)).alias("end"), x.alias("chunk")))))

    found = let(F.regexp_extract_all(text, F.lit(separator), 0), of)
    long = F.filter(found, lambda s: F.length(F.regexp_replace(s["chunk"], r"(?U)^\s+|\s+$", "")) >= least)
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(long).alias("pos", "s")).select(key, "pos", "s.start", "s.end", "s.chunk")


def tagged_text(docs: DataFrame, key: str = "doc_id", text: str = "text", uri: str = "doc:", least: int = 20) -> DataFrame:
    """(key, tagged, tags): the text with `[SRC:<uri><key>#p<n>] ` before each paragraph of `least` characters, and map from tag to struct(start, end) in the text as it was."""
    tags = paragraphs(docs, key, text, least=least).withColumn("tag", F.concat(F.lit(uri), F.col(key).cast("string"), F.lit("#p"), F.col("pos").cast("string")))
    listed = tags.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "chunk", "tag"))).alias("_p"))
    none = F.array().cast(listed.schema["_p"].dataType)
    joined = docs.where(F.col(text).isNotNull()).select(key, text).join(listed, key, "left").withColumn("_p", F.coalesce("_p", none))
    before = lambda i: F.when(i > 0, F.get(F.col("_p"), i - 1)["end"]).otherwise(F.lit(0))
    pieces = F.transform("_p", lambda s, i: F.concat(F.substring(F.col(text), before(i) + 1, s["start"] - before(i)), F.lit("[SRC:"), s["tag"], F.lit("] "), s["chunk"]))
    rest = F.substring(F.col(text), F.coalesce(F.get("_p", F.size("_p") - 1)["end"], F.lit(0)) + 1, F.length(text))
    spans_of = F.map_from_entries(F.transform("_p", lambda s: F.struct(s["tag"], F.struct(s["start"], s["end"]))))
    return joined.select(key, F.concat(F.array_join(pieces, ""), rest).alias("tagged"), spans_of.alias("tags"))


_PARAGRAPH = re.compile(r"\n\n+")


def segments(text: str, model: Model = Model()) -> list[int]:
    """Where sentences end; where the text has no two sentences, where paragraphs do."""
    ends = boundaries(text, model) or [m.end() for m in _PARAGRAPH.finditer(text)]
    return ends if ends and ends[-1] == len(text) else [*ends, len(text)]


def pack_text(text: str, most: int, least: int, model: Model = Model()) -> list[tuple[int, int]]:
    """Segments packed greedily into chunks of at most `most` characters; a longer segment is cut; a tail under `least` joins its predecessor."""
    if len(text) <= most:
        return [(0, len(text))] if text else []
    out, start, last = [], 0, 0
    for e in segments(text, model):
        if e - start > most and last > start:
            out.append((start, last))
            start = last
        while e - start > most:
            out.append((start, start + most))
            start += most
        last = e
    if start < len(text):
        out.append((start, len(text)))
    if len(out) > 1 and out[-1][1] - out[-1][0] < least:
        tail = out.pop()
        out[-1] = (out[-1][0], tail[1])
    return out


def pack_sentences(docs: DataFrame, most: int = 2000, least: int = 200, key: str = "doc_id", text: str = "text", model: Model = Model()) -> DataFrame:
    """(key, pos, start, end, chunk) by pack_text() with sentences of the model; null and empty texts have no chunks."""
    kind = docs.schema[key].dataType

    def run(batches):
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                cuts = [pack_text(t or "", most, least, model) for t in part.column(1).to_pylist()]
                of = pa.array([i for i, c in enumerate(cuts) for _ in c], pa.int32())
                texts = part.column(1).take(of).to_pylist()
                flat = [(n, a, b) for c in cuts for n, (a, b) in enumerate(c)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), *(pa.array([f[i] for f in flat], pa.int32()) for i in range(3)), pa.array([t[a:b] for t, (_, a, b) in zip(texts, flat)], pa.string())], [key, "pos", "start", "end", "chunk"])

    return docs.select(key, text).mapInArrow(run, T.StructType([T.StructField(key, kind)] + [T.StructField(c, T.IntegerType()) for c in ("pos", "start", "end")] + [T.StructField("chunk", T.StringType())]))


def with_chunk_ids(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """chunks with chunk_id, 16 digits of a hash of its text and place."""
    return chunks.withColumn("chunk_id", F.substring(F.sha2(F.concat_ws("\x1f", F.col(key).cast("string"), "start", "end", "chunk"), 256), 1, 16))


def pooled_chunks(lists: Column) -> Column:
    """Chunk ids of several results (array of arrays), each once, in order of first use."""
    return F.array_distinct(F.flatten(lists))


def pooled_spans(a: Column, b: Column) -> Column:
    """Spans of two results, each (source, start, end) once, in order of first use."""
    return F.array_distinct(F.concat(a, b))


def bm25(docs: DataFrame, terms: list[str], k: int, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score): the k best documents for the terms; ties by key. Only rows of query terms are shuffled."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    sized = docs.select(key, F.filter(words, lambda w: w != "").alias("w")).select(key, F.size("w").alias("n"), F.filter("w", lambda w: w.isin(*terms)).alias("hits"))
    total, mean = sized.agg(F.count("*"), F.avg("n")).first()
    tf = sized.select(key, "n", F.explode("hits").alias("term")).groupBy(key, "n", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.lit(mean or 1.0)))
    return tf.join(df, "term").groupBy(key).agg(F.round(F.sum(score), 4).alias("score")).orderBy(F.desc("score"), key).limit(k)


def merge_retrieval(hits: DataFrame, k: int) -> DataFrame:
    """(query, uri, score): each query's best score for a uri, the k best."""
    best = hits.groupBy("query", "uri").agg(F.max("score").alias("score"))
    return best.withColumn("_r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "uri"))).where(F.col("_r") <= k).drop("_r")


def context_budget(passages: DataFrame, chars: int) -> DataFrame:
    """(query, doc, pos) in document order while the text so far fits; the first always does."""
    w = W.partitionBy("query").orderBy("doc", "pos")
    sized = passages.withColumn("_sum", F.sum(F.length("text")).over(w)).withColumn("_n", F.row_number().over(w))
    return sized.where((F.col("_sum") <= chars) | (F.col("_n") == 1)).drop("_sum", "_n")


def extractive_top_k(sentences: DataFrame, score: Column, k: int, joiner: str = " ") -> DataFrame:
    """(doc, summary): the k best sentences in source order."""
    top = sentences.withColumn("_s", score).withColumn("_r", F.row_number().over(W.partitionBy("doc").orderBy(F.desc("_s"), "pos"))).where(F.col("_r") <= k)
    return top.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), joiner).alias("summary"))


def expand_dedup(queries: DataFrame, most: int) -> DataFrame:
    """(query, pos, variant): variants without case-insensitive repeats, the first ones of each query."""
    w = W.partitionBy("query", F.lower(F.trim("variant"))).orderBy("pos")
    rest = queries.withColumn("_d", F.row_number().over(w)).where("_d = 1").drop("_d")
    return rest.withColumn("_r", F.row_number().over(W.partitionBy("query").orderBy("pos"))).where(F.col("_r") <= most).drop("_r")


def tree_levels(leaves: DataFrame, fan: int, merge: Callable[[str], Column], most: int = 8) -> DataFrame:
    """(doc, value, depth): leaves (doc, pos, value) merged in groups of `fan`, a lone last one into the group before, up to one a document; then flat.

    merge: Column of a grouped array of values in order. Each level is written, so that no later one computes it again.
    """
    folder = shared_folder(leaves.sparkSession, "tree")
    level = leaves.select("doc", "pos", "value", F.lit(0).alias("depth"))
    for depth in range(1, most + 1):
        n = F.count("*").over(W.partitionBy("doc"))
        rank = F.row_number().over(W.partitionBy("doc").orderBy("pos")) - 1
        group = F.when((rank == n - 1) & (n % fan == 1) & (n > fan), F.floor(rank / fan) - 1).otherwise(F.floor(rank / fan)) if depth < most else F.lit(0)
        grouped = level.withColumn("_n", n).withColumn("_g", group.cast("long"))
        values = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"])
        level = grouped.groupBy("doc", F.col("_g").alias("pos")).agg(merge(values).alias("value"), F.max(F.when(F.col("_n") > 1, F.lit(depth)).otherwise(F.col("depth"))).alias("depth"))
        level.write.parquet(f"{folder}/{depth}")
        level = leaves.sparkSession.read.parquet(f"{folder}/{depth}")
        if level.groupBy("doc").count().where("count > 1").isEmpty():
            break
    return level.select("doc", "value", "depth")


def cluster_reduce(leaves: DataFrame, merge: Callable[[Column], Column], last: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc, value, clusters, depth): leaves (doc, pos, cluster, value) merged in order within their cluster, then the clusters' values in order of their first leaf; one cluster alone takes no last merge (`last`, merge where none is given)."""
    ordered = lambda: F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"])
    parts = leaves.groupBy("doc", "cluster").agg(merge(ordered()).alias("value"), F.min("pos").alias("pos"))
    done = parts.groupBy("doc").agg(F.count("*").alias("clusters"), ordered().alias("_v"))
    return done.select("doc", F.when(F.size("_v") == 1, F.col("_v")[0]).otherwise((last or merge)(F.col("_v"))).alias("value"), "clusters", F.when(F.col("clusters") == 1, 1).otherwise(2).alias("depth"))


def refine_fold(leaves: DataFrame, start: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """(doc, value): a left fold over the leaves in order."""
    values = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return leaves.groupBy("doc").agg(values.alias("v")).select("doc", F.aggregate("v", start, lambda a, s: step(a, s["value"])).alias("value"))


#: Reducers by name: functions of leaves (doc, pos, value; cluster for `cluster`) that give (doc, value, ...).
REDUCERS: dict[str, Callable] = {
    "map_reduce": lambda leaves, merge, **_: leaves.groupBy("doc").agg(merge(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"])).alias("value")),
    "refine": lambda leaves, start, step, **_: refine_fold(leaves, start, step),
    "tree": lambda leaves, merge, fan=4, **_: tree_levels(leaves, fan, merge),
    "cluster": lambda leaves, merge, last=None, **_: cluster_reduce(leaves, merge, last),
}


def register_reducer(name: str, reducer: Callable) -> None:
    """Makes a reducer known by its name; a known name is refused."""
    if name in REDUCERS:
        raise ValueError(f"there is a reducer {name} already")
    REDUCERS[name] = reducer


def reduce_by(name: str, leaves: DataFrame, **options) -> DataFrame:
    """The leaves reduced by a reducer's name."""
    if name not in REDUCERS:
        raise ValueError(f"no reducer {name!r}; there are {', '.join(sorted(REDUCERS))}")
    return REDUCERS[name](leaves, **options)


def tag_passages(passages: DataFrame) -> DataFrame:
    """(doc, context): the passages (doc, pos, uri, text) in order, each under a header with its uri."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "uri", "text")))
    block = lambda s: F.concat(F.lit("=== SOURCE: "), s["uri"], F.lit(" ===\n\n"), s["text"])
    return passages.groupBy("doc").agg(F.array_join(F.transform(parts, block), "\n\n").alias("context"))


def passage_uri(doc_id: Column, text: Column, explicit: Column, block_ref: Column, char_start: Column) -> Column:
    """An explicit uri, else an id that has a fragment already, else the id with its block, its offset or a hash of its text; a block of the whole document doesn't tell passages apart."""
    return (
        F.when(F.coalesce(explicit, F.lit("")) != "", explicit).when(F.contains(doc_id, F.lit("#")), doc_id)
        .when((F.coalesce(block_ref, F.lit("")) != "") & (block_ref != "#/body/0"), F.concat(doc_id, block_ref))
        .when(char_start.isNotNull(), F.concat(doc_id, F.lit("#c"), char_start.cast("string"))).otherwise(F.concat(doc_id, F.lit("#h"), F.substring(F.sha2(text, 256), 1, 8)))
    )


def rerank(hits: DataFrame, k: int) -> DataFrame:
    """(query, uri, score): the k best hits (query, pos, uri, score) by score within 0 and 1; a failed score (null) counts as 0, ties keep their order."""
    clamped = hits.withColumn("score", F.least(F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    return clamped.withColumn("_r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "pos"))).where(F.col("_r") <= k).select("query", "uri", "score")
