"""Quality by perplexity: an interpolated modified Kneser-Ney model of character 4-grams, trained on trusted texts.

Documents are read in batches of rows that lie together in a file. Each batch sends
its distinct n-grams, with their counts in trusted texts, once. Counts are summed by
n-gram over shards; discounts, back-off weights and the probabilities of all n-grams
that any batch asks for come from joins of sharded count tables; each batch gets its
answers back and scores its documents. All counts cover all texts and grow with the
input; what a task holds is one batch's distinct n-grams.

Symbols are UTF-16 code units, 16 bits of a 64-bit key each: a character is one symbol
(two beyond U+FFFF), and different n-grams have different keys. The code points 0 and
1 stand for a text's beginning and end; in texts they count as spaces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import as_text, column, free_name, slices, stage

ORDER, _BITS = 4, 16
_PAD, _END = 0, 1
#: Rows of a file that are one batch, and distinct n-grams that a task holds before it sends them.
BATCH_ROWS, HELD = 8192, 4_000_000
#: Bytes of trusted ids up to which they are broadcast; beyond, they are joined by shuffle.
BROADCAST_BYTES = 64 << 20


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of each position's n-gram: every symbol and each text's end, after ORDER - 1 pads."""
    clean = [t.translate({0: " ", 1: " "}) if "\0" in t or "\1" in t else t for t in texts]
    flat = "".join(f"\0\0\0{t}\1" for t in clean)
    p = np.frombuffer(flat.encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64)
    text = np.cumsum(p == _END) - (p == _END)
    keys = p[:-3] << np.uint64(48) | p[1:-2] << np.uint64(32) | p[2:-1] << np.uint64(16) | p[3:]
    own = p[3:] != _PAD
    return text[3:][own], keys[own].view(np.int64)


def _placed(docs: DataFrame) -> DataFrame:
    """docs with a column `batch`: the file and the BATCH_ROWS rows of it that a row is among, the same whenever it is read.

    Rows that don't come straight from Parquet files are written first.
    """
    place = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / BATCH_ROWS))
    try:
        return docs.select("*", place.alias("batch"))
    except AnalysisException:
        return stage(docs).select("*", place.alias("batch"))


def _grams(docs: DataFrame) -> DataFrame:
    """(batch, key, n): each batch's distinct n-grams and their counts in trusted texts."""

    def run(batches):
        held: dict[int, list] = {}
        size = 0

        def flush():
            for b, parts in held.items():
                keys, n = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
                unique, which = np.unique(keys, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unique), b)), pa.array(unique), pa.array(np.bincount(which, n, len(unique)).astype(np.int64))], ["batch", "key", "n"])

        for batch in slices(batches, "text"):
            of = column(batch, "batch").to_numpy()
            trained = column(batch, "trained").to_numpy(zero_copy_only=False)
            text, keys = symbols(as_text(batch, "text"))
            for b in np.unique(of):
                here = (of == b)[text] if (of != b).any() else slice(None)
                k, good = keys[here], trained[text[here]]
                for part, counted in ((k[good], True), (k[~good], False)):
                    unique, n = np.unique(part, return_counts=True)
                    held.setdefault(int(b), []).append((unique, n if counted else np.zeros(len(n), np.int64)))
                    size += len(unique)
            if size > HELD:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    return docs.select("batch", "text", "trained").mapInArrow(run, "batch long, key long, n long")


def _low(key: str | Column, k: int) -> Column:
    """The last k symbols of a key."""
    c = F.col(key) if isinstance(key, str) else key
    return c if k == ORDER else c.bitwiseAND(F.lit((1 << _BITS * k) - 1))


def _before(key: str | Column) -> Column:
    """A key without its last symbol."""
    return F.shiftrightunsigned(key, _BITS)


def log_probabilities(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, logp) of the distinct keys of `asked` under the model of counts (key, n > 0)."""
    tables = {ORDER: counts.select("key", F.col("n").alias("c"))}
    for k in range(ORDER - 1, 0, -1):  # lower orders count the distinct symbols before
        tables[k] = stage(tables[k + 1].groupBy(_low("key", k).alias("key")).agg(F.count("*").alias("c")))
    rows = asked
    for k in range(ORDER, 0, -1):
        n1, n2, n3, n4 = tables[k].agg(*[F.count_if(F.col("c") == i) for i in (1, 2, 3, 4)]).first()
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d1, d2, d3 = (min(max(i - (i + 1) * y * b / a, 0.0), float(i)) if a and b else 0.5 * i for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        of = tables[k].groupBy(_before("key").alias("h")).agg(F.sum("c").alias("total"), F.sum(cut).alias("cut"))
        if k == 1:
            left = of.first()
            total, mass = (left["total"], left["cut"]) if left else (1, 1.0)
            vocabulary = tables[1].count() + 1
            here = tables[1].select(F.col("key").alias("s1"), ((F.col("c") - cut) / F.lit(float(total))).alias("a1"))
            rows = rows.join(here, _low("key", 1) == F.col("s1"), "left")
            p: Column = F.coalesce("a1", F.lit(0.0)) + F.lit(mass / total / vocabulary)
        else:
            weights = of.select(F.col("h").alias(f"h{k}"), (F.col("cut") / F.col("total")).alias(f"g{k}"), "total")
            here = tables[k].join(weights, _before("key") == F.col(f"h{k}")).select(F.col("key").alias(f"s{k}"), ((F.col("c") - cut) / F.col("total")).alias(f"a{k}"))
            rows = rows.join(here, _low("key", k) == F.col(f"s{k}"), "left")
            rows = rows.join(weights.drop("total"), _before(_low("key", k)) == F.col(f"h{k}"), "left")
    for k in range(2, ORDER + 1):
        p = F.coalesce(f"a{k}", F.lit(0.0)) + F.coalesce(f"g{k}", F.lit(1.0)) * p
    return rows.select("key", F.log(p).alias("logp"))


def _packed(docs: DataFrame) -> DataFrame:
    """(batch, payload): rows of docs as compressed Arrow streams of about a slice each."""

    def run(batches):
        for batch in slices(batches, "text"):
            of = column(batch, "batch").to_numpy()
            for b in np.unique(of):
                part = batch if (of == b).all() else batch.filter(pa.array(of == b))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch", "payload"])

    return docs.mapInArrow(run, "batch long, payload binary")


def perplexities(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "perplexity", hold: int = 5) -> DataFrame:
    """docs without its text, with perplexity (a symbol's, ends included), trusted (the id is in trusted_ids) and trained.

    The model is trained on trusted rows but those of a `hold`th of the ids, by hash (hold=0: on all).

    Null text is empty (only its end is predicted). Repeated rows count as often as
    they occur; null ids are never trusted. Without trusted text every perplexity
    is 1. Input columns trusted, trained and `out` are replaced; others, of any name,
    are carried. An empty table gives no rows.
    """
    ids = stage(trusted_ids.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_trusted")).distinct())
    if ids.count() * 16 <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    names = [c for c in docs.columns if c not in (text_col, "trusted", "trained", out)]
    carry = [f"_c{i}" for i in range(len(names))]  # no name of docs is in the way
    used = F.pmod(F.xxhash64("_id"), F.lit(hold)) != 0 if hold else F.lit(True)
    plain = docs.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, carry)], F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    marked = _placed(plain).join(ids, F.col("_id") == F.col("_trusted"), "left").withColumn("trusted", F.col("_trusted").isNotNull()).withColumn("trained", F.col("trusted") & used).drop("_trusted", "_id")
    grams = stage(_grams(marked))
    counts = stage(grams.where("n > 0").groupBy("key").agg(F.sum("n").alias("n")))
    answers = stage(log_probabilities(grams.select("key").distinct(), counts))
    asked = grams.select("batch", "key").join(answers, "key").select("batch", F.lit(0).alias("part"), "key", "logp", F.lit(None).cast("binary").alias("payload"))
    texts = _packed(marked).select("batch", F.lit(1).alias("part"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("double").alias("logp"), "payload")
    schema = T.StructType([T.StructField(c, docs.schema[n].dataType) for n, c in zip(names, carry)] + [T.StructField("trusted", T.BooleanType()), T.StructField("trained", T.BooleanType()), T.StructField(out, T.DoubleType())])

    def run(batches):
        now, keys, logs = None, [], []
        known = np.zeros(0, np.int64)
        for batch in batches:
            of, part = column(batch, "batch").to_numpy(), column(batch, "part").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (part[1:] != part[:-1])]))
            for lo, hi in zip(edges, np.append(edges[1:], len(of))):
                if now != of[lo]:
                    now, keys, logs = of[lo], [], []
                rows = batch.slice(lo, hi - lo)
                if part[lo] == 0:
                    keys.append(column(rows, "key").to_numpy())
                    logs.append(column(rows, "logp").to_numpy())
                    continue
                if len(keys) != 1:
                    keys, logs = [np.concatenate(keys)], [np.concatenate(logs)]
                known, logp = keys[0], logs[0]
                for payload in column(rows, "payload"):
                    for docs_ in pa.ipc.open_stream(payload.as_buffer()):
                        n = docs_.num_rows
                        text, k = symbols(as_text(docs_, "text"))
                        at = np.searchsorted(known, k)
                        if len(k) and (at.max() >= len(known) or (known[at] != k).any()):
                            raise ValueError("an n-gram has no answer")
                        mean = np.bincount(text, logp[at], n) / np.bincount(text, minlength=n)
                        yield pa.RecordBatch.from_arrays([*(column(docs_, c) for c in carry), column(docs_, "trusted"), column(docs_, "trained"), pa.array(np.exp(-mean))], [*carry, "trusted", "trained", out])

    return asked.union(texts).repartition("batch").sortWithinPartitions("batch", "part", "key").mapInArrow(run, schema).toDF(*names, "trusted", "trained", out)


def classify(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.99) -> DataFrame:
    """perplexities() with threshold, the quantile over the language's trusted texts that the model wasn't trained on, and keep (perplexity <= threshold).

    Input columns threshold and keep are replaced. A language (null is one) with fewer than 20 of these takes the larger of its own
    quantile and that over all languages; without any anywhere, everything is kept.
    """
    found = stage(perplexities(docs.drop("threshold", "keep"), trusted_ids, id_col, text_col))
    good = found.where("trusted and not trained")
    lang, own, n = (free_name(found.columns, x) for x in ("_lang", "_own", "_n"))
    q = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000))
    by_lang = good.groupBy(F.col(lang_col).alias(lang)).agg(q.alias(own), F.count("*").alias(n))
    overall = good.agg(q).first()[0]
    joined = found.join(by_lang, F.col(lang_col).eqNullSafe(F.col(lang)), "left")
    threshold = F.coalesce(F.when(F.col(n) >= 20, F.col(own)), F.greatest(own, F.lit(overall).cast("double")), F.lit(float("inf")))
    return joined.withColumn("threshold", threshold).drop(lang, own, n).withColumn("keep", F.col("perplexity") <= F.col("threshold"))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, keep) of all documents; trusted are those with label quality = 1.

    Null texts count as empty. Repeated rows are scored alike and count as often as they
    occur; a null doc_id is never trusted; null is a language. Without trusted documents
    everything is kept. Empty table: no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return classify(docs, trusted).select("doc_id", "lang", "perplexity", "threshold", "keep")
