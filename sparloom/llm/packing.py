"""Concatenate and cut: documents' tokens in one endless row, cut into fixed windows.

Pass one tokenizes each partition and notes where each document begins within it;
the partitions' totals are summed up to global offsets; pass two cuts at multiples
of the window. Nothing is shuffled: the ids are written once and read once. Every
sequence is full but the last one, so there is hardly any padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import as_text, column, out_batch, slices, stage
from .tokens import encoder

def tokenize(docs: DataFrame, tokenizer: str, text_col: str = "text", end_id: int = 1) -> DataFrame:
    """docs with part, local_start, doc_tokens and ids (little-endian unsigned of id_bytes each) in place of the text.

    local_start: tokens of earlier documents in the same partition `part`. Null and
    empty texts are the end id alone. Input columns of these names are replaced.
    """
    new = ("part", "local_start", "doc_tokens", "id_bytes", "ids")
    carry = [c for c in docs.columns if c not in (text_col, *new)]

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer)
        for batch in slices(batches, text_col):
            ids = [np.append(x, enc.dtype(end_id)) for x in enc.encode(as_text(batch, text_col))]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            ends = at + np.cumsum(sizes)
            n = len(ids)
            yield out_batch(batch, carry, {
                "part": pa.array(np.full(n, part, np.int32)), "local_start": pa.array(ends - sizes), "doc_tokens": pa.array(sizes),
                "id_bytes": pa.array(np.full(n, np.dtype(enc.dtype).itemsize, np.int32)), "ids": pa.array([x.tobytes() for x in ids], pa.binary()),
            })
            at = int(ends[-1])

    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField("part", T.IntegerType()), T.StructField("local_start", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("id_bytes", T.IntegerType()), T.StructField("ids", T.BinaryType())])
    return docs.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of documents: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, boundary (and ids).

    start: tokens of the document before the piece; offset: tokens of its sequence
    before it; boundary: the document goes on in another piece. Sequences fill up
    in the order of partitions and rows. Repeated rows are packed each for itself;
    a null id is carried. An empty table has no pieces. The driver sums up one total
    for each partition of docs: as many numbers as it has tasks anyway.
    """
    spark = docs.sparkSession
    tokens = stage(tokenize(docs.select(F.col(id_col), F.col(text_col)), tokenizer, text_col, end_id))
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n")).toArrow().sort_by("part")
    parts = totals.column("part").to_numpy().astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(totals.column("n").to_numpy(), dtype=np.int64)])
    bases = spark.sparkContext.broadcast((parts, sums))

    def run(batches):
        known, before = bases.value
        for batch in slices(batches, "ids"):
            begin = column(batch, "local_start").to_numpy() + before[np.searchsorted(known, column(batch, "part").to_numpy())]
            total = column(batch, "doc_tokens").to_numpy()
            pieces = (begin + total - 1) // window - begin // window + 1
            row = np.repeat(np.arange(len(total)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = begin[row] // window + nth
            lo = np.maximum(sequence * window, begin[row])
            hi = np.minimum((sequence + 1) * window, (begin + total)[row])
            start, length = lo - begin[row], hi - lo
            wide = [np.frombuffer(x, f"<u{k}").astype("<u4") for x, k in zip(column(batch, "ids").to_pylist(), column(batch, "id_bytes").to_pylist())]
            cut = [wide[r][s : s + n].tobytes() for r, s, n in zip(row.tolist(), start.tolist(), length.tolist())]
            arrays = {
                id_col: column(batch, id_col).take(pa.array(row)), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(np.fromiter(map(zlib.crc32, cut), np.int64, len(cut))),
                "doc_tokens": pa.array(total[row]), "sequence_id": pa.array(sequence), "offset": pa.array(lo - sequence * window), "boundary": pa.array(pieces[row] > 1),
            }
            if with_ids:
                arrays["ids"] = pa.array([np.frombuffer(c, "<u4").astype(np.int32) for c in cut], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))

    longs = [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    extra = [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    return tokens.mapInArrow(run, T.StructType([docs.schema[id_col], *longs, T.StructField("boundary", T.BooleanType()), *extra]))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """The pieces of all documents, pack() with the 49k word-level BPE file and windows of 2048.

    Null and empty texts are the end id alone. Repeated rows are packed each for itself.
    Empty table: no rows.
    """
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
