"""Vector best-fit packing: as few sequences as it can, no document cut but those longer than a sequence.

A piece of n tokens takes (n, 1, n * n) of a sequence's tokens, documents and
attention cost. Pieces come in order of size, largest first; each goes, among the open
sequences that have room for it under all three capacities, to the one of the best
score, or opens a new one.

A piece is wholly described by its length, and there are no more lengths than tokens
in a sequence. So what is planned is the histogram of lengths: sequences with the same
content are one run of them, a length's pieces enter a run together, and the plan is
the very one that a walk over all pieces would give. It has at most four new runs for
each length, however many documents there are. Tasks number the pieces of each length,
and the plan turns a number into a place.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import as_text, column, free_name, out_batch, slices, stage
from .packing import default_tokenizer
from .tokens import encoder


@dataclass(frozen=True)
class Capacities:
    """What a sequence holds, how much each counts in a score, and the score: 'norm', the least weighted norm of what is left, or 'dot', the largest weighted product of piece and room."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.25, 0.25)
    score: str = "norm"

    def __post_init__(self):
        if min(self.tokens, self.documents, self.attention) < 1 or self.score not in ("norm", "dot") or min(self.weights) < 0 or self.weights[0] == 0:
            raise ValueError("capacities are at least 1, weights are not negative and that of tokens is not zero, score is 'norm' or 'dot'")

    @property
    def longest(self) -> int:
        """Longest piece that a sequence holds."""
        return min(self.tokens, int(np.floor(np.sqrt(self.attention))))

    @property
    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], np.int64)


def scores(room: np.ndarray, item: np.ndarray, limits: Capacities) -> np.ndarray:
    """The score of each row of `room` for a piece, lower is better; infinite where it doesn't fit."""
    scale, weights = limits.vector.astype(float), np.array(limits.weights)
    if limits.score == "norm":
        found = ((((room - item) / scale) ** 2) * weights).sum(1)
    else:
        found = -((room / scale) * (item / scale) * weights).sum(1)
    return np.where((room >= item).all(1), found, np.inf)


def plan(lengths: np.ndarray, counts: np.ndarray, limits: Capacities) -> tuple[np.ndarray, int]:
    """Where pieces go: rows (length, first number, pieces, first sequence, pieces each, offset), and the number of sequences.

    The pieces of a length are numbered from 0. Of a row, `pieces each` go to each of
    consecutive sequences, one behind the other from `offset` on. Equal scores: the
    run that was opened first.
    """
    room, first, many = np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows: list[tuple[int, int, int, int, int, int]] = []
    opened = 0
    for at in np.argsort(-lengths):
        size, left, number = int(lengths[at]), int(counts[at]), 0
        item = np.array([size, 1, size * size], np.int64)
        while left:
            found = scores(room, item, limits)
            best = int(np.argmin(found)) if len(found) else -1
            if best < 0 or not np.isfinite(found[best]):
                each = int((limits.vector // item).min())  # no other sequence takes this length, so each new one is filled
                here, begin, n = limits.vector.copy(), opened, -(-left // each)
                opened += n
            else:
                here, begin, n = room[best], int(first[best]), int(many[best])
                # By norm a sequence stays the best until the length doesn't fit; by product it is behind its like after one.
                each = int((here // item).min()) if limits.score == "norm" else 1
                room, first, many = np.delete(room, best, 0), np.delete(first, best), np.delete(many, best)
            offset = int(limits.tokens - here[0])
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            new: list[tuple[np.ndarray, int, int]] = []
            if full:
                rows.append((size, number, full * each, begin, each, offset))
                new.append((here - each * item, begin, full))
            if rest:
                rows.append((size, number + full * each, rest, begin + full, rest, offset))
                new.append((here - rest * item, begin + full, 1))
            untouched = n - full - (rest > 0)
            if untouched:
                new.append((here, begin + full + (rest > 0), untouched))
            number, left = number + full * each + rest, left - full * each - rest
            room = np.concatenate([room, np.array([r for r, _, _ in new])])
            first, many = np.append(first, [b for _, b, _ in new]), np.append(many, [n for _, _, n in new])
            order = np.argsort(first, kind="stable")
            room, first, many = room[order], first[order], many[order]
            keep = (room >= 1).all(1)  # what can't take even a token is closed
            room, first, many = room[keep], first[keep], many[keep]
    return np.array(rows, np.int64).reshape(-1, 6), opened


def measure(docs: DataFrame, tokenizer: str, longest: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """id_col, part, cuts_before, tokens, rest, rest_number, crcs (and ids): a row for each document, its last piece numbered among those of its length in the task.

    rest: tokens of the last piece if it is shorter than `longest`, else 0; cuts_before:
    pieces of full length in the task before this document's.
    """
    added = [T.StructField("part", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("cuts_before", "tokens", "rest", "rest_number")], T.StructField("crcs", T.ArrayType(T.LongType()))]
    if with_ids:
        added.append(T.StructField("ids", T.BinaryType()))

    def run(batches):
        part, cuts, seen = TaskContext.get().partitionId(), 0, np.zeros(longest, np.int64)
        enc = encoder(tokenizer)
        for batch in slices(batches, text_col):
            ids = [np.append(x, enc.dtype(end_id)).astype("<u4") for x in enc.encode(as_text(batch, text_col))]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            rest, full = sizes % longest, sizes // longest
            before = cuts + np.cumsum(full) - full
            cuts += int(full.sum())
            order = np.argsort(rest, kind="stable")
            ranks = np.empty(len(rest), np.int64)
            starts = np.searchsorted(rest[order], rest[order], "left")
            ranks[order] = np.arange(len(rest)) - starts
            numbers = ranks + seen[rest]
            np.add.at(seen, rest, 1)
            crcs = [[zlib.crc32(x[i : i + longest].tobytes()) for i in range(0, len(x), longest)] for x in ids]
            new = {"part": pa.array(np.full(len(ids), part, np.int32)), "cuts_before": pa.array(before), "tokens": pa.array(sizes), "rest": pa.array(rest), "rest_number": pa.array(numbers), "crcs": pa.array(crcs, pa.list_(pa.int64()))}
            if with_ids:
                new["ids"] = pa.array([x.tobytes() for x in ids], pa.binary())
            yield out_batch(batch, [id_col], new)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, T.StructType([docs.schema[id_col], *added]))


def best_fit(docs: DataFrame, tokenizer: str, limits: Capacities = Capacities(), id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of documents: id_col, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Null and empty texts are the end id alone. Only documents longer than
    limits.longest are cut, into pieces of that length and a rest. Repeated rows are
    packed each for itself; a null id is carried; an empty table has no pieces. The
    driver holds one count for each length and one for each task.
    """
    spark, longest = docs.sparkSession, limits.longest
    inner = free_name(["part", "cuts_before", "tokens", "rest", "rest_number", "crcs", "ids", "base", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", text_col], id_col)
    table = stage(measure(docs.select(F.col(id_col).alias(inner), F.col(text_col)), tokenizer, longest, inner, text_col, end_id, with_ids))

    by_task = table.groupBy("rest", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = table.join(by_task.select("rest", "part", before.alias("base")), ["rest", "part"])

    histogram = by_task.where("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).toArrow()
    tasks = table.groupBy("part").agg(F.sum(F.floor(F.col("tokens") / longest).cast("long")).alias("n")).toArrow().sort_by("part")
    sums = np.concatenate([[0], np.cumsum(tasks.column("n").to_numpy(), dtype=np.int64)])
    rows, _ = plan(np.append(histogram.column("rest").to_numpy(), longest), np.append(histogram.column("n").to_numpy(), sums[-1]), limits)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    shared = spark.sparkContext.broadcast((rows, tasks.column("part").to_numpy().astype(np.int64), sums))

    fields = [T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "sequence_id", "offset")]]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches):
        rows, parts, sums = shared.value
        factor = int((rows[:, 1] + rows[:, 2]).max(initial=0))  # above all numbers, so (length, number) is one ordered key
        begins = rows[:, 0] * factor + rows[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, rest = column(batch, "tokens").to_numpy(), column(batch, "rest").to_numpy()
            number = column(batch, "rest_number").to_numpy() + column(batch, "base").to_numpy()
            cuts = column(batch, "cuts_before").to_numpy() + sums[np.searchsorted(parts, column(batch, "part").to_numpy())]
            pieces = tokens // longest + (rest > 0)
            row = np.repeat(np.arange(len(tokens)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = nth * longest
            length = np.minimum(longest, tokens[row] - start)
            which = np.where(length < longest, number[row], cuts[row] + nth)
            found = rows[np.searchsorted(begins, length * factor + which, "right") - 1]
            place = which - found[:, 1]
            sequence, offset = found[:, 3] + place // found[:, 4], found[:, 5] + place % found[:, 4] * found[:, 0]
            arrays = [column(batch, inner).take(pa.array(row)), pa.array(nth.astype(np.int32)), pa.array(start), pa.array(length), column(batch, "crcs").flatten(), pa.array(sequence), pa.array(offset)]
            if with_ids:
                whole = [np.frombuffer(x, "<u4").astype(np.int32) for x in column(batch, "ids").to_pylist()]
                arrays.append(pa.array([whole[r][s : s + n] for r, s, n in zip(row.tolist(), start.tolist(), length.tolist())], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, [inner, *[f.name for f in fields]])

    keep = [inner, "part", "cuts_before", "tokens", "rest", "rest_number", "base", "crcs"] + (["ids"] if with_ids else [])
    out = numbered.select(*keep).mapInArrow(run, T.StructType([table.schema[inner], *fields]))
    return out.withColumnRenamed(inner, id_col)


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents, best_fit() with the 49k word-level BPE file and 2048 tokens a sequence.

    As the contract limits tokens alone, 2,048 documents and an attention cost of
    2048 * 2048 leave every sequence of 2,048 tokens allowed. Null and empty texts are the
    end id alone; repeated rows are packed each for itself; empty table: no rows.
    """
    return best_fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
