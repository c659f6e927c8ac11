"""SimHash near-duplicates by covering locality-sensitive hashing.

Each bit position i carries a nonzero vector m(i) of radius + 1 bits. For each
nonzero vector v a table keeps the bits with <m(i), v> = 1. Positions where two
fingerprints within the radius differ span at most `radius` dimensions, so some v
is orthogonal to them all and the pair agrees on that table's key: no pair within
the radius is missed. A bucket of more than `bucket` fingerprints is divided again:
the bits that its key leaves free are dealt into groups, and each table of the next
level leaves only `radius` of the groups free; a pair's differences lie in so many
groups at most. The first division makes radius + 1 tables of one; the last takes
as many groups as leave no more free bits than a bucket of `bucket` distinct
fingerprints has, so a bucket's size is bounded without any cap.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import as_bytes, out_batch, slices, stage
from .components import connected_components

#: Distinct fingerprints of one bucket that a task compares among themselves.
BUCKET = 4096
_ROWS = 1 << 16


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Bits set in over half of the hashes of the text's shingles, repeats included; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    k = min(shingle, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - k + 1]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(flat[a:b], seed) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist())), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), _ROWS):
        part = hashes[lo : lo + _ROWS]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fp", shingle: int = 3) -> DataFrame:
    """docs with a column `out` (long, the fingerprint's 64 bits) in place of the text."""
    carry = [c for c in docs.columns if c not in (text_col, out)]

    def run(batches):
        for batch in slices(batches, text_col):
            found = np.array([fingerprint(t, shingle) for t in as_bytes(batch, text_col)], np.uint64)
            yield out_batch(batch, carry, {out: pa.array(found.view(np.int64))})

    return docs.mapInArrow(run, T.StructType([docs.schema[c] for c in carry] + [T.StructField(out, T.LongType())]))


def covering_masks(radius: int) -> list[int]:
    """Masks of the bits that a table keeps, one for each nonzero vector of radius + 1 bits."""
    vectors = (1 << radius + 1) - 1
    return [sum(1 << b for b in range(64) if ((1 + b % vectors) & v).bit_count() & 1) for v in range(1, vectors + 1)]


def dividing_masks(mask: int, radius: int, groups: int) -> list[int]:
    """Masks that keep the bits of `mask` and all but `radius` of the groups into which the others are dealt."""
    free = [b for b in range(64) if not mask >> b & 1]
    dealt = [sum(1 << b for b in free[i::groups]) for i in range(min(groups, len(free)))]
    return sorted({(1 << 64) - 1 - sum(some) for some in combinations(dealt, min(radius, len(dealt)))})


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect what links within the members, each to its component's first member."""
    rest, out = members, []
    while len(rest) > 1:
        root, frontier, rest = rest[0], rest[:1], rest[1:]
        while len(frontier) and len(rest):
            near = np.zeros(len(rest), bool)
            for f in frontier:
                near |= np.bitwise_count(rest ^ f) <= radius
            frontier, rest = rest[near], rest[~near]
            out += [(root, x) for x in frontier]
    return out


def _bucket_edges(rows: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) that connect the linked fingerprints of each bucket of rows (mask, key, fp)."""

    def edges(masks, keys, fps):
        first = np.flatnonzero(np.concatenate([[True], (masks[1:] != masks[:-1]) | (keys[1:] != keys[:-1])]))
        sizes = np.diff(np.concatenate([first, [len(keys)]]))
        two = first[sizes == 2]
        two = two[np.bitwise_count((fps[two] ^ fps[two + 1]).view(np.uint64)) <= radius]
        more = [e for f, n in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist()) for e in _forest(fps[f : f + n].view(np.uint64), radius)]
        grown = np.array(more, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([fps[two], grown[:, 0]])), pa.array(np.concatenate([fps[two + 1], grown[:, 1]]))], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            now = [batch.column(i).to_numpy() for i in range(3)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            if not len(held[0]):
                continue
            masks, keys, fps = held
            last = int(np.flatnonzero((masks != masks[-1]) | (keys != keys[-1]))[-1:].sum()) + 1 if (masks[0] != masks[-1] or keys[0] != keys[-1]) else 0
            if last:
                yield edges(masks[:last], keys[:last], fps[:last])
            held = [x[last:] for x in held]
        if held is not None and len(held[0]):
            yield edges(*held)

    return rows.repartition("mask", "key").sortWithinPartitions("mask", "key").select("mask", "key", "fp").mapInArrow(run, "a long, b long")


def linked_fingerprints(fps: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of fps (fp long, distinct) within the radius."""
    spark = fps.sparkSession
    masks = covering_masks(radius)
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)]))
    rows = fps.select("fp", table.alias("t")).select("t.mask", "t.key", "fp")
    bits, groups, out = bucket.bit_length() - 1, radius + 1, None
    while True:
        free = max(64 - m.bit_count() for m in masks)
        hot = None
        if free > max(bits, radius):
            hot = stage(rows.groupBy("mask", "key").count().where(F.col("count") > bucket).select("mask", "key"))
            hot = None if hot.isEmpty() else hot
        cool = _bucket_edges(rows if hot is None else rows.join(hot, ["mask", "key"], "left_anti"), radius)
        out = cool if out is None else out.union(cool)
        if hot is None:
            return out
        finer = [(i, m) for i, kept in enumerate(masks) for m in dividing_masks(kept, radius, groups)]
        # of a size that radius and bucket alone decide: 60, then 1,200 masks at radius 3
        wide = F.broadcast(spark.createDataFrame([(i, j, _signed(m)) for j, (i, m) in enumerate(finer)], "mask int, finer int, bits long"))
        rows = rows.join(hot, ["mask", "key"], "left_semi").join(wide, "mask").select(F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("bits")).alias("key"), "fp")
        masks = [m for _, m in finer]
        groups = max(radius + 1, -(-radius * max(64 - m.bit_count() for m in masks) // max(bits, radius, 1)))


def _classes(docs: DataFrame, id_col: str, text_col: str, radius: int = 3, shingle: int = 3, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """Staged rows (id_col, fp) of docs, and (fp, label, component_id) of each fingerprint: label is one for each component."""
    rows = stage(fingerprints(docs.select(F.col(id_col), F.col(text_col)), text_col, "fp", shingle))
    least = rows.groupBy("fp").agg(F.min(id_col).alias("least"))
    labels = connected_components(linked_fingerprints(least.select("fp"), radius, bucket))
    linked = labels.join(least, labels["node"] == least["fp"]).select("node", "label", "least")
    of = linked.groupBy("label").agg(F.min("least").alias("smallest"))
    by_fp = linked.join(of, "label").select(F.col("node").alias("fp"), "label", "smallest")
    # written once, so that both sides of the last join are plain shuffles, which Spark splits where one fingerprint is hot
    return rows, stage(least.join(by_fp, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"), F.coalesce("smallest", "least").alias("component_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, shingle: int = 3, bucket: int = BUCKET) -> DataFrame:
    """(id_col, fp long, component_id): component_id is the smallest id reachable over links.

    Documents link when their fingerprints differ in at most `radius` bits; equal
    texts have equal fingerprints. Null or wordless texts have fingerprint 0 and
    link like any other. One row for each input row; rows without id get their
    component too, but lend it no id (null where no row has one). Empty: no rows.
    """
    rows, whole = _classes(docs, id_col, text_col, radius, shingle, bucket)
    return rows.join(whole, "fp").select(id_col, "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, shingle: int = 3, bucket: int = BUCKET) -> DataFrame:
    """One document of each component: the rows that have its smallest id.

    Rows of one id are one document and stay together. A row without id is a document
    of its own: it stays only if its component has no id, and of such rows of one component
    one stays, that of the smallest text (null as empty; which one of equal texts is open).
    Which ids go is decided on ids and fingerprints alone; texts move only when the ids
    that go are too many to broadcast, and those of rows without id.
    """
    rows, whole = _classes(docs, id_col, text_col, radius, shingle, bucket)
    found = rows.where(F.col(id_col).isNotNull()).join(whole, "fp")
    # an id that is the smallest of its component for one of its rows stays
    gone = found.groupBy(id_col).agg(F.max(F.col(id_col) == F.col("component_id")).alias("stays")).where("not stays").select(F.col(id_col).alias("_gone"))
    gone = stage(gone)
    kept = docs.where(F.col(id_col).isNotNull()).join(gone, docs[id_col] == gone["_gone"], "left_anti")
    if rows.where(F.col(id_col).isNull()).isEmpty():
        return kept
    nameless = docs.where(F.col(id_col).isNull()).select(F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    alone = fingerprints(nameless.select("row", F.col("row")[text_col].alias("of"), "text")).join(whole.where("component_id is null"), "fp")
    one = alone.groupBy("label").agg(F.min_by("row", F.coalesce("of", F.lit(""))).alias("row"))
    return kept.unionByName(one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))


def hex64(fp: str = "fp") -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, component_id) of all documents.

    Null, empty and wordless texts: fingerprint 0. Repeated rows: one row each, of one
    component. A null doc_id has its component but lends it no id. Empty table: no rows.
    """
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", hex64().alias("fingerprint"), "component_id")
