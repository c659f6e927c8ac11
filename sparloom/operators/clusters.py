"""Clusters of a document's leaves by their vectors, for the cluster reducer.

Per document: the first centre is a leaf drawn by hash, each further one the leaf least
similar to those chosen; then spherical k-means. All documents take each round in one
job. Leaves lie in cells of bounded size, a long document in several; a cell meets the
centres of its documents and passes on sums, never vectors.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparloom.operators.metric_index import matrix, unit
from sparloom.sources.scratch import shared_folder

#: Leaves of a cell on average, and of one document in a cell at most.
CELL, PIECE = 16_384, 4_096


def _kept(df: DataFrame, folder: str) -> DataFrame:
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _by_document(cell: pa.Table) -> dict[int, np.ndarray]:
    docs = cell.column("doc").to_numpy()
    order = np.argsort(docs, kind="stable")
    ends = np.flatnonzero(np.diff(docs[order])) + 1
    return {int(docs[rows[0]]): rows for rows in np.split(order, ends) if len(rows)}


def _centres(table: pa.Table) -> dict[int, np.ndarray]:
    return {d: np.array(c, np.float64) for d, c in zip(table.column("doc").to_pylist(), table.column("centres").to_pylist())}


def _score(e: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (e @ centres.T).round(12)


def _farthest(leaves: pa.Table, centres: pa.Table) -> pa.Table:
    """Of each document of the cell the leaf least similar to its centres."""
    e, pos, known = unit(matrix(leaves.column("e"))), leaves.column("pos").to_numpy(), _centres(centres)
    rows = []
    for d, at in _by_document(leaves).items():
        if d in known:
            like = _score(e[at], known[d]).max(axis=1)
            best = np.lexsort((pos[at], like))[0]
            rows.append((d, float(like[best]), int(pos[at[best]]), e[at[best]].tolist()))
    columns = list(zip(*rows)) or [(), (), (), ()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64())))], ["doc", "like", "pos", "e"])


def _sums(leaves: pa.Table, centres: pa.Table) -> pa.Table:
    e, known, rows = unit(matrix(leaves.column("e"))), _centres(centres), []
    for d, at in _by_document(leaves).items():
        nearest = _score(e[at], known[d]).argmax(axis=1)
        rows += [(d, int(c), e[at[nearest == c]].sum(axis=0).tolist()) for c in np.unique(nearest)]
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.float64())))], ["doc", "cluster", "total"])


def _assigned(leaves: pa.Table, centres: pa.Table) -> pa.Table:
    e, known = unit(matrix(leaves.column("e"))), _centres(centres)
    out = np.zeros(leaves.num_rows, np.int64)
    for d, at in _by_document(leaves).items():
        out[at] = _score(e[at], known[d]).argmax(axis=1)
    return pa.table([leaves.column("doc"), leaves.column("pos"), pa.array(out)], ["doc", "pos", "cluster"])


def cluster_leaves(leaves: DataFrame, k: int | None = None, rounds: int = 10, seed: int = 42) -> DataFrame:
    """(doc, pos, cluster): each leaf (doc long, pos long, embedding) of a document in one of k clusters, numbered from 0 in the order of their first leaf.

    Without k as many as the root of the document's leaves, 2 to 8; never more than it
    has different vectors. Ties go to the smaller place and the earlier centre; a centre
    that loses all leaves stays. Leaves without a vector are cluster -1.
    """
    folder = shared_folder(leaves.sparkSession, "clusters")
    good = leaves.where(F.col("embedding").isNotNull())
    rows = good.select(F.col("doc").cast("long").alias("doc"), F.col("pos").cast("long").alias("pos"), F.col("embedding").cast("array<double>").alias("e"))
    n = rows.count()
    cell = F.pmod(F.xxhash64("doc", F.floor(F.col("pos") / PIECE)), F.lit(max(1, -(-n // CELL))))
    rows = _kept(rows.withColumn("cell", cell), folder)
    sizes = rows.groupBy("doc").agg(F.count("*").alias("n"), F.min_by("e", F.struct(F.xxhash64("pos", F.lit(seed)), "pos")).alias("first"))
    wanted = F.lit(k) if k is not None else F.greatest(F.lit(2), F.least(F.round(F.sqrt("n")).cast("int"), F.lit(8)))
    length = F.sqrt(F.aggregate("first", F.lit(0.0), lambda s, x: s + x * x))
    begin = F.when(length > 0, F.transform("first", lambda x: x / length)).otherwise(F.col("first"))
    centres = _kept(sizes.select("doc", F.least(wanted, F.col("n").cast("int")).alias("k"), F.array(begin).alias("centres")), folder)
    where = _kept(rows.select("cell", "doc").distinct(), folder)

    def meet(table: DataFrame, f, schema: str) -> DataFrame:
        there = where.join(table, "doc").select(F.col("cell").alias("of"), "doc", "centres")
        return rows.groupBy("cell").cogroup(there.groupBy("of")).applyInArrow(f, schema)

    while True:
        few = centres.where(F.size("centres") < F.col("k"))
        if few.isEmpty():
            break
        # of documents that have enough, nothing is asked
        far = meet(few, _farthest, "doc long, like double, pos long, e array<double>").groupBy("doc").agg(F.min_by(F.struct("like", "e"), F.struct("like", "pos")).alias("f"))
        grown = F.when(F.col("f.like") < 1 - 1e-12, F.concat("centres", F.array("f.e"))).otherwise(F.col("centres"))
        limit = F.when(F.col("f.like") < 1 - 1e-12, F.col("k")).when(F.col("f.like").isNull(), F.col("k")).otherwise(F.size("centres"))
        centres = _kept(centres.join(far, "doc", "left").select("doc", limit.alias("k"), F.when(F.col("f").isNull(), F.col("centres")).otherwise(grown).alias("centres")), folder)
    for _ in range(rounds):
        sums = meet(centres, _sums, "doc long, cluster long, total array<double>")
        item = sums.select("doc", "cluster", F.posexplode("total").alias("i", "x")).groupBy("doc", "cluster", "i").agg(F.sum("x").alias("x"))
        vectors = item.groupBy("doc", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
        moved = vectors.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("cluster", "v"))).alias("m"))
        norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        step = F.transform("centres", lambda c, i: F.when(norm(F.col("m")[i.cast("long")]) > 0, F.transform(F.col("m")[i.cast("long")], lambda x: x / norm(F.col("m")[i.cast("long")]))).otherwise(c))
        later = _kept(centres.join(moved, "doc").select("doc", "k", step.alias("centres"), F.col("centres").alias("before")), folder)
        still = F.forall(F.zip_with(F.flatten("centres"), F.flatten("before"), lambda a, b: F.abs(a - b) < 1e-12), lambda x: x)
        done = later.where(~still).isEmpty()
        centres = later.drop("before")
        if done:
            break
    found = meet(centres, _assigned, "doc long, pos long, cluster long")
    firsts = found.groupBy("doc", "cluster").agg(F.min("pos").alias("at")).groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "cluster"))), lambda s: s["cluster"]).alias("o"))
    numbered = found.join(firsts, "doc").select("doc", "pos", (F.array_position("o", F.col("cluster")) - 1).cast("int").alias("cluster"))
    return numbered.unionByName(leaves.where(F.col("embedding").isNull()).select(F.col("doc").cast("long").alias("doc"), F.col("pos").cast("long").alias("pos"), F.lit(-1).alias("cluster")))
