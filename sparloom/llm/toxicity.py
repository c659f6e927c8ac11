"""Toxicity: a factorization machine over hashed terms.

Terms are words and their beginnings of 4, 5 and 6 bytes (inflected insults share a
stem), hashed to 2**18 buckets. The machine's inputs are buckets that tell the labels
apart alone, and buckets that do so only together: of the most frequent ones, those
whose covariance with another differs by label, however alike their shares are. To a
linear weight for each input it adds a learned interaction of each pair, the dot
product of two short vectors.

The fit takes at most `sample` / 2 labelled rows of each label, those of the smallest
hash; what this changes in the share of label 1 is put right in the bias. The driver
holds sample x a few hundred integers at most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import aside, as_bytes, back, column, out_batch, slices, stage
from .words import Words

BITS = 18
PREFIXES = (4, 5, 6)
#: Labelled rows that the fit reads at most, half of each label.
SAMPLE = 16_000
#: Buckets that are inputs because their shares by label differ, by LEAST_Z standard errors at least.
TERMS, LEAST_Z = 4096, 4.0
#: The most frequent buckets, of which all pairs are counted, and how many of them become inputs at most because a pair's covariance differs by label, by LEAST_PAIR_Z standard errors.
FREQUENT, JOINT, LEAST_PAIR_Z = 2048, 1024, 8.0
#: Times that the training reads all rows, and its mini-batches at least (small tables are read more often).
PASSES, STEPS = 10, 1000


def _terms(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each distinct term of each text."""
    hashes = [w.hashes, *w.prefixes]
    docs = [w.doc, *(w.doc[p != 0] for p in w.prefixes)]
    buckets = np.concatenate([hashes[0], *(p[p != 0] for p in hashes[1:])]) >> np.uint64(64 - BITS)
    both = np.unique((np.concatenate(docs).astype(np.int64) << BITS) | buckets.astype(np.int64))
    return both >> BITS, both & (1 << BITS) - 1


@dataclass
class Machine:
    """score = sigmoid(bias + sum of weights + pairwise dot products of factors) over a text's terms."""

    slot: np.ndarray  # of each bucket, or -1
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, rows: np.ndarray, slots: np.ndarray, n: int) -> np.ndarray:
        v = self.factors[slots]
        sums = np.stack([np.bincount(rows, v[:, f], n) for f in range(v.shape[1])], axis=1) if len(rows) else np.zeros((n, v.shape[1]))
        squares = np.bincount(rows, (v * v).sum(axis=1), n)
        return self.bias + np.bincount(rows, self.weights[slots], n) + ((sums * sums).sum(axis=1) - squares) / 2

    def scores(self, texts: list[bytes]) -> np.ndarray:
        w = Words(texts, prefix_bytes=PREFIXES)
        rows, buckets = _terms(w)
        slots = self.slot[buckets]
        return 1 / (1 + np.exp(-np.clip(self.margins(rows[slots >= 0], slots[slots >= 0], len(texts)), -30, 30)))


def _some(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number within `rows`, place) of all entries of some rows; row i's entries are at first[i] to first[i + 1]."""
    sizes = first[rows + 1] - first[rows]
    ends = np.cumsum(sizes)
    return np.repeat(np.arange(len(rows)), sizes), np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[rows] - (ends - sizes), sizes)


def _train(rows: np.ndarray, slots: np.ndarray, labels: np.ndarray, n_slots: int, factors: int = 8, batch: int = 128, rate: float = 0.1, decay: float = 1e-4) -> tuple[float, np.ndarray, np.ndarray]:
    """Log loss by AdaGrad over mini-batches, PASSES times all rows, STEPS mini-batches at least; rows is ascending. No factors: the linear part alone."""
    rng = np.random.default_rng(7)
    n = len(labels)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    bias, w, v = float(np.log(share / (1 - share))), np.zeros(n_slots), rng.normal(0, 0.05, (n_slots, factors))
    gb, gw, gv = 1e-2, np.full(n_slots, 1e-2), np.full((n_slots, factors), 1e-2)
    first, order = np.searchsorted(rows, np.arange(n + 1)), rng.permutation(n)
    batches = [order[lo : lo + batch] for lo in range(0, n, batch)]
    for _ in range(max(PASSES, -(-STEPS // len(batches)))):
        for k in rng.permutation(len(batches)):
            some = batches[k]
            row, at = _some(first, some)
            used, which = np.unique(slots[at], return_inverse=True)
            x = np.zeros((len(some), len(used)), np.float32)
            x[row, which] = 1
            wu, vu = w[used], v[used].astype(np.float32)
            sums = x @ vu
            margin = bias + x @ wu + ((sums**2).sum(1) - x @ (vu**2).sum(1)) / 2
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[some]) / len(some)
            slope = x.T @ np.column_stack([error, error[:, None] * sums])
            d_w, d_v = slope[:, 0] + decay * wu, slope[:, 1:] - slope[:, :1] * vu + decay * vu
            gw[used] += d_w**2
            gv[used] += d_v**2
            w[used] -= rate * d_w / np.sqrt(gw[used])
            v[used] -= rate * d_v / np.sqrt(gv[used])
            d_b = error.sum()
            gb += d_b**2
            bias -= rate * d_b / np.sqrt(gb)
    return bias, w, v.astype(np.float32)


def _joint(rows: np.ndarray, slots: np.ndarray, labels: np.ndarray, n_slots: int) -> np.ndarray:
    """The slots that tell together with another: a pair's covariances in rows of label 1 and 0 differ by LEAST_PAIR_Z standard errors; JOINT of them at most, the most telling ones. Rows is ascending."""
    first = np.searchsorted(rows, np.arange(len(labels) + 1))
    together, sizes = [], []
    for label in (0, 1):
        mine = np.flatnonzero(labels == label)
        both = np.zeros((n_slots, n_slots), np.float32)  # counts, exact up to 2 ** 24 rows
        for lo in range(0, len(mine), 512):
            row, at = _some(first, mine[lo : lo + 512])
            x = np.zeros((min(512, len(mine) - lo), n_slots), np.float32)
            x[row, slots[at]] = 1
            both += x.T @ x
        together.append(both)
        sizes.append(max(1, len(mine)))
    shares = [m.diagonal().astype(float) / n for m, n in zip(together, sizes)]
    best = np.zeros(n_slots)
    for lo in range(0, n_slots, 128):  # some rows of the matrices at a time, as the driver's memory is small
        some = slice(lo, lo + 128)
        covariance = [m[some] / n - np.outer(p[some], p) for m, n, p in zip(together, sizes, shares)]
        variance = sum(np.outer(p[some] * (1 - p[some]), p * (1 - p)) / n for n, p in zip(sizes, shares))
        z = np.abs(covariance[1] - covariance[0]) / np.sqrt(np.maximum(variance, 1e-9))
        z[np.arange(len(z)), lo + np.arange(len(z))] = 0
        best[some] = z.max(axis=1, initial=0)
    some = np.argsort(-best, kind="stable")[:JOINT]
    return some[best[some] >= LEAST_PAIR_Z]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, terms: int = TERMS) -> Machine:
    """Learns from the texts of docs and their labels 0 or 1 (other values and nulls are passed over).

    Without labels of both values, or without a document that has one, the machine
    answers the share of label 1. Repeated rows and repeated labels count as often as
    they occur. Null and empty texts are rows without terms. Other columns of docs and
    labels, of any name, don't matter.
    """
    spark = docs.sparkSession
    good = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    taken = [good.where(F.col("_label") == k).orderBy(F.xxhash64("_id"), "_id").limit(sample // 2) for k in (0, 1)]
    few = F.broadcast(stage(taken[0].union(taken[1])))  # `sample` rows at most
    chosen = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(few, F.col("_doc") == F.col("_id")).select("_label", "_text")

    def hashed(batches):
        for batch in slices(batches, "_text"):
            rows, buckets = _terms(Words(as_bytes(batch, "_text"), prefix_bytes=PREFIXES))
            lists = np.split(buckets.astype(np.int32), np.searchsorted(rows, np.arange(1, batch.num_rows)))
            yield out_batch(batch, ["_label"], {"buckets": pa.array(lists, pa.list_(pa.int32()))})

    rows = stage(chosen.mapInArrow(hashed, "_label int, buckets array<int>"))
    n1, n = rows.agg(F.sum("_label"), F.count("*")).first()
    slot = np.full(1 << BITS, -1, np.int32)
    if not n or not n1 or n1 == n:
        share = np.clip((n1 or 0) / max(n, 1), 1e-6, 1 - 1e-6)
        return Machine(slot, float(np.log(share / (1 - share))), np.zeros(1), np.zeros((1, 1)))
    counts = stage(rows.select("_label", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.sum("_label").alias("c1"), F.count("*").alias("c")).where((F.col("c") > 1) & (F.col("c") < n)))  # a bucket that every row has tells nothing
    p1, p0, p = F.col("c1") / n1, (F.col("c") - F.col("c1")) / (n - n1), F.col("c") / n
    z = F.abs(p1 - p0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / (n - n1)))
    telling = np.array([r["bucket"] for r in counts.withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "bucket").limit(terms).collect()], np.int64)
    frequent = np.array([r["bucket"] for r in counts.orderBy(F.desc("c"), "bucket").limit(FREQUENT).collect()], np.int64)
    inputs = np.union1d(telling, frequent)
    slot[inputs] = np.arange(len(inputs))
    spread = spark.sparkContext.broadcast(slot)

    def reduced(batches):
        for batch in batches:
            lists = [spread.value[np.asarray(x, np.int64)].astype(np.int16) for x in column(batch, "buckets").to_pylist()]  # TERMS + FREQUENT at most
            yield out_batch(batch, ["_label"], {"slots": pa.array([np.sort(x[x >= 0]) for x in lists], pa.list_(pa.int16()))})

    # The order doesn't depend on the partitions; the driver gets one buffer of two bytes a number.
    got = rows.mapInArrow(reduced, "_label int, slots array<smallint>").orderBy("_label", "slots").toArrow().combine_chunks()
    lists, y = got.column("slots").chunk(0), got.column("_label").to_numpy().astype(float)
    row, used = np.repeat(np.arange(n, dtype=np.int32), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
    nth = np.full(len(inputs), -1, np.int32)
    nth[np.searchsorted(inputs, frequent)] = np.arange(len(frequent))
    pairs = nth[used] >= 0
    chosen_slots = np.union1d(np.searchsorted(inputs, telling), np.searchsorted(inputs, frequent[_joint(row[pairs], nth[used[pairs]], y, len(frequent))]))
    last = np.full(len(inputs), -1, np.int32)
    last[chosen_slots] = np.arange(len(chosen_slots))
    keep = last[used] >= 0
    bias, w, v = _train(row[keep], last[used[keep]], y, max(1, len(chosen_slots)))
    kept = slot >= 0
    slot[kept] = last[slot[kept]]
    all_of = {r["_label"]: r["count"] for r in good.groupBy("_label").count().collect()}
    share_of = {k: min(1.0, sample // 2 / all_of[k]) for k in (0, 1)}
    return Machine(slot, bias + float(np.log(share_of[0] / share_of[1])), w, v)


def score(docs: DataFrame, machine: Machine, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a column `out` between 0 and 1; the machine's size is fixed by BITS, TERMS and JOINT. Null text scores as empty.

    An input column `out` is replaced; others, of any name, are carried. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(machine)
    carry = [c for c in docs.columns if c != out]

    def run(batches):
        for batch in slices(batches, text_col):
            yield out_batch(batch, carry, {out: pa.array(model.value.scores(as_bytes(batch, text_col)))})

    return docs.mapInArrow(run, T.StructType([docs.schema[c] for c in carry] + [T.StructField(out, T.DoubleType())]))


def drop_toxic(docs: DataFrame, machine: Machine, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """docs without those that score `least` or more; the same columns, of any name. Null text scores as empty; repeated rows are judged alike."""
    safe, now = aside(docs, ["_score"])
    return back(score(safe, machine, text_col, "_score").where(F.col("_score") < least), now, docs.columns)


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of all documents; the fit sees labels of those that aren't held out.

    Null texts score as empty ones. Repeated rows score alike; a null doc_id isn't held
    out and lends no label. Without labels of both values every score is the share of
    label 1. Empty documents: no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
