"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are runs of digits, letters and non-ASCII characters, ASCII letters
lower-cased. Each window of `n` consecutive words of a benchmark item (or the
whole item, if it is shorter) is looked up in the documents by hash; each hit is
verified by comparing the words themselves. The benchmark is broadcast in blocks
of bounded size; a larger benchmark takes more passes, each written before the next
one begins, so that a task holds one block at a time.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import as_bytes, aside, back, column, out_batch, slices, stage
from .words import Words

#: Bytes of benchmark windows in one broadcast.
BLOCK_BYTES = 64 << 20
_FILTER_BITS = 20
_RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_RUNS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = 13) -> DataFrame:
    """(item string, words int, text binary): the distinct windows of each item; none for null or wordless texts."""

    def run(batches):
        for batch in slices(batches, "text"):
            w = Words(as_bytes(batch, "text"))
            ids = column(batch, "item").to_pylist()
            firsts = np.concatenate([[0], np.cumsum(w.counts)])
            out = set()
            for d, count in enumerate(w.counts.tolist()):
                k = min(n, count)
                if k and ids[d] is not None:
                    lo = int(firsts[d])
                    out.update((ids[d], k, w.join(i, i + k)) for i in range(lo, lo + count - k + 1))
            rows = list(out)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["item", "words", "text"])

    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return items.mapInArrow(run, "item string, words int, text binary").distinct()


class WindowIndex:
    """Windows by length and hash, with a bit table that dismisses most others."""

    def __init__(self, rows):
        by_text: dict[tuple[int, bytes], list[str]] = defaultdict(list)
        for r in rows:
            by_text[r["words"], bytes(r["text"])].append(r["item"])
        self.by_length = {}
        lengths = defaultdict(list)
        for (k, text), items in by_text.items():
            lengths[k].append((text, items))
        for k, entries in lengths.items():
            _, hashes = Words([t for t, _ in entries]).windows(k)
            table = defaultdict(list)
            for h, e in zip(hashes.tolist(), entries):
                table[h].append(e)
            known = np.unique(hashes)
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[known >> np.uint64(64 - _FILTER_BITS)] = True
            self.by_length[k] = (bits, known, dict(table))

    def hits(self, w: Words) -> list[tuple[int, int, list[str]]]:
        """(first word, one past the last, items) of each verified window."""
        found = []
        for k, (bits, known, table) in self.by_length.items():
            at, hashes = w.windows(k)
            near = np.flatnonzero(bits[hashes >> np.uint64(64 - _FILTER_BITS)])
            if not len(near):
                continue
            near = near[known[np.minimum(np.searchsorted(known, hashes[near]), len(known) - 1)] == hashes[near]]
            for i, h in zip(at[near].tolist(), hashes[near].tolist()):
                text = w.join(i, i + k)
                found += [(i, i + k, items) for t, items in table[h] if t == text]
        return found


def _scan(docs: DataFrame, text_col: str, index) -> DataFrame:
    """Adds the block's hits to the columns n_words, n_hit, items, hit_words, hit_spans."""
    carry = [c for c in docs.columns if c not in ("n_words", "n_hit", "items", "hit_words", "hit_spans")]
    before = "hit_words" in docs.columns

    def run(batches):
        for batch in slices(batches, text_col):
            texts = as_bytes(batch, text_col)
            w = Words(texts)
            marks = np.zeros(len(w.hashes) + 1, np.int64)
            firsts = np.concatenate([[0], np.cumsum(w.counts)])
            items = [set(x or ()) for x in column(batch, "items").to_pylist()] if before else [set() for _ in texts]
            if before:
                for d, old in enumerate(column(batch, "hit_words").to_pylist()):
                    for r in old or ():
                        marks[firsts[d] + r["start"]] += 1
                        marks[firsts[d] + r["end"]] -= 1
            for i, j, of in index.value.hits(w):
                marks[i] += 1
                marks[j] -= 1
                items[w.doc[i]].update(of)
            hit = np.cumsum(marks[:-1]) > 0
            n_hit = np.bincount(w.doc[hit], minlength=len(texts))
            word_runs, spans = [], []
            for d in range(len(texts)):
                if not n_hit[d]:
                    word_runs.append([])
                    spans.append([])
                    continue
                lo = int(firsts[d])
                step = np.diff(np.concatenate([[0], hit[lo : int(firsts[d + 1])].astype(np.int8), [0]]))
                runs = list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()))
                word_runs.append([{"start": a, "end": b} for a, b in runs])
                base = int(w.text_starts[d])
                points = np.cumsum((np.frombuffer(texts[d], np.uint8) & 0xC0) != 0x80)  # code points up to each byte
                spans.append([{"start": int(points[w.starts[lo + a] - base]) - 1, "end": int(points[w.ends[lo + b - 1] - base - 1])} for a, b in runs])
            yield out_batch(batch, carry, {
                "n_words": pa.array(w.counts, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()),
                "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                "hit_words": pa.array(word_runs, _RUNS_ARROW), "hit_spans": pa.array(spans, _RUNS_ARROW),
            })

    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("hit_words", _RUNS), T.StructField("hit_spans", _RUNS)])
    return docs.mapInArrow(run, schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs with n_words, n_hit, items, hit_words and hit_spans.

    items: ids (as strings, sorted) of the items of which a window occurs;
    hit_words, hit_spans: runs of hit words, as word positions and as code points.
    Input columns of these names are replaced; others, of any name, are carried.
    Null text: no words, no hits. Repeated rows are judged each for itself. An
    empty benchmark hits nothing; an item without id or words is passed over.
    """
    spark = docs.sparkSession
    windows = benchmark_windows(benchmark, item_col, item_text_col, n).cache()
    total = windows.agg(F.coalesce(F.sum(F.length("text") + F.length("item") + 100), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    keyed = windows.withColumn("block", F.pmod(F.xxhash64("text", "item"), F.lit(blocks)))
    docs = docs.drop("n_words", "n_hit", "items", "hit_words", "hit_spans")
    for b in range(blocks):
        docs = _scan(docs, text_col, spark.sparkContext.broadcast(WindowIndex(keyed.where(F.col("block") == b).collect())))
        if b < blocks - 1:
            docs = stage(docs)
    windows.unpersist()
    return docs


def contaminated() -> F.Column:
    """At least one hit word, and at least a twentieth of all words."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def remove_spans(found: DataFrame, text_col: str = "text") -> DataFrame:
    """Cuts the hit spans out of the texts of find_contamination()'s result."""
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("hit_spans", lambda s: s["end"]))
    starts = F.concat(F.transform("hit_spans", lambda s: s["start"]), F.array(F.length(text_col).cast("long")))
    pieces = F.zip_with(ends, starts, lambda a, b: F.substring(F.col(text_col), (a + 1).cast("int"), (b - a).cast("int")))
    return found.withColumn(text_col, F.when(F.size("hit_spans") > 0, F.concat_ws("", pieces)).otherwise(F.col(text_col)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", **options) -> DataFrame:
    """docs without contaminated documents (remove="documents") or without hit spans (remove="spans"); the same columns, of any name, with their values.

    Null and empty texts stay; repeated rows are judged each for itself.
    """
    safe, now = aside(docs, ["n_words", "n_hit", "items", "hit_words", "hit_spans"])
    found = find_contamination(safe, benchmark, **options)
    kept = found.where(~contaminated()) if remove == "documents" else remove_spans(found, options.get("text_col", "text"))
    return back(kept, now, docs.columns)


def items_sha256(items: str = "items") -> F.Column:
    return F.sha2(F.concat_ws(",", F.array_sort(items)), 256)


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of all documents.

    Null texts have no words; repeated rows are judged each for itself; a null doc_id is
    carried. Empty documents: no rows; empty benchmark: no hits.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items_sha256().alias("items_sha256"), contaminated().alias("contaminated"))


_EMPTY_SHA = hashlib.sha256(b"").hexdigest()

ORACLE = {
    "op1_decontamination": f"""
with d as (
    select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
dn as (select row_number() over () as r, doc_id, coalesce(w, []) as w from d),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
bw as (select distinct cast(item_id as varchar) as item, least(13, len(w)) as k, unnest([array_to_string(w[i : i + least(13, len(w)) - 1], ' ') for i in range(1, len(w) - least(13, len(w)) + 2)]) as t
       from b where len(w) > 0 and item_id is not null),
ks as (select distinct k from bw),
dw as (select r, k, unnest(range(1, len(w) - k + 2)) as i, unnest([array_to_string(w[i : i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) as t from dn, ks where len(w) >= k),
h as (select r, i, dw.k, item from dw join bw on dw.t = bw.t and dw.k = bw.k),
n as (select r, count(distinct j) as n_hit from (select r, unnest(range(i, i + k)) as j from (select distinct r, i, k from h)) group by r),
m as (select r, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as s from (select distinct r, item from h) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       coalesce(s, '{_EMPTY_SHA}') as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dn left join n using (r) left join m using (r)""",
}
