"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

The alignment itself is relational. Token lists are exploded with their places,
windowed sums of byte lengths give each token's end, and an outer equi-join on (text,
end) gives the points at which a token of either side ends (written as a grouping of
both sides' rows by these keys, which keeps the shuffle by text). Points at which both end
are cuts; a running count of them numbers the groups. Each point is also one link: two
tokens overlap exactly if one of them is the next to end after the overlap, so the
next tokens of both sides at a point, by windows again, are all overlapping pairs, once
each, without a range join.

Over a corpus the same plan runs on distinct words. Neither tokenizer has a token that
holds a visible character and then a space, so both cut there, and a text's alignment
is that of its words one after another. Texts travel as batches of word codes; what is
shuffled are a batch's distinct words and distinct id pairs, however often they occur.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import as_text, column, discard, slices, stage

#: Bytes of text whose words are coded together; one longer document makes a batch of its own.
BATCH_BYTES = 24 << 20
#: Before a space that ends neither the text nor anything but a visible ASCII character, letter or digit. The text has a space before it.
_CUT = re.compile(r"(?<=[!-~\w])(?= (?s:.))")
_HARD = re.compile(r"[^!-~\w] |^ | \Z")


def words(text: str) -> list[str]:
    """The words of a text, without the one space that each has before it; together, spaces included, they are space + text."""
    if not text:
        return []
    if _HARD.search(text):
        return [w[1:] for w in _CUT.split(" " + text)]
    return text.split(" ")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if visible, else the next one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Both tokenizers in a worker, with the bytes of each token."""

    def __init__(self, a_path: str, b_path: str):
        self.a_path, self.b_path = a_path, b_path

    @cached_property
    def a(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.a_path)
        out.encode_special_tokens = True  # their strings in a text are ordinary text
        letters = _byte_letters()
        self.a_bytes = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in out.get_vocab().items()}
        return out

    @cached_property
    def b(self):
        import sentencepiece

        out = sentencepiece.SentencePieceProcessor(model_file=self.b_path)
        pieces = [out.id_to_piece(i) for i in range(out.vocab_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("this model has pieces over the end of a word")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if out.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        return out

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int], list[int], list[int]] | None]:
        """(ids, byte lengths, ids, byte lengths) of space + text; None where either side's bytes are not those."""
        a = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        b = self.b.encode(texts, num_threads=1)
        out: list = []
        for text, x, y in zip(texts, a, b):
            ids, want = x.ids, (" " + text).encode()
            left, right = [self.a_bytes[i] for i in ids], [self.b_bytes[i] for i in y]
            out.append((ids, [len(s) for s in left], y, [len(s) for s in right]) if b"".join(left) == want == b"".join(right) else None)
        return out


_pairs: dict[tuple[str, str], Pair] = {}


def pair(a_path: str, b_path: str) -> Pair:
    return _pairs.setdefault((a_path, b_path), Pair(a_path, b_path))


def encoded(texts_of: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """texts_of with `tokens` and `sizes` in place of the text: a's token ids, then b's as -1 - id, and their byte lengths; empty for null and empty texts and those whose bytes a tokenizer changes."""
    carry = [c for c in texts_of.columns if c != text_col]

    def run(batches):
        coder = pair(a_path, b_path)
        for batch in slices(batches, text_col):
            given = as_text(batch, text_col)
            found = iter(coder.encode([t for t in given if t]))
            ids, sizes = [], []
            for t in given:
                one = next(found) if t else None
                ids.append(one[0] + [-1 - i for i in one[2]] if one else ())
                sizes.append(one[1] + one[3] if one else ())
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in carry), pa.array(ids, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32()))], [*carry, "tokens", "sizes"])

    return texts_of.mapInArrow(run, T.StructType([texts_of.schema[c] for c in carry] + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("tokens", "sizes")]))


def points(tokens: DataFrame, key: str) -> DataFrame:
    """(key, end, a, b, behind, link_a, link_b): one row for each place of a text where a token of either side ends.

    tokens: key (unique), tokens and sizes of encoded(). a, b: the token that ends there, null if
    none does; link_a, link_b: the tokens that cover the bytes before it; behind: cuts
    from here to the end, so that equal values are one group.
    """
    # one shuffle by text; all that follows is grouped by it
    rows = tokens.select(key, "tokens", "sizes").repartition(key).select(key, F.posexplode(F.arrays_zip("tokens", "sizes")).alias("pos", "t"))
    token = F.col("t.tokens")
    rows = rows.select(key, "pos", (token < 0).cast("int").alias("side"), F.when(token < 0, -1 - token).otherwise(token).alias("id"), F.col("t.sizes").alias("size"))
    end = F.sum("size").over(Window.partitionBy(key, "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    of = lambda mark: F.max(F.when(F.col("side") == mark, F.col("id")))
    both = rows.withColumn("end", end).groupBy(key, "end").agg(of(0).alias("a"), of(1).alias("b"))
    onward = Window.partitionBy(key).orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    cut = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1).otherwise(0)
    return both.select(key, "end", "a", "b", F.sum(cut).over(onward).alias("behind"), F.last("a", True).over(onward).alias("link_a"), F.last("b", True).over(onward).alias("link_b"))


def _ordered(name: str):
    rows = F.array_sort(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("end", F.col(name).alias("id")))))
    return F.transform(rows, lambda x: x["id"])


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Groups (id_col, group, start, end, a_ids, b_ids) and links (id_col, end, a_id, b_id) of each document.

    start, end: bytes of space + text. Groups are numbered from 0 in the order of the
    text. Documents without tokens (null, empty, or changed by a tokenizer) have no rows.
    Repeated rows are texts of their own, a null id is carried.
    """
    rows = stage(encoded(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row")), a_path, b_path))
    found = stage(points(rows.drop("id"), "row"))
    names = rows.select("row", F.col("id").alias(id_col))
    grouped = found.groupBy("row", "behind").agg(F.max("end").alias("end"), _ordered("a").alias("a_ids"), _ordered("b").alias("b_ids"))
    before = Window.partitionBy("row").orderBy("end")
    grouped = grouped.select("row", (F.row_number().over(before) - 1).alias("group"), F.coalesce(F.lag("end").over(before), F.lit(0)).alias("start"), "end", "a_ids", "b_ids")
    return grouped.join(names, "row").select(id_col, "group", "start", "end", "a_ids", "b_ids"), found.join(names, "row").select(id_col, "end", F.col("link_a").alias("a_id"), F.col("link_b").alias("b_id"))


def texts(batch: pa.RecordBatch, name: str):
    """The texts one after another, null as empty."""
    return (x.as_py() or "" for x in column(batch, name))


def _pack(values: np.ndarray) -> bytes:
    """Small numbers by planes of their bytes, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _coded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for some megabytes of documents: batch, ids, counts (words of each), codes (of each word, packed), words (distinct)."""

    def run(batches):
        at = TaskContext.get().partitionId() << 33
        for batch in slices(batches, text_col, BATCH_BYTES):
            known, codes, counts = {}, array("i"), array("i")
            for text in texts(batch, text_col):
                found = words(text)
                codes.extend([known.setdefault(w, len(known)) for w in found])
                counts.append(len(found))
            one = [pa.array([at], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), column(batch, id_col))]
            one += [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (pa.array(counts, pa.int32()), pa.array(list(known), pa.string()))]
            one.insert(3, pa.array([_pack(np.frombuffer(codes, np.int32))], pa.binary()))
            del known, codes
            yield pa.RecordBatch.from_arrays(one, ["batch", "ids", "counts", "codes", "words"])
            at += 1

    of = T.ArrayType
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, T.StructType([T.StructField("batch", T.LongType()), T.StructField("ids", of(docs.schema[id_col].dataType)), T.StructField("counts", of(T.IntegerType())), T.StructField("codes", T.BinaryType()), T.StructField("words", of(T.StringType()))]))


def _record(spark: SparkSession, a_path: str, b_path: str) -> np.dtype:
    """How a point is stored: the ids that link there, in as many bytes as the vocabularies need, and the sides that end there (1: a, 2: b, 3: both, a cut)."""

    def run(batches):
        for batch in batches:
            coder = pair(a_path, b_path)
            n = max(coder.a.get_vocab_size(), coder.b.vocab_size())
            yield pa.RecordBatch.from_arrays([pa.array([n] * batch.num_rows, pa.int64())], ["n"])

    wide = spark.range(1).mapInArrow(run, "n long").first()["n"] > 1 << 16
    return np.dtype([("a", "<u4" if wide else "<u2"), ("b", "<u4" if wide else "<u2"), ("sides", "u1")])


def _word_results(coded: DataFrame, a_path: str, b_path: str, record: np.dtype) -> DataFrame:
    """(word, points) of each distinct word, staged: its points in order as records; null where it has no tokens."""
    distinct = coded.select(F.explode("words").alias("word")).distinct()
    keyed = stage(distinct.withColumn("key", F.monotonically_increasing_id()))
    tokens = stage(encoded(keyed.withColumnRenamed("word", "text"), a_path, b_path))
    sides = F.when(F.col("b").isNull(), 1).when(F.col("a").isNull(), 2).otherwise(3)
    point = F.shiftleft(F.col("link_a").cast("long"), 33).bitwiseOR(F.shiftleft(F.col("link_b").cast("long"), 2)).bitwiseOR(sides)
    each = points(tokens, "key").select("key", F.struct("end", point.alias("point")).alias("p")).groupBy("key").agg(F.array_sort(F.collect_list("p")).alias("p"))

    def run(batches):
        for batch in batches:
            lists = column(batch, "points")
            flat = lists.flatten().to_numpy()
            records = np.empty(len(flat), record)
            records["a"], records["b"], records["sides"] = flat >> 33, flat >> 2 & (1 << 31) - 1, flat & 3
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64) * record.itemsize
            offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes())
            packed = pa.Array.from_buffers(pa.binary(), len(lists), [None, offsets, pa.py_buffer(records.tobytes())])
            yield pa.RecordBatch.from_arrays([column(batch, "word"), pc.if_else(lists.is_valid(), packed, pa.scalar(None, pa.binary()))], ["word", "points"])

    out = stage(keyed.join(each.select("key", F.col("p.point").alias("points")), "key", "left").select("word", "points").mapInArrow(run, "word string, points binary"))
    discard(keyed, tokens)
    return out


_PARTS = "n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, digests array<string>, per_doc array<int>, pairs binary, times binary, pair_a array<int>, pair_b array<int>, pair_docs array<bigint>"


def _one(values, kind) -> pa.Array:
    flat = pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def _group_texts(a: list[int], b: list[int], sides: list[int], first: list[int]) -> list[str]:
    """The groups of each word, written as `a1,a2|b1;a3|b2`; word i has the points from first[i] to first[i + 1]."""
    out = []
    for lo, hi in zip(first, first[1:]):
        if hi - lo == 1:
            out.append(f"{a[lo]}|{b[lo]}")
            continue
        groups, left, right = [], [], []
        for i in range(lo, hi):
            s = sides[i]
            if s != 2:
                left.append(str(a[i]))
            if s != 1:
                right.append(str(b[i]))
            if s == 3:
                groups.append(f"{','.join(left)}|{','.join(right)}")
                left, right = [], []
        out.append(";".join(groups))
    return out


def _compose(coded: pa.Table, found: pa.Table, record: np.dtype) -> pa.Table:
    """What a batch's documents are made of: sums and digest of each, its distinct id pairs with how often each links, and how many documents hold each pair."""
    counts = coded.column("counts").combine_chunks().flatten().to_numpy().astype(np.int64)
    codes = _unpack(coded.column("codes")[0].as_py(), int(counts.sum()))
    lists = found.column("points").take(pc.sort_indices(found.column("code"))).combine_chunks()
    good = lists.is_valid().to_numpy(zero_copy_only=False).astype(bool)
    n_links = (pc.fill_null(pc.binary_length(lists), 0).to_numpy() // record.itemsize).astype(np.int32)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lists)], pa.int32()), pc.fill_null(lists, b"")), b"")[0].as_buffer()
    flat = np.frombuffer(joined, record)
    del lists, found
    firsts = np.concatenate([[0], np.cumsum(n_links, dtype=np.int64)])
    texts: list[str] = []
    for lo in range(0, len(n_links), 20_000):  # some words at a time: lists of numbers take far more memory than arrays
        own = firsts[lo : lo + 20_001]
        some = flat[own[0] : own[-1]]
        texts += _group_texts(some["a"].tolist(), some["b"].tolist(), some["sides"].tolist(), (own - own[0]).tolist())
    sides = flat["sides"]
    within = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])[firsts]).astype(np.int32)
    value = {"n_a": within(sides != 2), "n_b": within(sides != 1), "n_groups": within(sides == 3), "n_links": n_links}
    coded_pairs = pa.array(flat["a"].astype(np.int64) << 32 | flat["b"]).dictionary_encode()
    ids, pair_of = coded_pairs.dictionary.to_numpy(), coded_pairs.indices.to_numpy()
    del flat, sides, coded_pairs, joined

    ends = np.cumsum(counts)
    filled = np.flatnonzero(counts)
    starts = (ends - counts)[filled]
    per = lambda v: np.add.reduceat(v[codes], starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    whole = np.ones(len(counts), bool)  # all words have tokens
    whole[filled] = per((~good).astype(np.int8)) == 0
    sums = {}
    for name, v in value.items():
        sums[name] = np.zeros(len(counts), np.int64)
        sums[name][filled] = per(v)
        sums[name][~whole] = 0
    digests, per_doc, pairs, times = [], [], [], []
    pair_docs = np.zeros(len(ids), np.int64)
    for lo, hi, fine in zip((ends - counts).tolist(), ends.tolist(), whole.tolist()):
        if lo == hi or not fine:
            digests.append("")
            per_doc.append(0)
            continue
        own = codes[lo:hi]
        digests.append(hashlib.sha256(";".join(map(texts.__getitem__, own.tolist())).encode()).hexdigest())
        n = n_links[own]
        stop = np.cumsum(n)
        place = np.arange(stop[-1]) + np.repeat(firsts[own] - (stop - n), n)
        seen, often = np.unique(pair_of[place], return_counts=True)
        pair_docs[seen] += 1
        per_doc.append(len(seen))
        pairs.append(seen)
        times.append(often)
    packed = [pa.array([_pack(np.concatenate(x) if x else np.zeros(0, np.int32))], pa.binary()) for x in (pairs, times)]
    arrays = [coded.column("batch").combine_chunks(), coded.column("ids").combine_chunks(), *[_one(sums[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], _one(digests, pa.string()), _one(np.array(per_doc, np.int32), pa.int32()), *packed, _one((ids >> 32).astype(np.int32), pa.int32()), _one((ids & 0xFFFFFFFF).astype(np.int32), pa.int32()), _one(pair_docs, pa.int64())]
    return pa.Table.from_arrays(arrays, ["batch", "ids", *[c.split()[0] for c in _PARTS.split(", ")]])


def summaries(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, with counts of linked id pairs over all docs.

    A pair's count is how many documents hold it linked; n_best counts the links whose
    pair has the highest count of its A id, ties included. Documents without tokens (null,
    empty, or changed by a tokenizer): zeros and ''. Repeated rows are documents of
    their own; a null id is carried; an empty table gives no rows.
    """
    coded = stage(_coded(docs, id_col, text_col))
    record = _record(docs.sparkSession, a_path, b_path)
    results = _word_results(coded, a_path, b_path, record)
    asked = coded.select(F.col("batch").alias("of"), F.posexplode("words").alias("code", "word")).join(results, "word").drop("word")
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("batch", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), *T.StructType.fromDDL(_PARTS).fields])
    parts = stage(coded.drop("words").groupBy("batch").cogroup(asked.groupBy("of")).applyInArrow(lambda left, right: _compose(left, right, record), schema))
    discard(coded, results)

    held = parts.select("batch", F.posexplode(F.arrays_zip("pair_a", "pair_b", "pair_docs")).alias("code", "p")).select("batch", "code", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.pair_docs").alias("n"))
    counts = held.groupBy("a", "b").agg(F.sum("n").alias("count"))
    highest = counts.groupBy("a").agg(F.max("count").alias("top"))
    counts = counts.join(highest, "a").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))
    told = held.select(F.col("batch").alias("of"), "code", "a", "b").join(counts, ["a", "b"]).select("of", "code", "count", "best")
    out = T.StructType([T.StructField("id", id_type), *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], T.StructField("groups_sha256", T.StringType())])

    def finish(part: pa.Table, told: pa.Table) -> pa.Table:
        told = told.sort_by("code")
        count, best = told.column("count").to_numpy(), told.column("best").to_numpy().astype(np.int64)
        flat = {c: part.column(c).combine_chunks().flatten() for c in ("ids", "n_a", "n_b", "n_groups", "n_links", "digests", "per_doc")}
        per_doc = flat["per_doc"].to_numpy()
        ends = np.cumsum(per_doc, dtype=np.int64)
        pairs, times = (_unpack(part.column(c)[0].as_py(), int(ends[-1]) if len(ends) else 0) for c in ("pairs", "times"))
        sums = []
        for value in (best, count):
            total = np.concatenate([[0], np.cumsum(value[pairs] * times)])
            sums.append(pa.array(total[ends] - total[ends - per_doc]))
        return pa.Table.from_arrays([flat["ids"], flat["n_a"], flat["n_b"], flat["n_groups"], flat["n_links"], *sums, flat["digests"]], out.names)

    needed = parts.drop("pair_a", "pair_b", "pair_docs")
    return needed.groupBy("batch").cogroup(told.groupBy("of")).applyInArrow(finish, out).withColumnRenamed("id", id_col)


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """summaries() of all documents for the byte-level 50k file and the 32k piece model.

    Documents without tokens: zeros and ''. Repeated rows: one row each; a null doc_id is
    carried. Empty table: no rows.
    """
    return summaries(spark.read.parquet(f"{sf_dir}/documents.parquet"), *default_tokenizers())
