"""Language identification by rank-order profiles.

A document's letter n-grams of one to three characters (words padded with spaces)
are ranked by frequency; so are each language's, counted over its training texts in
Spark. A document gets the language whose profile is nearest in out-of-place
distance: the sum of the differences of rank, `size` for n-grams a profile lacks.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ._common import as_text, column, out_batch, slices, stage

#: Ranks of a profile.
SIZE = 300
#: Languages whose profiles are broadcast together; more take more passes.
LANGUAGES = 4096
#: Numbers in one table of distances that a task holds: n-grams of a slice by languages.
CELLS = 4_000_000
_UNDETERMINED = "und"
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, count) of each distinct n-gram of each text; a code holds up to three code points, 21 bits each.

    Every n-gram begins some trigram, so shorter ones are summed up from those. Texts
    whose numbers and alphabet don't fit into one sort key are halved until they do;
    one text alone always fits.
    """
    points = np.frombuffer("\0".join(texts).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letter_table()[points], points, 0)
    # the lower case of a text may be longer than the text
    bounds = np.cumsum(np.fromiter((len(t.lower()) + 1 for t in texts), np.int64, len(texts)))
    padded = np.concatenate([[0], points, [0, 0]]).astype(np.int64)
    keep = np.concatenate([[True], (padded[1:] != 0) | (padded[:-1] != 0)])  # one space between words
    at = np.flatnonzero(keep)
    p = padded[at]
    doc = np.searchsorted(bounds + 1, at, "right")
    p = np.concatenate([p, [0, 0]])
    doc = np.minimum(doc, len(texts) - 1)
    alphabet, small = np.unique(p, return_inverse=True)
    bits = max(1, int(len(alphabet) - 1).bit_length())
    a, b, c = small[:-2], small[1:-1], small[2:]
    c = np.where(b == 0, 0, c)  # a trigram ends with its word
    doc = np.where(a == 0, np.append(doc[1:], doc[-1:]), doc)  # the space before a word belongs to the word's text
    if bits * 3 + len(texts).bit_length() > 63 and len(texts) > 1:
        half = len(texts) // 2
        (text, code, counts), (more, codes, n) = ngrams(texts[:half]), ngrams(texts[half:])
        return np.concatenate([text, more + half]), np.concatenate([code, codes]), np.concatenate([counts, n])
    if len(texts) == 1:
        doc = np.zeros_like(doc)  # the text's number needs no bits
    starts = np.flatnonzero((a != 0) | (b != 0))
    keys = np.sort((doc[starts] << 3 * bits) | (a[starts] << 2 * bits) | (b[starts] << bits) | c[starts])
    outs = []
    for n in (3, 2, 1):
        k = keys >> (3 - n) * bits
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(k)))
        k = k[first]
        chars = [alphabet[(k >> j * bits) & (1 << bits) - 1] for j in range(n - 1, -1, -1)]
        text = k >> n * bits
        code = np.zeros(len(k), np.int64)
        for x in chars:
            code = (code << 21) | np.where(x == 0, 32, x)  # a space, so that codes of different lengths differ
        whole = chars[-1] != 0 if n == 1 else (np.maximum.reduce(chars) != 0)
        if n == 3:  # "a", pad, pad is the bigram "a", pad
            whole &= (chars[1] != 0)
        outs.append((text[whole], code[whole], counts[whole]))
    return tuple(np.concatenate(x) for x in zip(*outs))


def _top(text: np.ndarray, code: np.ndarray, counts: np.ndarray, n_texts: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, rank) of each text's `size` most frequent n-grams; ties by code."""
    order = np.lexsort((code, -counts, text))
    text, code = text[order], code[order]
    first = np.searchsorted(text, np.arange(n_texts))
    rank = np.arange(len(text)) - first[text]
    top = rank < size
    return text[top], code[top], rank[top]


def profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = SIZE) -> DataFrame:
    """(lang, code, rank): each language's `size` most frequent n-grams over all texts with that language; ties by code.

    Rows without language or text add nothing.
    """

    def run(batches):
        for batch in slices(batches, "text"):
            langs = column(batch, "lang").to_pylist()
            names = sorted(set(langs))
            text, code, counts = ngrams(as_text(batch, "text"))
            of = np.array([names.index(x) for x in langs])[text] if len(names) > 1 else np.zeros(len(text), np.int64)
            order = np.lexsort((code, of))
            of, code, counts = of[order], code[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (code[1:] != code[:-1])])) if len(of) else np.zeros(0, np.int64)
            sums = np.add.reduceat(counts, first) if len(first) else first
            yield pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(of[first])), pa.array(code[first]), pa.array(sums.astype(np.int64))], ["lang", "code", "n"])

    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = known.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # a limit on row_number() itself is applied within tasks first, so a language's n-grams don't all move
    ranked = counts.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "code")))
    return ranked.where(F.col("place") <= size).select("lang", "code", (F.col("place") - 1).alias("rank"))


def identify(docs: DataFrame, known: DataFrame, text_col: str = "text", out: str = "lang_pred", score: str = "score", size: int = SIZE) -> DataFrame:
    """docs with the nearest profile's language and a score (1: the profile's order, 0: nothing shared).

    `und` with score 0 for null texts, texts without letters, or when no profile is known. Ties: the first language by name.
    """
    spark = docs.sparkSession
    known = stage(known)  # counted once, read more than once
    langs = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    carry = [c for c in docs.columns if c not in (out, score)]
    docs = docs.select(*carry)
    for lo in range(0, max(1, len(langs)), LANGUAGES):
        some = langs[lo : lo + LANGUAGES]
        rows = known.where(F.col("lang").isin(some)).collect() if some else []
        docs = _nearest(docs, spark.sparkContext.broadcast(_ranks(some, rows, size)), text_col, carry, out, score, size)
    return docs


def _ranks(langs: list[str], rows: list, size: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, all codes of their profiles, and each code's rank by language (-1: none)."""
    codes = np.array(sorted({r["code"] for r in rows}), np.int64)
    table = np.full((len(codes) + 1, len(langs)), -1, np.int32)
    index = {x: i for i, x in enumerate(langs)}
    for r in rows:
        table[np.searchsorted(codes, r["code"]), index[r["lang"]]] = r["rank"]
    return langs, codes, table


def _nearest(docs: DataFrame, model, text_col: str, carry: list[str], out: str, score: str, size: int) -> DataFrame:
    again = out in docs.columns

    def run(batches):
        langs, codes, table = model.value
        for batch in slices(batches, text_col, 1 << 20):
            n = batch.num_rows
            text, code, counts = ngrams(as_text(batch, text_col))
            text, code, rank = _top(text, code, counts, n, size)
            names = [_UNDETERMINED] * n
            best = np.zeros(n)
            if len(langs) and len(text):
                at = np.searchsorted(codes, code)
                at[codes[np.minimum(at, len(codes) - 1)] != code] = len(codes)
                total = np.bincount(text, minlength=n)
                least, nearest = np.full(n, np.inf), np.zeros(n, np.int64)
                few = max(1, CELLS // max(len(at), n))
                for j in range(0, len(langs), few):
                    theirs = table[at, j : j + few]
                    places = np.where(theirs < 0, size, np.abs(theirs - rank[:, None]))
                    far = np.stack([np.bincount(text, places[:, i], n) for i in range(places.shape[1])], axis=1)
                    here = far.argmin(axis=1)
                    there = far[np.arange(n), here]
                    nearest = np.where(there < least, j + here, nearest)
                    least = np.minimum(there, least)
                some = np.flatnonzero(total)
                best[some] = 1 - least[some] / (size * total[some])
                for i in some.tolist():
                    names[i] = langs[nearest[i]]
            if again:
                for i, (old, s) in enumerate(zip(column(batch, out).to_pylist(), column(batch, score).to_pylist())):
                    if old != _UNDETERMINED and s >= best[i]:
                        names[i], best[i] = old, s
            yield out_batch(batch, carry, {out: pa.array(names, pa.string()), score: pa.array(best)})

    return docs.mapInArrow(run, T.StructType([docs.schema[c] for c in carry] + [T.StructField(out, T.StringType()), T.StructField(score, T.DoubleType())]))


def op10_language(spark, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of all documents; profiles are learned from those that aren't held out.

    Null texts and texts without a letter: `und`, score 0. Repeated rows are judged
    alike and count as often as they occur in profiles; a null doc_id isn't held out.
    Empty table: no rows. Equal distances: the first language by name.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    found = identify(docs.select("doc_id", "text"), profiles(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
