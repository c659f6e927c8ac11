"""Sentence boundaries by an unsupervised model: abbreviations, sentence starters and collocations from counts.

Training follows Kiss and Strunk (2006): words that end in a full stop more often than
chance allows, weighed by their length, are abbreviations; words that follow certain
sentence ends more often than elsewhere are starters; pairs of an abbreviation, initial or
number and the next word that stand together more often than apart are collocations. All
counts are groupings with partial sums; the model is a small table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparloom.sources.scratch import shared_folder

#: Thresholds of the scores, as published, and entries that a model may have to be broadcast.
ABBREVIATION, STARTER, COLLOCATION, MOST = 0.3, 30.0, 7.88, 1_000_000
_EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.?!]+$"


def _xlog(count: Column, p: Column) -> Column:
    """count * ln(p), 0 where count is 0."""
    return F.when(count > 0, count * F.log(F.greatest(p, F.lit(1e-300)))).otherwise(0.0)


def together(a: Column, b: Column, both: Column, n: Column) -> Column:
    """Log-likelihood ratio of b's rate after a against its rate elsewhere: a of n places, b at b of them, at `both` of a's."""
    p, p1, p2 = b / n, both / a, F.when(n > a, (b - both) / (n - a)).otherwise(1.0)
    plain = _xlog(both, p) + _xlog(a - both, 1 - p) + _xlog(b - both, p) + _xlog(n - a - b + both, 1 - p)
    split = _xlog(both, p1) + _xlog(a - both, 1 - p1) + _xlog(b - both, p2) + _xlog(n - a - b + both, 1 - p2)
    return -2 * (plain - split)


def tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, dot, ends, after): each word in lower case without its final full stop, `#` for numbers; whether it has one; whether it ends in a question or exclamation mark; and the next word."""
    cores = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda t: F.regexp_replace(t, _EDGES, "")), lambda t: t != "")
    word = lambda t: F.when(t.rlike(r"^\p{N}[\p{N}.,]*$"), F.lit("#")).otherwise(F.lower(F.regexp_replace(t, r"[.?!]+$", "")))
    of = F.transform(F.col("c"), lambda t, i: F.struct(F.get("w", i).alias("word"), F.endswith(t, F.lit(".")).alias("dot"), (F.endswith(t, F.lit("?")) | F.endswith(t, F.lit("!"))).alias("ends"), F.get("w", i + 1).alias("after")))
    return docs.select(cores.alias("c")).select("c", F.transform("c", word).alias("w")).select(F.explode(of).alias("t")).select("t.*").where("word <> ''")


def train(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, word, after, score) of the texts: kinds abbreviation, starter and collocation; null and empty texts have no words, no words give no rows."""
    path = shared_folder(docs.sparkSession, "sentences")
    tokens(docs, text).groupBy("word", "dot", "ends", "after").agg(F.count("*").alias("n")).write.parquet(path)
    kinds = docs.sparkSession.read.parquet(path)  # all counts below are made of these, so texts are read once
    words = kinds.groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("dot"), F.col("n")).otherwise(0)).alias("dots"))
    total = kinds.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("dot"), F.col("n")).otherwise(0)).alias("all_dots"))
    rows = words.crossJoin(F.broadcast(total)).where("dots > 0 and word <> '#'")  # one row
    p1, p2 = F.col("all_dots") / F.col("total"), F.lit(0.99)
    rest = F.col("n") - F.col("dots")
    ratio = -2 * (_xlog(F.col("dots"), p1) + _xlog(rest, 1 - p1) - _xlog(F.col("dots"), p2) - _xlog(rest, 1 - p2))
    letters = F.length(F.replace("word", F.lit("."), F.lit("")))
    inner = F.length("word") - letters + 1
    score = ratio * F.exp(-letters.cast("double")) * inner / F.pow(letters.cast("double"), rest.cast("double"))
    abbreviations = rows.where((letters > 0) & (score >= ABBREVIATION)).select(F.lit("abbreviation").alias("kind"), "word", F.lit(None).cast("string").alias("after"), score.alias("score"))

    known = abbreviations.select("word", F.lit(True).alias("short"))
    short = F.coalesce("short", F.lit(False)) | (F.col("word") == "#") | F.col("word").rlike(r"^\p{L}$")
    marked = kinds.join(known, "word", "left").withColumn("short", short)
    ended = (F.col("dot") & ~F.col("short")) | F.col("ends")
    after = marked.where(F.col("after").isNotNull() & F.col("after").rlike(r"^\p{L}"))
    breaks = marked.agg(F.sum(F.when(ended, F.col("n")).otherwise(0)).alias("breaks"), F.sum("n").alias("total"))
    follow = after.where(ended).groupBy("after").agg(F.sum("n").alias("both"))
    follow = follow.join(words.select(F.col("word").alias("after"), F.col("n").alias("b")), "after").crossJoin(F.broadcast(breaks))
    likely = together(F.col("breaks"), F.col("b"), F.least("both", "b"), F.col("total"))
    starters = follow.where((F.col("both") / F.col("breaks") > F.col("b") / F.col("total")) & (likely >= STARTER)).select(F.lit("starter"), "after", F.lit(None).cast("string"), likely)

    pairs = after.where(F.col("dot") & F.col("short")).groupBy("word", "after").agg(F.sum("n").alias("both"))
    pairs = pairs.join(words.select("word", F.col("n").alias("a")), "word").join(words.select(F.col("word").alias("after"), F.col("n").alias("b")), "after").crossJoin(F.broadcast(breaks.select("total")))
    close = together(F.col("a"), F.col("b"), F.least("both", "a", "b"), F.col("total"))
    collocations = pairs.where((F.col("both") > 1) & (F.col("both") / F.col("a") > F.col("b") / F.col("total")) & (close >= COLLOCATION)).select(F.lit("collocation"), "word", "after", close)
    return abbreviations.union(starters).union(collocations)


@dataclass(frozen=True)
class Model:
    """What boundaries need; without entries every full stop before white space ends a sentence, but that of a number or an initial before a small letter."""

    abbreviations: frozenset[str] = frozenset()
    starters: frozenset[str] = frozenset()
    collocations: frozenset[tuple[str, str]] = field(default_factory=frozenset)


def model_of(rows: DataFrame) -> Model:
    """The table of train() as a model; its size is checked, as every task gets a copy."""
    found = rows.limit(MOST + 1).collect()
    if len(found) > MOST:
        raise ValueError(f"the model has over {MOST} entries; train with higher thresholds")
    of = lambda kind: [r for r in found if r["kind"] == kind]
    return Model(frozenset(r["word"] for r in of("abbreviation")), frozenset(r["word"] for r in of("starter")), frozenset((r["word"], r["after"]) for r in of("collocation")))


_MARK = re.compile(r"[.?!…]+[\"'”’»)\]]*(?=\s)")


def _word(token: str) -> str:
    core = re.sub(r"^[\W_]+|[^\w.?!]+$|(?<=[\w.?!])_+$", "", token)
    return "#" if re.match(r"^\d[\d.,]*$", core) else re.sub(r"[.?!]+$", "", core).lower()


def boundaries(text: str, model: Model) -> list[int]:
    """Where sentences end: the code points after their mark and the white space behind it."""
    out = []
    for m in _MARK.finditer(text):
        end = m.end()
        while end < len(text) and text[end].isspace():
            end += 1
        if end == len(text):
            continue
        if "?" not in m.group() and "!" not in m.group():
            begin = m.start()
            while begin and not text[begin - 1].isspace():
                begin -= 1
            stop = end
            while stop < len(text) and not text[stop].isspace():
                stop += 1
            word, token = _word(text[begin : m.start() + 1]), text[end:stop].lstrip("\"'“‘«([")
            after, small = _word(token), token[:1].islower()
            initial = len(word) == 1 and word.isalpha()
            if word == "#" or initial or word in model.abbreviations:
                if small or (word, after) in model.collocations:
                    continue
                if word != "#" and after not in model.starters:
                    continue
            elif ("…" in m.group() or ".." in m.group()) and small:
                continue
        out.append(end)
    return out


def sentences(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, start, end, text): the sentences of each document, with the white space behind them; null and empty texts have none."""
    kind = docs.schema[key].dataType

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                of, rows = [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    if t:
                        cuts = [0, *boundaries(t, model), len(t)]
                        rows += [(n, a, b, t[a:b]) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                        of += [i] * (len(cuts) - 1)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of, pa.int32())), *(pa.array([r[i] for r in rows], pa.int32()) for i in range(3)), pa.array([r[3] for r in rows], pa.string())], [key, "pos", "start", "end", "text"])

    return docs.select(key, text).mapInArrow(run, T.StructType([T.StructField(key, kind), *[T.StructField(c, T.IntegerType()) for c in ("pos", "start", "end")], T.StructField("text", T.StringType())]))
