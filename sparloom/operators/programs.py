"""Programs over rows with the model calls injected: producers and scorers are functions from Columns to Columns (or run before, over Arrow batches, by runs.execute)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparloom.functions.arrays import let


def best_of_n(rows: DataFrame, key: str, n: int, produce: Callable[[Column], Column], score: Callable[[Column], Column]) -> DataFrame:
    """(key, index, output, score, failed): of n outputs the one of the best score, the earliest on ties; a failed score (null) loses to any other. produce(index) may read all columns of rows, of which each is a task of its own; nothing is shuffled."""
    tried = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: let(produce(i), lambda out: F.struct(i.alias("index"), out.alias("output"), score(out).cast("double").alias("score"))))
    ahead = lambda s: F.coalesce(s["score"], F.lit(float("-inf")))
    best = lambda a: F.aggregate(F.slice(a, 2, n), a[0], lambda x, y: F.when(ahead(y) > ahead(x), y).otherwise(x))
    made = rows.select(key, let(tried, lambda a: F.struct(best(a).alias("b"), F.size(F.filter(a, lambda s: s["score"].isNull())).cast("long").alias("failed"))).alias("_t"))
    return made.select(key, "_t.b.index", "_t.b.output", "_t.b.score", "_t.failed")


def compare_chains(rows: DataFrame, key: str, n: int, produce: Callable[[Column], Column], decide: Callable[[Column], Column]) -> DataFrame:
    """(key, output): decide(array of the n outputs in order)."""
    return rows.select(key, let(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), produce), decide).alias("output"))


def refine(start: Column, improve: Callable[[Column, Column], Column], score: Callable[[Column], Column], least: float, most: int) -> Column:
    """struct(output, score, rounds): improve(output, round) until the score reaches `least`, `most` rounds at most; then the best one, the earliest on ties."""
    state = lambda out, s, best, top, n: F.struct(out.alias("out"), s.alias("s"), best.alias("best"), top.alias("top"), n.cast("int").alias("n"))

    def step(a: Column, i: Column) -> Column:
        new = improve(a["out"], i)
        mark = F.coalesce(score(new).cast("double"), F.lit(float("-inf")))
        better = mark > a["top"]
        return F.when(a["s"] >= least, a).otherwise(state(new, mark, F.when(better, new).otherwise(a["best"]), F.greatest(mark, a["top"]), i))

    first = F.coalesce(score(start).cast("double"), F.lit(float("-inf")))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(most)), state(start, first, start, first, F.lit(0)), step)
    return F.struct(end["best"].alias("output"), end["top"].alias("score"), end["n"].alias("rounds"))


def judged(score: Column) -> Column:
    """A judge's score within 0 and 1; a failure is 0."""
    return F.least(F.greatest(F.coalesce(score, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def descend(scores: DataFrame, labels: DataFrame, depth: int, least: float = 0.0) -> DataFrame:
    """(doc, label, level): the walk from the roots of a taxonomy (name, parent) to the best child each time, until a leaf, `depth` levels or a best score below `least`.

    scores: (doc, label, score), what a classifier says of each label; labels that it says nothing of aren't chosen. Ties go to the smaller label.
    """
    placed = scores.join(labels, F.col("label") == F.col("name")).select("doc", "label", "score", "parent")
    at = None
    for level in range(depth):
        if at is None:
            some = placed.where("parent is null")
        else:
            some = placed.join(at.select("doc", F.col("label").alias("parent")), ["doc", "parent"])
        best = some.where(F.col("score") >= least).groupBy("doc").agg(F.max_by("label", F.struct("score", F.expr("concat(transform(split(label, ''), x -> -ascii(x)), array(1))"))).alias("label")).withColumn("level", F.lit(level))
        at = best if at is None else best.unionByName(at.join(best.select("doc"), "doc", "left_anti"))
    return at


def query_focused(sentences: DataFrame, query: Column, k: int, joiner: str = " ") -> DataFrame:
    """(doc, context, spans, ranks): each document's k sentences nearest to the query, in source order, as a summariser is given them, with their spans and their order by score.

    sentences: (doc, start, end, text, vector); query is a vector.
    """
    from sparloom.functions.metrics import cosine

    scored = sentences.withColumn("_s", cosine(F.col("vector"), query))
    ranked = scored.withColumn("_r", F.row_number().over(W.partitionBy("doc").orderBy(F.desc("_s"), "start"))).where(F.col("_r") <= k)
    listed = F.array_sort(F.collect_list(F.struct("start", "end", "text", "_r")))
    return ranked.groupBy("doc").agg(listed.alias("x")).select("doc", F.array_join(F.transform("x", lambda s: s["text"]), joiner).alias("context"), F.transform("x", lambda s: F.struct(s["start"], s["end"])).alias("spans"), F.transform("x", lambda s: s["_r"]).alias("ranks"))


def extract_corpus(docs: DataFrame, key: str, extractors: dict[str, Callable[[Column], Column]], kinds: dict[str, str], text: str = "text", policy: str = "cell") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, table, lineage): a column for each extractor (text to a value or null), refusals by policy, equal values told by kind.

    cells: (doc, col, status, value, pos); table: one row a document; lineage as dedup_cells().
    """
    from sparloom.operators import cells

    values = docs.select(F.col(key).alias("doc"), *[f(F.col(text)).cast("string").alias(c) for c, f in extractors.items()])
    long = cells.refusal_policy(cells.project_cells(values, "doc", list(extractors)), policy)
    place = F.create_map(*[F.lit(x) for c in enumerate(extractors) for x in (c[1], c[0])])
    long = long.withColumn("pos", F.struct("doc", place[F.col("col")].alias("n")))
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("col")]
    return long, cells.pivot_cells(long, list(extractors)), cells.dedup_cells(long, cells.canonical_value(F.col("value"), kind))[1]
