"""Labels picked for chunks, aggregated to documents. picks: (doc, chunk, pos, label, score, weight, start, end, source); ties go to the first appearance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _top(rows: DataFrame, *order) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(W.partitionBy("doc").orderBy(*order))).where("_r = 1").drop("_r")


def _share(threshold: float) -> float:
    if not 0 < threshold <= 1:
        raise ValueError("a threshold is above 0 and at most 1")
    return threshold


def known_picks(picks: Column, labels: list[str]) -> Column:
    """The picks (array) that are labels, in their order."""
    return F.filter(picks, lambda x: x.isin(*labels))


def demand_known(picks: Column, labels: list[str]) -> Column:
    """The picks (array), or an error that names one that is no label."""
    odd = F.filter(picks, lambda x: ~x.isin(*labels))
    return F.when(F.size(odd) > 0, F.raise_error(F.concat(F.lit("not a label: "), F.get(odd, F.lit(0)))).cast("array<string>")).otherwise(picks)


def in_label_order(found: Column, labels: list[str]) -> Column:
    """The labels among the found ones (array), in the order of `labels`."""
    return F.filter(F.array(*[F.lit(x) for x in labels]), lambda x: F.array_contains(found, x))


def decided(winner: Column, labels: list[str]) -> list[Column]:
    """labels (an array of the winner) and abstained: true without a winner or for one that is no label."""
    known = F.coalesce(winner.isin(*labels), F.lit(False))
    return [F.when(known, F.array(winner)).otherwise(F.array().cast("array<string>")).alias("labels"), (~known).alias("abstained")]


def vote(picks: DataFrame) -> DataFrame:
    """(doc, label, votes): the label picked most often."""
    counts = picks.groupBy("doc", "label").agg(F.count("*").alias("votes"), F.min("pos").alias("_first"))
    return _top(counts, F.desc("votes"), "_first").select("doc", "label", "votes")


def majority(picks: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc, label, abstained): the label of most chunks, if its share of the chunks reaches the threshold."""
    chunks = picks.groupBy("doc").agg(F.count_distinct("chunk").alias("_n"))
    counts = picks.groupBy("doc", "label").agg(F.count_distinct("chunk").alias("_votes"), F.min("pos").alias("_first"))
    won = _top(counts, F.desc("_votes"), "_first").join(chunks, "doc").withColumn("_ok", F.col("_votes") >= _share(threshold) * F.col("_n"))
    return won.select("doc", F.when(F.col("_ok"), F.col("label")).alias("label"), (~F.col("_ok")).alias("abstained"))


def union(picks: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """(doc, labels): all labels picked, in the order of `labels` (those that aren't among them left out), else by name."""
    found = picks.groupBy("doc").agg(F.sort_array(F.collect_set("label")).alias("found"))
    return found.select("doc", F.array_join(in_label_order(F.col("found"), labels) if labels else F.col("found"), ",").alias("labels"))


def intersection(picks: DataFrame) -> DataFrame:
    """(doc, label) picked in every chunk of the document."""
    chunks = picks.groupBy("doc").agg(F.count_distinct("chunk").alias("_n"))
    return picks.groupBy("doc", "label").agg(F.count_distinct("chunk").alias("_k")).join(chunks, "doc").where("_k = _n").select("doc", "label")


def weighted(picks: DataFrame, threshold: float = 0.5, exclusive: bool = False) -> DataFrame:
    """(doc, label, weight): the labels whose weight reaches the threshold's share of the document's weight; exclusive: the heaviest one."""
    by_label = picks.groupBy("doc", "label").agg(F.sum("weight").alias("weight"), F.min("pos").alias("_first"))
    if exclusive:
        return _top(by_label, F.desc("weight"), "_first").select("doc", "label", "weight")
    total = picks.groupBy("doc").agg(F.sum("weight").alias("_all"))
    return by_label.join(total, "doc").where(F.col("weight") >= _share(threshold) * F.col("_all")).select("doc", "label", "weight")


def max_score(picks: DataFrame, threshold: float | None = None, exclusive: bool = True) -> DataFrame:
    """(doc, label, score): the label of the highest score, null below the threshold; not exclusive: all labels that reach it."""
    best = picks.groupBy("doc", "label").agg(F.max("score").alias("score"), F.min("pos").alias("_first"))
    if not exclusive:
        return best.where(F.lit(True) if threshold is None else F.col("score") >= threshold).select("doc", "label", "score")
    top = _top(best, F.desc("score"), "_first")
    return top.select("doc", "label" if threshold is None else F.when(F.col("score") >= threshold, F.col("label")).alias("label"), "score")


def histogram(picks: DataFrame) -> DataFrame:
    return picks.groupBy("doc", "label").agg(F.count("*").alias("n"))


def provenance(picks: DataFrame) -> DataFrame:
    """(doc, chunks_used, spans, input_chunks, picked): chunks in order of first use, distinct spans by source, start and end, and how often each label was picked."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk"))), lambda s: s["chunk"])
    spans = picks.where(F.col("start").isNotNull()).groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("source", "start", "end"))).alias("spans"))
    used = picks.groupBy("doc").agg(F.array_distinct(ordered).alias("chunks_used"), F.count_distinct("chunk").alias("input_chunks"))
    counts = histogram(picks).groupBy("doc").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("picked"))
    none = F.array().cast("array<struct<source:string,start:int,end:int>>")
    return used.join(counts, "doc").join(spans, "doc", "left").select("doc", "chunks_used", F.coalesce(F.col("spans").cast("array<struct<source:string,start:int,end:int>>"), none).alias("spans"), "input_chunks", "picked")


#: Aggregators by name.
AGGREGATORS = {"vote": vote, "majority": majority, "union": union, "intersection": intersection, "weighted": weighted, "max_score": max_score}


def aggregate(picks: DataFrame, name: str | None = None, exclusive: bool = True, **options) -> DataFrame:
    """By an aggregator's name; without one, majority for exclusive labels and union for others."""
    name = name or ("majority" if exclusive else "union")
    if name not in AGGREGATORS:
        raise ValueError(f"no aggregator {name!r}; there are {', '.join(sorted(AGGREGATORS))}")
    return AGGREGATORS[name](picks, **options)


def ensemble(results: DataFrame) -> DataFrame:
    """(doc, value, votes, members): the value that most members of an ensemble gave, the earliest on ties. results: (doc, pos, value)."""
    counts = results.groupBy("doc", "value").agg(F.count("*").alias("votes"), F.min("pos").alias("_first"))
    return _top(counts.withColumn("members", F.sum("votes").over(W.partitionBy("doc"))), F.desc("votes"), "_first").select("doc", "value", "votes", "members")
