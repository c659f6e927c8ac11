"""Table functions for SQL: splitters, company names and rankers, to be used with LATERAL or on a partitioned table."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


class SplitText:
    """split_text(text, width [, overlap]): (pos, start, end, chunk) of fixed width; null and empty texts have none."""

    @staticmethod
    def analyze(text: AnalyzeArgument, width: AnalyzeArgument, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError("split_text: the first argument is a text")
        step = width.value - (overlap.value if overlap else 0) if width.isConstantExpression else 1
        if step < 1:
            raise ValueError("split_text: the width is larger than the overlap")
        return AnalyzeResult(StructType([StructField("pos", IntegerType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("chunk", StringType())]))

    def eval(self, text: str, width: int, overlap: int = 0):
        at, pos = 0, 0
        while text and at < len(text):
            end = min(at + width, len(text))
            yield pos, at, end, text[at:end]
            if end == len(text):
                return
            at, pos = at + width - overlap, pos + 1


class FindEntities:
    """find_entities(text): (start, end, name, form) of the companies in a text."""

    def __init__(self):
        from sparloom.operators import entities

        self.of, self.machine = entities.entities_of, entities.automaton(entities.gazetteer())

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError("find_entities: the argument is a text")
        return AnalyzeResult(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("name", StringType()), StructField("form", StringType())]))

    def eval(self, text: str):
        if text:
            yield from self.of(text, self.machine.iter(text))


class RankRows:
    """rank_rows(TABLE(t), by, best): the rows of each value of column `by` with the `best` largest values of the table's column `score`, with their `rank`.

    The table is partitioned by `by` and ordered by score, largest first, then by its other columns;
    rows come out with all columns of t. A partition is read row by row, none is held.
    """

    def __init__(self):
        self.seen = 0

    @staticmethod
    def analyze(table: AnalyzeArgument, by: AnalyzeArgument, best: AnalyzeArgument) -> AnalyzeResult:
        names = [f.name for f in table.dataType]
        if by.value not in names or "score" not in names:
            raise ValueError("rank_rows: the table has columns `score` and the one to partition by")
        rest = [n for n in names if n not in ("score", by.value)]
        return AnalyzeResult(StructType([*table.dataType, StructField("rank", LongType())]), partitionBy=[PartitioningColumn(by.value)], orderBy=[OrderingColumn("score", ascending=False), *[OrderingColumn(n) for n in rest]])

    def eval(self, row, by: str, best: int):
        self.seen += 1
        if self.seen <= best:
            yield (*row, self.seen)


def register(spark: SparkSession) -> None:
    """Makes split_text, find_entities and rank_rows known to the session's SQL."""
    for name, kind in (("split_text", SplitText), ("find_entities", FindEntities), ("rank_rows", RankRows)):
        spark.udtf.register(name, F.udtf(kind))
