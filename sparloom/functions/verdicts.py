"""Verdicts on claims as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = ("entailment", "neutral", "contradiction")
# A judge's words for the three labels.
JUDGE = {"supported": "entailment", "entailment": "entailment", "refuted": "contradiction", "contradiction": "contradiction", "neutral": "neutral"}


def verdict(entailment: Column, neutral: Column, contradiction: Column) -> Column:
    """struct(label, confidence) of the most likely label, the earliest on ties."""
    best = F.greatest(entailment, neutral, contradiction)
    label = F.when(entailment == best, LABELS[0]).when(neutral == best, LABELS[1]).otherwise(LABELS[2])
    return F.struct(label.alias("label"), best.alias("confidence"))


def judged(label: Column, confidence: Column) -> Column:
    """struct(label, entailment, neutral, contradiction): a judge's confidence, the rest split evenly; null for a label that isn't known."""
    words = F.create_map(*[F.lit(x) for pair in JUDGE.items() for x in pair])
    own = words[F.lower(F.trim(label))]
    rest = F.greatest((1 - confidence) / 2, F.lit(0.0))
    return F.when(own.isNotNull(), F.struct(own.alias("label"), *[F.when(own == x, confidence).otherwise(rest).alias(x) for x in LABELS]))


def escalates(verdict: Column, neutral: Column, floor: float, confident: float, similarity: Column | None = None, gate: float = 0.5) -> Column:
    """Whether a verdict goes to a judge: much neutral mass, or another label with little confidence; where the similarity of claim and evidence is given, only from `gate` on (none without one)."""
    asked = (neutral >= floor) | ((verdict["label"] != "neutral") & (verdict["confidence"] < confident))
    return asked if similarity is None else asked & F.coalesce(similarity >= gate, F.lit(False))


def settled(verdict: Column, escalated: Column, judge: Column) -> Column:
    """struct(label, confidence, method): the judge's verdict (judged()) where one was asked for and is known, else the first one; the judge alone changes a label, never the gate."""
    use = F.coalesce(escalated, F.lit(False)) & judge.isNotNull()
    sure = F.greatest(judge["entailment"], judge["neutral"], judge["contradiction"])
    return F.struct(F.when(use, judge["label"]).otherwise(verdict["label"]).alias("label"), F.when(use, sure).otherwise(verdict["confidence"]).alias("confidence"), F.when(use, "llm_judge").otherwise("nli").alias("method"))


def refused(verified: Column, claims: Column, floor: float) -> Column:
    """Whether a text with claims has too small a share of verified ones to be shown."""
    return (claims > 0) & (verified / F.nullif(claims, F.lit(0)) < floor)
