"""Longest common subsequences by bit vectors, and what rests on them: ROUGE-L and unified diffs.

A sequence's places are the bits of one integer; each element of the other sequence
takes a few operations on whole integers. Columns are compared in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Hashable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparloom.functions.stems import stem

#: Bits of kept vectors beyond which a trace-back halves its input first.
KEPT_BITS = 1 << 28


def _masks(a: Sequence[Hashable]) -> dict[Hashable, int]:
    places: dict[Hashable, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    out = {}
    for x, at in places.items():
        bits = np.zeros(len(a), np.uint8)
        bits[at] = 1
        out[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    return out


def _vectors(a: Sequence[Hashable], b: Sequence[Hashable]):
    """After each element of b: the integer in which bit i is 0 if a[: i + 1] has a longer common subsequence than a[:i]."""
    masks, full = _masks(a), (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def length(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Length of a longest common subsequence."""
    v = (1 << len(a)) - 1
    for v in _vectors(a, b):  # noqa: B007
        pass
    return len(a) - v.bit_count()


def _along(a: Sequence[Hashable], b: Sequence[Hashable]) -> np.ndarray:
    """length(a[:i], b) for each i."""
    v = (1 << len(a)) - 1
    for v in _vectors(a, b):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def matches(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence, ascending; of several the one that ends earliest in a, from the end backwards."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(i, i) for i in range(head)]
    out += [(head + i, head + j) for i, j in _middle(a[head : len(a) - tail], b[head : len(b) - tail])]
    return out + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def _middle(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) * len(b) > KEPT_BITS and len(b) > 1:
        half = len(b) // 2
        before, after = _along(a, b[:half]), _along(a[::-1], b[half:][::-1])[::-1]
        cut = int(np.argmax(before + after))
        return _middle(a[:cut], b[:half]) + [(cut + i, half + j) for i, j in _middle(a[cut:], b[half:])]
    kept = [(1 << len(a)) - 1, *_vectors(a, b)]
    i, j, out = len(a), len(b), []
    while i and j:
        if kept[j] >> (i - 1) & 1:
            i -= 1
        elif not kept[j - 1] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


_WORD = re.compile("[a-z0-9]+")


def words(text: str | None, stemmed: bool = False) -> list[str]:
    """Lower-cased runs of a-z and 0-9; stemmed: those of more than three letters as their stems."""
    found = _WORD.findall((text or "").lower())
    return [stem(w) if len(w) > 3 else w for w in found] if stemmed else found


def common_grams(a: list[str], b: list[str], n: int) -> tuple[int, int, int]:
    """(n-grams in common, each as often as in both, n-grams of a, of b)."""
    x, y = (Counter(zip(*(w[i:] for i in range(n)))) for w in (a, b))
    return sum((x & y).values()), sum(x.values()), sum(y.values())


def _scored(p: Column, g: Column, count: Callable[[list[str], list[str]], tuple[int, int, int]], stemmed: bool) -> Column:
    def run(p: pd.Series, g: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(p, g):
            k, n, m = count(words(x, stemmed), words(y, stemmed))
            rows.append((k / n if n else 0.0, k / m if m else 0.0, 2 * k / (n + m) if n and m else 0.0))
        return pd.DataFrame(rows, columns=["precision", "recall", "f1"])

    return F.pandas_udf(run, "struct<precision:double,recall:double,f1:double>")(p, g)


def rouge_l(p: Column, g: Column, stemmed: bool = False) -> Column:
    """struct(precision, recall, f1) of the longest common subsequence of two texts' words; 0 for null and wordless texts."""
    return _scored(p, g, lambda a, b: (length(a, b), len(a), len(b)), stemmed)


def rouge_n(p: Column, g: Column, n: int = 1, stemmed: bool = True) -> Column:
    """struct(precision, recall, f1) of the word n-grams that two texts have in common, counted in time that grows with the texts; 0 for null texts and those without n words."""
    return _scored(p, g, lambda a, b: common_grams(a, b, n), stemmed)


def lines_of(value: str | None) -> list[str]:
    """The lines of a JSON value, indented by two and with sorted keys; of other text its own lines; null has none."""
    if value is None:
        return []
    try:
        return json.dumps(json.loads(value), indent=2, sort_keys=True).splitlines()
    except ValueError:
        return value.splitlines()


def _hunk(a: list[str], b: list[str], steps: list[tuple[str, int, int]]) -> list[str]:
    """Header and lines of consecutive steps (mark, place in a, place in b)."""
    n_a, n_b = sum(m != "+" for m, *_ in steps), sum(m != "-" for m, *_ in steps)
    begin = lambda at, n: f"{at + (n > 0)}" + ("" if n == 1 else f",{n}")
    return [f"@@ -{begin(steps[0][1], n_a)} +{begin(steps[0][2], n_b)} @@", *(m + (b[j] if m == "+" else a[i]) for m, i, j in steps)]


def unified(a: list[str], b: list[str], context: int = 3) -> str:
    """A unified diff of two lists of lines along a longest common subsequence; '' where they are equal."""
    steps, i, j = [], 0, 0
    for x, y in [*matches(a, b), (len(a), len(b))]:
        steps += [("-", k, j) for k in range(i, x)] + [("+", x, k) for k in range(j, y)]
        if x < len(a) or y < len(b):
            steps.append((" ", x, y))
        i, j = x + 1, y + 1
    changed = [k for k, (m, *_) in enumerate(steps) if m != " "]
    if not changed:
        return ""
    out, lo, hi = ["--- before", "+++ after"], max(0, changed[0] - context), changed[0]
    for k in changed[1:]:
        if k - hi - 1 > 2 * context:
            out += _hunk(a, b, steps[lo : hi + context + 1])
            lo = k - context
        hi = k
    return "\n".join(out + _hunk(a, b, steps[lo : hi + context + 1]))


def _unified(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([unified(lines_of(x), lines_of(y)) for x, y in zip(before, after)], dtype=object)


def unified_diff(before: Column, after: Column) -> Column:
    """Unified diff of two JSON values (or texts) by lines, '' where they are equal; null is no lines."""
    return F.pandas_udf(_unified, "string")(before, after)
