"""Company names by a gazetteer of legal forms: an automaton over all forms, then a walk back over the name.

The automaton is built once a worker from the broadcast forms and finds all of them in
one pass over a text, however many they are.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparloom.functions.extractors import ARTICLES, FORMS, MARKED_FORMS

#: Words that join parts of a name though they have no capital.
JOINERS = ("&", "and", "of", "de", "und", "et", "y")


def gazetteer(forms: Iterable[str] = FORMS, marked: Iterable[str] = MARKED_FORMS) -> list[str]:
    """All spellings: plain forms as they are, in capitals, and both with a full stop; marked forms as they are and in capitals."""
    plain = {v for f in forms for v in (f, f.upper())}
    return sorted(plain | {f"{v}." for v in plain} | {v for f in marked for v in (f, f.upper())})


def automaton(spellings: Iterable[str]):
    """An Aho-Corasick automaton of the spellings."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for s in spellings:
        out.add_word(s, len(s))
    out.make_automaton()
    return out


def forms_in(text: str, found: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the forms among found (last place, length) that stand alone: after white space, before no letter or digit; the longest of one start, none inside another."""
    longest: dict[int, int] = {}
    for last, size in found:
        start, end = last - size + 1, last + 1
        if start and text[start - 1].isspace() and not (end < len(text) and (text[end].isalnum() or text[end] == "_")):
            longest[start] = max(longest.get(start, 0), end)
    out: list[tuple[int, int]] = []
    for start, end in sorted(longest.items()):
        if not out or start >= out[-1][1]:
            out.append((start, end))
    return out


def _name_start(text: str, at: int, barred: int) -> int | None:
    """Where the name before the form at `at` begins; not before `barred`."""
    end, start, first = at, None, True
    while True:
        stop = end
        while stop > barred and text[stop - 1].isspace():
            if text[stop - 1] == "\n" and stop - 2 >= 0 and text[stop - 2] == "\n":
                return start
            stop -= 1
        begin = stop
        while begin > barred and not text[begin - 1].isspace():
            begin -= 1
        token = text[begin:stop]
        if not token or (token[-1] in ".;:!?" and not (len(token) == 2 and token[0].isupper())) or (token[-1] == "," and not first):
            return start
        word = token.lstrip("\"'(“‘«[").rstrip(",")
        if word[:1].isupper() or word[:1].isdigit():
            if word.lower() in ARTICLES:
                return start
            start = stop - len(token.lstrip("\"'(“‘«["))
        elif word not in JOINERS or first:
            return start
        if word != token.rstrip(","):  # an opening mark begins the name
            return start
        end, first = begin, False


def entities_of(text: str, found: Iterable[tuple[int, int]]) -> list[tuple[int, int, str, str]]:
    """(start, end, name, form) of each company: capitalised words or numbers, joined or not, and the form or chain of forms behind them.

    A comma before the form belongs to neither. Articles don't begin a name; a form
    without a name is none; names don't reach over commas, sentence ends or earlier companies.
    """
    out: list[tuple[int, int, str, str]] = []
    chains: list[list[int]] = []
    for start, end in forms_in(text, found):
        if chains and text[chains[-1][1] : start].strip() == "" and start - chains[-1][1] <= 1:
            chains[-1][1] = end
        else:
            chains.append([start, end])
    barred = 0
    for start, end in chains:
        begin = _name_start(text, start, barred)
        if begin is not None:
            out.append((begin, end, text[begin:start].rstrip().rstrip(",").rstrip(), text[start:end]))
            barred = end
    return out


def entities(docs: DataFrame, spellings: list[str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, name, form) of the companies in each text; code points, end exclusive. Null and empty texts have none; repeated rows count each."""
    spellings = gazetteer() if spellings is None else spellings
    sent = docs.sparkSession.sparkContext.broadcast(spellings)

    def run(batches):
        machine = automaton(sent.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = [(i, *e) for i, t in enumerate(part.column(1).to_pylist()) if t for e in entities_of(t, machine.iter(t))]
                columns = list(zip(*rows)) or [(), (), (), (), ()]
                kinds = (pa.int32(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(columns[0], pa.int32())), *(pa.array(c, k) for c, k in zip(columns[1:], kinds))], [key, "start", "end", "name", "form"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, T.StructType([docs.schema[key], *T.StructType.fromDDL("start int, end int, name string, form string").fields]))
