"""Sentences, subsequences, repaired JSON and company names against plain versions."""

import difflib
import json
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sparloom.functions import codecs, lcs
from sparloom.operators import entities, sentences
from sparloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def corpus():
    dice = random.Random(2)
    names, nouns = ["Smith", "Jones", "Keller", "Blum"], ["list", "house", "garden", "river", "field", "road", "town", "bridge", "paper", "stone", "wall", "roof", "tree", "boat"]
    noun = lambda: dice.choice(nouns)
    rows = []
    for i in range(400):
        rows.append((i, f"Yesterday dr. {dice.choice(names)} saw no. {i} of the {noun()} near a {noun()}. However the {noun()} was {dice.choice(['late', 'old'])}! Was it a {noun()}? They met at approx. {i % 9} p.m. and left the {noun()}. \"However a {noun()}.\" said J. {dice.choice(names)} by the {noun()}. It had a {noun()}... and a {noun()}."))
    return rows + [(1000, None), (1001, "")]


def plain_model(texts):
    """The same counts and ratios in plain Python."""
    found = []
    for t in texts:
        cores = [c for c in (re.sub(r"^[\W_]+|[^\w.?!]+$", "", w) for w in (t or "").split()) if c]
        word = lambda c: "#" if re.match(r"^\d[\d.,]*$", c) else re.sub(r"[.?!]+$", "", c).lower()
        found += [(word(c), c.endswith("."), bool(re.search("[?!]$", c)), word(cores[i + 1]) if i + 1 < len(cores) else None) for i, c in enumerate(cores)]
    found = [f for f in found if f[0]]
    total, dots = len(found), sum(f[1] for f in found)
    count, dotted = {}, {}
    for w, d, *_ in found:
        count[w] = count.get(w, 0) + 1
        dotted[w] = dotted.get(w, 0) + d
    xlog = lambda n, p: n * math.log(max(p, 1e-300)) if n > 0 else 0.0
    short = set()
    for w, k in dotted.items():
        rest, letters = count[w] - k, len(w.replace(".", ""))
        if k and w != "#" and letters:
            p = dots / total
            ratio = -2 * (xlog(k, p) + xlog(rest, 1 - p) - xlog(k, 0.99) - xlog(rest, 0.01))
            if ratio * math.exp(-letters) * (len(w) - letters + 1) / letters**rest >= 0.3:
                short.add(w)
    return short


def test_model_and_boundaries(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    model = sentences.model_of(sentences.train(docs))
    assert model.abbreviations == plain_model([t for _, t in corpus()])
    assert {"dr", "no", "p.m"} <= model.abbreviations and "list" not in model.abbreviations
    assert "however" in model.starters
    text = "Yesterday dr. Smith saw no. 4 of the list. However it was late! \"Was it?\" He left at 3 p.m. However J. Blum stayed. It went on... and on. No. 5 left"
    cuts = [0, *sentences.boundaries(text, model), len(text)]
    assert [text[a:b].strip() for a, b in zip(cuts, cuts[1:])] == ["Yesterday dr. Smith saw no. 4 of the list.", "However it was late!", '"Was it?"', "He left at 3 p.m.", "However J. Blum stayed.", "It went on... and on.", "No. 5 left"]
    found = sentences.sentences(docs, model).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r.doc_id, r.pos)):
        by.setdefault(r.doc_id, []).append(r)
    for d, t in corpus():
        assert "".join(r.text for r in by.get(d, [])) == (t or "") and all(t[r.start : r.end] == r.text for r in by.get(d, []))
    assert sentences.train(docs.limit(0)).count() == 0 and sentences.model_of(sentences.train(docs.where("text is null"))) == sentences.Model()


def test_model_size_is_checked(spark, monkeypatch):
    monkeypatch.setattr(sentences, "MOST", 1)
    rows = spark.createDataFrame([("starter", "a", None), ("starter", "b", None)], "kind string, word string, after string")
    with pytest.raises(ValueError, match="over 1 entries"):
        sentences.model_of(rows)


def table_of(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=30), st.lists(st.sampled_from("abcdf"), max_size=30), st.sampled_from([1 << 28, 4]))
def test_longest_common_subsequence(a, b, kept):
    before, lcs.KEPT_BITS = lcs.KEPT_BITS, kept  # few bits: halves first
    try:
        found = lcs.matches(a, b)
    finally:
        lcs.KEPT_BITS = before
    assert len(found) == lcs.length(a, b) == table_of(a, b)
    assert all(a[i] == b[j] for i, j in found) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 40), st.floats(0, 0.5))
def test_diffs_of_edited_lines_are_the_usual_ones(seed, n, share):
    dice = random.Random(seed)
    a = [f"line {i}" for i in range(n)]
    b = []
    for x in a:
        if dice.random() < share:
            b += [f"new {dice.random()}" for _ in range(dice.randrange(3))]
            if dice.random() < 0.7:
                continue
        b.append(x)
    assert lcs.unified(a, b) == "\n".join(difflib.unified_diff(a, b, "before", "after", lineterm=""))


def test_columns_of_subsequences(spark):
    rows = [("the cat sat on the mat", "The cat, lay on a mat."), (None, "x"), ("", ""), ("a b", "b a"), ("z" * 5, None)]
    got = spark.createDataFrame(rows, "p string, g string").select("p", "g", lcs.rouge_l("p", "g").alias("s")).collect()
    for r in got:
        a, b = lcs.words(r.p), lcs.words(r.g)
        n = table_of(a, b)
        assert tuple(r.s) == (n / len(a) if a else 0, n / len(b) if b else 0, 2 * n / (len(a) + len(b)) if a and b else 0)
    nested = spark.createDataFrame([('{"b": {"y": [1, 2]}, "a": 1}', '{"a": 1, "b": {"y": [1, 3]}}'), ("not json", None)], "x string, y string").select(lcs.unified_diff("x", "y").alias("d")).collect()
    assert nested[0].d.splitlines()[-8:] == ['   "b": {', '     "y": [', "       1,", "-      2", "+      3", "     ]", "   }", " }"] and nested[1].d == "--- before\n+++ after\n@@ -1 +0,0 @@\n-not json"


BAD = '{"memo": "Across all 5 contracts the clause states "shall remain in full force" after termination.", "score": 4, "more": true}'
ANSWERS = [
    ('{"a": 1}', {"a": 1}), ("```json\n{\"a\": [1, 2]}\n```", {"a": [1, 2]}), ("Sure: {\"a\": {\"b\": \"}\"}} done", {"a": {"b": "}"}}), (BAD, "memo score more"), (f"```json\n{BAD}\n```", "memo score more"), (f"Text {BAD} text", "memo score more"),
    ('{"items": ["A", "B"], "share": 0.85', {"items": ["A", "B"], "share": 0.85}), ('{"items": ["A", "B is cu', {"items": ["A", "B is cu"]}), (r'{"s": "He said \"hi\" and', {"s": 'He said "hi" and'}), ('{"items": [{"a": 1', {"items": [{"a": 1}]}),
    ("This is no JSON.", None), ("", None), (None, None), ("[1, 2]", None), ('{"a": tru', None), ('{"a": "x\\', None), ('prefix {"a": "b" c"} suffix', {"a": 'b" c'}),
]


def test_objects_in_answers(spark):
    got = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(ANSWERS)], "i int, a string").select("i", codecs.extract_json(F.col("a")).alias("j")).collect()
    for r in got:
        want = ANSWERS[r.i][1]
        read = None if r.j is None else json.loads(r.j)
        assert (read == want) if not isinstance(want, str) else (set(read) == set(want.split()) and read["more"] is True and '"shall remain in full force"' in read["memo"]), (r, want)


NAMES = [
    ("I worked at Acme Corp. from 2010.", [("Acme", "Corp.")]), ("Beta LLC is a party.", [("Beta", "LLC")]), ("Siemens GmbH ist hier", [("Siemens", "GmbH")]), ("International Business Machines Corp. was founded", [("International Business Machines", "Corp.")]),
    ("Microsoft Corporation is American.", [("Microsoft", "Corporation")]), ("Sony K.K. makes things.", [("Sony", "K.K.")]), ("Acme Inc. and Beta LLC are the parties.", [("Acme", "Inc."), ("Beta", "LLC")]), ("Acme Inc., Beta LLC, Gamma Corp. are", [("Acme", "Inc."), ("Beta", "LLC"), ("Gamma", "Corp.")]),
    ("Mahindra Pvt. Ltd. and Foo Holdings Ltd. won", [("Foo", "Holdings Ltd.")]), ("Johnson & Johnson Inc. is big.", [("Johnson & Johnson", "Inc.")]), ("MGM HOLDINGS INC. ANNOUNCED", [("MGM", "HOLDINGS INC.")]), ("The Corporation was formed.", []), ("via eBay Inc. was big", []),
    ("Inc. was the suffix.", []), ("", []), ("nothing here", []), ("by DRAGON SYSTEMS, INC. today", [("DRAGON SYSTEMS", "INC.")]), ("The Bank of Ulm AG, it", [("Bank of Ulm", "AG")]), ("3M Co. sells", [("3M", "Co.")]), ("It ended. Kappa Oy began (Tau AB)", [("Kappa", "Oy"), ("Tau", "AB")]), ("AcmeInc. or Acme Incx", []),
]


def test_company_names(spark):
    rows = entities.entities(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NAMES)] + [(99, None)], "doc_id long, text string")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        got.setdefault(r.doc_id, []).append((r.name, r.form))
        text = NAMES[r.doc_id][0]
        assert text[r.start : r.end].startswith(r.name) and text[r.start : r.end].endswith(r.form)
    for i, (t, want) in enumerate(NAMES):
        assert got.get(i, []) == want, t


def test_company_names_of_all_texts(spark):
    """Every spelling searched at every place, for each text of the query."""
    spellings = entities.gazetteer()
    assert len(spellings) > 108 and {"Inc", "INC.", "S.A.R.L.", "ApS", "z.o.o.", "Holdings"} <= set(spellings)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = []
    for r in docs:
        text = (r.text or "") + f"\nBetween {r.source.capitalize()} & Sons Holdings Ltd., The {r.lang.upper()} Print Shop, Inc. and Kappa GmbH of old."
        found = [(m.end() - 1, len(s)) for s in spellings for m in re.finditer(f"(?={re.escape(s)})", text) for m in [re.compile(re.escape(s)).match(text, m.start())]]
        want += [(r.doc_id, *e) for e in entities.entities_of(text, found)]
    assert sorted(tuple(r) for r in QUERIES["company_names"](spark, SF).collect()) == sorted(want) and len(want) >= 3 * len(docs)


STEMS = (
    "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky "
    "relational relat conditional condit rational ration digitizer digit vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous triplicate triplic formative form formalize formal electrical electr "
    "hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ "
    "homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controlling control roll roll is is"
).split()


def test_stems_are_the_published_ones(spark):
    from sparloom.functions.stems import stem

    assert {w: stem(w) for w in STEMS[::2]} == dict(zip(STEMS[::2], STEMS[1::2]))
    rows = [("The cats were hopping", "a cat hopped, the cats hop"), (None, "x"), ("one", "one"), ("", "")]
    got = spark.createDataFrame(rows, "p string, g string").select(lcs.rouge_n("p", "g").alias("a"), lcs.rouge_n("p", "g", 2).alias("b"), lcs.rouge_l("p", "g", True).alias("c")).collect()
    # the cat were hop | a cat hop the cat hop: the, cat, hop; "the cat"; the cat hop
    assert tuple(got[0].a) == (3 / 4, 3 / 6, 6 / 10) and tuple(got[0].b) == (1 / 3, 1 / 5, 2 / 8) and tuple(got[0].c) == (3 / 4, 3 / 6, 6 / 10)
    assert [tuple(r.a) for r in got[1:]] == [(0, 0, 0), (1, 1, 1), (0, 0, 0)] and tuple(got[2].b) == (0, 0, 0)
