"""Language profiles: n-grams, profiles and distances against plain Python, large alphabets, odd inputs."""

import zlib
from collections import Counter, defaultdict

from sparloom.llm import language

SMALL = "/root/testdata/sf0.001"


def slow_ngrams(text):
    out = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = f" {word} "
        for n in (1, 2, 3):
            out.update(g for i in range(len(padded) - n + 1) if (g := padded[i : i + n]).strip())
    return out


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def slow_profile(counts, size=language.SIZE):
    return {g: i for i, (g, _) in enumerate(sorted(((code(g), n) for g, n in counts.items()), key=lambda x: (-x[1], x[0]))[:size])}


def test_ngrams_of_many_texts():
    texts = ["Ab, c! xyz", "", "123", "Éé ab", "..q", "x", "z z z", "end. ", " İstanbul Σας"]
    text, codes, counts = language.ngrams(texts)
    for i, t in enumerate(texts):
        assert dict(zip(codes[text == i].tolist(), counts[text == i].tolist())) == {code(g): n for g, n in slow_ngrams(t).items()}


def test_large_alphabets():
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    big = " ".join("".join(letters[i : i + 7]) for i in range(0, len(letters), 7))
    text, codes, counts = language.ngrams(["ab c"] * 9000 + [big])
    _, alone, n = language.ngrams([big])
    assert dict(zip(codes[text == 9000].tolist(), counts[text == 9000].tolist())) == dict(zip(alone.tolist(), n.tolist()))
    assert dict(zip(codes[text == 4000].tolist(), counts[text == 4000].tolist())) == {code(g): n for g, n in slow_ngrams("ab c").items()}


def test_query_against_plain_python(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in docs}
    totals = defaultdict(Counter)
    for r in docs:
        if not held[r["doc_id"]] and r["lang"] is not None:
            totals[r["lang"]].update(slow_ngrams(r["text"] or ""))
    known = {x: slow_profile(c) for x, c in sorted(totals.items())}
    got = {r["doc_id"]: r for r in language.op10_language(spark, SMALL).collect()}
    assert set(got) == set(held) and all(got[i]["held_out"] == h for i, h in held.items())
    for r in docs:
        own = slow_profile(slow_ngrams(r["text"] or ""))
        far = {x: sum(abs(p[g] - k) if g in p else language.SIZE for g, k in own.items()) for x, p in known.items()}
        want = min(far, key=lambda x: (far[x], x)) if own else "und"
        assert got[r["doc_id"]]["lang_pred"] == want
        assert abs(got[r["doc_id"]]["score"] - (1 - far[want] / (language.SIZE * len(own)) if own else 0)) < 1e-12


def test_many_languages_take_more_passes(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    known = language.profiles(docs)
    want = {tuple(r) for r in language.identify(docs.select("doc_id", "text"), known).collect()}
    monkeypatch.setattr(language, "LANGUAGES", 1)
    assert {tuple(r) for r in language.identify(docs.select("doc_id", "text"), known).collect()} == want


def test_odd(spark, odd):
    rows = language.identify(odd, language.profiles(odd)).collect()
    assert [r["lang_pred"] for r in rows[:4]] == ["und"] * 4 and rows[4]["lang_pred"] == "en" and rows[0]["batch"] == "x"
    assert language.identify(odd, language.profiles(odd.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert language.identify(odd.limit(0), language.profiles(odd)).count() == 0
