"""Alignments against merges of plain token lists, on given documents and awkward texts."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sparloom.llm import alignment

PATHS = alignment.default_tokenizers()
ODD_TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a  b", "one two  three\n four \n\n five\t six", "x  y", "　 wide", "under▁line here", "<|endoftext|> </s> <unk> <0x41>", "Éa ñ ß 😀 İ\0\1 x", "don't we'll  'S it", "日本語 テキスト", "a\r b;\r c",
    "tail \n", "﻿bom and zero​width", "ﬁ ① é é", "w" * 300 + " " + "é" * 50, "1234567890 3.14159 00", "\x85 nel   line", "._- __init__ (x) {y} ́ mark",
]


def plain_encode(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=PATHS[1])
    letters = alignment._byte_letters()
    out = []
    for t in texts:
        x = a.encode(" " + t, add_special_tokens=False)
        left = [(i, bytes(letters[c] for c in s)) for i, s in zip(x.ids, x.tokens)]
        right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(t)]
        same = t and b"".join(s for _, s in left) == b"".join(s for _, s in right) == (" " + t).encode()
        out.append((left, right) if same else ([], []))
    return out


def spans(tokens):
    at, out = 0, []
    for i, s in tokens:
        out.append((i, at, at + len(s)))
        at += len(s)
    return out


def plain(texts):
    """Per text: groups [(start, end, a ids, b ids)] and links [(end, a, b)]."""
    out = []
    for left, right in plain_encode(texts):
        a, b = spans(left), spans(right)
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = [(lo, hi, [i for i, s, e in a if lo < e <= hi], [i for i, s, e in b if lo < e <= hi]) for lo, hi in zip([0, *cuts], cuts)]
        out.append((groups, [(min(ae, be), i, j) for i, s, ae in a for j, t, be in b if s < be and t < ae]))
    return out


def plain_summary(ids, texts):
    found = plain(texts)
    held = {}
    for _, links in found:
        for p in {(i, j) for _, i, j in links}:
            held[p] = held.get(p, 0) + 1
    top = {}
    for (i, _), n in held.items():
        top[i] = max(top.get(i, 0), n)
    rows = []
    for d, (groups, links) in zip(ids, found):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for *_, x, y in groups)
        rows.append((d, sum(len(g[2]) for g in groups), sum(len(g[3]) for g in groups), len(groups), len(links), sum(held[i, j] == top[i] for _, i, j in links), sum(held[i, j] for _, i, j in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return rows


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
order = lambda rows: sorted(rows, key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("length(text) < 3000").limit(60)
    rows = [tuple(r) for r in given.collect()]
    return rows + [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(1, "repeated row"), (1, "repeated row"), (None, "no id"), (5000, None)]


@pytest.mark.parametrize("batch", [1 << 24, 200])
def test_summaries(spark, docs, monkeypatch, batch):
    monkeypatch.setattr(alignment, "BATCH_BYTES", batch)
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, batch int, codes string").repartition(3)
    got = [tuple(r) for r in alignment.summaries(table, *PATHS).select(*COLUMNS).collect()]
    assert order(got) == order(plain_summary([d for d, _ in docs], [t or "" for _, t in docs]))


def test_groups_and_links(spark, docs):
    some = docs[-40:]
    groups, links = alignment.align(spark.createDataFrame(some, "doc_id long, text string"), *PATHS)
    want = plain([t or "" for _, t in some])
    assert order((r.doc_id, r.group, r.start, r.end, r.a_ids, r.b_ids) for r in groups.collect()) == order((d, n, *g) for (d, _), (gs, _) in zip(some, want) for n, g in enumerate(gs))
    assert order(tuple(r) for r in links.collect()) == order((d, *x) for (d, _), (_, ls) in zip(some, want) for x in ls)


def test_empty_table_and_tables_without_tokens(spark, tmp_path):
    for name, rows in (("none", []), ("null", [(1, None), (2, "")])):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert sorted(tuple(r) for r in alignment.op12_alignment(spark, f"{tmp_path}/{name}").select(*COLUMNS).collect()) == [(d, 0, 0, 0, 0, 0, 0, "") for d, _ in rows]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab'1.é_ \n\t ▁\r　́日")), max_size=25))
def test_words_are_encoded_as_within_their_text(text):
    coder = alignment.pair(*PATHS)
    found = alignment.words(text)
    assert "".join(" " + w for w in found) == (" " + text if text else "")
    if text:
        whole, parts = coder.encode([text])[0], coder.encode(found)
        assert (whole is None) == any(p is None for p in parts)
        if whole is not None:
            assert all([i for p in parts for i in p[k]] == whole[k] for k in range(4))
