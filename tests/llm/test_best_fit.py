"""Plans against a walk over all pieces; the query against the tokenizer itself."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sparloom.llm import best_fit
from sparloom.llm.best_fit import Capacities, plan, scores


def walk(lengths, limits):
    """Sequences, each with its pieces in order: one piece after another."""
    bins, room = [], []
    for n in sorted(lengths, reverse=True):
        item = np.array([n, 1, n * n])
        found = scores(np.array(room).reshape(-1, 3), item, limits)
        at = int(np.argmin(found)) if len(found) and np.isfinite(found).any() else len(bins)
        if at == len(bins):
            bins.append([])
            room.append(limits.vector.copy())
        bins[at].append(n)
        room[at] = room[at] - item
    return bins


def unfolded(rows, n):
    bins = [{} for _ in range(n)]
    for size, _, pieces, first, each, offset in rows.tolist():
        for i in range(pieces):
            assert offset + i % each * size not in bins[first + i // each]
            bins[first + i // each][offset + i % each * size] = size
    out = []
    for b in bins:
        at = 0
        for offset in sorted(b):
            assert offset == at
            at += b[offset]
        out.append([b[o] for o in sorted(b)])
    return out


LIMITS = [Capacities(20, 20, 400), Capacities(20, 3, 400), Capacities(20, 20, 150, (1.0, 1.0, 1.0)), Capacities(20, 4, 210, score="dot"), Capacities(20, 20, 400, (1.0, 0.0, 2.0), "dot")]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.sampled_from(LIMITS))
def test_plan_is_the_walk_over_all_pieces(lengths, limits):
    lengths = [min(n, limits.longest) for n in lengths]
    sizes, counts = np.unique(np.array(lengths, np.int64), return_counts=True)
    rows, n = plan(sizes, counts, limits)
    got = unfolded(rows, n)
    assert sorted(got) == sorted(walk(lengths, limits))
    for b in got:
        assert sum(b) <= limits.tokens and len(b) <= limits.documents and sum(x * x for x in b) <= limits.attention
    for size in set(lengths):  # numbers have no gaps
        own = sorted((lo, lo + k) for s, lo, k, *_ in rows.tolist() if s == size)
        assert [a for a, _ in own] == [0, *[b for _, b in own]][: len(own)] and own[-1][1] == lengths.count(size)


def test_plan_does_not_grow_with_the_documents():
    sizes = np.arange(1, 2049)
    counts = np.random.default_rng(1).integers(1, 1000, 2048)
    few, _ = plan(sizes, counts, Capacities())
    many, n = plan(sizes, counts * 1_000_000_007, Capacities())
    assert len(many) < 4 * len(few) and len(many) < 20_000
    assert n <= 1.02 * (sizes * counts * 1_000_000_007).sum() / 2048


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(best_fit.default_tokenizer())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def check(rows, docs, limits=Capacities()):
    """Each id in one piece, gapless sequences within all capacities, pieces as the contract cuts them."""
    want = sorted((repr(d), ids) for d, ids in zip([d for d, _ in docs], plain_ids([t for _, t in docs])))
    pieces = sorted((d, i, min(limits.longest, len(ids) - i), zlib.crc32(np.array(ids[i : i + limits.longest], "<u4").tobytes())) for d, ids in want for i in range(0, len(ids), limits.longest))
    assert sorted((repr(r[0]), r.start, r.length, r.ids_crc32) for r in rows) == pieces
    assert all(r.start == r.piece * limits.longest for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in by.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= limits.tokens and len(found) <= limits.documents and sum(n * n for _, n in found) <= limits.attention
    return len(by)


def test_query_on_given_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    n = check(best_fit.op13_best_fit(spark, "/root/testdata/sf0.001").collect(), docs)
    lengths = [min(2048, len(i) - s) for i in plain_ids([t for _, t in docs]) for s in range(0, len(i), 2048)]
    assert n == len(walk(lengths, Capacities()))


@pytest.mark.parametrize("limits", [Capacities(64, 5, 2500), Capacities(64, 64, 4096, score="dot")])
def test_binding_capacities_odd_rows_and_real_ids(spark, odd, limits):
    dice = random.Random(5)
    more = [(100 + i, " ".join(dice.choice(["alpha", "beta", "<|endoftext|>", "x1"]) for _ in range(dice.randrange(90)))) for i in range(150)]
    docs = [*[(r.doc_id, r.text) for r in odd.collect()], *more]
    table = odd.select("doc_id", "text", "score", "_n").unionByName(spark.createDataFrame([(*d, 0.5, 1) for d in more], "doc_id long, text string, score double, _n int"))
    rows = best_fit.best_fit(table.repartition(5), best_fit.default_tokenizer(), limits, with_ids=True).collect()
    check(rows, docs, limits)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)


def test_empty_table_clashing_id_name_and_wrong_limits(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert best_fit.best_fit(empty, best_fit.default_tokenizer()).count() == 0
    odd = spark.createDataFrame([(3, "a b c"), (4, None)], "tokens long, text string")
    assert sorted(r.tokens for r in best_fit.best_fit(odd, best_fit.default_tokenizer(), id_col="tokens").collect()) == [3, 4]
    for wrong in ({"tokens": 0}, {"score": "first"}, {"weights": (0.0, 1.0, 1.0)}):
        with pytest.raises(ValueError):
            Capacities(**wrong)
