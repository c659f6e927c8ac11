"""The trie against one built turn by turn, on conversations with nulls, gaps, ties, copies and long runs."""

import hashlib
import random
import re
import zlib

import pytest
from sparloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, conv long, words int"


def plain(rows, family=20, heads=4):
    by = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    by = {c: [t[2:] for t in sorted(x)] for c, x in by.items()}
    nodes = {}
    for c in by:
        source = c - (abs(c) % family) * (1 if c >= 0 else -1)
        h = 0 if source == c else zlib.crc32(str(c).encode()) % heads
        turns = by.get(source, [])[:h] + by[c][h:]
        for d in range(len(turns) + 1):
            node = nodes.setdefault(tuple(turns[:d]), {"members": [], "ends": []})
            node["members"].append(c)
            if d == len(turns):
                node["ends"].append(c)
    out = []
    for path, node in nodes.items():
        subtree = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in nodes if len(p) == len(path) + 1 and p[: len(path)] == path]
        inner = {p[:-1] for p in nodes if p}
        saved = sum((len(nodes[p]["members"]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0) for p in subtree)
        digest = hashlib.sha256(",".join(map(str, sorted(node["ends"]))).encode()).hexdigest()
        out.append((min(node["members"]), len(path), min(nodes[path[:-1]]["members"]) if path else None, len(node["members"]), len(children), sum(p not in inner for p in subtree), saved, digest))
    return sorted(out)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def run(spark, tmp_path, rows, name="x"):
    spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/{name}/conversations.parquet")
    return sorted(tuple(r) for r in prefix_trie.op11_prefix_trie(spark, f"{tmp_path}/{name}").select(*COLUMNS).collect())


@pytest.mark.parametrize("bits", [1, 10])
def test_trie_equals_one_built_turn_by_turn(spark, tmp_path, monkeypatch, bits):
    """Blocks of two turns and ids exercise what long conversations and hot nodes do."""
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", bits)
    monkeypatch.setattr(prefix_trie, "IDS_BITS", bits)
    dice = random.Random(3)
    rows = []
    for c in [-21, -3, *range(0, 66)]:
        if c == 40:
            continue  # conversations 41 to 59 have no source
        for t in range(dice.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, t, dice.choice(["user", "assistant"]), dice.choice(["a b", "a  b", "c", "", "d\te f"])))
    rows += [(20, t, "user", f"turn {t % 3}") for t in range(10, 80)]
    rows += [(7, None, None, None), (7, 3, "user", None), (8, 2, "user", "tie two"), (8, 2, "user", "tie one"), (8, 2, "bot", "tie three"), (9, 5, "u", "same"), (9, 5, "u", "same"), (None, 1, "user", "nobody")]
    rows += [(c, t, "user", "copied") for c in range(1000, 1040) for t in range(6)]
    got = run(spark, tmp_path, rows)
    assert got == plain(rows)


def test_conversations_can_lose_all_turns_and_table_can_be_empty(spark, tmp_path):
    lone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    assert run(spark, tmp_path, [(lone, 0, "user", "gone"), (lone, 1, "user", "gone too")]) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    assert run(spark, tmp_path, [], "none") == []


def test_role_and_text_are_told_apart(spark, tmp_path):
    rows = [(0, 0, "ab", "c"), (20, 0, "a", "bc"), (40, 0, "", "abc"), (60, 0, "1:a", "b"), (80, 0, "ab", "c")]
    got = run(spark, tmp_path, rows)
    assert [r[3] for r in got if r[1] == 1] == [2, 1, 1, 1] and got == plain(rows)
