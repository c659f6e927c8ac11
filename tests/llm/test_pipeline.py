"""Each stage of the pipeline against a plain version of its decisions on the same rows, and on odd rows."""

import re
import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from sparloom.llm import packing, secrets, toxicity
from sparloom.llm._common import stage

from tests.llm.test_llm import WORD, low, slow_fingerprint
from tests.llm.test_toxicity import slow_margin

SF = "/root/testdata/sf0.001"


def components(fps):
    """The smallest id that each reaches over links of 3 bits."""
    label, changed = {i: i for i in fps}, True
    while changed:
        now = {i: min(label[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 3) for i in fps}
        changed, label = now != label, now
    return label


def is_contaminated(text, items):
    words = WORD.findall(low(text))
    hit = set()
    for item in items:
        k = min(13, len(item))
        windows = {tuple(item[i : i + k]) for i in range(len(item) - k + 1)} if k else set()
        hit |= {q for p in range(len(words) - k + 1) if tuple(words[p : p + k]) in windows for q in range(p, p + k)} if k else set()
    return bool(hit) and 20 * len(hit) >= len(words)


def masked(text):
    spans = sorted((m.start(), m.end()) for x in secrets.RULES for m in re.finditer(x.regex, text) if len(m.group(x.group)) >= x.least)
    out, at = "", 0
    for a, b in spans:
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [docs]
    for _, f in corpus_pipeline.STAGES:
        rows.append(stage(f(spark, rows[-1], SF)))
        assert rows[-1].columns == docs.columns or len(rows) == 6
    texts = [{r["doc_id"]: r["text"] for r in d.collect()} for d in rows[:5]]
    machine = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(texts[1]) == {i for i, t in texts[0].items() if slow_margin(machine, t or "") < 0}
    label = components({i: slow_fingerprint(t or "") for i, t in texts[1].items()})
    assert set(texts[2]) == {i for i in texts[1] if label[i] == i}
    items = [WORD.findall(low(r["text"] or "")) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(texts[3]) == {i for i, t in texts[2].items() if not is_contaminated(t or "", items)}
    assert texts[4] == {i: t if t is None else masked(t) for i, t in texts[3].items()}
    assert all(r["n_chars"] == len(r["text"]) for r in rows[4].collect())

    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.default_tokenizer())
    ids = {i: tk.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts[4].items()}
    pieces = rows[5].collect()
    assert {p["doc_id"] for p in pieces} == set(ids) and sum(p["length"] for p in pieces) == sum(map(len, ids.values()))
    for p in pieces:
        assert zlib.crc32(np.array(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted((p["doc_id"], p["start"], p["length"], p["ids_crc32"]) for p in pieces)


def test_odd_rows_go_through_all_stages(spark, odd):
    for docs in (odd, odd.limit(0), odd.where("text is null")):
        now = docs
        for name, f in corpus_pipeline.STAGES:
            now = f(spark, now, SF)
            assert now.columns == odd.columns or name == "packing"
            if name != "packing":  # what is carried is as it was
                now = stage(now)
                assert now.where("_score <> 0.9 or items <> 'mine' or secrets <> 'mine' or _row <> 'mine' or fp <> 6").count() == 0
        pieces = {r["doc_id"]: r["n"] for r in now.groupBy("doc_id").agg(F.max("doc_tokens").alias("n")).collect()}
        # 2 and 3 are near copies of 1, all without words; the repeated rows of 5 stay together
        assert set(pieces) == ({1, 4, 5, 7, None} if docs is odd else {1} if docs.count() else set())
