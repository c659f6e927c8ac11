"""The ten operators against brute force, planted cases and odd inputs."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from sparloom.llm import decontaminate, html, mpeg, packing, passages, registry, secrets, simhash, tokens
from sparloom.llm.components import connected_components
from sparloom.llm.words import Words

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "conversations"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda d: sorted(map(tuple, d[columns].convert_dtypes().astype(str).values.tolist()))  # noqa: E731  numbers with nulls are floats on one side
    assert key(got) == key(want)


def test_words_have_equal_hashes_wherever_they_stand():
    a, b = Words([b"Alpha beta", b"", b"x" * 9000 + b" beta"]), Words([b"beta,alpha"])
    assert a.hashes[1] == a.hashes[3] == b.hashes[0] and a.hashes[0] == b.hashes[1]
    assert a.counts.tolist() == [2, 0, 2] and a.word(1) == b"beta"


def test_decontamination_blocks_and_spans(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontaminate.find_contamination(docs, bench).collect()}
    many = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontaminate.find_contamination(docs, bench, block_bytes=60_000).collect()}
    assert one == many and any(n for n, _ in one.values())
    item = "Aa bb cc, dd ee ff gg hh ii jj kk ll mm"
    rows = spark.createDataFrame([(1, f"é before {item.upper()} after"), (2, "aa bb"), (3, "tiny item")], "doc_id long, text string")
    tests = spark.createDataFrame([(9, item), (8, "Tiny item"), (7, None), (6, "--"), (None, "tiny")], "item_id long, text string")
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(rows, tests, remove="spans").collect()}
    assert cut == {1: "é before  after", 2: "aa bb", 3: ""}
    assert [r["doc_id"] for r in decontaminate.decontaminate(rows, tests).collect()] == [2]
    found = decontaminate.find_contamination(odd, tests.limit(0))
    assert found.count() == 8 and found.agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.find_contamination(odd.limit(0), tests).count() == 0


def test_mpeg_round_trip_and_resync(spark, odd):
    for n in (64, 1344, 1402, 1408, 64 * 5000):
        payload = bytes(random.Random(n).randrange(256) for _ in range(n))
        data = mpeg.encode(payload)
        s = mpeg.parse(data)
        assert mpeg.decode(data, s) == payload and s.skipped == 0 and s.vbr == "Xing" and s.vbr_frames == len(s.headers)
        assert mpeg.verify([(data, s)]) == [(len(s.headers), 0)]
    s = mpeg.parse(b"junk\xff\xfb" + data[: len(data) // 2] + b"\xff\xff\0" + data[len(data) // 2 :] + b"TAG" + b"a title".ljust(125, b"\0"))
    assert s.skipped > 0 and s.tags["title"] == "a title" and len(s.headers) >= 200
    flipped = bytearray(data)
    flipped[mpeg.parse(data).offsets[3] + 10] ^= 1
    assert mpeg.verify([(bytes(flipped), mpeg.parse(bytes(flipped)))])[0][1] == 1
    rows = mpeg._digest(mpeg.to_media(odd)).collect()
    for r, o in zip(rows, odd.collect()):
        raw = (o["text"] or "").encode()
        raw += bytes(-len(raw) % 64 if raw else 64)
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
    none = spark.createDataFrame([(None,), (b"no audio",), (b"",)], "media binary")
    assert [r["frames"] for r in mpeg.media_features(none).collect()] == [0, 0, 0]


def test_media_query_against_plain_arithmetic(spark):
    """Every document of sf0.001: digests of the zero-filled text, and what the format's own formulas say of frames, samples and sizes."""
    rates = [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]  # kbit/s; a frame of 1152 samples at 32 kHz has 144 * rate / 32 bytes, 38 of them header, checksum and side information
    sizes = [144 * r * 1000 // 32000 for r in rates]
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = mpeg.op2_mpeg_audio(spark, SMALL).collect()
    assert {r["doc_id"] for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        raw = docs[r["doc_id"]]
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        full, rest = divmod(len(payload), sizes[-1] - 38)
        frames = full + (rest > 0)
        last = next((s for s in sizes if s - 38 >= rest), 0) if rest else 0
        head = 10 + 10 + len("\0payload_bytes\0") + len(str(len(payload)))
        table = next(s for s in sizes if s - 38 >= 4 + 4 + 4 + 4 + 100)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_bytes"] == head + table + full * sizes[-1] + last + 32 + 128
        offsets = [head + table + i * sizes[-1] for i in range(frames)]
        assert r["feature"] == f"mpeg1-l3;32000Hz;ch=2;frames={frames};samples={1152 * frames};vbr=Xing:{frames};crc={frames}/0;skipped=0;seek={hashlib.sha256(','.join(map(str, offsets)).encode()).hexdigest()[:16]}"


def test_media_of_odd_tables(spark, odd):
    got = mpeg._digest(mpeg.to_media(odd))
    assert got.count() == 8 and got.where("score <> 0.1").count() == 0 and mpeg._digest(mpeg.to_media(odd.limit(0))).count() == 0
    assert mpeg.media_features(mpeg.to_media(odd)).where("batch = 'x' or batch is null").count() == 8


def test_clashing_columns_keep_their_values(spark, odd):
    tests = spark.createDataFrame([(1, "some thirteen words that no document has at all in it, one two three")], "item_id long, text string")
    kept = decontaminate.decontaminate(odd, tests)
    assert kept.columns == odd.columns and kept.where("items = 'mine' and n_words = 5").count() == 8
    assert secrets.redact(odd).columns == odd.columns and secrets.redact(odd).where("secrets = 'mine' and _row = 'mine'").count() == 8


def test_media_of_payloads_that_look_like_tags():
    for mark in (b"TAG", b"APETAGEX", b"SONNTAG"):
        for n in (0, 64, 300, 1100, 2500):
            for back in range(len(mark), min(n, 300) + 1):
                payload = bytearray(b"x" * n)
                payload[n - back : n - back + len(mark)] = mark
                data = mpeg.encode(bytes(payload))
                s = mpeg.parse(data)
                assert mpeg.decode(data, s) == bytes(payload) and s.skipped == 0


def _bitwise(bits):
    crc = 0xFFFF
    for b in bits:
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if (crc >> 15) ^ b else 0)
    return crc


def test_checksums_of_layers_1_and_2():
    # header, bits that the checksum covers after it: layer I stereo, joint (bound 8), mono; layer II at 32 kbit/s mono and 192 stereo
    for head, n in (("fffe8000", 256), ("fffe8050", 160), ("fffe80c0", 128), ("fffc10c0", 26 + 16), ("fffca000", 2 * (88 + 60))):
        h = mpeg.header(bytes.fromhex(head))
        body = bytearray(h.size - 6)
        if h.layer == 2:
            full = n if h.mono else 2 * 88
            body[: full // 8 + 1] = b"\xff" * (full // 8 + 1)
        frame = bytes.fromhex(head) + b"\0\0" + bytes(body)
        n = mpeg._covered_bits(frame, h) if not h.mono or h.layer == 1 else n
        bits = [x >> 7 - k & 1 for x in frame[2:4] + frame[6:] for k in range(8)][: 16 + n]
        frame = frame[:4] + _bitwise(bits).to_bytes(2) + frame[6:]
        bad = frame[:6] + bytes([frame[6] ^ 0x80]) + frame[7:]
        data = frame + bad + frame
        assert mpeg.verify([(data, mpeg.parse(data))]) == [(2, 1)]


def test_free_format_and_vbri():
    frame = bytes.fromhex("fffb0000") + bytes(696)
    s = mpeg.parse(frame * 5)
    assert [h.size for h in s.headers] == [700] * 5 and s.offsets == [0, 700, 1400, 2100, 2800] and s.skipped == 0
    head = bytes.fromhex("fffb9000")
    h = mpeg.header(head)
    table = b"VBRI" + bytes(6) + (4000).to_bytes(4) + (8).to_bytes(4) + b"".join(x.to_bytes(2) for x in (4, 10, 2, 2, 100, 100, 100, 100))
    s = mpeg.parse((head + bytes(32) + table).ljust(h.size, b"\0") + (head + bytes(h.size - 4)) * 8)
    assert s.vbr == "VBRI" and list(s.toc) == [i * 256 // 100 for i in range(100)]


def test_passages(spark, odd):
    rng = random.Random(3)
    text = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    shared, rows = text(60), []
    for i in range(40):
        words = text(150)
        if i in (3, 17, 31):
            part = list(shared)
            if i == 31:
                part[20], part[45] = "changed", "altered"
            words[50:50] = part
        rows.append((i, " ".join(words)))
    rows += [(100, rows[5][1]), (101, rows[5][1]), (102, " ".join(shared[:30]))]
    found = passages.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["partner_id"]) for r in found} == {(17, 3), (31, 3), (100, 5), (101, 5)}
    exact = next(r for r in found if r["doc_id"] == 17)
    assert exact["end"] - exact["start"] >= 60 and exact["share"] == 1.0
    assert passages.find_passages(odd).count() == 0 and passages.find_passages(odd.limit(0)).count() == 0


def test_passages_of_lines_from_smaller_documents(spark):
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    for holders in (1, 12):  # seeds that are linked each to each, and hot ones
        lines, rows = [text(30), text(30)], []
        for i in range(2 * holders):
            rows.append((i, text(40) + lines[i % 2] + text(40)))
        rows[0] = (0, lines[0] + rows[0][1])
        rows += [(100 + i, text(40) + lines[0] + lines[1] + text(40)) for i in range(2 * holders)]
        found = passages.find_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")).collect()
        whole = {(r["doc_id"], r["partner_id"]) for r in found if r["end"] - r["start"] >= 60 and r["share"] == 1}
        assert whole == {(100 + i, 100) for i in range(1, 2 * holders)}


def test_every_passage_of_equal_words_is_found(spark):
    rng = random.Random(6)
    rows = [[f"w{rng.randrange(12)}" if i % 3 == 0 else f"v{rng.randrange(5000)}" for _ in range(200)] for i in range(60)]
    for i in range(20, 60):
        n, j = rng.randrange(50, 56), rng.randrange(20)
        at, to = rng.randrange(len(rows[j]) - n), rng.randrange(140)
        rows[i][to : to + n] = rows[j][at : at + n]
    grams, brute = {}, set()
    for i, t in enumerate(rows):
        for p in range(len(t) - 49):
            g = tuple(t[p : p + 50])
            if g in grams and grams[g] != i:
                brute |= {(i, q) for q in range(p, p + 50)}
            grams.setdefault(g, i)
    found = passages.find_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")).collect()
    assert brute and brute <= {(r["doc_id"], q) for r in found for q in range(r["start"], r["end"])}


def test_passage_with_one_seed(spark):
    rows = []
    for n in range(40):
        t = [f"a{n}x{i}" for i in range(80)]
        rows += [(n, " ".join(t)), (100 + n, " ".join(w if i % 6 != (0 if i <= 30 else 2) or 31 <= i < 50 else f"b{n}x{i}" for i, w in enumerate(t)))]  # 19 equal words, else each sixth differs
    found = passages.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["partner_id"]) for r in found if r["end"] - r["start"] >= 70} == {(100 + n, n) for n in range(40)}


def test_chains_match_the_quadratic_recurrence():
    rng = random.Random(1)
    for _ in range(50):
        pts = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(25)}, key=lambda p: (p[1], -p[0]))
        best = []
        for i, (x, y) in enumerate(pts):
            best.append(passages.GAIN + max([0.0] + [best[j] - passages.GAP * (x - a + y - b) for j, (a, b) in enumerate(pts[:i]) if a < x and b < y]))
        chains = passages.chain([p[0] for p in pts], [p[1] for p in pts], 1)
        top = chains[0]
        score = passages.GAIN * len(top) - passages.GAP * sum(pts[b][0] - pts[a][0] + pts[b][1] - pts[a][1] for a, b in zip(top, top[1:]))
        assert math.isclose(score, max(best)) and sorted(i for c in chains for i in c) == list(range(len(pts)))


def slow_fingerprint(t):
    w = re.findall("[^\x20\x09-\x0d]+", low(t))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("bucket", [4096, 32])
def test_simhash(spark, bucket):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    rng, seen = random.Random(5), list(rows)
    for k in range(60):  # a group of near copies of a long text
        words = max((r["text"] for r in rows), key=len).split()
        words[rng.randrange(len(words))] = f"edit{k}"
        seen.append((10_000 + k, " ".join(words)))
    seen += [(20_000, None), (20_001, ""), (20_002, " \t")]
    fps = {r[0]: slow_fingerprint(r[1] or "") for r in seen}
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            least = min(label[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 3)
            changed |= least < label[i]
            label[i] = min(label[i], least)
    got = simhash.near_duplicates(spark.createDataFrame(seen, "doc_id long, text string"), bucket=bucket).collect()
    assert {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in got} == fps
    assert {r["doc_id"]: r["component_id"] for r in got} == label


def test_covering_masks_miss_no_pair():
    masks = simhash.covering_masks(3)
    rng = random.Random(2)
    for _ in range(2000):
        d = sum(1 << b for b in rng.sample(range(64), 3))
        hit = [m for m in masks if not d & m]
        assert hit
        for groups in (4, 8):
            assert all(any(not d & f for f in simhash.dividing_masks(m, 3, groups)) for m in hit)
    assert len(simhash.dividing_masks(masks[0], 3, 4)) == 4 and max(64 - m.bit_count() for m in simhash.dividing_masks(masks[0], 3, 8)) <= 12


def test_simhash_odd(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 8 and {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 5, 7]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(50)] + [(100, 101), (101, 102), (5, 5)], "a long, b long")
    got = {r["node"]: r["label"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100, 102: 100}


def test_html():
    page = "<title>T &amp; t</title><ul><li>one<li>two<ol><li>a<li>b</ol></ul><table><tr><th>name<th>n<tr><td>long name<td>1</table><p>x<p>y<div hidden>no</div><script>no</script><span style='display:none'>no</span><pre>a\n  b</pre>q<br>r"
    assert html.extract(page) == ("T & t", "- one\n- two\n  1. a\n  2. b\n\nname      | n\nlong name | 1\n\nx\n\ny\n\na\n  b\n\nq\nr")
    for bad in ("", "<", "<p", "</p>", "<table><td>x", "<" * 500, "<div>" * 2000 + "deep", "<!-- open", "&#x110000;&bogus;"):
        html.extract(bad)


def test_html_keeps_all_visible_text():
    text = lambda page: html.extract(page)[1].split()
    assert text("<table>Loose<tr><td>x</td></tr></table>") == ["Loose", "x"]
    assert text("<table><div>Text</div><tr><td>a<td>b</table>") == ["Text", "a", "|", "b"]
    assert text("<table><tr>row<form><td>x</td></form></tr><form><td>y</td></form></table>") == ["row", "x", "y"]
    assert text("<table><tr><td>a <table>in<tr><td>b</table>c</table>d") == ["a", "in", "b", "c", "d"]
    assert html.extract("<html><head><title>T</title><p>Hello") == ("T", "Hello")
    assert html.extract("<head><title>T</title>Hello<head><p>you") == ("T", "Hello\n\nyou")
    assert html.extract("<head><meta charset=utf-8>\n<style>x</style></head><body>b</body>") == ("", "b")
    assert text("<svg><title>no</title><defs><text>no</text></defs><path/><text>drawn</text></svg> <math><mi>x</mi></math> <i aria-hidden='true'>seen</i>") == ["drawn", "x", "seen"]
    for n in (399, 5000):
        assert text("<font>" * n + "<template>no</template><b>yes</b><div hidden>no</div>" + "<div>" * n + "end") == ["yes", "end"]
        assert text("<table><tr><td>" * n + "x") == ["x"]


def test_html_pages(spark):
    pages = spark.createDataFrame([(1, None, "a", "b"), (2, "", "a", "b"), (3, "<b>hi</b>", "a", "b")], "page_id long, html string, title string, extra string")
    assert [(r["page_id"], r["title"], r["text"]) for r in html.extract_text(pages).collect()] == [(1, None, None), (2, "", ""), (3, "", "hi")]
    assert html.op6_html_text(spark, SF).where("text is null or length(text) = 0").count() == 0


def test_tokens_and_packing(spark, odd, duck):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    thue = "a"
    while len(thue) < 4096:  # of one hash with its complement, as the hash of a piece is a polynomial modulo 2**64
        thue += thue.translate({97: "b", 98: "a"})
    twin = thue.translate({97: "b", 98: "a"})
    tk = Tokenizer.from_file(path)
    docs = duck.sql("select doc_id, text from documents").fetchall()
    texts = ["it's we're i'll they'd don'tx ''s \"'s 's't", "", "²x½ ª º µ ß ÷×", "Σας İı", "日本語", "<|endoftext|> hi", "__init__ _a_ 3.14 --", "don''t '''s 'REr"] + [t for _, t in docs[:200]]
    for texts in (texts, [thue, twin], [f"{twin} it's {thue}", thue, "a b", twin]):
        assert [x.tolist() for x in tokens.PieceEncoder(path).encode(texts)] == [tk.encode(t, add_special_tokens=False).ids for t in texts]
    want = {d: tk.encode(t, add_special_tokens=False).ids + [1] for d, t in docs}
    pieces = packing.op7_packing(spark, SF).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        ids = want[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(want[p["doc_id"]])
        by_doc.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts, total in [(by_doc[d], len(w)) for d, w in want.items()] + [(x, 2048 if s < max(by_sequence) else None) for s, x in by_sequence.items()]:
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert total in (None, at)
    assert sorted(packing.pack(odd, path).groupBy("doc_id").agg(F.max("doc_tokens").alias("n")).where("n = 1").toPandas().doc_id) == [1, 2, 3]
    assert packing.pack(odd.limit(0), path).count() == 0


def brute_secrets(t, rules=secrets.RULES):
    return sorted((m.start(), o, r.kind, m.end()) for o, r in enumerate(rules) for m in re.finditer(r.regex, t or "") if len(m.group(r.group)) >= r.least)


def test_secrets(spark, odd):
    texts = ["é token: abcdef, SECRET='zzzzz' password = 12345678\napi_key=\"" + "0f" * 20 + '"', "AKIA" + "A" * 16 + " AKIAB", "😀 ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----", "", None, "tokentoken=abcdefg", "eyJ" + "a" * 20 + ".eyJ" + "b" * 20 + ".c", "deadbeef" * 3, "passwd:=x=123456", "xoxb-" + "1" * 20]
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, secrets string")
    got = {r["doc_id"]: [tuple(s) for s in r["secrets"]] for r in secrets.find_secrets(rows).collect()}
    assert got == {i: brute_secrets(t) for i, t in enumerate(texts)}
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(rows).collect()}
    assert masked[1] == "[SECRET] AKIAB" and masked[5] is None and masked[0].startswith("é [SECRET], SECRET='zzzzz' [SECRET]")
    assert secrets.find_secrets(odd).count() == 8 and secrets.find_secrets(odd.limit(0)).count() == 0


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]+") == [] and secrets.trigram_query("(abc|de)x?") == []
    assert secrets.trigram_query("(abc|bcde)[0-9]+") == [{frozenset(["abc"]), frozenset(["bcd", "cde"])}]
