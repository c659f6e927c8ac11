"""Rows without ids in near-duplicate removal, and strings of added tokens in packing."""

from sparloom.llm import packing, simhash, tokens

A = "the quick brown fox jumps over the lazy dog and then it runs away from the angry bear in the wood"
B = "completely other words stand here so that nothing of this sentence is like the first one at all ever"


def kept(spark, rows):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, fp int")
    return sorted(((r.doc_id, r.text) for r in simhash.deduplicate(df).collect()), key=repr)


def test_rows_without_id_are_judged_by_row(spark):
    assert kept(spark, [(5, A), (None, A), (None, A)]) == [(5, A)]
    assert kept(spark, [(5, A), (None, A), (None, A), (None, B)]) == [(5, A), (None, B)]
    assert kept(spark, [(None, B), (None, B), (None, A), (6, A), (7, A)]) == [(6, A), (None, B)]
    assert kept(spark, [(None, None), (None, ""), (None, "  ")]) in ([(None, None)], [(None, "")])
    assert kept(spark, [(5, A), (5, A), (4, B), (9, B)]) == [(4, B), (5, A), (5, A)]


def test_strings_of_added_tokens_are_read_as_the_tokenizer_reads_them(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["hello <|endoftext|> world", "<|startoftext|><|endoftext|>", "<|ENDOFTEXT|> no token", "a<|endoftext|>b", "< |endoftext|>", "plain text", "<|endoftext|"]
    assert [x.tolist() for x in tokens.encoder(packing.default_tokenizer()).encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert 49407 in plain.encode(texts[0], add_special_tokens=False).ids
