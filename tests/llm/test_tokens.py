"""Encoding against the whole-text encoder of another library, decoding as an exact round trip."""

import random

import pyarrow.parquet as pq
import pytest

from ribospark.llm import tokens

tokenizers = pytest.importorskip("tokenizers")
SCHEMA = "doc_id bigint, text string, ids string, k string, uid string"
PIECES = list("ab  \n\t'sdt1.,!é­​　ıß漢字🏛́\r \xa0") + ["<|endoftext|>", " 's", "'ll", "word ", "\n\n\n", "   "]


@pytest.fixture(scope="module")
def whole():
    t = tokenizers.Tokenizer.from_file(tokens.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def encoded(spark, texts, **sizes):
    df = spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(texts)], SCHEMA)
    out = tokens.encode_corpus(df, **sizes).collect()
    assert len(out) == len(texts)
    return [list(r.ids) for r in sorted(out, key=lambda r: r.doc_id)]


def test_defined_cases(spark, whole):
    texts = [None, "", " ", "\n \n", "<|endoftext|>", "x" * 9_000, "a b " * 5_000, " " * 10_000]
    assert encoded(spark, texts) == whole(texts)


@pytest.mark.parametrize("chunk,overlap,task_chunks", [(20, 12, 1_000), (20, 12, 0), (64, 32, 1_000), (64, 32, 2)])
def test_stitched_chunks(spark, whole, chunk, overlap, task_chunks):
    rnd = random.Random(chunk)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 400))) for _ in range(300)]
    got = encoded(spark, texts, chunk=chunk, overlap=overlap, task_chunks=task_chunks)
    assert got == whole(texts)
    assert [tokens.decode(ids) for ids in got] == texts


def test_documents(spark, whole):
    path = "/root/testdata/sf0.001/documents.parquet"
    rows = pq.read_table(path, columns=["doc_id", "text"]).to_pylist()
    got = {r.doc_id: list(r.ids) for r in tokens.encode_corpus(spark.read.parquet(path), chunk=500, overlap=60).collect()}
    assert got == dict(zip([r["doc_id"] for r in rows], whole([r["text"] for r in rows]), strict=True))


def test_a_text_goes_by_its_chunks():
    text = "".join(random.Random(1).choice(PIECES) for _ in range(4_000))
    got, joined = tokens.stitched_tokens(text, 64, 32)
    assert list(got) == tokens.pre_tokens(text) and joined < len(text) / 64 / 10
    got, joined = tokens.stitched_tokens("x" * 20_000 + " y", 64, 32)
    assert list(got) == ["x" * 20_000, " y"] and joined < 12


def test_agreement(spark):
    df = spark.createDataFrame([("a b " * 1_000,), ("x" * 3_000,), ("short",), ("",), (None,)], "text string")
    assert {(r.n_chunks, r.joined, r.n) for r in tokens.agreement(df).collect()} == {(4, 0, 1), (3, 2, 1), (1, 0, 1)}


def test_repeated_rows_null_ids_empty_table(spark):
    long = "many words " * 1_000
    df = spark.createDataFrame([(1, long, "", "", ""), (1, long, "", "", ""), (None, "a", "", "", "")], SCHEMA)
    out = tokens.encode_corpus(df).collect()
    assert [r.doc_id for r in out].count(1) == 2 and len(out) == 3
    assert tokens.encode_corpus(df.limit(0)).count() == 0


def test_the_splitter_knows_the_characters_of_the_encoder():
    enc = tokens.encoding(tokens.VOCABULARY)
    for lo in range(0, 0x30000, 0x400):
        text = "".join(f"a{chr(c)}1{chr(c)}{chr(c)} " for c in range(lo, lo + 0x400) if not 0xD800 <= c < 0xE000)
        at, pieces = 0, []
        for end in tokens.boundaries(text):
            pieces += enc._encode_single_piece(text[at:end])
            at = end
        assert pieces == enc.encode_ordinary(text), hex(lo)
