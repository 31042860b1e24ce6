"""The encoder against the public library's own, exact round trips and edge cases."""

import random

import pyarrow as pa
import pytest

from lumenfold.llm import tokens as T

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def encoder():
    return T.Encoder(T.serialise_model(T.read_vocabulary()))


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def ids_of(encoder, texts):
    offsets, ids = encoder.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


def test_random_texts_equal_the_reference(encoder, reference):
    rng = random.Random(1)
    alphabet = list("ab'sdmtlvre  \n\t\r 　é方1２٣½.,-_🙂‍́﻿") + ["'s", "'ll", " '", "  ", "<|endoftext|>", "\\begin{x}"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(5000)]
    got = ids_of(encoder, texts)
    assert got == reference(texts)
    vocabulary = T.read_vocabulary()
    assert all(T.decode_ids(i, vocabulary) == t for i, t in zip(got, texts))


def test_edges(encoder, reference):
    texts = [None, "", "   ", " ", "\n\n x", "x'", "'", "'s", "a" * 200_000, "方" * 3000, "it's 'tis we'll", "don'ts"]
    assert ids_of(encoder, texts) == [[], *reference(texts[1:])]
    assert ids_of(encoder, []) == [] and ids_of(encoder, [None]) == [[]]


def test_sliced_arrays(encoder):
    array = pa.array(["one", "two words", None, "three", ""])
    offsets, ids = encoder.encode(array.slice(1, 3))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == ids_of(encoder, ["two words", None, "three"])


def test_parts_cut_between_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["aa", None, "bbbb", "", "c"])], names=["text"])
    cut = [p.column(0).to_pylist() for p in T.parts(batch, "text", 3)]
    assert len(cut) > 1 and sum(cut, []) == ["aa", None, "bbbb", "", "c"]
    assert list(T.parts(batch.slice(0, 0), "text")) == []


def test_table(spark, reference):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "y"), (3, "", None), (3, "", None)], "doc_id long, text string, result string")
    rows = sorted(tuple(r) for r in T.encode_texts(df, "text", "ids").select("doc_id", "ids").collect())
    assert rows == [(1, reference(["Hello world"])[0]), (2, []), (3, []), (3, [])]
    assert sorted(tuple(r) for r in T.count_tokens(df.select("doc_id", "text"), "text", "n").collect()) == [(1, 2), (2, 0), (3, 0), (3, 0)]
    assert T.encode_texts(df.limit(0), "text", "ids").count() == 0
