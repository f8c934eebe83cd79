import random

import pytest
from pyspark.sql import functions as F

from tidewright.llm.tokens import PIECE, decode, encode, encoding, pieces, round_trip, token_ids
from tidewright.llm.tokens import TOKENIZERS as FOLDER

NAME = "byte_bpe_50k"
TEXTS = ["", " ", "\n\n", "Hello world's  end.", "it'll  be\t'sure", "<|endoftext|>", "日本語の文章。全角　空白", "สวัสดี ครับ", "नमस्ते दुनिया", "🙂👩‍👩‍👧 é", " x　y", "a" * 50, "1234567 89", "x  \n  y", "don't'S'LL"]


def test_known_ids_and_defined_empties(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(99, None)], "doc_id bigint, text string")
    out = {r.doc_id: r.ids for r in token_ids(df).collect()}
    assert out[99] == [] and out[0] == []
    for i, t in enumerate(TEXTS):
        assert out[i] == encoding(NAME, FOLDER).encode_ordinary(t)
    assert 50256 not in out[5]
    assert dict(token_ids(df).dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
    assert token_ids(df.limit(0)).count() == 0


def test_pieces_change_nothing():
    r = random.Random(1)
    parts = ["word", "It's", "'ll", " ", "  ", "\n", "　", "漢字", "。", "12", "3.4", "é", "…", "क्षि", "x" * 40, "'", "\t\n "]
    for size in (1, 3, 10, 50):
        for _ in range(30):
            t = "".join(r.choice(parts) for _ in range(300))
            cut = pieces(t, size)
            assert "".join(cut) == t
            assert [i for p in cut for i in encoding(NAME, FOLDER).encode_ordinary(p)] == encoding(NAME, FOLDER).encode_ordinary(t)


def test_long_texts():
    spaced = "The valve is open. " * 20_000
    assert encode(spaced, NAME, FOLDER).tolist() == encoding(NAME, FOLDER).encode_ordinary(spaced)
    assert len(pieces(spaced)) > len(spaced) // (2 * PIECE)
    solid = "漢字。" * 30_000
    assert decode(encode(solid, NAME, FOLDER).tolist(), NAME, FOLDER).decode() == solid
    one_run = "漢" * 40_000
    assert decode(encode(one_run, NAME, FOLDER).tolist(), NAME, FOLDER).decode() == one_run


def test_round_trip_of_all_documents(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    out = round_trip(docs)
    assert out.count() == docs.count() and out.where(~F.col("same")).count() == 0


@pytest.mark.parametrize("other", ["byte_bpe_multi_50k"])
def test_other_tokenizer_by_parameter(spark, other):
    df = spark.createDataFrame([(1, "der Ventilkörper")], "doc_id bigint, text string")
    assert token_ids(df, name=other).first().ids == encoding(other, FOLDER).encode_ordinary("der Ventilkörper")
