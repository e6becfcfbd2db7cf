"""Tokenizers: round trips and byte lengths."""

import os

import pytest

from millrace.operators import tokenizers

TEXTS = ["a rose is a rose", "été à Paris", ""]


def both_ways(tok, df):
    coded = tok.encode(df, "id", "text")
    return {r.id: r.text for r in tok.decode(coded, "id", "ids").collect()}, {r.id: r.ids for r in coded.collect()}


def test_word_and_character_tokenizers(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    words, ids = both_ways(tokenizers.WordTokenizer(df, "text"), df)
    assert words == {0: "a rose is a rose", 1: "été à paris", 2: ""} and ids[0][0] == ids[0][3]
    chars = tokenizers.CharacterTokenizer(df, "text")
    assert both_ways(chars, df)[0] == dict(enumerate(TEXTS))
    with pytest.raises(Exception, match="unknown character"):
        chars.encode(spark.createDataFrame([(9, "zebra")], "id long, text string"), "id", "text").collect()


def test_byte_bpe(spark):
    vocabulary = pytest.importorskip("public_tokenizers")
    path = vocabulary.path("byte_bpe_50k.tiktoken")
    if not os.path.exists(path):
        pytest.skip("no rank file here")
    tok = tokenizers.ByteBpeTokenizer(spark, path, vocabulary.PATTERN)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    back, ids = both_ways(tok, df)
    assert back == dict(enumerate(TEXTS))
    bytes_of = {r.id: r.bytes for r in tok.byte_lengths().collect()}
    assert all(sum(bytes_of[i] for i in ids[k]) == len(t.encode()) for k, t in enumerate(TEXTS))
