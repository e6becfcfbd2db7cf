"""Queries of the text functions."""

from __future__ import annotations

import importlib.util

from pyspark.sql import functions as F

from millrace.functions import arrays, text
from millrace.operators import encode, tokenizers
from millrace.plans.inputs import BLOCK, ENCODED, VOCABULARY, WS, encoded, read, sql_message_words, sql_norm, sql_shingles, sql_words, vocabulary

SWAPS = {"the": "a", "a": "the", "of": "from"}


def normalize_text(spark, d):
    return read(spark, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("norm"))


def format_message(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", text.format_message(F.col("role"), F.col("text")).alias("message"))


def strip_prefix(spark, d):
    tagged = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Subject:"), F.col("text"))).otherwise(F.col("text"))
    return read(spark, d, "documents").select("doc_id", text.without_prefix(tagged).alias("bare"))


def words(spark, d):
    w = text.words(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(w).cast("bigint").alias("n_words"), F.array_join(F.slice(w, 1, 5), "|").alias("first_words"))


def clean_body(spark, d):
    odd = F.concat(F.lit(" \r\n"), F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")), F.lit(" \n"))
    return read(spark, d, "documents").select("doc_id", text.clean_body(odd).alias("body")).where(F.length("body") > 0)


def preview(spark, d):
    return read(spark, d, "documents").select("doc_id", text.preview(F.concat(F.lit("Subject: "), F.col("text"))).alias("preview"))


def swap_names(spark, d):
    body = F.col("text")
    swapped = F.when(text.has_word(body, SWAPS), text.swap_words(body, SWAPS))
    return read(spark, d, "conversations").select("conv_id", "turn", swapped.alias("swapped"))


def token_bytes(spark, d):
    sizes = F.transform(text.words(F.col("text")), lambda w: F.octet_length(w))
    return read(spark, d, "documents").select("doc_id", F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("bytes"), F.coalesce(F.array_max(sizes), F.lit(0)).cast("bigint").alias("longest"))


def _char_vocabulary(spark, d):
    chars = read(spark, d, "documents").select(F.explode(text.characters(F.col("text"))).alias("ch")).distinct()
    return encode.ranked(chars, "id", F.col("ch").asc())


def char_vocab(spark, d):
    return _char_vocabulary(spark, d)


def char_encode(spark, d):
    coded = encode.encode_characters(read(spark, d, "documents"), "doc_id", "text", _char_vocabulary(spark, d))
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_chars"), F.md5(ids).alias("ids_md5"))


def tag_lists(spark, d):
    raw = F.concat(F.col("lang"), F.lit(" , ,"), F.col("source"), F.lit(","))
    return read(spark, d, "documents").select("doc_id", F.array_join(text.tag_list(raw), "|").alias("tags"))


def label_names(spark, d):
    name = text.label_name(F.col("toxic").cast("int"))
    return read(spark, d, "labels").select("doc_id", name.alias("name"), text.label_code(name).alias("code"))


def word_vocab(spark, d):
    return vocabulary(spark, d)


def shingles(spark, d):
    s = arrays.shingles(text.words(F.col("text")), 5)
    return read(spark, d, "documents").select("doc_id", F.size(s).cast("bigint").alias("n"), F.md5(F.array_join(s, "|")).alias("all_md5"))


def message_shingles(spark, d):
    s = arrays.message_shingles(F.concat(F.lit("Subject: "), F.col("text")), 5)
    return read(spark, d, "documents").select("doc_id", F.size(s).cast("bigint").alias("n"), F.md5(F.array_join(F.sort_array(s), "|")).alias("sorted_md5"))


def encode_pad(spark, d):
    rows, end = encoded(spark, d)
    wide = arrays.padded(F.col("tokens"), BLOCK, F.lit(end))
    return rows.select("idx", F.col("length").cast("bigint").alias("length"), "truncated", F.md5(F.array_join(F.transform(wide, lambda t: t.cast("string")), ",")).alias("tokens_md5"))


def window_starts(spark, d):
    starts = arrays.window_starts(F.col("n_chars"), 8, F.lit(160))
    return read(spark, d, "documents").select("doc_id", F.size(starts).cast("bigint").alias("n"), F.array_join(F.transform(starts, lambda s: s.cast("string")), ",").alias("starts"))


def char_round_trip(spark, d):
    """Texts that were encoded by characters and decoded again."""
    docs = read(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), "text")
    tok = tokenizers.CharacterTokenizer(docs, "text")
    return tok.decode(tok.encode(docs, "key", "text"), "key", "ids").select("key", F.md5("text").alias("text_md5"))


def bpe_round_trip(spark, d):
    """Texts that were encoded by byte pairs and decoded again, and their bytes summed over the tokens."""
    import public_tokenizers

    docs = read(spark, d, "benchmark").select("item_id", "text")
    tok = tokenizers.ByteBpeTokenizer(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = tok.encode(docs, "item_id", "text")
    # a row for each token of the vocabulary
    summed = coded.select("item_id", F.explode("ids").alias("id")).join(F.broadcast(tok.byte_lengths()), "id").groupBy("item_id").agg(F.sum("bytes").cast("bigint").alias("n_bytes"))
    return tok.decode(coded, "item_id", "ids").join(summed, "item_id").select("item_id", F.md5("text").alias("text_md5"), "n_bytes")


QUERIES = {f.__name__: f for f in (normalize_text, format_message, strip_prefix, words, clean_body, preview, swap_names, token_bytes, char_vocab, char_encode, tag_lists, label_names, word_vocab, shingles, message_shingles, encode_pad, window_starts, char_round_trip)}
# the vocabulary file is an extra of some installations
if importlib.util.find_spec("public_tokenizers"):
    QUERIES["bpe_round_trip"] = bpe_round_trip

_W = sql_words("text")
_SWAP = r"""CASE WHEN len(list_intersect(regexp_extract_all(text, '[\p{L}\p{N}_]+'), ['the', 'a', 'of'])) > 0
  THEN array_to_string(list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'),
    lambda w: CASE w WHEN 'the' THEN 'a' WHEN 'a' THEN 'the' WHEN 'of' THEN 'from' ELSE w END), '') END"""
_CHARS = "chars AS (SELECT ch, (row_number() OVER (ORDER BY ch) - 1)::BIGINT AS id FROM (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '')"
ORACLES = {
    "normalize_text": f"SELECT doc_id, {sql_norm('text')} AS norm FROM documents",
    "format_message": f"SELECT conv_id, turn, 'Subject: ' || {sql_norm("role || ' ' || text")} AS message FROM conversations",
    "strip_prefix": "SELECT doc_id, CASE WHEN starts_with(t, 'Subject:') THEN substr(t, 9) ELSE t END AS bare FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Subject:' || text ELSE text END AS t FROM documents)",
    "words": f"SELECT doc_id, len({_W})::BIGINT AS n_words, array_to_string({_W}[1:5], '|') AS first_words FROM documents",
    "clean_body": f"SELECT * FROM (SELECT doc_id, regexp_replace(replace(' ' || chr(13) || chr(10) || replace(text, chr(10), chr(13) || chr(10)) || chr(160) || chr(10), chr(13) || chr(10), chr(10)), '^{WS}+|{WS}+$', '', 'g') AS body FROM documents) WHERE length(body) > 0",
    "preview": "SELECT doc_id, substr(text, 1, 90) || CASE WHEN length(text) > 90 THEN '...' ELSE '' END AS preview FROM documents",
    "swap_names": f"SELECT conv_id, turn, {_SWAP} AS swapped FROM conversations",
    "token_bytes": f"SELECT doc_id, coalesce(list_sum(list_transform({_W}, lambda w: strlen(w))), 0)::BIGINT AS bytes, coalesce(list_max(list_transform({_W}, lambda w: strlen(w))), 0)::BIGINT AS longest FROM documents",
    "char_round_trip": "SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS key, md5(text) AS text_md5 FROM conversations",
    "char_vocab": f"WITH {_CHARS} SELECT ch, id FROM chars",
    "char_encode": f"WITH {_CHARS}, each AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS pos FROM documents) SELECT doc_id, count(*)::BIGINT AS n_chars, md5(string_agg(id::VARCHAR, ',' ORDER BY pos)) AS ids_md5 FROM each JOIN chars USING (ch) GROUP BY doc_id",
    "tag_lists": "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(lang || ' , ,' || source || ',', ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS tags FROM documents",
    "label_names": "SELECT doc_id, CASE toxic WHEN 0 THEN 'legitimate' ELSE 'spam' END AS name, toxic::INTEGER AS code FROM labels",
    "word_vocab": f"WITH {VOCABULARY} SELECT token, n, id FROM vocabulary",
    "shingles": f"SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(s, '|')) AS all_md5 FROM (SELECT doc_id, {sql_shingles('w', 5).replace('list_distinct', '')} AS s FROM (SELECT doc_id, {_W} AS w FROM documents))",
    "message_shingles": f"SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(list_sort(s), '|')) AS sorted_md5 FROM (SELECT doc_id, {sql_shingles('w', 5)} AS s FROM (SELECT doc_id, {sql_message_words("'Subject: ' || text")} AS w FROM documents))",
    "encode_pad": f"WITH {ENCODED} SELECT idx, length::BIGINT AS length, truncated, md5(array_to_string(list_concat(tokens, list_transform(range({BLOCK} - len(tokens)), lambda i: tokens[-1])), ',')) AS tokens_md5 FROM encoded",
    "window_starts": """WITH sized AS (SELECT doc_id, (n_chars - 1) // 8 AS n, 20 AS k FROM documents), started AS (
      SELECT doc_id, CASE WHEN n <= k THEN list_transform(range(n), lambda i: i * 8) ELSE list_transform(range(k), lambda i: (i * (n - 1) // (k - 1)) * 8) END AS s FROM sized)
      SELECT doc_id, len(s)::BIGINT AS n, array_to_string(s, ',') AS starts FROM started""",
}
if "bpe_round_trip" in QUERIES:
    ORACLES["bpe_round_trip"] = "SELECT item_id, md5(text) AS text_md5, strlen(text) AS n_bytes FROM benchmark"
