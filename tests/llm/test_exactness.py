"""Words that share a symbol, lines that share a passage alone, reading single documents of token files, many ties at a search's bound."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from millrace.llm import hamming_search, line_dedup, token_files
from millrace.llm.queries import WORD_VOCABULARY
from millrace.llm.word_ids import WordIds


def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_words_of_one_symbol_still_count_as_different(spark):
    words = spark.range(6000).select(F.concat(F.lit("word"), "id").alias("w"))
    same = words.groupBy(line_dedup.as_symbols(F.col("w"), 1).alias("s")).agg(F.collect_list("w").alias("ws")).where(F.size("ws") > 1).collect()
    assert same
    a, b = sorted(same[0].ws)[:2]
    # two of five words differ, one of them by its second symbol alone
    out = line_dedup.dedup_lines(docs(spark, [f"alpha beta gamma {a} delta", f"alpha beta gamma {b} other", f"alpha beta gamma {a} other"])).collect()
    assert {r.doc_id: r.n_dropped for r in out} == {0: 0, 1: 1, 2: 1}  # the third is one edit from both
    out = line_dedup.dedup_lines(docs(spark, [f"alpha beta gamma {a} delta", f"alpha beta gamma {b} other"])).collect()
    assert {r.doc_id: r.n_dropped for r in out} == {0: 0, 1: 0}


def test_symbols_are_one_character_a_word(spark):
    line = " ".join(f"w{i}" for i in range(3000)) + " 今天"
    row = spark.createDataFrame([(line,)], "t string").select(F.length(line_dedup.as_symbols(F.col("t"), 2)).alias("n")).first()
    assert row.n == 3002


def test_documents_of_a_range_are_read_alone(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = [f"document number {i} says this and that, {'again ' * (i % 7)}" for i in range(60)] + [None, ""]
    path = str(tmp_path / "files")
    token_files.write_token_files(docs(spark, texts).union(spark.createDataFrame([(None, "no id")], "doc_id long, text string")), path, WORD_VOCABULARY, shard_ids=64)
    shards = spark.read.parquet(path)
    assert shards.count() > 1 and shards.where("first_doc > last_doc").count() == 0
    own = Tokenizer.from_file(WORD_VOCABULARY)
    want = {i: [*own.encode(texts[i] or "", add_special_tokens=False).ids, 2] for i in range(20, 62)}
    assert {r.doc_id: r.ids for r in token_files.read_tokens_of(spark, path, 20, 90).collect()} == want
    assert token_files.read_tokens_of(spark, path, 70, 90).count() == 0
    assert [r.doc_id for r in token_files.read_tokens_of(spark, path, 0, 0).collect()] == [0]


def test_many_ties_at_the_bound_of_a_search(spark):
    codes = [(100 + i, 1 << (i % 63)) for i in range(630)]  # 63 codes of ten rows each, all one bit from 0
    rows = spark.createDataFrame(codes, "id long, code long")
    asked = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id long, code long")
    got = {}
    for r in hamming_search.top_k(rows, asked, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.id))
    near = [(k + 1, 1, 100 + k) for k in range(5)]
    assert sorted(got[1]) == near and sorted(got[2]) == near
    assert sorted(got[3]) == [(k + 1, 0, 100 + 63 * k) for k in range(5)]


def test_lines_that_share_a_passage_alone_have_no_text_read(spark, monkeypatch):
    rng = random.Random(5)
    own = lambda i, n: [f"w{i}x{j}" for j in range(n)]
    passage = ["one", "passage", "of", "many", "lines"]
    lines = [" ".join([*own(i, 12), *passage, *own(i + 100, 12)]) for i in range(30)]
    read, texts = [], line_dedup.line_texts
    monkeypatch.setattr(line_dedup, "line_texts", lambda rows, wanted: read.append(wanted.count()) or texts(rows, wanted))
    assert {r.n_dropped for r in line_dedup.dedup_lines(docs(spark, lines), runs=None).collect()} == {0} and not read
    # nothing that may link is left out: words replaced, put in, left out and moved, up to the limit
    pairs = []
    for n in range(4, 90, 3):
        a = [f"v{rng.randrange(60)}" for _ in range(n)]
        b, most = list(a), (n + n // 5) // 5
        for _ in range(rng.randrange(most + 1)):
            k = rng.randrange(len(b))
            b[k : k + 1] = rng.choice([[], [f"v{rng.randrange(60)}"], [b[k], "new"]])
        pairs.append((" ".join(a), " ".join(b) or "v"))
    of = lambda t: F.struct(F.size(F.split(t, " ")).alias("n"), *line_dedup.parities(F.transform(F.split(t, " "), lambda w: F.xxhash64(w))))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", of("a").alias("of_a"), of("b").alias("of_b")).select("a", "b", line_dedup.parities_allow("of_a", "of_b").alias("may")).collect()
    linked = [r for r in got if edits(r.a.split(), r.b.split()) <= max(len(r.a.split()), len(r.b.split())) // 5]
    assert len(linked) > 15 and all(r.may for r in linked)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(last + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1]


def test_a_word_is_one_chunk_whatever_sign_follows_it():
    from tokenizers import Tokenizer

    own, fast = Tokenizer.from_file(WORD_VOCABULARY), WordIds(WORD_VOCABULARY)
    texts = ["Word, word. word; (word) word's WORD!", "don't 'Sam it's.'s a1b2 x-y-z ..'ll é, Ærø. ß? l'été 1,5 ª º¹", "a\x0b,b\x0c.c\td!\n", "word,\xa0word <|endoftext|>, it"]
    ids, at = fast.encode(pa.array(texts, pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert [c for c in fast.known if "word" in c] == ["word", "(word"]
