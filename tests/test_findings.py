"""Tests of single findings: each fails on the code before its repair."""

import hashlib
import pathlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import arrays, text
from millrace.operators import behaviour, dedup, encode, lm, metrics
from millrace.sources import readers
from millrace.storage import written


def test_a_batch_with_lines_of_two_splits_keeps_the_records_of_both():
    lines = [("f", 0, False, "a,1"), ("f", 0, False, "b,2"), ("f", 0, False, '"c'), ("f", 90, True, 'd",3'), ("f", 90, True, "e,4"), ("g", 0, False, "h,5")]
    names = ["file", "block", "within", "value"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*lines, strict=True)], names)
    out = [r for b in readers._records_of_splits(iter([batch])) for r in b.to_pylist()]
    assert [(r["file"], r["block"], r["begins"], r["ends"], r["record"]) for r in out] == [
        ("f", 0, True, True, "a,1"), ("f", 0, True, True, "b,2"), ("f", 0, True, False, '"c'), ("f", 90, False, True, 'd",3'), ("f", 90, True, True, "e,4"), ("g", 0, True, True, "h,5"),
    ]


def test_a_resample_draws_as_many_rows_as_there_are(spark):
    rows = [(10 * i, i / 16_000_000, i % 2) for i in range(16)]  # scores that one bin of ten thousand would hold
    df = spark.createDataFrame(rows, "idx long, prob double, label int")
    got = {r.metric: (r.lo, r.hi) for r in metrics.resampled(df, 0.5, 2).collect()}
    auc = []
    for rep in range(2):
        drawn = [rows[int(hashlib.md5(f"0:{rep}:{i}".encode()).hexdigest()[:8], 16) % 16] for i in range(16)]
        up, down = [p for _, p, y in drawn if y], [p for _, p, y in drawn if not y]
        auc.append(sum((a > b) + (a == b) / 2 for a in up for b in down) / len(up) / len(down))
    lo, hi = sorted(auc)
    assert got["roc_auc"] == pytest.approx((lo + 0.025 * (hi - lo), lo + 0.975 * (hi - lo)))


def test_ids_of_blocks_and_pairs_need_no_exchange_of_single_tokens(spark):
    texts = ["b a", "", None, "c unknown a a", "a", "- -", "B"]
    docs = spark.createDataFrame([(10 * i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    words = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "token string, id long")
    assert {r.doc_id: r.ids for r in encode.encode_words(docs, "doc_id", "text", words).collect()} == {0: [1, 0], 10: [], 20: [], 30: [2, 0, 0], 40: [0], 50: [], 60: [1]}
    assert {r.doc_id: r.ids for r in encode.encode_words(docs, "doc_id", "text", words, 2).collect()}[30] == [2]
    assert all(r.ids == [] for r in encode.encode_words(docs, "doc_id", "text", words.limit(0)).collect())
    coded = written(encode.placed_words(docs, "doc_id", "text", words), "coded")
    stream = lm.token_stream(coded, "doc_id", 9)
    assert [r.token for r in stream.orderBy("pos").collect()] == [1, 0, 9, 9, 9, 2, 0, 0, 9, 0, 9, 9, 1, 9]
    pairs = lm.stream_pairs(coded, 9)
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, lm.with_next(stream).collect()))
    assert sorted(map(tuple, lm.stream_pairs(coded, 9, 3, 7).collect())) == [(3, 9, 9), (4, 9, 2), (5, 2, 0)]
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_line_dedup_of_the_query_and_the_pipeline_misses_no_link(spark, tmp_path):
    import corpus_pipeline
    from millrace.llm.queries import QUERIES

    rng, lines = random.Random(7), []
    for _ in range(80):
        line = [f"w{rng.randrange(10**9)}" for _ in range(40)]
        lines += [line, [f"w{rng.randrange(10**9)}" if k % 5 == 2 else w for k, w in enumerate(line)]]  # a fifth of the words
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.n_dropped for r in QUERIES["op8_line_dedup"](spark, str(tmp_path)).collect()} == {i: i % 2 for i in range(160)}
    assert {r.doc_id: int(r.text == "") for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()} == {i: i % 2 for i in range(160)}


def test_characters_are_looked_up_without_a_shuffle_of_texts(spark):
    texts = ["aé日😀a", "", None, "\U0010fffdZ"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    every = sorted({c for t in texts for c in t or ""})
    known = spark.createDataFrame([(c, i) for i, c in enumerate(every)], "ch string, id long")
    coded = encode.encode_characters(docs, "doc_id", "text", known)
    assert {r.doc_id: r.ids for r in coded.collect()} == {i: [every.index(c) for c in t or ""] for i, t in enumerate(texts)}
    assert "Exchange hashpartitioning(doc_id" not in coded._jdf.queryExecution().executedPlan().toString()


def test_a_cases_input_is_made_once_for_all_its_edits(spark):
    cases = spark.createDataFrame([("a", 0, "", "Alice met Bob"), ("b", 1, "Hi", "no names"), ("c", 1, "", None)], "case_id string, label int, subject string, body string")
    score = lambda x: F.length(x).cast("double")
    got, want = behaviour.edited_pairs(cases, score), behaviour.paired(behaviour.perturb(cases), score)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "x0" in behaviour.perturb(cases.withColumn("x0", F.lit("")), behaviour.EDITS, "x0").columns


def _jaccard(x, y):
    return len(x & y) / len(x | y)


def test_similar_sets_are_compared_by_atoms_and_only_flagged_matches_on_request(spark):
    rng, line, rows = random.Random(5), list(range(1000, 1400)), []
    for k in range(60):
        own = [rng.randrange(10**6) + 10**6 for _ in range(rng.randrange(2, 9))]
        rows.append((k, sorted({*own, *line[: 400 - k % 3], *([7, 8] if k % 2 else [])})))
    rows += [(60, [5]), (61, [6, 9]), (62, []), (63, [6, 9, 10]), (64, rows[0][1])]
    sets = spark.createDataFrame(rows, "id long, set array<long>")
    of = {k: set(v) for k, v in rows}
    want = {(i, j, len(of[i] & of[j]), len(of[i] | of[j])) for i in of for j in of if i < j and of[i] and of[j] and _jaccard(of[i], of[j]) >= 0.98}
    assert {tuple(r) for r in dedup.similar_pairs(sets, (49, 50)).collect()} == want
    asked, held = sets.where("id % 4 = 0"), sets.where("id % 4 != 0")
    for flagged_only in (False, True):
        for r in dedup.best_matches(asked, held, (49, 50), flagged_only=flagged_only).collect():
            best = min(((-_jaccard(of[r.i], of[j]), j) for j in of if j % 4 and of[r.i] & of[j]), default=(0, None))
            best = best if not flagged_only or best[0] <= -0.98 else (0, None)
            assert (r.similarity, r.match, r.flagged) == (pytest.approx(-best[0]), best[1], best[0] <= -0.98)
    # the line's common elements are an atom or a few, not some four hundred entries of each set
    _, classes = dedup.set_classes(sets)
    atoms = dedup.set_atoms(classes.withColumn("asked", F.lit(False)), F.col("f") > 1)
    assert max(len(r.x) for r in atoms.collect()) <= 6


def test_pairs_are_counted_and_looked_up_in_one_exchange(spark):
    rows = [(0, 1, 2), (1, 2, 1), (2, 1, 2), (3, 2, 3), (4, 3, 1), (5, 1, 2), (6, 2, 9)]
    pairs = spark.createDataFrame(rows, "pos long, a long, b long")
    used = lm.pair_uses(pairs, c=F.col("pos") < 3, tune=F.col("pos").between(4, 5))
    assert used._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {(r.a, r.b): (r.c, r.tune) for r in used.collect()} == {(1, 2): (2, 1), (2, 1): (1, 0), (3, 1): (0, 1)}
    unigram = spark.createDataFrame([(1, 0.5), (2, 0.5)], "token long, prob double")
    contexts = spark.createDataFrame([(1, 2), (2, 1)], "a long, ca long")
    looked = lm.counted_probabilities(used.where("tune > 0").select("a", "b", "c"), unigram, contexts)
    assert {(r.a, r.b): (r.p_uni, r.p_bi) for r in looked.collect()} == {(1, 2): (0.5, 1.0), (3, 1): (0.5, 0.0)}


def test_windows_name_the_rows_that_hold_their_second_tokens(spark):
    placed = spark.createDataFrame([(k, size, start) for k, (size, start) in enumerate([(3, 0), (1, 3), (4, 4), (1, 8), (5, 9)])], "doc_id long, size int, start long")
    for begin in range(11):
        starts = spark.createDataFrame([(0, begin)], "draw long, start long")
        want = [k for k, (size, start) in enumerate([(3, 0), (1, 3), (4, 4), (1, 8), (5, 9)]) if {begin + 1, begin + 2} & set(range(start, start + size))]
        assert sorted(r.doc_id for r in lm.rows_of_windows(placed, starts, 2).collect()) == want


def test_pairs_of_words_are_those_of_the_encoded_stream(spark):
    texts = ["b a", "", None, "c d a a", "a", "- -", "B"]
    docs = spark.createDataFrame([(10 * i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    words = encode.word_vocabulary(docs, "text")
    want = lm.stream_pairs(encode.placed_words(docs, "doc_id", "text", words), words.count())
    seed = lm.separating_seed(words, "token")
    got = lm.word_pairs(docs, "doc_id", text.words(F.col("text")), seed)
    named = {r.h: r.id for r in words.select(F.xxhash64("token", F.lit(seed)).alias("h"), "id").collect()} | {None: words.count()}
    assert sorted((named[r.a], named[r.b]) for r in got.collect()) == sorted((r.a, r.b) for r in want.collect())


def test_shingles_have_one_hash_where_their_words_are_the_same(spark):
    rows = [(1, "Subject a b c a b c"), (2, "a b c a"), (3, "a b"), (4, ""), (5, None), (6, "ab c"), (7, "a bc"), (8, "b a")]
    df = spark.createDataFrame(rows, "k int, t string")
    got = df.select("k", F.explode(arrays.shingle_hashes(F.col("t"), 3)).alias("h")).join(df.select("k", F.posexplode(arrays.message_shingles(F.col("t"), 3)).alias("at", "s")), "k").groupBy("k").agg(F.sort_array(F.collect_set("h")).alias("h"), F.collect_set("s").alias("s")).collect()
    sets = {r.k: (set(r.h), set(r.s)) for r in got}
    assert set(sets) == {1, 2, 3, 6, 7, 8}
    for a in sets.values():
        assert len(a[0]) == len(a[1])
        assert all(len(a[0] & b[0]) == len(a[1] & b[1]) for b in sets.values())
    plan = df.select(arrays.shingle_hashes(F.col("t"), 3))._jdf.queryExecution().executedPlan().toString()
    assert "array_join" not in plan  # no shingle is put together


def test_sets_of_one_64_bit_digest_keep_their_own_links(spark):
    other = [8, 5775063480725956755]  # xxhash64 of the array is that of [1, 2]
    sets = spark.createDataFrame([(0, [1, 2]), (1, other), (2, other), (3, [8])], "id long, set array<long>")
    assert sets.select(F.xxhash64("set")).distinct().count() == 2
    assert {tuple(r) for r in dedup.similar_pairs(sets, (1, 2)).collect()} == {(1, 2, 2, 2), (1, 3, 1, 2), (2, 3, 1, 2)}


def test_a_fit_keeps_no_table_of_its_steps_and_goes_on_where_it_was_cut(spark, monkeypatch):
    from millrace.operators import logistic
    from millrace.storage import scratch_root

    rng = random.Random(2)
    xs = [[rng.random() for _ in range(6)] for _ in range(60)]
    cells = spark.createDataFrame([(r, c, x) for r, row in enumerate(xs) for c, x in enumerate(row)], "row long, slot int, x double")
    rows = spark.createDataFrame([(r, int(row[0] + rng.random() > 1), 1.0) for r, row in enumerate(xs)], "row long, label int, weight double")
    fits = []
    for cut in (2, 100):
        monkeypatch.setattr(logistic, "CUT", cut, raising=False)
        weights, intercept = logistic.fit(cells, rows, 1e-3, 5)
        fits.append([intercept, *(r.weight for r in weights.orderBy("slot").collect())])
    assert fits[0] == pytest.approx(fits[1]) and len(fits[0]) == 7
    assert not list(pathlib.Path(scratch_root(spark), "millrace").glob("term-packs-*")) + list(pathlib.Path(scratch_root(spark), "millrace").glob("fit-state-*"))


def test_the_similarity_join_keeps_no_second_copy_of_the_sets(spark):
    from millrace.storage import scratch_root

    tables = lambda: {p.name for p in pathlib.Path(scratch_root(spark), "millrace").glob("*") if p.name.startswith(("sets-", "atom-parts-"))}
    before = tables()
    sets = written(spark.createDataFrame([(k, [k % 3, 5, 6, 7, 8 + k % 2, -k]) for k in range(1, 12)], "id long, set array<long>"), "stored")
    asked, held = sets.where("id < 4"), sets.where("id >= 4")
    got = dedup.best_matches(asked, held, (1, 2), stored=True).collect()
    pairs = dedup.similar_pairs(sets, (1, 2)).collect()
    assert tables() == before
    assert sorted(map(tuple, got)) == sorted(map(tuple, dedup.best_matches(asked, held, (1, 2)).collect()))
    of = {r.id: set(r.set) for r in sets.collect()}
    assert {(r.i, r.j, r.shared, r.total) for r in pairs} == {(i, j, len(of[i] & of[j]), len(of[i] | of[j])) for i in of for j in of if i < j and _jaccard(of[i], of[j]) >= 0.5}


def test_keys_are_dealt_in_more_slices_than_pairs(spark):
    from millrace.llm.components import linked_components

    rows = [(key, node) for key, nodes in ((3, (1, 2)), (8, (2, 5, 9)), (17, (9, 30)), (20, (40, 41)), (21, (41, 42, 7))) for node in nodes]
    keyed = spark.createDataFrame(rows, "key long, node long")
    far = lambda a, b: F.abs(F.col(a) - F.col(b)) < 30
    got = linked_components(keyed, "node", far, lambda a, b: F.lit(1), slices=5, pair_slices=2)
    assert {tuple(r) for r in got.collect()} == {(1, 1), (2, 1), (5, 1), (9, 1), (30, 1), (40, 40), (41, 40), (42, 40)}
