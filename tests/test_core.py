"""The core operators on small inputs with results worked out by hand."""

import io
import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import arrays, text
from millrace.operators import behaviour, dedup, encode, lm, metrics, runs, scorers
from millrace.sources import readers, sinks
from millrace.streaming.dedup import stream_dedup


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalize(spark):
    got = one(spark, text.normalize(F.lit("Don't PAY $9!!\r\n\tNow  ")))
    assert got == "don ' t pay $ 9 ! ! now"
    assert one(spark, text.normalize(F.lit(got))) == got
    assert one(spark, text.normalize(F.lit("Éa naïve ½"))) == "éa naïve ½"


def test_messages_and_prefixes(spark):
    assert one(spark, text.format_message(F.lit(""), F.lit("Hi"))) == "Subject: hi"
    assert one(spark, text.without_prefix(F.lit("Subject:Subject: a"))) == "Subject: a"
    assert one(spark, text.without_prefix(F.lit("subject: a"))) == "subject: a"
    assert one(spark, text.preview(F.lit("Subject: " + "x" * 91))) == "x" * 90 + "..."


def test_swap_words_in_one_pass(spark):
    table = {"Ann": "Bob", "Bob": "Cy"}
    assert one(spark, text.swap_words(F.lit("Ann, Anna and Bob"), table)) == "Bob, Anna and Cy"
    assert one(spark, text.has_word(F.lit("Anna"), table)) is False


def test_labels_and_tags(spark):
    assert one(spark, text.tag_list(F.lit(" a , ,b,"))) == ["a", "b"]
    assert one(spark, text.label_code(F.lit("spam"))) == 1
    with pytest.raises(Exception, match="unknown label"):
        one(spark, text.label_code(F.lit("other")))


@pytest.mark.parametrize(("words", "n", "count"), [("a b c d e", 3, 3), ("a b", 5, 1), ("", 3, 0)])
def test_shingle_counts(spark, words, n, count):
    assert len(one(spark, arrays.shingles(text.words(F.lit(words)), n))) == count


def test_shingles_ignore_a_leading_subject(spark):
    a, b = (one(spark, arrays.message_shingles(F.lit(t), 3)) for t in ("Subject: a b c d", "a b c d"))
    assert a == b


def test_close_and_pad(spark):
    ids = F.sequence(F.lit(1), F.lit(40))
    closed = arrays.close_ids(ids, 16, F.lit(99))
    assert one(spark, closed) == [*range(1, 16), 99]
    assert one(spark, arrays.padded(F.array(F.lit(1), F.lit(99)), 4, F.lit(99))) == [1, 99, 99, 99]


def test_window_starts(spark):
    assert one(spark, arrays.window_starts(F.lit(1000), 8, F.lit(10**6))) == [8 * i for i in range(124)]
    got = one(spark, arrays.window_starts(F.lit(100_000), 10, F.lit(1000)))
    assert (len(got), got[0], got[-1] > 90_000, all(s % 10 == 0 for s in got)) == (100, 0, True, True)
    assert one(spark, arrays.window_starts(F.lit(5), 8, F.lit(100))) == []


def test_exact_dedup_and_conflicts(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", 0), (3, "b", 0), (4, "b", 1), (5, "c", 1)], "id long, text string, label int")
    kept = dedup.keep_first(dedup.drop_conflicts(df, "text", "label"), "text", "id")
    assert sorted(r.id for r in kept.collect()) == [1, 5]
    assert [r.id for r in dedup.later_copies(df, "text", "id").orderBy("id").collect()] == [2, 4]


TEXTS = ["the quick brown fox jumps over the lazy dog again today", "something else entirely with other words in it here now", "the quick brown fox jumps over the lazy dog again tonight", "the quick brown fox jumps over the lazy dog again today"]


def test_similar_pairs_match_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    sets = dedup.shingle_sets(df, "id", "text", 3)
    got = {(r.i, r.j, r.shared, r.total) for r in dedup.similar_pairs(sets, (7, 10)).collect()}
    own = {r.id: set(r.set) for r in sets.collect()}
    want = {(i, j, len(own[i] & own[j]), len(own[i] | own[j])) for i in own for j in own if i < j and len(own[i] & own[j]) * 10 >= 7 * len(own[i] | own[j])}
    assert got == want
    groups = {r.id: r.group_id for r in dedup.greedy_groups(df, dedup.similar_pairs(sets, (7, 10))).collect()}
    assert groups == {0: 0, 1: 1, 2: 0, 3: 0}


def test_greedy_groups_are_not_components(spark):
    nodes = spark.range(5)
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "i long, j long")
    assert {r.id: r.group_id for r in dedup.greedy_groups(nodes, pairs).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}


def test_best_match_without_overlap(spark):
    q = dedup.shingle_sets(spark.createDataFrame([(0, TEXTS[2]), (1, "nothing in common")], "id long, text string"), "id", "text", 3)
    r = dedup.shingle_sets(spark.createDataFrame([(7, TEXTS[1]), (8, TEXTS[0])], "id long, text string"), "id", "text", 3)
    got = {x.i: (x.match, x.similarity > 0.7, x.flagged) for x in dedup.best_matches(q, r, (7, 10)).collect()}
    assert got == {0: (8, True, True), 1: (None, False, False)}


def test_near_duplicate_filter_drops_conflicting_groups(spark):
    rows = [(i, t, [i], y) for i, (t, y) in enumerate(zip(TEXTS, [0, 1, 1, 0], strict=True))]
    df = spark.createDataFrame(rows, "id long, text string, tokens array<int>, label int")
    assert {r.id for r in dedup.near_duplicate_filter(df, 3, (7, 10)).where("keep").collect()} == {1}


def test_stratified_split(spark):
    df = spark.range(1000).select(F.col("id").alias("idx"), (F.col("id") % 4 == 0).cast("int").alias("label"))
    rows = encode.stratified_split(df, "idx", "label").collect()
    sizes = {s: sum(r.split == s for r in rows) for s in ("train", "val", "test")}
    assert sizes == {"train": 800, "val": 100, "test": 100}
    assert sum(r.label for r in rows if r.split == "test") == 25


def test_integrity_and_fingerprint(spark):
    rows = [("a", 0, [1, 2, 9], 3, 0), ("a", 1, [1, 2, 3], 3, 1), ("b", 0, [9], 1, 2)]
    df = spark.createDataFrame(rows, "split string, idx long, tokens array<int>, length int, label int")
    got = {(r.split, r.rule): r.failures for r in encode.integrity(df, 4, 10, 9).collect()}
    assert got["a", "end"] == 1 and got["b", "length"] == 1 and got["b", "end"] == 0 and got["b", "label"] == 1
    a = encode.fingerprint(df, "split").where("split = 'a'").first().fingerprint
    b = encode.fingerprint(df.withColumn("label", 1 - F.col("label")), "split").where("split = 'a'").first().fingerprint
    assert a != b


def scored(spark, probs, labels):
    return spark.createDataFrame(list(zip(range(len(probs)), map(float, probs), labels, strict=True)), "idx long, prob double, label int")


def test_binary_metrics(spark):
    df = scored(spark, [0.9, 0.8, 0.5, 0.7, 0.1, 0.2, 0.3, 0.1, 0.2, 0.0], [1, 1, 1, 0, 1, 1, 0, 0, 0, 0])
    r = metrics.binary_metrics(df, 0.5).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (3, 1, 2, 4)
    assert (r.precision, r.recall) == (0.75, 0.6)
    none = metrics.binary_metrics(scored(spark, [0.1, 0.2, 0.3, 0.4], [1, 0, 0, 0]), 0.5).first()
    assert (none.precision, none.fbeta, none.accuracy) == (0, 0, 0.75)


def test_threshold_is_the_middle_of_the_tied_run(spark):
    df = scored(spark, [0.001, 0.005, 0.805, 0.9], [0, 0, 1, 1])
    r = metrics.choose_threshold(df).first()
    assert (r.threshold, r.tied) == (0.41, 80)


def test_ranking_metrics(spark):
    perfect = metrics.ranking_metrics(scored(spark, [0.1, 0.2, 0.8, 0.9], [0, 0, 1, 1])).first()
    assert tuple(perfect) == (1.0, 1.0, 1.0)
    reverse = metrics.ranking_metrics(scored(spark, [0.9, 0.8, 0.2, 0.1], [0, 0, 1, 1])).first()
    assert (reverse.roc_auc, reverse.recall_at_fpr) == (0.0, 0.0)
    df = scored(spark, [*(i / 1000 for i in range(98)), 0.8, 0.6, 0.9, 0.5], [0] * 100 + [1, 1])
    assert metrics.ranking_metrics(df).first().recall_at_fpr == 0.5


def test_calibration(spark):
    df = scored(spark, [0.8] * 4, [1, 1, 0, 0])
    assert math.isclose(metrics.ece(df).first().ece, 0.3) and math.isclose(metrics.brier(df).first().brier, 0.34)


def test_wilson_mcnemar_bootstrap(spark):
    lo, hi = (one(spark, c) for c in metrics.wilson(F.lit(0), F.lit(10)))
    assert lo == 0 and math.isclose(hi, 0.2775, abs_tol=1e-4)
    assert [one(spark, c) for c in metrics.wilson(F.lit(0), F.lit(0))] == [0.0, 1.0]
    rows = [(True, False)] * 10 + [(False, True)] * 2 + [(True, True)] * 5
    r = metrics.mcnemar(spark.createDataFrame(rows, "correct_a boolean, correct_b boolean")).first()
    assert (r.a_only, r.b_only) == (10, 2) and math.isclose(r.p, 2 * sum(math.comb(12, k) for k in range(3)) / 2**12)
    same = metrics.mcnemar(spark.createDataFrame([(True, True)], "correct_a boolean, correct_b boolean")).first()
    assert same.p == 1.0
    df = scored(spark, [(i % 10) / 10 for i in range(40)], [int(i % 10 > 4) for i in range(40)])
    ci = {r.metric: (r.lo, r.hi) for r in metrics.bootstrap(df, 0.5, 30).collect()}
    assert ci["accuracy"][0] <= 1.0 <= ci["accuracy"][1] + 1e-9


def test_exposure_report_has_empty_cells(spark):
    df = scored(spark, [0.9], [1]).withColumn("seen_share", F.lit(1.0))
    rows = {(r.label, r.seen): (r.n, r.lo, r.hi) for r in metrics.exposure_report(df, 0.5).collect()}
    assert len(rows) == 4 and rows[0, False] == (0, 0.0, 1.0)


def test_behaviour(spark):
    cases = spark.createDataFrame([("a", 0, ["x"], "", "Alice met Bob"), ("b", 1, ["x", "y"], "Hi", "no names")], "case_id string, label int, tags array<string>, subject string, body string")
    edited = behaviour.perturb(cases)
    names = {(r.edit, r.case_id) for r in edited.collect()}
    assert ("other names", "a") in names and ("other names", "b") not in names
    assert ("warm start", "a") not in names and ("appeal", "b") not in names
    pairs = behaviour.paired(edited, lambda x: F.when(x.contains("prize"), 0.9).otherwise(0.2))
    same = {r.edit for r in pairs.where("same").collect()}
    assert same == {"capitals", "small letters", "double spacing"}
    up = behaviour.directional(pairs, 0.5).first()
    assert (up.n, up.wrong_way, up.now_spam) == (1, 0, 1)
    assert {r.edit: r.flips for r in behaviour.invariance(pairs, 0.5).collect()}["closing lines"] == 0
    tags = {r.tag: r.labels for r in behaviour.by_tag(cases.withColumn("prob", F.lit(0.9)), 0.5).collect()}
    assert tags == {"x": "legit/spam", "y": "spam"}


def test_bigram_model_learns_a_cycle(spark):
    stream = spark.range(2000).select(F.col("id").alias("pos"), (F.col("id") % 4).cast("int").alias("token"))
    vocab = spark.range(10)
    pairs = lm.with_next(stream)
    uni, counts = lm.unigram_counts(stream, vocab), lm.bigram_counts(pairs)
    scored_pairs = lm.pair_probabilities(lm.distinct_pairs(pairs), uni, counts)
    best = lm.tune_share(scored_pairs).first()
    assert best.lam == 0.95 and best.loss < 0.1
    assert math.isclose(scored_pairs.agg(lm.weighted(-F.log("p_uni"))).first()[0], math.log(4), abs_tol=0.01)
    w = lm.lm_windows(pairs, 0, 2, 5).where("window = 1").orderBy("at").collect()
    assert [(r.a, r.b) for r in w] == [(i % 4, (i + 1) % 4) for i in range(5, 10)]


def test_runs_and_gate(spark):
    facts = "fbeta_lo double, fbeta_b double, same_split boolean, agreement double, wrong_a long, wrong_b long, changed long, perplexity_a double, perplexity_b double"
    check = lambda *row: {r.check: r.passed for r in runs.gate(spark.createDataFrame([row], facts)).collect()}
    good = check(0.8, 0.85, True, 0.995, 3, 4, 2, 50.0, 50.8)
    assert all(good.values())
    bad = check(0.8, 0.75, False, 1.0, 3, 3, 4, 50.0, 52.0)
    assert bad == {"fbeta within interval": False, "predictions agree": False, "challenge count": True, "challenge changes": False, "perplexity": False}
    skipped = runs.gate(spark.createDataFrame([(0.8, 0.85, True, 1.0, 3, 3, 0, None, 5.0)], facts))
    assert runs.verdict(skipped).first() == (True, 1)
    assert one(spark, runs.saved(F.lit(0.12345649))) == 0.123456


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "m.csv").write_text('text,spam\n"Subject: Hello  there",0\n"Subject:",1\n"two\nlines",1\n')
    got = {r.text for r in readers.read_messages(spark, str(tmp_path / "m.csv")).collect()}
    assert got == {"Subject: hello there", "Subject: two lines"}
    (tmp_path / "c.txt").write_text("# head\n=== one\nlabel: spam\ntags: a, b\nsubject: Re: x\n---\nFirst line\n\nsecond: not a header\n=== two\nlabel: legitimate\ntags:\nsubject:\n---\nbody\n=== three\ntags : c\n\n")
    cases = {r.case_id: r for r in readers.read_cases(spark, str(tmp_path / "c.txt")).collect()}
    assert cases["one"].subject == "Re: x" and cases["one"].body == "First line\n\nsecond: not a header" and cases["one"].tags == ["a", "b"]
    assert cases["two"].label == 0 and cases["two"].tags == []
    assert (cases["three"].label, cases["three"].tags, cases["three"].subject, cases["three"].body) == (None, ["c"], "", "") and len(cases) == 3
    (tmp_path / "p.txt").write_text("# no\n\nOne\\nline\nTwo\n")
    assert [r.prompt for r in readers.read_prompts(spark, str(tmp_path / "p.txt")).collect()] == ["One\nline", "Two"]
    df = spark.createDataFrame([("a", 0, [1], 1, 0), ("b", 0, [2], 1, 1)], readers.SPLIT)
    sinks.write_split(df, str(tmp_path / "s"))
    assert readers.read_split(spark, str(tmp_path / "s"), "b").select("tokens").first().tokens == [2]
    (tmp_path / "r.json").write_text('{"classifier": {"threshold": 0.5, "metrics": {"f1": 0.9}}, "challenge": {"wrong": ["x"]}}')
    run = readers.read_run(spark, str(tmp_path / "r.json")).first()
    assert run.lm is None and run.classifier.metrics["f1"] == 0.9
    assert readers.file_info(spark, str(tmp_path / "p.txt")).first().size == len("# no\n\nOne\\nline\nTwo\n")


def test_token_cache_blocks_and_edge_inputs(spark, tmp_path):
    stream = spark.range(100).select(F.col("id").alias("pos"), (F.col("id") % 7).alias("token"))
    sinks.write_tokens(stream, str(tmp_path / "t"))
    got = readers.read_tokens(spark, str(tmp_path / "t"), 10, 13).orderBy("pos").collect()
    assert [(r.pos, r.token) for r in got] == [(10, 3), (11, 4), (12, 5)] and readers.read_tokens(spark, str(tmp_path / "t"), 98).count() == 2
    rows = spark.createDataFrame([([1, 2],), ([1, 2, 3],)], "tokens array<int>")
    assert encode.fits_block(rows, "tokens", 3).count() == 2
    with pytest.raises(Exception, match="more than 2 tokens"):
        encode.fits_block(rows, "tokens", 2).collect()
    windows = lm.random_windows(lm.with_next(stream), 0, 100, 8, 3).groupBy("draw").agg(F.count("*").alias("n"), F.max("a").alias("top")).collect()
    assert len(windows) == 3 and all(r.n == 8 and r.top < 7 for r in windows)
    with pytest.raises(ValueError, match="doesn't fit"):
        lm.random_windows(lm.with_next(stream), 0, 8, 8, 1)
    assert behaviour.edge_inputs(spark).count() == 4
    assert readers.one_message(spark, stdin=io.StringIO("from a pipe")).first().body == "from a pipe"


def test_streaming_dedup(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"body": "x"}\n{"body": " x\\r\\n"}\n{"body": "y"}\n{"body": " "}\n')
    q = stream_dedup(spark.readStream.schema("body string").json(str(src)), "body").writeStream.format("memory").queryName("seen").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.body for r in spark.table("seen").collect()) == ["x", "y"]


def test_scorers(spark, tmp_path):
    rows = [(i, ("buy cheap pills now" if i % 3 == 0 else "meeting notes for monday") + f" item{i % 5}", int(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "idx long, text string, label int")
    model = scorers.TfIdfBaseline().fit(df, df)
    out = model(df)
    assert out.where((F.col("prob") >= model.threshold) != (F.col("label") == 1)).count() == 0
    assert scorers.classify(spark.createDataFrame([("", "buy cheap pills")], "subject string, body string"), model, 0.0).first().label == "spam"
    model.save(str(tmp_path / "model"))
    model.set_threshold(str(tmp_path / "model"), 0.4)
    again = scorers.TfIdfBaseline.load(spark, str(tmp_path / "model"))
    assert again.threshold == 0.4 and sorted(again(df).select("idx", "prob").collect()) == sorted(out.select("idx", "prob").collect())
    batch = scorers.batch_scorer(lambda: lambda tokens: [len(t) / 10 for t in tokens])
    assert batch(spark.createDataFrame([([1, 2],)], "tokens array<int>")).first().prob == 0.2
