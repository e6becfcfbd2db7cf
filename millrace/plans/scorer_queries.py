"""Queries of scorers, their checkpoints, the guard of the block, model sizes and run metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import encode, lm, metrics, runs, scorers
from millrace.plans.inputs import BLOCK, ENCODED, SCORED, SPLIT, encoded, read, scored, split_rows, sql_norm, sql_uniform, sql_words, uniform
from millrace.plans.lm_queries import STREAM
from millrace.storage import scratch_path, written

#: The threshold that a stored model is given after its fit.
STORED = 0.25


def classify_messages(spark, d):
    """Every document as a message under its source, cut to the block, by a scorer that depends on each character it is shown."""
    rows = read(spark, d, "documents").select("doc_id", F.col("source").alias("subject"), F.col("text").alias("body"))
    return scorers.classify(rows, lambda df: df.withColumn("prob", uniform(F.col("text"))), 0.5, BLOCK, "doc_id")


def _digest(batch: list) -> list[float]:
    """A score that depends on each token and its place."""
    return [float(sum((k + 1) * int(t) for k, t in enumerate(tokens)) % 1000) / 1000 for tokens in batch]


def batch_scores(spark, d):
    """Every labelled document's tokens by a plugged-in function of token lists."""
    rows, _ = encoded(spark, d)
    return scorers.batch_scorer(lambda: _digest)(rows).select("idx", "prob")


def baseline_parts(spark, d) -> dict[str, DataFrame]:
    """(idx, text, label) of the labelled documents, cut to the block, by split."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("idx"), F.array_join(F.slice(text.words(F.col("text")), 1, BLOCK - 1), " ").alias("text"))
    rows = written(docs.join(split_rows(spark, d), "idx"), "baseline-rows")
    return {name: rows.where(F.col("split") == name).select("idx", "text", "label") for name in ("train", "val", "test")}


def tfidf_metrics(spark, d):
    """The baseline fitted on the training part with its threshold from the validation part, on the test part."""
    parts = baseline_parts(spark, d)
    model = scorers.TfIdfBaseline().fit(parts["train"], parts["val"])
    return metrics.all_metrics(model(parts["test"]), model.threshold)


def checkpoint_scores(spark, d):
    """Whether a stored and loaded baseline scores the test part as the fitted one does, and the threshold it was given when stored."""
    parts = baseline_parts(spark, d)
    model = scorers.TfIdfBaseline().fit(parts["train"], parts["val"])
    path = scratch_path(spark, "checkpoint")
    model.save(path)
    model.set_threshold(path, STORED)
    again = scorers.TfIdfBaseline.load(spark, path)
    both = model(parts["test"]).select("idx", F.col("prob").alias("own")).join(again(parts["test"]).select("idx", "prob"), "idx")
    return both.select("idx", (F.abs(F.col("own") - F.col("prob")) < 1e-12).alias("same"), F.lit(again.threshold).alias("threshold"))


def block_guard(spark, d):
    """Encoded rows behind the guard, which would raise on one longer than the block."""
    rows, _ = encoded(spark, d)
    return encode.fits_block(rows, "tokens", BLOCK).groupBy("split").agg(F.count("*").alias("n"), F.max("length").cast("int").alias("longest"))


def model_sizes(spark, d):
    """Entries of the vocabularies and of the n-gram models fitted on all documents; none is made where its entries can be told apart without."""
    docs, ws = read(spark, d, "documents").select("doc_id", "text"), text.words(F.col("text"))
    chars = docs.select(F.explode(text.characters(F.col("text"))).alias("ch")).distinct()
    words = written(docs.select(F.explode(ws).alias("token")).distinct(), "words")
    pairs = lm.word_pairs(docs, "doc_id", ws, lm.separating_seed(words, "token")).distinct()
    n = F.count("*")
    successors = pairs.groupBy("a").agg(n.alias("n"))
    return lm.model_sizes(
        chars.agg(n.alias("characters")), words.agg(n.alias("words"), (n + 1).alias("unigram")),
        successors.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("bigram"), n.alias("contexts")),
    )


def run_metadata(spark, d):
    """Facts of two runs side by side: one over all labelled documents, the other over its training part, whose settings differ."""
    everything = scored(spark, d).agg(F.count("*").alias("rows"), F.sum("label").alias("positive"), F.max("prob").alias("highest"))
    train = split_rows(spark, d).where("split = 'train'").agg(F.count("*").alias("rows"), F.sum("label").alias("positive"), F.first("split").alias("split"))
    facts = lambda df: df.select(*(F.col(c).cast("string").alias(c) for c in df.columns)).unpivot([], df.columns, "key", "value")
    return runs.run_meta(facts(everything), facts(train))


QUERIES = {f.__name__: f for f in (classify_messages, batch_scores, tfidf_metrics, checkpoint_scores, block_guard, model_sizes, run_metadata)}

_SHOWN = f"array_to_string(w[1:{BLOCK - 1}], ' ')"
_SIZES = {
    "characters": "SELECT count(DISTINCT ch) FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> ''",
    "words": "SELECT count(*) FROM vocabulary",
    "unigram": "SELECT count(*) + 1 FROM vocabulary",
    "bigram": "SELECT count(*) FROM (SELECT DISTINCT a, b FROM follow)",
    "contexts": "SELECT count(DISTINCT a) FROM follow",
}
ORACLES = {
    "classify_messages": f"""WITH m AS (SELECT doc_id, {sql_words(f"'Subject: ' || {sql_norm("coalesce(source, '') || ' ' || coalesce(text, '')")}")} AS w FROM documents), p AS (SELECT doc_id, {sql_uniform(_SHOWN)} AS prob, len(w) >= {BLOCK} AS truncated FROM m)
      SELECT doc_id, CASE WHEN prob >= 0.5e0 THEN 'spam' ELSE 'legitimate' END AS label, prob, truncated FROM p""",
    "batch_scores": f"WITH {ENCODED} SELECT idx, (list_sum(list_transform(tokens, lambda t, i: t * i))::BIGINT % 1000)::DOUBLE / 1000 AS prob FROM encoded",
    "checkpoint_scores": f"WITH {SPLIT} SELECT idx, true AS same, {STORED}e0 AS threshold FROM split_rows WHERE split = 'test'",
    "block_guard": f"WITH {ENCODED} SELECT split, count(*) AS n, max(length)::INTEGER AS longest FROM encoded GROUP BY split",
    "model_sizes": f"WITH {STREAM}, follow AS (SELECT a.token AS a, b.token AS b FROM stream a JOIN stream b ON b.pos = a.pos + 1) " + " UNION ALL ".join(f"SELECT '{k}' AS part, ({q}) AS n" for k, q in _SIZES.items()),
    "run_metadata": f"""WITH {SPLIT}, {SCORED}, a AS (SELECT count(*) AS rows, sum(label) AS positive, max(prob) AS highest FROM scored), b AS (SELECT count(*) AS rows, sum(label) AS positive FROM split_rows WHERE split = 'train')
      SELECT 'rows' AS key, a.rows::VARCHAR AS a, b.rows::VARCHAR AS b FROM a, b UNION ALL SELECT 'positive', a.positive::VARCHAR, b.positive::VARCHAR FROM a, b UNION ALL SELECT 'highest', highest::VARCHAR, '-' FROM a UNION ALL SELECT 'split', '-', 'train'""",
}
