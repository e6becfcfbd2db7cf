"""Queries of metrics, behavioural tests, run comparison and the gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import behaviour, metrics, runs
from millrace.plans.inputs import CASES, SCORED, cases, read, scored, sql_norm, sql_score, sql_uniform, stand_in_score, uniform
from millrace.storage import written

T = 0.5
REPLICATES = 1000


def _rounded(df, *keep):
    return df.select(*[F.round(c, 9).alias(c) if kind == "double" and c not in keep else F.col(c) for c, kind in df.dtypes])


def binary_metrics(spark, d):
    return _rounded(metrics.binary_metrics(scored(spark, d), T))


def brier(spark, d):
    return _rounded(metrics.brier(scored(spark, d)))


def ece(spark, d):
    return _rounded(metrics.ece(scored(spark, d)))


def roc_auc(spark, d):
    return _rounded(metrics.ranking_metrics(scored(spark, d)).select("roc_auc"))


def pr_auc(spark, d):
    return _rounded(metrics.ranking_metrics(scored(spark, d)).select("pr_auc"))


def recall_at_fpr(spark, d):
    return _rounded(metrics.ranking_metrics(scored(spark, d)).select("recall_at_fpr"))


def all_metrics(spark, d):
    return _rounded(metrics.all_metrics(scored(spark, d), T))


def choose_threshold(spark, d):
    return metrics.choose_threshold(scored(spark, d))


def wilson(spark, d):
    """The interval of each label's share among every source's documents; sources without labelled rows have the whole range."""
    rows = read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    counts = rows.groupBy("source").agg(F.count_if(F.col("toxic") == 1).alias("k"), F.count("toxic").alias("n"))
    lo, hi = metrics.wilson(F.col("k"), F.col("n"))
    return _rounded(counts.select("source", "k", "n", lo.alias("lo"), hi.alias("hi")))


def mcnemar(spark, d):
    right = (F.col("prob") >= T) == (F.col("label") == 1)
    a = scored(spark, d).select("idx", right.alias("correct_a"))
    b = scored(spark, d, "b").select("idx", right.alias("correct_b"))
    return _rounded(metrics.mcnemar(a.join(b, "idx")))


def bootstrap_ci(spark, d):
    return _rounded(metrics.resampled(scored(spark, d), T, REPLICATES))


def metrics_report(spark, d):
    """The whole report: each metric with its interval."""
    return _rounded(metrics.metrics_report(scored(spark, d), T, REPLICATES))


def challenge_report(spark, d):
    """The whole challenge report: flagged cases by label, right ones by tag, edits that must not and that may only one way change a decision."""
    rows, pairs = _scored_cases(spark, d), written(_pairs(spark, d).select("edit", "p0", "p1", "same"), "edited-pairs")  # once, for both sections
    return behaviour.report(rows, pairs, T)


def error_report(spark, d):
    return metrics.error_report(scored(spark, d), T, 10)


def class_weights(spark, d):
    return _rounded(metrics.class_weights(scored(spark, d)))


def confusion_by_source(spark, d):
    """The console report's counts, by source."""
    rows = scored(spark, d).join(read(spark, d, "documents").select(F.col("doc_id").alias("idx"), "source"), "idx")
    return _rounded(metrics.binary_metrics(rows, T, by=("source",)).select("source", "tp", "fp", "fn", "tn", "accuracy", "precision", "recall"))


def _scored_cases(spark, d):
    return cases(spark, d).withColumn("prob", stand_in_score(F.col("case_id"), F.col("label")))


def by_tag(spark, d):
    return behaviour.by_tag(_scored_cases(spark, d), T)


def flag_rates(spark, d):
    return behaviour.flag_rates(_scored_cases(spark, d), T)


def edges_fine(spark, d):
    """The edge inputs beside the ordinary turns."""
    edges = behaviour.edge_inputs(spark).select(uniform(text.format_message(F.col("subject"), F.col("body"))).alias("prob"))
    return behaviour.edges_fine(edges.union(_scored_cases(spark, d).select("prob")))


_EDITS = behaviour.EDITS


def perturb(spark, d):
    out = behaviour.perturb(cases(spark, d))
    return out.select("edit", "case_id", F.md5("new_subject").alias("subject_md5"), F.md5("new_body").alias("body_md5"))


def _pairs(spark, d):
    return behaviour.edited_pairs(cases(spark, d), uniform)


def invariance(spark, d):
    return behaviour.invariance(_pairs(spark, d), T)


def directional(spark, d):
    return _rounded(behaviour.directional(_pairs(spark, d), T))


def _second(spark, d):
    """A second run: one score in fifty is another one."""
    a, b = scored(spark, d), scored(spark, d, "b").select("idx", F.col("prob").alias("other"))
    return a.join(b, "idx").select("idx", F.when(F.col("idx") % 50 == 1, F.col("other")).otherwise(F.col("prob")).alias("prob"), "label")


def run_agreement(spark, d):
    a, b = scored(spark, d), _second(spark, d)
    return _rounded(runs.run_agreement(a, b, T, T).crossJoin(runs.same_split(a, b)).where("same_split").drop("same_split"))


def _wrong(df):
    return df.where((F.col("prob") >= T) != (F.col("label") == 1)).select(F.col("idx").alias("case_id"))


def challenge_changes(spark, d):
    return runs.challenge_changes(_wrong(scored(spark, d)), _wrong(_second(spark, d)))


def tags_diff(spark, d):
    first = _scored_cases(spark, d)
    second = first.where("not array_contains(tags, 'short')").withColumn("prob", stand_in_score(F.concat(F.lit("b"), F.col("case_id")), F.col("label")))
    return runs.tags_diff(behaviour.by_tag(first, T), behaviour.by_tag(second, T))


_NAMES = ["accuracy", "precision", "recall", "f1", "fbeta"]


def _long(df):
    return metrics.binary_metrics(df, T).unpivot([], _NAMES, "metric", "value")


def metric_deltas(spark, d):
    a, b = _long(scored(spark, d)), _long(_second(spark, d))
    return _rounded(runs.metric_deltas(a, b, a.select("metric", (F.col("value") - 0.001).alias("lo"), (F.col("value") + 0.001).alias("hi"))))


def error_deltas(spark, d):
    """False positives and negatives of two runs."""
    return runs.error_deltas(metrics.binary_metrics(scored(spark, d), T), metrics.binary_metrics(_second(spark, d), T))


_SPEED = {"single_ms": (2.5, 2.0), "per_second": (400.0, 520.0)}


def speed_and_lm(spark, d):
    """Speeds as ratios and language-model figures as differences; what either run lacks is left out."""
    frame = lambda k: spark.createDataFrame([(n, v[k]) for n, v in _SPEED.items()], "metric string, value double")
    lm_a, lm_b = metrics.brier(scored(spark, d)), metrics.brier(_second(spark, d))
    return _rounded(runs.speed_and_lm(frame(0), frame(1), lm_a.select(F.lit("loss").alias("metric"), F.col("brier").alias("value")), lm_b.select(F.lit("loss").alias("metric"), F.col("brier").alias("value"))))


def run_sections(spark, d):
    """A run document put together from its sections."""
    rows = scored(spark, d)
    wrong = _wrong(rows).agg(F.sort_array(F.collect_list(F.col("case_id").cast("string"))).alias("wrong"))
    m = metrics.binary_metrics(rows, T)
    out = runs.assemble(classifier=m.select("threshold", runs.saved(F.col("accuracy")).alias("accuracy"), "tp", "fp"), challenge=wrong.select(F.size("wrong").alias("n_wrong")))
    return out.select(F.get_json_object("document", "$.classifier.tp").cast("bigint").alias("tp"), F.get_json_object("document", "$.classifier.accuracy").cast("double").alias("accuracy"), F.get_json_object("document", "$.challenge.n_wrong").cast("bigint").alias("n_wrong"))


def failing_gate(spark, d):
    """The gate with a language model that got worse and a second run on a split in which one label is another one."""
    b = _second(spark, d)
    changed = b.agg(F.min("idx").alias("one"))
    b = b.crossJoin(F.broadcast(changed)).withColumn("label", F.when(F.col("idx") == F.col("one"), 1 - F.col("label")).otherwise(F.col("label")))
    same = runs.same_split(scored(spark, d), b)
    worse = _facts(spark, d).drop("same_split").crossJoin(same).withColumns({"perplexity_a": F.lit(50.0), "perplexity_b": F.lit(50.0) * (1 + F.col("agreement") / 20)})
    return runs.gate(worse)


def _facts(spark, d):
    a, b = scored(spark, d), _second(spark, d)
    wrong_a, wrong_b = _wrong(a), _wrong(b)
    parts = [
        metrics.binary_metrics(a, T).select((F.col("fbeta") - 0.01).alias("fbeta_lo")), metrics.binary_metrics(b, T).select(F.col("fbeta").alias("fbeta_b")),
        runs.run_agreement(a, b, T, T).select("agreement"), wrong_a.agg(F.count("*").alias("wrong_a")), wrong_b.agg(F.count("*").alias("wrong_b")),
        runs.challenge_changes(wrong_a, wrong_b).agg(F.count("*").alias("changed")),
    ]
    one = reduce(lambda x, y: x.crossJoin(y), parts)  # rows of one row each
    return one.crossJoin(runs.same_split(a, b)).select("*", F.lit(None).cast("double").alias("perplexity_a"), F.lit(None).cast("double").alias("perplexity_b"))


def gate(spark, d):
    return runs.gate(_facts(spark, d))


def gate_verdict(spark, d):
    return runs.verdict(runs.gate(_facts(spark, d)))


def run_spread(spark, d):
    each = [_long(scored(spark, d, s)).withColumn("run", F.lit(s)) for s in ("", "b", "c")]
    return _rounded(runs.run_spread(reduce(lambda x, y: x.union(y), each)))


def run_json(spark, d):
    m = metrics.binary_metrics(scored(spark, d), T)
    return m.select(runs.run_document(accuracy=runs.saved(F.col("accuracy")), tp=F.col("tp"), fp=F.col("fp")).alias("document"))


QUERIES = {f.__name__: f for f in (binary_metrics, brier, ece, roc_auc, pr_auc, recall_at_fpr, all_metrics, choose_threshold, wilson, mcnemar, bootstrap_ci, metrics_report, challenge_report, error_report, class_weights, confusion_by_source, by_tag, flag_rates, edges_fine, perturb, invariance, directional, run_agreement, challenge_changes, tags_diff, metric_deltas, error_deltas, speed_and_lm, run_sections, failing_gate, gate, gate_verdict, run_spread, run_json)}

_COUNTS = "count(*) FILTER (prob >= {t} AND label = 1) AS tp, count(*) FILTER (prob >= {t} AND label = 0) AS fp, count(*) FILTER (prob < {t} AND label = 1) AS fn, count(*) FILTER (prob < {t} AND label = 0) AS tn"
_C = _COUNTS.format(t="0.5e0")


def _derived(source: str) -> str:
    """accuracy ... fbeta over rows with tp, fp, fn, tn."""
    return f"""(SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, coalesce(1.25e0 * precision * recall / nullif(0.25e0 * precision + recall, 0), 0) AS fbeta
      FROM (SELECT *, (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS accuracy, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall FROM {source}))"""


def _round(*names: str) -> str:
    return ", ".join(f"round({n}, 9) AS {n}" for n in names)


_RANK = f"""{SCORED}, byscore AS (SELECT prob, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM scored GROUP BY prob),
  down AS (SELECT *, sum(p) OVER (ORDER BY prob DESC)::DOUBLE AS tp, sum(n) OVER (ORDER BY prob DESC)::DOUBLE AS fp, sum(p) OVER ()::DOUBLE AS pp, sum(n) OVER ()::DOUBLE AS nn FROM byscore),
  ranking AS (SELECT sum(p * (nn - fp + n / 2e0)) / any_value(pp) / any_value(nn) AS roc_auc, sum(p * tp / (tp + fp)) / any_value(pp) AS pr_auc,
    coalesce(max(tp / pp) FILTER (fp / nn <= 0.01e0), 0) AS recall_at_fpr FROM down)"""
_ECE = "(SELECT sum(abs(p - y)) / sum(n) AS ece FROM (SELECT sum(prob) AS p, sum(label) AS y, count(*) AS n FROM scored GROUP BY least(floor(prob * 10), 9)))"
SQL_WILSON = _WIL = "CASE WHEN n = 0 THEN 0e0 ELSE greatest(0e0, ((p + 3.8416e0 / (2e0 * n)) - 1.96e0 * sqrt(p * (1 - p) / n + 3.8416e0 / (4e0 * n * n))) / (1 + 3.8416e0 / n)) END AS lo, CASE WHEN n = 0 THEN 1e0 ELSE least(1e0, ((p + 3.8416e0 / (2e0 * n)) + 1.96e0 * sqrt(p * (1 - p) / n + 3.8416e0 / (4e0 * n * n))) / (1 + 3.8416e0 / n)) END AS hi"
_B = f"other AS (SELECT doc_id AS idx, {sql_score(chr(39) + 'b' + chr(39) + ' || doc_id::VARCHAR', 'toxic')} AS prob, toxic::INTEGER AS label FROM labels)"
_SECOND = f"{SCORED}, {_B}, second AS (SELECT s.idx, CASE WHEN s.idx % 50 = 1 THEN o.prob ELSE s.prob END AS prob, s.label FROM scored s JOIN other o USING (idx))"
_WRONGS = f"{_SECOND}, wrong_a AS (SELECT idx AS case_id FROM scored WHERE (prob >= 0.5e0) <> (label = 1)), wrong_b AS (SELECT idx AS case_id FROM second WHERE (prob >= 0.5e0) <> (label = 1)), changes AS (SELECT case_id, 'newly wrong' AS change FROM wrong_b ANTI JOIN wrong_a USING (case_id) UNION ALL SELECT case_id, 'newly right' FROM wrong_a ANTI JOIN wrong_b USING (case_id))"
_AGREE = "agree AS (SELECT avg(((pa >= 0.5e0) = (pb >= 0.5e0))::INTEGER) AS agreement, count(*) FILTER ((pa >= 0.5e0) <> (pb >= 0.5e0)) AS changed, avg(abs(pa - pb)) AS mean_abs_dp, max(abs(pa - pb)) AS max_abs_dp FROM (SELECT round_even(s.prob, 6) AS pa, round_even(t.prob, 6) AS pb FROM scored s JOIN second t USING (idx)))"
_GATE = f"""{_WRONGS}, {_AGREE}, facts AS (SELECT (SELECT fbeta - 0.01e0 FROM {_derived(f'(SELECT {_C} FROM scored)')}) AS fbeta_lo, (SELECT fbeta FROM {_derived(f'(SELECT {_C} FROM second)')}) AS fbeta_b, (SELECT agreement FROM agree) AS agreement,
   (SELECT count(*) FROM wrong_a) AS wrong_a, (SELECT count(*) FROM wrong_b) AS wrong_b, (SELECT count(*) FROM changes) AS changed),
  checks AS (SELECT 'fbeta within interval' AS "check", fbeta_b >= fbeta_lo AS passed FROM facts UNION ALL SELECT 'predictions agree', agreement >= 0.99e0 FROM facts UNION ALL SELECT 'challenge count', wrong_b - wrong_a <= 1 FROM facts
   UNION ALL SELECT 'challenge changes', changed <= 2 FROM facts UNION ALL SELECT 'perplexity', NULL)"""


def _cases_scored(salt: str = "''") -> str:
    return f"(SELECT *, {sql_score(salt + ' || case_id', 'label')} AS prob FROM cases)"


def _tags(source: str) -> str:
    return f"(SELECT tag, count(*) AS n, count(*) FILTER ((prob >= 0.5e0) = (label = 1)) AS correct, array_to_string(list_sort(list_distinct(list(CASE label WHEN 0 THEN 'legit' ELSE 'spam' END))), '/') AS labels FROM (SELECT unnest(tags) AS tag, label, prob FROM {source}) GROUP BY tag)"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_WORDLIST = "[" + ", ".join(f"'{k}'" for k in behaviour.NAMES) + "]"
_SWAP = lambda c: f"array_to_string(list_transform(regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'), lambda w: CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in behaviour.NAMES.items()) + " ELSE w END), '')"
_PERTURB = f"""{CASES}, perturbed AS (
  SELECT 'capitals' AS edit, case_id, label, subject, body, upper(replace(subject, 'ß', 'SS')) AS new_subject, upper(replace(body, 'ß', 'SS')) AS new_body FROM cases
  UNION ALL SELECT 'small letters', case_id, label, subject, body, lower(subject), lower(body) FROM cases
  UNION ALL SELECT 'double spacing', case_id, label, subject, body, subject, replace(replace(body, ' ', '  '), chr(10), chr(10) || chr(10)) FROM cases
  UNION ALL SELECT 'subject led by ' || word, case_id, label, subject, body, word || ': ' || subject, body FROM cases, (VALUES ('Fwd'), ('Re')) w(word)
  UNION ALL SELECT 'other names', case_id, label, subject, body, {_SWAP('subject')}, {_SWAP('body')} FROM cases WHERE len(list_intersect(regexp_extract_all(subject || ' ' || body, '[\\p{{L}}\\p{{N}}_]+'), {_WORDLIST})) > 0
  UNION ALL SELECT 'closing lines', case_id, label, subject, body, subject, body || {_text(behaviour.SIGNATURE)} FROM cases
  UNION ALL SELECT 'legal notice', case_id, label, subject, body, subject, body || {_text(behaviour.DISCLAIMER)} FROM cases
  UNION ALL SELECT 'warm start', case_id, label, subject, body, subject, {_text(behaviour.OPENER)} || body FROM cases WHERE label = 1
  UNION ALL SELECT 'appeal', case_id, label, subject, body, subject, body || {_text(behaviour.CALL)} FROM cases WHERE label = 0
)"""
_SEEN = lambda s, b: f"array_to_string(string_split('Subject: ' || {sql_norm(s + ' || chr(32) || ' + b)}, ' ')[1:255], ' ')"
_PAIRED = f"{_PERTURB}, inputs AS (SELECT edit, label, {_SEEN('subject', 'body')} AS x0, {_SEEN('new_subject', 'new_body')} AS x1 FROM perturbed), pairs AS (SELECT edit, {sql_uniform('x0')} AS p0, {sql_uniform('x1')} AS p1, x0 = x1 AS same FROM inputs)"
_M = ("accuracy", "precision", "recall", "f1", "fbeta")


def _longer(table: str) -> str:
    return f"(UNPIVOT (SELECT {', '.join(_M)} FROM {_derived(f'(SELECT {_C} FROM {table})')}) ON {', '.join(_M)} INTO NAME metric VALUE value)"


_UNIT = lambda e: f"CAST('0x' || substr(md5({e}), 1, 8) AS BIGINT)"
_P = metrics.PRIME
_BOOTSTRAP = f"""{SCORED}, reps AS (SELECT rep, 1 + {_UNIT("'0:a:' || rep::VARCHAR")} % {_P - 1} AS a, {_UNIT("'0:b:' || rep::VARCHAR")} % {_P} AS b FROM range({REPLICATES}) r(rep)),
      draws AS (SELECT rep, prob, label, (a * ({_UNIT("'0:' || idx::VARCHAR")} % {_P}) + b) % {_P} AS u FROM scored, reps),
      sample AS (SELECT rep, prob, label, least(floor(prob * 10000), 9999) AS bin, {' + '.join(f'(u >= {k})::INTEGER' for k in metrics.LIMITS)} AS w FROM draws WHERE u >= {metrics.LIMITS[0]}),
      bybin AS (SELECT rep, bin, coalesce(sum(w) FILTER (label = 1), 0) AS p, coalesce(sum(w) FILTER (label = 0), 0) AS n FROM sample GROUP BY rep, bin),
      downwards AS (SELECT *, sum(p) OVER (PARTITION BY rep ORDER BY bin DESC)::DOUBLE AS tp, sum(n) OVER (PARTITION BY rep ORDER BY bin DESC)::DOUBLE AS fp, sum(p) OVER (PARTITION BY rep)::DOUBLE AS pp, sum(n) OVER (PARTITION BY rep)::DOUBLE AS nn FROM bybin),
      rankings AS (SELECT rep, sum(p * (nn - fp + n / 2e0)) / any_value(pp) / any_value(nn) AS roc_auc, sum(p * tp / (tp + fp)) / any_value(pp) AS pr_auc, coalesce(max(tp / pp) FILTER (fp / nn <= 0.01e0), 0) AS recall_at_fpr FROM downwards WHERE pp > 0 AND nn > 0 GROUP BY rep),
      calibration AS (SELECT rep, sum(abs(p - y)) / sum(n) AS ece FROM (SELECT rep, sum(w * prob) AS p, sum(w * label) AS y, sum(w) AS n FROM sample GROUP BY rep, least(floor(prob * 10), 9)) GROUP BY rep),
      counted AS (SELECT rep, {', '.join(f"coalesce(sum(w) FILTER (prob {o} 0.5e0 AND label = {y}), 0) AS {k}" for k, o, y in (('tp', '>=', 1), ('fp', '>=', 0), ('fn', '<', 1), ('tn', '<', 0)))}, sum(w * (prob - label) * (prob - label)) / sum(w) AS brier FROM sample GROUP BY rep),
      resampled AS (SELECT rep, {', '.join(_M)}, roc_auc, pr_auc, recall_at_fpr, brier, ece FROM {_derived('counted')} JOIN rankings USING (rep) JOIN calibration USING (rep)),
      long AS (UNPIVOT resampled ON {', '.join(_M)}, roc_auc, pr_auc, recall_at_fpr, brier, ece INTO NAME metric VALUE value),
      ci AS (SELECT metric, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM long GROUP BY metric)"""
ORACLES = {
    "binary_metrics": f"WITH {SCORED} SELECT 0.5e0 AS threshold, tp, fp, fn, tn, {_round(*_M)} FROM {_derived(f'(SELECT {_C} FROM scored)')}",
    "brier": f"WITH {SCORED} SELECT round(avg((prob - label) * (prob - label)), 9) AS brier FROM scored",
    "ece": f"WITH {SCORED} SELECT round(ece, 9) AS ece FROM {_ECE}",
    **{n: f"WITH {_RANK} SELECT round({n}, 9) AS {n} FROM ranking" for n in ("roc_auc", "pr_auc", "recall_at_fpr")},
    "all_metrics": f"WITH {_RANK} SELECT 0.5e0 AS threshold, tp, fp, fn, tn, {_round(*_M, 'roc_auc', 'pr_auc', 'recall_at_fpr', 'brier', 'ece')} FROM {_derived(f'(SELECT {_C} FROM scored)')}, ranking, (SELECT avg((prob - label) * (prob - label)) AS brier FROM scored), {_ECE}",
    "choose_threshold": f"""WITH {SCORED}, cuts AS (SELECT k, k / 100e0 AS cut FROM range(1, 100) t(k)), swept AS (SELECT k, {_COUNTS.format(t='cut')} FROM cuts, scored GROUP BY k),
      scores AS (SELECT k, fbeta FROM {_derived('swept')}), tied AS (SELECT k, k - row_number() OVER (ORDER BY k) AS run FROM scores WHERE abs(fbeta - (SELECT max(fbeta) FROM scores)) <= 1e-8 + 1e-5 * (SELECT max(fbeta) FROM scores)),
      runs AS (SELECT count(*) AS n, min(k) AS f FROM tied GROUP BY run ORDER BY n DESC, f LIMIT 1) SELECT (f + n // 2) / 100e0 AS threshold, n AS tied FROM runs""",
    "wilson": f"SELECT source, k, n, round(lo, 9) AS lo, round(hi, 9) AS hi FROM (SELECT source, k, n, {_WIL} FROM (SELECT source, k, n, coalesce(k::DOUBLE / nullif(n, 0), 0) AS p FROM (SELECT source, count(*) FILTER (toxic = 1) AS k, count(toxic) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)))",
    "mcnemar": f"""WITH {SCORED}, {_B}, c AS (SELECT count(*) FILTER (a AND NOT b) AS a_only, count(*) FILTER (b AND NOT a) AS b_only FROM (SELECT (s.prob >= 0.5e0) = (s.label = 1) AS a, (o.prob >= 0.5e0) = (o.label = 1) AS b FROM scored s JOIN other o USING (idx)))
      SELECT a_only, b_only, round(CASE WHEN a_only + b_only = 0 THEN 1e0 ELSE least(1e0, 2 * (SELECT sum(exp(lgamma(a_only + b_only + 1) - lgamma(k + 1) - lgamma(a_only + b_only - k + 1) - (a_only + b_only) * ln(2e0))) FROM range(0, 1000) t(k) WHERE k <= least(a_only, b_only))) END, 9) AS p FROM c""",
    "bootstrap_ci": f"""WITH {SCORED}, numbered AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS i, prob, label FROM scored), size AS (SELECT count(*) AS n FROM numbered),
      draws AS (SELECT rep, CAST('0x' || substr(md5('0:' || rep::VARCHAR || ':' || d.i::VARCHAR), 1, 8) AS BIGINT) % n AS i FROM range({REPLICATES}) r(rep), size, numbered d),
      sample AS (SELECT rep, prob, label FROM draws JOIN numbered USING (i)),
      byscore AS (SELECT rep, prob, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM sample GROUP BY rep, prob),
      down AS (SELECT *, sum(p) OVER (PARTITION BY rep ORDER BY prob DESC)::DOUBLE AS tp, sum(n) OVER (PARTITION BY rep ORDER BY prob DESC)::DOUBLE AS fp, sum(p) OVER (PARTITION BY rep)::DOUBLE AS pp, sum(n) OVER (PARTITION BY rep)::DOUBLE AS nn FROM byscore),
      ranking AS (SELECT rep, sum(p * (nn - fp + n / 2e0)) / any_value(pp) / any_value(nn) AS roc_auc, sum(p * tp / (tp + fp)) / any_value(pp) AS pr_auc, coalesce(max(tp / pp) FILTER (fp / nn <= 0.01e0), 0) AS recall_at_fpr FROM down GROUP BY rep),
      calibration AS (SELECT rep, sum(abs(p - y)) / sum(n) AS ece FROM (SELECT rep, sum(prob) AS p, sum(label) AS y, count(*) AS n FROM sample GROUP BY rep, least(floor(prob * 10), 9)) GROUP BY rep),
      m AS (SELECT rep, {', '.join(_M)}, roc_auc, pr_auc, recall_at_fpr, brier, ece FROM {_derived(f'(SELECT rep, {_C}, avg((prob - label) * (prob - label)) AS brier FROM sample GROUP BY rep)')} JOIN ranking USING (rep) JOIN calibration USING (rep) WHERE tp + fn > 0 AND fp + tn > 0),
      long AS (UNPIVOT m ON {', '.join(_M)}, roc_auc, pr_auc, recall_at_fpr, brier, ece INTO NAME metric VALUE value)
      SELECT metric, round(quantile_cont(value, 0.025), 9) AS lo, round(quantile_cont(value, 0.975), 9) AS hi FROM long GROUP BY metric""",
    "metrics_report": f"""WITH {_RANK}, {_BOOTSTRAP.removeprefix(SCORED + ', ')}, wide AS (SELECT {', '.join(_M)}, roc_auc, pr_auc, recall_at_fpr, brier, ece FROM {_derived(f'(SELECT {_C} FROM scored)')}, ranking, (SELECT avg((prob - label) * (prob - label)) AS brier FROM scored), {_ECE}),
      tall AS (UNPIVOT wide ON {', '.join(_M)}, roc_auc, pr_auc, recall_at_fpr, brier, ece INTO NAME metric VALUE value) SELECT metric, round(value, 9) AS value, round(lo, 9) AS lo, round(hi, 9) AS hi FROM tall JOIN ci USING (metric)""",
    "error_report": f"""WITH {SCORED}, k AS (SELECT *, CASE WHEN prob >= 0.5e0 AND label = 0 THEN 'false positive' WHEN prob < 0.5e0 AND label = 1 THEN 'false negative' ELSE 'near miss' END AS kind FROM scored),
      o AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY CASE kind WHEN 'false positive' THEN -prob WHEN 'false negative' THEN prob ELSE abs(prob - 0.5e0) END, idx)::INTEGER AS rank FROM k)
      SELECT kind, rank, idx, label, prob FROM o WHERE kind <> 'near miss' OR rank <= 10""",
    "class_weights": f"WITH {SCORED} SELECT label, n, round(sum(n) OVER () / ((count(*) OVER ()) * n)::DOUBLE, 9) AS weight FROM (SELECT label, count(*) AS n FROM scored GROUP BY label)",
    "confusion_by_source": f"WITH {SCORED} SELECT source, tp, fp, fn, tn, {_round('accuracy', 'precision', 'recall')} FROM {_derived(f'(SELECT source, {_C} FROM scored JOIN documents ON doc_id = idx GROUP BY source)')}",
    "by_tag": f"WITH {CASES} SELECT tag, n, correct, labels FROM {_tags(_cases_scored())}",
    "flag_rates": f"WITH {CASES}, c AS (SELECT label, count(*) AS n, count(*) FILTER (prob >= 0.5e0) AS flagged FROM {_cases_scored()} GROUP BY label), w AS (SELECT *, {_WIL} FROM (SELECT *, flagged::DOUBLE / n AS p FROM c)) SELECT label, n, flagged, flagged::VARCHAR || '/' || n::VARCHAR || ' [' || floor(lo * 1000)::BIGINT::VARCHAR || '-' || floor(hi * 1000)::BIGINT::VARCHAR || ']' AS shown FROM w",
    "edges_fine": f"WITH {CASES} SELECT bool_and(prob BETWEEN 0 AND 1) AS fine FROM {_cases_scored()}",
    "perturb": f"WITH {_PERTURB} SELECT edit, case_id, md5(new_subject) AS subject_md5, md5(new_body) AS body_md5 FROM perturbed",
    "challenge_report": f"""WITH {_PAIRED}, names AS (SELECT unnest([{', '.join(chr(39) + e.name + chr(39) for e in _EDITS if not e.direction)}]) AS edit), right_cases AS (SELECT *, (prob >= 0.5e0) = (label = 1) AS good FROM {_cases_scored()})
      SELECT 'flagged' AS section, CASE label WHEN 0 THEN 'legitimate' ELSE 'spam' END AS name, count(*) AS n, NULL::BIGINT AS unchanged, count(*) FILTER (prob >= 0.5e0) AS k FROM right_cases GROUP BY label
      UNION ALL SELECT 'tag', tag, count(*), NULL, count(*) FILTER (good) FROM (SELECT unnest(tags) AS tag, good FROM right_cases) GROUP BY tag
      UNION ALL SELECT 'invariance', n.edit, count(p.p0), count(*) FILTER (same), count(*) FILTER ((p0 >= 0.5e0) <> (p1 >= 0.5e0) AND NOT same) FROM names n LEFT JOIN pairs p ON p.edit = n.edit GROUP BY n.edit
      UNION ALL SELECT 'direction', 'appeal', count(*), count(*) FILTER (same), count(*) FILTER (p1 - p0 < -0.05e0 AND NOT same) FROM pairs WHERE edit = 'appeal'""",
    "invariance": f"WITH {_PAIRED}, names AS (SELECT unnest([{', '.join(chr(39) + e.name + chr(39) for e in _EDITS if not e.direction)}]) AS edit) SELECT n.edit, count(p.p0) AS n, count(*) FILTER (same) AS unchanged, count(*) FILTER ((p0 >= 0.5e0) <> (p1 >= 0.5e0) AND NOT same) AS flips FROM names n LEFT JOIN pairs p ON p.edit = n.edit GROUP BY n.edit",
    "directional": f"WITH {_PAIRED} SELECT 'appeal' AS edit, count(*) AS n, count(*) FILTER (same) AS unchanged, count(*) FILTER (p1 - p0 < -0.05e0 AND NOT same) AS wrong_way, round(coalesce(avg(p1 - p0) FILTER (NOT same), 0), 9) AS mean_delta, count(*) FILTER (p1 >= 0.5e0 AND p0 < 0.5e0) AS now_spam FROM pairs WHERE edit = 'appeal'",
    "run_agreement": f"WITH {_SECOND}, {_AGREE} SELECT round(agreement, 9) AS agreement, changed, round(mean_abs_dp, 9) AS mean_abs_dp, round(max_abs_dp, 9) AS max_abs_dp FROM agree",
    "challenge_changes": f"WITH {_WRONGS} SELECT case_id, change FROM changes",
    "tags_diff": f"WITH {CASES} SELECT coalesce(a.tag, b.tag) AS tag, coalesce(a.correct, 0) AS correct_a, coalesce(a.n, 0) AS n_a, coalesce(b.correct, 0) AS correct_b, coalesce(b.n, 0) AS n_b FROM {_tags(_cases_scored())} a FULL JOIN {_tags('(SELECT * FROM ' + _cases_scored(chr(39) + 'b' + chr(39)) + ' WHERE NOT list_contains(tags, ' + chr(39) + 'short' + chr(39) + '))')} b ON a.tag = b.tag",
    "metric_deltas": f"WITH {_SECOND}, a AS {_longer('scored')}, b AS {_longer('second')} SELECT metric, round(a.value, 9) AS value_a, round(b.value, 9) AS value_b, round(b.value - a.value, 9) AS delta, b.value < a.value - 0.001e0 OR b.value > a.value + 0.001e0 AS outside FROM a JOIN b USING (metric)",
    "error_deltas": f"WITH {_SECOND}, a AS (SELECT {_C} FROM scored), b AS (SELECT {_C} FROM second) SELECT 'fp' AS error, a.fp AS n_a, b.fp AS n_b, b.fp - a.fp AS delta FROM a, b UNION ALL SELECT 'fn', a.fn, b.fn, b.fn - a.fn FROM a, b",
    "speed_and_lm": f"WITH {_SECOND}, a AS (SELECT avg((prob - label) * (prob - label)) AS x FROM scored), b AS (SELECT avg((prob - label) * (prob - label)) AS y FROM second) SELECT 'speed' AS part, metric, p AS value_a, q AS value_b, round(q / p, 9) AS change FROM (VALUES {', '.join(f'({chr(39)}{n}{chr(39)}, {v[0]}e0, {v[1]}e0)' for n, v in _SPEED.items())}) s(metric, p, q) UNION ALL SELECT 'lm', 'loss', round(x, 9), round(y, 9), round(y - x, 9) FROM a, b",
    "run_sections": f"WITH {SCORED} SELECT tp, round_even(accuracy, 6) AS accuracy, fp + fn AS n_wrong FROM {_derived(f'(SELECT {_C} FROM scored)')}",
    "failing_gate": f"""WITH {_GATE} SELECT "check", CASE "check" WHEN 'predictions agree' THEN false WHEN 'perplexity' THEN (SELECT agreement / 20 <= 0.02e0 FROM facts) ELSE passed END AS passed FROM checks""",
    "gate": f'WITH {_GATE} SELECT "check", passed FROM checks',
    "gate_verdict": f"WITH {_GATE} SELECT coalesce(bool_and(passed), true) AS passed, count(*) FILTER (passed IS NULL) AS skipped FROM checks",
    "run_spread": f"WITH {SCORED}, {_B}, third AS (SELECT doc_id AS idx, {sql_score(chr(39) + 'c' + chr(39) + ' || doc_id::VARCHAR', 'toxic')} AS prob, toxic::INTEGER AS label FROM labels), every AS (SELECT * FROM {_longer('scored')} UNION ALL SELECT * FROM {_longer('other')} UNION ALL SELECT * FROM {_longer('third')}) SELECT metric, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS std FROM every GROUP BY metric",
    "run_json": f"WITH {SCORED} SELECT '{{\"accuracy\":' || round_even(accuracy, 6)::VARCHAR || ',\"tp\":' || tp::VARCHAR || ',\"fp\":' || fp::VARCHAR || '}}' AS document FROM {_derived(f'(SELECT {_C} FROM scored)')}",
}
