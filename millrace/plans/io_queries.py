"""Queries that write tables through the sinks into scratch and read them back through the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import behaviour, encode, metrics, runs
from millrace.plans.dedup_queries import SPLIT_SETS, by_split_sets
from millrace.plans.inputs import CASES, ENCODED, SCORED, SPLIT, VOCABULARY, cases, encoded, read, scored, split_rows, sql_norm, sql_words
from millrace.plans.metric_queries import SQL_WILSON
from millrace.sources import readers, sinks
from millrace.storage import scratch_path, written
from millrace.streaming import tokens


def _csv(spark, df, name):
    """Written as CSV with a header and doubled quotes; nulls are empty and empty texts quoted."""
    path = scratch_path(spark, name)
    df.write.option("header", True).option("escape", '"').option("quoteAll", False).option("lineSep", "\n").csv(path)
    return path


def csv_messages(spark, d):
    """Typed CSV of labelled messages, with quoted line breaks, in message form."""
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select("text", F.col("toxic").cast("tinyint").alias("spam"))
    got = readers.read_messages(spark, _csv(spark, rows, "messages"))
    return got.groupBy(F.md5("text").alias("text_md5"), F.col("spam").cast("int").alias("spam")).agg(F.count("*").alias("n"))


def csv_bodies(spark, d):
    """One column of a wider CSV."""
    path = _csv(spark, read(spark, d, "benchmark").select("item_id", "text"), "bodies")
    return readers.read_csv(spark, path, "item_id bigint, body string", ["body"]).select(F.md5("body").alias("body_md5"))


def whole_files(spark, d):
    """Whole files, one for each benchmark item, with their sizes and digests."""
    path = scratch_path(spark, "files")
    read(spark, d, "benchmark").select("text", "item_id").write.partitionBy("item_id").text(path)
    info = readers.file_info(spark, f"{path}/*/*.txt").select("path", "size", "sha256")
    whole = readers.read_whole(spark, f"{path}/*/*.txt").select(F.sha2(F.encode("value", "UTF-8"), 256).alias("sha256"), F.length("value").alias("characters"))
    return info.join(whole, "sha256").select(F.regexp_extract("path", r"item_id=(\d+)", 1).cast("bigint").alias("item_id"), "size", F.col("characters").cast("bigint").alias("characters"), "sha256")


def split_table(spark, d):
    """The encoded split as a partitioned table; one partition is read."""
    rows, _ = encoded(spark, d)
    path = scratch_path(spark, "split")
    sinks.write_split(rows.select("split", "idx", "tokens", F.col("length").cast("int").alias("length"), "label"), path)
    return readers.read_split(spark, path, "val").select("idx", "tokens", "length", "label")


def guarded_checks(spark, d):
    """Saved checks of splits; those of a split that has changed since are left out."""
    rows = split_rows(spark, d)
    now = rows.groupBy("split").agg(F.md5(F.concat(F.sum("idx").cast("string"), F.lit(":"), F.count("*").cast("string"))).alias("fingerprint"))
    path = scratch_path(spark, "checks")
    sinks.write_checks(rows.select("split", "idx", (F.col("idx") % 7 == 0).alias("flagged")), path)
    saved = now.withColumn("fingerprint", F.when(F.col("split") == "val", F.lit("of another time")).otherwise(F.col("fingerprint")))
    return readers.current_checks(spark.read.parquet(path), saved, now).select("split", F.col("idx").cast("bigint").alias("idx"), "flagged")


def case_file(spark, d):
    """Conversation turns as a file of challenge cases, parsed again."""
    rows = cases(spark, d).withColumn("body", text.clean_body(F.col("body")))
    lines = F.concat(F.lit("=== "), F.col("case_id"), F.lit("\nlabel: "), text.label_name(F.col("label")), F.lit("\ntags: "), F.array_join("tags", ", "), F.lit("\nsubject: A: "), F.col("case_id"), F.lit("\n---\n"), F.col("body"), F.lit("\n"))
    path = scratch_path(spark, "cases")
    rows.select(lines.alias("value")).write.text(path)
    parsed = readers.read_cases(spark, f"{path}/*.txt")
    return parsed.select("case_id", "label", "tags", "subject", F.md5("body").alias("body_md5"))


def prompt_file(spark, d):
    """Prompts of a text file: blank lines and comments go, a written \\n is a line break."""
    path = scratch_path(spark, "prompts")
    turns = read(spark, d, "conversations").where("role = 'user'").select(F.replace(F.replace("text", F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit("\\n")).alias("value"))
    turns.union(spark.createDataFrame([("",), ("# a comment",), ("\t ",)], "value string")).write.text(path)
    return readers.read_prompts(spark, path).groupBy(F.md5("prompt").alias("prompt_md5")).agg(F.count("*").alias("n"))


def run_file(spark, d):
    """A run document written as JSON and read again; what it lacks is null."""
    rows = scored(spark, d)
    m = metrics.binary_metrics(rows, 0.5)
    wrong = rows.where((F.col("prob") >= 0.5) != (F.col("label") == 1)).agg(F.sort_array(F.collect_list(F.col("idx").cast("string"))).alias("wrong"))
    classifier = F.struct(F.lit("abc").alias("split_fingerprint"), F.col("threshold"), F.create_map(F.lit("recall"), runs.saved(F.col("recall")), F.lit("accuracy"), runs.saved(F.col("accuracy"))).alias("metrics"))
    path = scratch_path(spark, "run")
    sinks.write_run(m.crossJoin(wrong).select(F.to_json(F.struct(classifier.alias("classifier"), F.struct("wrong").alias("challenge"))).alias("document")), path)
    run = readers.read_run(spark, path)
    return run.select(F.col("classifier.split_fingerprint").alias("fingerprint"), F.col("classifier.threshold").alias("threshold"), F.col("classifier.metrics")["recall"].alias("recall"), F.col("classifier.metrics")["accuracy"].alias("accuracy"), F.size("challenge.wrong").cast("bigint").alias("n_wrong"), F.col("lm").isNull().alias("no_lm"))


def single_message(spark, d):
    """One message read from a file, in message form."""
    path = scratch_path(spark, "message")
    read(spark, d, "benchmark").agg(F.min_by("text", "item_id").alias("value")).write.text(path)
    one = readers.one_message(spark, "Hello", path=f"{path}/*.txt")
    return one.select(text.format_message(F.col("subject"), F.col("body")).alias("message"))


def error_lines(spark, d):
    """The lines of the error report, written in order and read again."""
    rows = scored(spark, d)
    texts = read(spark, d, "documents").select(F.col("doc_id").alias("idx"), text.preview(text.normalize(F.col("text"))).alias("text"))
    path = scratch_path(spark, "report")
    sinks.write_report(sinks.error_lines(metrics.error_report(rows, 0.5, 10), texts), path, "kind", "rank")
    return spark.read.text(path).select(F.col("value").alias("line"))


def failure_lines(spark, d):
    """A line for each edit of a case that flips its decision."""
    score = lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("bigint").cast("double") / F.lit(4294967295.0)
    edited = behaviour.perturb(cases(spark, d), tuple(e for e in behaviour.EDITS if e.name in ("capitals", "warm start")))
    return sinks.failure_lines(behaviour.paired(edited, score), 0.5)


def _seen_shares(spark, d, n):
    """(idx, split, label, train, val): the share of each labelled document's shingles that either part of the corpus has."""
    sets, corpus = by_split_sets(spark, d, n)
    # no filter of the messages' shingles goes before: they are as many as the corpus's, and would fill it
    hits = corpus.groupBy("h").agg(F.max("train").alias("train"), F.max("val").alias("val"))
    each = sets.select("idx", "split", "label", F.explode_outer("set").alias("h")).join(hits, "h", "left")
    share = lambda c: F.coalesce(F.avg(F.when(F.col("h").isNotNull(), F.coalesce(F.col(c), F.lit(0)))), F.lit(0.0))
    return each.groupBy("idx", "split", "label").agg(share("train").alias("train"), share("val").alias("val"))


def contamination_by_split(spark, d, n=13, seen_at=0.5):
    """By split and label, and over all labels: messages seen in the corpus, and in its validation part."""
    out = _seen_shares(spark, d, n).select("split", F.explode(F.array(text.label_name(F.col("label")), F.lit("all"))).alias("label"), "train", "val")
    return out.groupBy("split", "label").agg(F.count("*").alias("n"), F.count_if(F.col("train") >= seen_at).alias("seen"), F.count_if(F.col("val") >= seen_at).alias("seen_in_val"), F.round(F.avg("train"), 9).alias("mean_share"))


def exposure_report(spark, d, n=13):
    """Decisions by label and by whether the corpus has half of the message: the contamination check's shares beside the scores."""
    shares = _seen_shares(spark, d, n).select("idx", F.col("train").alias("seen_share"))
    out = metrics.exposure_report(scored(spark, d).join(shares, "idx"), 0.5)
    return out.select("label", "seen", "n", "flagged", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))


def appended_tokens(spark, d):
    """Documents as a stream of files, a quarter in each micro-batch, appended to a token cache and read back."""
    source, cache = scratch_path(spark, "stream-files"), scratch_path(spark, "token-stream")
    docs = read(spark, d, "documents").select("doc_id", "text")
    words = written(encode.word_vocabulary(docs, "text"), "vocabulary")
    end = words.count()
    cuts = [0, *docs.approxQuantile("doc_id", [0.25, 0.5, 0.75], 0.01), float("inf")]
    arriving = lambda: spark.readStream.schema(docs.schema).parquet(source)
    for lo, hi in zip(cuts, cuts[1:], strict=False):  # a part's files arrive together, and the stream goes on from where it stopped
        docs.where((F.col("doc_id") >= lo) & (F.col("doc_id") < hi)).write.mode("append").parquet(source)
        tokens.append_tokens(arriving(), cache, f"{cache}-checkpoint", words, end).awaitTermination()
    got = tokens.read_appended(spark, cache)
    return got.groupBy(F.floor(F.col("pos") / 1000).alias("range")).agg(F.count("*").alias("n"), F.sum("token").cast("bigint").alias("total"))


QUERIES = {f.__name__: f for f in (csv_messages, csv_bodies, whole_files, split_table, guarded_checks, case_file, prompt_file, run_file, single_message, error_lines, failure_lines, contamination_by_split, exposure_report, appended_tokens)}

_BARE = lambda e: f"CASE WHEN starts_with({e}, 'Subject:') THEN substr({e}, 9) ELSE {e} END"
_UNIT = lambda e: f"(CAST('0x' || substr(md5({e}), 1, 8) AS BIGINT)::DOUBLE / 4294967295e0)"
_SPACES = f"[{text.SPACES}]"
_CLEAN = lambda e: f"regexp_replace(replace({e}, chr(13) || chr(10), chr(10)), '^{_SPACES}+|{_SPACES}+$', '', 'g')"
_SEEN = lambda b: f"array_to_string(string_split('Subject: ' || {sql_norm(b)}, ' ')[1:255], ' ')"
_SHARES = f"""{SPLIT_SETS},
      hits AS (SELECT sh, max(train) AS train, max(val) AS val FROM corpus GROUP BY sh), each AS (SELECT idx, split, label, unnest(s) AS sh FROM messages),
      shares AS (SELECT m.idx, m.split, m.label, coalesce(avg(CASE WHEN e.sh IS NOT NULL THEN coalesce(h.train, 0) END), 0) AS train, coalesce(avg(CASE WHEN e.sh IS NOT NULL THEN coalesce(h.val, 0) END), 0) AS val
        FROM messages m LEFT JOIN each e ON e.idx = m.idx LEFT JOIN hits h ON h.sh = e.sh GROUP BY ALL)"""
ORACLES = {
    "csv_messages": f"SELECT md5('Subject: ' || t) AS text_md5, spam, count(*) AS n FROM (SELECT {sql_norm(_BARE('text'))} AS t, toxic::INTEGER AS spam FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND toxic IS NOT NULL) WHERE t <> '' GROUP BY ALL",
    "csv_bodies": "SELECT md5(text) AS body_md5 FROM benchmark",
    "whole_files": "SELECT item_id, strlen(text) + 1 AS size, length(text) + 1 AS characters, sha256(text || chr(10)) AS sha256 FROM benchmark",
    "split_table": f"WITH {ENCODED} SELECT idx, tokens, length, label FROM encoded WHERE split = 'val'",
    "guarded_checks": f"WITH {SPLIT} SELECT split, idx, idx % 7 = 0 AS flagged FROM split_rows WHERE split <> 'val'",
    "case_file": f"WITH {CASES} SELECT case_id, label, tags, 'A: ' || case_id AS subject, md5({_CLEAN('body')}) AS body_md5 FROM cases",
    "prompt_file": f"SELECT md5(text) AS prompt_md5, count(*) AS n FROM (SELECT replace(text, chr(13), ' ') AS text FROM conversations WHERE role = 'user') WHERE regexp_replace(text, '{_SPACES}+', '', 'g') <> '' AND NOT starts_with(text, '#') GROUP BY ALL",
    "run_file": f"WITH {SCORED}, m AS (SELECT count(*) FILTER (prob >= 0.5e0 AND label = 1) AS tp, count(*) FILTER (label = 1) AS pos, count(*) FILTER ((prob >= 0.5e0) = (label = 1)) AS good, count(*) AS n FROM scored) SELECT 'abc' AS fingerprint, 0.5e0 AS threshold, round_even(coalesce(tp::DOUBLE / nullif(pos, 0), 0), 6) AS recall, round_even(good::DOUBLE / n, 6) AS accuracy, n - good AS n_wrong, true AS no_lm FROM m",
    "single_message": f"SELECT 'Subject: ' || {sql_norm("'Hello ' || text")} AS message FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)",
    "error_lines": f"""WITH {SCORED}, k AS (SELECT *, CASE WHEN prob >= 0.5e0 AND label = 0 THEN 'false positive' WHEN prob < 0.5e0 AND label = 1 THEN 'false negative' ELSE 'near miss' END AS kind FROM scored),
      o AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY abs(prob - 0.5e0), idx) AS rank FROM k), t AS (SELECT doc_id AS idx, {sql_norm('text')} AS t FROM documents), s AS (SELECT idx, CASE WHEN starts_with(t, 'Subject: ') THEN substr(t, 10) ELSE t END AS t FROM t)
      SELECT '[#' || idx::VARCHAR || '] label ' || label::VARCHAR || ' | score ' || format('{{:.3f}}', prob) || ' | ' || substr(t, 1, 90) || CASE WHEN length(t) > 90 THEN '...' ELSE '' END AS line FROM o JOIN s USING (idx) WHERE kind <> 'near miss' OR rank <= 10""",
    "failure_lines": f"""WITH {CASES}, edited AS (SELECT 'capitals' AS edit, case_id, subject || ' ' || body AS a, upper(replace(subject || ' ' || body, 'ß', 'SS')) AS b FROM cases
        UNION ALL SELECT 'warm start', case_id, subject || ' ' || body, subject || ' ' || '{behaviour.OPENER.replace("'", "''").replace(chr(10), "' || chr(10) || '")}' || body FROM cases WHERE label = 1),
      x AS (SELECT edit, case_id, {_SEEN('a')} AS x0, {_SEEN('b')} AS x1 FROM edited), p AS (SELECT *, {_UNIT('x0')} AS p0, {_UNIT('x1')} AS p1 FROM x)
      SELECT edit, case_id, edit || ': ' || case_id || ' ' || format('{{:.3f}}', p0) || ' -> ' || format('{{:.3f}}', p1) AS line FROM p WHERE (p0 >= 0.5e0) <> (p1 >= 0.5e0) AND x0 <> x1""",
    "contamination_by_split": f"""WITH {_SHARES}, lines AS (SELECT split, unnest([CASE label WHEN 0 THEN 'legitimate' ELSE 'spam' END, 'all']) AS label, train, val FROM shares)
      SELECT split, label, count(*) AS n, count(*) FILTER (train >= 0.5e0) AS seen, count(*) FILTER (val >= 0.5e0) AS seen_in_val, round(avg(train), 9) AS mean_share FROM lines GROUP BY ALL""",
    "exposure_report": f"""WITH {_SHARES}, {SCORED}, exposed AS (SELECT s.label, s.prob, train >= 0.5e0 AS seen FROM scored s JOIN shares USING (idx)), cells AS (SELECT l AS label, s AS seen FROM (VALUES (0), (1)) a(l), (VALUES (true), (false)) b(s)),
      c AS (SELECT g.label, g.seen, count(e.prob) AS n, count(*) FILTER (e.prob >= 0.5e0) AS flagged FROM cells g LEFT JOIN exposed e ON e.label = g.label AND e.seen = g.seen GROUP BY g.label, g.seen)
      SELECT label, seen, n, flagged, round(lo, 9) AS lo, round(hi, 9) AS hi FROM (SELECT *, {SQL_WILSON} FROM (SELECT *, coalesce(flagged::DOUBLE / nullif(n, 0), 0) AS p FROM c))""",
    "appended_tokens": f"""WITH {VOCABULARY}, worded AS (SELECT doc_id, {sql_words("text")} AS w FROM documents),
      starts AS (SELECT doc_id, len(w) AS n, coalesce(sum(len(w) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM worded),
      stream AS (SELECT start + k - 1 AS pos, id AS token FROM (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS k FROM worded) JOIN starts USING (doc_id) JOIN vocabulary USING (token) UNION ALL SELECT start + n, (SELECT count(*) FROM vocabulary) FROM starts)
      SELECT pos // 1000 AS range, count(*) AS n, sum(token)::BIGINT AS total FROM stream GROUP BY 1""",
}
