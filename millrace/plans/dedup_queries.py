"""Queries of deduplication, similarity joins, splits and data checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import arrays, text
from millrace.operators import dedup, encode, membership
from millrace.operators.metrics import wilson
from millrace.plans.inputs import ENCODED, SPLIT, encoded, read, split_rows, sql_message_words, sql_norm, sql_shingles
from millrace.storage import free_shuffles, written


def _messages(spark, d):
    """(idx, text, label): labelled documents in normal form."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("idx"), text.normalize(F.col("text")).alias("text"))
    return docs.join(split_rows(spark, d).select("idx", "label"), "idx")


def null_rows(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left").dropna(subset=["text", "toxic"])
    body = text.normalize(text.without_prefix(F.col("text")))
    return rows.select("doc_id", F.concat(F.lit("Subject: "), body).alias("text")).where("text != 'Subject: '")


def exact_dedup(spark, d):
    return dedup.keep_first(read(spark, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("text")), "text", "doc_id").select("doc_id")


def label_conflicts(spark, d):
    return dedup.drop_conflicts(_messages(spark, d), "text", "label").select("idx", "label")


def corpus_dedup(spark, d):
    bodies = read(spark, d, "documents").select("doc_id", text.clean_body(F.col("text")).alias("body")).where(F.length("body") > 0)
    return dedup.keep_first(bodies, "body", "doc_id").select("doc_id", F.md5("body").alias("body_md5"))


def exact_leakage(spark, d):
    rows, _ = encoded(spark, d)
    rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    return dedup.later_copies(rows.select("split", "idx", "tokens"), "tokens", rank, F.col("idx")).select("split", "idx")


def jaccard_pairs(spark, d):
    return dedup.similar_pairs(dedup.shingle_sets(read(spark, d, "documents"), "doc_id", "text", 5)).select("i", "j", F.col("shared").cast("bigint").alias("shared"), F.col("total").cast("bigint").alias("total"))


def _sets_by_split(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("idx"), "text")
    known, out = written(split_rows(spark, d), "split-rows"), []
    for k in range(dedup.SLICES):  # one slice of the texts after the other, for disk
        some = docs.where(F.pmod(F.xxhash64("idx"), F.lit(dedup.SLICES)) == k).join(known, "idx")
        # by number: small rows make much work here, and would be coalesced into a few tasks
        rows = some.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "idx")
        out.append(written(rows.select("idx", "split", "label", arrays.shingle_hashes(F.col("text"), 5).alias("set")), "split-sets"))
        free_shuffles(spark)
    return reduce(DataFrame.union, out)


def _matches(spark, d, flagged_only=False):
    sets = _sets_by_split(spark, d)
    of = lambda s: sets.where(F.col("split") == s).select("idx", "set")
    best = dedup.best_matches(of("test"), of("train"), flagged_only=flagged_only, stored=True)
    return best.withColumn("similarity", F.round("similarity", 9)), sets.select("idx", "label")


def near_dup_leakage(spark, d):
    return _matches(spark, d)[0]


def label_disagreement(spark, d):
    """Flagged matches of another label: every fourth document is matched with the others, its source standing for the label, as sources of copies do differ."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("idx"), F.col("source").alias("label"), arrays.shingle_hashes(F.col("text"), 5).alias("set"))
    docs = written(docs, "labelled-sets")
    best = dedup.best_matches(docs.where("idx % 4 = 0").select("idx", "set"), docs.where("idx % 4 != 0").select("idx", "set"), flagged_only=True, stored=True)
    return dedup.label_disagreement(best, docs.select("idx", "label"))


def near_dup_summary(spark, d):
    best, labels = _matches(spark, d, flagged_only=True)
    rows = best.join(labels.toDF("i", "label"), "i").join(labels.toDF("match", "match_label"), "match", "left")
    flagged = F.col("flagged")
    return rows.agg(F.count("*").alias("n"), F.count_if(flagged).alias("n_flagged"), F.count_if(flagged & (F.col("label") == 1)).alias("flagged_spam"), F.count_if(flagged & (F.col("label") != F.col("match_label"))).alias("disagree"))


def top_near_dups(spark, d):
    best, _ = _matches(spark, d, flagged_only=True)
    return best.where("flagged").orderBy(F.col("similarity").desc(), "i").limit(5).withColumn("rank", F.row_number().over(Window.orderBy(F.col("similarity").desc(), "i"))).select("rank", "i", "match", "similarity")


def near_dup_groups(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return dedup.similar_groups(docs, dedup.shingle_sets(docs, "id", "text", 5))


def near_dup_filter(spark, d):
    rows, _ = encoded(spark, d)
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("idx"), "text")
    seen = F.array_join(F.slice(text.words(F.col("text")), 1, 255), " ")  # what the model reads
    return dedup.near_duplicate_filter(rows.join(docs, "idx").select(F.col("idx").alias("id"), seen.alias("text"), "tokens", "label"))


def stratified_split(spark, d):
    return split_rows(spark, d)


def split_summary(spark, d):
    n = F.count("*")
    spam = F.sum("label").cast("bigint")
    return split_rows(spark, d).groupBy("split").agg(n.alias("n"), spam.alias("spam"), (n - spam).alias("legitimate"), F.round(spam / n, 9).alias("share"))


def split_stats(spark, d):
    rows, _ = encoded(spark, d)
    return rows.groupBy("split").agg(
        F.count("*").alias("n"), F.round(F.avg("label"), 9).alias("positive"), F.round(F.avg(F.col("truncated").cast("int")), 9).alias("truncated"),
        F.percentile("length", 0.5).cast("int").alias("median"), F.percentile("length", 0.9).cast("int").alias("p90"),
    )


def integrity(spark, d):
    """Rows padded to the block, every seventh by 0, checked against a block of 200 and a vocabulary short of 500 ids, so that rules fail."""
    rows, end = encoded(spark, d)
    rows = rows.withColumn("tokens", arrays.padded(F.col("tokens"), 256, F.when(F.col("idx") % 7 == 0, 0).otherwise(end)))
    return encode.integrity(rows, 200, end - 499, end)


def batch_crop(spark, d):
    """Batches of 64 rows by index, each cut to its longest row; the table's rows are padded to the block."""
    rows, end = encoded(spark, d)
    full = rows.withColumn("tokens", arrays.padded(F.col("tokens"), 256, F.lit(end)))
    out = encode.cropped_batches(full, 64, F.lit(end), F.col("idx").asc())
    return out.select("idx", F.col("batch").cast("bigint").alias("batch"), "width", F.md5(F.array_join(F.transform("tokens", lambda t: t.cast("string")), ",")).alias("tokens_md5"))


def fingerprint(spark, d):
    rows, _ = encoded(spark, d)
    return encode.fingerprint(rows.select("split", "idx", "tokens", F.col("length").cast("int").alias("length"), "label"), "split")


def _hits(spark, d, n=13):
    """((key, label, set), corpus shingles that the benchmark has): short documents give the corpus nothing."""
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("i"), arrays.shingle_hashes(F.col("text"), n).alias("set"))
    wanted = items.select(F.explode("set").alias("h")).distinct()
    corpus = read(spark, d, "documents").select(text.words(F.col("text")).alias("w")).where(F.size("w") >= n).select(F.explode(arrays.hashed_shingles(F.col("w"), n)).alias("h"))
    return items, membership.held(corpus, wanted).distinct()


def _overlap(spark, d):
    items, hits = _hits(spark, d)
    each = items.select("i", F.explode_outer("set").alias("h")).join(hits.withColumn("hit", F.lit(1)), "h", "left")
    return each.groupBy("i").agg(F.round(F.coalesce(F.avg(F.when(F.col("h").isNotNull(), F.coalesce("hit", F.lit(0)))), F.lit(0.0)), 9).alias("seen_share"))


def by_split_sets(spark, d, n):
    """((idx, split, label, set) of labelled documents, (h, train, val) of the others, a tenth of which are validation)."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("idx"), "text")
    known = split_rows(spark, d)
    sets = docs.join(known, "idx").select("idx", "split", "label", arrays.shingle_hashes(F.col("text"), n).alias("set"))
    val = (F.col("idx") % 10 == 9).cast("int")
    # cut into words below the generator: above it, that would be done again for the filter
    rest = docs.join(known, "idx", "left_anti").select("idx", F.explode(F.array(text.words(F.col("text")))).alias("ws")).where(F.size("ws") >= n)
    each = F.explode(F.array_distinct(arrays.hashed_shingles(arrays.without_subject(F.col("ws")), n)))
    return sets, rest.select(each.alias("h"), (1 - val).alias("train"), val.alias("val"))


def contamination(spark, d):
    items, hits = _hits(spark, d)
    return items.select("i", F.explode("set").alias("h")).join(hits, "h", "left_semi").groupBy("i").agg(F.count("*").alias("n_hits"))


def overlap_fraction(spark, d):
    return _overlap(spark, d)


def contamination_report(spark, d):
    """By half of the items and in all: a subtotal over the halves."""
    rows = _overlap(spark, d).select(F.when(F.col("i") % 2 == 0, "even").otherwise("odd").alias("part"), F.col("seen_share") >= 0.5, "seen_share").toDF("part", "seen", "seen_share")
    out = rows.rollup("part").agg(F.count("*").alias("n"), F.count_if("seen").alias("seen"), F.round(F.avg("seen_share"), 9).alias("mean_share"))
    lo, hi = wilson(F.col("seen"), F.col("n"))
    return out.select(F.coalesce("part", F.lit("all")).alias("part"), "n", "seen", "mean_share", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


QUERIES = {f.__name__: f for f in (null_rows, exact_dedup, label_conflicts, corpus_dedup, exact_leakage, jaccard_pairs, near_dup_leakage, label_disagreement, near_dup_summary, top_near_dups, near_dup_groups, near_dup_filter, stratified_split, split_summary, split_stats, integrity, batch_crop, fingerprint, contamination, overlap_fraction, contamination_report)}

_NORM = sql_norm("text")
_SETS = f"sets AS (SELECT doc_id AS idx, {sql_shingles('w', 5)} AS s FROM (SELECT doc_id, {sql_message_words('text')} AS w FROM documents))"
_EACH = "each AS (SELECT idx, len(s) AS n, unnest(s) AS sh FROM sets)"
_PAIRS = f"""{_SETS}, {_EACH}, pairs AS (
  SELECT a.idx AS i, b.idx AS j, count(*) AS shared, any_value(a.n + b.n) - count(*) AS total
  FROM each a JOIN each b ON a.sh = b.sh AND a.idx < b.idx GROUP BY a.idx, b.idx HAVING 5 * count(*) >= 4 * (any_value(a.n + b.n) - count(*))
)"""
SPLIT_SETS = f"""{SPLIT}, worded AS (SELECT doc_id AS idx, {sql_message_words('text')} AS w, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS own FROM documents),
  messages AS (SELECT idx, split, label, {sql_shingles('w', 13)} AS s FROM worded JOIN split_rows USING (idx)),
  corpus AS (SELECT unnest({sql_shingles('w', 13)}) AS sh, (idx % 10 <> 9)::INTEGER AS train, (idx % 10 = 9)::INTEGER AS val FROM worded ANTI JOIN split_rows USING (idx) WHERE len(own) >= 13)"""
_MATCH = f"""{SPLIT}, {_SETS}, {_EACH}, found AS (
  SELECT q.idx AS i, r.idx AS j, count(*) AS shared, any_value(q.n + r.n) - count(*) AS total
  FROM each q JOIN each r ON q.sh = r.sh JOIN split_rows sq ON sq.idx = q.idx AND sq.split = 'test' JOIN split_rows sr ON sr.idx = r.idx AND sr.split = 'train'
  GROUP BY q.idx, r.idx
), best AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY i ORDER BY shared::DOUBLE / total DESC, j) = 1
), matches AS (
  SELECT s.idx AS i, b.j AS match, round(coalesce(b.shared::DOUBLE / b.total, 0), 9) AS similarity, coalesce(5 * b.shared >= 4 * b.total, false) AS flagged
  FROM split_rows s LEFT JOIN best b ON b.i = s.idx WHERE s.split = 'test'
)"""


def _walk(pairs: str) -> str:
    """The greedy walk as a recursion over the rows that have a similar row."""
    return f"""low AS (SELECT j, list(i) AS l FROM {pairs} GROUP BY j),
  node AS (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM (SELECT i AS id FROM {pairs} UNION SELECT j FROM {pairs})),
  walk(rn, kept) AS (
    SELECT 0::BIGINT, []::BIGINT[]
    UNION ALL
    SELECT n.rn, CASE WHEN low.l IS NULL OR len(list_intersect(low.l, w.kept)) = 0 THEN list_append(w.kept, n.id) ELSE w.kept END
    FROM walk w JOIN node n ON n.rn = w.rn + 1 LEFT JOIN low ON low.j = n.id
  ), done AS (SELECT kept FROM walk ORDER BY rn DESC LIMIT 1),
  led AS (SELECT low.j AS id, list_min(list_intersect(low.l, done.kept)) AS leader FROM low, done)"""


_HITS = f"""items AS (SELECT item_id AS i, {sql_shingles('w', 13)} AS s FROM (SELECT item_id, {sql_message_words('text')} AS w FROM benchmark)),
  wanted AS (SELECT i, unnest(s) AS sh FROM items),
  corpus AS (SELECT DISTINCT unnest({sql_shingles('w', 13)}) AS sh FROM (SELECT {sql_message_words('text')} AS w, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS own FROM documents) WHERE len(own) >= 13),
  overlap AS (SELECT items.i, round(coalesce(avg(CASE WHEN w.sh IS NOT NULL THEN (c.sh IS NOT NULL)::INTEGER END), 0), 9) AS seen_share
    FROM items LEFT JOIN wanted w USING (i) LEFT JOIN corpus c ON c.sh = w.sh GROUP BY items.i)"""
_WILSON = "(p + 1.96e0 * 1.96e0 / (2 * n)) / (1 + 1.96e0 * 1.96e0 / n), 1.96e0 * sqrt(p * (1 - p) / n + 1.96e0 * 1.96e0 / (4e0 * n * n)) / (1 + 1.96e0 * 1.96e0 / n)"
ORACLES = {
    "null_rows": f"SELECT * FROM (SELECT doc_id, 'Subject: ' || {sql_norm('t')} AS text FROM (SELECT doc_id, CASE WHEN starts_with(text, 'Subject:') THEN substr(text, 9) ELSE text END AS t FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND toxic IS NOT NULL)) WHERE text <> 'Subject: '",
    "exact_dedup": f"SELECT min(doc_id) AS doc_id FROM (SELECT doc_id, {_NORM} AS t FROM documents) GROUP BY t",
    "label_conflicts": f"WITH m AS (SELECT doc_id AS idx, {_NORM} AS t, toxic::INTEGER AS label FROM documents JOIN labels USING (doc_id)) SELECT idx, label FROM m WHERE t IN (SELECT t FROM m GROUP BY t HAVING min(label) = max(label))",
    "corpus_dedup": "SELECT min(doc_id) AS doc_id, md5(body) AS body_md5 FROM (SELECT doc_id, regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^WS+|WS+$', '', 'g') AS body FROM documents) WHERE length(body) > 0 GROUP BY body".replace("WS", f"[{text.SPACES}]"),
    "exact_leakage": f"WITH {ENCODED} SELECT split, idx FROM encoded QUALIFY row_number() OVER (PARTITION BY tokens ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END, idx) > 1",
    "jaccard_pairs": f"WITH {_PAIRS} SELECT i, j, shared, total FROM pairs",
    "near_dup_leakage": f"WITH {_MATCH} SELECT i, match, similarity, flagged FROM matches",
    "label_disagreement": f"""WITH {_SETS}, {_EACH}, found AS (SELECT q.idx AS i, r.idx AS j, count(*) AS shared, any_value(q.n + r.n) - count(*) AS total FROM each q JOIN each r ON q.sh = r.sh AND q.idx % 4 = 0 AND r.idx % 4 <> 0 GROUP BY q.idx, r.idx),
      best AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY i ORDER BY shared::DOUBLE / total DESC, j) = 1)
      SELECT i, j AS match, a.source AS label, b.source AS match_label FROM best JOIN documents a ON a.doc_id = i JOIN documents b ON b.doc_id = j WHERE 5 * shared >= 4 * total AND a.source <> b.source""",
    "near_dup_summary": f"WITH {_MATCH} SELECT count(*) AS n, count(*) FILTER (flagged) AS n_flagged, count(*) FILTER (flagged AND a.label = 1) AS flagged_spam, count(*) FILTER (flagged AND a.label <> b.label) AS disagree FROM matches m JOIN split_rows a ON a.idx = m.i LEFT JOIN split_rows b ON b.idx = m.match",
    "top_near_dups": f"WITH {_MATCH} SELECT row_number() OVER (ORDER BY similarity DESC, i)::INTEGER AS rank, i, match, similarity FROM matches WHERE flagged ORDER BY similarity DESC, i LIMIT 5",
    "near_dup_groups": f"WITH RECURSIVE {_PAIRS}, {_walk('pairs')} SELECT doc_id AS id, coalesce(leader, doc_id) AS group_id FROM documents LEFT JOIN led ON led.id = doc_id",
    "near_dup_filter": f"""WITH RECURSIVE {ENCODED}, sets AS (SELECT idx, {sql_shingles('w', 5)} AS s FROM (SELECT idx, CASE WHEN w[1] = 'subject' THEN w[2:255] ELSE w[1:255] END AS w FROM worded)), {_PAIRS.removeprefix(_SETS + ', ')}, {_walk('pairs')},
      grouped AS (SELECT e.idx AS id, e.label, e.tokens, coalesce(leader, e.idx) AS g FROM encoded e LEFT JOIN led ON led.id = e.idx),
      merged AS (SELECT id, label, CASE WHEN g = id THEN first_value(g) OVER (PARTITION BY tokens ORDER BY id) ELSE g END AS group_id FROM grouped)
      SELECT id, group_id, group_id = id AND min(label) OVER (PARTITION BY group_id) = max(label) OVER (PARTITION BY group_id) AS keep FROM merged""",
    "stratified_split": f"WITH {SPLIT} SELECT idx, label, split FROM split_rows",
    "split_summary": f"WITH {SPLIT} SELECT split, count(*) AS n, sum(label)::BIGINT AS spam, (count(*) - sum(label))::BIGINT AS legitimate, round(sum(label)::DOUBLE / count(*), 9) AS share FROM split_rows GROUP BY split",
    "split_stats": f"WITH {ENCODED} SELECT split, count(*) AS n, round(avg(label), 9) AS positive, round(avg(truncated::INTEGER), 9) AS truncated, trunc(quantile_cont(length, 0.5))::INTEGER AS median, trunc(quantile_cont(length, 0.9))::INTEGER AS p90 FROM encoded GROUP BY split",
    "integrity": f"""WITH {ENCODED}, v AS (SELECT count(*) AS e FROM vocabulary), rules AS (
      SELECT split, count(*) FILTER (NOT length BETWEEN 2 AND 200) AS "length", count(*) FILTER (length BETWEEN 2 AND 200 AND tokens[length] <> e) AS "end",
        count(*) FILTER (idx % 7 <> 0 AND length < 256 OR len(list_filter(tokens, lambda t: t >= e - 499)) > 0) AS vocabulary, count(*) FILTER (idx % 7 = 0 AND length < 256 AND e <> 0) AS padding, count(*) FILTER (NOT label BETWEEN 0 AND 1) AS label,
        count(*) FILTER (list_contains(tokens[1:length - 1], e)) AS "inner end" FROM (SELECT *, (SELECT e FROM v) AS e FROM encoded) GROUP BY split)
      UNPIVOT rules ON "length", "end", vocabulary, padding, label, "inner end" INTO NAME rule VALUE failures""",
    "batch_crop": f"""WITH {ENCODED}, batched AS (SELECT *, (row_number() OVER (ORDER BY idx) - 1) // 64 AS batch FROM encoded), wide AS (SELECT *, max(length) OVER (PARTITION BY batch)::INTEGER AS width FROM batched)
      SELECT idx, batch::BIGINT AS batch, width, md5(array_to_string(list_resize(tokens, width, (SELECT count(*) FROM vocabulary)), ',')) AS tokens_md5 FROM wide""",
    "fingerprint": f"""WITH {ENCODED}, digests AS (SELECT split, idx, md5(array_to_string(tokens, ',') || '|' || length::VARCHAR || '|' || label::VARCHAR) AS d FROM encoded),
      folded AS (SELECT split, idx // 1000 AS r, md5(string_agg(d, '' ORDER BY idx)) AS d FROM digests GROUP BY split, r),
      top AS (SELECT split, r, d FROM folded WHERE (SELECT max(idx) FROM encoded) >= 1000 UNION ALL SELECT split, idx, d FROM digests WHERE (SELECT max(idx) FROM encoded) < 1000)
      SELECT split, md5(string_agg(d, '' ORDER BY r)) AS fingerprint FROM top GROUP BY split""",
    "contamination": f"WITH {_HITS} SELECT i, count(*) AS n_hits FROM wanted JOIN corpus USING (sh) GROUP BY i",
    "overlap_fraction": f"WITH {_HITS} SELECT i, seen_share FROM overlap",
    "contamination_report": f"""WITH {_HITS}, parted AS (SELECT CASE WHEN i % 2 = 0 THEN 'even' ELSE 'odd' END AS part, seen_share FROM overlap),
      counted AS (SELECT coalesce(part, 'all') AS part, count(*) AS n, count(*) FILTER (seen_share >= 0.5) AS seen, round(avg(seen_share), 9) AS mean_share FROM parted GROUP BY ROLLUP (part)),
      w AS (SELECT *, seen::DOUBLE / n AS p FROM counted), iv AS (SELECT *, {_WILSON.replace('), 1.96e0 * sqrt', ') AS centre, 1.96e0 * sqrt', 1)} AS half FROM w)
      SELECT part, n, seen, mean_share, round(greatest(0, centre - half), 9) AS lo, round(least(1, centre + half), 9) AS hi FROM iv""",
}
