"""The driver's tables as the operators' inputs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import encode

BLOCK = 256
#: Tables whose rows are long texts.
TEXTS = ("documents", "conversations")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(df) if table in TEXTS else df


def spread(df: DataFrame) -> DataFrame:
    """df, dealt anew where its files give fewer tasks than half the cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def uniform(c: Column) -> Column:
    """A number in [0, 1] from the first eight hex digits of an md5."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint").cast("double") / F.lit(4294967295.0)


def stand_in_score(key: Column, label: Column) -> Column:
    """A score that leans to the label, in steps of a thousandth so that ties occur."""
    return F.floor((uniform(key) * 1.4 + label.cast("double") * 0.6) / 2.0 * 1000.0).cast("double") / 1000.0


def scored(spark: SparkSession, sf_dir: str, salt: str = "") -> DataFrame:
    """(idx, prob, label) of every labelled document."""
    rows = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"), F.col("toxic").cast("int").alias("label"))
    return rows.select("idx", stand_in_score(F.concat(F.lit(salt), F.col("idx").cast("string")), F.col("label")).alias("prob"), "label")


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, label, split) of every labelled document."""
    rows = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"), F.col("toxic").cast("int").alias("label"))
    return encode.stratified_split(rows, "idx", "label")


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.word_vocabulary(read(spark, sf_dir, "documents"), "text")


def encoded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """((split, idx, tokens, length, truncated, label), end id) of every labelled document."""
    words = vocabulary(spark, sf_dir)
    end = words.count()
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "text")
    known = split_rows(spark, sf_dir)
    coded = encode.encoded_table(docs.join(known, "idx", "left_semi"), "idx", "text", words, BLOCK, end)
    return coded.join(known, "idx"), end


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as behavioural cases: the user's turns are the positive class."""
    turns = read(spark, sf_dir, "conversations")
    length = F.when(F.length("text") < 200, "short").otherwise("long")
    return turns.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("case_id"),
        (F.col("role") == "user").cast("int").alias("label"), F.array(F.col("role"), length).alias("tags"), F.lit("").alias("subject"), F.col("text").alias("body"),
    )


# ---- SQL ----

WS = f"[{text.SPACES}]"


def sql_norm(e: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({e}), '([^\p{{L}}\p{{N}}_{text.SPACES}])', ' \1 ', 'g'), '{WS}+', ' ', 'g'))"


def sql_words(e: str) -> str:
    return rf"regexp_extract_all(lower({e}), '[\p{{L}}\p{{N}}_]+')"


def sql_message_words(e: str) -> str:
    return f"CASE WHEN {sql_words(e)}[1] = 'subject' THEN {sql_words(e)}[2:] ELSE {sql_words(e)} END"


def sql_shingles(w: str, n: int) -> str:
    """Distinct shingles of a list of words."""
    return f"CASE WHEN len({w}) = 0 THEN [] ELSE list_distinct(list_transform(range(1, len({w}) - least({n}, len({w})) + 2), lambda i: array_to_string({w}[i:i + least({n}, len({w})) - 1], ' '))) END"


def sql_uniform(e: str) -> str:
    return f"(CAST('0x' || substr(md5({e}), 1, 8) AS BIGINT)::DOUBLE / 4294967295e0)"


def sql_score(key: str, label: str) -> str:
    return f"(floor(({sql_uniform(key)} * 1.4e0 + {label}::DOUBLE * 0.6e0) / 2e0 * 1000e0) / 1000e0)"


SCORED = f"scored AS (SELECT doc_id AS idx, {sql_score('doc_id::VARCHAR', 'toxic')} AS prob, toxic::INTEGER AS label FROM labels)"
SPLIT = """ranked AS (
  SELECT doc_id AS idx, toxic::INTEGER AS label, count(*) OVER (PARTITION BY toxic) AS n,
         row_number() OVER (PARTITION BY toxic ORDER BY md5('1337:' || doc_id::VARCHAR)) AS rn FROM labels
), split_rows AS (
  SELECT idx, label, CASE WHEN rn <= round_even(n * 0.1, 0) THEN 'test' WHEN rn <= 2 * round_even(n * 0.1, 0) THEN 'val' ELSE 'train' END AS split FROM ranked
)"""
VOCABULARY = f"""vocabulary AS (
  SELECT token, n, (row_number() OVER (ORDER BY n DESC, token) - 1)::BIGINT AS id
  FROM (SELECT token, count(*) AS n FROM (SELECT unnest({sql_words("text")}) AS token FROM documents) GROUP BY token)
)"""
ENCODED = f"""{SPLIT}, {VOCABULARY}, worded AS (
  SELECT doc_id AS idx, {sql_words("text")} AS w FROM documents WHERE doc_id IN (SELECT idx FROM split_rows)
), placed AS (
  SELECT idx, unnest(w[1:{BLOCK - 1}]) AS token, generate_subscripts(w[1:{BLOCK - 1}], 1) AS pos FROM worded
), listed AS (
  SELECT idx, list(id ORDER BY pos) AS ids FROM placed JOIN vocabulary USING (token) GROUP BY idx
), encoded AS (
  SELECT split, w.idx, list_append(coalesce(ids, []), (SELECT count(*) FROM vocabulary)) AS tokens,
         len(coalesce(ids, [])) + 1 AS length, len(w.w) >= {BLOCK} AS truncated, label
  FROM worded w LEFT JOIN listed USING (idx) JOIN split_rows USING (idx)
)"""
CASES = """cases AS (
  SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS case_id, (role = 'user')::INTEGER AS label,
         [role, CASE WHEN length(text) < 200 THEN 'short' ELSE 'long' END] AS tags, '' AS subject, text AS body FROM conversations
)"""
