"""Scans: typed CSV, whole files, splits, guarded checks, cases, prompts and run documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.storage import written

MESSAGE = "text string, spam tinyint"
SPLIT = "split string, idx bigint, tokens array<int>, length int, label int"
RUN = """classifier struct<split_fingerprint: string, threshold: double, probs: array<double>, metrics: map<string, double>, ci: map<string, array<double>>>,
 challenge struct<wrong: array<string>>, lm struct<perplexity: double>"""


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, first) of CSV files: whole records with their line breaks, and whether one is its file's first.

    Files are split like plain lines. Whether a split begins within quotes follows from the number of
    quotes in the splits before it, which a first scan counts: a row for each split is all that is
    summed and broadcast. In the second scan a split gives the records that it begins and ends; what it
    can't end, and what belongs to a record of a split before, meets in a small aggregation. A quote
    that is neither around a field nor doubled isn't allowed, as in RFC 4180.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counts = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    states = counts.select("file", "block", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("within"))
    marked = lines.join(F.broadcast(states), ["file", "block"]).select("file", "block", "within", "value")
    parts = marked.mapInArrow(_records_of_splits, "file string, block long, begins boolean, ends boolean, first boolean, record string")
    parts = parts.withColumn("record", F.regexp_replace("record", r"\r\z", ""))
    whole = parts.where("begins and ends").select("record", "first")
    pieces = parts.where("not (begins and ends)")
    # the split in which a piece's record begins: the last that begins one, at or before the piece's own
    order = Window.partitionBy("file").orderBy("block", "begins")
    owner = F.last(F.when(F.col("begins"), F.col("block")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    pieces = pieces.withColumn("owner", owner).groupBy("file", "owner")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "begins", "record"))), lambda x: x["record"]), "\n")
    return whole.union(pieces.agg(joined.alias("record"), F.bool_or("first").alias("first")).select("record", "first")).where("record != ''")


def _records_of_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records, and pieces of records, of lines (file, block, within, value) in the order of their splits.

    begins and ends say whether a piece has its record's first and last line.
    """
    split, within, held, begins, first, out = None, False, [], True, False, []
    names = ["file", "block", "begins", "ends", "first", "record"]

    def rows(key: tuple, out: list) -> pa.RecordBatch:
        columns = [[key[0]] * len(out), [key[1]] * len(out), *map(list, zip(*out, strict=True))]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        odd = np.bitwise_and(pc.count_substring(batch.column(3), '"').to_numpy(zero_copy_only=False), 1).astype(bool)
        block, value = batch.column(1).to_numpy(), batch.column(3).to_pylist()
        file = batch.column(0)
        for k, line in enumerate(value):
            key = (split[0], block[k]) if split and split[1] == block[k] and split[0] == file[k].as_py() else (file[k].as_py(), block[k])
            if key != split:
                if held:
                    out.append((begins, False, first, "\n".join(held)))
                if out:  # a batch may go on with another split
                    yield rows(split, out)
                split, held, within = key, [], batch.column(2)[k].as_py()
                begins, first, out = not within, key[1] == 0, []
            held.append(line)
            within ^= bool(odd[k])
            if not within:
                out.append((begins, True, first, "\n".join(held)))
                held, begins, first = [], True, False
                if len(out) >= 1000:
                    yield rows(split, out)
                    out = []
        if split and out:
            yield rows(split, out)
            out = []
    if held:
        yield rows(split, [(begins, False, first, "\n".join(held))])


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV with a header, quoted line breaks allowed; files are split, and only the wanted columns are parsed.

    schema names all columns in the file's order.
    """
    records = csv_records(spark, path).where("not first")
    parsed = records.select(F.from_csv("record", schema, {"escape": '"'}).alias("row"))
    names = columns or spark.createDataFrame([], schema).columns
    return parsed.select(*(F.col("row").getField(c).alias(c) for c in names))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """(text, spam) in message form; rows with a null or without a body go."""
    rows = read_csv(spark, path, MESSAGE).dropna(subset=["text", "spam"])
    bare = text.without_prefix(F.col("text"))
    return rows.select(text.format_message(F.lit(""), bare).alias("text"), "spam").where(F.col("text") != f"{text.PREFIX} ")


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(value): one row for each file."""
    return spark.read.text(path, wholetext=True)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of the partitioned table; other partitions aren't read."""
    return spark.read.schema(SPLIT).parquet(path).where(F.col("split") == split)


def read_tokens(spark: SparkSession, path: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """(pos, token) of a token cache from start up to stop; the range is pushed down to its files."""
    df = spark.read.schema("pos bigint, token int").parquet(path).where(F.col("pos") >= start)
    return df if stop is None else df.where(F.col("pos") < stop)


def current_checks(checks: DataFrame, saved: DataFrame, now: DataFrame) -> DataFrame:
    """checks (split, ...) whose saved fingerprint (split, fingerprint) is still that of the split; stale ones go."""
    return checks.join(saved.join(now, ["split", "fingerprint"], "left_semi").select("split"), "split", "left_semi")


def _header(block: Column, name: str) -> Column:
    """The value of the last such header line, null without one; only the first colon parts it from its name."""
    values = F.regexp_extract_all(block, F.lit(rf"(?m)^[ \t]*{name}[ \t]*:(.*)$"), F.lit(1))
    return text.squeeze(F.try_element_at(values, F.lit(-1)))


CASE_MARK = "=== "


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, label, tags, subject, body) of case files of any size.

    A line "=== id" opens a case, and what stands before the first is a comment; headers follow up to
    a line "---", then the body. A case without a label has a null one; without tags or a subject
    they are empty. Unknown labels and repeated ids raise. The mark at the start of a line parts records,
    so files are split between tasks at cases; only a file's first record, which is written as a table of
    one row a file, must be looked at for a mark of its own, as no line break stands before that.
    """
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    records = spark.read.option("lineSep", f"\n{CASE_MARK}").text(path).select("value", F.col("_metadata.file_path").alias("file"), at.alias("at"))
    records = written(records, "case-records")
    heads = records.groupBy("file").agg(F.min("at").alias("head"))
    head, opens = F.col("at") == F.col("head"), F.startswith("value", F.lit(CASE_MARK))
    block = F.when(head, F.substring("value", len(CASE_MARK) + 1, 2_147_483_647)).otherwise(F.col("value"))
    blocks = records.join(heads, "file").where(~head | opens).select(F.replace(block, F.lit("\r\n"), F.lit("\n")).alias("block"))
    return _unique_cases(parse_case(blocks))


def parse_case(blocks: DataFrame) -> DataFrame:
    """(case_id, label, tags, subject, body) of cases (block), each without its mark."""
    end = r"(?:\n[ \t]*---[ \t]*(?:\n|\z)|\z)"
    head, body = F.regexp_extract("block", rf"(?s)^(.*?){end}", 1), F.regexp_replace("block", rf"(?s)^.*?{end}", "")
    parsed = blocks.select(text.squeeze(F.regexp_extract("block", r"^([^\n]*)", 1)).alias("case_id"), F.regexp_replace(head, r"^[^\n]*", "").alias("head"), body.alias("body"))
    label = _header(F.col("head"), "label")
    return parsed.select(
        "case_id", F.when(label.isNotNull(), text.label_code(label)).alias("label"), F.coalesce(text.tag_list(_header(F.col("head"), "tags")), F.array().cast("array<string>")).alias("tags"),
        F.coalesce(_header(F.col("head"), "subject"), F.lit("")).alias("subject"), text.clean_body(F.col("body")).alias("body"),
    )


def _unique_cases(cases: DataFrame) -> DataFrame:
    """cases, which raise when they are read if an id is repeated."""
    again = cases.groupBy("case_id").agg(F.count("*").alias("n"))
    fine = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("repeated case id "), F.col("case_id"))).cast("boolean")).otherwise(F.lit(True))
    return cases.join(again.where(fine), "case_id").drop("n")


def read_until(spark: SparkSession, path: str, size: Column, most: int) -> DataFrame:
    """The first rows of a folder of parquet files, with `before`, the sum of size over the rows before each.

    Files count in the order of their names, rows in that of their files. Files are read in growing
    rounds, twice as many in each, until the sizes of whole files add up to more than `most`; later ones
    aren't opened. Rows that begin at `most` or beyond are left out. Raises where all files fall short.
    """
    files = sorted(r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path").collect())  # names only; contents aren't read
    rows = lambda some: spark.read.parquet(*some).select("*", size.cast("long").alias("_size"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    starts, total, done, step = [], 0, 0, 1
    while total <= most:
        if done >= len(files):
            raise ValueError(f"{path} has {total} of more than {most} that are asked for")
        some = files[done : done + step]
        sizes = {r["_file"]: r["n"] for r in rows(some).groupBy("_file").agg(F.sum("_size").alias("n")).collect()}  # a row for each file of the round
        for name in sorted(sizes):
            starts.append((name, total))
            total += sizes[name] or 0
        done, step = done + len(some), 2 * step
    base = F.broadcast(spark.createDataFrame(starts, "_file string, _start long"))  # a row for each file that was read
    own = Window.partitionBy("_file").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows(files[:done]).join(base, "_file").withColumn("before", F.col("_start") + F.coalesce(F.sum("_size").over(own), F.lit(0)))
    return placed.where(F.col("before") < most).drop("_file", "_row", "_size", "_start")


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(prompt): lines that are neither blank nor comments; a written \\n is a line break."""
    lines = spark.read.text(path)
    return lines.where((text.squeeze(F.col("value")) != "") & ~F.startswith("value", F.lit("#"))).select(F.replace("value", F.lit("\\n"), F.lit("\n")).alias("prompt"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """A run document; what a run lacks is null."""
    return spark.read.schema(RUN).json(path, multiLine=True)


def file_info(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def one_message(spark: SparkSession, subject: str = "", body: str | None = None, path: str | None = None, stdin=None) -> DataFrame:
    """(subject, body) of a single message, from an argument, else from a file, else from an open stream such as sys.stdin."""
    if body is None and path is None and stdin is not None:
        body = stdin.read()
    if body is not None:
        return spark.createDataFrame([(subject, body)], "subject string, body string")
    if path is None:
        raise ValueError("a body, a path or a stream is needed")
    return read_whole(spark, path).select(F.lit(subject).alias("subject"), F.col("value").alias("body"))
