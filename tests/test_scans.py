"""Scans that split files: quoted CSV, case files, and reading until there is enough."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import dedup
from millrace.sources import readers


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_quoted_csv_splits_and_keeps_its_records(spark, tmp_path, small_splits):
    rng = random.Random(4)
    words = ["plain", "a,b", 'say "hi"', "two\nlines", "\n", "", "x" * 300, "end\n\n", '"', "long\n" * 200, " spaced ", "é日本"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 4)))) for i in range(300)]
    for name, part in (("a.csv", rows[:200]), ("b.csv", rows[200:])):
        with open(tmp_path / name, "w", newline="") as out:
            csv.writer(out, lineterminator="\r\n" if name == "b.csv" else "\n").writerows([("id", "body"), *part])
    df = readers.read_csv(spark, str(tmp_path), "id bigint, body string")
    assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 8
    assert sorted((r.id, r.body or "") for r in df.collect()) == rows
    assert readers.read_csv(spark, str(tmp_path), "id bigint, body string", ["body"]).columns == ["body"]
    (tmp_path / "only").mkdir()
    (tmp_path / "only" / "c.csv").write_text("id,body\n")
    assert readers.read_csv(spark, str(tmp_path / "only"), "id bigint, body string").count() == 0


def test_case_files_split_at_cases(spark, tmp_path, small_splits):
    cases = [(f"c{i}", "=== not a mark inside\n" if i % 7 == 0 else f"body {i}\n\nmore: words ===\n" * (i % 5)) for i in range(120)]
    text = "# a comment\n" + "".join(f"=== {k}\nlabel: {'spam' if i % 2 else 'legitimate'}\nsubject: Re: {k}\n---\n {b if not b.startswith('=== ') else ' ' + b}" + "\n" for i, (k, b) in enumerate(cases))
    (tmp_path / "one.txt").write_text(text)
    (tmp_path / "two.txt").write_text("=== first of its file\r\nlabel: spam\r\n---\r\nx\r\n=== === doubled mark\n---\ny")
    (tmp_path / "three.txt").write_text("nothing but a comment")
    got = {r.case_id: r for r in readers.read_cases(spark, str(tmp_path)).collect()}
    assert len(got) == 122 and got["first of its file"].body == "x" and got["=== doubled mark"].body == "y"
    assert all(got[k].body == b.strip() and got[k].subject == f"Re: {k}" and got[k].label == i % 2 for i, (k, b) in enumerate(cases))
    (tmp_path / "four.txt").write_text("=== c1\n---\nagain")
    with pytest.raises(Exception, match="repeated case id c1"):
        readers.read_cases(spark, str(tmp_path)).collect()


def test_reading_until_enough_opens_no_later_file(spark, tmp_path):
    for k in range(8):
        spark.createDataFrame([(10 * k + i, 3) for i in range(4)], "id long, n int").coalesce(1).write.parquet(str(tmp_path / "t" / f"{k}"))
        part = next((tmp_path / "t" / f"{k}").glob("*.parquet"))
        part.rename(tmp_path / f"part-{k}.parquet")
    for k in range(3, 8):
        (tmp_path / f"part-{k}.parquet").write_bytes(b"not parquet at all")
    got = readers.read_until(spark, str(tmp_path), F.col("n"), 30).orderBy("before").collect()
    assert [(r.id, r.before) for r in got] == [(10 * (i // 4) + i % 4, 3 * i) for i in range(10)]
    with pytest.raises(Exception, match="parquet|Parquet"):
        readers.read_until(spark, str(tmp_path), F.col("n"), 36)
    for k in range(3, 8):
        (tmp_path / f"part-{k}.parquet").unlink()
    with pytest.raises(ValueError, match="has 36 of more than 36"):
        readers.read_until(spark, str(tmp_path), F.col("n"), 36)


def test_best_matches_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dedup, "PLACES", [0, 1, 3, 1 << 31])
    rng = random.Random(9)
    draw = lambda: sorted({min(int(rng.expovariate(0.08)), 60) for _ in range(rng.randrange(0, 25))})
    sides = [[(i, draw()) for i in range(lo, lo + 60)] for lo in (0, 1000)]
    sides[0][7:9] = [(7, sides[1][3][1]), (8, sides[1][3][1])]
    sides[1][5] = (1005, sides[1][3][1])
    q, r = (spark.createDataFrame(s, "id long, set array<long>") for s in sides)
    got = {x.i: (x.match, round(x.similarity, 9), x.flagged) for x in dedup.best_matches(q, r).collect()}
    for i, a in sides[0]:
        scored = [(-len({*a} & {*b}) / len({*a} | {*b}), j) for j, b in sides[1] if {*a} & {*b}]
        best = min(scored, default=None)
        assert got[i] == ((best[1], round(-best[0], 9), -best[0] >= 0.8) if best else (None, 0.0, False))


def test_groups_over_classes_are_the_walk_over_rows(spark):
    rng = random.Random(2)
    base = [[rng.randrange(1000) for _ in range(20)] for _ in range(6)]
    rows = []
    for i in range(80):
        s = [*rng.choice(base)]
        for _ in range(rng.choice([0, 0, 1, 2])):
            s[rng.randrange(20)] = rng.randrange(1000)
        rows.append((i, sorted(set(s)) if i % 11 else []))
    sets = spark.createDataFrame(rows, "id long, set array<long>")
    nodes = sets.select("id")
    want = sorted(map(tuple, dedup.greedy_groups(nodes, dedup.similar_pairs(sets)).collect()))
    assert sorted(map(tuple, dedup.similar_groups(nodes, sets).collect())) == want
