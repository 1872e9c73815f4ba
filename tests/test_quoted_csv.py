"""CSV read by many tasks a file: against Python's own reader."""

import csv
import random

import pytest

from gridloom.sources import files, quoted


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", 300)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_across_ranges(spark, tmp_path, small_ranges, end):
    rng = random.Random(2)
    cell = lambda: rng.choice(["x", "", "a,b", 'say "hi"', '""', "two\nlines", "\n\n\n", "r\r\ns", "long\n" * 200, "é" * 30, ' "', "q,\n\""])
    rows = [[str(i), cell(), cell()] for i in range(400)]
    with (tmp_path / "a.csv").open("w", newline="") as f:
        csv.writer(f, lineterminator=end).writerows([["id", "a\nb", "c"], *rows])
    df = files.read_csv(spark, str(tmp_path / "a.csv"), keep_strings=True)
    assert df.columns == ["id", "a\nb", "c"] and df.rdd.getNumPartitions() > 20
    got = sorted(([v or "" for v in r] for r in df.collect()), key=lambda r: int(r[0]))
    assert got == rows


def test_plain_cases(spark, tmp_path, small_ranges):
    def read(text, **options):
        (tmp_path / "x.csv").write_bytes(text.encode())
        return files.read_csv(spark, str(tmp_path / "x.csv"), **options)

    df = read("name,age,score\nAlice,25,88.5\nBob,30,92.3\n")
    assert df.dtypes == [("name", "string"), ("age", "int"), ("score", "double")] and df.count() == 2
    assert [tuple(r) for r in read('name,note\n"Doe, John","said ""hi"""\n').collect()] == [("Doe, John", 'said "hi"')]
    assert read("1,2\n3,4\n", has_header=False).columns == ["column_0", "column_1"] and read("1,2\n3,4\n", has_header=False).count() == 2
    with pytest.raises(ValueError, match="unbalanced"):
        read('a,b\n"unterminated,2\n')
    with pytest.raises(Exception, match="rows differ"):
        read("a,b\n1,2\n3\n").collect()
    assert read("flag\ntrue\nfalse\ntrue\n").dtypes == [("flag", "boolean")]
    assert sorted(map(tuple, read("a,b\n1,\n,2\n").collect()), key=repr) == [(1, None), (None, 2)]
    assert read("a,b\r\n1,2\r\n\r\n3,4\r\n").count() == 2
    assert read("").columns == [] and read("only_one_column\nvalue\n").collect()[0][0] == "value"
    assert read("\ufeffa;b\n1;NA\n", delimiter=";", null_value="NA").collect()[0].asDict() == {"a": 1, "b": None}


def test_several_files(spark, tmp_path):
    for name, rows in (("a", 'k,v\n1,"x\ny"\n'), ("b", "k,v\n2,z\n")):
        (tmp_path / f"{name}.csv").write_text(rows)
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path)).collect())) == [(1, "x\ny"), (2, "z")]
    (tmp_path / "c.csv").write_text("k,w\n3,z\n")
    with pytest.raises(ValueError, match="headers"):
        files.read_csv(spark, str(tmp_path))


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    line = "{},\"first, line\nsecond \"\"line\"\"\"," + "x" * 120 + "\n"
    with (tmp_path / "a.csv").open("w") as f:
        f.write("id,a,b\n")
        f.writelines(line.format(i) for i in range(300_000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4 << 20)
    try:
        df = quoted.read(spark, str(tmp_path / "a.csv"))
        assert df.rdd.getNumPartitions() >= 10
        found = df.selectExpr("count(*) n", "count(distinct id) d", "count(distinct a) k", "min(a) a", "sum(length(b)) b").first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tuple(found) == (300_000, 300_000, 1, 'first, line\nsecond "line"', 300_000 * 120)
