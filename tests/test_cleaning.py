import math

import pytest
from pyspark.sql import functions as F

from flowsieve.functions import columns as C
from flowsieve.functions import labels as L
from flowsieve.sources import flows_csv


def one(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_numbers_from_text(spark):
    cells = ["1", " 2 ", "Infinity", "-inf", "NaN", "abc", "", " ", "-", "1e3", "0x1", "1d", None,
             ".5", "5.", "+1", "1,000", "1e999", "--1", "0x1p3", "1_000"]
    got = one(spark, cells, C.to_number)
    assert got == [1.0, 2.0] + [None] * 7 + [1000.0] + [None] * 3 + [0.5, 5.0, 1.0] + [None] * 5


def test_coerce_keeps_other_columns_and_absent_names(spark):
    df = spark.createDataFrame([("7", "x", float("inf"))], "a string, b string, c double")
    out = C.coerce_numeric(df, ["a", "c", "absent"])
    assert [tuple(r) for r in out.collect()] == [(7.0, "x", None)]


def test_infinite_and_nan_become_null(spark):
    got = one(spark, [1.0, math.inf, -math.inf, math.nan, None], C.finite, "double")
    assert got == [1.0, None, None, None, None]


def test_sentinels_need_the_exact_cell(spark):
    df = spark.createDataFrame([(" ", "-"), ("--", "a-")], "a string, b string")
    assert [tuple(r) for r in C.sentinels_to_null(df).collect()] == [(None, None), ("--", "a-")]


def test_labels(spark):
    dirty = [" benign ", None, "", "nan", "Web Attack \u0096 XSS", "Web Attack – Sql Injection",
             "Web Attack  -  Brute Force", "web attack SQL injection", " Bot "]
    text = one(spark, dirty, L.label_text)
    assert text == ["benign", "nan", "", "nan", "Web Attack \u0096 XSS",
                    "Web Attack – Sql Injection", "Web Attack  -  Brute Force",
                    "web attack SQL injection", "Bot"]
    assert one(spark, dirty, lambda c: L.canonical_benign(L.label_text(c)))[0] == "BENIGN"
    clean = one(spark, dirty, lambda c: L.canonical_attack(L.label_text(c)))
    assert clean[4:] == ["Web Attack XSS", "Web Attack Sql Injection", "Web Attack Brute Force",
                         "Web Attack Sql Injection", "Bot"]
    assert one(spark, dirty, L.is_missing_label) == [False, True, True, True] + [False] * 5
    assert one(spark, ["BENIGN", "x", None], L.is_attack) == [0, 1, 1]
    assert one(spark, [None, " Fuzzers "], L.filled_label) == ["Normal", "Fuzzers"]


def test_rejected_labels_list_null(spark):
    df = spark.createDataFrame([("Bot",), ("odd",), ("odd",), (None,)], "label string")
    assert {r[0] for r in L.rejected_labels(df, "label").collect()} == {"odd", None}
    assert L.keep_allowed(df, "label").count() == 1


def test_header_names():
    assert flows_csv.unique_names(["a", "a", None, "a"]) == ["a", "a.1", "Unnamed: 2", "a.2"]
    assert C.normalise_name(" Flow Duration ") == "flow_duration"
    assert C.normalise_name(" Flow Duration ", keep_spaces=True) == "flow duration"


def test_scan_joins_files_by_name(spark, tmp_path):
    (tmp_path / "1.csv").write_text(" A, B,A, Label\n1,2,3, BENIGN\n,,,\n", encoding="latin-1")
    (tmp_path / "2.csv").write_text("Label,B\nDo S,5\nNaN,N/A\n", encoding="latin-1")
    (tmp_path / "3.csv").write_text("Label,B\nBot,6\n", encoding="latin-1")
    df = flows_csv.scan_headered(spark, f"{tmp_path}/*.csv")
    assert df.columns == ["a", "b", "a.1", "label"]
    got = sorted((tuple(r) for r in df.collect()), key=str)
    assert got == sorted(
        [("1", "2", "3", "BENIGN"), (None,) * 4, (None, "5", None, "Do S"), (None,) * 4,
         (None, "6", None, "Bot")], key=str)
    # One scan per distinct header, not per file.
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2


def test_headers_of_many_files_come_from_as_many_jobs_as_of_few(spark, tmp_path):
    heads = ["a,b", "b, a", 'a,"x, y"', "\n  \na,b"]
    for folder, files in (("few", 160), ("many", 320)):  # both above the number of paths that Spark lists in a job
        (tmp_path / folder).mkdir()
        for i in range(files):
            head = heads[i % 4]
            (tmp_path / folder / f"{i:03}.csv").write_text(f"{head}\r\n{i},-{i}\r\n" + "7,8\r\n" * (i % 3))
        (tmp_path / folder / "empty.csv").write_text("")
    tracker, jobs = spark.sparkContext.statusTracker(), {}
    for folder in ("few", "many"):
        spark.sparkContext.setJobGroup(f"headers-{folder}", folder)
        df = flows_csv.scan_headered(spark, f"{tmp_path}/{folder}/*.csv")
        jobs[folder] = len(tracker.getJobIdsForGroup(f"headers-{folder}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs["many"] == jobs["few"]
    assert len(df.inputFiles()) == 320 and sorted(df.columns) == ["a", "b", "x,_y"]
    rows = [tuple(r) for r in df.select("a", "b", "x,_y").collect()]
    expected = []
    for i in range(320):
        for a, b in [(str(i), f"-{i}")] + [("7", "8")] * (i % 3):
            expected.append({0: (a, b, None), 1: (b, a, None), 2: (a, None, b), 3: (a, b, None)}[i % 4])
    assert sorted(rows, key=str) == sorted(expected, key=str)


def test_header_lines_are_read_without_the_rest(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text("a,b\n" + "1,2\n" * 500_000)
    lines = flows_csv.header_lines(spark, f"{tmp_path}/*.csv")
    assert lines.rdd.getNumPartitions() == 3
    assert sorted(tuple(r) for r in lines.collect()) == [(f"file:{tmp_path}/{i}.csv", "a,b") for i in range(3)]


def test_scan_without_files(spark, tmp_path):
    with pytest.raises(Exception):
        flows_csv.scan_headered(spark, f"{tmp_path}/none/*.csv")


def test_column_subset_is_pruned(spark, tmp_path):
    (tmp_path / "1.csv").write_text("a,b,c\n1,2,3\n")
    df = flows_csv.scan_headered(spark, f"{tmp_path}/*.csv", columns=["c", "zz"])
    assert df.columns == ["c"]
    assert "ReadSchema: struct<c2:string>" in df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
