"""Heads of files, and profiles of wide tables, each from one look."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from terraprofile.operators import profile
from terraprofile.sources import files


@pytest.mark.parametrize("opens", [True, False])
def test_heads_are_read_alone(spark, tmp_path, monkeypatch, opens):
    if not opens:
        monkeypatch.setattr(files, "_opens", lambda uri: False)
    big = "a;b\r\n" + "1;2\n" * 500_000
    long = "x|" * 100_000 + "\n1|2\n"
    for name, text in {"big one.csv": big, "long.csv": long, "one line.csv": "a,b", "tab+é.csv": "a\tb\n1\t2\n"}.items():
        (tmp_path / name).write_text(text, newline="")
    rows = {r.file_path.rsplit("/", 1)[1]: r for r in files.file_heads(spark, str(tmp_path)).collect()}
    found = sorted((r.head[:3], len(r.head)) for r in rows.values())
    assert found == [("a\tb", 3), ("a,b", 3), ("a;b", 3), ("x|x", 200_000)]
    if opens:
        assert max(r.n_read for r in rows.values()) <= 4 * files.HEAD_BYTES and sorted(r.n_read for r in rows.values())[2] == files.HEAD_BYTES
    kinds = sorted(r.delimiter for r in files.detect_delimiter(spark, str(tmp_path)).collect())
    assert kinds == ["\t", ",", ";", "|"]


def wide(spark, n):
    day = datetime.date(2020, 1, 1)
    rows = [
        (k if k % 3 else None, float("nan") if k % 2 else k / 7, None, f"t{99 - k}", k % 2 == 0, day + datetime.timedelta(k), datetime.datetime(2021, 1, 1 + k % 20), decimal.Decimal(k) / 4, bytearray([k % 256]), {"a": k}, [k, 1], (k, "x"))
        for k in range(n)
    ]
    ddl = "i long, d double, e string, s string, b boolean, day date, ts timestamp, dec decimal(10,2), bin binary, m map<string,int>, l array<int>, st struct<p:int,q:string>"
    base = spark.createDataFrame(rows, ddl)
    return base.select("*", *[(F.col("i") + k).alias(f"w{k}") for k in range(290)])


@pytest.mark.parametrize("n", [0, 50])
def test_wide_tables_are_one_scan(spark, monkeypatch, n):
    df = wide(spark, n)
    folded = profile.column_catalog(df)
    plan = folded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "SortAggregate" not in plan
    got = [tuple(r) for r in folded.orderBy("position").collect()]
    ratios = [tuple(r) for r in profile.null_ratio_per_column(df).orderBy("position").collect()]
    monkeypatch.setattr(profile, "COMPILED_COLUMNS", 10**6)
    narrow = df.select(df.columns[:20])
    assert got[:20] == [tuple(r) for r in profile.column_catalog(narrow).orderBy("position").collect()] and len(got) == 302
    assert ratios[:20] == [tuple(r) for r in profile.null_ratio_per_column(narrow).orderBy("position").collect()]
