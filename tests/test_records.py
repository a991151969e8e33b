"""Records of delimited files, read by blocks of any size."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from terraprofile.sources import records

BITS = ["a", "b c", '"x"', '"line\nbreak"', '"a ""quoted"" word\n\n"', '"sep , ; here"', "", '""', "5", "é"]


def written(tmp_path, n, seed):
    chance = random.Random(seed)
    wanted = {}
    for f in range(4):
        d = ",;\t|"[f]
        rows = [["h1", "h2", "h3"]] + [[chance.choice(BITS).replace(",", d) for _ in range(3)] for _ in range(n)]
        text = "\n".join(d.join(r) for r in rows) + ("\n" if f % 2 else "")
        (tmp_path / f"f{f}.csv").write_text(text, newline="")
        with open(tmp_path / f"f{f}.csv", newline="") as file:
            wanted[f"f{f}.csv"] = [[c.strip(" ") for c in r] for r in csv.reader(file, delimiter=d) if r]
    return wanted


def read(spark, folder):
    heads, rows = records.records(spark, str(folder))
    delimiter = F.when(F.contains("head", F.lit(",")), ",").when(F.contains("head", F.lit(";")), ";").when(F.contains("head", F.lit("\t")), "\t").otherwise("|")
    found = rows.join(heads, "path").select(F.element_at(F.split("path", "/"), -1).alias("file"), "first", "broken", records.cells(F.col("value"), delimiter).alias("cells"))
    return found.collect()


@pytest.mark.parametrize("block", [29, 333, 1 << 20])
def test_quoted_line_breaks_across_blocks(spark, tmp_path, block):
    wanted = written(tmp_path, 40, block)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        rows = read(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, expected in wanted.items():
        own = [r for r in rows if r.file == name]
        assert sorted(r.cells for r in own) == sorted(expected) and not any(r.broken for r in own)
        assert [r.cells for r in own if r.first] == [["h1", "h2", "h3"]]


def test_stray_quotes_keep_their_line_and_an_open_cell_is_broken(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n5" pipe,1\n7" pipe,2\n"open,3\nrest,4\n')
    rows = read(spark, tmp_path)
    assert sorted(r.cells for r in rows if not r.broken) == [['5" pipe', "1"], ['7" pipe', "2"], ["x", "y"]]
    assert [r.broken for r in rows].count(True) == 1


def test_states_behind_lines():
    assert [records.after_line(t, s) for t in ("a,b", 'a,"b', 'a"b', '"a""b"', 'x",y', 'x","y') for s in (0, 1)] == [0, 1, 1, 0, 0, 0, 0, 0, 0, 0, 1, 1]


def test_a_batch_walks_its_text_once_for_records(spark, tmp_path, monkeypatch):
    from terraprofile.plans.batch_report import batch_report

    (tmp_path / "a.csv").write_text('longitude,latitude,note\n' + "".join(f'{k % 9}.5,{42 + k % 8}.25,"two\nlines"\n' for k in range(50)))
    walked, pieces = spark.sparkContext.accumulator(0), records._pieces

    def counted(batches):
        def each():
            for batch in batches:
                walked.add(batch.num_rows)
                yield batch

        return pieces(each())

    monkeypatch.setattr(records, "_pieces", counted)
    row = batch_report(spark, str(tmp_path)).first()
    assert (row["Nb lignes"], row["n_bad"], row["Nb colonnes"]) == (50, 0, 3)
    assert walked.value == 101
