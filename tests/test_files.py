import pytest
from pyspark.sql import functions as F

from ticketflow.operators import score
from ticketflow.sources import tickets as files

ODD = [
    'comma, and "quote"',
    "line\nbreak\r\nand more",
    "  leading and trailing  ",
    'ends with "',
    "back\\slash and \\\" both",
    "é ñ ü 漢字 🙂",
    ",",
    '"',
]


def test_csv_keeps_odd_texts(spark, tmp_path):
    rows = [(i, t, "a", 3) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, files.TICKET)
    files.write_tickets(df, str(tmp_path / "csv"), "csv")
    back = files.read_tickets(spark, str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in back.collect()) == rows


def test_reads_what_pandas_writes(spark, tmp_path):
    import pandas as pd

    rows = [(i, t, "a", 3) for i, t in enumerate(ODD)]
    pd.DataFrame(rows, columns=files.TICKET.names).to_csv(tmp_path / "t.csv", index=False, encoding="utf-8")
    back = files.read_tickets(spark, str(tmp_path / "t.csv"))
    assert sorted(tuple(r) for r in back.collect()) == rows


BROKEN = """id,text,category,annotator_confidence
1,fits,a,3
two,"an id, that is none",a,4
3,no number,a,often
4,too short,a
5,too long,a,3,4
6,"over two
lines",b,2
7,,b,
"""


def test_refused_rows_are_told_apart(spark, tmp_path):
    (tmp_path / "t.csv").write_text(BROKEN)
    path = str(tmp_path / "t.csv")
    rows, refused = files.read_checked(spark, path)
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "fits", "a", 3), (6, "over two\nlines", "b", 2), (7, None, "b", None)]
    found = {r.text: r for r in refused.collect()}
    assert set(found) == {"an id, that is none", "no number", "too short", "too long"}
    assert found["an id, that is none"].id is None and found["an id, that is none"].annotator_confidence == 4
    assert found["no number"].id == 3 and found["no number"].annotator_confidence is None
    assert found["too short"][files.REFUSED].strip() == "4,too short,a"
    assert (rows.count(), refused.count(), refused.select(files.REFUSED).count()) == (3, 4, 4)
    # the plain read gives nulls, a strict one fails, whichever columns are asked for
    assert files.read_tickets(spark, path).count() == 7
    for columns in (["text"], files.TICKET.names):
        with pytest.raises(Exception, match="(?i)malformed"):
            files.read_tickets(spark, path, strict=True).select(*columns).collect()


def test_strict_reads(spark, tmp_path):
    rows = [(i, t, "a", 3) for i, t in enumerate(ODD)]
    files.write_tickets(spark.createDataFrame(rows, files.TICKET), str(tmp_path / "good"), "csv")
    assert sorted(tuple(r) for r in files.read_tickets(spark, str(tmp_path / "good"), strict=True).collect()) == rows
    (tmp_path / "names.csv").write_text("id,body,category,annotator_confidence\n1,x,a,3\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_tickets(spark, str(tmp_path / "names.csv"), strict=True).collect()
    (tmp_path / "t.json").write_text('{"id": 1, "text": "x"}\n{"id": "one", "text": "y"}\n{"id": 2, "te\n')
    good, refused = files.read_checked(spark, str(tmp_path / "t.json"), "json")
    assert [r.id for r in good.collect()] == [1] and refused.count() == 2
    (tmp_path / "none.csv").write_text("id,text,category,annotator_confidence\n")
    assert [df.count() for df in files.read_checked(spark, str(tmp_path / "none.csv"))] == [0, 0]
    with pytest.raises(ValueError):
        files.read_checked(spark, str(tmp_path / "good"), "parquet")


def test_other_formats(spark, tickets, tmp_path):
    small = tickets.select(*files.TICKET.names).limit(50)
    for fmt in ("parquet", "json", "orc"):
        files.write_tickets(small, str(tmp_path / fmt), fmt)
        back = files.read_tickets(spark, str(tmp_path / fmt), fmt)
        assert sorted(back.collect()) == sorted(small.collect())


def test_one_split_opens_one_folder(splits):
    train, validation, test = splits
    assert [df.count() for df in splits] == [3500, 750, 750]
    plan = validation._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_csv_splits(spark, tickets, tmp_path):
    cut = tickets.select(*files.TICKET.names).withColumn("split", F.when(F.col("id") % 2 == 0, "test").otherwise("train"))
    files.write_splits(cut, str(tmp_path / "s"), "csv")
    assert files.read_split(spark, str(tmp_path / "s"), "test", "csv").count() == 2500


def test_scored_and_routed(spark, tmp_path):
    rows = [(1, "t", "a", 3, "b", 0.81), (2, "u", "a", 3, "a", 0.8), (3, "v", "a", 3, "a", 1.0)]
    df = score.route(
        spark.createDataFrame(rows, "id long, text string, category string, annotator_confidence int, prediction string, confidence double")
    )
    files.write_scored(df, str(tmp_path / "scored"))
    assert sorted(files.read_scored(spark, str(tmp_path / "scored")).collect()) == sorted(df.collect())
    files.write_routed(df, str(tmp_path / "routed"))
    back = spark.read.parquet(str(tmp_path / "routed"))
    assert back.count() == 3
    assert [r.id for r in back.filter("decision = 'human_review'").collect()] == [2]


def test_inline_texts(spark):
    assert files.inline_examples(spark).count() == 10
    assert files.demo_texts(spark).count() == 6
