from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from ticketflow.fixed_values import LABELS
from ticketflow.functions.draws import hash_hex
from ticketflow.operators import profile, split


def counts(df):
    return {(r.split, r.category): r.n for r in profile.class_counts_by_split(df).collect()}


def test_standard_split_sizes(tickets):
    got = counts(split.train_val_test_split(tickets, labels=LABELS))
    assert [got["train", c] for c in LABELS] == [1050, 840, 630, 490, 315, 175]
    assert [got["validation", c] for c in LABELS] == [225, 180, 135, 105, 68, 37]
    assert [got["test", c] for c in LABELS] == [225, 180, 135, 105, 67, 38]
    totals = {r.part: r.n for r in profile.row_counts(split.train_val_test_split(tickets)).collect()}
    assert totals == {"train": 3500, "validation": 750, "test": 750, "total": 5000}


def test_equals_plain_window_and_is_stable(tickets):
    cut = split.stratified_split(tickets, labels=LABELS)
    sizes = {c: n for (s, c), n in counts(cut).items() if s == "train"}
    in_class = Window.partitionBy("category").orderBy(hash_hex(42, "split", "id"))
    plain = tickets.withColumn("rank", F.row_number().over(in_class)).select("id", "category", "rank").collect()
    expected = {r.id for r in plain if r["rank"] <= sizes[r.category]}
    train = {r.id for r in cut.filter("split = 'train'").select("id").collect()}
    assert train == expected and len(train) == 3500
    moved = split.stratified_split(tickets.repartition(5, "text"), labels=LABELS)
    assert {r.id for r in moved.filter("split = 'train'").select("id").collect()} == train
    other = split.stratified_split(tickets, labels=LABELS, seed=1)
    assert {r.id for r in other.filter("split = 'train'").select("id").collect()} != train


def test_largest_remainder():
    assert split.largest_remainder([135, 75], 105) == [68, 37]
    assert split.largest_remainder([10, 10, 10], 10) == [4, 3, 3]
    assert sum(split.largest_remainder([3 * 10**12, 7, 11], 10**12)) == 10**12


@given(st.lists(st.integers(1, 10**12), min_size=1, max_size=12), st.data())
def test_allocation_is_exact_and_proportional(counts, data):
    draws = data.draw(st.integers(0, sum(counts)))
    shares = split.largest_remainder(counts, draws)
    assert sum(shares) == draws
    for n, share in zip(counts, shares):
        assert 0 <= share <= n and abs(share * sum(counts) - n * draws) < sum(counts)


def test_null_is_a_class_of_its_own(spark):
    rows = [(i, None if i % 5 == 0 else "a") for i in range(50)]
    cut = split.stratified_split(spark.createDataFrame(rows, "id long, category string"), test_size="0.2")
    got = Counter((r.category, r.split) for r in cut.collect())
    assert got == {("a", "train"): 32, ("a", "test"): 8, (None, "train"): 8, (None, "test"): 2}


def test_integer_classes(spark):
    df = spark.range(40).withColumn("label", (F.col("id") % 4).cast("int"))
    got = Counter((r.label, r.split) for r in split.stratified_split(df, "label", "0.5").collect())
    assert set(got.values()) == {5}


@pytest.mark.parametrize(
    "categories",
    [["a"] * 9 + ["b"], ["a", "a", "b", "b"], []],
    ids=["class of one", "side too small", "empty"],
)
def test_refused(spark, categories):
    df = spark.createDataFrame(list(enumerate(categories)), "id long, category string")
    with pytest.raises(ValueError):
        split.stratified_split(df, test_size="0.25")


def test_rows_are_not_shuffled(tickets):
    """A split table is one scan and one broadcast of a row per class."""
    plan = split.train_val_test_split(tickets)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("BroadcastExchange") == 1
    assert "Exchange hash" not in plan and "SortMergeJoin" not in plan


def test_class_column_of_nulls_only(spark):
    df = spark.range(20).withColumn("category", F.lit(None).cast("string"))
    assert split.stratified_split(df, test_size="0.5").filter("split = 'train'").count() == 10


def test_repeated_keys_at_a_cut_are_refused(spark):
    df = spark.createDataFrame([(i // 20, "a") for i in range(100)], "id long, category string")
    with pytest.raises(ValueError, match="repeats"):
        split.stratified_split(df, test_size="0.25")


def test_nulls_in_a_key_are_told_apart(spark):
    rows = [(1, None, 2), (1, 2, None), (None, 1, 2)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    assert df.select(hash_hex(1, "t", "a", "b", "c").alias("h")).distinct().count() == 3


def test_any_number_of_classes(spark, monkeypatch):
    """20,000 classes, ordered by several tasks: the shares are those of the plain rule, equal remainders in class order."""
    monkeypatch.setattr(split, "CLASSES", 3_000)
    sizes = {c: 2 + c * c % 5 for c in range(20_000)}
    rows = spark.range(20_000).select(F.col("id").alias("category"), F.explode(F.sequence(F.lit(1), 2 + F.col("id") * F.col("id") % 5)).alias("nth"))
    total = sum(sizes.values())
    cut = split.stratified_split(rows, test_size="0.5", key=["category", "nth"])
    got = {r.category: r.n for r in cut.filter("split = 'train'").groupBy("category").agg(F.count("*").alias("n")).collect()}
    want = dict(zip(sizes, split.largest_remainder(list(sizes.values()), total - -(-total // 2))))
    assert {c: got.get(c, 0) for c in sizes} == want
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert cut.count() == total and "LocalRelation" not in plan


@pytest.mark.parametrize("sizes", [[3, 3, 3, 3, 3, 3, 3], [2, 9, 4, 10**12, 31, 10**12 + 1], [5]])
@pytest.mark.parametrize("share", ["0.3", "0.5"])
def test_allotted_equals_the_plain_rule(spark, sizes, share, monkeypatch):
    monkeypatch.setattr(split, "CLASSES", 2)
    classes = spark.createDataFrame([(i, 0, n) for i, n in enumerate(sizes)], "_class int, _place long, _n long")
    total = sum(sizes)
    draws = total - split.math.ceil(split.Decimal(share) * total)
    if min(draws, total - draws) < len(sizes):
        with pytest.raises(ValueError):
            split.allotted(classes, split.Decimal(share), "k")
    else:
        got = {r._class: r.k for r in split.allotted(classes, split.Decimal(share), "k").collect()}
        assert [got[i] for i in range(len(sizes))] == split.largest_remainder(sizes, draws)
