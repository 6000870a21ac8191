import hashlib
from functools import partial

import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from ticketflow.functions import text as tx
from ticketflow.operators import encode
from ticketflow.plans import oracle, queries

FOLDER = "/root/testdata/sf0.001"


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "text string").select(column.alias("c")).first().c


@pytest.mark.parametrize(
    "value, expected",
    [
        ("I CAN'T log-in, 2nd try!", ["i", "can", "t", "log", "in", "2nd", "try"]),
        ("", []),
        ("?! ... --", []),
        (None, []),
        ("Étéñ  Übung\n\tß", ["étéñ", "übung", "ß"]),
    ],
)
def test_tokens(spark, value, expected):
    assert one(spark, value, tx.tokens("text")) == expected


@pytest.mark.parametrize("n", [0, 125, 126, 127, 200])
def test_fixed_length(spark, n):
    df = spark.createDataFrame([(" ".join(["w"] * n),)], "text string")
    row = encode.encode_fixed(df).first()
    real = min(n, 126)
    assert row.tokens == ["[CLS]"] + ["w"] * real + ["[SEP]"] + ["[PAD]"] * (126 - real)
    assert row["mask"] == [1] * (real + 2) + [0] * (126 - real)


def test_truncate_needs_room(spark):
    with pytest.raises(ValueError):
        tx.truncate(F.col("x"), 1)


def test_pad_to_longest_of_batch(spark):
    rows = [(0, ["a"]), (0, ["a", "b", "c"]), (1, ["d"])]
    padded = encode.pad_batch(spark.createDataFrame(rows, "batch_id int, tokens array<string>")).collect()
    got = sorted((r.batch_id, r.tokens, r["mask"]) for r in padded)
    assert got == [
        (0, ["a", "[PAD]", "[PAD]"], [1, 0, 0]),
        (0, ["a", "b", "c"], [1, 1, 1]),
        (1, ["d"], [1]),
    ]


def test_vocabulary_and_ids(spark):
    docs = encode.tokenize(spark.createDataFrame([("b a b c",), ("a b d",), ("",)], "text string"))
    vocabulary = encode.build_vocabulary(docs, 3)
    assert {r.token: r.token_id for r in vocabulary.collect()} == {"b": 4, "a": 5, "c": 6}
    rows = [("c x a",), ("",), ("[PAD]",)]
    ids = encode.token_ids(encode.tokenize(spark.createDataFrame(rows, "text string")), vocabulary)
    assert [r.ids for r in ids.collect()] == [[6, 1, 5], [], [1]]
    assert ids.select(encode.pad_ids("ids", 4).alias("p")).first().p == [6, 1, 5, 0]


def test_large_vocabulary_is_refused(spark):
    docs = encode.tokenize(spark.createDataFrame([("a b c d",)], "text string"))
    with pytest.raises(Exception, match="exceeds 3"):
        encode.token_ids(docs, encode.build_vocabulary(docs), limit=3).collect()
    assert encode.token_ids(docs, encode.build_vocabulary(docs), limit=4).first().ids


def test_few_rows_look_up_a_large_vocabulary(spark):
    docs = encode.tokenize(spark.createDataFrame([("b a b c e",), ("a b d",)], "text string"))
    vocabulary = encode.build_vocabulary(docs)
    rows = encode.tokenize(spark.createDataFrame([("b x a b",), ("",), (None,), ("[UNK] y",)], "text string"))
    used = encode.used_vocabulary(vocabulary, rows)
    assert {r.token: r.token_id for r in used.collect()} == {"b": 4, "a": 5}
    assert [r.ids for r in encode.token_ids(rows, used, limit=2).collect()] == [[4, 1, 5, 4], [], [], [1, 1]]
    none = encode.tokenize(spark.createDataFrame([("x y",), ("",)], "text string"))
    assert [r.ids for r in encode.token_ids(none, encode.used_vocabulary(vocabulary, none), limit=1).collect()] == [[1, 1], []]


def test_examples_are_encoded_beyond_the_limit(spark, monkeypatch):
    limit = 100  # the ten examples have 65 distinct tokens, the documents far more
    assert queries.vocabulary(spark, FOLDER).count() > limit
    monkeypatch.setattr(encode, "token_ids", partial(encode.token_ids, limit=limit))
    sql = oracle.sql()["example_token_ids"]
    assert difference(spark, connect(FOLDER), queries.example_token_ids, sql, FOLDER) is None


def test_whole_vocabulary_by_lookup_and_by_join(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = encode.tokenize(docs.union(spark.createDataFrame([(-1, ""), (-2, None), (-3, "[PAD] same same")], "doc_id long, text string")))
    known = docs.filter("doc_id % 3 != 0")
    vocabulary = encode.build_vocabulary(known)
    counts = known.selectExpr("explode(tokens) AS token").groupBy("token").count().collect()
    want = sorted(counts, key=lambda r: (-r["count"], hashlib.md5(r.token.encode()).hexdigest()))
    assert {r.token: r.token_id for r in vocabulary.collect()} == {r.token: i + 4 for i, r in enumerate(want)}
    found = {r.doc_id: r.ids for r in encode.token_ids(docs, vocabulary).collect()}
    assert found == {r.doc_id: r.ids for r in encode.joined_token_ids(docs, vocabulary, ["doc_id"]).collect()}
    assert len(found) == docs.count()


def test_rows_without_a_batch_stay(spark):
    rows = [(None, ["a"]), (None, ["a", "b"]), (1, [])]
    padded = encode.pad_batch(spark.createDataFrame(rows, "batch_id int, tokens array<string>")).collect()
    assert sorted(len(r.tokens) for r in padded) == [0, 2, 2]


def test_ids_need_no_shuffle_of_the_rows(spark):
    docs = encode.tokenize(spark.createDataFrame([("a b",)], "text string"))
    ids = encode.token_ids(docs, encode.build_vocabulary(docs, 10))
    plan = ids._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert "Exchange" not in main and "Python" not in main


def test_map_batches(spark):
    def double(batch):
        assert len(batch) <= 4
        return batch.assign(id=batch["id"] * 2)

    got = encode.map_batches(spark.range(10), double, "id long", batch_size=4).collect()
    assert sorted(r.id for r in got) == list(range(0, 20, 2))
