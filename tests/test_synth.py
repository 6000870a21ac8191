from ticketflow.fixed_values import CLASS_QUOTAS, CONFIDENT_CLASSES
from ticketflow.operators import profile, synth
from ticketflow.schema import quota_table


def test_counts_and_domains(tickets):
    counts = [(r.category, r.n) for r in profile.class_counts(tickets).collect()]
    assert counts == list(CLASS_QUOTAS.items())
    shares = [r.pct for r in profile.class_counts(tickets, pct=True).collect()]
    assert shares == [30.0, 24.0, 18.0, 14.0, 9.0, 5.0]
    rows = tickets.collect()
    for r in rows:
        low = 3 if r.category in CONFIDENT_CLASSES else 2
        assert low <= r.annotator_confidence <= 5
        assert r.text and "{" not in r.text
    assert len({r.text for r in rows}) <= 160
    assert {r.annotator_confidence for r in rows if r.category == "general"} == {2, 3, 4, 5}


def test_ids_follow_quota_order_and_positions_are_a_permutation(tickets):
    rows = sorted(tickets.select("id", "category", "pos").collect())
    assert [r.id for r in rows] == list(range(1, 5001))
    expected = [c for c, n in CLASS_QUOTAS.items() for _ in range(n)]
    assert [r.category for r in rows] == expected
    assert sorted(r.pos for r in rows) == list(range(5000))
    assert [r.pos for r in rows] != list(range(5000))


def test_same_rows_under_any_partitioning(spark, tickets):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        again = synth.synthesize_tickets(spark)
        assert sorted(again.collect()) == sorted(tickets.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    other = synth.synthesize_tickets(spark, seed=43)
    assert other.join(tickets, ["id", "text", "annotator_confidence"]).count() < 4000


def test_expansion_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(synth, "CHUNK", 7)
    quotas = quota_table(spark, {"a": 20, "none": 0, "b": 7, "c": 1})
    rows = sorted(tuple(r) for r in synth.expand_quota(quotas).collect())
    assert rows == list(zip(range(1, 29), "a" * 20 + "b" * 7 + "c"))


def test_preview(tickets):
    assert [r.pos for r in profile.preview(tickets, 5).collect()] == [0, 1, 2, 3, 4]
