from collections import defaultdict

import pytest

from ticketflow.llm import mixing, sharding


def level(sizes, weights, budget, most):
    """Deals the budget by weight, again and again, until no source is above its cap."""
    got, open_ = {}, dict(sizes)
    while open_:
        total = sum(weights[s] for s in open_)
        share = {s: budget * weights[s] / total for s in open_}
        full = [s for s in open_ if share[s] >= most * sizes[s]]
        if not full:
            return got | share
        for s in full:
            got[s] = most * sizes[s]
            budget -= got[s]
            del open_[s]
    return got


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_mix_plan(which, request):
    docs = request.getfixturevalue(which)
    rows = docs.collect()
    sizes = defaultdict(int)
    words = {}
    for r in rows:
        n = len((r.text or "").encode().split())
        words[(r.doc_id, r.text)] = n
        sizes[r.source] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want = level(sizes, weights, 1.5 * sum(sizes.values()), 2)
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == len(rows)
    got = defaultdict(list)
    for r in plan:
        got[(r.source_size, round(r.target, 6))].append(r)
        assert 0 <= r.copies <= 2
    assert sorted(got) == sorted({(sizes[s], round(float(want[s]), 6)) for s in sizes})
    for (_, target), members in got.items():
        taken = sum(r.copies * r["size"] for r in members)
        assert abs(taken - target) <= max(r["size"] for r in members) * len({r.id for r in members}) or taken == target
    again = mixing.mix_plan(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, plan))


def test_sources_come_near_their_targets(documents):
    taken, most, goal = defaultdict(int), defaultdict(int), {}
    for r in mixing.mix_plan(documents).collect():
        key = (r.source_size, r.target)
        taken[key] += r.copies * r["size"]
        most[key] = max(most[key], r["size"])
        goal[key] = r.target
    assert all(abs(taken[k] - goal[k]) <= most[k] for k in goal)


def test_larger_budgets_take_more(documents):
    few = {r.id: r.copies for r in mixing.mix_plan(documents, share=0.5).collect()}
    many = {r.id: r.copies for r in mixing.mix_plan(documents, share=0.9).collect()}
    assert all(few[i] <= many[i] for i in few) and sum(few.values()) < sum(many.values())


def test_mixed(odd, none, documents):
    assert mixing.mixed(odd).columns == odd.columns
    assert mixing.mixed(none).count() == mixing.mix_plan(none).count() == 0
    copies = {r.id: r.copies for r in mixing.mix_plan(documents).collect()}
    counts = defaultdict(int)
    for r in mixing.mixed(documents).collect():
        counts[r.doc_id] += 1
    assert all(counts[i] == n for i, n in copies.items())


def smallest(sizes, shards):
    """Smallest capacity by trying every sum of neighbours."""
    sums = sorted({sum(sizes[i:j]) for i in range(len(sizes)) for j in range(i + 1, len(sizes) + 1)})
    for capacity in sums:
        used, held = 1, 0
        for n in sizes:
            if n > capacity:
                break
            if held + n > capacity:
                used, held = used + 1, 0
            held += n
        else:
            if used <= shards:
                return capacity


@pytest.mark.parametrize("shards", [1, 3, 7, 40])
def test_smallest_capacity(spark, shards, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST", 1)  # so that prefixes must be opened
    rows = [(f"{i * 2654435761 % 2**32:032x}"[::-1], 1 + i * i % 97) for i in range(150)]
    groups = spark.createDataFrame(rows, "key string, size long").cache()
    capacity, cuts = sharding.capacity_and_cuts(groups, shards)
    sizes = [n for _, n in sorted(rows)]
    assert capacity == smallest(sizes, shards)
    held = defaultdict(int)
    for key, n in rows:
        held[sum(key >= c for c in cuts)] += n
    assert len(cuts) < shards and max(held.values()) == capacity


@pytest.mark.parametrize("which", ["odd", "documents", "none"])
def test_sharded(which, request):
    docs = request.getfixturevalue(which)
    rows = sharding.sharded(docs, 6).collect()
    assert len(rows) == docs.count()
    by_shard, by_key = defaultdict(list), defaultdict(set)
    for r in rows:
        by_shard[r.shard].append(r)
        by_key[r.key].add(r.shard)
    assert all(len(s) == 1 for s in by_key.values())
    for shard, members in by_shard.items():
        assert 0 <= shard < 6
        assert sorted(r.slot for r in members) == list(range(len(members)))
    if which == "documents":
        sizes = {s: sum(r["size"] for r in m) for s, m in by_shard.items()}
        assert len(sizes) == 6 and max(sizes.values()) < 1.5 * sum(sizes.values()) / 6


def test_a_group_above_the_even_share_stands_alone(spark):
    docs = spark.createDataFrame([(i, "same " * 50) for i in range(100)] + [(i, f"text {i}") for i in range(100, 300)], "doc_id long, text string")
    held = defaultdict(int)
    hot = None
    for r in sharding.sharded(docs, 4).collect():
        held[r.shard] += r["size"]
        hot = r.shard if r.id == 0 else hot
    rest = [n for s, n in held.items() if s != hot]
    assert len(rest) == 3 and max(rest) - min(rest) < 200
