import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from math import log10

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from ticketflow.llm import exact, lm, mixing, packing, quality, sharding, simhash, sketch, tables, unigram, urls
from ticketflow.llm.queries import PIECE_TOKENIZER, QUERIES, WORD_TOKENIZER

ALPHABET = "abcXYZ ’'éÉßİıſ.,!  \n\t  ́ẛΣσ漢字12\x1f▁<|endoftext|>ﬁññ\U0001f600"


def noise(n, seed=1, alphabet=ALPHABET):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_ids_equal_the_tokenizers():
    texts = [*noise(3000), "a<|endoftext|>b", "don't I'LL 's !!", "İ.", "word " * 50]
    tokenizer = Tokenizer.from_file(WORD_TOKENIZER)
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    encoder = packing.Encoder(WORD_TOKENIZER)
    assert encoder.encode(texts) == want
    assert encoder.encode(texts[::-1]) == want[::-1]


@pytest.mark.parametrize("which", ["odd", "documents", "none"])
def test_packed(which, request):
    docs = request.getfixturevalue(which)
    rows = packing.packed(docs, WORD_TOKENIZER, 512).collect()
    tokenizer = Tokenizer.from_file(WORD_TOKENIZER)
    want = Counter()
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for p, i in enumerate(range(0, len(ids), 512)):
            part = np.array(ids[i : i + 512], "<u4")
            want[(r.doc_id, p, i, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(r.length for r in rows)
    assert len(held) <= 1.05 * total / 512 + 2


def test_plan_holds_the_histogram():
    rng = np.random.default_rng(3)
    histogram = np.bincount(np.minimum(rng.lognormal(5.3, 1, 200_000).astype(int) + 1, 1024), minlength=1025)
    used = packing.plan(histogram, 1024)
    held = np.zeros_like(histogram)
    for pattern, n in used:
        assert sum(size * k for size, k in pattern) <= 1024 and n > 0
        for size, k in pattern:
            held[size] += n * k
    assert (held == histogram).all()
    sequences, tokens = sum(n for _, n in used), int((histogram * np.arange(1025)).sum())
    assert sequences <= 1.002 * tokens / 1024 + 1


def test_token_counts_equal_the_tokenizers(odd, none):
    pieces = unigram.vocabulary(PIECE_TOKENIZER)
    bytes_ = [(f"<0x{b:02X}>", 0.0) for b in range(256)]
    least = min(s for _, s in pieces)
    model = models.Unigram([("<unk>", least), *((p, s) for p, s in bytes_), *pieces], 0, True)
    counter = unigram.Counter(pieces)
    texts = [t for t in noise(1500, 2, "abctheing THE  .,!\n\té漢\U0001f600▁") if t]
    for text in texts:
        tokens = model.tokenize("▁" + text.replace(" ", "▁"))
        assert counter.count(text)[0] == len(tokens), text
        assert counter.count(text) == counter.viterbi("▁" + text.replace(" ", "▁"))
    got = unigram.token_counts(odd, PIECE_TOKENIZER).collect()
    by = {r.doc_id: r.text for r in odd.collect()}
    assert len(got) == odd.count() and all(r.n_tokens == 0 for r in got if r.doc_id is not None and not by[r.doc_id])
    assert unigram.token_counts(none, PIECE_TOKENIZER).count() == 0


def test_ties_go_to_the_longest_piece():
    counter = unigram.Counter([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("abab", -4.0)])
    assert counter.viterbi("abab") == (1, -4.0)


def test_sketches():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    a = [rng.choice(words) for _ in range(6000)]
    b = a[:4000] + [rng.choice(words) for _ in range(3000)]
    sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b)]
    one, two = sketch.sketches([" ".join(a), " ".join(b).upper()], 5, 1024)
    true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert abs(sketch.resemblance(one, two, 1024) - true) < 0.06
    assert abs(sketch.distinct(one, 1024) / len(sets[0]) - 1) < 0.12
    assert abs(sketch.containment(one, two, 1024) - len(sets[0] & sets[1]) / len(sets[0])) < 0.1
    # parts that overlap by four words have the shingles of the whole
    parts = sketch.sketches([" ".join(a[:3000]), " ".join(a[2996:])], 5, 1024)
    assert (sketch.merge(*parts, 1024) == one).all()
    assert (sketch.from_text(sketch.to_text(one)) == one).all()
    nothing = sketch.sketches([""])[0]
    assert sketch.resemblance(nothing, nothing) == 1 and sketch.resemblance(nothing, one) == 0


def in_order(docs):
    """(doc_id, text) in descending doc_id, null last, rows of one id by the hash of their texts."""
    rows = ((r.doc_id, r.text or "") for r in docs.collect())
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) ^ 2**63) - 2**63
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1]), r[1]))


@pytest.mark.parametrize("parts", [1, 4, 50])
@pytest.mark.parametrize("which", ["odd", "documents", "none"])
def test_compared(which, parts, request):
    docs = request.getfixturevalue(which)
    rows = in_order(docs)
    want = Counter()
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = sketch.sketches([text, edited, after])
        want[(i, len(text), sha256(edited.encode()).hexdigest(), sketch.to_text(a), sketch.to_text(b), sketch.resemblance(a, b), sketch.resemblance(a, c))] += 1
    got = sketch.compared(docs, parts=parts).drop("contained_edited", "distinct_shingles").collect()
    assert Counter(map(tuple, got)) == want


@pytest.fixture(scope="module", params=["one id", "no id", "one row"])
def hot(request, spark):
    """Documents, a third of them under one id or none, or all the same row."""
    every = spark.range(0, 9_000, 1, 12).withColumn("hot", F.col("id") % 3 == 0)
    shared = F.lit(None if request.param == "no id" else 5_000).cast("long")
    text = F.lit("the same") if request.param == "one row" else F.concat(F.lit("text "), F.col("id").cast("string"))
    doc_id = F.when(F.col("hot"), shared).otherwise(F.col("id"))
    return every.select(doc_id.alias("doc_id"), F.when(F.col("hot"), text).otherwise(F.concat(F.lit("own "), F.col("id").cast("string"))).alias("text"))


def test_a_hot_id_is_dealt_over_tasks(hot):
    dealt = sketch.beside_next(hot, 8)
    tasks = dealt.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.countDistinct("part").alias("parts")).collect()
    assert len(tasks) == 8 and all(t.parts == 1 for t in tasks) and max(t.n for t in tasks) < 9_000 / 4
    rows = in_order(hot)
    want = Counter((i, text[: len(text) - len(text) // 3] + after[: len(text) // 3]) for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]))
    got = sketch.compared(hot, parts=8).select("doc_id", "edited_sha256").collect()
    assert Counter(map(tuple, got)) == Counter({(i, sha256(t.encode()).hexdigest()): n for (i, t), n in want.items()})


def test_a_hot_id_is_numbered_by_many_tasks(hot):
    """Ranks within a value are gapless, and no window holds more than one written part of a hot row."""
    runs = tables.stored_runs(hot.withColumn("by", F.lit(1)), "runs")
    assert runs.groupBy("by", "run").count().agg(F.max("count")).first()[0] < 9_000 / 4
    ranks = tables.ranked(runs, "by", ["doc_id", "text"], "rank")
    assert ranks.columns == ["by", "doc_id", "text", "rank"]
    assert sorted(r["rank"] for r in ranks.collect()) == list(range(9_000))
    sequences = packing.packed(hot, WORD_TOKENIZER, 512).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("to")).collect()
    assert all(r.n == r.to <= 512 for r in sequences)
    slots = sharding.sharded(hot, 4).groupBy("shard").agg(F.countDistinct("slot").alias("n"), F.max("slot").alias("to"), F.count("*").alias("rows")).collect()
    assert all(r.n == r.rows == r.to + 1 for r in slots) and sum(r.rows for r in slots) == 9_000


def kneser_ney(train, texts):
    """log10 of texts by dictionaries; train and texts are lists of words."""
    pairs, own = Counter(), Counter()
    for t in train:
        t = [*t, None]
        own.update(t)
        pairs.update(zip(["<s>", *t], t))
    before, stood = Counter(w for _, w in pairs), Counter()
    for (v, _), n in pairs.items():
        stood[v] += n
    d, low = (lm.discounts(*(list(c.values()).count(k) for k in (1, 2, 3, 4))) for c in (pairs, before))
    cut = lambda n, by: (0.0, *by)[min(n, 3)]
    spare = Counter()
    for (v, _), n in pairs.items():
        spare[v] += cut(n, d)
    rest = sum(cut(n, low) for n in before.values()) / len(pairs)

    def p(v, w):
        q = max(before[w] - cut(before[w], low), 0) / len(pairs) + rest / (len(own) + 1)
        return (max(pairs[(v, w)] - cut(pairs[(v, w)], d), 0) + spare[v] * q) / stood[v] if stood[v] else q

    total = sum(own.values())
    for t in texts:
        t = [*t, None]
        yield (
            len(t), sum(w in own for w in t), total,
            sum(log10((own[w] + 1) / (total + len(own) + 1)) for w in t),
            sum(log10(p(v, w)) for v, w in zip(["<s>", *t], t)),
        )
    every = [*own, "never seen"]
    assert abs(sum(p("the", w) for w in every) - 1) < 1e-9


def test_language_model(documents):
    rows = documents.collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows}
    split = {r.doc_id: [w.decode() for w in (r.text or "").encode().lower().split()] for r in rows}
    want = dict(zip(split, kneser_ney([split[i] for i in split if not held[i]], split.values())))
    got = lm.scored(documents, lm.fit(lm.training(documents))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == held[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert (r.base_score, r.score) == pytest.approx(want[r.doc_id][3:], rel=1e-9)
    new = [r for r in got if r.held_out]
    assert sum(r.score for r in new) > sum(r.base_score for r in new)


def test_language_model_of_odd_rows(odd, none):
    got = lm.scored(odd, lm.fit(lm.training(odd))).collect()
    assert len(got) == odd.count() and all(r.score < 0 and r.n_tokens > 0 for r in got)
    assert lm.scored(none, lm.fit(lm.training(none))).count() == 0
    for r in lm.scored(odd, lm.fit(lm.training(none))).collect():
        assert (r.train_tokens, r.n_known, r.score, r.base_score) == (0, 0, 0.0, 0.0)


def test_packed_arrays():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 1000, np.uint64))
    counts = np.arange(len(keys)) + 1
    a, b = lm.unpacked(lm.packed(keys, counts))
    assert (a == keys).all() and (b == counts).all()


def test_word_hashes_do_not_depend_on_the_place(monkeypatch):
    from ticketflow.llm import words

    texts = pa.array(["Ab cd " * 40, "x" * 5_000 + " ab\ncd", None])
    data, starts, ends, counts = words.spans(texts)
    want = [bytes(data[a:b]).lower() for a, b in zip(starts, ends)]
    usual = words.hashes(data, starts, ends)
    assert counts.tolist() == [80, 3, 0] and len(set(usual.tolist())) == len(set(want)) == 3
    assert len({(w, h) for w, h in zip(want, usual.tolist())}) == 3
    monkeypatch.setattr(words, "HASH_BYTES", 64)
    assert (words.hashes(data, starts, ends) == usual).all()


def test_quality(spark, odd, none):
    folder = "/root/testdata/sf0.01"
    scored = QUERIES["op2_quality"](spark, folder)
    both = scored.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    good, bad = ([r.score for r in both if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.85
    assert np.mean([r.predicted == r.quality for r in both]) > 0.95
    assert np.mean([r.predicted for r in both if r.quality == 1]) > 0.98
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)] + [(None, 1, 0), (3, None, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    for model in (quality.fit(odd, labels), quality.fit(none, labels), quality.fit(odd, labels.limit(0))):
        got = quality.scores(odd, model).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
        assert quality.accepted(odd, model).columns == odd.columns
        assert quality.scores(none, model).count() == 0


def test_quality_learns_from_repeated_and_very_long_rows(spark):
    """One text of each id, and none above the bound, whatever else the id has."""
    rows = [(i, f"{'fine words of many kinds ' if i % 2 else 'spam spam spam '}{i} " * 9) for i in range(60)]
    docs = spark.createDataFrame([*rows, *rows[:7] * 200, (61, "long " * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(62)], "doc_id long, quality int")
    once = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert quality.fit(docs, labels, size=400_000) == once and once.good and once.bad
    assert quality.fit(docs, labels, size=0) == quality.fit_texts([], [])


URLS = [
    ("http://A.example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/"), ("x://net", "net", "", None),
    ("https://b.net/q", "b.net", "/q", "net/"), ("http://fakenet/", "fakenet", "/", None), ("no scheme", "", "", None),
    ("http://example.com/de/?://x/", "example.com", "/de/", "example.com/de/"), ("http://s.org/fr/a#b", "s.org", "/fr/a", "org/fr/"),
    (None, "", "", None), ("http://h\n.net?q", "h\n.net", "", None), ("", "", "", None), ("http://notexample.com/de/", "notexample.com", "/de/", None),
]


def test_hosts_and_stated_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(URLS)], "page_id long, url string, host string").union(
        spark.createDataFrame([(None, URLS[0][0], None)], "page_id long, url string, host string")
    )
    labels = spark.createDataFrame([], "id long, bad boolean")
    got = urls.judged(pages, labels).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r.host, r.path, r.rule) == URLS[r.page_id or 0][1:]
        assert r.verdict == ("block" if r.rule in ("net/", "example.com/de/") else "allow")
    assert urls.judged(pages.limit(0), labels).count() == 0


def test_mined_rules(spark):
    rng = random.Random(2)
    rows = []
    for i in range(800):
        host, top, lang = rng.choice(["pills", "news", "shop"]), rng.choice(["com", "info"]), rng.choice(["en", "de"])
        rows.append((i, f"http://{host}.{top}/{lang}/{i}", host == "pills" and lang == "de" or host == "shop" and top == "info"))
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[:600]], "id long, bad boolean")
    got = {r.page_id: r for r in urls.judged(pages, labels, rules=()).collect()}
    assert all((got[i].verdict == "block") == bad for i, _, bad in rows)

    # the same rules by counting every combination
    tokens = {r.page_id: tuple(r.tokens) for r in pages.select("page_id", urls.host_of().alias("host"), urls.path_of().alias("path")).select("page_id", urls.tokens().alias("tokens")).collect()}
    from itertools import combinations

    seen = defaultdict(Counter)
    for i, _, bad in rows[:600]:
        for k in (1, 2, 3):
            for c in combinations(tokens[i], k):
                seen[c]["block" if bad else "allow"] += 1
    sure = {(c, v): n / sum(by.values()) for c, by in seen.items() for v, n in by.items() if n >= 20 and n / sum(by.values()) >= 0.9}
    want = {
        (c, v) for (c, v), p in sure.items()
        if not any(sure.get((s, v), 0) >= p for k in (len(c) - 1, 1) if 0 < k < len(c) for s in combinations(c, k))
    }
    known = spark.createDataFrame([(list(tokens[i]), "block" if bad else "allow") for i, _, bad in rows[:600]], "tokens array<string>, verdict string")
    assert {(tuple(r.tokens), r.verdict) for r in urls.mine(known).collect()} == want


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    left = {r.id for r in quality.scores(docs, model).collect() if r.score >= 0.5}
    last = {}
    for i in sorted(left):
        last[rows[i].text] = i
    left = set(last.values())
    fps = {i: simhash.fingerprint(rows[i].text.encode()) for i in sorted(left)}
    left = [i for i in fps if not any(j < i and (fps[i] ^ fps[j]).bit_count() <= 2 for j in fps)]
    copies = {r.id: r.copies for r in mixing.mix_plan(docs.filter(F.col("doc_id").isin(left))).collect()}
    assert set(copies) == set(left)
    got = corpus_pipeline.run(spark, folder).collect()
    firsts = Counter(r.doc_id for r in got if r.piece == 0)
    assert firsts == Counter({i: n for i, n in copies.items() if n})
    assert len(corpus_pipeline.STAGES) == 5 and exact.drop_copies(docs).columns == docs.columns


def test_pipeline_on_odd_and_empty_tables(spark, odd, none, tmp_path):
    import corpus_pipeline

    for name, docs in (("odd", odd), ("none", none)):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        # without labels nothing is rejected: pieces come of the texts that stay
        left = simhash.one_of_each(exact.drop_copies(docs))
        copies = {(r.id, r.copies) for r in mixing.mix_plan(left).collect() if r.copies}
        assert sorted({r.doc_id for r in got}, key=str) == sorted({i for i, _ in copies}, key=str)


def test_counts_beyond_four_bytes(spark, tmp_path):
    keys, counts = np.array([1, 5, 9], np.uint64), np.array([2**32 + 5, 3, 2**40], np.int64)
    got = lm.unpacked(lm.packed(keys, counts))
    assert got[0].tolist() == keys.tolist() and got[1].tolist() == counts.tolist()
    assert lm.narrow(counts[1:2]).dtype == np.uint32 and lm.narrow(counts).tolist() == counts.tolist()
    train = spark.createDataFrame([("a b a b a",), ("b a c",)], "text string")
    model = lm.fit(train, folder=str(tmp_path / "model"), shards=1)
    n = model.pairs[0]
    lm.narrow(np.arange(n) + 2**33).tofile(model.file("times", 0))
    known = np.fromfile(model.file("key", 0), np.uint64)
    assert model.counts_of(known).tolist() == [2**33 + i for i in range(n)]


def test_long_urls_do_not_explode(spark):
    """A long url many times, and many urls below one long path: a subset of their parts is no rule of its own."""
    long = "http://a.long.info/" + "/".join(f"part{i}" for i in range(25))
    deep = "http://b.deep.example/" + "/".join(f"level{i}" for i in range(25))
    pages = [(i, long) for i in range(10_000)] + [(10_000 + i, f"{deep}/{i}") for i in range(60)] + [(11_000 + i, f"http://c.good.org/{i}") for i in range(60)]
    rows = spark.createDataFrame(pages, "page_id long, url string")
    labels = rows.select(F.col("page_id").alias("id"), F.col("url").contains("deep").alias("bad"))
    got = {(r.host, r.verdict): r.n for r in urls.judged(rows, labels, rules=()).groupBy("host", "verdict").agg(F.count("*").alias("n")).collect()}
    assert got == {("a.long.info", "allow"): 10_000, ("b.deep.example", "block"): 60, ("c.good.org", "allow"): 60}
    tokens = rows.select("page_id", urls.host_of().alias("host"), urls.path_of().alias("path")).select(urls.tokens().alias("tokens"), (F.col("page_id") >= 11_000).alias("good"))
    rules = urls.mine(tokens.select("tokens", F.when(F.col("good") | F.exists("tokens", lambda t: t == "h1:long"), "allow").otherwise("block").alias("verdict"))).collect()
    assert any(len(r.tokens) > 25 and r.verdict == "block" for r in rules) and len(rules) < 10


def test_rules_are_judged_against_the_share_of_their_label(spark):
    """Few urls are bad: a host with mostly bad ones is blocked, though far below the confidence for all; chance makes no rule."""
    rng = random.Random(11)
    pages, bad = [], []
    for i in range(3_000):
        spam = i % 25 == 0
        pages.append((i, f"http://{'cheap.info' if spam else rng.choice('abcdef') + '.org'}/{rng.choice('uvwxyz')}/{i}"))
        bad.append((i, rng.random() < (0.75 if spam else 0.06)))
    rows = spark.createDataFrame(pages, "page_id long, url string").cache()
    labels = spark.createDataFrame(bad, "id long, bad boolean")
    got = urls.judged(rows, labels, rules=()).groupBy("host", "verdict").agg(F.count("*").alias("n")).collect()
    assert {r.host: r.n for r in got if r.verdict == "block"} == {"cheap.info": 120}
    assert sum(r.n for r in got) == 3_000
    shuffled = [b for _, b in bad]
    rng.shuffle(shuffled)
    chance = spark.createDataFrame([(i, b) for i, b in enumerate(shuffled)], "id long, bad boolean")
    assert urls.judged(rows, chance, rules=()).filter("matched is not null").count() == 0


def test_url_query(spark):
    """The query's hosts, paths and stated rules by plain Python, for every page."""
    folder = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    stated = {("net", "/"): "block", ("example.net", "/en/"): "allow", ("example.com", "/de/"): "block", ("org", "/fr/"): "allow"}
    want = Counter()
    for page in pages:
        after = (page.url or "").partition("://")[2].partition("#")[0].partition("?")[0]
        host, slash, path = after.partition("/")
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path
        fits = [h + p for h, p in stated if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want[(page.page_id, host, path, max(fits, key=len, default=None))] += 1
    got = QUERIES["op3_urls"](spark, folder).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == want
    says = {h + p: v for (h, p), v in stated.items()}
    assert all(r.verdict == says[r.rule] if r.rule else r.verdict in ("allow", "block") for r in got)
