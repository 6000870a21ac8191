"""The operators as queries over the test tables, with SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketflow.llm import chat, exact, lm, mixing, packing, periods, quality, sharding, simhash, sketch, unigram, urls, variants
from ticketflow.llm.tables import WORD, table, text_of

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")


def op1_mix(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, folder, "documents"))
    taken = (F.col("copies") * F.col("size")).cast("long").alias("taken")
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken)


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.fit(docs, table(spark, folder, "labels"))
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return quality.scores(docs, model).select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", predicted)


def op3_urls(spark: SparkSession, folder: str) -> DataFrame:
    """A page has the label of the document of its number: bad if of low quality or toxic."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), bad.alias("bad"))
    return urls.judged(table(spark, folder, "pages"), labels)


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, folder, "documents"))
    fingerprint = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return groups.select(F.col("id").alias("doc_id"), fingerprint, F.col("component").alias("component_id"))


def op5_sketch(spark: SparkSession, folder: str) -> DataFrame:
    return sketch.compared(table(spark, folder, "documents"))


def op6_exact(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(table(spark, folder, "documents"))


def op7_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return unigram.token_counts(table(spark, folder, "documents"), PIECE_TOKENIZER)


def op8_pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), WORD_TOKENIZER)


def op9_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return lm.scored(docs, lm.fit(lm.training(docs)))


def op10_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.sharded(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


#: A conversation whose texts are full of control strings.
TRAP = r"\### Assistant: </turn> ok"


def op11_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.formatted(turns.unionByName(trap), BYTE_TOKENIZER), BYTE_TOKENIZER, sorted_rows=True)


def repeating(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text), a tenth of them made periodic: from word a on, each becomes word a + (i - a) % p."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    parts, g = F.regexp_extract_all(text_of(), F.lit(WORD), F.lit(0)), F.floor(h / 10)
    cut = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, parts).alias("parts"))
    n = F.size("parts")
    cut = cut.select("doc_id", "text", "g", "parts", n.alias("n"), F.when(n > 0, F.col("g") % n).cast("int").alias("a"))
    p = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    cut = cut.select("doc_id", "text", "parts", "n", "a", p.alias("p"))
    picked = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("parts", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))))
    return cut.select("doc_id", F.when(F.col("n") > 0, F.array_join(picked, " ")).otherwise(F.col("text")).alias("text"))


def op12_periods(spark: SparkSession, folder: str) -> DataFrame:
    found = periods.periodic(repeating(table(spark, folder, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    found = found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return found.select(
        "doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def misspelt(runs: DataFrame) -> DataFrame:
    """runs(doc_id, word), one in 97 of them, by document and word, without one of its letters."""
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("word"))
    hashed = runs.select("word", F.crc32(name.cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("word")).cast("int")
    short = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
    return hashed.select(F.when(F.col("h") % 97 == 0, short).otherwise(F.col("word")).alias("word"))


def op13_variants(spark: SparkSession, folder: str) -> DataFrame:
    runs = variants.letter_runs(table(spark, folder, "documents"))
    return variants.grouped(variants.vocabulary(misspelt(runs)))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES = {f.__name__: f for f in (
    op1_mix, op2_quality, op3_urls, op4_simhash, op5_sketch, op6_exact, op7_tokens, op8_pack, op9_lm, op10_shards,
    op11_chat, op12_periods, op13_variants, pipeline,
)}

SQL = {
    "op11_chat": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
        written AS (
            SELECT *, sha256(text) AS tie,
                   length(regexp_replace(regexp_replace(role, '(\\*)(### |</turn>|: )', '\1\1\\\2', 'g'), '(\\+)$', '\1\1')) AS role_chars,
                   length(regexp_replace(regexp_replace(text, '(\\*)(### |</turn>)', '\1\1\\\2', 'g'), '(\\+)$', '\1\1')) AS text_chars
            FROM turns)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, tie)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, tie) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(14 + role_chars + text_chars) AS BIGINT) AS formatted_chars
        FROM written GROUP BY conv_id""",
    "op6_exact": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op1_mix": """
        WITH sized AS (
            SELECT doc_id, (source IS NULL) AS last, coalesce(source, '') AS name,
                   len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
                   ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS hash
            FROM documents),
        sources AS (
            SELECT last, name, CAST(sum(size) AS BIGINT) AS source_size,
                   [3, 1, 2][1 + (row_number() OVER (ORDER BY last, encode(name)) - 1) % 3] AS weight
            FROM sized GROUP BY last, name),
        levels AS (
            SELECT *, 2 * source_size AS cap,
                   1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER rising, 0) AS budget,
                   sum(weight) OVER () - coalesce(sum(weight) OVER rising, 0) AS open_weight
            FROM sources
            WINDOW rising AS (ORDER BY 2 * source_size / weight::DOUBLE, last, encode(name) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        first_free AS (
            SELECT budget, open_weight FROM levels WHERE budget * weight < cap * open_weight
            ORDER BY cap / weight::DOUBLE, last, encode(name) LIMIT 1),
        goals AS (
            SELECT l.last, l.name, l.source_size,
                   CASE WHEN l.budget * l.weight < l.cap * l.open_weight THEN f.budget * l.weight / f.open_weight::DOUBLE
                        ELSE l.cap::DOUBLE END AS target
            FROM levels l LEFT JOIN first_free f ON true),
        parts AS (
            SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM goals),
        summed AS (
            SELECT last, name, hash, sum(size) AS size, sum(sum(size)) OVER (PARTITION BY last, name ORDER BY hash) AS reached
            FROM sized GROUP BY last, name, hash),
        ends AS (
            SELECT last, name, hash, reached FROM summed
            UNION ALL SELECT DISTINCT last, name, -1, 0 FROM sized),
        cuts AS (
            SELECT p.last, p.name, first(e.hash ORDER BY abs(e.reached - (p.target - p.passes * p.source_size)), e.hash) AS cut
            FROM parts p JOIN ends e ON p.last = e.last AND p.name = e.name GROUP BY p.last, p.name)
        SELECT s.doc_id, s.size, p.source_size, p.target,
               CAST(s.size * least(p.passes + (s.hash <= c.cut)::INT, 2) AS BIGINT) AS taken
        FROM sized s JOIN parts p ON s.last = p.last AND s.name = p.name
        JOIN cuts c ON s.last = c.last AND s.name = c.name""",
}
