"""Checks the documents recommend: threshold calibration, reliability, drift,
leakage between splits and conflicting labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketflow.functions.text import normalise, tokens
from ticketflow.operators.split import TEST, TRAIN, VALIDATION


def threshold_sweep(
    df: DataFrame,
    thresholds: Sequence[float],
    truth: str = "truth",
    prediction: str = "prediction",
    confidence: str = "confidence",
) -> DataFrame:
    """``threshold, automatic, coverage, precision, recall`` per threshold.

    Coverage is the automatic share of all rows, precision the right share of
    the automatic ones, recall the automatic share of the right ones. Rows are
    read once into one count per confidence band.
    """
    steps = sorted(set(thresholds))
    c = F.col(confidence)
    passed = sum((F.when(c > F.lit(t), 1).otherwise(0) for t in steps), F.lit(0))
    band = F.when(c.isNull() | F.isnan(c), 0).otherwise(passed)
    right = F.coalesce(F.col(truth) == F.col(prediction), F.lit(False))
    bands = df.groupBy(band.alias("_band")).agg(F.count("*").alias("_n"), F.count_if(right).alias("_right"))
    reached = [
        F.struct(
            F.lit(t).alias("threshold"),
            F.coalesce(F.sum(F.when(F.col("_band") > i, F.col("_n"))), F.lit(0)).alias("automatic"),
            F.coalesce(F.sum(F.when(F.col("_band") > i, F.col("_right"))), F.lit(0)).alias("_hits"),
        )
        for i, t in enumerate(steps)
    ]
    totals = bands.agg(F.array(*reached).alias("_s"), F.sum("_n").alias("_n"), F.sum("_right").alias("_right"))
    return totals.select("_n", "_right", F.inline("_s")).select(
        "threshold",
        "automatic",
        F.try_divide("automatic", "_n").alias("coverage"),
        F.try_divide("_hits", "automatic").alias("precision"),
        F.try_divide("_hits", "_right").alias("recall"),
    )


def reliability_bins(
    df: DataFrame,
    bins: int = 10,
    truth: str = "truth",
    prediction: str = "prediction",
    confidence: str = "confidence",
) -> DataFrame:
    """``bin, n, accuracy, mean_confidence, gap`` for the bins that hold rows."""
    c = F.col(confidence)
    right = F.coalesce(F.col(truth) == F.col(prediction), F.lit(False))
    cell = F.least(F.lit(bins - 1), F.floor(c * bins).cast("int"))
    return (
        df.filter(c.isNotNull() & ~F.isnan(c))
        .groupBy(cell.alias("bin"))
        .agg(
            F.count("*").alias("n"),
            (F.count_if(right) / F.count("*")).alias("accuracy"),
            F.avg(c).alias("mean_confidence"),
        )
        .withColumn("gap", F.abs(F.col("accuracy") - F.col("mean_confidence")))
    )


def calibration_error(bins: DataFrame) -> DataFrame:
    """Expected calibration error: the row-weighted mean gap of the bins."""
    return bins.agg(F.try_divide(F.sum(F.col("n") * F.col("gap")), F.sum("n")).alias("ece"))


def text_key(text: str) -> F.Column:
    """A short stand-in for the normalised text, so texts are not shuffled. A
    missing text counts as an empty one."""
    return F.md5(normalise(F.coalesce(F.col(text), F.lit(""))))


def split_leakage(
    df: DataFrame,
    text: str = "text",
    split: str = "split",
    train: str = TRAIN,
    held_out: Sequence[str] = (VALIDATION, TEST),
) -> DataFrame:
    """``split, n, leaked, leaked_texts`` of each held-out split: rows, and
    rows and distinct texts that also occur in train.

    One shuffle, of one record per text: copies combine before it, so a text
    that is a third of the table is one small record per task.
    """
    per_text = df.groupBy(text_key(text).alias("_t")).agg(
        F.count_if(F.col(split) == train).alias("_train"),
        *[F.count_if(F.col(split) == name).alias(f"_{name}") for name in held_out],
    )
    seen = F.col("_train") > 0
    lines = [
        F.struct(
            F.lit(name).alias(split),
            F.sum(f"_{name}").alias("n"),
            F.sum(F.when(seen, F.col(f"_{name}")).otherwise(0)).alias("leaked"),
            F.count_if(seen & (F.col(f"_{name}") > 0)).alias("leaked_texts"),
        )
        for name in held_out
    ]
    return per_text.agg(F.array(*lines).alias("_lines")).select(F.inline("_lines"))


def leaked_rows(df: DataFrame, text: str = "text", split: str = "split", train: str = TRAIN) -> DataFrame:
    """Held-out rows whose normalised text occurs in train.

    One semi join against the distinct train texts, by their keys. A text that
    most held-out rows have is one row on the right, and adaptive execution
    splits the left side.
    """
    seen = df.filter(F.col(split) == train).select(text_key(text).alias("_t")).distinct()
    return df.filter(F.col(split) != train).withColumn("_t", text_key(text)).join(seen, "_t", "left_semi").drop("_t")


#: Bits per key in the filter of contained_items(), and the most it takes: 1 MB in every task.
FILTER_SHARE, FILTER_BITS = 64, 1 << 23


def _key_filter(keys: DataFrame) -> tuple[DataFrame, int]:
    """One row, one array: bit ``h mod bits`` of it is 1 if a key ``_h`` is there; and the number of bits."""
    n = keys.count()
    bits = min(FILTER_BITS, max(1 << 12, 1 << (FILTER_SHARE * max(n, 1) - 1).bit_length()))
    at = F.pmod("_h", F.lit(bits))
    words = keys.groupBy(F.floor(at / 64).cast("int").alias("_i")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).alias("_b")
    )
    every = keys.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("_i")).join(words, "_i", "left")
    rows = F.array_sort(F.collect_list(F.struct("_i", F.coalesce("_b", F.lit(0)).cast("long").alias("_b"))))
    return every.agg(F.transform(rows, lambda r: r["_b"]).alias("_f")), bits


def contained_items(
    items: DataFrame, docs: DataFrame, item: str = "item_id", doc: str = "doc_id", text: str = "text", width: int = 5
) -> DataFrame:
    """``item, doc`` of each item whose tokens stand in a row, whole, in a document.

    Candidates share the item's first ``width`` tokens (all of a shorter one) by their 64-bit hash; the
    whole item is then looked for at that place. Windows of a document are hashed where it lies and first asked of a filter of the
    items' hashes, so only places that may begin an item leave it, each with the text that follows. Items without tokens are in none. Rows of
    docs that share a doc, null too, are looked at each.
    """
    words = items.select(F.col(item).alias("_item"), tokens(text).alias("_iw")).filter("size(_iw) > 0")
    keyed = words.select(
        "_item", "_iw", F.least(F.size("_iw"), F.lit(width)).alias("_k"), F.xxhash64(F.slice("_iw", 1, width)).alias("_h")
    )
    # at most `width` different lengths, and the longest item
    sizes = keyed.agg(F.collect_set("_k").alias("k"), F.max(F.size("_iw")).alias("most")).first()
    lengths, most = sorted(sizes.k) or [width], sizes.most or width
    begin = keyed.select(F.xxhash64(F.get("_iw", F.lit(0))).alias("_h"))
    flags, bits = _key_filter(keyed.select("_h").unionByName(begin).distinct())

    def known(h: F.Column) -> F.Column:
        at = F.pmod(h, F.lit(bits))
        word = F.get("_f", F.floor(at / 64).cast("int"))
        return F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1

    # places of a first token of an item; only these are hashed with what follows
    every = F.when(F.size("_w") > 0, F.sequence(F.lit(1), F.size("_w"))).otherwise(F.array().cast("array<int>"))
    places = F.filter(every, lambda i: known(F.xxhash64(F.get("_w", i - 1))))

    def starts(k: int) -> F.Column:
        room = F.filter("_places", lambda i: i <= F.size("_w") - k + 1)
        hashed = F.transform(room, lambda i: F.struct(F.xxhash64(F.slice("_w", i, k)).alias("h"), i.alias("i")))
        return F.filter(hashed, lambda x: known(x["h"]))

    # a generator of one row: its output is a column that is not computed again for every window
    once = F.inline(F.array(F.struct(tokens(text).alias("_w"), F.col("_f"))))
    toks = docs.withColumn("_f", flags.scalar()).select(F.col(doc).alias("_doc"), once)
    toks = toks.select("_doc", F.inline(F.array(F.struct("_w", "_f", places.alias("_places")))))
    found = toks.select("_doc", "_w", F.flatten(F.array(*[starts(k) for k in lengths])).alias("_at")).filter("size(_at) > 0")
    begun = found.select("_doc", F.explode(F.transform("_at", lambda a: F.struct(a["h"].alias("_h"), F.slice("_w", a["i"], most).alias("_next")))).alias("_p"))
    met = begun.select("_doc", "_p._h", "_p._next").join(keyed, "_h")
    whole = met.filter(F.slice("_next", F.lit(1), F.size("_iw")) == F.col("_iw"))
    return whole.select(F.col("_item").alias(item), F.col("_doc").alias(doc)).distinct()


def conflicting_labels(df: DataFrame, text: str = "text", category: str = "category") -> DataFrame:
    """``text_key, n_rows, n_labels`` of the texts with more than one label."""
    per_label = (
        df.filter(F.col(category).isNotNull())
        .groupBy(text_key(text).alias("text_key"), category)
        .agg(F.count("*").alias("_n"))
    )
    return (
        per_label.groupBy("text_key")
        .agg(F.sum("_n").alias("n_rows"), F.count("*").alias("n_labels"))
        .filter("n_labels > 1")
    )
