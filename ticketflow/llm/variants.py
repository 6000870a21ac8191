"""Spelling variants: words one edit apart, found over a reduced alphabet.

Letters are hashed to a few symbols. An edit of a word is an edit of its reduced word, or none, so all near words of a
word are among those whose reduced word is in the full one-edit neighbourhood of its own. A neighbour is a polynomial
hash that takes one step from the word's own, whatever its length. A filter of the reduced vocabulary lets through
the neighbours that may occur, those are joined with it, and what meets is verified on the original words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketflow.llm import tables, words

#: A run of letters, and the code points and occurrences that make it a word of the vocabulary.
LETTERS, CHARS, TIMES = "[A-Za-zÀ-ÿ]+", 5, 3
#: A form occurs so many times as often as its variant, at least.
FACTOR = 2
#: Symbols of the reduced alphabet. A word has about 2 * SYMBOLS * length neighbours.
SYMBOLS = 8
#: The filter has 2 ** FILTER_BITS bits, 8 MB, whatever the vocabulary; a full one lets all through.
FILTER_BITS, FILTER_PARTS = 26, 64
#: Letters whose neighbours are made at a time.
BLOCK = 1 << 16

BASE, BACK = np.uint64(words.BASE), np.uint64(pow(words.BASE, -1, 2**64))
SYMBOL = words.mix((np.arange(SYMBOLS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def lowered(word: Column) -> Column:
    """A-Z as a-z, other letters as they are."""
    ascii_only = F.octet_length(word) == F.char_length(word)
    return F.when(ascii_only, F.lower(word)).otherwise(F.translate(word, tables.UPPER, tables.LOWER))


def letter_runs(docs: DataFrame) -> DataFrame:
    """Per run of letters of docs(doc_id, text): doc_id and word, lower-cased. Null text has none."""
    found = F.regexp_extract_all(tables.text_of(), F.lit(LETTERS), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("word")).select("doc_id", lowered(F.col("word")).alias("word"))


def vocabulary(runs: DataFrame, chars: int = CHARS, times: int = TIMES) -> DataFrame:
    """Words of runs(word) with so many code points and occurrences: word, n. Counted where they are read first."""
    long = runs.filter(F.char_length("word") >= chars)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= times)


# Reduced words


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words together, and where each word begins and the last ends."""
    texts = column.to_pylist()
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
    ends = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    return (words.mix(points + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SYMBOLS)).astype(np.int64), ends


class Reduced:
    """Reduced words of a column with their hashes: the sum of SYMBOL[s] * BASE ** place."""

    def __init__(self, column: pa.Array):
        self.symbol, ends = symbols(column)
        self.size = np.diff(ends)
        self.word = np.repeat(np.arange(len(self.size)), self.size)
        place = np.arange(len(self.symbol)) - ends[self.word]
        self.power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(int(self.size.max(initial=0)), BASE))))[place]
        terms = np.concatenate((np.zeros(1, np.uint64), np.cumsum(SYMBOL[self.symbol] * self.power, dtype=np.uint64)))
        self.code = terms[ends[1:]] - terms[ends[:-1]]
        self.until = terms[:-1] - terms[ends[:-1]][self.word]  # the terms before each place

    def neighbours(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, hash) of every reduced word and of all that one edit makes of it, in parts."""
        whole = self.code[self.word]
        after = whole - self.until  # the terms from each place on
        own = SYMBOL[self.symbol] * self.power
        yield np.arange(len(self.code)), self.code
        yield self.word, self.until + (after - own) * BACK
        for value in SYMBOL:
            other = SYMBOL[self.symbol] != value
            yield self.word[other], (whole + (value - SYMBOL[self.symbol]) * self.power)[other]
            yield self.word, self.until + value * self.power + after * BASE
        end = np.zeros(len(self.code), np.uint64)  # the power after the last place
        np.maximum.at(place := np.zeros(len(self.code), np.int64), self.word, np.arange(len(self.word)))
        filled = self.size > 0
        end[filled] = self.power[place[filled]] * BASE
        end[~filled] = 1
        for value in SYMBOL:
            yield np.arange(len(self.code)), self.code + value * end


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    yield from words.slices(batch, "word", BLOCK)


def coded(vocab: DataFrame) -> DataFrame:
    """vocab(word, n) with code, the hash of the reduced word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _blocks(whole):
                code = pa.array(Reduced(batch.column("word")).code.view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), code], ["word", "n", "code"])

    return vocab.select("word", "n").mapInArrow(run, "word string, n long, code long")


def _bit(code: np.ndarray) -> np.ndarray:
    return (code.view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def reduced_filter(codes: DataFrame) -> np.ndarray:
    """Bits of codes(code): bit code >> (64 - FILTER_BITS) is 1 if such a code is there. FILTER_PARTS rows come to the driver."""
    size = 2**FILTER_BITS // FILTER_PARTS
    bit = F.shiftrightunsigned("code", 64 - FILTER_BITS).cast("long")
    bits = codes.select(F.floor(bit / size).cast("int").alias("part"), (bit % size).cast("int").alias("bit")).distinct()

    def packed(key, table):
        flags = np.zeros(size, np.uint8)
        flags[table.column("bit").to_numpy()] = 1
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "flags": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros((FILTER_PARTS, size // 8), np.uint8)
    for r in bits.groupBy("part").applyInArrow(packed, "part int, flags binary").collect():
        out[r.part] = np.frombuffer(r.flags, np.uint8)
    return out.ravel()


def asked(vocab: DataFrame, flags: np.ndarray) -> DataFrame:
    """Per word of vocab(word) the codes of its own reduced word and of its one-edit neighbours that the filter lets through."""
    shared = vocab.sparkSession.sparkContext.broadcast(flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for whole in batches:
            for batch in _blocks(whole):
                found = []
                for word, code in Reduced(batch.column("word")).neighbours():
                    bit = _bit(code)
                    some = (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                    found.append((word[some], code[some]))
                word, code = (np.concatenate(x) for x in zip(*found))
                order = np.lexsort((code, word))
                word, code = word[order], code[order]
                new = np.ones(len(word), bool)
                new[1:] = (word[1:] != word[:-1]) | (code[1:] != code[:-1])
                asking = batch.column("word").take(pa.array(word[new]))
                yield pa.RecordBatch.from_arrays([asking, pa.array(code[new].view(np.int64))], ["word", "code"])

    return vocab.select("word").mapInArrow(run, "word string, code long")


# Near words, forms and roots


def _moved(rows: DataFrame) -> DataFrame:
    """rows, a side of a join that moves both sides and broadcasts none.

    Spark sizes a written table by its packed files, and takes what mapInArrow makes of rows for no larger than they are. Words
    ask for some 20 codes each, so what it puts below its broadcast bound may be far too large for the driver.
    """
    return rows.hint("shuffle_merge")


def near(coded_words: DataFrame) -> DataFrame:
    """Of coded_words(word, n, code), per word that has near words: word, n_near, form (its near word of largest n, ties
    by the smallest in code-point order), form_n."""
    codes = coded_words.select("code").distinct()
    asking = asked(coded_words, reduced_filter(codes))
    other = coded_words.select("code", F.col("word").alias("other"), F.col("n").alias("other_n"))
    met = asking.join(_moved(other), "code").filter(F.levenshtein("word", "other", 1) == 1)
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    found = met.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", F.col("best.word").alias("form"), (-F.col("best.n")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """forms(word, form) to (word, root): the end of the chain of forms.

    Counts at least double along a chain, so it has no circle and few links; each round doubles the links a word has
    followed, and is a written table.
    """
    now = tables.stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while now.filter("moved").limit(1).count():
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        on = now.select("word", "root").join(_moved(step), "root", "left")
        now = tables.stored(on.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
    return now.select("word", "root")


def grouped(vocab: DataFrame, factor: int = FACTOR) -> DataFrame:
    """Per word of vocab(word, n): word, form, root, n, n_near, form_n.

    Two words are near if they differ by one inserted, deleted or replaced code point. A word's form is its near word of
    largest n if that is `factor` times its own at least, else null; its root is where its chain of forms ends, or the
    word itself. Words are distinct; an empty vocabulary gives an empty result.
    """
    known = tables.stored(coded(vocab), "coded")
    joined = known.select("word", "n").join(near(known), "word", "left")
    is_form = F.col("form_n") >= factor * F.col("n")
    found = joined.select("word", F.when(is_form, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("form_n")).alias("form_n"))
    found = tables.stored(found, "forms")
    ends = roots(found.filter("form is not null"))
    out = found.join(_moved(ends), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
