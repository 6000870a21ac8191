"""Text to fixed-length token arrays, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketflow.fixed_values import CLS, PAD, SEP

# Everything but letters and digits separates tokens.
SEPARATORS = r"[^\p{L}\p{N}]+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise(text: str | Column) -> Column:
    """Case-folded text with single blanks, for comparing texts."""
    return F.trim(F.regexp_replace(F.lower(_col(text)), r"[ \t\r\n]+", " "))


def tokens(text: str | Column) -> Column:
    """Case-folded tokens; null text gives an empty array."""
    parts = F.split(F.lower(F.coalesce(_col(text), F.lit(""))), SEPARATORS)
    return F.array_remove(parts, "")


def truncate(toks: str | Column, max_length: int, first=CLS, last=SEP) -> Column:
    """At most ``max_length`` entries, both end marks included."""
    if max_length < 2:
        raise ValueError("max_length must leave room for the two end marks")
    return F.concat(F.array(F.lit(first)), F.slice(_col(toks), 1, max_length - 2), F.array(F.lit(last)))


def pad(arr: str | Column, length: int | Column, fill=PAD) -> Column:
    """Extend an array to ``length``; a longer one is left as it is."""
    arr = _col(arr)
    missing = F.greatest(F.lit(0), F.lit(length) - F.size(arr))
    return F.concat(arr, F.array_repeat(F.lit(fill), missing))


def attention_mask(arr: str | Column, length: int | Column) -> Column:
    """1 for each real entry, 0 for each padded one."""
    return pad(F.array_repeat(F.lit(1), F.size(_col(arr))), length, 0)
