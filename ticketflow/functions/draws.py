"""Keyed hash draws: random choices that depend on the row key only, so they
are the same under any partitioning and after any task retry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_hex(seed: int, tag: str, *key: str | Column) -> Column:
    """32 hex digits per key; a null part counts as the character U+0000."""
    parts = [F.coalesce(_col(k).cast("string"), F.lit("\u0000")) for k in key]
    return F.md5(F.concat_ws(":", F.lit(f"{seed}:{tag}"), *parts))


def draw(seed: int, tag: str, *key: str | Column) -> Column:
    """Uniform double in [0, 1) from the first 52 bits of the hash."""
    head = F.substring(hash_hex(seed, tag, *key), 1, 13)
    return F.conv(head, 16, 10).cast("long") / F.lit(float(2**52))


def pick(values: str | Column, u: Column) -> Column:
    """One element of an array column, uniformly; null for an empty array."""
    values = _col(values)
    return F.get(values, F.floor(u * F.size(values)).cast("int"))


def weighted_choice(values: Sequence, weights: Sequence[int], u: Column) -> Column:
    """One of ``values`` with probability proportional to its weight. Pass a
    draw that is already a column: it is compared once per value."""
    if len(values) != len(weights) or not values or min(weights) < 0 or sum(weights) == 0:
        raise ValueError("values and weights must match and hold a positive weight")
    scaled, bound, choice = u * F.lit(float(sum(weights))), 0, None
    for value, weight in zip(values, weights):
        bound += weight
        hit = scaled < F.lit(float(bound))
        choice = F.when(hit, F.lit(value)) if choice is None else choice.when(hit, F.lit(value))
    return choice


def fill_slots(template: str | Column, slots: dict[str, Column], u: Column) -> Column:
    """Replace the slot a template holds; a template without one is unchanged."""
    template = _col(template)
    filled = template
    for name, values in slots.items():
        mark = F.lit("{" + name + "}")
        filled = F.when(F.contains(template, mark), F.replace(template, mark, pick(values, u))).otherwise(filled)
    return filled
