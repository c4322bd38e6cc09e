"""Small label and default-value functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions.hashing import unit


def none_if_missing(label: Column) -> Column:
    """Null for text that holds "no info" or "n/a" in any case, else trimmed text."""
    text = F.trim(label.cast("string"))
    folded = F.lower(text)
    missing = F.contains(folded, F.lit("no info")) | F.contains(folded, F.lit("n/a"))
    return F.when(~missing, text)


def default_score(item_id: Column, seed: int = 42) -> Column:
    """A score between 7.5 and 9.8 with one decimal, fixed per item."""
    return F.round(F.lit(7.5) + F.lit(2.3) * unit(item_id, seed), 1)


def method_label(method: Column, k: Column) -> Column:
    return F.concat_ws("_", method, k.cast("string"))
