"""Formatting without floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_text(ns: Column) -> Column:
    """Nanoseconds as seconds with nine digits."""
    ns = ns.cast("long")
    whole = ((ns - ns % 1_000_000_000) / 1_000_000_000).cast("long")
    return F.concat(whole.cast("string"), F.lit("."), F.lpad((ns % 1_000_000_000).cast("string"), 9, "0"))
