"""Numbers of financial tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def numeric(value: Column, lenient: bool = False) -> Column:
    """Double of a cell, or null. "(x)" is negative if the cell starts with the bracket; "%" divides by 100.

    ``lenient`` also takes a currency sign before the bracket.
    """
    v = F.regexp_replace(value, r"^\s+|\s+$", "")
    if lenient:
        v = F.regexp_replace(v, r"^[$€£¥]\s*(?=\()", "")
    v = F.when(v.startswith("(") & v.endswith(")"), F.concat(F.lit("-"), F.substring(v, F.lit(2), F.length(v) - 2))).otherwise(v)
    v = F.regexp_replace(v, r"[$€£¥,\s]", "")
    percent = v.endswith("%")
    v = F.when(percent, F.substring(v, F.lit(1), F.length(v) - 1)).otherwise(v)
    number = F.when(v.rlike(r"^[+-]?(\d+(_\d+)*(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), F.replace(v, F.lit("_"), F.lit("")).try_cast("double"))
    number = F.when(F.lower(v).rlike(r"^[+-]?(nan|inf|infinity)$"), F.regexp_replace(F.lower(v), "inf(inity)?", "Infinity").try_cast("double")).otherwise(number)
    return F.when(percent, number / 100).otherwise(number)


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x.cast("double")))
