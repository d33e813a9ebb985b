"""ANSI-safe casts of JSON text (P3, P4; S16, S17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
# Fixed value: integer text, optionally signed, optionally with a fraction
# that is dropped (``'12.5' -> 12``), as a non-ANSI cast would do.
INTEGER_TEXT = r"^\s*([+-]?[0-9]+)(\.[0-9]*)?\s*$"


def to_money(text: Column) -> Column:
    """Text -> DECIMAL(18,2), half-up rounding; malformed/overflow -> NULL."""
    return text.try_cast(MONEY)


def to_integer(text: Column, type_name: str = "int") -> Column:
    """Text -> INT/BIGINT: integral part of a number; garbage/overflow -> NULL."""
    return F.regexp_extract(text, INTEGER_TEXT, 1).try_cast(type_name)


def with_fields(df: DataFrame, struct: Column, names: list[str]) -> DataFrame:
    """``df`` with the fields of ``struct`` as columns ``names``; NULL fields for a NULL struct.

    A generator makes them, so that an expensive struct (parsed JSON) is built once per row: a filter on a
    projected field is pushed below the projection and takes the whole expression behind the field along."""
    return df.select("*", F.inline(F.array(struct)).alias(*names))
