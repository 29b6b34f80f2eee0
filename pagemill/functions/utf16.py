"""Offsets that count UTF-16 units, as browsers give them, and those that count code points.

Characters beyond U+FFFF are two units. An offset between the two halves of one belongs to its start.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARSET = "UTF-16BE"


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, CHARSET)) / 2).cast("long")


def utf16_offset(text: Column, points: Column) -> Column:
    """Units before the character of this number (from 0)."""
    return utf16_length(F.left(text, points.cast("int")))


def whole_offset(text: Column, units: Column) -> Column:
    """The offset, clamped to the text, moved to the start of the character that it would cut."""
    at = F.greatest(F.lit(0).cast("long"), F.least(units.cast("long"), utf16_length(text)))
    second_half = F.hex(F.substring(F.encode(text, CHARSET), (at * 2 + 1).cast("int"), F.lit(1))).between("DC", "DF")
    return F.when(text.isNotNull() & units.isNotNull(), F.when((at > 0) & second_half, at - 1).otherwise(at))


def code_points(text: Column, units: Column) -> Column:
    """Characters before an offset in units."""
    return F.length(utf16_left(text, units)).cast("long")


def utf16_left(text: Column, units: Column) -> Column:
    """The text before an offset in units; a character that it would cut is left out."""
    return F.decode(F.substring(F.encode(text, CHARSET), F.lit(1), (whole_offset(text, units) * 2).cast("int")), CHARSET)


def utf16_slice(text: Column, start: Column, end: Column) -> Column:
    """The text between two offsets in units."""
    first, last = code_points(text, start), code_points(text, end)
    return F.substring(text, (first + 1).cast("int"), F.when(last > first, last - first).otherwise(0).cast("int"))
