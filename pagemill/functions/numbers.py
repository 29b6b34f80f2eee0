"""Rounding, page and retry arithmetic, and decision tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARACTERS_A_PAGE, PAGES_AN_HOUR = 1800, 30
#: The factors of CSS font size keywords.
FONT_LADDER = {"xx-small": 0.6, "x-small": 0.75, "small": 0.875, "medium": 1.0, "large": 1.125, "x-large": 1.25, "xx-large": 1.5, "smaller": 0.85, "larger": 1.2}
#: Response codes that are worth another try, and those that never will be.
TRANSIENT, PERMANENT = [401, 408, 425, 429], [400, 403, 404, 409, 410, 413, 415, 422]


def half_up(x: Column) -> Column:
    """To the nearest whole number, halves towards plus infinity."""
    return F.floor(x + 0.5).cast("long")


def pages(characters: Column) -> Column:
    return F.when(characters > 0, F.greatest(F.lit(1).cast("long"), half_up(characters / CHARACTERS_A_PAGE)))


def percent(part: Column, whole: Column) -> Column:
    """0 to 100, halves up; 0 of nothing."""
    return F.when(whole > 0, F.least(F.lit(100).cast("long"), F.greatest(F.lit(0).cast("long"), half_up(part * 100 / whole)))).otherwise(0).cast("long")


def reading_hours(page_count: Column) -> Column:
    """Hours with one decimal, in tenths."""
    return half_up(page_count * 10 / PAGES_AN_HOUR)


def backoff_ms(attempt: Column, first: int = 1000, most: int = 30_000) -> Column:
    """first, doubled with every attempt, at most `most`."""
    return F.least(F.lit(most).cast("long"), (first * F.pow(F.lit(2.0), F.least(attempt, F.lit(40)))).cast("long"))


def failure_kind(status: Column) -> Column:
    """drop for permanent failures, retry for all others, unknown ones included."""
    return F.when(status.isin(*TRANSIENT) | status.between(500, 599), "retry").when(status.isin(*PERMANENT), "drop").otherwise("retry")


def session_failure_kind(status: Column) -> Column:
    """Closed sessions are dropped on anything that is not transient."""
    return F.when(status.isin(*TRANSIENT) | status.between(500, 599), "retry").otherwise("drop")


def counts_as_reading(purpose: Column, confidence: Column) -> Column:
    """Low confidence counts whatever the purpose."""
    return (confidence == "low") | purpose.isin("BODY", "PREFACE", "AFTERWORD", "UNKNOWN")


def font_scale(value: Column) -> Column:
    """A CSS font size as a factor: keywords, em, rem, %; 0.5 to 2, three decimals; 1, what is
    not above 0 and unknown values are null."""
    v = F.lower(F.btrim(value))
    pattern = r"^(-?[\d.]+)\s*(em|rem|%)$"
    raw = F.regexp_extract(v, pattern, 1).try_cast("double") / F.when(F.regexp_extract(v, pattern, 2) == "%", 100).otherwise(1)
    for word, factor in FONT_LADDER.items():
        raw = F.when(v == word, factor).otherwise(raw)
    scaled = F.floor(F.least(F.lit(2.0), F.greatest(F.lit(0.5), raw)) * 1000 + 0.5) / 1000
    return F.when((raw > 0) & (scaled != 1), scaled)


def font_weight(value: Column) -> Column:
    """Keywords or a number, 100 to 900 in hundreds; 400 and unknown are null."""
    v = F.lower(F.btrim(value))
    raw = F.when(v.isin("bold", "bolder"), 700).when(v == "lighter", 300).when(v == "normal", 400).when(v.rlike(r"^\d+$"), v.try_cast("double"))
    snapped = (F.floor(F.least(F.lit(900), F.greatest(F.lit(100), raw)) / 100 + 0.5) * 100).cast("int")
    return F.when(raw.isNotNull() & (snapped != 400), snapped)
