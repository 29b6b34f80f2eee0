"""Style declarations as columns: alignment and indentation of a block."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs after which a long token may be broken, as in a character class.
BREAK_SIGNS = r":/\\\-_.?&=#%~+,;"


def declared(style: Column, name: str) -> Column:
    """The value that a style attribute declares for a property, or null."""
    return F.nullif(F.btrim(F.lower(F.regexp_extract(style, rf"(?i)(?:^|;)\s*{name}\s*:\s*([^;!]+)", 1))), F.lit(""))


def alignment(style: Column, attribute: Column) -> Column:
    """The style decides before the attribute; logical sides become physical ones."""
    side = lambda v: F.when(v == "start", "left").when(v == "end", "right").when(v.isin("left", "right", "center", "justify"), v)
    return F.coalesce(side(declared(style, "text-align")), side(F.lower(F.btrim(attribute))))


def indent(style: Column, most: float = 4.0) -> Column:
    """In em, three decimals: em and rem as they are, % as hundredths, ch as half; 0 is
    allowed without a unit, other unitless, negative and unknown values are null."""
    v = declared(style, "text-indent")
    pattern = r"^(-?[\d.]+)\s*(em|rem|%|ch)$"
    em = F.regexp_extract(v, pattern, 1).try_cast("double") * F.when(F.regexp_extract(v, pattern, 2) == "%", 0.01).when(F.regexp_extract(v, pattern, 2) == "ch", 0.5).otherwise(1.0)
    return F.when(v == "0", 0.0).when(em >= 0, F.floor(F.least(F.lit(most), em) * 1000 + 0.5) / 1000)


def break_points(text: Column, least: int = 16) -> Column:
    """The text in parts that may be split over lines: tokens of `least` characters or
    more are cut after runs of URL punctuation, but not between digits nor at their end."""
    tokens = F.transform(F.split(text, r"(?<=\s)(?=\S)"), lambda t: F.when(F.length(F.rtrim(t)) >= least, F.regexp_replace(F.regexp_replace(t, rf"([{BREAK_SIGNS}]+)(?=[^\s{BREAK_SIGNS}])", "$1\x01"), "([0-9][" + BREAK_SIGNS + "]+)\x01([0-9])", "$1$2")).otherwise(t))
    return F.split(F.array_join(tokens, ""), "\x01")
