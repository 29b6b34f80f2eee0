"""Fill-in-the-middle: documents cut at two seeded places into prefix, middle and suffix.

The cuts count code points, and are made by string functions alone: a control
character serves as delimiter, escaped where the text holds it; a regular
expression appends it after each unit; counting it gives the length, and
substring_index takes the parts of given ranks out. Everything is a column
expression on one row, so nothing is shuffled and no text leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Follows each unit. In the text itself it is written as ESCAPE d, and ESCAPE as ESCAPE e.
DELIMITER, ESCAPE = "\x1f", "\x1e"
#: A unit of escaped text: an escaped character, or any other code point.
UNIT = f"(?s){ESCAPE}.|."
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}e")), F.lit(DELIMITER), F.lit(f"{ESCAPE}d"))


def unescaped(text: Column) -> Column:
    """In escaped text each ESCAPE begins a pair, so that the two replacements can't meet."""
    return F.replace(F.replace(text, F.lit(f"{ESCAPE}d"), F.lit(DELIMITER)), F.lit(f"{ESCAPE}e"), F.lit(ESCAPE))


def marked(text: Column) -> Column:
    """The escaped text with a delimiter after each unit."""
    return F.regexp_replace(escaped(text), UNIT, f"$0{DELIMITER}")


def n_units(marked_text: Column) -> Column:
    return (F.octet_length(marked_text) - F.octet_length(F.replace(marked_text, F.lit(DELIMITER), F.lit("")))).cast("long")


def _text_of(piece: Column) -> Column:
    return unescaped(F.replace(piece, F.lit(DELIMITER), F.lit("")))


def parts(marked_text: Column, n: Column, first: Column, second: Column) -> list[Column]:
    """The texts of the units before `first`, up to `second`, and after it."""
    by = F.lit(DELIMITER)
    take = lambda s, count: F.call_function("substring_index", s, by, count.cast("int"))
    until = take(marked_text, second)
    # A marked text ends with a delimiter, after which an empty piece follows; `until` does not.
    return [_text_of(take(marked_text, first)), _text_of(take(until, first - second)), _text_of(take(marked_text, second - n - 1))]


def draws(doc_id: str, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the SHA-256 of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text that `output` was made of. A text with markers of its own stays plain, so
    the first marker of each kind is the one that was put in."""
    index = lambda s, by, n: F.substring_index(s, by, n)
    between = lambda a, b: index(index(output, b, 1), a, -1)
    psm = F.concat(between(PREFIX, SUFFIX), index(output, MIDDLE, -1), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), index(output, MIDDLE, -1), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """(row, n, form, output, prefix_chars, middle_chars): every row, packed, with its text
    as a training example: `rate` % of the texts are cut, `spm_rate` % of these put the suffix first.

    The draws depend on the seed and the id only, so that rows which repeat an id
    are cut at places drawn alike. A null text counts as empty; empty texts and
    texts that hold a marker stay plain, with null sizes. A null id draws as an empty one.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    drawn = docs.select(row, F.array(*draws(f"`{id_col}`", seed)).alias("h")).select("row", "h", marked(text).alias("units"))
    h = [F.col("h")[i] for i in range(4)]
    counted = drawn.select("row", "h", "units", n_units(F.col("units")).alias("n"))
    holds = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (F.col("n") == 0) | holds | (h[2] % 100 >= rate)
    places = [h[i] % (F.col("n") + 1) for i in range(2)]
    form = F.when(plain, "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    cut = counted.select("row", "units", "n", form.alias("form"), F.least(*places).alias("first"), F.greatest(*places).alias("second"))
    prefix, middle, suffix = (F.col("parts")[i] for i in range(3))
    pieces = cut.select("row", "n", "form", "first", "second", F.when(F.col("form") != "plain", F.array(*parts(F.col("units"), F.col("n"), F.col("first"), F.col("second")))).alias("parts"))
    lit = F.lit
    output = (
        F.when(F.col("form") == "psm", F.concat(lit(PREFIX), prefix, lit(SUFFIX), suffix, lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(lit(SUFFIX), suffix, lit(PREFIX), prefix, lit(MIDDLE), middle))
        .otherwise(text)
    )
    sized = lambda c: F.when(F.col("form") != "plain", c)
    return pieces.select("row", "n", "form", output.alias("output"), sized(F.col("first")).alias("prefix_chars"), sized(F.col("second") - F.col("first")).alias("middle_chars"))
