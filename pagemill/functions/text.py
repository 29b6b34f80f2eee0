"""Text functions on columns. Lengths count code points; white space is Unicode's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that become another spelling in slugs.
ONE_TO_ONE = (
    "абвгґдеёзиіїйклмнопрстуфыэ" "áàäâãå" "éèëê" "íìïî" "óòöôõø" "úùüû" "ýÿ" "ñç",
    "abvggdeeziiiiklmnoprstufye" "aaaaaa" "eeee" "iiii" "oooooo" "uuuu" "yy" "nc",
)
# Letters that become several letters or none.
ONE_TO_MANY = {"є": "ie", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ь": "", "ю": "iu", "я": "ia", "ß": "ss"}
#: Quote pairs that a selection is stripped of.
QUOTE_PAIRS = [('"', '"'), ("'", "'"), ("“", "”"), ("«", "»")]
WS = r"(?U)\s+"
# Titles that say nothing, as lower-case patterns.
FILE_TITLE = r"\.(x?html?|xml)$"
MACHINE_TITLE = r"^(section|split|part|item|text|page)[\s_.-]*\d+$"
NUMBER_TITLE = r"^[\d\s.:_-]+$"


def transliterate(text: Column) -> Column:
    """Lower case with Cyrillic and accented Latin letters spelt in ASCII; other characters stay."""
    many = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), ONE_TO_MANY.items(), F.lower(text))
    return F.translate(many, *ONE_TO_ONE)


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(transliterate(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def clamp_slug(slug: Column, longest: int) -> Column:
    """Cut to `longest` characters; only a cut slug loses hyphens at its end."""
    return F.when(F.length(slug) <= longest, slug).otherwise(F.regexp_replace(F.left(slug, F.lit(longest)), "-+$", ""))


def book_slug(title: Column, author: Column, longest: int = 80) -> Column:
    """title-by-author, either alone, or untitled."""
    t, a = slugify(F.coalesce(title, F.lit(""))), slugify(F.coalesce(author, F.lit("")))
    both = F.when((t != "") & (a != ""), F.concat(t, F.lit("-by-"), a)).when(t != "", t).when(a != "", a).otherwise("untitled")
    return clamp_slug(both, longest)


def collection_slug(name: Column, longest: int = 60) -> Column:
    s = slugify(F.coalesce(name, F.lit("")))
    return clamp_slug(F.when(s == "", "collection").otherwise(s), longest)


def collapse(text: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.btrim(F.regexp_replace(text, WS, " "))


def normalise_selection(text: Column) -> Column:
    """Collapsed; one enclosing pair of quotes is stripped, then trimmed again."""
    c = collapse(text)
    inner = F.btrim(F.substring(c, F.lit(2), F.length(c) - 2))
    enclosed = reduce(lambda x, y: x | y, [F.startswith(c, F.lit(a)) & F.endswith(c, F.lit(b)) for a, b in QUOTE_PAIRS]) & (F.length(c) >= 2)
    return F.when(enclosed, inner).otherwise(c)


def source_hash(kind: Column, text: Column, language: Column, model: Column) -> Column:
    """The identity of a generated comment: sha256 of kind|text|language|model, a null language empty."""
    return F.sha2(F.concat_ws("|", kind, normalise_selection(text), F.coalesce(language, F.lit("")), model).cast("binary"), 256)


def words(text: Column) -> Column:
    return F.filter(F.split(text, WS), lambda w: w != "")


def digit_percent(digits: Column, characters: Column) -> Column:
    """round(100 * digits / characters), halves up; 0 without characters."""
    return F.when(characters > 0, F.floor(digits * 100 / characters + 0.5)).otherwise(0).cast("long")


def sample_text(w: Column, head: int = 100, mid: int = 60) -> Column:
    """The whole text if it is short, else its first words, a gap mark and words from the middle."""
    start = F.floor(F.size(w) / 2).cast("int") + 1
    short = F.array_join(w, " ")
    return F.when(F.size(w) <= head + mid, short).otherwise(F.concat_ws(" ", F.array_join(F.slice(w, 1, head), " "), F.lit("…"), F.array_join(F.slice(w, start, F.lit(mid)), " ")))


def said_title(text: Column, longest: int = 80) -> Column:
    """A title cut to `longest` characters; null if it is blank, a file name, a machine
    label or only digits."""
    t = F.btrim(text)
    low = F.lower(t)
    dull = (t == "") | low.rlike(FILE_TITLE) | low.rlike(MACHINE_TITLE) | t.rlike(NUMBER_TITLE)
    cut = F.when(F.length(t) > longest, F.concat(F.rtrim(F.left(t, F.lit(longest))), F.lit("…"))).otherwise(t)
    return F.when(text.isNotNull() & ~dull, cut)


def normalise_title(title: Column, label: Column, index: Column) -> Column:
    """The first of two said titles that is not just the chapter's made-up number."""
    own = lambda t: F.when(F.lower(t) != F.concat(F.lit("chapter "), (index + 1).cast("string")), t)
    return F.coalesce(own(title), own(label), F.lit("(untitled)"))


def pad_chapter(label: Column) -> Column:
    """The first `Chapter 7` becomes `Chapter 07`; longer numbers stay."""
    return F.regexp_replace(label, r"(?i)^(.*?)\b(chapter )(\d)(?!\d)", "$1$20$3")


def filename_title(name: Column, default: str = "Untitled") -> Column:
    bare = collapse(F.regexp_replace(F.regexp_replace(name, r"\.[^.]+$", ""), "[_-]+", " "))
    return F.when(bare == "", default).otherwise(bare)


def published_year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\d{4}", 0), F.lit("")).cast("int")


def distinct_ci(values: Column) -> Column:
    """A short list without repeats, whatever their case: first spelling and order kept."""
    low = F.transform(values, lambda v: F.lower(v))
    return F.filter(values, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)


def split_genres(text: Column) -> Column:
    return distinct_ci(F.filter(F.transform(F.split(text, r"\s+(?:--|-)\s+"), lambda g: F.btrim(g)), lambda g: g != ""))


def split_authors(text: Column) -> Column:
    """Names between commas, trimmed, without repeats."""
    return distinct_ci(F.filter(F.transform(F.split(text, ","), lambda a: collapse(a)), lambda a: a != ""))


def parse_number(text: Column) -> Column:
    """A finite number, or null."""
    n = F.btrim(text).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def parse_text(text: Column) -> Column:
    """Trimmed; null if nothing is left."""
    return F.nullif(F.btrim(text), F.lit(""))


def language_tag(text: Column) -> Column:
    """Subtags by their places: the language in lower case, four letters as a script, two
    letters or three digits as a region, others in lower case; `_` separates as `-` does."""
    parts = F.split(F.replace(F.btrim(text), F.lit("_"), F.lit("-")), "-")
    script = lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substring(p, F.lit(2), F.length(p))))
    shaped = F.transform(parts, lambda p, i: F.when(i == 0, F.lower(p)).when(p.rlike("^[A-Za-z]{4}$"), script(p)).when(p.rlike("^([A-Za-z]{2}|[0-9]{3})$"), F.upper(p)).otherwise(F.lower(p)))
    return F.array_join(shaped, "-")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.btrim(p, F.lit(" \n\t"))), lambda p: p != "")


def selection_context(text: Column, start: Column, end: Column, most: int = 30) -> Column:
    """struct(before, after): up to `most` characters around a range, from 0, `end` not in it."""
    from_ = F.greatest(F.lit(0), start - most)
    return F.struct(F.substring(text, from_ + 1, start - from_).alias("before"), F.substring(text, end + 1, F.lit(most)).alias("after"))


def format_authors(authors: Column) -> Column:
    return F.when(F.size(authors) > 0, F.array_join(authors, ", ")).otherwise("Unknown author")


def parse_bool(text: Column) -> Column:
    t = F.lower(F.btrim(text))
    return F.when(t.isin("true", "1", "yes", "on"), True).when(t.isin("false", "0", "no", "off"), False)


def parse_status(text: Column, allowed: tuple[str, ...] = ("DRAFT", "PUBLISHED", "ARCHIVED"), default: str = "DRAFT") -> Column:
    t = F.upper(F.btrim(text))
    return F.when(t.isin(*allowed), t).otherwise(default)


def file_format(name: Column, mime: Column | None = None) -> Column:
    n, m = F.lower(name), F.coalesce(mime, F.lit("")) if mime is not None else F.lit("")
    return F.when((m == "application/epub+zip") | F.endswith(n, F.lit(".epub")), "EPUB").when((m == "application/pdf") | F.endswith(n, F.lit(".pdf")), "PDF").otherwise("UNKNOWN")


def image_mime(name: Column) -> Column:
    n = F.lower(name)
    ends = lambda *xs: reduce(lambda a, b: a | b, [F.endswith(n, F.lit(x)) for x in xs])
    return F.when(ends(".jpg", ".jpeg"), "image/jpeg").when(ends(".png"), "image/png").when(ends(".gif"), "image/gif").when(ends(".svg"), "image/svg+xml").otherwise("application/octet-stream")


def data_url(mime: Column, data: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(data))


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def href_path(href: Column) -> Column:
    """Without the fragment, percent-decoded where that is possible, in lower case."""
    return F.lower(_decoded(F.substring_index(href, "#", 1)))


def href_anchor(href: Column) -> Column:
    """The fragment, percent-decoded where that is possible; null without one."""
    return F.nullif(_decoded(F.regexp_extract(href, "#(.*)$", 1)), F.lit(""))


def strict_locator(raw: Column) -> Column:
    """A reading position: struct(chapterId, blockId, textOffset), or null unless both ids
    are JSON strings and the offset is a JSON number."""
    v = F.try_parse_json(raw)
    field = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    text = lambda name: F.schema_of_variant(field(name)) == "STRING"
    number = F.schema_of_variant(field("textOffset")).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    whole = F.struct(*[F.try_variant_get(v, f"$.{n}", kind).alias(n) for n, kind in (("chapterId", "string"), ("blockId", "string"), ("textOffset", "double"))])
    return F.when(text("chapterId") & text("blockId") & number, whole)


def contains_ci(text: Column, query: str) -> Column:
    """Case-insensitive substring search; a blank query finds all."""
    q = query.strip().lower()
    return F.lit(True) if not q else F.contains(F.lower(text), F.lit(q))
