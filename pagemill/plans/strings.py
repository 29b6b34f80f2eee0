"""Slugs, identities, parsing and presentation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.numbers import FONT_LADDER, font_scale, font_weight
from pagemill.functions.text import ONE_TO_MANY, ONE_TO_ONE, book_slug, collection_slug, data_url, file_format, filename_title, format_authors, href_anchor, href_path, image_mime, pad_chapter, parse_bool, parse_number, parse_status, parse_text, published_year, split_authors, split_genres, strict_locator
from pagemill.operators.relational import first_seen, unique_names
from pagemill.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _listed(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _slug_sql(x: str) -> str:
    out = f"lower({x})"
    for a, b in ONE_TO_MANY.items():
        out = f"replace({out}, '{a}', '{b}')"
    out = f"translate({out}, '{ONE_TO_ONE[0]}', '{ONE_TO_ONE[1]}')"
    return f"regexp_replace(regexp_replace({out}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def _clamped(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE regexp_replace(left({x}, {n}), '-+$', '') END"


_TITLES = "t AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE split_part(text, chr(10), 1) END AS title, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE source || ' Щедрин' END AS author FROM documents)"


@query(f"""WITH {_TITLES}, s AS (SELECT doc_id, {_slug_sql("coalesce(title, '')")} AS a, {_slug_sql("coalesce(author, '')")} AS b FROM t),
j AS (SELECT doc_id, CASE WHEN a <> '' AND b <> '' THEN a || '-by-' || b WHEN a <> '' THEN a WHEN b <> '' THEN b ELSE 'untitled' END AS s FROM s) SELECT doc_id, {_clamped('s', 80)} AS slug FROM j""")
def book_slugs(spark: SparkSession, d: str) -> DataFrame:
    title = F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.substring_index("text", "\n", 1))
    author = F.when(F.col("doc_id") % 4 != 0, F.concat("source", F.lit(" Щедрин")))
    return table(spark, d, "documents").select("doc_id", book_slug(title, author).alias("slug"))


@query(f"""WITH s AS (SELECT DISTINCT c_nationkey AS nation, c_mktsegment AS name FROM customer), g AS (SELECT nation, name, {_slug_sql("name")} AS s FROM s)
SELECT nation, name, {_clamped("CASE WHEN s = '' THEN 'collection' ELSE s END", 60)} AS slug FROM g""")
def collection_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("name")).distinct().withColumn("slug", collection_slug(F.col("name")))


@query("""WITH b AS (SELECT p_partkey AS book_id, p_brand AS shelf, replace(p_name, ' ', '-') AS base FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY shelf, base ORDER BY book_id) AS n FROM b)
SELECT book_id, shelf, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM n""")
def unique_slug(spark: SparkSession, d: str) -> DataFrame:
    from pagemill.functions.text import slugify

    books = table(spark, d, "part").select(F.col("p_partkey").alias("book_id"), F.col("p_brand").alias("shelf"), slugify(F.col("p_name")).alias("base"))
    return unique_names(books, ["shelf"], "base", [F.asc("book_id")], "slug").select("book_id", "shelf", "slug")


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS a FROM documents), u AS (SELECT doc_id, unnest(a) AS v, generate_subscripts(a, 1) AS pos FROM w),
f AS (SELECT doc_id, lower(v) AS k, min(pos) AS pos, arg_min(v, pos) AS v FROM u GROUP BY ALL) SELECT doc_id, string_agg(v, ' ' ORDER BY pos) AS names FROM f GROUP BY doc_id""")
def dedupe_ci_first_seen(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("a"))
    return first_seen(rows, ["doc_id"], "a", "a").select("doc_id", F.array_join("a", " ").alias("names"))


@query(r"""WITH g AS (SELECT p_partkey AS book_id, p_size, p_brand, p_name, list_transform(string_split_regex(p_type || ' -- ' || p_name || ' - ' || p_brand || ' -- ' || upper(p_name), '\s+(?:--|-)\s+'), lambda g: trim(g)) AS l FROM part),
k AS (SELECT *, list_transform(l, lambda x: lower(x)) AS low FROM g)
SELECT book_id, array_to_string(list_filter(l, lambda x, i: list_position(low, lower(x)) = i), '|') AS genres,
    TRY_CAST(nullif(regexp_extract('c. ' || (1900 + p_size) || '-05', '\d{4}'), '') AS INTEGER) AS published, CASE WHEN p_size % 5 = 0 THEN 'Unknown author' ELSE p_brand || ', ' || p_name END AS authors FROM k""")
def book_metadata(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat("p_type", F.lit(" -- "), "p_name", F.lit(" - "), "p_brand", F.lit(" -- "), F.upper("p_name"))
    year = F.concat(F.lit("c. "), (1900 + F.col("p_size")).cast("string"), F.lit("-05"))
    authors = F.when(F.col("p_size") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand", "p_name"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("book_id"), F.array_join(split_genres(said), "|").alias("genres"), published_year(year).alias("published"), format_authors(authors).alias("authors"))


@query(r"""WITH t AS (SELECT o_orderkey AS book_id, ' ' || o_orderpriority || ', ' || lower(o_orderpriority) || ',,' || o_orderstatus || '  ' || o_orderstatus || ' , ' || o_orderpriority AS said FROM orders),
n AS (SELECT book_id, trim(regexp_replace(unnest(string_split(said, ',')), '\s+', ' ', 'g')) AS name, generate_subscripts(string_split(said, ','), 1) AS pos FROM t),
f AS (SELECT book_id, arg_min(name, pos) AS name, min(pos) AS pos FROM n WHERE name <> '' GROUP BY book_id, lower(name)) SELECT book_id, string_agg(name, '|' ORDER BY pos) AS authors FROM f GROUP BY book_id""")
def author_lists(spark: SparkSession, d: str) -> DataFrame:
    p, o = F.col("o_orderpriority"), F.col("o_orderstatus")
    said = F.concat(F.lit(" "), p, F.lit(", "), F.lower(p), F.lit(",,"), o, F.lit("  "), o, F.lit(" , "), p)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("book_id"), F.array_join(split_authors(said), "|").alias("authors"))


_FLAGS = ["Yes", " on ", "0", "FALSE", "maybe", "1", ""]
_STATES = [" published", "Draft", "archived ", "lost"]
_NUMBERS = [" {} ", "{}e2", "abc", "", "-0.{}", ".5", "Infinity", "NaN", "1 2"]


@query(f"""WITH f AS (SELECT event_id, trim({_listed(_FLAGS)}[event_id % 7 + 1]) AS b, {_listed(_STATES)}[event_id % 4 + 1] AS s, trim(replace({_listed(_NUMBERS)}[event_id % 9 + 1], '{{}}', CAST(event_id AS VARCHAR))) AS n FROM events)
SELECT event_id, CASE WHEN lower(b) IN ('true', '1', 'yes', 'on') THEN true WHEN lower(b) IN ('false', '0', 'no', 'off') THEN false END AS flag, CASE WHEN upper(trim(s)) IN ('DRAFT', 'PUBLISHED', 'ARCHIVED') THEN upper(trim(s)) ELSE 'DRAFT' END AS status,
    CASE WHEN isfinite(TRY_CAST(n AS DOUBLE)) THEN TRY_CAST(n AS DOUBLE) END AS number, nullif(n, '') AS text FROM f""")
def form_parse(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda values: F.replace(F.get(F.array(*map(F.lit, values)), (F.col("event_id") % len(values)).cast("int")), F.lit("{}"), F.col("event_id").cast("string"))
    return table(spark, d, "events").select("event_id", parse_bool(pick(_FLAGS)).alias("flag"), parse_status(pick(_STATES)).alias("status"), parse_number(pick(_NUMBERS)).alias("number"), parse_text(pick(_NUMBERS)).alias("text"))


@query("""WITH h AS (SELECT page_id, url || CASE WHEN page_id % 3 = 0 THEN '#S%20%C3%A9' || page_id WHEN page_id % 3 = 1 THEN '%20x' ELSE '' END AS href FROM pages)
SELECT page_id, lower(url_decode(split_part(href, '#', 1))) AS path, nullif(CASE WHEN contains(href, '#') THEN url_decode(substr(href, strpos(href, '#') + 1)) ELSE '' END, '') AS anchor FROM h""")
def href_normalize(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("page_id") % 3
    href = F.concat("url", F.when(m == 0, F.concat(F.lit("#S%20%C3%A9"), F.col("page_id").cast("string"))).when(m == 1, "%20x").otherwise(""))
    return table(spark, d, "pages").select("page_id", href_path(href).alias("path"), href_anchor(href).alias("anchor"))


_ENDS = ["_vol.EPUB", ".pdf", ".Jpeg", ".svg", ".gif", ".txt", ".png"]


@query(f"""WITH n AS (SELECT p_partkey AS id, replace(p_name, ' ', '_') || {_ENDS}[p_partkey % 7 + 1] AS name FROM part)
SELECT id, CASE WHEN lower(name) LIKE '%.epub' THEN 'EPUB' WHEN lower(name) LIKE '%.pdf' THEN 'PDF' ELSE 'UNKNOWN' END AS format,
    CASE WHEN lower(name) LIKE '%.jpg' OR lower(name) LIKE '%.jpeg' THEN 'image/jpeg' WHEN lower(name) LIKE '%.png' THEN 'image/png' WHEN lower(name) LIKE '%.gif' THEN 'image/gif' WHEN lower(name) LIKE '%.svg' THEN 'image/svg+xml' ELSE 'application/octet-stream' END AS mime,
    trim(regexp_replace(regexp_replace(name, '\\.[^.]+$', ''), '[_-]+', ' ', 'g')) AS title, 'data:text/plain;base64,' || base64(encode(name)) AS url FROM n""")
def file_kinds(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.get(F.array(*map(F.lit, _ENDS)), (F.col("p_partkey") % 7).cast("int")))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), name.alias("name"))
    n = F.col("name")
    return rows.select("id", file_format(n).alias("format"), image_mime(n).alias("mime"), filename_title(n).alias("title"), data_url(F.lit("text/plain"), n.cast("binary")).alias("url"))


#: Font sizes and weights, edge cases among them; {} is the part's size.
_FONTS = [*FONT_LADDER, "{}%", "{} %", "0.{}em", ".{}rem", "{}.em", "-{}em", "0em", "1.2.3em", "{}px", "inherit", "100%", " SMALL "]
_WEIGHTS = ["{}0", "{}00", "{}5", "123456789012345678901", "normal", "Bold", " lighter", "bolder", "400", "0", "-{}00", "7 00", "inherit"]


@query(f"""WITH s AS (SELECT p_partkey AS id, p_size, p_name, lower(trim(replace({_listed(_FONTS)}[p_partkey % {len(_FONTS)} + 1], '{{}}', CAST(p_size AS VARCHAR)))) AS f, lower(trim(replace({_listed(_WEIGHTS)}[p_partkey % {len(_WEIGHTS)} + 1], '{{}}', CAST(p_size AS VARCHAR)))) AS w FROM part),
r AS (SELECT *, CASE f {" ".join(f"WHEN '{k}' THEN {v}" for k, v in FONT_LADDER.items())} ELSE TRY_CAST(nullif(regexp_extract(f, '^(-?[\\d.]+)\\s*(em|rem|%)$', 1), '') AS DOUBLE) / CASE WHEN f LIKE '%\\%' ESCAPE '\\' THEN 100 ELSE 1 END END AS size,
    CASE w WHEN 'normal' THEN 400 WHEN 'bold' THEN 700 WHEN 'bolder' THEN 700 WHEN 'lighter' THEN 300 ELSE TRY_CAST(nullif(regexp_extract(w, '^\\d+$'), '') AS DOUBLE) END AS heavy FROM s)
SELECT id, 'Chapter ' || lpad(CAST(p_size AS VARCHAR), 2, '0') || ': ' || p_name AS label, CASE WHEN size > 0 THEN nullif(floor(least(2.0, greatest(0.5, size)) * 1000 + 0.5) / 1000, 1) END AS font,
    CASE WHEN heavy IS NOT NULL THEN CAST(nullif(floor(least(900, greatest(100, heavy)) / 100.0 + 0.5) * 100, 400) AS INTEGER) END AS weight FROM r""")
def label_styles(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    css = lambda values: F.replace(F.get(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values)).cast("int")), F.lit("{}"), size)
    label = F.concat(F.lit("Chapter "), size, F.lit(": "), F.col("p_name"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), pad_chapter(label).alias("label"), font_scale(css(_FONTS)).alias("font"), font_weight(css(_WEIGHTS)).alias("weight"))


_LOCATORS = ['{"chapterId": 1, "blockId": "b", "textOffset": 2}', "oops", '{"chapterId": "c{}", "blockId": "b1", "textOffset": {}}', '{"chapterId": "c{}", "blockId": "b1", "textOffset": "{}"}', '{"chapterId": "c{}", "blockId": null, "textOffset": 1}', '{"chapterId": "", "blockId": "", "textOffset": {}.5}', '{"blockId": "b1", "textOffset": {}}', "[1, 2]", "", '{"chapterId": "x", "blockId": "y", "textOffset": -{}, "more": [{}]}']


@query(f"""WITH e AS (SELECT event_id, nullif(replace({_listed(_LOCATORS)}[event_id % {len(_LOCATORS)} + 1], '{{}}', CAST(event_id AS VARCHAR)), '') AS l FROM events),
v AS (SELECT event_id, CASE WHEN json_valid(l) THEN l END AS l FROM e),
g AS (SELECT event_id, CASE WHEN json_type(l, '$.chapterId') = 'VARCHAR' AND json_type(l, '$.blockId') = 'VARCHAR' AND json_type(l, '$.textOffset') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN l END AS l FROM v)
SELECT event_id, json_extract_string(l, '$.chapterId') AS chapter, json_extract_string(l, '$.blockId') AS block, CAST(json_extract_string(l, '$.textOffset') AS DOUBLE) AS text_offset FROM g""")
def locator_parse(spark: SparkSession, d: str) -> DataFrame:
    """Strict: null unless all three fields are there and of their types."""
    raw = F.replace(F.get(F.array(*map(F.lit, _LOCATORS)), (F.col("event_id") % len(_LOCATORS)).cast("int")), F.lit("{}"), F.col("event_id").cast("string"))
    rows = table(spark, d, "events").select("event_id", strict_locator(raw).alias("l"))
    return rows.select("event_id", F.col("l.chapterId").alias("chapter"), F.col("l.blockId").alias("block"), F.col("l.textOffset").alias("text_offset"))


@query("""WITH a AS (SELECT c_custkey AS id, 'de;q=0.' || (c_nationkey % 9 + 1) || ',uk-UA;q=0.' || (c_custkey % 9 + 1) || ',xx,en;q=0' AS header FROM customer),
p AS (SELECT id, split_part(unnest(string_split(header, ',')), ';', 1) AS tag, TRY_CAST(coalesce(nullif(split_part(unnest(string_split(header, ',')), 'q=', 2), ''), '1') AS DOUBLE) AS q, generate_subscripts(string_split(header, ','), 1) AS pos FROM a),
m AS (SELECT id, pos, q, CASE WHEN tag IN ('en', 'uk', 'de') THEN tag WHEN split_part(tag, '-', 1) IN ('en', 'uk', 'de') THEN split_part(tag, '-', 1) END AS lang FROM p WHERE q > 0)
SELECT a.id, coalesce(arg_min(lang, (-q, pos)) FILTER (WHERE lang IS NOT NULL), 'en') AS language FROM a LEFT JOIN m ON a.id = m.id GROUP BY a.id""")
def language_match(spark: SparkSession, d: str) -> DataFrame:
    """The best supported language of an Accept-Language header."""
    header = F.concat(F.lit("de;q=0."), (F.col("c_nationkey") % 9 + 1).cast("string"), F.lit(",uk-UA;q=0."), (F.col("c_custkey") % 9 + 1).cast("string"), F.lit(",xx,en;q=0"))
    known = ["en", "uk", "de"]
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.posexplode(F.split(header, ",")).alias("pos", "part"))
    tag, quality = F.substring_index("part", ";", 1), F.coalesce(F.nullif(F.regexp_extract("part", "q=([0-9.]+)", 1), F.lit("")), F.lit("1")).cast("double")
    main = F.substring_index(tag, "-", 1)
    lang = F.when(tag.isin(*known), tag).when(main.isin(*known), main)
    usable = lang.isNotNull() & (quality > 0)
    return rows.groupBy("id").agg(F.coalesce(F.min_by(lang, F.when(usable, F.struct(-quality, "pos"))), F.lit("en")).alias("language"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'unavailable' WHEN o_orderkey % 7 = 0 THEN 'downloading' WHEN o_orderkey % 5 = 0 AND o_orderkey % 3 = 0 THEN 'saved' WHEN o_orderkey % 5 = 0 THEN 'partial' ELSE 'online' END AS card,
    o_orderkey % 4 = 0 AND o_orderkey % 6 <> 0 AND o_orderkey <> 12 AS evictable FROM orders""")
def offline_card(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    card = F.when(F.col("o_orderstatus") == "P", "unavailable").when(k % 7 == 0, "downloading").when((k % 5 == 0) & (k % 3 == 0), "saved").when(k % 5 == 0, "partial").otherwise("online")
    return table(spark, d, "orders").select(k.alias("id"), card.alias("card"), ((k % 4 == 0) & (k % 6 != 0) & (k != 12)).alias("evictable"))
