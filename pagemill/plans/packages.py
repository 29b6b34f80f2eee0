"""Stored packages, validity, snapshots in part, contents trust and presentation of chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.text import collapse, language_tag
from pagemill.functions.styles import BREAK_SIGNS, alignment, break_points, indent
from pagemill.operators.relational import delete, upsert
from pagemill.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


PACKAGE = "version int, chapters array<struct<chapterId:string,blockIds:array<string>,counted:boolean>>"


def parsed_package(raw: Column) -> Column:
    """A stored package or index: null unless its version is 1 or 2 and it has chapters."""
    p = F.from_json(raw, PACKAGE)
    return F.when(p["version"].isin(1, 2) & p["chapters"].isNotNull(), p)


def upgraded_chapters(package: Column) -> Column:
    """Version 1 knows no counted flag: everything counts."""
    return F.transform(package["chapters"], lambda c: F.struct(c["chapterId"].alias("chapter_id"), F.size(c["blockIds"]).alias("blocks"), F.coalesce(c["counted"], F.lit(True)).alias("counted")))


_RAW_SQL = """CASE doc_id % 5 WHEN 0 THEN '{"version": 1, "chapters": [{"chapterId": "a", "blockIds": ["1", "2"]}, {"chapterId": "b", "blockIds": []}]}'
    WHEN 1 THEN '{"version": 2, "chapters": [{"chapterId": "a", "blockIds": ["1"], "counted": false}, {"chapterId": "b", "blockIds": ["' || doc_id || '", "y"], "counted": true}]}' WHEN 2 THEN '{"version": 3, "chapters": []}' WHEN 3 THEN 'broken' ELSE '{"version": 2}' END"""


def _raw() -> Column:
    k = F.col("doc_id") % 5
    second = F.concat(F.lit('{"version": 2, "chapters": [{"chapterId": "a", "blockIds": ["1"], "counted": false}, {"chapterId": "b", "blockIds": ["'), F.col("doc_id").cast("string"), F.lit('", "y"], "counted": true}]}'))
    first = '{"version": 1, "chapters": [{"chapterId": "a", "blockIds": ["1", "2"]}, {"chapterId": "b", "blockIds": []}]}'
    return F.when(k == 0, first).when(k == 1, second).when(k == 2, '{"version": 3, "chapters": []}').when(k == 3, "broken").otherwise('{"version": 2}')


@query(f"""WITH r AS (SELECT doc_id, {_RAW_SQL} AS raw FROM documents), p AS (SELECT doc_id, CASE WHEN json_valid(raw) AND CAST(json_extract(raw, '$.version') AS INTEGER) IN (1, 2) AND json_extract(raw, '$.chapters') IS NOT NULL THEN raw END AS raw FROM r)
SELECT doc_id, raw IS NOT NULL AS valid, CAST(json_array_length(raw, '$.chapters') AS BIGINT) AS chapters, CAST(json_array_length(raw, '$.chapters[0].blockIds') + json_array_length(raw, '$.chapters[1].blockIds') AS BIGINT) AS blocks,
    CAST(CASE WHEN raw IS NULL THEN NULL WHEN coalesce(json_extract_string(raw, '$.chapters[0].counted'), 'true') = 'true' THEN json_array_length(raw, '$.chapters[0].blockIds') + json_array_length(raw, '$.chapters[1].blockIds') ELSE json_array_length(raw, '$.chapters[1].blockIds') END AS BIGINT) AS body_blocks FROM p""")
def package_upgrade(spark: SparkSession, d: str) -> DataFrame:
    package = parsed_package(_raw())
    rows = table(spark, d, "documents").select("doc_id", package.isNotNull().alias("valid"), upgraded_chapters(package).alias("c"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["blocks"])
    return rows.select("doc_id", "valid", F.when(F.col("valid"), F.size("c")).cast("long").alias("chapters"), total(F.col("c")).alias("blocks"), total(F.filter("c", lambda x: x["counted"])).alias("body_blocks"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""")
def locator_lenient(spark: SparkSession, d: str) -> DataFrame:
    """Any JSON counts; what is malformed or missing is null."""
    raw = F.when(F.col("event_id") % 4 == 0, "{oops").when(F.col("event_id") % 4 != 1, F.col("props"))
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json(raw), "$.k", "long").alias("k"))


@query("""SELECT event_id, value > 0 AND value <= 400 AS value_ok, event_type IN ('view', 'click', 'purchase', 'signup') AS kind_ok, length(props) BETWEEN 9 AND 2000 AS length_ok, regexp_matches(event_type || event_id, '^[a-z]+[0-9]{2,}$') AS id_ok FROM events""")
def validity_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", ((F.col("value") > 0) & (F.col("value") <= 400)).alias("value_ok"), F.col("event_type").isin("view", "click", "purchase", "signup").alias("kind_ok"), F.length("props").between(9, 2000).alias("length_ok"), F.concat("event_type", F.col("event_id").cast("string")).rlike("^[a-z]+[0-9]{2,}$").alias("id_ok"))


@query("""WITH shelf AS (SELECT c_custkey AS item, c_nationkey AS shelf FROM customer), fresh AS (SELECT c_custkey AS item, 7 AS shelf FROM customer WHERE c_custkey % 11 = 0)
SELECT item, CAST(shelf AS BIGINT) AS shelf FROM shelf WHERE shelf <> 7 AND item NOT IN (SELECT item FROM fresh) UNION ALL SELECT item, shelf FROM fresh""")
def partial_replace(spark: SparkSession, d: str) -> DataFrame:
    """One shelf is replaced: its old members go, the new ones come from wherever they were."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("item"), F.col("c_nationkey").cast("long").alias("shelf"))
    fresh = c.where("item % 11 = 0").withColumn("shelf", F.lit(7).cast("long"))
    return upsert(c.where("shelf <> 7"), fresh, ["item"])


@query("SELECT doc_id, source FROM documents WHERE NOT starts_with(source, 'src1') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def prefix_delete(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source").where(~F.startswith("source", F.lit("src1")))
    return delete(rows, table(spark, d, "labels").where("quality = 0"), ["doc_id"])


@query(r"""WITH t AS (SELECT source, doc_id, nullif(trim(split_part(text, chr(10), 1)), '') AS title FROM documents),
c AS (SELECT source, count(*) AS chapters, count(title) / count(*) AS coverage, count(DISTINCT title) AS entries FROM t GROUP BY source)
SELECT source, chapters, entries >= chapters AS rich, coverage >= 0.8 AS covered, entries >= chapters OR coverage >= 0.8 AS trusted FROM c""")
def toc_trust(spark: SparkSession, d: str) -> DataFrame:
    """Contents are trusted if they have as many entries as chapters; titles found in the
    text are used then, or if most chapters have one."""
    rows = table(spark, d, "documents").select("source", F.nullif(F.btrim(F.substring_index("text", "\n", 1), F.lit(" ")), F.lit("")).alias("title"))
    c = rows.groupBy("source").agg(F.count("*").alias("chapters"), (F.count("title") / F.count("*")).alias("coverage"), F.count_distinct("title").alias("entries"))
    rich, covered = F.col("entries") >= F.col("chapters"), F.col("coverage") >= 0.8
    return c.select("source", "chapters", rich.alias("rich"), covered.alias("covered"), (rich | covered).alias("trusted"))


@query("""WITH c AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, n_chars % 2 = 0 AS have FROM documents),
w AS (SELECT *, bool_and(have) OVER (PARTITION BY source ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS whole FROM c)
SELECT source, doc_id FROM w WHERE (i % 3 = 1 AND NOT whole) OR (i = n - 1 AND n % 3 = 1 AND NOT have)""")
def stride_cover(spark: SparkSession, d: str) -> DataFrame:
    """Chapters to fetch with their neighbours: every third, unless all three are there;
    the last one if no window reaches it. Windows don't overlap, so no state is needed."""
    book = W.partitionBy("source").orderBy("doc_id")
    rows = table(spark, d, "documents").select("source", "doc_id", (F.row_number().over(book) - 1).alias("i"), F.count("*").over(W.partitionBy("source")).alias("n"), (F.col("n_chars") % 2 == 0).alias("have"))
    rows = rows.withColumn("whole", F.bool_and("have").over(book.rowsBetween(-1, 1)))
    wanted = ((F.col("i") % 3 == 1) & ~F.col("whole")) | ((F.col("i") == F.col("n") - 1) & (F.col("n") % 3 == 1) & ~F.col("have"))
    return rows.where(wanted).select("source", "doc_id")


@query(r"""WITH c AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, 'Text/' || lang || '_Part ' || doc_id || '.xhtml' AS href, CASE WHEN doc_id % 3 = 0 THEN 'Sec.' || doc_id END AS anchor, split_part(text, chr(10), 1) AS title, source, source || ' ' || lang AS book FROM documents),
t AS (SELECT *, trim(regexp_replace(title, '\s+', ' ', 'g')) AS own, trim(regexp_replace(split_part(title, ':', 1), '\s+', ' ', 'g')) AS head FROM c)
SELECT doc_id, 'chapter-' || (i + 1) || '-' || trim(regexp_replace(lower(regexp_extract(href, '([^/]*)\.[^.]*$', 1)), '[^a-z0-9]+', '-', 'g'), '-') || CASE WHEN anchor IS NULL THEN '' ELSE '--' || trim(regexp_replace(lower(anchor), '[^a-z0-9]+', '-', 'g'), '-') END AS chapter_id,
    CASE WHEN len(string_split(own, ' ')) <= 8 AND lower(own) <> lower(book) AND own <> '' THEN own WHEN len(string_split(head, ' ')) <= 8 AND lower(head) <> lower(book) AND head <> '' THEN head ELSE 'Chapter ' || (i + 1) END AS label FROM t""")
def chapter_ids(spark: SparkSession, d: str) -> DataFrame:
    """Identities from place, file and anchor; labels that only repeat the book's title fall back to the place."""
    place = F.row_number().over(W.partitionBy("source").orderBy("doc_id")).cast("string")
    plain = lambda c: F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))
    href = F.concat(F.lit("Text/"), "lang", F.lit("_Part "), F.col("doc_id").cast("string"), F.lit(".xhtml"))
    anchor = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Sec."), F.col("doc_id").cast("string")))
    first = F.substring_index("text", "\n", 1)
    book = F.concat("source", F.lit(" "), "lang")

    def candidate(text: Column) -> Column:
        """A short line that is not the book's title, whatever its case and white space."""
        t = collapse(text)
        return F.when((F.size(F.split(t, " ")) <= 8) & (F.lower(t) != F.lower(collapse(book))) & (t != ""), t)

    title = F.coalesce(candidate(first), candidate(F.substring_index(first, ":", 1)))
    rows = table(spark, d, "documents").select("doc_id", "source", "lang", title.alias("title")).withColumn("place", place)
    chapter = F.concat(F.lit("chapter-"), "place", F.lit("-"), plain(F.regexp_extract(href, r"([^/]*)\.[^.]*$", 1)), F.when(anchor.isNotNull(), F.concat(F.lit("--"), plain(anchor))).otherwise(""))
    return rows.select("doc_id", chapter.alias("chapter_id"), F.coalesce("title", F.concat(F.lit("Chapter "), "place")).alias("label"))


@query(r'''SELECT doc_id, '[' || doc_id || '] ' || regexp_replace(lang || ' """" ' || source, '"{3,}', '"', 'g') || ' · ' || len(string_split(text, chr(10))) || ' blocks · ' || n_chars || ' characters' || CASE WHEN doc_id % 2 = 0 THEN ' · even' ELSE '' END AS line FROM documents''')
def prompt_lines(spark: SparkSession, d: str) -> DataFrame:
    """One line a chapter; long quote runs could close a fence and shrink to one."""
    title = F.regexp_replace(F.concat("lang", F.lit(' """" '), "source"), '"{3,}', '"')
    head = F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("] "), title)
    parts = [head, F.concat(F.size(F.split("text", "\n")).cast("string"), F.lit(" blocks")), F.concat(F.col("n_chars").cast("string"), F.lit(" characters")), F.when(F.col("doc_id") % 2 == 0, "even")]
    return table(spark, d, "documents").select("doc_id", F.concat_ws(" · ", *parts).alias("line"))


_STYLES = ["text-align: Center", "color: red; TEXT-ALIGN:end", "text-indent: 1.5em", "text-indent:150%;text-align:start", "text-indent: -1em", "text-indent: 12px", "text-indent: 9rem", "text-indent: 3ch", "text-indent: 0", ""]


@query(f"""WITH s AS (SELECT p_partkey AS id, {_STYLES}[p_partkey % 10 + 1] AS style, p_partkey % 10 AS k, p_partkey FROM part)
SELECT id, CASE k WHEN 0 THEN 'center' WHEN 1 THEN 'right' WHEN 3 THEN 'left' ELSE CASE WHEN p_partkey % 4 = 0 THEN 'justify' END END AS align, CASE k WHEN 2 THEN 1.5 WHEN 3 THEN 1.5 WHEN 6 THEN 4.0 WHEN 7 THEN 1.5 WHEN 8 THEN 0.0 END::DOUBLE AS indent FROM s""")
def block_styles(spark: SparkSession, d: str) -> DataFrame:
    style = F.get(F.array(*map(F.lit, _STYLES)), (F.col("p_partkey") % 10).cast("int"))
    attribute = F.when(F.col("p_partkey") % 4 == 0, " Justify ").otherwise("middle")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), alignment(style, attribute).alias("align"), indent(style).alias("indent"))


@query(rf"""WITH t AS (SELECT page_id, regexp_extract_all(url, '^\s+|\S+\s*') AS tokens FROM pages)
SELECT page_id, string_split(array_to_string(list_transform(tokens, lambda t: CASE WHEN length(rtrim(t)) >= 16 THEN regexp_replace(regexp_replace(t, '([{BREAK_SIGNS}]+)([^\s{BREAK_SIGNS}])', '\1' || chr(1) || '\2', 'g'), '([0-9][{BREAK_SIGNS}]+)' || chr(1) || '([0-9])', '\1\2', 'g') ELSE t END), ''), chr(1)) AS parts FROM t""")
def url_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Where long addresses may be broken; pinned examples are in the tests."""
    return table(spark, d, "pages").select("page_id", break_points(F.col("url")).alias("parts"))


@query("""SELECT page_id, CASE WHEN starts_with(h, '#') OR regexp_matches(h, '^[a-z][a-z0-9+.-]*:') THEN h ELSE 'OEBPS/nav/' || h END AS target FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '#p' || page_id WHEN 1 THEN url ELSE 'ch' || page_id || '.html' END AS h FROM pages)""")
def toc_href_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Anchors and full addresses stay; others are relative to the contents' folder."""
    k = F.col("page_id") % 3
    h = F.when(k == 0, F.concat(F.lit("#p"), F.col("page_id").cast("string"))).when(k == 1, F.col("url")).otherwise(F.concat(F.lit("ch"), F.col("page_id").cast("string"), F.lit(".html")))
    return table(spark, d, "pages").select("page_id", F.when(F.startswith(h, F.lit("#")) | h.rlike("^[a-z][a-z0-9+.-]*:"), h).otherwise(F.concat(F.lit("OEBPS/nav/"), h)).alias("target"))


_TAGS = ["EN_us", "uk", "De-at", "fr_FR", "zh_hant_tw", "SR-Cyrl-rs", "es-419", "sl-Rozaj-biske", " PT_br "]


@query(f"""SELECT c_custkey AS id, array_to_string(list_transform(string_split(replace(trim({_TAGS}[c_custkey % {len(_TAGS)} + 1]), '_', '-'), '-'), lambda p, i: CASE WHEN i = 1 THEN lower(p)
    WHEN regexp_full_match(p, '[A-Za-z]{{4}}') THEN upper(p[1]) || lower(p[2:]) WHEN regexp_full_match(p, '([A-Za-z]{{2}}|[0-9]{{3}})') THEN upper(p) ELSE lower(p) END), '-') AS tag FROM customer""")
def language_tags(spark: SparkSession, d: str) -> DataFrame:
    said = F.get(F.array(*map(F.lit, _TAGS)), (F.col("c_custkey") % len(_TAGS)).cast("int"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), language_tag(said).alias("tag"))
