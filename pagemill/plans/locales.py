"""Names in the order of a locale, and language tags in their canonical form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.locale import LANGUAGE_ALIASES, REGION_ALIASES, canonical_tag, collated
from pagemill.sources.tables import table

QUERIES, SQL = {}, {}
#: How the languages of documents are written in older catalogues, by language and parity of the length.
WRITTEN = {("en", 0): "ENG_uk", ("en", 1): "en-gb-oed", ("de", 0): "ger-dd", ("de", 1): "De_at", ("fr", 0): "fra-FX", ("fr", 1): "fr_ca", ("es", 0): "SPA-419", ("es", 1): " es "}
_VALUES = "(VALUES " + ", ".join(f"('{lang}', {odd}, '{tag}')" for (lang, odd), tag in WRITTEN.items()) + ")"
_ALIASES = "(VALUES " + ", ".join(f"('{old}', '{new}')" for old, new in LANGUAGE_ALIASES.items()) + ")"
_REGIONS = "CASE p " + " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in REGION_ALIASES.items()) + " ELSE p END"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"""WITH said AS (SELECT doc_id, lower(replace(trim(tag), '_', '-')) AS tag FROM documents LEFT JOIN {_VALUES} w(lang, odd, tag) ON w.lang = documents.lang AND w.odd = n_chars % 2),
longest AS (SELECT s.tag, arg_max(a.old, length(a.old)) AS old, arg_max(a.new, length(a.old)) AS new FROM (SELECT DISTINCT tag FROM said) s JOIN {_ALIASES} a(old, new) ON s.tag = a.old OR starts_with(s.tag, a.old || '-') GROUP BY s.tag),
new AS (SELECT doc_id, CASE WHEN l.new IS NULL THEN s.tag ELSE l.new || substr(s.tag, length(l.old) + 1) END AS tag FROM said s LEFT JOIN longest l ON l.tag = s.tag),
shaped AS (SELECT doc_id, array_to_string(list_transform(string_split(tag, '-'), lambda p, i: CASE WHEN i = 1 THEN lower(p) WHEN regexp_full_match(p, '[A-Za-z]{{4}}') THEN upper(p[1]) || lower(p[2:]) WHEN regexp_full_match(p, '([A-Za-z]{{2}}|[0-9]{{3}})') THEN upper(p) ELSE lower(p) END), '-') AS tag FROM new)
SELECT doc_id, array_to_string(list_transform(string_split(tag, '-'), lambda p, i: CASE WHEN i = 1 THEN p ELSE {_REGIONS} END), '-') AS tag FROM shaped""")
def canonical_tags(spark: SparkSession, d: str) -> DataFrame:
    odd = F.col("n_chars") % 2
    tag = F.coalesce(*[F.when((F.col("lang") == lang) & (odd == parity), tag) for (lang, parity), tag in WRITTEN.items()])
    return table(spark, d, "documents").select("doc_id", canonical_tag(tag).alias("tag"))


_NAMES = "CASE c_custkey % 4 WHEN 0 THEN c_mktsegment WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN replace(c_mktsegment, 'E', 'É') ELSE lower(replace(c_mktsegment, 'U', 'Ü')) END"


@query(f"""WITH c AS (SELECT c_nationkey AS nation, c_custkey, c_mktsegment AS base, {_NAMES} AS name FROM customer), shelves AS (SELECT nation, base, name, count(*) AS own FROM c GROUP BY ALL),
accents AS (SELECT *, list_transform(string_split(name, ''), lambda x: x IN ('É', 'Ü', 'ü')) AS a, name = lower(name) AS small FROM shelves)
SELECT nation, name, own, CAST(sum(own) OVER (PARTITION BY nation, base) AS BIGINT) AS matched, CAST(row_number() OVER (PARTITION BY nation ORDER BY base, a, NOT small) AS INTEGER) AS place FROM accents""")
def shelves_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Shelves of a nation in the order of their names (letters first, then accents, then case), with the
    customers of all shelves whose names differ from theirs in case and accents only."""
    k, segment = F.col("c_custkey") % 4, F.col("c_mktsegment")
    name = F.when(k == 0, segment).when(k == 1, F.lower(segment)).when(k == 2, F.replace(segment, F.lit("E"), F.lit("É"))).otherwise(F.lower(F.replace(segment, F.lit("U"), F.lit("Ü"))))
    shelves = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation"), name.alias("name")).agg(F.count("*").alias("own"))
    same = shelves.groupBy("nation", collated(F.col("name"), case=False, accents=False).alias("like_")).agg(F.sum("own").alias("matched"))
    met = shelves.join(same.withColumnRenamed("nation", "of"), (F.col("nation") == F.col("of")) & (collated(F.col("name"), case=False, accents=False) == F.col("like_")))
    return met.select("nation", "name", "own", "matched", F.row_number().over(W.partitionBy("nation").orderBy(collated(F.col("name")))).alias("place"))


@query("""WITH last AS (SELECT user_id, max(event_id) AS at FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT e.user_id AS book, count(*) FILTER (WHERE e.event_type = 'error' AND e.event_id > coalesce(l.at, -1)) AS attempts, count(*) FILTER (WHERE e.event_type = 'error') AS errors,
    CASE WHEN arg_max(e.event_type, e.event_id) FILTER (WHERE e.event_type IN ('signup', 'error', 'purchase')) = 'purchase' THEN 'READY' WHEN count(*) FILTER (WHERE e.event_type = 'error' AND e.event_id > coalesce(l.at, -1)) >= 3 THEN 'GIVEN UP' ELSE 'ELIGIBLE' END AS state
FROM events e LEFT JOIN last l ON l.user_id = e.user_id GROUP BY e.user_id""")
def job_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Failed attempts since a book's last new file (signup), which sets the counter back; three are the most."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    kind = F.col("event_type")
    per = e.groupBy(F.col("user_id").alias("book")).agg(F.max(F.when(kind == "signup", F.col("event_id"))).alias("fresh"), F.count_if(kind == "error").alias("errors"), F.max_by(kind, F.when(kind.isin("signup", "error", "purchase"), F.col("event_id"))).alias("last"))
    failed = e.where(kind == "error").join(per.select("book", "fresh"), F.col("user_id") == F.col("book")).where(F.col("event_id") > F.coalesce("fresh", F.lit(-1)))
    counted = failed.groupBy(F.col("book").alias("of")).agg(F.count("*").alias("n"))
    attempts = F.coalesce("n", F.lit(0).cast("long"))
    state = F.when(F.col("last") == "purchase", "READY").when(attempts >= 3, "GIVEN UP").otherwise("ELIGIBLE")
    return per.join(counted, F.col("book") == F.col("of"), "left").select("book", attempts.alias("attempts"), "errors", state.alias("state"))
