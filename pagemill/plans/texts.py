"""Chapter text, label and position queries: a book is a source, its chapters are documents by doc_id, blocks are lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.numbers import counts_as_reading, half_up, pages, percent, reading_hours
from pagemill.functions.text import FILE_TITLE, MACHINE_TITLE, NUMBER_TITLE, collapse, contains_ci, digit_percent, normalise_selection, normalise_title, paragraphs, said_title, sample_text, selection_context, source_hash, words
from pagemill.functions.utf16 import utf16_length
from pagemill.operators.relational import counts_of_domain, numbered
from pagemill.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _chapters(spark: SparkSession, d: str, **columns: Column) -> DataFrame:
    """The documents with their place in their book. What a query needs of the texts are
    `columns`, computed before the window, so that no text is shuffled."""
    order = W.partitionBy("source").orderBy("doc_id")
    rows = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars", *[c.alias(n) for n, c in columns.items()])
    return rows.withColumn("idx", F.row_number().over(order) - 1)


def n_words(text: str = "text") -> Column:
    return F.size(words(F.col(text))).cast("long")


CH = "ch AS (SELECT doc_id, source, lang, text, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx FROM documents)"
WC = r"len(list_filter(string_split_regex({}, '\s+'), lambda w: w <> ''))"


@query(rf"""WITH {CH}, b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), w AS (SELECT doc_id, line, {WC.format('line')} AS n FROM b),
s AS (SELECT doc_id, count(*) AS blocks, CAST(sum(n) AS BIGINT) AS words, CAST(floor(coalesce(median(CASE WHEN n > 0 THEN n END), 0) + 0.5) AS BIGINT) AS median_words, sum(length(regexp_replace(line, '[^0-9]', '', 'g'))) AS digits, sum(length(line)) AS chars FROM w GROUP BY doc_id)
SELECT doc_id, blocks, words, median_words, CASE WHEN chars > 0 THEN CAST(floor(digits * 100 / chars + 0.5) AS BIGINT) ELSE 0 END AS digit_percent,
    CAST(CASE WHEN count(*) OVER (PARTITION BY source) > 1 THEN floor(idx * 100 / (count(*) OVER (PARTITION BY source) - 1) + 0.5) ELSE 0 END AS BIGINT) AS position_percent FROM s JOIN ch USING (doc_id)""")
def chapter_signals(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split("text", "\n")

    def median(counts: Column) -> Column:
        mid = lambda k: F.get(counts, k.cast("int"))
        n = F.size(counts)
        return F.when(n == 0, 0).when(n % 2 == 1, mid(F.floor(n / 2))).otherwise(F.floor((mid(F.floor(n / 2)) + mid(F.floor(n / 2) - 1)) / 2 + 0.5)).cast("long")

    counts = F.array_sort(F.filter(F.transform(lines, lambda x: F.size(words(x))), lambda n: n > 0))
    sums = F.transform(F.array(counts), lambda c: F.struct(F.aggregate(c, F.lit(0).cast("long"), lambda a, n: a + n).alias("words"), median(c).alias("median")))[0]
    rows = _chapters(spark, d, blocks=F.size(lines).cast("long"), sums=sums, digits=F.regexp_count("text", F.lit("[0-9]")), chars=F.length("text") - F.size(lines) + 1)
    total = F.count("*").over(W.partitionBy("source"))
    place = F.when(total > 1, half_up(F.col("idx") * 100 / F.nullif(total - 1, F.lit(0)))).otherwise(0)
    return rows.select("doc_id", "blocks", "sums.words", F.col("sums.median").alias("median_words"), digit_percent(F.col("digits"), F.col("chars")).alias("digit_percent"), place.cast("long").alias("position_percent"))


@query("""SELECT source, CAST(sum(n_chars) AS BIGINT) AS chars, CASE WHEN sum(n_chars) > 0 THEN greatest(1, CAST(floor(sum(n_chars) / 1800 + 0.5) AS BIGINT)) END AS pages,
    CAST(floor(greatest(1, floor(sum(n_chars) / 1800 + 0.5)) * 10 / 30 + 0.5) AS BIGINT) AS tenths_of_hours FROM documents GROUP BY source""")
def page_estimate(spark: SparkSession, d: str) -> DataFrame:
    sums = table(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("chars"))
    return sums.select("source", "chars", pages(F.col("chars")).alias("pages"), reading_hours(pages(F.col("chars"))).alias("tenths_of_hours"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) <= 160 THEN array_to_string(w, ' ') ELSE array_to_string(w[1:100], ' ') || ' … ' || array_to_string(w[len(w) // 2 + 1:len(w) // 2 + 60], ' ') END AS sample FROM w""")
def head_mid_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", words(F.col("text")).alias("w"))
    return rows.select("doc_id", sample_text(F.col("w")).alias("sample"))


LABELLED = rf"""{CH}, scored AS (SELECT doc_id, source, idx, {WC.format('text')} AS words, len(string_split(text, chr(10))) AS blocks,
    CASE WHEN toxic = 1 THEN 'NOTES' ELSE 'BODY' END AS purpose, CASE WHEN quality = 1 THEN 'high' ELSE 'low' END AS confidence,
    coalesce(quality, 0) = 0 OR coalesce(toxic, 0) = 0 AS own FROM ch LEFT JOIN labels USING (doc_id)),
guarded AS (SELECT *, coalesce(sum(words) FILTER (WHERE own) OVER (PARTITION BY source) / nullif(sum(words) OVER (PARTITION BY source), 0) < 0.4, true) AS distrusted FROM scored),
final AS (SELECT doc_id, source, idx, words, blocks, purpose, confidence, distrusted, own OR distrusted AS counted FROM guarded)"""


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Labels with defaults, the counting policy, and the guard that distrusts a whole book."""
    ch = _chapters(spark, d, words=n_words(), blocks=F.size(F.split("text", "\n")).cast("long")).join(table(spark, d, "labels"), "doc_id", "left")
    rows = ch.select("doc_id", "source", "idx", "words", "blocks", F.when(F.col("toxic") == 1, "NOTES").otherwise("BODY").alias("purpose"), F.when(F.col("quality") == 1, "high").otherwise("low").alias("confidence"))
    rows = rows.withColumn("own", counts_as_reading(F.col("purpose"), F.col("confidence")))
    book = W.partitionBy("source")
    ratio = F.sum(F.when(F.col("own"), F.col("words")).otherwise(0)).over(book) / F.nullif(F.sum("words").over(book), F.lit(0))
    rows = rows.withColumn("distrusted", F.coalesce(ratio < 0.4, F.lit(True)))
    return rows.withColumn("counted", F.col("own") | F.col("distrusted")).drop("own")


@query(f"WITH {LABELLED} SELECT doc_id, purpose, confidence, counted, distrusted FROM final")
def label_finalize(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).select("doc_id", "purpose", "confidence", "counted", "distrusted")


@query(f"WITH {LABELLED} SELECT source, CAST(sum(words) FILTER (WHERE counted) AS BIGINT) AS body_words, CAST(sum(words) AS BIGINT) AS all_words, count(*) FILTER (WHERE purpose = 'NOTES') AS notes FROM final GROUP BY source")
def body_words(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).groupBy("source").agg(F.sum(F.when(F.col("counted"), F.col("words"))).alias("body_words"), F.sum("words").alias("all_words"), F.count_if(F.col("purpose") == "NOTES").alias("notes"))


@query(f"WITH {CH} SELECT source, CAST(idx // 60 AS BIGINT) AS batch, count(*) AS chapters, min(doc_id) AS first_id, max(doc_id) AS last_id FROM ch GROUP BY ALL")
def digest_batches(spark: SparkSession, d: str) -> DataFrame:
    return _chapters(spark, d).groupBy("source", F.floor(F.col("idx") / 60).alias("batch")).agg(F.count("*").alias("chapters"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query(f"""WITH {LABELLED}, any_counted AS (SELECT *, counted OR NOT bool_or(counted) OVER (PARTITION BY source) AS c FROM final),
pos AS (SELECT doc_id, blocks // 2 AS at_block, coalesce(sum(CASE WHEN c THEN blocks ELSE 0 END) OVER (PARTITION BY source ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(CASE WHEN c THEN blocks ELSE 0 END) OVER (PARTITION BY source) AS total, c FROM any_counted)
SELECT doc_id, CAST(CASE WHEN total > 0 THEN least(100, greatest(0, floor((before + CASE WHEN c THEN at_block + 1 ELSE 0 END) * 100 / total + 0.5))) ELSE 0 END AS BIGINT) AS percent FROM pos""")
def progress_percent(spark: SparkSession, d: str) -> DataFrame:
    """Completion at the middle block of every chapter; uncounted chapters add nothing."""
    book = W.partitionBy("source")
    rows = _labelled(spark, d)
    rows = rows.withColumn("c", F.col("counted") | ~F.bool_or("counted").over(book))
    n = F.when(F.col("c"), F.col("blocks")).otherwise(0)
    before = F.coalesce(F.sum(n).over(book.orderBy("idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = before + F.when(F.col("c"), F.floor(F.col("blocks") / 2) + 1).otherwise(0)
    return rows.select("doc_id", percent(at, F.sum(n).over(book)).alias("percent"))


@query("""SELECT conv_id, turn, lag(turn) OVER w AS prev_turn, lead(turn) OVER w AS next_turn, CAST(count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS window_size FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def prev_next_window(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.lag("turn").over(w).alias("prev_turn"), F.lead("turn").over(w).alias("next_turn"), F.count("*").over(w.rowsBetween(-1, 1)).alias("window_size"))


@query("""WITH m AS (SELECT conv_id, turn, text, turn % 3 = 0 AS bold, CASE WHEN (turn % 3 = 0) = lag(turn % 3 = 0) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS fresh FROM conversations),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM m)
SELECT conv_id, CAST(run AS BIGINT) AS run, bold, string_agg(text, '' ORDER BY turn) AS text, count(*) AS parts FROM r GROUP BY ALL""")
def run_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring runs of one style become one."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", (F.col("turn") % 3 == 0).alias("bold"))
    fresh = F.when(F.col("bold") == F.lag("bold").over(w), 0).otherwise(1)
    rows = rows.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "")
    return rows.groupBy("conv_id", "run", "bold").agg(joined.alias("text"), F.count("*").alias("parts"))


@query("""WITH s AS (SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS seg FROM conversations)
SELECT conv_id, turn, CAST(seg AS BIGINT) AS segment, conv_id || '-' || seg || '::b' || row_number() OVER (PARTITION BY conv_id, seg ORDER BY turn) AS block_id FROM s""")
def anchor_split(spark: SparkSession, d: str) -> DataFrame:
    """Segments start at anchors (user turns); blocks are numbered anew in each."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(W.partitionBy("conv_id").orderBy("turn")).alias("segment"))
    n = F.row_number().over(W.partitionBy("conv_id", "segment").orderBy("turn"))
    return rows.select("conv_id", "turn", "segment", F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("segment").cast("string"), F.lit("::b"), n.cast("string")).alias("block_id"))


@query(rf"""WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
t AS (SELECT doc_id, arg_min(trim(line), pos) FILTER (WHERE {WC.format('line')} BETWEEN 1 AND 8) AS title, min(pos) FILTER (WHERE {WC.format('line')} BETWEEN 1 AND 8) AS at_pos, max(pos) FILTER (WHERE trim(line) <> '') AS last_pos FROM b GROUP BY doc_id)
SELECT doc_id, CASE WHEN last_pos > at_pos THEN title END AS title FROM t""")
def chapter_title_extract(spark: SparkSession, d: str) -> DataFrame:
    """The first short line is the title if more content follows."""
    lines = F.transform(F.split("text", "\n"), lambda line, pos: F.struct(pos.alias("pos"), F.trim(line).alias("title"), F.size(words(line)).alias("n")))
    rows = table(spark, d, "documents").select("doc_id", lines.alias("lines"))
    title, last = F.get(F.filter("lines", lambda x: x["n"].between(1, 8)), 0), F.try_element_at(F.filter("lines", lambda x: x["title"] != ""), F.lit(-1))
    return rows.select("doc_id", F.when(last["pos"] > title["pos"], title["title"]).alias("title"))


@query(rf"""WITH {CH}, c AS (SELECT doc_id, idx, CASE doc_id % 5 WHEN 0 THEN 'Chapter ' || (idx + 1) WHEN 1 THEN 'part_' || idx WHEN 2 THEN '12.3' WHEN 3 THEN split_part(text, chr(10), 1) ELSE NULL END AS title, CASE doc_id % 3 WHEN 0 THEN 'split-07.xhtml' WHEN 1 THEN ' Notes ' ELSE 'Chapter 3' END AS label FROM ch),
n AS (SELECT doc_id, unnest([title, label]) AS t, unnest([0, 1]) AS o, idx FROM c),
k AS (SELECT doc_id, o, trim(t) AS t FROM n WHERE t IS NOT NULL AND trim(t) <> '' AND lower(trim(t)) <> 'chapter ' || (idx + 1) AND NOT regexp_matches(lower(trim(t)), '{FILE_TITLE}') AND NOT regexp_matches(lower(trim(t)), '{MACHINE_TITLE}') AND NOT regexp_matches(trim(t), '{NUMBER_TITLE}'))
SELECT c.doc_id, coalesce(arg_min(CASE WHEN length(t) > 80 THEN rtrim(left(t, 80)) || '…' ELSE t END, o), '(untitled)') AS title FROM c LEFT JOIN k ON k.doc_id = c.doc_id GROUP BY c.doc_id""")
def title_normalize(spark: SparkSession, d: str) -> DataFrame:
    """First lines are cut to titles before the window."""
    k = F.col("doc_id") % 5
    m = F.col("doc_id") % 3
    label = F.when(m == 0, "split-07.xhtml").when(m == 1, " Notes ").otherwise("Chapter 3")
    rows = _chapters(spark, d, first=said_title(F.substring_index("text", "\n", 1)), label=said_title(label))
    numbered = F.when(k == 0, F.concat(F.lit("Chapter "), (F.col("idx") + 1).cast("string"))).when(k == 1, F.concat(F.lit("part_"), F.col("idx").cast("string"))).when(k == 2, "12.3")
    return rows.select("doc_id", normalise_title(F.when(k == 3, F.col("first")).otherwise(said_title(numbered)), F.col("label"), F.col("idx")).alias("title"))


@query(r"""WITH s AS (SELECT doc_id, lang, trim(regexp_replace('"' || text || ' "', '\s+', ' ', 'g')) AS c FROM documents)
SELECT doc_id, sha256('explain|' || trim(substr(c, 2, length(c) - 2)) || '|' || CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END || '|small') AS source_hash FROM s""")
def selection_hash(spark: SparkSession, d: str) -> DataFrame:
    quoted = F.concat(F.lit('"'), "text", F.lit(' "'))
    return table(spark, d, "documents").select("doc_id", source_hash(F.lit("explain"), quoted, F.when(F.col("doc_id") % 4 != 0, F.col("lang")), F.lit("small")).alias("source_hash"))


@query("SELECT sha256(text) AS checksum, count(*) AS copies, min(doc_id) AS first_id, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY text")
def checksum_index(spark: SparkSession, d: str) -> DataFrame:
    data = F.col("text").cast("binary")
    return table(spark, d, "documents").groupBy(F.sha2(data, 256).alias("checksum")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


@query(f"""WITH {CH} SELECT doc_id, source, lang, n_chars < 500 AS short, CAST(row_number() OVER (PARTITION BY lang ORDER BY (n_chars < 500), idx DESC, doc_id DESC) AS INTEGER) AS place FROM ch
WHERE (contains(lower(text), 'license') OR contains(lower(source), 'license')) AND lang IN ('en', 'de')""")
def search_filter_sort(spark: SparkSession, d: str) -> DataFrame:
    """Entries of two colours (languages) that hold the search words in one of two columns, in the panel's order."""
    hit = contains_ci(F.col("text"), " License ") | contains_ci(F.col("source"), " License ")
    found = _chapters(spark, d, hit=hit).where(F.col("hit") & F.col("lang").isin("en", "de"))
    short = found.select("doc_id", "source", "lang", (F.col("n_chars") < 500).alias("short"), "idx")
    return numbered(short, ["lang"], [F.asc("short"), F.desc("idx"), F.desc("doc_id")], "place").drop("idx")


@query("SELECT u.source, k.lang, count(d.doc_id) AS n FROM (SELECT DISTINCT source FROM documents) u CROSS JOIN (VALUES ('en'), ('fr'), ('de'), ('es'), ('uk')) k(lang) LEFT JOIN documents d ON d.source = u.source AND d.lang = k.lang GROUP BY ALL")
def language_counts(spark: SparkSession, d: str) -> DataFrame:
    return counts_of_domain(table(spark, d, "documents").select("source", "lang"), ["source"], "lang", ["en", "fr", "de", "es", "uk"])


@query("""WITH b AS (SELECT doc_id, length(line) + length(regexp_replace(line, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS n, pos FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS cum, sum(n) OVER (PARTITION BY doc_id) AS total FROM b), w AS (SELECT *, least(doc_id % 997, greatest(total - 1, 0)) AS off FROM c)
SELECT doc_id, CAST(coalesce(min(pos) FILTER (WHERE cum > off) - 1, 0) AS BIGINT) AS segment, CAST(coalesce(min(off) - arg_min(cum - n, pos) FILTER (WHERE cum > off), 0) AS BIGINT) AS in_segment FROM w GROUP BY doc_id""")
def offset_locate(spark: SparkSession, d: str) -> DataFrame:
    """The line that holds a text offset, and the offset in it; in one pass over the lines. Offsets count UTF-16 units."""
    lengths = F.transform(F.split("text", "\n"), utf16_length)
    rows = table(spark, d, "documents").select("doc_id", lengths.alias("lengths"))
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)
    rows = rows.withColumn("off", F.least(F.col("doc_id") % 997, F.greatest(total - 1, F.lit(0))))
    step = lambda at, n: F.when(at["found"] | (at["start"] + n > F.col("off")), F.struct(at["segment"], at["start"], F.lit(True).alias("found"))).otherwise(F.struct((at["segment"] + 1).alias("segment"), (at["start"] + n).alias("start"), F.lit(False).alias("found")))
    start = F.struct(F.lit(0).cast("long").alias("segment"), F.lit(0).cast("long").alias("start"), F.lit(False).alias("found"))
    at = rows.select("doc_id", "off", F.aggregate("lengths", start, step).alias("at"))
    here = lambda c: F.when(F.col("at.found"), c).otherwise(0).cast("long")
    return at.select("doc_id", here(F.col("at.segment")).alias("segment"), here(F.col("off") - F.col("at.start")).alias("in_segment"))


@query(f"""WITH {CH} SELECT a.doc_id, count(*) AS cached, min(b.idx) AS lo, max(b.idx) AS hi, string_agg('Chapter ' || (b.idx + 1), ', ' ORDER BY b.idx) AS labels FROM ch a JOIN ch b ON a.source = b.source AND b.idx BETWEEN a.idx - 1 AND a.idx + 1 GROUP BY a.doc_id""")
def reader_window(spark: SparkSession, d: str) -> DataFrame:
    """The chapter and its neighbours, fewer at the ends."""
    w = W.partitionBy("source").orderBy("doc_id").rowsBetween(-1, 1)
    return _chapters(spark, d).select("doc_id", F.count("*").over(w).alias("cached"), F.min("idx").over(w).cast("long").alias("lo"), F.max("idx").over(w).cast("long").alias("hi"), F.array_join(F.collect_list(F.concat(F.lit("Chapter "), (F.col("idx") + 1).cast("string"))).over(w), ", ").alias("labels"))


@query(rf"""SELECT doc_id, len(list_filter(string_split_regex(text, '\n\s*\n'), lambda p: trim(p, ' ' || chr(10) || chr(9)) <> '')) AS paragraphs, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 30) AS before, right(trim(regexp_replace(text, '\s+', ' ', 'g')), 30) AS after FROM documents""")
def paragraph_context(spark: SparkSession, d: str) -> DataFrame:
    text = collapse(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(paragraphs(F.col("text"))).cast("long").alias("paragraphs"), F.left(text, F.lit(30)).alias("before"), F.right(text, F.lit(30)).alias("after"))


@query(r"""WITH saved AS (SELECT doc_id AS comment_id, source, lang, trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g')) AS sel, n_chars % 3 AS tool FROM documents)
SELECT d.doc_id, tool, arg_min(comment_id, comment_id) AS comment_id FROM documents d JOIN saved s ON d.source = s.source AND d.lang = s.lang AND trim(regexp_replace(split_part(d.text, chr(10), 1), '\s+', ' ', 'g')) = s.sel AND d.n_chars % 3 = s.tool GROUP BY ALL""")
def saved_comment_match(spark: SparkSession, d: str) -> DataFrame:
    """Selections meet saved comments by four columns; the first of each tool wins."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", normalise_selection(F.substring_index("text", "\n", 1)).alias("sel"), (F.col("n_chars") % 3).alias("tool"))
    saved = docs.groupBy("source", "lang", "sel", "tool").agg(F.min("doc_id").alias("comment_id"))
    return docs.join(saved, ["source", "lang", "sel", "tool"]).select("doc_id", "tool", "comment_id")


@query(f"WITH {CH} SELECT ch.doc_id, ch.idx // 60 AS batch, quality, toxic FROM ch JOIN labels USING (doc_id) WHERE ch.idx // 60 IN (SELECT idx // 60 FROM ch c2 JOIN labels l2 USING (doc_id) WHERE c2.source = ch.source AND l2.toxic = 1)")
def label_batches(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the batches of 60 chapters that were asked for: those that hold a toxic chapter."""
    ch = _chapters(spark, d).select("doc_id", "source", F.floor(F.col("idx") / 60).alias("batch"))
    told = ch.join(table(spark, d, "labels"), "doc_id")
    asked = told.where("toxic = 1").select("source", "batch")
    return told.join(asked, ["source", "batch"], "left_semi").select("doc_id", "batch", "quality", "toxic")


@query(f"""WITH {LABELLED} SELECT source, CAST(sum(blocks) AS BIGINT) AS total_blocks, CAST(sum(CASE WHEN counted THEN blocks ELSE 0 END) AS BIGINT) AS body_blocks, string_agg(doc_id || ':' || blocks || CASE WHEN counted THEN '' ELSE '!' END, ' ' ORDER BY idx) AS chapters FROM final GROUP BY source""")
def progress_index(spark: SparkSession, d: str) -> DataFrame:
    """The index of a book: its chapters in order with their blocks and whether they count, and the totals."""
    rows = _labelled(spark, d).select("source", "idx", "blocks", "counted", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("blocks").cast("string"), F.when(F.col("counted"), "").otherwise("!")).alias("chapter"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("idx", "chapter"))), lambda c: c["chapter"])
    return rows.groupBy("source").agg(F.sum("blocks").alias("total_blocks"), F.sum(F.when(F.col("counted"), F.col("blocks")).otherwise(0)).alias("body_blocks"), F.array_join(ordered, " ").alias("chapters"))


@query("""WITH p AS (SELECT doc_id AS id, source, lang, n_chars FROM documents), m AS (SELECT doc_id AS id FROM labels WHERE quality = 1)
SELECT id, source, lang, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, id DESC) AS INTEGER) AS place FROM p WHERE id NOT IN (SELECT id FROM m) UNION ALL SELECT id, 'memory', NULL, 0 FROM m""")
def pending_not_in_memory(spark: SparkSession, d: str) -> DataFrame:
    """What was loaded as pending, newest first, without what memory holds already; then memory itself."""
    memory = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    loaded = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "lang", "n_chars").join(memory, "id", "left_anti")
    place = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), F.desc("id")))
    return loaded.select("id", "source", "lang", place.alias("place")).unionByName(memory.select("id", F.lit("memory").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(0).alias("place")))


@query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), r AS (SELECT doc_id, t, length(t) // 3 AS a, least(length(t), length(t) // 3 + doc_id % 50) AS b FROM t)
SELECT doc_id, substr(t, greatest(0, a - 30) + 1, a - greatest(0, a - 30)) AS before, substr(t, b + 1, 30) AS after FROM r""")
def selection_contexts(spark: SparkSession, d: str) -> DataFrame:
    """What stands before and after a selected range."""
    rows = table(spark, d, "documents").select("doc_id", collapse(F.col("text")).alias("t"))
    a = F.floor(F.length("t") / 3).cast("int")
    rows = rows.select("doc_id", selection_context(F.col("t"), a, F.least(F.length("t"), (a + F.col("doc_id") % 50).cast("int"))).alias("c"))
    return rows.select("doc_id", "c.before", "c.after")
