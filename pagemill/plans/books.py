"""Books as archives: volumes of documents are packed to e-book files, and read back by the data source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.sources.archives import write_epubs
from pagemill.sources.epub import read_epubs
from pagemill.sources.kept import shared_folder
from pagemill.sources.tables import table

QUERIES, SQL = {}, {}
#: A volume of a source holds the documents of so many ids.
VOLUME = 1000


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(rf"""WITH lines AS (
    SELECT doc_id, coalesce(source, '') || ' ' || CAST(floor(doc_id / {VOLUME}) AS BIGINT) AS title, lang, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: trim(regexp_replace(l, '[ \t\r\f]+', ' ', 'g'))), lambda l: l <> '') AS kept FROM documents
)
SELECT title, first_value(lang) OVER (PARTITION BY title ORDER BY doc_id) AS language, CAST(row_number() OVER (PARTITION BY title ORDER BY doc_id) - 1 AS INTEGER) AS chapter_index, 'Document ' || doc_id AS label, len(kept) AS n_blocks, sha256(array_to_string(kept, chr(10))) AS text_sha256
FROM lines WHERE len(kept) > 0""")
def epub_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """One archive for each source and thousand of ids, written and read back. Documents without
    any text give no chapter; a line is a paragraph, in which blanks collapse."""
    docs = table(spark, d, "documents").where(F.coalesce("text", F.lit("")).rlike(r"\S"))
    title = F.concat(F.coalesce("source", F.lit("")), F.lit(" "), F.floor(F.col("doc_id") / VOLUME).cast("string"))
    folder = shared_folder(spark, "volumes")
    write_epubs(docs.select(title.alias("book"), title.alias("title"), F.col("lang").alias("language"), F.col("doc_id").alias("position"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("label"), "text"), folder)
    blocks = read_epubs(spark, folder)
    texts = F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda b: b["text"])
    read = blocks.groupBy("title", "language", "chapter_index", "label").agg(F.count("*").alias("n_blocks"), F.sha2(F.array_join(texts, "\n").cast("binary"), 256).alias("text_sha256"))
    return read.select("title", "language", "chapter_index", "label", "n_blocks", "text_sha256")
