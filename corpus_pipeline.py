"""The corpus pipeline: from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns the rows for the next one; all but the last return the columns of
documents, extra ones included. Null and empty texts pass every stage that
does not judge them; a null doc_id is never grouped with another one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import scratch, table, utf8, written
from pagemill.llm.line_dedup import drop_repeated_lines
from pagemill.llm.mixing import mix, text_topic, word_count
from pagemill.llm.near_dups import near_duplicates
from pagemill.llm.quality import fit, held_out, with_statistics
from pagemill.llm.queries import piece_model_path
from pagemill.llm.sentencepiece_bpe import encode_decode

#: A document goes if its quality score is lower.
QUALITY_THRESHOLD = 0.5
#: Exponents that temper the present shares to the targets of the mix. Documents are
#: never repeated, so the farther the targets, the fewer documents can stay. Topics keep their
#: shares: a rare one can't be raised by more than MOST.
TARGETS = {"source": 0.85, "lang": 0.9, "topic": 1.0}
#: No cell is raised to more than this many times its tokens: four fifths of all tokens stay.
MOST = 1.25


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents and drops those the classifier rejects.
    Where there is nothing to learn from, all documents stay. The rows are written
    with their statistics, so that these are computed once."""
    rows = written(with_statistics(docs), "statistics")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    known = rows.select(F.col("row.doc_id").alias("id"), "x").where(~held_out(F.col("id")))
    model = fit(known.join(labels, "id"))
    return rows.where(model.column(F.col("x")) >= QUALITY_THRESHOLD).select("row.*") if model.classes else docs


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that an earlier document holds; n_chars follows the text. A document
    that has nothing but blanks left by that (a copy of others) goes."""
    out = drop_repeated_lines(docs)
    out = out.where((F.col("n_dropped") == 0) | (F.btrim("text", F.lit(" \t\n\x0b\f\r")) != ""))
    made = {"text": F.col("text"), "n_chars": F.length("text").cast("long").alias("n_chars")}
    return out.select(*[made[c] if c in made else F.col(f"row.`{c}`") for c in docs.columns])


def _row_key(docs: DataFrame) -> Column:
    """A key for each doc_id and text, in the order of the doc_ids. A null text counts as empty."""
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        flipped = F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(2**63)))
        at = F.unhex(F.lpad(F.hex(flipped), 16, "0"))
    else:
        at = F.concat(F.col("doc_id").cast("string"), F.lit("\0")).cast("binary")
    return F.concat(at, F.unhex(F.md5(utf8("text"))))


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the
    smallest doc_id stays, once. Each row is judged by its own text: unlike texts
    that share a doc_id all stay, rows that repeat both are one."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.where(F.col("doc_id").isNotNull()).select(_row_key(docs).alias("key"), F.col("text"), row)
    kept = near_duplicates(keyed, "key").where("kept").select(F.col("id").alias("key"))
    single = keyed.select("key", "row").dropDuplicates(["key"]).join(kept, "key", "left_semi")
    return single.select("row.*").union(docs.where(F.col("doc_id").isNull()))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents towards the target shares of sources, languages and topics."""
    columns = {"source": F.col("source"), "lang": F.col("lang"), "topic": text_topic("text")}
    out = mix(docs, {n: (columns[n], TARGETS[n]) for n in TARGETS}, word_count("text"), most=MOST)
    return out.where("kept").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids (little-endian unsigned 32-bit integers), n_tokens and the
    SHA-256 of the text that they decode to."""
    out = encode_decode(docs, piece_model_path())
    return out.select("doc_id", "token_ids", "n_tokens", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dups", near_dups), ("mixing", mixing), ("tokens", tokens)]

#: Hash sketches, a fitted classifier and a tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as keep:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
            keep(docs)
    return docs
