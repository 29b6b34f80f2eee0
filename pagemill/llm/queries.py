"""The registered queries of the training-data operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .fill_in_middle import fill_in_middle, restored
from .fingerprints import fingerprints
from .licenses import APART, PHRASES, SHARE, STRETCH, TEMPLATES, license_scan
from .line_dedup import drop_repeated_lines
from .mixing import mix, text_topic, word_count
from .near_dups import near_duplicates
from .neighbour_graph import nearest_neighbours
from .quality import quality_scores
from .quotes import link_quotes
from .sentencepiece_bpe import encode_decode
from .top_k import exact_top_k
from .vector_codes import vector_codes
from .warc import archive_pages, read_archives


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without an id keep their rows, with a null page_id."""
    manifest, folder = archive_pages(table(spark, sf_dir, "pages"))
    back = read_archives(manifest, folder, payloads=False)
    number = lambda c: F.nullif(F.col(c), F.lit("")).cast("long").alias(c)
    return back.select(number("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"))


OP1_SQL = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
    SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, repeated and null ids included; a null or empty text is one empty line."""
    out = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
    SELECT doc_id, t.line, t.pos FROM documents,
        LATERAL (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos) t
), keyed AS (
    SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), firsts AS (
    SELECT key, min(doc_id) AS first_id FROM keyed WHERE length(key) >= 10 GROUP BY key
), told AS (
    SELECT k.doc_id, k.line, k.pos, coalesce(f.first_id < k.doc_id, false) AS gone FROM keyed k LEFT JOIN firsts f ON k.key = f.key AND length(k.key) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id
"""


def op3_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each doc_id. A null or empty text has no shingles and is linked with nothing."""
    out = near_duplicates(table(spark, sf_dir, "documents"), words=3, share=(85, 100))
    return out.withColumnRenamed("id", "doc_id")


def op4_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each message, repeated and null keys included; a null text counts as empty."""
    out = link_quotes(table(spark, sf_dir, "conversations"))
    return out.select("row.conv_id", "row.turn", "row.role", "n_quoted", "n_linked", "parent_turn", "thread_turn", "depth", "position", F.sha2(F.col("own_text").cast("binary"), 256).alias("own_sha256"))


OP4_SQL = r"""
WITH RECURSIVE lines AS (
    SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM conversations
), levels AS (
    SELECT *, len(regexp_extract(line, '^[> \t]*')) - len(replace(regexp_extract(line, '^[> \t]*'), '>', '')) AS level FROM lines
), parsed AS (
    SELECT conv_id, turn, pos, level, CASE WHEN level > 0 THEN regexp_replace(line, '^[> \t]*', '') ELSE line END AS content FROM levels
), marked AS (
    SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY conv_id, turn ORDER BY pos) THEN 0 ELSE 1 END AS fresh FROM parsed
), numbered AS (
    SELECT *, sum(fresh) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS run FROM marked
), runs AS (
    SELECT conv_id, turn, level, run, string_agg(content, chr(10) ORDER BY pos) AS content FROM numbered GROUP BY ALL
), units AS (
    SELECT DISTINCT conv_id, turn, level, trim(regexp_replace(lower(content), '[ \t\n\v\f\r]+', ' ', 'g')) AS t
    FROM (SELECT conv_id, turn, level, content FROM runs UNION ALL SELECT conv_id, turn, level, content FROM parsed)
), originals AS (
    SELECT conv_id, t, min(turn) AS original FROM units WHERE level = 0 AND len(t) >= 10 GROUP BY ALL
), links AS (
    SELECT q.conv_id, q.turn, q.level, len(q.t) AS size, o.original FROM units q JOIN originals o ON q.conv_id = o.conv_id AND q.t = o.t AND o.original < q.turn WHERE q.level > 0 AND len(q.t) >= 10
), parents AS (
    SELECT conv_id, turn, count(DISTINCT original) AS n_linked, arg_max(original, (-level, size, original)) AS parent_turn FROM links GROUP BY ALL
), up AS (
    SELECT conv_id, turn, parent_turn AS root, CAST(1 AS BIGINT) AS depth FROM parents
    UNION ALL SELECT up.conv_id, up.turn, p.parent_turn, up.depth + 1 FROM up JOIN parents p ON up.conv_id = p.conv_id AND up.root = p.turn
), threads AS (
    SELECT conv_id, turn, arg_max(root, depth) AS root, max(depth) AS depth FROM up GROUP BY ALL
), own AS (
    SELECT conv_id, turn, trim(coalesce(string_agg(content, chr(10) ORDER BY pos) FILTER (WHERE level = 0), ''), ' ' || chr(9) || chr(10) || chr(13)) AS own_text,
        count(DISTINCT run) FILTER (WHERE level > 0) AS n_quoted FROM numbered GROUP BY ALL
)
SELECT c.conv_id, c.turn, c.role, n_quoted, coalesce(n_linked, 0) AS n_linked, parent_turn, coalesce(root, c.turn) AS thread_turn, coalesce(depth, 0) AS depth,
    row_number() OVER (PARTITION BY c.conv_id ORDER BY coalesce(root, c.turn), c.turn) - 1 AS position, sha256(own_text) AS own_sha256
FROM conversations c JOIN own USING (conv_id, turn) LEFT JOIN parents USING (conv_id, turn) LEFT JOIN threads USING (conv_id, turn)
"""


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, repeated and null ids included; a null text counts as empty."""
    out = encode_decode(table(spark, sf_dir, "documents"), piece_model_path())
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, repeated and null ids included; a null text counts as empty and has no words."""
    texts, spans = license_scan(table(spark, sf_dir, "documents"))
    found = spans.groupBy("id", "version").agg(
        F.count_if("exact").alias("n_base"),
        F.min(F.when(F.col("exact"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    joined = texts.join(found.withColumnsRenamed({"id": "found_id", "version": "found_version"}), F.col("id").eqNullSafe(F.col("found_id")) & (F.col("version") == F.col("found_version")), "left")
    none = F.lit("")
    return joined.select(
        F.col("id").alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"),
    )


def _op6_sql() -> str:
    told = ", ".join(f"('{label}', {exact}, '{text}')" for texts, exact in ((PHRASES, True), (TEMPLATES, False)) for text, label in texts)
    return f"""
WITH named(label, exact, text) AS (VALUES {told}
), pairs AS (
    SELECT label, exact, len(string_split(text, ' ')) - 1 AS pairs, unnest(range(0, len(string_split(text, ' ')) - 1)) AS p, string_split(text, ' ') AS tw FROM named
), tp AS (
    SELECT label, exact, pairs, p, tw[p + 1] AS a, tw[p + 2] AS b FROM pairs
), docs AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), rolling AS (
    SELECT doc_id, i, w[i + 1] AS a, w[i + 2] AS b FROM (SELECT doc_id, w, unnest(range(0, len(w) - 1)) AS i FROM docs WHERE len(w) > 1)
), votes AS MATERIALIZED (
    SELECT doc_id, label, exact, pairs, i - p AS d, list(DISTINCT p) AS ps, min(i) AS lo, max(i) AS hi FROM rolling JOIN tp USING (a, b) GROUP BY ALL
), marked AS (
    SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY doc_id, label ORDER BY d) <= {APART} THEN 0 ELSE 1 END AS fresh FROM votes WHERE NOT exact
), islands AS (
    SELECT *, sum(fresh) OVER (PARTITION BY doc_id, label ORDER BY d) AS island FROM marked
), spans AS (
    SELECT doc_id, label, pairs, len(list_distinct(flatten(list(ps)))) AS held, min(lo) AS first, max(hi) + 1 AS last FROM islands GROUP BY doc_id, label, pairs, island
), found AS (
    SELECT doc_id, label, exact, d AS first, 1.0::DOUBLE AS share FROM votes WHERE exact AND len(ps) = pairs
    UNION ALL
    SELECT doc_id, label, false, first, held::DOUBLE / pairs FROM spans WHERE held::DOUBLE / pairs >= {SHARE} AND last - first + 1 <= {STRETCH} * (pairs + 1)
), grouped AS (
    SELECT doc_id, count(*) FILTER (WHERE exact) AS n_base, min(first) FILTER (WHERE exact) AS first_word, max(first) FILTER (WHERE exact) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
    FROM found GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 9) AS score
FROM docs LEFT JOIN grouped USING (doc_id)"""


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, repeated and null ids included; a null text counts as empty."""
    out = fingerprints(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, repeated and null ids included; null and empty texts are scored like others."""
    out = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumnRenamed("id", "doc_id")


#: Exponents that temper the present shares of sources, languages and topics to their targets.
MIX = {"source": 0.7, "lang": 0.7, "topic": 0.8}
MIX_ROUNDS = 20
#: No cell is raised to more than twice its tokens, so that half of all tokens stay.
MIX_MOST = 2.0


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, repeated and null ids included; null sources and languages are the empty one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    # What the mix needs of each text is computed once.
    docs = written(docs.select("doc_id", "source", "lang", text_topic("text").alias("topic"), word_count("text").alias("words")), "counted")
    out = mix(docs, {n: (F.col(n), target) for n, target in MIX.items()}, F.col("words"), rounds=MIX_ROUNDS, most=MIX_MOST)
    return out.select("row.doc_id", "tokens", F.round("probability", 9).alias("probability"), "kept")


def _op9_sql() -> str:
    steps = [
        """docs AS MATERIALIZED (
    SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens,
        CASE WHEN contains(lower(coalesce(text, '')), 'license') THEN 'legal' WHEN length(coalesce(text, '')) < 1000 THEN 'brief' ELSE 'prose' END AS topic FROM documents
)""",
        "cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM docs GROUP BY ALL HAVING sum(tokens) > 0)",
    ]
    for n, power in MIX.items():
        steps.append(f"aim_{n} AS MATERIALIZED (SELECT {n}, pow(sum(tokens), {power}) / sum(pow(sum(tokens), {power})) OVER () * sum(sum(tokens)) OVER () AS aim_{n} FROM cells GROUP BY {n})")
    steps.append("w0 AS MATERIALIZED (SELECT *, tokens AS w FROM cells JOIN aim_source USING (source) JOIN aim_lang USING (lang) JOIN aim_topic USING (topic))")
    for k in range(MIX_ROUNDS * len(MIX)):
        n = list(MIX)[k % len(MIX)]
        steps.append(f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (least(w * aim_{n} / sum(w) OVER (PARTITION BY {n}), {MIX_MOST} * tokens) AS w) FROM w{k})")
    last = f"w{MIX_ROUNDS * len(MIX)}"
    steps.append(f"p AS (SELECT source, lang, topic, w / tokens / max(w / tokens) OVER () AS probability FROM {last})")
    return "WITH " + ",\n".join(steps) + """
SELECT doc_id, tokens, round(coalesce(probability, 0), 9) AS probability,
    CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / pow(2, 52) < coalesce(probability, 0) AS kept
FROM docs LEFT JOIN p USING (source, lang, topic)"""


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 5 rows a query; unusable vectors and null ids take no part."""
    return exact_top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, k=5)


OP10_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 20 rows a query. Approximate: tests hold its recall against full scans."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each usable vector, repeated ids included."""
    out = vector_codes(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def _op12_sql() -> str:
    near = lambda k: f"""near{k} AS MATERIALIZED (
    SELECT vec_id, p, x, min(CAST(list_inner_product(x, x) - 2 * list_inner_product(x, y) + list_inner_product(y, y) AS BIGINT) * 256 + e) AS m FROM parts JOIN book{k} USING (p) GROUP BY ALL
)"""  # noqa: E731
    steps = [
        """kept AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        "parts AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x FROM kept, range(4) t(p))",
        "book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS y FROM parts QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 256)",
    ]
    for k in range(4):
        steps.append(near(k))
        steps.append(f"sums{k} AS (SELECT p, m % 256 AS e, pos, floor(sum(c) / count(*)) AS c FROM (SELECT p, m, unnest(x) AS c, generate_subscripts(x, 1) AS pos FROM near{k}) GROUP BY ALL)")
        steps.append(f"new{k} AS (SELECT p, e, list(c ORDER BY pos) AS z FROM sums{k} GROUP BY ALL)")
        steps.append(f"book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(z, y) AS y FROM book{k} LEFT JOIN new{k} USING (p, e))")
    steps.append(near(4))
    steps.append("coded AS (SELECT vec_id, string_agg(printf('%02x', m % 256), '' ORDER BY p) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM near4 GROUP BY vec_id)")
    steps.append("told AS (SELECT sha256(string_agg(array_to_string(list_transform(y, lambda c: CAST(c AS BIGINT)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book4)")
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), told"""


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, repeated and null ids included."""
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
    SELECT *, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substring(h, i, 8) AS BIGINT)) AS g FROM d
), placed AS (
    SELECT *, least(g[1] % (n + 1), g[2] % (n + 1)) AS a, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR g[3] % 100 >= 90 THEN 'plain' WHEN g[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), cut AS (
    SELECT *, left(t, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM placed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM cut
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_line_dedup": op2_line_dedup,
        "op3_near_dups": op3_near_dups,
        "op4_quotes": op4_quotes,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_licenses": op6_licenses,
        "op7_fingerprints": op7_fingerprints,
        "op8_quality": op8_quality,
        "op9_mixing": op9_mixing,
        "op10_top_k": op10_top_k,
        "op11_neighbours": op11_neighbours,
        "op12_vector_codes": op12_vector_codes,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": OP1_SQL,
        "op2_line_dedup": OP2_SQL,
        "op4_quotes": OP4_SQL,
        "op6_licenses": _op6_sql(),
        "op9_mixing": _op9_sql(),
        "op10_top_k": OP10_SQL,
        "op12_vector_codes": _op12_sql(),
        "op13_fill_in_middle": OP13_SQL,
    }
