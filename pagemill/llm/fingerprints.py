"""Document fingerprints: invertible Bloom lookup sketches, with DataFrame functions only.

A text's distinct paragraphs (lines; long ones are cut after words that their
hashes choose, so that an edit moves no other cut) are hashed, and every digest is
added to one cell in each of three tables. A cell holds a count, the exclusive or of its
digests and that of their checksums. Subtracting the cells of two versions
cancels what they share; peeling then takes digests out of cells that hold
just one, until none is left, and so recovers the paragraphs that differ. A
sketch that is too small for a difference fails and is retried larger: the
digests are dealt to segments that each have a sketch, more with each retry.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch, written

#: Cells in each of the three tables of a fingerprint, and of a segment in retries; digests a segment gets in the first retry.
FINGERPRINT_WIDTH, SEGMENT_WIDTH, SEGMENT_DIGESTS = 8, 16, 6
#: Segments that a failed segment is dealt to.
SPLIT = 4
#: Passes over the cells; every pass takes out all digests that stand alone.
PASSES = 8
#: Segments that one task peels.
TASK_SEGMENTS = 8000
#: A line of more than the first number of code points is cut after one word in SHORT_CUT or, if it is longer than the second, in LONG_CUT.
LONG, ENDLESS = 80, 600
SHORT_CUT, LONG_CUT = 16, 256
#: What is then still longer than ENDLESS (few words that come again and again, scripts that don't part words) is cut after
#: each punctuation mark beyond ASCII, and after so many other characters.
WINDOW = 240
WINDOW_CUT = rf"([\p{{P}}&&[^\p{{ASCII}}]]|[\p{{ASCII}}\P{{P}}]{{{WINDOW}}})"


def paragraphs(text: Column) -> Column:
    """The lines of a text, long ones cut after the words whose hash says so: in any script, and
    wherever a word stands, so that an edit moves no cut but its own. The cut is a line end,
    which no line holds, so that one split parts both; a piece keeps the blank that it begins with."""

    def cut(line: Column) -> Column:
        every = F.when(F.length(line) > ENDLESS, F.lit(LONG_CUT)).otherwise(F.lit(SHORT_CUT))
        words = F.transform(F.split(line, " "), lambda w: F.when(F.pmod(F.xxhash64(w), every) == 0, F.concat(w, F.lit("\n"))).otherwise(w))
        return F.when(F.length(line) > LONG, F.array_join(words, " ")).otherwise(line)

    windows = lambda part: F.when(F.length(part) > ENDLESS, F.split(F.regexp_replace(part, WINDOW_CUT, "$1\n"), "\n")).otherwise(F.array(part))
    return F.flatten(F.transform(F.split(F.array_join(F.transform(F.split(text, "\n"), cut), "\n"), "\n"), windows))


def paragraph_digests(text: Column) -> Column:
    """The distinct 64-bit digests of the paragraphs of a text; the empty text is one empty paragraph."""
    return F.array_distinct(F.transform(paragraphs(text), lambda p: F.xxhash64(p)))


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _item(x: Column, width: int, level: int, sign: Column, check: Column) -> Column:
    """A digest with the cells it belongs to."""
    at = lambda h, t: (t * width + F.pmod(F.shiftright(h, 20 * t), F.lit(width))).cast("int")
    return _let(F.xxhash64(x, F.lit(level)), lambda h: F.struct(x.alias("x"), sign.cast("int").alias("n"), check.alias("c"), at(h, 0).alias("i0"), at(h, 1).alias("i1"), at(h, 2).alias("i2")))


def _added(cell: Column, items: Column, j: Column, width: int, sign: int) -> Column:
    """The cell j with its items added (sign 1) or taken out (sign -1)."""
    mine = lambda e: F.when(j < width, e["i0"]).when(j < 2 * width, e["i1"]).otherwise(e["i2"]) == j
    put = lambda c, e: F.struct((c["n"] + F.lit(sign) * e["n"]).cast("int").alias("n"), c["x"].bitwiseXOR(e["x"]).alias("x"), c["c"].bitwiseXOR(e["c"]).alias("c"))
    return F.aggregate(F.filter(items, mine), cell, put)


def sketch(digests: Column, width: int, level: int = 0) -> Column:
    """The 3 * width cells (n, x, c) of an array of distinct digests."""
    items = F.transform(digests, lambda x: _item(x, width, level, F.lit(1), F.xxhash64(x, F.lit(-1))))
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("c"))
    return _let(items, lambda e: F.transform(F.sequence(F.lit(0), F.lit(3 * width - 1)), lambda j: _added(empty, e, j, width, 1)))


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: F.struct((p["n"] - q["n"]).cast("int").alias("n"), p["x"].bitwiseXOR(q["x"]).alias("x"), p["c"].bitwiseXOR(q["c"]).alias("c")))


def peeled(cells: Column, width: int, level: int = 0) -> Column:
    """struct(cells left, plus, minus): the digests of the first and the second version
    only, as far as peeling came. The cells left are all zero if it came to the end."""
    alone = lambda c: (F.abs(c["n"]) == 1) & (F.xxhash64(c["x"], F.lit(-1)) == c["c"])

    def step(state: Column, _: Column) -> Column:
        def taken(found: Column) -> Column:
            cells = F.transform(state["cells"], lambda c, j: _added(c, found, j, width, -1))
            gained = lambda sign: F.transform(F.filter(found, lambda e: e["n"] == sign), lambda e: e["x"])
            return F.struct(cells.alias("cells"), F.concat(state["plus"], gained(1)).alias("plus"), F.concat(state["minus"], gained(-1)).alias("minus"))

        found = F.array_distinct(F.transform(F.filter(state["cells"], alone), lambda c: _item(c["x"], width, level, c["n"], c["c"])))
        return _let(found, lambda e: F.when(F.size(e) > 0, taken(e)).otherwise(state))

    none = F.array().cast("array<bigint>")
    start = F.struct(cells.alias("cells"), none.alias("plus"), none.alias("minus"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(PASSES)), start, step)


def is_empty(cells: Column) -> Column:
    return F.forall(cells, lambda c: (c["n"] == 0) & (c["x"] == 0) & (c["c"] == 0))


def as_text(digests: Column, cells: Column) -> Column:
    """The number of digests and the cells in Base64, 15 bytes each (32 bits of a checksum are
    enough to tell a digest that stands alone): equal texts, equal fingerprints."""
    padded = lambda v, n: F.lpad(F.hex(v), n, "0")
    one = lambda c: F.concat(padded(F.pmod(c["n"], F.lit(1 << 24)), 6), padded(c["x"], 16), padded(c["c"].bitwiseAND(F.lit(0xFFFFFFFF)), 8))
    return F.concat(F.size(digests).cast("string"), F.lit("/"), F.base64(F.unhex(F.array_join(F.transform(cells, one), ""))))


def _outcome(s: Column, a: str, b: str) -> list[Column]:
    """What a peeled sketch tells: the sizes of both differences, or else the digests for a retry."""
    ok = is_empty(s["cells"])
    sizes = [F.when(ok, F.size(s[side]).cast("long")).alias(f"n_{side}") for side in ("plus", "minus")]
    return [ok.alias("ok"), *sizes, F.when(~ok, F.col(a)).alias("a"), F.when(~ok, F.col(b)).alias("b")]


def _retried(failed: DataFrame) -> DataFrame:
    """(key, n_plus, n_minus) of failed (key, seg, a, b), which are dealt to more and more segments."""
    done, level = [], 0
    while not failed.isEmpty():
        level += 1
        # The first retry is sized by the digests, every further one deals each failed segment out again.
        wanted = (F.ceil((F.size("a") + F.size("b")) / SEGMENT_DIGESTS) if level == 1 else F.lit(SPLIT)).cast("long")
        sides = F.concat(F.transform("a", lambda x: F.struct(x.alias("x"), F.lit(True).alias("first"))), F.transform("b", lambda x: F.struct(x.alias("x"), F.lit(False).alias("first"))))
        dealt = failed.select("key", "seg", wanted.alias("wanted"), F.explode(sides).alias("e"))
        dealt = dealt.select("key", F.xxhash64("seg", F.pmod(F.xxhash64("e.x", F.lit(1000 + level)), F.col("wanted"))).alias("seg"), "e.x", "e.first")
        # Peeling takes the time, so tasks get equal numbers of segments rather than of bytes.
        tasks = max(1, -(-(failed.agg(F.sum(wanted)).first()[0] or 0) // TASK_SEGMENTS))
        rows = dealt.repartition(tasks, "key", "seg").groupBy("key", "seg").agg(F.collect_list(F.when(F.col("first"), F.col("x"))).alias("a"), F.collect_list(F.when(~F.col("first"), F.col("x"))).alias("b"))
        peels = rows.select("key", "seg", "a", "b", peeled(subtracted(sketch(F.col("a"), SEGMENT_WIDTH, level), sketch(F.col("b"), SEGMENT_WIDTH, level)), SEGMENT_WIDTH, level).alias("s"))
        tried = written(peels.select("key", "seg", *_outcome(F.col("s"), "a", "b")), "peeled")
        done.append(tried.where("ok").select("key", "n_plus", "n_minus"))
        failed = tried.where("not ok").select("key", "seg", "a", "b")
    if not done:
        return failed.select("key", F.lit(0).cast("long").alias("n_plus"), F.lit(0).cast("long").alias("n_minus"))
    return reduce(DataFrame.unionByName, done).groupBy("key").agg(F.sum("n_plus").alias("n_plus"), F.sum("n_minus").alias("n_minus"))


def differences(pairs: DataFrame) -> DataFrame:
    """(key, a, b) pairs of digest arrays to (key, n_plus, n_minus): how many digests
    only a and only b has, all recovered by peeling. `key` must be unique."""
    width = FINGERPRINT_WIDTH
    peels = pairs.select("key", "a", "b", peeled(subtracted(sketch(F.col("a"), width), sketch(F.col("b"), width)), width).alias("s"))
    tried = written(peels.select("key", F.lit(0).cast("long").alias("seg"), *_outcome(F.col("s"), "a", "b")), "peeled")
    return tried.where("ok").select("key", "n_plus", "n_minus").unionByName(_retried(tried.where("not ok").select("key", "seg", "a", "b")))


_KEY = ["absent", "place", "version"]


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, head, following, times): each text with what the next one by id gives it,
    the last one's next being the first. `head` are the next text's first code points, a
    quarter as many as the text has, `following` its paragraph digests.

    Rows that repeat an id are ordered by a hash of their text, null ids come first. A null
    text counts as empty. Equal rows are one row with `times` how often it stands; all
    but the last of them are followed by themselves.

    The order is found from ids, hashes and lengths: range partitions number the rows, and
    one row a partition tells what follows its last one. Texts are shuffled once, by key.
    """
    kind = docs.schema[id_col].dataType
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).isNull().alias("absent"), F.coalesce(F.col(id_col), F.lit(0).cast(kind)).alias("place"), F.xxhash64(text).alias("version"), text.alias("text"))
    sizes = rows.groupBy(*_KEY).agg(F.count("*").alias("times"), F.max(F.floor(F.length("text") / 4)).cast("int").alias("quarter"))
    order = [F.desc("absent"), F.asc("place"), F.asc("version")]
    placed = sizes.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")), "order")
    # One row for each range partition.
    ends = placed.groupBy("part").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    every = W.partitionBy(F.lit(1)).orderBy("part")
    ends = ends.select("part", "last", F.coalesce(F.lead("first").over(every), F.min("first").over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("beyond"))
    led = placed.join(F.broadcast(ends), "part").withColumn("next", F.when(F.col("seq") == F.col("last"), F.col("beyond")).otherwise(F.col("seq") + 1))
    before = led.select(F.col("next").alias("seq"), *[F.col(c).alias(f"to_{c}") for c in [*_KEY, "times", "quarter"]])
    links = written(placed.select(*_KEY, "seq").join(before, "seq").drop("seq"), "links", few=True)

    texts = rows.groupBy(*_KEY).agg(F.first("text").alias("text"))
    told = texts.join(links, _KEY).select(*[F.col(f"to_{c}").alias(c) for c in _KEY], F.col("to_times").alias("times"), F.left("text", F.col("to_quarter")).alias("head"), paragraph_digests(F.col("text")).alias("following"))
    met = texts.join(told, _KEY).select(F.when(~F.col("absent"), F.col("place")).alias("id"), "text", "head", "following", "times")
    itself = F.struct(F.left("text", F.floor(F.length("text") / 4).cast("int")).alias("head"), F.lit(None).cast("array<bigint>").alias("following"), (F.col("times") - 1).alias("times"))
    each = F.when(F.col("times") > 1, F.array(F.struct("head", "following", F.lit(1).cast("long").alias("times")), itself)).otherwise(F.array(F.struct("head", "following", "times")))
    return met.select("id", "text", F.explode(each).alias("n")).select("id", "text", "n.*")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints every text and its edited text, and compares them.

    The edited text has the last quarter of the code points (rounded down)
    replaced by the first as many (or all) of the next document's. Returns one
    row for each input row: id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next: the Jaccard similarity of the
    distinct paragraphs of the text and the edited or the next text, as the
    peeled differences of their sketches give it. Null and empty texts are one
    empty paragraph. Documents are ordered as `with_next` says; a table of one
    row is its own next. Texts are compared whole; other columns are not read.
    """
    n, width = F.length("text"), FINGERPRINT_WIDTH
    with scratch(docs.sparkSession) as keep:
        rows = with_next(docs, id_col, text_col).withColumn("edited", F.concat(F.left("text", n - F.floor(n / 4).cast("int")), "head"))
        rows = rows.select("id", "times", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), paragraph_digests(F.col("text")).alias("own"), paragraph_digests(F.col("edited")).alias("ed"), F.col("following").alias("nx"))
        rows = rows.withColumn("nx", F.coalesce("nx", "own"))
        rows = rows.select("*", sketch(F.col("own"), width).alias("s_own"), sketch(F.col("ed"), width).alias("s_ed"), sketch(F.col("nx"), width).alias("s_nx"))
        rows = rows.select("*", peeled(subtracted(F.col("s_own"), F.col("s_ed")), width).alias("p_ed"), peeled(subtracted(F.col("s_own"), F.col("s_nx")), width).alias("p_nx"))
        outcomes = [F.struct(F.size(other).alias("size"), *_outcome(F.col(f"p_{other}"), "own", other)).alias(f"o_{other}") for other in ("ed", "nx")]
        rows = rows.select("id", "times", "n_chars", "edited_sha256", as_text(F.col("own"), F.col("s_own")).alias("fingerprint"), as_text(F.col("ed"), F.col("s_ed")).alias("edited_fingerprint"), F.size("own").alias("size"), *outcomes)
        rows = written(rows.withColumn("rid", F.monotonically_increasing_id()), "compared")
        failed = [rows.where(f"not o_{other}.ok").select((F.col("rid") * 2 + k).alias("key"), F.lit(0).cast("long").alias("seg"), f"o_{other}.a", f"o_{other}.b") for k, other in enumerate(("ed", "nx"))]
        again = _retried(failed[0].unionByName(failed[1])).select(F.floor(F.col("key") / 2).alias("rid"), F.pmod("key", F.lit(2)).alias("kind"), (F.col("n_plus") + F.col("n_minus")).alias("d"))
        again = written(again.groupBy("rid").agg(*[F.max(F.when(F.col("kind") == k, F.col("d"))).alias(f"d_{other}") for k, other in enumerate(("ed", "nx"))]), "retried", few=True)
        keep(rows, again)

    def like(other: str) -> Column:
        d = F.coalesce(F.col(f"o_{other}.n_plus") + F.col(f"o_{other}.n_minus"), f"d_{other}")
        both = F.col("size") + F.col(f"o_{other}.size")
        return ((both - d) / (both + d)).alias(f"near_{'edited' if other == 'ed' else 'next'}")

    out = rows.join(again, "rid", "left").select("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("ed"), like("nx"), "times")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("copy", "times")
