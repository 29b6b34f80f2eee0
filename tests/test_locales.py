"""Canonical tags, collations and UTF-16 offsets: pinned examples and brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pagemill.functions.locale import canonical_tag, collated
from pagemill.functions.utf16 import code_points, utf16_left, utf16_length, utf16_offset, utf16_slice, whole_offset

TAGS = [
    ("iw", "he"), ("iw-IL", "he-IL"), ("zh-min-nan", "nan"), ("ZH_MIN_NAN_tw", "nan-TW"), ("zh-min", "zh-min"), ("i-klingon", "tlh"), ("en-GB-oed", "en-GB-oxendict"), ("sh", "sr-Latn"), ("sh-YU", "sr-Latn-YU"), ("eng-uk", "en-GB"),
    ("uk", "uk"), ("uk-UA", "uk-UA"), ("ger-dd", "de-DE"), (" art-Lojban ", "jbo"), ("sgn-BE-FR", "sfb"), ("mo", "ro"), ("", ""), (None, None), ("xx-yy-zz", "xx-YY-ZZ"),
]
NAMES = ["zebra", "Äpfel", "apfel", "Apfel", "івана", "игор", "їжак", "йод", "ґанок", "гора", "дім", "е", "є"]


def test_canonical_tags(spark):
    rows = spark.createDataFrame(TAGS, "raw string, want string").select("raw", "want", canonical_tag(F.col("raw")).alias("got")).collect()
    assert [(r.raw, r.got) for r in rows] == [(r.raw, r.want) for r in rows]


@pytest.mark.parametrize("locale,want", [
    ("uk", ["гора", "ґанок", "дім", "е", "є", "игор", "івана", "їжак", "йод", "apfel", "Apfel", "Äpfel", "zebra"]),
    ("UNICODE", ["apfel", "Apfel", "Äpfel", "zebra", "ґанок", "гора", "дім", "е", "є", "игор", "івана", "їжак", "йод"]),
])
def test_order_of_names(spark, locale, want):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    assert [r.n for r in df.orderBy(collated(F.col("n"), locale)).collect()] == want


def test_equal_names(spark):
    df = spark.createDataFrame([("résumé", 1), ("resume", 2), ("RESUME", 4), ("other", 8), (None, 16)], "n string, v int")
    sums = lambda **how: sorted(r[1] for r in df.groupBy(collated(F.col("n"), **how)).agg(F.sum("v")).collect())
    assert sums() == [1, 2, 4, 8, 16] and sums(case=False) == [1, 6, 8, 16] and sums(accents=False) == [3, 4, 8, 16] and sums(case=False, accents=False) == [7, 8, 16]
    other = df.select(F.col("n").alias("m"))
    assert df.join(other, collated(F.col("n"), case=False, accents=False) == collated(F.col("m"), case=False, accents=False)).count() == 10


def units(text):
    return len(text.encode("utf-16-be")) // 2


def test_utf16_against_python(spark):
    rng = random.Random(5)
    texts = ["", "a", "😀", "a😀b", "é́😀😀", "𝒳y"] + ["".join(rng.choice("aé€😀𐍈\n") for _ in range(rng.randrange(40))) for _ in range(40)]
    rows = [(t, u, e) for t in texts for u, e in ((0, 1), (1, 3), (2, units(t)), (units(t), units(t) + 3), (-2, 2))] + [(None, 1, 2)]
    cols = ["t", utf16_length(F.col("t")), whole_offset(F.col("t"), F.col("u")), code_points(F.col("t"), F.col("u")), utf16_left(F.col("t"), F.col("u")), utf16_slice(F.col("t"), F.col("u"), F.col("e")), utf16_offset(F.col("t"), F.lit(2))]
    got = spark.createDataFrame(rows, "t string, u long, e long").select(*cols).collect()

    def whole(t, u):
        u = max(0, min(u, units(t)))
        raw = t.encode("utf-16-be")
        return u - 1 if u and 0xDC <= (raw[2 * u] if 2 * u < len(raw) else 0) <= 0xDF else u

    left = lambda t, u: t.encode("utf-16-be")[: 2 * whole(t, u)].decode("utf-16-be")
    for (t, u, e), r in zip(rows, got):
        want = (None,) * 7 if t is None else (t, units(t), whole(t, u), len(left(t, u)), left(t, u), t[len(left(t, u)) : max(len(left(t, u)), len(left(t, e)))], units(t[:2]))
        assert tuple(r) == want


def test_offsets_in_texts_with_emoji(spark, tmp_path):
    from pagemill.plans.texts import offset_locate

    texts = [(5, "😀\nab"), (3, "😀😀\nx"), (990, "𝒳" * 300 + "\n" + "é" * 900), (7, ""), (1, "\n\n"), (2, "a\n😀")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, text in texts:
        sizes = [units(line) for line in text.split("\n")]
        off, start = min(i % 997, max(sum(sizes) - 1, 0)), 0
        place = (0, 0)
        for n, size in enumerate(sizes):
            if start + size > off:
                place = (n, off - start)
                break
            start += size
        want.append((i, *place))
    assert sorted(map(tuple, offset_locate(spark, str(tmp_path)).collect())) == sorted(want)
