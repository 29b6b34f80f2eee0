from __future__ import annotations

import hashlib
import random

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from pagemill.llm.fingerprints import ENDLESS, LONG, LONG_CUT, SHORT_CUT, WINDOW_CUT, differences, fingerprints

from odd_texts import ODD


def marked(word, every):
    signed = xxhash.xxh64_intdigest(word.encode(), seed=42)
    return word + "\n" * ((signed - 2**64 if signed >= 2**63 else signed) % every == 0)


def pieces(text):
    cut = lambda line: " ".join(marked(w, LONG_CUT if len(line) > ENDLESS else SHORT_CUT) for w in line.split(" ")) if len(line) > LONG else line
    windows = lambda part: regex.sub("(?V1)" + WINDOW_CUT, r"\1\n", part).split("\n") if len(part) > ENDLESS else [part]
    return frozenset(w for part in "\n".join(map(cut, text.split("\n"))).split("\n") for w in windows(part))


def likeness(a, b):
    a, b = pieces(a), pieces(b)
    return len(a & b) / len(a | b)


def check(df, docs):
    got = {r.id: r for r in fingerprints(df).collect()}
    docs = sorted((i, t or "") for i, t in docs)
    assert len(got) == len(docs)
    for k, (i, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        n, q = len(text), len(text) // 4
        edited = text[: n - q] + following[:q]
        r = got[i]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - likeness(text, edited)) < 1e-12 and abs(r.near_next - likeness(text, following)) < 1e-12
    by_text = {}
    for i, text in docs:
        assert by_text.setdefault(text, got[i].fingerprint) == got[i].fingerprint
    assert len(set(by_text.values())) == len({pieces(t) for t in by_text})


@pytest.mark.parametrize("clash", [False, True])
def test_odd_rows(documents, clash):
    docs = list(enumerate(ODD))
    check(documents(docs, clash), docs)


def test_real_texts(documents, real):
    check(documents(real).repartition(5), real)


SCRIPTS = {
    "latin": ("abcdefghij", " "), "russian": ("абвгдежзиклмнопрст", " "), "chinese": ("天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往", ""), "chinese with signs": ("天地玄黄宇宙洪荒日月盈昃，。", ""), "hindi": ("कखगघचछजझ", " "), "one word": ("a", " "),
}


@pytest.mark.parametrize("script", SCRIPTS)
def test_one_line_texts_are_likelier_their_edits(documents, script):
    """Texts of one line of 3,000 to 10,000 characters, in any script."""
    letters, blank = SCRIPTS[script]
    rng = random.Random(3)
    docs = [(i, blank.join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 7))) for _ in range(rng.randrange(700, 1500)))) for i in range(12)]
    check(documents(docs), docs)
    if script != "one word":
        assert all(r.near_edited > 0.2 > r.near_next for r in fingerprints(documents(docs)).collect())


def test_one_row_empty_table_nulls_and_repeats(documents):
    check(documents([(7, "alone\nhere")]), [(7, "alone\nhere")])
    assert fingerprints(documents([])).collect() == []
    got = fingerprints(documents([(None, "a\nb\nc\nd"), (1, "e"), (1, "e"), (1, "f")])).collect()
    assert len(got) == 4 and [r.near_next for r in got if r.id is None] == [0.0]


def test_differences_of_any_size(spark):
    rng = random.Random(4)
    rows = []
    for key, (common, own_a, own_b) in enumerate([(0, 0, 0), (50, 0, 0), (500, 3, 2), (0, 400, 300), (5, 1000, 0), (1000, 40, 60), (0, 1, 0)]):
        pick = lambda n: [rng.getrandbits(63) for _ in range(n)]
        shared = pick(common)
        rows.append((key, shared + pick(own_a), shared + pick(own_b)))
    got = {r.key: (r.n_plus, r.n_minus) for r in differences(spark.createDataFrame(rows, "key long, a array<long>, b array<long>")).collect()}
    assert got == {k: (len(set(a) - set(b)), len(set(b) - set(a))) for k, a, b in rows}
    assert spark.range(1).select(F.lit(1)).count() == 1
