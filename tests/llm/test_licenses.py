from __future__ import annotations

import re

import pytest

from pagemill.llm.licenses import PHRASES, TEMPLATES, license_scan

from odd_texts import ODD

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def places(text):
    w = words_of(text)
    return sorted((label, k) for phrase, label in PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())


@pytest.mark.parametrize("clash", [False, True])
def test_phrases_against_brute_force(documents, real, clash):
    odd = ["MIT License mit-license MIT\nLICENSE", "apache  license; General PUBLIC_License general public license", "mit licenses", "xmit license", "general public general public license", "łicense mit license é", "MİT LICENSE mit lİcense"]
    docs = [*real[:60], *((1000 + i, t) for i, t in enumerate([*ODD, *odd]))]
    texts, spans = license_scan(documents([*docs, (None, "mit license")], clash))
    n = {r.id: r.n_words for r in texts.collect()}
    found = {}
    for r in spans.where("exact").collect():
        found.setdefault(r.id, []).append((r.label, r["first"]))
    for i, t in docs:
        assert n[i] == len(words_of(t))
        assert sorted(found.get(i, [])) == places(t), t
    assert found[None] == [("mit", 0)]


def test_templates_verify_spans(documents):
    whole = dict((label, text) for text, label in TEMPLATES)["mit-text"].split()
    changed = whole[:8] + ["indeed"] + whole[8:14] + whole[15:]
    scattered = " x y z ".join(whole[k] + " " + whole[k + 1] for k in range(0, len(whole) - 1, 2))
    docs = [(0, " ".join(whole)), (1, "pre " * 50 + " ".join(changed) + " post" * 9), (2, " ".join(whole[:6])), (3, scattered), (4, "Licensed under CC BY-NC 4.0.")]
    got = {(r.id, r.label): r for r in license_scan(documents(docs))[1].collect()}
    assert got[0, "mit-text"].share == 1.0 and (got[0, "mit-text"]["first"], got[0, "mit-text"]["last"]) == (0, len(whole) - 1)
    assert 0.85 < got[1, "mit-text"].share < 1 and got[1, "mit-text"]["first"] == 50
    assert (2, "mit-text") not in got and (3, "mit-text") not in got
    assert got[4, "cc-by-nc-4.0-notice"].share == 1.0


def test_repeated_rows_and_empty_table(documents):
    texts, spans = license_scan(documents([(1, "mit license"), (1, "mit license"), (1, "apache license")]))
    assert texts.count() == 3 and sorted(r.label for r in spans.collect()) == ["apache", "mit"]
    texts, spans = license_scan(documents([]))
    assert texts.collect() == [] and spans.collect() == []
