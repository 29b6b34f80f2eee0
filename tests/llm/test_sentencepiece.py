from __future__ import annotations

import random
from array import array

import pytest
import sentencepiece

from pagemill.llm.queries import piece_model_path
from pagemill.llm.sentencepiece_bpe import BpeModel, encode_decode

from odd_texts import ODD


@pytest.fixture(scope="module")
def models():
    data = open(piece_model_path(), "rb").read()
    return BpeModel(data), sentencepiece.SentencePieceProcessor(model_proto=data)


def test_exact_on_random_and_hard_texts(models):
    ours, theirs = models
    rng = random.Random(1)
    letters = " .,ab\nthe▁é日🙂  tionier0123'\t -_/<s>²½€()\"\x00\x7f"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [" " * n + "x" * n for n in (1, 15, 16, 17, 33, 500)] + ["ab" * 5000, "</s><s><unk><0x41>", "a" * 20_000]
    for t in texts:
        assert ours.encode(t) == theirs.encode(t)
        ids = theirs.encode(t, add_bos=True, add_eos=True)
        assert ours.decode(ids) == theirs.decode(ids)


def test_decode_of_any_ids(models):
    ours, theirs = models
    rng = random.Random(2)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randint(0, 12))]
        assert ours.decode(ids) == theirs.decode(ids)


def test_whole_rows(documents, models, real):
    _, theirs = models
    docs = [*real, *((1000 + i, t) for i, t in enumerate(ODD)), (None, "null id"), (5, "again"), (5, "again")]
    got = encode_decode(documents(docs, clash=True), piece_model_path()).collect()
    want = sorted(((i, theirs.encode(t or "", add_bos=True, add_eos=True)) for i, t in docs), key=repr)
    assert sorted(((r.doc_id, array("I", r.token_ids).tolist()) for r in got), key=repr) == want
    assert {r.doc_id: r.decoded for r in got}[real[0][0]] == real[0][1]
    assert all(r.n_tokens == len(r.token_ids) // 4 for r in got)


def test_empty_table_and_other_models(documents):
    assert encode_decode(documents([]), piece_model_path()).collect() == []
    with pytest.raises(Exception):
        BpeModel(b"not a model")
