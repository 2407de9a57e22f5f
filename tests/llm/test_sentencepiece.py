"""Ids and decoded texts against the sentencepiece library."""

import hashlib
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from heddle.llm import sentencepiece as own

PATH = public_tokenizers.path("piece_bpe_32k.model")
V = own.load(PATH)
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)


def check(texts):
    ids, stops = own.encode_batch(texts, V)
    decoded = own.decode_batch(ids, stops, V)
    for text, got, end, start in zip(texts, decoded, stops, [0, *stops], strict=False):
        want = SP.encode(text, add_bos=True, add_eos=True)
        assert ids[start:end].tolist() == want, text[:200]
        assert got.decode() == SP.decode(want), text[:200]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aaabcdethinrso  \n\t▁ÉéßñAT.,!$%&<>/0123") | st.characters(exclude_categories=("Cs",)), max_size=80), max_size=6))
def test_random_texts(texts):
    check(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["    ", "the", "the ", "\n\n", "return", " self", "....", "====", "ab", "a" * 17, "▁", "00000", "é", "日本語", "\U0001f600", "tion", "ing"]), max_size=40))
def test_pieces_of_code_and_prose(parts):
    check(["".join(parts)])


def test_runs_and_long_texts():
    check([" " * n + end for n in range(70) for end in ("", "t", "日", "\n")])
    check(["", "x" * 3000, "ab" * 2000, "thethe" * 500 + "\n" * 500, " ".join(["onion"] * 20000), "<s></s><unk><0x0A>"])


LETTERS = st.text(alphabet=st.sampled_from("aabcdeeghinorstTHE=-0_.<é日"), min_size=1, max_size=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(LETTERS, st.integers(1, 40)), max_size=8), st.integers(1, 400))
def test_words_without_spaces(parts, rounds):
    text = "".join(p * n for p, n in parts)
    before = own.ROUNDS
    own.ROUNDS = rounds  # fewer rounds leave more to the queue
    try:
        check([text, "word " + text])
    finally:
        own.ROUNDS = before


def test_long_words_take_time_in_proportion():
    rng = np.random.default_rng(1)
    long = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"), 320_000))
    began = time.perf_counter()
    own.encode_batch([long], V)
    assert time.perf_counter() - began < 3
    for word in (long[:20_000], "ACGT" * 5000, "=" * 20_001, "ab" * 9_999 + "a", "".join(rng.choice(list("ACGT"), 20_000)), "thethe" * 3000, "a" * 12_345):
        check([word])


def test_words_are_remembered_and_forgotten(monkeypatch):
    monkeypatch.setattr(own, "MEMO_BYTES", 2000)
    memo = own._Memo(V)
    for texts in (["the cat", "a cat  the"], ["cat " * 50 + "dog"], [" ".join(f"w{i}" for i in range(60))], ["the dog"], [""]):
        ids, stops = own.encode_batch(texts, V, memo)
        plain = own.encode_batch(texts, V)
        assert ids.tolist() == plain[0].tolist() and stops.tolist() == plain[1].tolist()
    assert len(memo) < 10


def test_spark(spark):
    rows = [(1, None, 5), (2, "", 6), (2, "Hello  world\n", 7), (None, "Été à l'île", 8), (3, "long " * 30000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = own.encode_decode(docs, PATH, outputs=("ids", "decoded")).collect()
    assert len(got) == 5
    by = {r.decoded: r for r in got}
    for _, text, _ in rows:
        want = SP.encode(text or "", add_bos=True, add_eos=True)
        r = by[text or ""]
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert own.encode_decode(docs.where("doc_id > 5"), PATH).count() == 0


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as file:
        proto.ParseFromString(file.read())
    proto.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError):
        own.load(str(tmp_path / "m"))
