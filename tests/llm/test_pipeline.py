"""The pipeline against the operators' brute-force versions, one stage after the other, and odd rows."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from heddle.llm import langid, pii  # noqa: E402
from test_decontam import brute  # noqa: E402
from test_simhash import brute_components  # noqa: E402


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(11)
    speak = {"xx": ["ba", "lo", "mi", "ne"], "yy": ["tur", "gek", "fo", "rup"]}
    say = lambda lang, n: " ".join("".join(rng.choice(speak[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    items = [(i, say("xx", 20)) for i in range(5)]
    docs = []
    for i in range(150):
        lang = rng.choice(["xx", "yy"])
        text = say(lang, rng.choice([30, 80, 300]))
        if i % 10 == 0:
            text += f" mail a.b{i}@c.example.com or +1 (456) 555-{1000 + i}, card 4111 1111 1111 1111 "
        if i % 17 == 0:
            text += " " + items[i % 5][1].upper() + "."
        docs.append((i, text, lang, "s", len(text)))
    docs += [(200 + i, docs[i][1], docs[i][2], "s", 0) for i in range(20)]
    docs += [(300, None, "xx", "s", 0), (301, "", None, None, None), (302, "12 34", "xx", "s", 5), (303, "日本語のテキスト" * 60, None, "s", 9), (304, docs[7][1], None, "s", 9)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), docs, items


def test_stages_and_run(spark, tables):
    path, docs, items = tables
    df = spark.read.parquet(f"{path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_dedup", "decontaminate", "personal_data", "tokens"]
    state = {d[0]: d[1] for d in docs}
    model = langid.train(df)
    _, _, _, rejected = langid.classify(list(state.values()), model)
    state = {i: t for (i, t), r in zip(state.items(), rejected, strict=True) if not r}
    assert {300, 301, 302, 303}.isdisjoint(state) and len(state) == 171
    state = _firsts(state)
    bad = {d for d, _ in brute(list(state.items()), items)}
    assert bad
    state = {i: t for i, t in state.items() if i not in bad}
    weights = pii.fit([t for t in state.values()])
    state = {i: pii.redact(t, b + a) for (i, t), (b, a) in zip(state.items(), pii.find(list(state.values()), weights), strict=True)}
    assert any("[EMAIL]" in t and "[PHONE]" in t and "[CARD]" in t for t in state.values())
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    assert set(got) == set(state)
    for i, text in state.items():
        ids = sp.encode(text, add_bos=True, add_eos=True)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), text
    out = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, path)
        assert out.columns == list(corpus_pipeline.COLUMNS)


def _firsts(state):
    groups = brute_components(list(state.items()))
    return {i: t for i, t in state.items() if groups[i][1] == i}


def test_no_documents(spark, tables, tmp_path):
    path, _, _ = tables
    spark.read.parquet(f"{path}/documents.parquet").where("doc_id < 0").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
