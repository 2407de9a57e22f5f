"""Kneser-Ney tables against a direct version, accuracy and odd rows."""

import math
import random
from collections import Counter, defaultdict

import numpy as np

from heddle.llm import langid


def texts(seed, n):
    rng = random.Random(seed)
    syllables = {"xx": ["ba", "lo", "mi"], "yy": ["tur", "gek", "fo"]}
    out = []
    for i in range(n):
        lang = "xx" if i % 2 else "yy"
        out.append((" ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 30))), lang))
    return out


def brute(train, order, symbols):
    """p(w | context) by the textbook recursion over strings."""
    grams = Counter()
    for t in train:
        s = "_" * (order - 1) + t
        for i in range(order - 1, len(s)):
            grams[s[i - order + 1 : i + 1]] += 1
    levels = {order: grams}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    stats = {}
    for k, counts in levels.items():
        n1, n2 = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
        total, kinds = defaultdict(float), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        stats[k] = (counts, total, kinds, n1 / (n1 + 2 * n2) if n1 and n2 else 0.5)

    def p(g):
        if not g:
            return 1 / symbols
        counts, total, kinds, d = stats[len(g)]
        if g[:-1] not in total:
            return p(g[1:])
        return max(counts[g] - d, 0) / total[g[:-1]] + d * kinds[g[:-1]] / total[g[:-1]] * p(g[1:])

    return p


def test_tables_equal_the_textbook_recursion():
    train = [t.replace(" ", "_") for t, lang in texts(1, 8) if lang == "xx"]
    model = langid.Model(["xx"], 3)
    model.alphabet, model.letter = langid._alphabet(train)
    langid._kneser_ney([train], model)
    p = brute(train, 3, langid.FIRST + len(set("".join(train)) - {"_"}))
    for text in ["balo_miba", "tur_gek", "lo", "zz"]:
        s = "__" + text
        want = -sum(math.log(p(s[i - 2 : i + 1])) for i in range(2, len(s))) / len(text)
        if "z" not in text and "t" not in text:
            got, _, _ = langid.cross_entropies([text, None, text], model)
            assert np.allclose(got[[0, 2], 0], want, atol=1e-4) and got[1, 0] == 0


def test_only_letters_make_a_language():
    model = langid.fit(*map(list, zip(*texts(5, 60), strict=True)))
    alone = ["\u2764\ufe0f", "\u0301", "12 \u20e3", "\U0001f468\u200d\U0001f469", "\u00aa"]  # the last is a letter
    names, score, _, rejected = langid.classify(alone, model)
    assert names[:4] == ["und"] * 4 and not score[:4].any() and rejected[:4].all() and names[4] != "und"


def test_large_alphabets_keep_their_letters_apart():
    rng = random.Random(3)
    han = {"north": range(0x4E00, 0x4E00 + 3000), "south": range(0x4E00 + 3000, 0x4E00 + 6000)}
    rows = [("".join(chr(rng.choice(points)) for _ in range(80)), lang) for lang, points in han.items() for _ in range(150)]
    texts_, langs = map(list, zip(*rows, strict=True))
    model = langid.fit(texts_, langs)
    assert len(set(model.alphabet[0x4E00 : 0x4E00 + 6000])) > 5000
    fresh = [("".join(chr(rng.choice(points)) for _ in range(40)), lang) for lang, points in han.items() for _ in range(50)]
    names, *_ = langid.classify([t for t, _ in fresh], model)
    assert names == [lang for _, lang in fresh]


def test_spark(spark):
    rows = [(i, t, lang, "x") for i, (t, lang) in enumerate(texts(2, 400))]
    odd = [(900, None, "xx", "x"), (901, "", None, "x"), (902, "123 !!", "yy", "x"), (None, "balo mi", "xx", "x"), (3, "turgek fo", "yy", "x"), (904, "日本語のテキストです。" * 20, None, "x"), (905, "balomi " * 20000, None, "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    model = langid.train(docs.where("doc_id % 5 <> 0 AND doc_id < 900"))
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got if r.doc_id not in (3, None)}
    held = [i for i, *_ in rows if i % 5 == 0]
    assert sum(by[i].lang_pred == rows[i][2] for i in held) >= 0.98 * len(held)
    assert not any(by[i].rejected for i in held) and all(0 <= r.score <= 1 for r in got)
    assert [by[i].lang_pred for i in (900, 901, 902, 905)] == ["und"] * 3 + ["xx"]
    assert by[904].rejected and by[902].rejected and by[902].score == 0
    empty = langid.train(docs.where("doc_id < 0"))
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, empty).collect()} == {("und", 0.0)}
    assert langid.identify(docs.where("doc_id < 0"), model).count() == 0
