"""SimHash groups against a brute-force version."""

import math
import random
import re
from collections import Counter

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from heddle.llm import simhash


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = {i: brute_fingerprint(t) for i, t in rows}
    label = {i: i for i in fps}
    for i in sorted(fps):
        if label[i] == i:
            todo = [i]
            while todo:
                x = todo.pop()
                for y in fps:
                    if label[y] > i and (fps[x] ^ fps[y]).bit_count() <= 2:
                        label[y] = i
                        todo.append(y)
    return {i: (fps[i], label[i]) for i in fps}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAbBÉé \t\n\x0b\x85 \x1c.") | st.characters(exclude_categories=("Cs",)), max_size=60))
def test_fingerprint_equals_the_definition(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 40, 300, 900]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            if len(copy) > 30:
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, " ".join(copy)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "A b C"), (n + 4, "a B c")]


def test_groups_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    want = brute_components(rows)
    for bucket, segments in ((32, None), (1, None), (2, 5), (1, 9), (32, 31), (2, 63)):
        got = simhash.near_duplicates(docs, bucket=bucket, segments=segments).collect()
        assert {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in got} == want
    assert max(Counter(c for _, c in want.values()).values()) > 2


def test_crowded_keys_go_on_along_their_chain(spark):
    """Fingerprints that share keys but few links, and a dense group, for several sizes of buckets."""
    rng = random.Random(6)
    top = [rng.getrandbits(26) << 38 for _ in range(3)]
    values = {t | rng.getrandbits(38) for t in top for _ in range(60)}
    centre = rng.getrandbits(64)
    values |= {centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)}
    values |= {v ^ (1 << rng.randrange(64)) for v in rng.sample(sorted(values), 20)}
    fps = sorted(values)
    label = {i: i for i in range(len(fps))}
    want = {(i, j) for i in label for j in label if i < j and (fps[i] ^ fps[j]).bit_count() <= 2}
    nodes = spark.createDataFrame([(simhash._signed(fp), i) for i, fp in enumerate(fps)], "fp long, rep long")

    def components(edges):
        label = {i: i for i in range(len(fps))}
        while True:
            before = dict(label)
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
            if before == label:
                return label

    seen = set()
    for bucket, segments in ((8, 5), (32, 5), (8, 7), (1, 5), (10_000, 5)):
        found = simhash.links(nodes, segments=segments, bucket=bucket, paths=True).collect()
        assert {tuple(sorted((r.a, r.b))) for r in found if r.path != "star"} <= want
        assert components([(r.a, r.b) for r in found]) == components(want)
        seen |= {r.path for r in found}
        if bucket == 10_000:
            assert {tuple(sorted((r.a, r.b))) for r in found} == want
    assert seen == {"key", "longer key", "star"}


def test_keys_lengthen_with_the_table():
    assert simhash.segments_for(1000) == 5
    sizes = [simhash.segments_for(10**n) for n in range(3, 14)]
    assert sizes == sorted(sizes) and sizes[-1] <= 63 and 10**10 / 2 ** min(m.bit_count() for m in simhash._keys(simhash.segments_for(10**10), 2)) <= simhash.BESIDE
    for segments in (5, 9, 63):
        for mask in simhash._keys(segments, 2):
            parts = simhash._further(mask, 2)
            assert len(parts) == 3 and sum(parts) == (1 << 64) - 1 - mask


def test_one_bit(spark):
    fps = spark.createDataFrame([(0b0, 1), (0b1, 2), (0b11, 3), (-1, 4)], "fp long, rep long")
    for bucket in (32, 1):
        assert {tuple(sorted(r)) for r in simhash.links(fps, max_bits=1, bucket=bucket).collect()} == {(1, 2), (2, 3)}


def test_keep_one_odd_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "A b c d"), (3, "x y z q"), (None, "n m o"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.keep_one(docs).collect()
    assert sorted((r.doc_id or -1) for r in got) == [-1, -1, 1, 3]
    assert simhash.keep_one(docs.where("doc_id > 9")).count() == 0


def test_keep_one_keeps_a_row_of_each_group(spark):
    """Also where an id has several texts: the row that goes is not always the id's first."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(40)) for _ in range(12)]
    rows = [(rng.randrange(9), rng.choice(texts), rng.randrange(2)) for _ in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, heddle_row int")
    got = simhash.keep_one(docs).collect()
    fps = {t: brute_fingerprint(t) for _, t, _ in rows}
    assert len({f for f in fps.values()}) == len(fps)  # random texts: no links but repeated texts, or ids that join them
    edges = {}
    for i, t, _ in rows:
        edges.setdefault(t, set()).add(i)
    part = {t: min(ids) for t, ids in edges.items()}
    assert sorted(got and {part[r.text] for r in got}) == sorted(set(part.values())) and len(got) == len(set(part.values()))
    assert all(r.doc_id == part[r.text] for r in got) and {tuple(r) for r in got} <= set(rows)


def shingle_cosine(a, b):
    def own(t):
        w = [x.strip(".,;:!?()[]{}<>\"'`*_-") for x in t.lower().split()]
        w = [x for x in w if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    a, b = own(a), own(b)
    return len(a & b) / math.sqrt(len(a) * len(b)) if a and b else 0.0


def test_near_copies_go_and_others_stay(spark):
    """Copies with words changed here and there, against the exact cosine of five-word shingles."""
    rng = random.Random(21)
    words = [f"{a}{b}" for a in ("ba", "lo", "mi", "ter", "gan", "shi") for b in ("n", "st", "ra", "el", "o", "k", "ff", "ul")] + ["the", "of", "and"] * 10
    text = lambda n: [rng.choice(words) + str(rng.randrange(30)) * (rng.random() < 0.7) for _ in range(n)]
    rows, source = [], {}
    for i in range(60):
        base = text(rng.choice([80, 150, 400, 1500]))
        rows.append((i, " ".join(base)))
        for _ in range(2):
            copy = list(base)
            for _ in range(max(1, int(len(copy) * rng.choice([0.01, 0.02, 0.03, 0.2])))):
                copy[rng.randrange(len(copy))] = rng.choice(words) + "x"
            if rng.random() < 0.5:
                copy[3] = copy[3].upper() + ","
            source[len(source) + 100] = i
            rows.append((len(source) + 99, " ".join(copy)))
    rows += [(500 + i, " ".join(text(100))) for i in range(60)] + [(700, None), (701, ""), (702, "a b"), (703, "b a"), (704, "..."), (None, rows[0][1])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, heddle_key string, near int")
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns
    stays = {r.doc_id for r in left.collect()}
    texts = dict(rows)
    like = {d: shingle_cosine(texts[d], texts[i]) for d, i in source.items()}
    sure = [d for d, v in like.items() if v >= 0.84]
    assert len(sure) > 50 and sum(d not in stays for d in sure) >= 0.95 * len(sure)
    assert all(d in stays for d, v in like.items() if v < 0.6) and set(range(60)) <= stays and {500 + i for i in range(60)} <= stays and {700, 701, 702, 703, 704, None} <= stays
    assert simhash.drop_near_copies(docs.where("doc_id < 0")).count() == 0


def test_long_fingerprints_estimate_the_cosine():
    rng = random.Random(4)
    assert simhash.long_fingerprints(None, 4, 26) is None and simhash.long_fingerprints(" .. ", 4, 26) is None
    for share in (0.0, 0.01, 0.03, 0.1):
        a = [f"w{rng.randrange(5000)}" for _ in range(800)]
        b = [f"x{rng.randrange(5000)}" if rng.random() < share else w for w in a]
        (_, x), (_, y) = (simhash.long_fingerprints(" ".join(t), 4, 26) for t in (a, b))
        apart = sum(((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(x, y, strict=True)) / (64 * simhash.NEAR_WORDS)
        assert abs(math.cos(math.pi * apart) - shingle_cosine(" ".join(a), " ".join(b))) < 0.08
    sizes = [simhash.bands_for(10**n) for n in range(1, 12)]
    assert sizes == sorted(sizes) and all(1 - (1 - (1 - simhash.DESIGN) ** bits) ** bands >= simhash.RECALL for bands, bits in sizes)


def test_copies_with_one_word_in_twenty_changed_go(spark):
    rng = random.Random(12)
    word = lambda: f"{rng.choice('abcdefgh')}{int(rng.paretovariate(0.8)) % 5000}"
    bases = [[word() for _ in range(rng.choice([120, 250, 600]))] for _ in range(150)]
    rows = [(i, " ".join(w)) for i, w in enumerate(bases)]
    rows += [(1000 + i, " ".join(word() if rng.random() < 0.05 else x for x in w)) for i, w in enumerate(bases)]
    # half of the words are another text's: no copy
    rows += [(2000 + i, " ".join(w[: len(w) // 2] + bases[i - 1][: len(w) // 2])) for i, w in enumerate(bases[:60])]
    stays = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(1000 + i not in stays for i in range(150)) >= 0.85 * 150
    assert set(range(150)) <= stays and {2000 + i for i in range(60)} <= stays
