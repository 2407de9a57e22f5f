"""SimHash fingerprints and near-duplicate groups by pigeonring filtering.

Two fingerprints link when at most ``max_bits`` of their 64 bits differ. The bits are cut
into segments on a ring. If the differences of all segments sum to at most ``max_bits``, then
from some segment on, every prefix of the chain of consecutive segments stays within its share
``floor(length * max_bits / segments)`` of the budget. The longest prefix whose share is zero
must match exactly, so it is a join key; the longer prefixes prune the candidates that the join
finds before the full Hamming check. More segments make longer keys (26 bits of five, 31 of
31) and more rows; their number follows the number of fingerprints, so that a key of a random fingerprint
stays with a few others in a table of any size.

Equal fingerprints count once: what follows works on distinct fingerprints. A key shared by
more than ``bucket`` of them goes on along its chain: the budget that is left can't reach all of ``max_bits`` + 1
parts of the other segments, so two fingerprints that link share one of these too. Where even such a longer key is crowded
(fingerprints as like as a large group of copies), it is not joined with itself. There each fingerprint names itself and
the values one bit away; two fingerprints name a common value only if they differ in at most two
bits, and always if they do, so linking all that name a value to the least of them
finds the same components in linear time.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.llm.common import Stored, slices, spare
from heddle.llm.components import connected_components
from heddle.session import ship

SHINGLE = 3
MAX_BITS = 2
SEGMENTS = 5  # at least
BUCKET = 32
BESIDE = 8  # random fingerprints that share a key, about
SEED = 42
SALTS = 8
NEAR_SHINGLE, NEAR_WORDS, SIMILARITY = 5, 32, 0.8  # the second pass: five words, 2048 bits
WORD_BITS, WORDS_ALIKE, RUNS_ALIKE = 16, 0.9, 0.6  # of 64; texts with words changed all over
HOT_KEY = 10_000  # documents of one band
DESIGN, RECALL = 0.1, 0.97
PUNCTUATION = b".,;:!?()[]{}<>\"'`*_-"
CROWDED_ROWS = 20_000  # keys: a megabyte
BROADCAST_ROWS = 1_000_000  # ids: some 60 MB in a hash table


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a whole text; null and wordless texts have 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        part = hashes[i : i + (1 << 14)]
        votes += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: Column | None = None) -> DataFrame:
    """(doc_id, fp), and ``mark`` if one is given: one row per row of ``docs``; fp is the SimHash as a signed long."""

    ship(docs.sparkSession)

    def batches(parts):
        for part in parts:
            got = np.fromiter((fingerprint(t.as_py()) for t in part.column(1)), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got.view(np.int64)), part.column(2)], names=["doc_id", "fp", "mark"])

    kept = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        (F.lit(None) if mark is None else mark).cast("long").alias("mark"),
    )
    found = kept.mapInArrow(batches, "doc_id long, fp long, mark long")
    return found.drop("mark") if mark is None else found


def _masks(segments: int) -> list[int]:
    cuts = [round(64 * i / segments) for i in range(segments + 1)]
    return [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _chains(segments: int, max_bits: int) -> list[list[tuple[int, int]]]:
    """For each start, (mask, budget) of each prefix of its chain."""
    masks = _masks(segments)
    out = []
    for start in range(segments):
        mask, chain = 0, []
        for length in range(1, segments + 1):
            mask |= masks[(start + length - 1) % segments]
            chain.append((mask, length * max_bits // segments))
        out.append(chain)
    return out


def _within(chain: list[tuple[int, int]], diff: Column) -> Column:
    """Whether every prefix of the chain keeps its budget; the last is the full Hamming check."""
    ok = F.lit(True)
    for mask, budget in chain:
        ok = ok & (F.bit_count(diff.bitwiseAND(F.lit(_signed(mask)))) <= budget)
    return ok


def segments_for(fingerprints: int, max_bits: int = MAX_BITS) -> int:
    """The fewest segments, SEGMENTS at least, whose keys about BESIDE of so many random fingerprints share."""
    if max_bits == 1:
        return SEGMENTS
    for segments in range(SEGMENTS, 64, 2):
        key = min(mask.bit_count() for mask in _keys(segments, max_bits))
        if fingerprints / 2**key <= BESIDE:
            return segments
    return 63


def _keys(segments: int, max_bits: int) -> list[int]:
    """For each start, the mask of the longest prefix that must match exactly."""
    return [[m for m, b in chain if b == 0][-1] for chain in _chains(segments, max_bits)]


def _further(mask: int, max_bits: int) -> list[int]:
    """The bits outside a mask in ``max_bits`` + 1 parts, in ring order from its end."""
    bits = [b for b in range(64) if not mask >> b & 1]
    start = next((i for i, b in enumerate(bits) if mask >> (b - 1) % 64 & 1), 0)
    bits = bits[start:] + bits[:start]
    cuts = [round(len(bits) * i / (max_bits + 1)) for i in range(max_bits + 2)]
    return [sum(1 << b for b in bits[a:c]) for a, c in zip(cuts, cuts[1:], strict=False)]


def _split_by_size(keyed: DataFrame, on: list[str], bucket: int) -> tuple[DataFrame, DataFrame]:
    """The rows whose key has company, up to ``bucket`` and beyond it."""
    crowded = keyed.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1")
    shared = Stored(keyed.join(crowded, on)).df
    return shared.where(F.col("n") <= bucket).drop("n"), shared.where(F.col("n") > bucket).drop("n")


def links(nodes: DataFrame, max_bits: int = MAX_BITS, segments: int | None = None, bucket: int = BUCKET, paths: bool = False) -> DataFrame:
    """(a, b): edges between the ``rep`` of distinct fingerprints, with the same components as all links.

    ``nodes`` has (fp, rep), one row for each fingerprint. Pairs within ordinary buckets are exactly
    the links found there; buckets that stay crowded along the chain give a star for each named value. The number of segments follows
    the number of fingerprints unless it is given. With ``paths``, the edges have how they were found: by the ``key``, the
    ``longer key`` or as a ``star``.
    """
    if max_bits not in (1, 2):
        raise ValueError("max_bits is 1 or 2: oversized buckets are linked exactly for these")
    segments = segments or segments_for(nodes.count(), max_bits)
    chains, keys = _chains(segments, max_bits), _keys(segments, max_bits)
    part = lambda mask: F.col("fp").bitwiseAND(F.lit(_signed(mask)))
    keyed = nodes.select(
        "fp",
        "rep",
        F.explode(F.array(*[F.struct(F.lit(i).alias("i"), part(m).alias("key")) for i, m in enumerate(keys)])).alias("k"),
    ).select("fp", "rep", "k.i", "k.key")
    small, large = _split_by_size(keyed, ["i", "key"], bucket)
    further = [_further(m, max_bits) for m in keys]
    parts = F.array(*[F.array(*[part(m) for m in masks]) for masks in further])
    longer = large.select("fp", "rep", "i", "key", F.posexplode(F.get(parts, F.col("i"))).alias("j", "more"))
    few, many = _split_by_size(longer, ["i", "key", "j", "more"], bucket)
    diff = F.col("fp").bitwiseXOR(F.col("fp2"))
    chain_ok = F.lit(False)
    for i, chain in enumerate(chains):
        chain_ok = chain_ok | ((F.col("i") == i) & _within(chain, diff))

    def pairs(rows: DataFrame, on: list[str], path: str) -> DataFrame:
        other = rows.select(*on, F.col("fp").alias("fp2"), F.col("rep").alias("rep2"))
        return rows.join(other, on).where((F.col("fp") < F.col("fp2")) & chain_ok).select(
            F.col("rep").alias("a"),
            F.col("rep2").alias("b"),
            F.lit(path).alias("path"),
        )

    flips = [
        F.struct(
            F.lit(b).alias("bit"),
            (
                F.col("fp").bitwiseXOR if max_bits == 2 else F.col("fp").bitwiseAND
            )(F.lit(_signed((1 << b) ^ (0 if max_bits == 2 else (1 << 64) - 1)))).alias("value"),
        ) for b in range(64)
    ]
    if max_bits == 2:  # any bit flipped names the same value; at 1, the bit left open is part of the name
        flips = [
            F.struct(F.lit(0).alias("bit"), f["value"].alias("value")) for f in flips
        ] + [F.struct(F.lit(0).alias("bit"), F.col("fp").alias("value"))]
    stars = (
        many.select("fp", "rep").distinct().select("rep", F.explode(F.array(*flips)).alias("named"))
        .withColumn("least", F.min("rep").over(Window.partitionBy("named.bit", "named.value")))  # at most 65 fingerprints name a value
        .where(F.col("rep") != F.col("least"))
        .select(F.col("rep").alias("a"), F.col("least").alias("b"), F.lit("star").alias("path"))
    )
    found = pairs(small, ["i", "key"], "key").unionByName(pairs(few, ["i", "key", "j", "more"], "longer key")).unionByName(stars)
    return found.distinct() if paths else found.drop("path").distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_bits: int = MAX_BITS,
    segments: int | None = None,
    bucket: int = BUCKET,
    mark: Column | None = None,
) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the least doc_id reachable over links, itself included; and ``mark`` if one is given.

    Null and wordless texts have fingerprint 0 and link like any other. Rows that repeat an id stay
    separate rows, each in the group of its fingerprint; fingerprints whose least id is the same are one
    node. A row with a null id joins the
    group of its fingerprint; its component_id is null if no row of this fingerprint has an id. No
    rows give no rows. Other columns are not read, whatever their names.
    """
    fps = Stored(fingerprints(docs, id_col, text_col, mark)).df
    nodes = Stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))).df
    found = connected_components(links(nodes.where(F.col("rep").isNotNull()), max_bits, segments, bucket))
    labels = nodes.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    # a fingerprint may have a third of all rows: its label is there once for each salt
    labels = labels.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
    salted = fps.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS).cast("long")))
    return salted.join(labels, ["fp", "salt"]).select("doc_id", "fp", "component_id", *([] if mark is None else ["mark"]))


def bands_for(documents: int, near: float = DESIGN, recall: float = RECALL) -> tuple[int, int]:
    """(bands, bits of each) for so many documents.

    Bands are long enough that a random document shares one with few others, and so many that two documents whose words'
    fingerprints differ in ``near`` of their bits share one with a chance of ``recall``.
    """
    bits = max(26, math.ceil(math.log2(max(documents, 2))) + 8)  # a random document in one of 256 bands
    return math.ceil(math.log(1 - recall) / math.log(1 - (1 - near) ** bits)), bits


def _mixed(hashes: np.ndarray, outputs: int) -> np.ndarray:
    """So many independent 64-bit hashes of each hash, as rows."""
    with np.errstate(over="ignore"):
        z = hashes[:, None] + np.arange(1, outputs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _votes(hashes: np.ndarray, outputs: int) -> np.ndarray:
    """The SimHash of ``outputs`` * 64 bits of distinct features, as zeros and ones; one feature counts once."""
    votes = np.zeros(outputs * 64, np.int64)
    for i in range(0, len(hashes), 512):
        part = np.ascontiguousarray(_mixed(hashes[i : i + 512], outputs)).view(np.uint8).reshape(-1, outputs * 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return (2 * votes > len(hashes)).astype(np.uint8)


def long_fingerprints(text: str | None, bands: int, bits: int) -> tuple[list[int], list[int]] | None:
    """(band keys, near): the bands of the SimHash of a text's words, and the SimHash of its five-word shingles as signed longs; None without words."""
    found = _long_fingerprints(text, bands, bits)
    return found and found[:2]


def _long_fingerprints(text: str | None, bands: int, bits: int) -> tuple[list[int], list[int], list[int]] | None:
    """What ``long_fingerprints`` gives, and the SimHash of the text's words.

    Words are those of ``fingerprint`` without the punctuation around them.
    """
    words = [w for w in (x.strip(PUNCTUATION) for x in (text or "").encode("utf-8", "surrogatepass").lower().split()) if w]
    if not words:
        return None
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    size = min(NEAR_SHINGLE, len(words))
    runs = np.zeros(len(words) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            runs = (runs ^ hashes[i : len(words) - size + 1 + i]) * np.uint64(0xD6E8FEB86659FD93)
            runs ^= runs >> np.uint64(32)
    of_words = _votes(np.unique(hashes), max(WORD_BITS, -(-bands * bits // 64)))
    votes = of_words[: bands * bits].reshape(bands, bits)
    keys = votes.astype(np.int64) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
    near, own = (np.packbits(v, bitorder="little").view(np.int64) for v in (_votes(np.unique(runs), NEAR_WORDS), of_words[: 64 * WORD_BITS]))
    return keys.tolist(), near.tolist(), own.tolist()


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): ids of documents whose five-word shingles have a cosine of at least ``similarity``, as their 2048-bit SimHashes have it (within about 0.02).

    For copies with words changed here and there, which two bits of 64 don't reach. One word in twenty takes a quarter of the five-word shingles
    with it, but hardly any words: documents link too if the cosine of their distinct words is at least WORDS_ALIKE and that of their shingles RUNS_ALIKE. Candidates share a band of the SimHash of their
    words, which such changes move little; within a band each document meets the least id alone, so rows grow with documents. The search is
    approximate: see ``bands_for``. Null ids and wordless texts link to nothing.
    """
    ship(docs.sparkSession)
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")
    bands, bits = bands_for(kept.count())

    def batches(parts):
        for part in (p for whole in parts for p in slices(whole, 1)):
            got = [_long_fingerprints(t.as_py(), bands, bits) for t in part.column(1)]
            some = pa.array([g is not None for g in got], pa.bool_())
            got = [g for g in got if g is not None]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).filter(some),
                    pa.array([k for k, _, _ in got], pa.list_(pa.int64())),
                    pa.array([n + w for _, n, w in got], pa.list_(pa.int64())),
                ],
                names=["doc_id", "keys", "near"],
            )

    fps = Stored(kept.mapInArrow(batches, "doc_id long, keys array<long>, near array<long>")).df
    # the band goes into the key; most keys that are shared are shared by two, whose pair is the least and the greatest id
    keyed = fps.select("doc_id", F.explode(F.transform("keys", lambda k, i: F.xxhash64(k, i))).alias("key"))
    met = Stored(keyed.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).where("a < b")).df
    crowded = met.where("n > 2").select("key", "a", (F.col("n") > HOT_KEY).alias("hot"))
    if crowded.count() <= CROWDED_ROWS:
        stars = keyed.join(F.broadcast(crowded), "key")
    else:
        stars = _salted(keyed, F.col("doc_id")).join(crowded.withColumn("salt", _all_salts()), ["key", "salt"])
    stars = stars.where("a < doc_id").select("a", F.col("doc_id").alias("b"), "hot")
    pairs = met.where("n = 2").select("a", "b", F.lit(False).alias("hot")).unionByName(stars).groupBy("a", "b").agg(F.max("hot").alias("hot"))
    # the least id of a large band has a pair for each of its documents: they are dealt out by the other id
    near = fps.select("doc_id", "near")
    leads = near.join(crowded.where("hot").select(F.col("a").alias("doc_id"), F.lit(True).alias("lead")).distinct(), "doc_id", "left")
    leads = leads.select(F.col("doc_id").alias("a"), F.col("near").alias("x"), F.explode(F.when(F.col("lead"), _salt_array()).otherwise(F.array(F.lit(0).cast("long")))).alias("salt"))
    dealt = pairs.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("b"), F.lit(SALTS).cast("long"))).otherwise(F.lit(0).cast("long")))
    both = dealt.join(leads, ["a", "salt"]).join(near.select(F.col("doc_id").alias("b"), F.col("near").alias("y")), "b")
    apart = lambda start, size: reduce(lambda p, q: p + q, [F.bit_count(F.get("x", F.lit(i)).bitwiseXOR(F.get("y", F.lit(i)))) for i in range(start, start + size)])
    most = lambda size, cosine: F.lit(int(64 * size * math.acos(cosine) / math.pi))
    runs, own = apart(0, NEAR_WORDS), apart(NEAR_WORDS, WORD_BITS)
    alike = (runs <= most(NEAR_WORDS, similarity)) | (runs <= most(NEAR_WORDS, RUNS_ALIKE)) & (own <= most(WORD_BITS, WORDS_ALIKE))
    return both.where(alike).select("a", "b").distinct()


def _salt_array() -> Column:
    return F.array(*[F.lit(i).cast("long") for i in range(SALTS)])


def _all_salts() -> Column:
    return F.explode(_salt_array())


def _salted(rows: DataFrame, by: Column) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS).cast("long")))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without those that a document with a lesser id stands for, in groups that ``near_links`` links. Rows with a null id stay."""
    groups = Stored(connected_components(near_links(docs, id_col, text_col, similarity)).where("node <> component_id").select("node")).df
    key = spare(docs, "heddle_key")
    gone = groups.select(F.col("node").alias(key))
    marked = docs.withColumn(key, F.col(f"`{id_col}`").cast("long"))
    return marked.join(
        F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone,
        key,
        "left_anti",
    ).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that another document of their near-duplicate group stands for.

    Of each group the row with the least id stays, of rows that repeat this id the one whose hash over all columns is least; so
    every group keeps exactly one row, also where an id has several texts. Rows with a null id can't be named and all stay.
    """
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    groups = Stored(near_duplicates(docs, id_col, text_col, mark=row, **options).where("doc_id IS NOT NULL")).df
    first = groups.groupBy("component_id").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    each = groups.groupBy("component_id", "doc_id", "mark").agg(F.count("*").alias("n"))
    judged = each.join(first, "component_id").withColumn("stays", F.struct("doc_id", "mark") == F.col("first"))
    gone, repeated = judged.agg(F.count_if(~F.col("stays")), F.count_if(F.col("stays") & (F.col("n") > 1))).first()
    name, key = spare(docs, "heddle_row"), spare(docs, "heddle_key")
    marked = docs.withColumn(name, row).withColumn(key, F.col(f"`{id_col}`").cast("long"))
    stood_for = judged.where(~F.col("stays")).select(F.col("doc_id").alias(key), F.col("mark").alias(name))
    out = marked.join(F.broadcast(stood_for) if gone <= BROADCAST_ROWS else stood_for, [key, name], "left_anti")
    if repeated:  # equal rows: the first of each that has an id
        twice = judged.where(F.col("stays") & (F.col("n") > 1)).select(F.col("doc_id").alias(key), F.col("mark").alias(name))
        same = F.broadcast(twice) if repeated <= BROADCAST_ROWS else twice
        out = out.join(same, [key, name], "left_anti").unionByName(
            out.join(same, [key, name], "left_semi").select(out.columns).dropDuplicates([key, name])
        )
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
