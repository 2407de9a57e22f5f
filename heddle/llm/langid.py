"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of its letters' n-grams, all of them kept together: for each order, the
sorted hashes of the n-grams that any language has seen, beside a matrix of the fully interpolated
log-probability in every language, and the sorted hashes of contexts beside their log back-off
weights. One binary search so gives a character's probability in all languages; only what no
language has seen goes on to the next lower order. The language with the lowest cross-entropy a
character wins.

Letters and the marks on them keep their identity without case (16 bits a symbol; the few beyond the
65,533 commonest that training saw share one); a run of anything else is one boundary mark. Only letters
(category L) make a text one that has a language. Texts never share contexts. The models are fitted on at most about ``sample_docs`` labelled documents, in equal
shares by language, drawn by a hash of the id; a fifth of these is left out of the counts to
calibrate the score's temperature and the cross-entropy beyond which a text is rejected as none of
the languages.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import slices
from heddle.session import ship

ORDER = 4
SAMPLE_DOCS = 6000
CALIBRATION_SHARE = 0.2
REJECT_RATE = 1e-3  # what about a thousand calibration texts can support
UNKNOWN = "und"
CHUNK = 1 << 18
MIX = np.uint64(0x9E3779B97F4A7C15)
BITS = 16  # of a symbol; an n-gram of four is a 64-bit code
RARE, FIRST = 1, 2  # the symbol of letters that training did not see, and the first of those it did


@dataclass
class Model:
    langs: list[str]
    order: int = ORDER
    alphabet: np.ndarray = field(default_factory=lambda: np.zeros(0x110000, np.uint16))
    letter: np.ndarray = field(default_factory=lambda: np.zeros(0x110000, bool))
    grams: list[np.ndarray] = field(default_factory=list)  # of order 1, 2, ...: sorted hashes
    logs: list[np.ndarray] = field(default_factory=list)  # beside each: log-probability by language
    contexts: list[np.ndarray] = field(default_factory=list)  # of the contexts of order 1, 2, ...
    backoffs: list[np.ndarray] = field(default_factory=list)
    floor: float = 0.0
    temperature: float = 1.0
    limit: float = np.inf
    spread: float = 0.0


def _categories() -> np.ndarray:
    """The first letter of every code point's category."""
    import unicodedata

    return np.fromiter((unicodedata.category(chr(c))[0] for c in range(0x110000)), "U1", 0x110000)


def _alphabet(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code point to symbol (0 for neither letter nor mark, RARE for unseen ones, the seen from FIRST on, without case); which are letters."""
    counts = np.zeros(0x110000, np.int64)
    for text in texts:
        points, n = np.unique(_points(text.lower()), return_counts=True)
        counts[points] += n
    kinds = _categories()
    letter = kinds == "L"
    spoken = letter | (kinds == "M")
    counts[~spoken] = 0
    out = spoken.astype(np.uint16)  # RARE
    seen = np.argsort(-counts, kind="stable")[: (1 << BITS) - FIRST]
    seen = seen[counts[seen] > 0]
    out[seen] = np.arange(FIRST, FIRST + len(seen))
    for point in np.flatnonzero(spoken):
        low = chr(point).lower()
        if len(low) == 1:
            out[point] = out[ord(low)]
    return out, letter


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _symbols(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' symbols end to end, each with its context packed in: codes of ``order`` symbols; starts; letters in each text."""
    pad = np.zeros(model.order - 1, np.uint16)
    parts, sizes, letters = [], [], []
    for text in texts:
        points = _points(text) if text else pad[:0]
        s = model.alphabet[points]
        letters.append(int(np.count_nonzero(model.letter[points])))
        keep = s != 0
        keep[1:] |= s[:-1] != 0
        s = s[keep]
        parts += [pad, s]
        sizes.append(len(s))
    flat = np.concatenate([*parts, pad]) if parts else pad
    codes = np.zeros(len(flat), np.uint64)
    for back in range(model.order):
        codes[back:] |= flat[: len(flat) - back].astype(np.uint64) << np.uint64(BITS * back)
    starts = np.cumsum([0, *(n + model.order - 1 for n in sizes)])
    at = np.ones(len(flat), bool)
    for back in range(model.order - 1):
        at[starts + back] = False
    return codes[at], np.cumsum([0, *sizes]), np.array(letters, np.int64)


def _hash(codes: np.ndarray) -> np.ndarray:
    return codes * MIX  # odd, so no two codes share a hash


def _low(codes: np.ndarray, order: int) -> np.ndarray:
    return codes & np.uint64((1 << (BITS * order)) - 1)


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table, wanted)
    at[at == len(table)] = 0
    return at, (table[at] == wanted) if len(table) else np.zeros(len(wanted), bool)


def _kneser_ney(texts_by_lang: list[list[str]], model: Model) -> None:
    """Fills the model's tables."""
    n, langs = model.order, len(texts_by_lang)
    counted: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
    for texts in texts_by_lang:
        chunks = [_symbols(texts[i : i + 200], model)[0] for i in range(0, len(texts), 200)]
        grams, counts = np.unique(np.concatenate([*chunks, np.zeros(0, np.uint64)]), return_counts=True)
        for order in range(n, 0, -1):
            counted[order - 1].append((grams, counts.astype(np.float64)))
            if order > 1:  # below the highest order: in how many contexts, not how often
                grams, counts = np.unique(_low(grams, order - 1), return_counts=True)
    symbols = float(model.alphabet.max()) + 1  # with the boundary
    model.floor = -np.log(symbols)
    lower_hash, lower_log = np.zeros(0, np.uint64), np.zeros((0, langs))
    for order in range(1, n + 1):
        every = np.unique(np.concatenate([g for g, _ in counted[order - 1]] + [np.zeros(0, np.uint64)]))
        contexts = np.unique(every >> np.uint64(BITS))
        seen, weight = np.zeros((len(every), langs)), np.ones((len(contexts), langs))
        for lang, (grams, counts) in enumerate(counted[order - 1]):
            once, twice = np.count_nonzero(counts == 1), np.count_nonzero(counts == 2)
            discount = once / (once + 2 * twice) if once and twice else 0.5
            own, first = np.unique(grams >> np.uint64(BITS), return_index=True)
            if not len(own):
                continue
            totals, kinds = np.add.reduceat(counts, first), np.diff([*first, len(grams)])
            of = np.searchsorted(own, grams >> np.uint64(BITS))
            seen[np.searchsorted(every, grams), lang] = np.maximum(counts - discount, 0) / totals[of]
            weight[np.searchsorted(contexts, own), lang] = discount * kinds / totals
        if order == 1:
            below = np.full((len(every), langs), 1 / symbols)
        else:
            at, _ = _find(lower_hash, _hash(_low(every, order - 1)))
            below = np.exp(lower_log[at])
        logs = np.log(seen + weight[np.searchsorted(contexts, every >> np.uint64(BITS))] * below)
        rank, ctx = np.argsort(_hash(every)), np.argsort(_hash(contexts))
        lower_hash, lower_log = _hash(every)[rank], logs[rank]
        model.grams.append(lower_hash)
        model.logs.append(lower_log.astype(np.float32))
        model.contexts.append(_hash(contexts)[ctx])
        model.backoffs.append(np.log(weight[ctx]).astype(np.float32))


def _log_probabilities(codes: np.ndarray, model: Model, order: int) -> np.ndarray:
    """Of each code's last symbol after the others, by language."""
    if order == 0:
        return np.full((len(codes), len(model.langs)), model.floor, np.float32)
    at, hit = _find(model.grams[order - 1], _hash(codes))
    out = model.logs[order - 1][at] if len(model.grams[order - 1]) else np.zeros((len(codes), len(model.langs)), np.float32)
    if not hit.all():
        missed = codes[~hit]
        at, known = _find(model.contexts[order - 1], _hash(missed >> np.uint64(BITS)))
        back = np.where(
            known[:, None],
            model.backoffs[order - 1][at],
            np.float32(0),
        ) if len(known) and len(model.contexts[order - 1]) else np.float32(0)
        out[~hit] = back + _log_probabilities(_low(missed, order - 1), model, order - 1)
    return out


def cross_entropies(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nats a symbol by text and language (0 for empty texts); symbols and letters in each text."""
    codes, starts, letters = _symbols(texts, model)
    out = np.zeros((len(texts), len(model.langs)))
    lengths = np.diff(starts)
    if len(codes) and model.langs:
        sums = np.zeros((len(texts), len(model.langs)))
        full = np.flatnonzero(lengths)
        owner = np.repeat(np.arange(len(full)), lengths[full])
        for i in range(0, len(codes), CHUNK):
            logs = _log_probabilities(codes[i : i + CHUNK], model, model.order)
            mine = owner[i : i + CHUNK]
            first = np.flatnonzero(np.diff(mine, prepend=-1))
            np.add.at(sums, full[mine[first]], np.add.reduceat(logs, first, axis=0, dtype=np.float64))
        out[full] = -sums[full] / lengths[full, None]
    return out, lengths, letters


def fit(texts: list[str], langs: list[str], order: int = ORDER) -> Model:
    """A model of the labelled texts; every fifth is kept for calibration where there are at least ten."""
    model = Model(sorted(set(langs)), order)
    if not 1 <= order <= 64 // BITS:
        raise ValueError(f"the order is from 1 to {64 // BITS}: an n-gram is one 64-bit code")
    model.alphabet, model.letter = _alphabet(texts)
    every = round(1 / CALIBRATION_SHARE)
    held = [i % every == 0 and len(texts) >= 10 for i in range(len(texts))]
    _kneser_ney([[t for t, lang, h in zip(texts, langs, held, strict=True) if lang == own and not h] for own in model.langs], model)
    if any(held):
        own = [model.langs.index(lang) for lang, h in zip(langs, held, strict=True) if h]
        _calibrate([t for t, h in zip(texts, held, strict=True) if h], np.array(own), model)
    return model


def _calibrate(texts: list[str], own: np.ndarray, model: Model) -> None:
    ce, lengths, letters = cross_entropies(texts, model)
    some = letters > 0
    ce, own, lengths = ce[some], own[some], lengths[some]
    if not len(ce):
        return

    def loss(t: float) -> float:
        z = -ce * t
        top = z.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(z - top).sum(1)) + top[:, 0] - z[np.arange(len(z)), own]))

    model.temperature = min((0.5 * 1.25**i for i in range(24)), key=loss)
    best = np.sort(ce.min(1))  # what a text is rejected by
    model.limit = float(best[min(len(best), int(np.ceil((len(best) + 1) * (1 - REJECT_RATE)))) - 1])
    own_ce = ce[np.arange(len(ce)), own]
    model.spread = float(np.std((own_ce - own_ce.mean()) * np.sqrt(lengths)))


def classify(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, cross-entropy and whether it is rejected, for each text.

    A null text, or one without letters, is ``und`` with score 0 and rejected, as is any text where no
    language was learned. Otherwise the score is the calibrated probability of the language named. A
    text is rejected if its cross-entropy, less three standard errors at its length, is beyond
    the calibrated limit.
    """
    ce, lengths, letters = cross_entropies(texts, model)
    if not model.langs:
        none = np.zeros(len(texts))
        return [UNKNOWN] * len(texts), none, none, np.ones(len(texts), bool)
    best = ce.argmin(1)
    least = ce[np.arange(len(ce)), best]
    score = 1 / np.exp(-(ce - least[:, None]) * model.temperature).sum(1)
    blank = letters == 0
    score[blank] = 0
    far = least - 3 * model.spread / np.sqrt(np.maximum(lengths, 1)) > model.limit
    return [UNKNOWN if b else model.langs[i] for i, b in zip(best, blank, strict=True)], score, least, far | blank


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS,
    order: int = ORDER,
) -> Model:
    """Fits the models on a sample of the rows that have a text and a language.

    The counts by language set each language's share of ``sample_docs``; a row is drawn if a hash of
    its id is under the share. The driver gets the sample alone.
    """
    known = docs.select(
        F.col(id_col).cast("string").alias("id"),
        F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
    ).where("lang IS NOT NULL")
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], order)
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, sample_docs / len(counts) / n)))])
    drawn = known.where("text IS NOT NULL").where(
        F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) < F.get(F.array(F.try_element_at(share, F.col("lang"))), F.lit(0)) * (1 << 20)
    )
    rows = drawn.orderBy(F.xxhash64("id"), "id", "text").toArrow()
    return fit(rows.column("text").to_pylist(), rows.column("lang").to_pylist(), order)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, rejected), a row for each row; the text's other columns aren't read.

    See ``classify`` for null, empty and wordless texts; ids may be null or repeat.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(parts):
        own = shared.value
        for part in (p for whole in parts for p in slices(whole, 1)):
            names, score, least, rejected = classify(part.column(1).to_pylist(), own)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(names, pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array(least, pa.float64()),
                    pa.array(rejected, pa.bool_()),
                ],
                names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"],
            )

    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(kept.dtypes)["doc_id"]
    return kept.mapInArrow(batches, f"doc_id {kind}, lang_pred string, score double, cross_entropy double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows that are rejected; a null language becomes the predicted one. Other columns pass through."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def batches(parts):
        own = shared.value
        for part in (p for whole in parts for p in slices(whole, at)):
            names, _, _, rejected = classify(part.column(at).to_pylist(), own)
            kind = part.schema.field(lang_at).type
            columns = [pc.coalesce(c, pa.array(names, kind)) if j == lang_at else c for j, c in enumerate(part.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(pa.array(~rejected, pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)
