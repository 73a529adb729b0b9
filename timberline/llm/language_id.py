"""Language identification with script ranges and Viterbi decoding.

Training counts, per language, the byte trigrams of words (with word edges),
whole words and the scripts that words start with, all hashed into tables of a
fixed size; the counts cover every training row and are summed by Spark. A
word of a text gets from each language the smoothed log probability of its
trigrams and of itself. The script of its first letter narrows the candidates
to the languages that were seen with that script. Viterbi decoding with a
penalty for switching then labels every word, so that mixed text comes out as
spans; a document's language is the one with the most letters under it.

Words are runs of ASCII letters and of bytes above 0x7F, after lower-casing
A-Z. The model takes 1 MB a language (``SLOTS`` counts), whatever the corpus.

Defined results: a null text, or one without a letter, is ``und`` with score
0; so is every text if nothing was learned. Rows whose lang is null are not
learned from. Ties go to the language that sorts first. More than
``MAX_LANGUAGES`` different lang values are refused with an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import blocks, content_hashes, text_blocks

#: First code points of Unicode script ranges (fixed values); 'other' fills the gaps.
SCRIPT_STARTS = [
    (0x0000, "other"), (0x0041, "latin"), (0x005B, "other"), (0x0061, "latin"), (0x007B, "other"), (0x00C0, "latin"), (0x0250, "other"),
    (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"),
    (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1400, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})
_STARTS = np.array([cp for cp, _ in SCRIPT_STARTS])
_NAMES = np.array([SCRIPTS.index(name) for _, name in SCRIPT_STARTS])

TRIGRAMS = WORDS = 1 << 16
SLOTS = TRIGRAMS + WORDS + len(SCRIPTS)
#: Viterbi runs over this many bytes of documents at once.
DECODE_BYTES = 4 << 20
#: The most languages a model has: it is 1 MB a language, in the driver and in each task.
MAX_LANGUAGES = 500

LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x61:0x7B] = True
LETTERS[0x80:] = True


def _words(data: np.ndarray, offsets: np.ndarray):
    """Start, end, row and script of every run of letter bytes."""
    inside = LETTERS[data]
    n = len(data)
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | first[1:n]
    closes[:-1] &= ~inside[1:] | first[1:n]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    tail = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
    a, b, c, d = tail[starts], tail[starts + 1] & 63, tail[starts + 2] & 63, tail[starts + 3] & 63
    points = np.where(a < 0x80, a, np.where(a < 0xE0, (a & 31) << 6 | b, np.where(a < 0xF0, (a & 15) << 12 | b << 6 | c, (a & 7) << 18 | b << 12 | c << 6 | d)))
    return starts, ends, rows, _NAMES[np.searchsorted(_STARTS, points, side="right") - 1], opens, inside


def _features(data: np.ndarray, offsets: np.ndarray):
    """Words as from _words, the slot of the trigram ending at each letter byte, of the one at each word's end, and of each word."""
    starts, ends, rows, scripts, opens, inside = _words(data, offsets)
    wide = data.astype(np.uint32)
    one, two = np.full(len(data), 32, np.uint32), np.full(len(data), 32, np.uint32)
    one[1:] = np.where(opens[1:], 32, wide[:-1])
    second = np.zeros(len(data), dtype=bool)
    second[1:] = opens[:-1]
    two[2:] = np.where(opens[2:] | second[2:], 32, wide[:-2])

    def slot(x, y, z):
        return ((x << np.uint32(16) | y << np.uint32(8) | z) * np.uint32(0x9E3779B1)) >> np.uint32(16)

    last = ends - 1
    return starts, ends, rows, scripts, inside, slot(two, one, wide), slot(one[last], wide[last], np.uint32(32)), TRIGRAMS + (content_hashes(data, starts, ends) >> np.uint64(48)).astype(np.int64)


def count_features(rows: DataFrame) -> DataFrame:
    """(lang, slot, n): feature counts of (text, lang) rows, summed over all of them."""

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            names = sorted(set(langs.tolist()))
            codes = np.searchsorted(np.array(names, dtype=object), langs) if names else np.zeros(0, int)
            for a, b, block, cuts in text_blocks(batch.column("text")):
                starts, ends, doc, scripts, inside, tri, tri_end, word = _features(block, cuts)
                of_byte = np.repeat(codes[a:b], np.diff(cuts))
                of_word = codes[a:b][doc]
                for code, name in enumerate(names):
                    mine = of_word == code
                    if mine.any():
                        total = totals.setdefault(name, np.zeros(SLOTS, np.int64))
                        total[:TRIGRAMS] += np.bincount(tri[inside & (of_byte == code)], minlength=TRIGRAMS) + np.bincount(tri_end[mine], minlength=TRIGRAMS)
                        total += np.bincount(word[mine], minlength=SLOTS)
                        total[TRIGRAMS + WORDS :] += np.bincount(scripts[mine], minlength=len(SCRIPTS))
        for name, total in totals.items():
            slots = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(slots), pa.string()), pa.array(slots, pa.int32()), pa.array(total[slots])], ["lang", "slot", "n"])

    return rows.mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Log probabilities by slot and language, and the scripts a language is seen with."""

    def __init__(self, langs: list[str], counts: np.ndarray, smoothing: float = 0.5, script_share: float = 0.001):
        self.langs = langs
        self.scores = np.zeros((SLOTS, len(langs)), dtype=np.float32)
        self.barred = np.zeros((len(SCRIPTS), len(langs)), dtype=np.float32)
        if not langs:
            return
        for part, weight in ((slice(0, TRIGRAMS), 1.0), (slice(TRIGRAMS, TRIGRAMS + WORDS), 0.5)):
            c = counts[part].astype(float) + smoothing
            logs = np.log(c / c.sum(axis=0))
            self.scores[part] = weight * (logs - logs.mean(axis=1, keepdims=True))
        scripts = counts[TRIGRAMS + WORDS :].astype(float)
        seen = scripts >= script_share * np.maximum(1, scripts.sum(axis=0))
        seen[~seen.any(axis=1)] = True
        self.barred = np.where(seen, 0, -1000).astype(np.float32)

    @classmethod
    def learn(cls, rows: DataFrame, **options) -> LanguageModel:
        """From (text, lang) rows; brings SLOTS numbers a language to the driver, of MAX_LANGUAGES at most."""
        rows = rows.where(F.col("lang").isNotNull()).select("text", "lang")
        if rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages to learn: clean the lang column first")
        found = count_features(rows).toArrow()
        names = found["lang"].to_pylist()
        langs = sorted(set(names))
        counts = np.zeros((SLOTS, len(langs)), np.int64)
        at = {name: k for k, name in enumerate(langs)}
        counts[found["slot"].to_numpy(), [at[x] for x in names]] = found["n"].to_numpy()
        return cls(langs, counts, **options)

    def word_scores(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, rows, scripts, inside, tri, tri_end, word = _features(data, offsets)
        out = np.empty((len(starts), len(self.langs)), np.float32)
        total = np.zeros(len(data) + 1)
        for k in range(len(self.langs)):
            column = self.scores[:, k]
            np.cumsum(np.where(inside, column[tri], 0), out=total[1:])
            out[:, k] = total[ends] - total[starts] + column[tri_end] + column[word]
        return starts, ends, rows, out + self.barred[scripts]


def viterbi(scores: np.ndarray, firsts: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word when every switch costs ``penalty``.

    Row t of a document is scores[first + t]. All documents advance together,
    the longest first, so the loops run over positions and not over words.
    """
    order = np.argsort(-lengths, kind="stable")
    firsts, lengths = firsts[order], lengths[order]
    labels = np.zeros(len(scores), dtype=np.int16)
    steps = int(lengths.max(initial=0))
    if not steps:
        return labels
    active = np.searchsorted(-lengths, -np.arange(steps + 1), side="left")  # documents with more than t words
    stay, best = np.ones(scores.shape, dtype=bool), np.zeros(len(scores), dtype=np.int16)
    now = np.zeros(active[0], dtype=np.int16)
    value = scores[firsts[: active[0]]].astype(np.float64)
    for t in range(steps):
        if t:
            at, value = firsts[: active[t]] + t, value[: active[t]]
            top = value.argmax(axis=1)
            jump = (value[np.arange(len(top)), top] - penalty)[:, None]
            stay[at], best[at] = value >= jump, top
            value = np.maximum(value, jump) + scores[at]
        ended = slice(active[t + 1], active[t])
        now[ended] = value[ended].argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        at, held = firsts[: active[t]] + t, now[: active[t]]
        labels[at] = held
        if t:
            now[: active[t]] = np.where(stay[at, held], held, best[at])
    return labels


SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])


def _decode(model: LanguageModel, data: np.ndarray, offsets: np.ndarray, penalty: float, spans: bool):
    """Language code, score and spans of each document."""
    docs, states = len(offsets) - 1, len(model.langs)
    parts = []
    for a, b in blocks(offsets):
        starts, ends, rows, scores = model.word_scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        parts.append((starts + offsets[a], ends + offsets[a], rows + a, scores))
    starts, ends, rows, scores = (np.concatenate([p[k] for p in parts]) for k in range(4))
    lengths = np.bincount(rows, minlength=docs)
    labels = viterbi(scores, np.cumsum(lengths) - lengths, lengths, penalty)
    letters = np.bincount(rows * states + labels, weights=ends - starts, minlength=docs * states).reshape(docs, states)
    code = letters.argmax(axis=1)
    share = letters[np.arange(docs), code] / np.maximum(1, letters.sum(axis=1))
    total = np.stack([np.bincount(rows, weights=scores[:, k], minlength=docs) for k in range(states)], axis=1)
    total *= (np.minimum(lengths, 20) / np.maximum(1, lengths))[:, None]
    likely = np.exp(total - total.max(axis=1, keepdims=True))
    score = share * likely[np.arange(docs), code] / np.maximum(likely.sum(axis=1), 1e-300)
    if not spans:
        return code, score, None
    opens = np.flatnonzero(np.diff(rows, prepend=-1).astype(bool) | np.diff(labels, prepend=-1).astype(bool))
    closes = np.append(opens[1:], len(rows))[: len(opens)] - 1
    per_doc = np.bincount(rows[opens], minlength=docs)
    items = pa.StructArray.from_arrays([pa.array(starts[opens] - offsets[rows[opens]], pa.int32()), pa.array(ends[closes] - offsets[rows[opens]], pa.int32()), pa.array([model.langs[x] for x in labels[opens]], pa.string())], fields=list(SPAN))
    return code, score, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_doc)]), pa.int32()), items)


def _labels(model: LanguageModel, texts: pa.Array, lettered: np.ndarray, penalty: float, spans: bool):
    """(first row, last row, names, scores, spans) of a batch, in runs of DECODE_BYTES."""
    for a, b, data, offsets in text_blocks(texts, size=DECODE_BYTES):
        if model.langs:
            code, score, found = _decode(model, data, offsets, penalty, spans)
            yield a, b, np.where(lettered[a:b], np.array(model.langs, dtype=object)[code], "und"), np.where(lettered[a:b], score, 0.0), found
        else:
            yield a, b, np.full(b - a, "und", dtype=object), np.zeros(b - a), pa.array([[]] * (b - a), pa.list_(SPAN))


def _received(shared) -> LanguageModel:
    model = LanguageModel.__new__(LanguageModel)
    model.langs, model.scores, model.barred = shared.value
    return model


def identify_language(docs: DataFrame, model: LanguageModel, penalty: float = 8.0, spans: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and, if asked for, spans (byte ranges with their language) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.scores, model.barred))
    schema = "doc_id long, lang_pred string, score double" + (", spans array<struct<start:int,end:int,lang:string>>" if spans else "")

    def run(batches):
        here = _received(shared)
        for batch in batches:
            lettered = np.array(batch.column("lettered").to_pylist(), dtype=bool)
            for a, b, names, scores, found in _labels(here, batch.column("text"), lettered, penalty, spans):
                columns = [batch.column("doc_id")[a:b], pa.array(names, pa.string()), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns + [found] * spans, ["doc_id", "lang_pred", "score"] + ["spans"] * spans)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _lettered(text_col).alias("lettered")).mapInArrow(run, schema)


def _lettered(text_col: str):
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def label_identified(docs: DataFrame, model: LanguageModel, penalty: float = 8.0, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, that identify_language doesn't call ``und``, with its label for their language.

    A text is ``und`` if it has no letter. Where nothing was learned every
    text is ``und``, which tells nothing of it: then rows without a letter go,
    and the others keep the language they came with. Rows stay where they are:
    texts pass through the task that labels them.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.scores, model.barred))
    mark = "lettered"
    while mark in docs.columns:
        mark += "_"

    def run(batches):
        here = _received(shared)
        for batch in batches:
            lettered = np.array(batch.column(mark).to_pylist(), dtype=bool)
            rows = batch.select([n for n in batch.schema.names if n != mark])
            at = rows.schema.get_field_index(lang_col)
            for a, b, names, _, _ in _labels(here, batch.column(text_col), lettered, penalty, False):
                part = rows[a:b]
                if here.langs:
                    part = part.set_column(at, part.schema.field(at), pa.array(names, part.schema.field(at).type))
                yield part.filter(pa.array(names != "und" if here.langs else lettered[a:b]))

    return docs.withColumn(mark, _lettered(text_col)).mapInArrow(run, docs.schema)
