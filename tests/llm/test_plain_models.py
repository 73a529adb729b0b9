"""Results of operators that SQL can't express, against plain versions of the whole computation."""

import bisect
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import ODD
from plain import AZ, words

from timberline.llm import decontaminate as dc
from timberline.llm import language_id as li
from timberline.llm import quality as q
from timberline.llm._text import content_hashes
from timberline.llm.queries import QUERIES


def letter_runs(text):
    return re.findall(rb"[a-z\x80-\xff]+", (text or "").translate(AZ).encode())


def slots_of(word):
    """The slots of a word's trigrams, and its own."""
    padded = b"  " + word + b" "
    trigrams = [((int.from_bytes(padded[k : k + 3], "big") * 0x9E3779B1) & 0xFFFFFFFF) >> 16 for k in range(len(padded) - 2)]
    hashed = content_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0]
    return trigrams, li.TRIGRAMS + int(hashed >> np.uint64(48))


def script_of(word):
    starts = [cp for cp, _ in li.SCRIPT_STARTS]
    return li.SCRIPTS.index(li.SCRIPT_STARTS[bisect.bisect_right(starts, ord(word.decode()[0])) - 1][1])


def plain_language_tables(rows):
    langs = sorted({lang for _, lang in rows})
    counts = np.zeros((li.SLOTS, len(langs)))
    for text, lang in rows:
        for word in letter_runs(text):
            trigrams, own = slots_of(word)
            for slot in [*trigrams, own, li.TRIGRAMS + li.WORDS + script_of(word)]:
                counts[slot, langs.index(lang)] += 1
    logs = []
    for first, last, weight in ((0, li.TRIGRAMS, 1.0), (li.TRIGRAMS, li.TRIGRAMS + li.WORDS, 0.5)):
        smoothed = np.log((counts[first:last] + 0.5) / (counts[first:last] + 0.5).sum(axis=0))
        logs.append(weight * (smoothed - smoothed.mean(axis=1, keepdims=True)))
    scripts = counts[li.TRIGRAMS + li.WORDS :]
    seen = scripts >= 0.001 * np.maximum(1, scripts.sum(axis=0))
    return langs, np.concatenate(logs), [row if row.any() else np.ones(len(langs), bool) for row in seen]


def plain_language(text, langs, logs, seen, penalty=8.0):
    """(language, score) of a text by Viterbi over its words, one step at a time."""
    found, best, back = letter_runs(text), [], []
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    scores = []
    for word in found:
        trigrams, own = slots_of(word)
        scores.append(logs[[*trigrams, own]].sum(axis=0) + np.where(seen[script_of(word)], 0, -1000))
    for t, score in enumerate(scores):
        came = [max(range(len(langs)), key=lambda p, k=k: (best[p] - penalty * (p != k), p == k)) for k in range(len(langs))] if t else [0] * len(langs)
        best = [(best[came[k]] - penalty * (came[k] != k) if t else 0) + score[k] for k in range(len(langs))]
        back.append(came)
    label, letters = int(np.argmax(best)), np.zeros(len(langs))
    for t in range(len(found) - 1, -1, -1):
        letters[label] += len(found[t])
        label = back[t][label]
    total = np.sum(scores, axis=0) * min(len(found), 20) / len(found)
    likely = np.exp(total - total.max())
    k = int(letters.argmax())
    return langs[k], letters[k] / letters.sum() * likely[k] / likely.sum()


def test_languages_are_those_of_a_plain_decoder(spark, data, documents):
    rows = documents.select("doc_id", "text", "lang").collect()
    fold = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 3 for r in rows}
    langs, logs, seen = plain_language_tables([(r.text, r.lang) for r in rows if r.lang is not None and fold[r.doc_id] != 1])
    found = {r.doc_id: r for r in QUERIES["op7_language_id"](spark, data).collect()}
    asked = [r for r in rows if fold[r.doc_id] == 1][:50]
    for r in asked:
        name, score = plain_language(r.text, langs, logs, seen)
        assert found[r.doc_id].held_out and found[r.doc_id].lang_pred == name and found[r.doc_id].score == pytest.approx(score, abs=1e-3)


def plain_statistics(text):
    raw = (text or "").encode()
    size, own = len(raw), words(text)
    n = len(own)
    cased = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    symbol = lambda c: 0x21 <= c < 0x7F and not chr(c).isalnum() and chr(c) not in ".,;:?!'\"-"
    mark = lambda c: symbol(c) or chr(c) in ".,;:?!"
    share = lambda count: (count + 0.5) / (size + 20)

    def logit(x):
        x = min(max(x, 1e-4), 1 - 1e-4)
        return math.log(x / (1 - x))

    breaks = share(raw.count(b"\n"))
    return [
        math.log1p(size), math.log1p(n), math.log1p(size / max(1, n)),
        logit(share(sum(0x41 <= c <= 0x5A for c in raw))), logit(share(sum(0x30 <= c <= 0x39 for c in raw))), logit(share(sum(map(symbol, raw)))),
        logit(share(raw.count(b"!"))), logit(share(sum(c in b".,;:?" for c in raw))), logit(share(sum(c >= 0x80 for c in raw))), logit(breaks),
        logit((len(set(own)) + 1) / (n + 2)), logit((len(set(zip(own, own[1:], strict=False))) + 1) / (max(0, n - 1) + 2)), logit((max(Counter(own).values(), default=0) + 0.5) / (n + 10)),
        logit((sum(symbol(w[-1]) or w[-1] == 0x21 for w in cased) + 0.5) / (n + 10)), logit(share(sum(a == b and mark(b) for a, b in zip(raw, raw[1:], strict=False)))),
        math.log1p(size * (1 - breaks) / (size * breaks + 1)),
    ]


def test_statistics_are_those_of_each_text_alone(spark):
    """Against plain counts; texts next to one another in a batch don't touch."""
    texts = [t for _, t, *_ in ODD] + ["wow!!", "!! so it goes ??", "??", "a-b = c == d;;\n\n$$ 12", "", "#", "# x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r.x for r in q.document_statistics(docs).collect()}
    for k, text in enumerate(texts):
        assert dict(zip(q.STATISTICS, found[k], strict=True)) == pytest.approx(dict(zip(q.STATISTICS, plain_statistics(text), strict=True)), abs=1e-6)


def plain_quality(rows, labels):
    """doc_id -> score by two Gaussians, of (doc_id, text) rows and (doc_id, label) rows to learn from."""
    x = {d: np.array(plain_statistics(t)) for d, t in rows}
    mine = {k: np.array([x[d] for d, label in labels if label == k]) for k in (0, 1)}
    scatter = {k: (v - v.mean(axis=0)).T @ (v - v.mean(axis=0)) for k, v in mine.items()}
    total = len(mine[0]) + len(mine[1])
    pooled = (scatter[0] + scatter[1]) / total
    out = {}
    for d, v in x.items():
        logs = {}
        for k in (0, 1):
            own = 0.98 * (0.9 * scatter[k] / len(mine[k]) + 0.1 * pooled) + 0.02 * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(v))
            away = v - mine[k].mean(axis=0)
            logs[k] = math.log(len(mine[k]) / total) - 0.5 * (away @ np.linalg.solve(own, away) + np.linalg.slogdet(own)[1])
        out[d] = 1 / (1 + math.exp(-min(max(logs[1] - logs[0], -60), 60)))
    return out


def test_quality_scores_are_those_of_a_plain_discriminant(spark, data, documents, tmp_path):
    """Through the query: labels that are null, other than 0 and 1, repeated, contradictory or of no document; documents that have none."""
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()][:300] + [(-1, None), (-2, ""), (-3, "z" * 500)]
    given = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "quality").collect()]
    known = {d for d, _ in rows}
    ids = sorted(d for d, _ in given if d in known)
    labels = [(d, None if k % 7 == 0 else 2 if k % 11 == 0 else q_) for k, (d, q_) in enumerate(given) if k % 5]
    labels += [(ids[0], 0), (ids[0], 1), (ids[1], 1), (ids[1], 1), (-1, 0), (-3, 1), (10**12, 1), (None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    out_of_fold = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    learned = [(d, label) for d, label in labels if d in known and label in (0, 1) and not out_of_fold(d)]
    assert {0, 1} == {label for _, label in learned} and len(learned) < len(labels) - 20
    expected = plain_quality(rows, learned)
    found = QUERIES["op4_quality"](spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.score == pytest.approx(expected[r.doc_id], abs=1e-6) and r.held_out == out_of_fold(r.doc_id)
        assert r.predicted == (expected[r.doc_id] >= 0.3) or abs(expected[r.doc_id] - 0.3) < 1e-6


def test_leaks_are_those_of_aligning_all_pairs(spark, data, texts):
    """Every document is aligned with every item; pairs with too few words in common for half a score are passed over."""
    items = {r.item_id: r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    number = {}
    coded = lambda text: np.array([number.setdefault(w, len(number)) for w in re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").translate(AZ).encode())], np.uint64)
    sequences = {k: coded(t) for k, t in items.items()}
    assert min(map(len, sequences.values())) >= 2 * dc.SURE
    expected = set()
    for d, text in texts.items():
        own = coded(text)
        held = set(own.tolist())
        for k, item in sequences.items():
            if 2 * sum(w in held for w in item.tolist()) >= len(item) and dc.align(item, own)[0] >= len(item):
                expected.add((d, k))
    found = {(r.doc_id, r.item_id) for r in QUERIES["op10_decontamination"](spark, data).collect()}
    assert found <= expected and len(found) >= 0.99 * len(expected) > 0
