import math
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import ODD
from plain import words
from pyspark.sql import functions as F

from timberline.llm import language_id as li
from timberline.llm import lm_scoring as lm
from timberline.llm import quality as q
from timberline.llm._spark import in_fold
from timberline.llm.queries import QUERIES


def fold(d, mod):
    return zlib.crc32(str(d).encode()) % mod


def plain_language_model(texts, trained):
    """Counts and mixture weights learned token by token, and P(word | context)."""
    tokens = {d: [*words(t), None] for d, t in texts.items()}
    one, two = Counter(), Counter()
    for d, ws in tokens.items():
        if trained(d):
            one.update(ws)
            two.update(zip([None, *ws[:-1]], ws, strict=True))
    n, v = sum(one.values()), len(one)
    octave = lambda c: 0 if c <= 0 else min(1 + int(math.log2(c)), lm.OCTAVES - 1)
    left_out = Counter()
    for (context, w), times in two.items():  # every training token, with itself left out of the counts
        c = one[context] - 1
        left_out[octave(c), (times - 1) / c if c > 0 else 0.0, (one[w] - 1) / (n - 1)] += times
    weights = np.tile([0.4, 0.4, 0.2], (lm.OCTAVES, 1))
    weights[0] = [0, 0.8, 0.2]
    for _ in range(60):
        sums = np.zeros((lm.OCTAVES, 3))
        for (k, pair, word), times in left_out.items():
            each = weights[k] * [pair, word, 1 / (v + 1)]
            sums[k] += times * each / each.sum()
        seen = sums.sum(axis=1) > 0
        sums[:, 2] += 1e-3
        weights = np.where(seen[:, None], sums / sums.sum(axis=1, keepdims=True), weights)
    for k in range(2, lm.OCTAVES):
        if not seen[k] and seen[1:k].any():
            weights[k] = weights[k - 1]

    def p(w, context):
        a2, a1, a0 = weights[octave(one[context])]
        return a2 * two[context, w] / max(1, one[context]) + a1 * one[w] / n + a0 / (v + 1)

    return tokens, one, n, v, p


def test_language_model_counts_and_scores(spark, data, texts):
    """Against the plain model: the query's EM works on estimates rounded to an eighth of an octave."""
    found = {r.doc_id: r for r in QUERIES["op1_lm_scoring"](spark, data).collect()}
    tokens, counts, n, v, p = plain_language_model(texts, lambda d: fold(d, 7) != 2)
    for d, ws in tokens.items():
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        score = sum(math.log10(p(w, context)) for context, w in zip([None, *ws[:-1]], ws, strict=True))
        r = found[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(d, 7) == 2, len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=5e-3)
    held = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and all(r.score < 0 for r in held)


def test_interpolated_probabilities_sum_to_one(spark):
    """P(w | context) over the whole vocabulary and one unknown word, read from differences of scores."""
    train = ["a b a", "b", "a", "c", "b c", "a b c a b", "d a"]
    ends, vocabulary = ["a", "b", "c", "d", "zz"], ["a", "b", "c", "d"]
    # The score of "x" is log P(x | end) + log P(end | x), that of "x y" adds log P(y | x) and swaps the last factor.
    asked = [*vocabulary, "zz", ""] + [f"{x} {y}" for x in vocabulary for y in ends]
    docs = spark.createDataFrame([(k, t, True) for k, t in enumerate(train)] + [(100 + k, t, False) for k, t in enumerate(asked)], "doc_id long, text string, train boolean")
    score = {asked[r.doc_id - 100]: r.score for r in lm.score_documents(docs, F.col("train")).collect() if r.doc_id >= 100}
    _, one, n, v, p = plain_language_model(dict(enumerate(train)), lambda d: True)
    for x in [*vocabulary, None]:
        assert sum(p(w, x) for w in [*vocabulary, None]) + p("zz", x) == pytest.approx(1.0, abs=1e-9)
    for x in vocabulary:
        # Sum over y of P(y | x), each from the scores: P(y | x) = 10 ** (score(x y) - score(x)) * P(end | x) / P(end | y)
        total = sum(10 ** (score[f"{x} {y}"] - score[x]) * p(None, x) / p(None, y) for y in ends)
        assert total + p(None, x) == pytest.approx(1.0, rel=0.05)
    cells = np.array([(3 * lm.BINS + 200) * lm.BINS + 180, (3 * lm.BINS + 0) * lm.BINS + 150, (5 * lm.BINS + 190) * lm.BINS + 170])
    weights = lm.learn_weights(cells, np.array([50.0, 20.0, 30.0]))
    assert np.allclose(weights.sum(axis=1), 1) and (weights >= 0).all() and weights[0, 0] == 0


def test_deleted_estimates_leave_the_token_out(spark):
    evidence = spark.createDataFrame([(True, lm.pack(np.array([3, 1])), lm.pack(np.array([2, 1])))], "train boolean, one binary, two binary")
    found = {tuple(np.unravel_index(r.cell, (lm.OCTAVES, lm.BINS, lm.BINS))): r.n for r in lm.deleted_estimates(evidence, 10, 4).collect()}
    # first token: context is the end token, seen once, so nothing is left of it; second: context seen 3 times, its own pair and word only once
    assert found == {(0, 0, int(lm._bin(np.array([2 / 9 * 5]))[0])): 1, (2, 0, 0): 1}


@pytest.mark.parametrize("values", [[], [0], [1, 255, 256, 2**40], [2**63]])
def test_packing(values):
    assert lm.unpack(lm.pack(np.array(values, dtype=np.uint64))).tolist() == values


def test_lm_odd_rows(odd, none):
    found = lm.score_documents(odd, ~in_fold(F.col("doc_id"), 7, 2)).collect()
    assert len(found) == len(ODD) and {r.n_tokens for r in found if r.doc_id in (1, 2, 3)} == {1}
    assert [r.held_out for r in found if r.doc_id is None] == [False, False]
    assert lm.score_documents(none, F.lit(True)).count() == 0
    untrained = lm.score_documents(odd.where("doc_id = 4"), F.lit(False)).first()
    assert (untrained.train_tokens, untrained.n_known, untrained.score) == (0, 0, 0.0)


def test_language_accuracy(spark, data, documents):
    truth = {r.doc_id: r.lang for r in documents.collect()}
    held = [r for r in QUERIES["op7_language_id"](spark, data).collect() if r.held_out]
    right = sum(r.lang_pred == truth[r.doc_id] for r in held)
    assert right / len(held) > 0.95 and all(0 <= r.score <= 1 for r in held)


def test_viterbi_matches_brute_force():
    rng = np.random.default_rng(3)
    lengths = np.array([4, 0, 1, 6])
    scores = rng.normal(size=(11, 3)).astype(np.float32)
    labels = li.viterbi(scores, np.cumsum(lengths) - lengths, lengths, 0.7)
    from itertools import product

    for first, n in zip(np.cumsum(lengths) - lengths, lengths, strict=True):
        def value(path, s=scores[first : first + n]):
            return sum(s[t, x] for t, x in enumerate(path)) - 0.7 * sum(a != b for a, b in zip(path, path[1:], strict=False))

        if n:
            assert value(labels[first : first + n]) == pytest.approx(max(map(value, product(range(3), repeat=int(n)))), abs=1e-5)


def test_mixed_language_spans(spark, documents):
    model = li.LanguageModel.learn(documents)
    en, de = (max((r.text for r in documents.where(F.col("lang") == x).collect()), key=len)[:1500] for x in ("en", "de"))
    both = spark.createDataFrame([(1, en + "\n" + de)], "doc_id long, text string")
    row = li.identify_language(both, model).first()
    assert row.spans[0].lang == "en" and row.spans[-1].lang == "de" and row.spans[0].start < 5
    turn = next(s.start for s in row.spans if s.lang == "de" and s.end - s.start > 500)
    assert abs(turn - len(en.encode())) < 200


def test_scripts_narrow_candidates(spark):
    rows = [("hello there my friend", "en"), ("привет мой друг", "ru"), ("γεια σου φίλε", "el")] * 30
    model = li.LanguageModel.learn(spark.createDataFrame(rows, "text string, lang string"))
    asked = spark.createDataFrame([(1, "незнакомые слова"), (2, "zzz qqq"), (3, "άγνωστο")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in li.identify_language(asked, model).collect()} == {1: "ru", 2: "en", 3: "el"}


def test_language_odd_rows(odd, none):
    model = li.LanguageModel.learn(odd)
    found = li.identify_language(odd, model).collect()
    undecided = {r.doc_id for r in found if r.lang_pred == "und"}
    assert len(found) == len(ODD) and undecided >= {1, 2, 3, 11} and {4, 9, 12}.isdisjoint(undecided)
    assert all(r.score == 0 and r.spans == [] for r in found if r.lang_pred == "und" and r.doc_id != 11)
    empty = li.LanguageModel.learn(none)
    assert {r.lang_pred for r in li.identify_language(odd, empty).collect()} == {"und"} and li.identify_language(none, model).count() == 0
    kept = li.label_identified(odd, model)
    labels = {(r.doc_id, r.lang_pred) for r in found if r.lang_pred != "und"}
    assert kept.columns == odd.columns and kept.count() == sum(r.lang_pred != "und" for r in found) and {(r.doc_id, r.lang) for r in kept.collect()} == labels


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(li, "MAX_LANGUAGES", 3)
    rows = spark.createDataFrame([("a word", f"l{i}") for i in range(4)], "text string, lang string")
    with pytest.raises(ValueError, match="more than 3 languages"):
        li.LanguageModel.learn(rows)
    assert li.LanguageModel.learn(rows.where("lang <> 'l0'")).langs == ["l1", "l2", "l3"]


def test_quality_accuracy(spark, data):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op4_quality"](spark, data).collect() if r.held_out and r.doc_id in truth]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert sum(r.predicted == truth[r.doc_id] for r in rows) / len(rows) > 0.9


def test_discriminant_matches_gaussian_densities():
    rng = np.random.default_rng(5)
    x = {0: rng.normal(size=(500, 3)), 1: rng.normal(1.0, 2.0, size=(800, 3))}
    model = q.Discriminant({k: (len(v), v.sum(0), v.T @ v) for k, v in x.items()}, to_pooled=0, to_diagonal=0)
    at = rng.normal(size=(50, 3))

    def log_density(k):
        cov = np.cov(x[k].T, bias=True)
        d = at - x[k].mean(0)
        return -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(len(x[k]) / 1300)

    assert np.allclose(model.scores(at), 1 / (1 + np.exp(log_density(0) - log_density(1))), atol=1e-4)


@pytest.mark.parametrize(("moments", "score"), [({}, 0.5), ({1: (5, np.ones(16), np.eye(16))}, 1.0), ({0: (5, np.ones(16), np.eye(16))}, 0.0)])
def test_one_class_or_none(moments, score):
    assert q.Discriminant(moments).scores(np.zeros((2, 16))).tolist() == [score, score]


def test_quality_odd_rows(odd, none):
    found = q.document_statistics(odd).collect()
    assert len(found) == len(ODD) and all(np.isfinite(r.x).all() and len(r.x) == len(q.STATISTICS) for r in found)
    assert q.score_quality(q.document_statistics(none), q.Discriminant({})).count() == 0
