"""Whitening against a dense eigendecomposition, with exact integers for counts and deviations."""

import math

import numpy as np
import pytest

from timberline.llm import whitening
from timberline.llm.queries import QUERIES
from timberline.llm.whitening import fit_whitening, integer_vectors, whitened_embeddings

SCHEMA = "vec_id long, embedding array<float>, x string, n long, component string"


def frame(spark, vectors, kind="float"):
    return spark.createDataFrame([(k, v, "x", 1, "c") for k, v in vectors], SCHEMA.replace("float", kind))


def plain(vectors):
    """(n, sums, eigenvalues, eigenvectors, trace, vec_id -> integers) of usable vectors of the commonest length."""
    good = [(k, [math.floor(256.0 * c) for c in v]) for k, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = [len(x) for _, x in good]
    size = max(set(sizes), key=lambda s: (sizes.count(s), s))
    good = [(k, x) for k, x in good if len(x) == size]
    fit = sorted({tuple(x) for _, x in good})
    sums = [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array(fit, float) - np.array([s / len(fit) for s in sums])
    covariance = centred.T @ centred / len(fit)
    values, basis = np.linalg.eigh(covariance)
    return len(fit), sums, values[::-1], basis[:, ::-1], float(np.trace(covariance)), good


def check(found, vectors, components=4):
    n, sums, values, basis, trace, good = plain(vectors)
    some = min(components, int((values > 1e-12 * values[0]).sum()))
    assert len(found) == some * len(good)
    by = {}
    for r in found:
        by.setdefault((r.vec_id, r.component), []).append(r)
    signs = {}
    for vec_id, x in good:
        for c in range(some):
            rows = by[vec_id, c + 1]
            z = float((np.array(x) - np.array([s / n for s in sums])) @ basis[:, c] / np.sqrt(values[c]))
            r = min(rows, key=lambda r: abs(abs(r.whitened) - abs(z)))
            assert abs(r.whitened) == pytest.approx(abs(z), abs=1e-9)
            if abs(z) > 1e-6:
                signs.setdefault(c, set()).add(np.sign(z) == np.sign(r.whitened))
            deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
            assert (r.n, r.deviation) == (n, deviation if deviation < 1 << 63 else None)
            assert r.explained == pytest.approx(values[c] / trace, rel=1e-9) and 0 <= r.identity_error < 1e-9
    assert all(len(s) == 1 for s in signs.values())
    assert len({r.identity_error for r in found}) == 1


def test_query_equals_dense(spark, data):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    check(QUERIES["op13_embedding_whitening"](spark, data).collect(), rows)


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    vectors = [(k, [float(c) for c in rng.normal(size=6) * [3, 2, 1.5, 1, 0.5, 0.1]]) for k in range(60)]
    vectors += [(k, vectors[0][1]) for k in range(100, 140)]  # repeats
    vectors += [(200, None), (201, []), (202, [1.0] * 5), (203, [None, *[1.0] * 5]), (204, [float("nan"), *[1.0] * 5]), (205, [float("inf"), *[1.0] * 5]), (206, [float("-inf")] * 6), (207, [-0.0] * 6), (208, [1.0] * 7)]
    check(whitened_embeddings(frame(spark, vectors)).collect(), vectors)
    found = whitened_embeddings(frame(spark, [(None, v) for _, v in vectors])).collect()
    assert len(found) == 4 * (60 + 40 + 1) and all(r.vec_id is None for r in found)


@pytest.mark.parametrize("rank", [1, 2, 3])
def test_fewer_components_than_wanted(spark, rank):
    rng = np.random.default_rng(rank)
    vectors = [(k, [float(c) for c in np.append(rng.integers(-4, 5, rank) * np.arange(1, rank + 1), [2.0] * 5)]) for k in range(40)]
    check(whitened_embeddings(frame(spark, vectors)).collect(), vectors)


def test_huge_entries(spark):
    vectors = [(k, [1e4 * math.sin(k), 1e3 * math.cos(3 * k), 1e300 if k % 2 else 1.0]) for k in range(20)]
    found = whitened_embeddings(frame(spark, vectors, "double")).collect()
    assert len(found) % 20 == 0 and found and all(r.deviation is None for r in found)
    vectors = [(k, [3e6 * math.sin(k), 1e5 * math.cos(3 * k), 1.0]) for k in range(20)]
    check(whitened_embeddings(frame(spark, vectors, "double")).collect(), vectors)


def test_no_variance(spark):
    for vectors in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        assert whitened_embeddings(frame(spark, vectors)).count() == 0


def test_flat_spectrum_grows_the_block(spark, monkeypatch):
    """Without extra columns the fifth component is nearly as large as the fourth, so rounds run out and the block widens."""
    monkeypatch.setattr(whitening, "EXTRA", 0)
    monkeypatch.setattr(whitening, "ROUNDS", 2)
    rng = np.random.default_rng(5)
    vectors = [(k, [float(c) for c in rng.normal(size=12)]) for k in range(300)]
    check(whitened_embeddings(frame(spark, vectors)).collect(), vectors)


def test_passes_and_plan(spark):
    rng = np.random.default_rng(9)
    vectors = integer_vectors(frame(spark, [(k, [float(c) for c in rng.normal(size=48) * np.linspace(4, 0.2, 48)]) for k in range(200)]))
    model = fit_whitening(vectors)
    assert model.residual <= whitening.SURE and 2 < model.passes < 80 and model.basis.shape == (48, 4)
