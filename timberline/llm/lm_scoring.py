"""Language-model scoring by deleted interpolation of a word bigram model.

A text's tokens are its words and one end token. The probability of a token w
after v mixes three estimates::

    P(w | v) = a2 c(v w) / c(v)  +  a1 c(w) / N  +  a0 / (V + 1)

with weights (a2, a1, a0) for each octave of the context's count c(v). The end
token is also the context of a text's first token. Counts are over the
training rows. The weights are learned by expectation-maximisation on
held-out counts in the deleted sense: each training token is taken out of the
counts in turn, so its estimates are (c(v w) - 1) / (c(v) - 1) and
(c(w) - 1) / (N - 1). EM runs on a table of how many tokens have which
estimates (to an eighth of an octave), which all training tokens enter and
whose size does not depend on the corpus.

How counts get to tokens: documents are dealt into chunks of about 12 MB of
text. A chunk lists its different n-grams once, as sorted 64-bit hashes with
its own training counts, and sends them to buckets by hash range; a bucket adds
up all chunks' counts and answers each chunk in the chunk's own order. So a very
frequent n-gram reaches its bucket once per chunk, and lists travel as
differences of sorted hashes. The answers then meet the chunk's texts again.
There are as many buckets as chunks, so that the tasks of both keep their size
as the corpus grows. The pieces that chunks send get shorter then, but there
are never more of them than n-grams in the chunks' lists.

Defined results: a null or empty text is the end token alone; a row whose id is
null is learned from; rows that repeat an id are scored each; without training
rows all probability is uniform over one word (score 0). n-grams are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import chunk_count, discard, written
from ._text import mix64, text_blocks, word_hashes

END = np.uint64(0xE5D0E5D0E5D0E5D1)
STEPS = 8  # bins per octave
OCTAVES = 48  # context buckets; the last one is open
BINS = 64 * STEPS
KINDS = (0, 1)  # one word, two words


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, the low bytes of all first; high planes of zeros are left out."""
    planes = np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8).T
    used = 8 if not len(values) else max(1, -(-int(values.max()).bit_length() // 8))
    return bytes([used]) + planes[:used].tobytes()


def unpack(packed: bytes) -> np.ndarray:
    used, n = packed[0], (len(packed) - 1) // packed[0]
    out = np.zeros((n, 8), np.uint8)
    out[:, :used] = np.frombuffer(packed, np.uint8, offset=1).reshape(used, n).T
    return out.view("<u8").ravel()


class Tokens:
    """The tokens of a chunk: hashes with an end token after each row's words."""

    def __init__(self, texts):
        hashes, rows, docs = [], [], len(texts)
        for a, _, data, offsets in text_blocks(texts):
            h, r = word_hashes(data, offsets)
            hashes.append(h)
            rows.append(r + a)
        words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        of = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.counts = np.bincount(of, minlength=docs) + 1
        self.bounds = np.concatenate([[0], np.cumsum(self.counts)])
        self.row = np.repeat(np.arange(docs), self.counts)
        self.one = np.full(len(words) + docs, END)
        self.one[np.arange(len(words)) + of] = words
        before = np.roll(self.one, 1)  # the end token stands before every first token
        if docs:
            before[0] = END
        self.two = mix64(before * np.uint64(0x9FB21C651E98DF25) + self.one)

    def grams(self, kind: int) -> np.ndarray:
        return self.two if kind else self.one


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    """Ascends with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def _requests(buckets: int):
    def run(part: pa.Table) -> pa.Table:
        tokens = Tokens(part["text"])
        chunk, trained = part["chunk"][0].as_py(), part["train"].to_numpy()[tokens.row]
        out = {"bucket": [], "chunk": [], "kind": [], "grams": [], "counts": []}
        for kind in KINDS:
            order = np.argsort(tokens.grams(kind), kind="stable")
            ordered = tokens.grams(kind)[order]
            new = np.ones(len(ordered), dtype=bool)
            new[1:] = ordered[1:] != ordered[:-1]
            opens = np.flatnonzero(new)
            counts, grams = np.add.reduceat(trained[order].astype(np.int64), opens), ordered[opens]
            cuts = np.searchsorted(_bucket(grams, buckets), np.arange(buckets + 1))
            for bucket in np.flatnonzero(np.diff(cuts)).tolist():
                mine = slice(cuts[bucket], cuts[bucket + 1])
                for name, value in (("bucket", bucket), ("chunk", chunk), ("kind", kind), ("grams", pack(np.diff(grams[mine], prepend=np.uint64(0)))), ("counts", pack(counts[mine]))):
                    out[name].append(value)
        return pa.table({"bucket": pa.array(out["bucket"], pa.int32()), "chunk": pa.array(out["chunk"], pa.int32()), "kind": pa.array(out["kind"], pa.int32()), "grams": pa.array(out["grams"], pa.binary()), "counts": pa.array(out["counts"], pa.binary())})

    return run


def _answers(part: pa.Table) -> pa.Table:
    """A bucket's totals for each chunk's list; N and V of the bucket stand on its first row."""
    chunks, kinds = part["chunk"].to_numpy(), part["kind"].to_numpy()
    packed_grams, packed_counts = part["grams"].to_pylist(), part["counts"].to_pylist()
    answers: list[bytes] = [b""] * len(chunks)
    tokens, words = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
    for kind in KINDS:
        rows = np.flatnonzero(kinds == kind)
        if not len(rows):
            continue
        lists = [np.cumsum(unpack(packed_grams[i]), dtype=np.uint64) for i in rows]
        grams, inverse = np.unique(np.concatenate(lists), return_inverse=True)
        totals = np.zeros(len(grams), np.int64)
        np.add.at(totals, inverse, np.concatenate([unpack(packed_counts[i]) for i in rows]).astype(np.int64))
        cuts = np.cumsum([0, *map(len, lists)])
        for i, a, b in zip(rows.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            answers[i] = pack(totals[inverse[a:b]])
        if kind == 0:
            tokens[rows[0]], words[rows[0]] = totals.sum(), (totals > 0).sum()
    return pa.table({"chunk": part["chunk"], "kind": part["kind"], "bucket": part["bucket"], "answer": pa.array(answers, pa.binary()), "n_tokens": tokens, "n_words": words})


def _evidence(n_tokens: int, n_words: int):
    def run(part: pa.Table, answers: pa.Table) -> pa.Table:
        tokens = Tokens(part["text"])
        counts = []
        for kind in KINDS:
            mine = answers.filter(pc.equal(answers["kind"], kind)).sort_by("bucket") if answers.num_rows else answers
            totals = np.concatenate([unpack(x) for x in mine["answer"].to_pylist()]) if mine.num_rows else np.zeros(0, np.uint64)
            grams = np.unique(tokens.grams(kind))
            counts.append(totals[np.searchsorted(grams, tokens.grams(kind))])
        one, two = counts
        logs = np.log10((one.astype(float) + 1) / (n_tokens + n_words + 1))
        cuts = list(zip(tokens.bounds[:-1].tolist(), tokens.bounds[1:].tolist(), strict=True))
        return pa.table({
            "doc_id": part["doc_id"], "train": part["train"], "n_tokens": tokens.counts,
            "n_known": np.bincount(tokens.row[one > 0], minlength=len(cuts)),
            "base_score": np.bincount(tokens.row, weights=logs, minlength=len(cuts)),
            "one": pa.array([pack(one[a:b]) for a, b in cuts], pa.binary()), "two": pa.array([pack(two[a:b]) for a, b in cuts], pa.binary()),
        })

    return run


EVIDENCE = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, one binary, two binary"


def _octave(context: np.ndarray) -> np.ndarray:
    """0 for a context that was never seen, else 1 + log2 of its count."""
    return np.where(context > 0, np.minimum(1 + np.log2(np.maximum(context, 1)).astype(np.int64), OCTAVES - 1), 0)


def _streams(batch: pa.RecordBatch, rows: range):
    """Counts of tokens, of pairs and of contexts over some rows, and each row's size."""
    ones, twos = [unpack(batch.column("one")[i].as_py()) for i in rows], [unpack(batch.column("two")[i].as_py()) for i in rows]
    contexts = [np.roll(x, 1) for x in ones]  # the last token is the end token, the first one's context
    return (np.concatenate(x).astype(np.int64) for x in (ones, twos, contexts)), np.array([len(x) for x in ones])


def _bin(ratio: np.ndarray) -> np.ndarray:
    """0 for no estimate, else 1 + the eighth of an octave of estimate / uniform."""
    with np.errstate(divide="ignore"):
        at = np.rint(STEPS * np.log2(np.maximum(ratio, 1e-300))) + BINS // 4
    return np.where(ratio > 0, np.clip(at, 1, BINS - 1), 0).astype(np.int64)


def deleted_estimates(evidence: DataFrame, n_tokens: int, n_words: int) -> DataFrame:
    """(cell, n): how many training tokens have which octave, pair estimate and word estimate, with themselves left out."""

    def run(batches):
        cells: dict[int, int] = {}
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                (one, two, context), _ = _streams(batch, range(a, min(a + 500, batch.num_rows)))
                context = context - 1
                pair = np.where(context > 0, (two - 1) / np.maximum(context, 1), 0) * (n_words + 1)
                word = (one - 1) / max(1, n_tokens - 1) * (n_words + 1)
                found, n = np.unique((_octave(context) * BINS + _bin(pair)) * BINS + _bin(word), return_counts=True)
                for cell, m in zip(found.tolist(), n.tolist(), strict=True):
                    cells[cell] = cells.get(cell, 0) + m
        yield pa.RecordBatch.from_arrays([pa.array(list(cells), pa.int64()), pa.array(list(cells.values()), pa.int64())], ["cell", "n"])

    return evidence.where("train").select("one", "two").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def learn_weights(cells: np.ndarray, n: np.ndarray, rounds: int = 60) -> np.ndarray:
    """EM: (a2, a1, a0) by octave of the context's count. An octave without tokens takes its lower neighbour's."""
    octave, pair, word = cells // BINS**2, cells // BINS % BINS, cells % BINS
    level = lambda k: np.where(k > 0, 2.0 ** ((k - BINS // 4) / STEPS), 0.0)
    parts = np.stack([level(pair), level(word), np.ones(len(cells))], axis=1)
    weights = np.tile([0.4, 0.4, 0.2], (OCTAVES, 1))
    weights[0] = [0, 0.8, 0.2]
    seen = np.bincount(octave, weights=n, minlength=OCTAVES) > 0
    for _ in range(rounds):
        each = weights[octave] * parts
        each *= (n / np.maximum(each.sum(axis=1), 1e-300))[:, None]
        sums = np.stack([np.bincount(octave, weights=each[:, k], minlength=OCTAVES) for k in range(3)], axis=1).astype(float)
        sums[:, 2] += 1e-3  # keeps a little for the unknown
        weights = np.where(seen[:, None], sums / sums.sum(axis=1, keepdims=True), weights)
    for k in range(2, OCTAVES):
        if not seen[k] and seen[1:k].any():
            weights[k] = weights[k - 1]
    return weights


def score_documents(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", chunks: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``train`` tells which rows are learned from. base_score is the add-one
    unigram model's log10 probability, score that of the interpolated model.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    n = chunks or chunk_count(rows, "text")
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")).repartitionById(n, "chunk").groupBy("chunk")
    asked = dealt.applyInArrow(_requests(n), "bucket int, chunk int, kind int, grams binary, counts binary")
    answers = written(asked.repartitionById(n, "bucket").groupBy("bucket").applyInArrow(_answers, "chunk int, kind int, bucket int, answer binary, n_tokens long, n_words long"), "ngram-counts")
    n_tokens, n_words = (int(x or 0) for x in answers.agg(F.sum("n_tokens"), F.sum("n_words")).first())
    answered = answers.select("chunk", "kind", "bucket", "answer").repartitionById(n, "chunk").groupBy("chunk")
    evidence = written(dealt.cogroup(answered).applyInArrow(_evidence(n_tokens, n_words), EVIDENCE), "lm-evidence")
    discard(answers)
    table = deleted_estimates(evidence, n_tokens, n_words).toArrow()
    weights = learn_weights(table["cell"].to_numpy(), table["n"].to_numpy().astype(float))

    def score(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                some = range(a, min(a + 500, batch.num_rows))
                (one, two, context), sizes = _streams(batch, some)
                a2, a1, a0 = weights[_octave(context)].T
                p = a2 * two / np.maximum(context, 1) + a1 * one / max(1, n_tokens) + a0 / (n_words + 1) if n_tokens else np.ones(len(one))
                sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=np.log10(p), minlength=len(sizes))
                kept = [batch.column(c)[a : a + 500] for c in ("doc_id", "train", "n_tokens", "n_known", "base_score")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(sums)], ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])

    scored = evidence.mapInArrow(score, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
