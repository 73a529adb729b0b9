"""Ranked lexical search by the Best Position Algorithm.

The corpus is read once: each document becomes a row of its length and of the
query terms it holds with their counts. From these rows come the corpus'
figures (documents, terms, documents by term) and, shard by shard, impact
lists: for each term its documents by falling impact. A shard keeps for every
document its entries with their positions in the lists, which makes direct
access from a document to all lists one look-up.

A query reads its lists in parallel. Each document that turns up is scored by
direct access at once, and its positions in all lists count as seen. A list's
best position is the last one up to which all are seen; no unseen document can
score more than the impacts at the best positions add up to. That bound falls
faster than one from the positions read last, since direct accesses fill gaps
ahead of the reading. Reading stops once it is strictly below the k-th score,
so that ties are whole. A task carries its k-th scores from shard to shard; the
tasks' results meet in one top-k per query.

The queries and their vocabulary are shipped to the tasks, at most
``words_at_once`` words of queries at a time; more are taken in blocks. Terms
are told by their bytes: hashes only find candidates.

Defined results: null texts have no terms, and documents without terms don't
count in any figure; a query without terms, or whose terms are nowhere, gets no
rows; every row of the queries is one query, so a repeated one is answered
again, and every row of the documents is one document, also with a null or
repeated id (null ids rank behind others of the same score); terms that stand
in so many documents that their weight is 0 score nothing; an empty table on
either side gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import written
from ._text import column_bytes, lower, text_blocks
from .decontaminate import _item_blocks, _look_up, words

#: Entries of the impact lists that a task holds at a time.
SHARD_ENTRIES = 2_000_000
#: Positions of each list that the first step reads; later steps read twice as many as the one before.
FIRST_STEP = 64


class Queries:
    """The queries of a block as numbers of terms, and the vocabulary's bytes, ordered by hash."""

    def __init__(self, ids: list, texts: pa.Array):
        data, offsets = column_bytes(texts)
        data = lower(data)
        hashes, starts, ends, rows = words(data, offsets)
        spelled = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
        first = {}
        for h, w in sorted(zip(hashes.tolist(), spelled, strict=True)):
            first.setdefault(w, (h, len(first)))
        self.ids, self.hashes = ids, np.array([h for h, _ in first.values()], np.uint64)
        self.data = np.frombuffer(b"".join(first), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(w) for w in first])]).astype(np.int64)
        bounds = np.searchsorted(rows, np.arange(len(ids) + 1))
        terms = np.array([first[w][1] for w in spelled], np.int64)
        self.items = [np.unique(terms[a:b], return_counts=True) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, term) of the words of a block that are in the vocabulary, compared byte by byte."""
        word, term = _look_up(self.hashes, hashes)
        size = (ends - starts)[word]
        same = size == np.diff(self.offsets)[term]
        word, term, size = word[same], term[same], size[same]
        ahead = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(ahead, size)
        differs = data[np.repeat(starts[word], size) + step] != self.data[np.repeat(self.offsets[term], size) + step]
        right = np.add.reduceat(differs, ahead) == 0 if len(size) else np.zeros(0, bool)
        return word[right], term[right]


def _lists(values: np.ndarray, bounds: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def _postings(docs: DataFrame, shared) -> DataFrame:
    """(doc_id, n, term, tf) of each document with a term: its length, and the query terms in it with their counts."""

    def run(batches):
        queries = shared.value
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column("text")):
                hashes, starts, ends, rows = words(data, offsets)
                word, term = queries.find(data, hashes, starts, ends)
                pairs, tf = np.unique(rows[word] * len(queries) + term, return_counts=True)
                n = np.bincount(rows, minlength=b - a)
                bounds = np.searchsorted(pairs // max(1, len(queries)), np.arange(b - a + 1))
                some = pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n), _lists(pairs % max(1, len(queries)), bounds, pa.int32()), _lists(tf, bounds, pa.int64())], ["doc_id", "n", "term", "tf"])
                yield some.filter(pa.array(n > 0))

    return docs.mapInArrow(run, "doc_id long, n long, term array<int>, tf array<long>")


def _figures(postings: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms with repeats, and the documents that hold each query term."""

    def run(batches):
        counts = np.zeros(terms + 2, np.int64)
        for batch in batches:
            counts[:terms] += np.bincount(batch.column("term").flatten().to_numpy(zero_copy_only=False), minlength=terms)
            counts[terms] += batch.num_rows
            counts[terms + 1] += batch.column("n").to_numpy(zero_copy_only=False).sum()
        slots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(counts[slots])], ["slot", "c"])

    counts = np.zeros(terms + 2, np.int64)
    for slot, c in postings.select("n", "term").mapInArrow(run, "slot int, c long").groupBy("slot").agg(F.sum("c")).collect():  # a row a query term
        counts[slot] = c
    return int(counts[terms]), int(counts[terms + 1]), counts[:terms]


def weights(documents: int, holding: np.ndarray) -> np.ndarray:
    """Each term's weight by the number of documents that hold it."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in holding.tolist()], np.int64)


class Shard:
    """Impact lists of some documents, and each document's entries with their positions in the lists."""

    def __init__(self, n: np.ndarray, bounds: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, documents: int, length: int):
        m = 75 + (25 * n * documents) // max(1, length)
        owner = np.repeat(np.arange(len(n)), np.diff(bounds))
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[owner]))
        useful = impact > 0
        self.term, self.impact, owner = term[useful], impact[useful], owner[useful]
        self.first = np.searchsorted(owner, np.arange(len(n) + 1))
        order = np.lexsort((owner, -self.impact, self.term))
        self.doc, self.falling = owner[order], self.impact[order]
        self.start = np.searchsorted(self.term[order], np.arange(len(weight) + 1))
        self.position = np.empty(len(order), np.int64)
        self.position[order] = np.arange(len(order)) - self.start[self.term[order]]
        self.slot_of = np.full(len(weight), -1)


def best_positions(shard: Shard, terms: np.ndarray, times: np.ndarray, k: int, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, positions read) that may be among the k best; ``best`` has the k highest scores known so far.

    All documents of the shard with a score above 0 that is at least the k-th
    are among them.
    """
    sizes = shard.start[terms + 1] - shard.start[terms]
    terms, times, sizes = terms[sizes > 0], times[sizes > 0], sizes[sizes > 0]
    starts, ahead = shard.start[terms], np.cumsum(sizes) - sizes
    shard.slot_of[terms] = np.arange(len(terms))
    seen, known = np.zeros(int(sizes.sum()), bool), np.zeros(len(shard.first) - 1, bool)
    best_position = np.zeros(len(terms), np.int64)
    docs, scores, depth, step = [], [], 0, FIRST_STEP
    while len(terms):
        read = np.concatenate([shard.doc[s + depth : s + min(size, depth + step)] for s, size in zip(starts, sizes, strict=True)])
        fresh = np.unique(read[~known[read]])
        known[fresh] = True
        depth, step = depth + step, 2 * step
        # Direct access: all entries of the documents, of which those of this query count.
        count = shard.first[fresh + 1] - shard.first[fresh]
        ends = np.cumsum(count)
        entry = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(shard.first[fresh] - ends + count, count)
        slot = shard.slot_of[shard.term[entry]]
        mine = slot >= 0
        seen[ahead[slot[mine]] + shard.position[entry[mine]]] = True
        sums = np.concatenate([[0], np.cumsum(np.where(mine, shard.impact[entry] * times[slot], 0))])
        docs.append(fresh)
        scores.append(sums[ends] - sums[ends - count])
        best = np.sort(np.concatenate([best, scores[-1]]))[-k:]
        bound = 0
        for i in range(len(terms)):
            at, size = int(best_position[i]), int(sizes[i])
            gap = np.argmin(seen[ahead[i] + at : ahead[i] + size]) if at < size else 0
            at = size if at == size or seen[ahead[i] + at + gap] else at + int(gap)
            best_position[i] = at
            if at < size:
                bound += int(times[i]) * int(shard.falling[starts[i] + at - 1])
        if bound == 0 or (len(best) == k and int(best[0]) > bound):
            break
    shard.slot_of[terms] = -1
    docs, scores = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs, scores))
    kept = scores >= max(1, int(best[0]) if len(best) == k else 1)
    return docs[kept], scores[kept], min(depth, int(sizes.max(initial=0)))


def _ranked(postings: DataFrame, shared, weight: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """(query, doc_id, score): the k best of what each task holds."""

    def run(batches):
        queries = shared.value
        top = {}  # by query: scores, ids (the largest long for null), whether the id is null

        def search(held):
            table = pa.Table.from_batches(held).combine_chunks()
            n, terms = table["n"].to_numpy(), table["term"].combine_chunks()
            bounds = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            shard = Shard(n, bounds, terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64), table["tf"].combine_chunks().flatten().to_numpy(zero_copy_only=False), weight, documents, length)
            null = table["doc_id"].is_null().to_numpy()
            ids = table["doc_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
            for q, (terms_of, times) in enumerate(queries.items):
                before = top.get(q, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)))
                docs, scores, _ = best_positions(shard, terms_of, times, k, np.sort(before[0]))
                if len(docs):
                    both = [np.concatenate(x) for x in zip(before, (scores, ids[docs], null[docs]), strict=True)]
                    order = np.lexsort((both[2], both[1], -both[0]))[:k]
                    top[q] = tuple(x[order] for x in both)

        held, entries = [], 0
        for batch in batches:
            held.append(batch)
            entries += len(batch.column("term").flatten()) + batch.num_rows
            if entries >= SHARD_ENTRIES:
                search(held)
                held, entries = [], 0
        if held:
            search(held)
        for q, (scores, ids, null) in top.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q, np.int32)), pa.array(ids, mask=null), pa.array(scores)], ["query", "doc_id", "score"])

    return postings.mapInArrow(run, "query int, doc_id long, score long")


def _search(docs: DataFrame, items: DataFrame, k: int) -> DataFrame | None:
    held = items.toArrow()
    queries = Queries(held["item_id"].to_pylist(), held["text"])
    if not len(queries):
        return None
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(queries)
    postings = written(_postings(docs, shared), "postings")
    documents, length, holding = _figures(postings, len(queries))
    found = _ranked(postings, shared, weights(documents, holding), documents, length, k)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ids = spark.createDataFrame([*enumerate(queries.ids)], "query int, item_id long")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(ids, "query").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 20, words_at_once: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents that score highest for each query of (item_id, text), above 0."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = [p for p in (_search(texts, items, k) for items in _item_blocks(queries, words_at_once)) if p is not None]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
