"""Benchmark decontamination: rare word n-gram seeds and Smith-Waterman alignment.

Words are runs of ASCII letters, digits and bytes above 0x7F after
lower-casing A-Z, so punctuation does not matter. Word frequencies over the
whole corpus tell how likely an n-gram of a test item is by chance; the
n-grams less likely than ``rare`` are the item's seeds (all of its n-grams, if
none is). Rarity depends on word frequencies only, so a test item that leaked
into very many documents keeps its seeds. Every place of a document where a
seed stands is a candidate; the document's words around it are aligned with
the item's by Smith-Waterman (match 2, other -1, gap -1), which tolerates
replaced, added and missing words. A pair is reported if the best local
alignment reaches ``least`` of the item's perfect score and, since few words
in common are no evidence for a short item, holds at least ``SURE`` of the
item's words in their order (all of them, if the item has fewer).

The test set is shipped to the tasks, which is done only up to
``words_at_once`` words; a larger one is taken in blocks of items, each over
the whole corpus.

Defined results: null texts are empty; an item of fewer than ``n`` words is
reported where its whole word sequence stands (so a one-word item is, in every
document with that word), and one without words never; repeated rows are
reported each; an empty corpus or test set gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import discard, written
from ._text import column_bytes, content_hashes, lower, mix64, text_blocks

WORD = np.zeros(256, dtype=bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: So many words of an item in common are evidence, even if the item has more.
SURE = 6


def words(data: np.ndarray, offsets: np.ndarray):
    """Hash, start, end and row of each word."""
    inside = WORD[data]
    n = len(data)
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | first[1:n]
    closes[:-1] &= ~inside[1:] | first[1:n]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return content_hashes(data, starts, ends), starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def grams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every n-gram within a row."""
    count = max(0, len(hashes) - n + 1)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[k : k + count]
    at = np.flatnonzero(rows[:count] == rows[n - 1 : n - 1 + count]) if count else np.zeros(0, np.int64)
    return mix64(out[at]), at


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local score of two word sequences, and where it ends in ``text`` (exclusive)."""
    ramp = np.arange(len(text) + 1)
    above, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    for word in item:
        here = np.zeros_like(above)
        here[1:] = np.maximum(above[:-1] + np.where(text == word, 2, -1), above[1:] - 1)
        here = np.maximum(np.maximum.accumulate(np.maximum(here, 0) + ramp) - ramp, 0)  # gaps along the text
        top = int(here.argmax())
        if here[top] > best:
            best, end = int(here[top]), top
        above = here
    return best, end


def in_order(item: np.ndarray, text: np.ndarray) -> int:
    """The most words of ``item`` that stand in ``text`` in the same order."""
    above = np.zeros(len(text) + 1, np.int64)
    for word in item:
        here = above.copy()
        here[1:] = np.maximum(here[1:], above[:-1] + (text == word))
        above = np.maximum.accumulate(here)
    return int(above[-1])


class TestSet:
    """Test items with their seeds, sorted by hash; whole sequences of items of fewer than ``n`` words."""

    __test__ = False

    def __init__(self, ids: list, texts: pa.Array, n: int):
        data, offsets = column_bytes(texts)
        self.ids, self.n = ids, n
        self.hashes, _, _, self.rows = words(lower(data), offsets)
        self.bounds = np.searchsorted(self.rows, np.arange(len(ids) + 1))
        self.vocabulary = np.unique(self.hashes)
        self.seeds = self.seed_item = self.seed_at = None
        self.short = {}  # by number of words: sequences, sorted, and their items
        sizes = np.diff(self.bounds)
        for size in range(1, n):
            items = np.flatnonzero(sizes == size)
            if len(items):
                found, at = grams(self.hashes, self.rows, size)
                whole = found[np.searchsorted(at, self.bounds[items])]
                order = np.argsort(whole, kind="stable")
                self.short[size] = whole[order], items[order]

    def choose_seeds(self, counts: np.ndarray, total: int, rare: float) -> None:
        chance = np.maximum(counts, 1) / max(1, total)
        hashes, at = grams(self.hashes, self.rows, self.n)
        each = chance[np.searchsorted(self.vocabulary, self.hashes)] if len(self.hashes) else np.zeros(0)
        likely = np.prod([each[at + k] for k in range(self.n)], axis=0) if len(at) else np.zeros(0)
        item = self.rows[at]
        keep = likely < rare
        some = np.bincount(item[keep], minlength=len(self.ids)) > 0
        keep |= ~some[item]
        order = np.argsort(hashes[keep], kind="stable")
        self.seeds, self.seed_item, self.seed_at = hashes[keep][order], item[keep][order], (at - self.bounds[item])[keep][order]

    def item(self, k: int) -> np.ndarray:
        return self.hashes[self.bounds[k] : self.bounds[k + 1]]


def _word_counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """How often each word of the vocabulary stands in the corpus, and the corpus' words."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shared.value
        counts = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column("text")):
                found, _, _, _ = words(data, offsets)
                at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                counts[:-1] += np.bincount(at[known[at] == found], minlength=len(known))
                counts[-1] += len(found)
        slots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(counts[slots])], ["slot", "n"])

    counts = np.zeros(len(vocabulary) + 1, np.int64)
    for slot, n in docs.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n")).collect():  # one row a word of the test set
        counts[slot] = n
    return counts[:-1], int(counts[-1])


def _look_up(sorted_keys: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index in ``found``, index in ``sorted_keys``) of every equal pair."""
    slot = np.minimum(np.searchsorted(sorted_keys, found), len(sorted_keys) - 1)
    hit = np.flatnonzero(sorted_keys[slot] == found)
    first, last = np.searchsorted(sorted_keys, found[hit]), np.searchsorted(sorted_keys, found[hit], side="right")
    times = last - first
    return np.repeat(hit, times), np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)


def _whole(wanted, items, size, found, at, starts, ends, rows, offsets):
    """As _matches, for items whose whole sequence stands in a document: its first place, and how often."""
    hit, slot = _look_up(wanted, found)
    place, item = at[hit], items[slot]
    order = np.lexsort((place, item, rows[place]))
    place, item = place[order], item[order]
    row = rows[place]
    cut = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]))) if len(row) else np.zeros(0, int)
    for a, b in zip(cut, np.append(cut[1:], len(row))[: len(cut)], strict=True):
        r, k = row[a], place[a]
        yield int(r), int(item[a]), 1.0, int(b - a), int(starts[k] - offsets[r]), int(ends[k + size - 1] - offsets[r])


def _matches(tests: TestSet, data: np.ndarray, offsets: np.ndarray, least: float):
    """(row, item, similarity, seeds hit, start, end) of each reported pair of a block."""
    hashes, starts, ends, rows = words(data, offsets)
    for size, (wanted, items) in tests.short.items():
        yield from _whole(wanted, items, size, *grams(hashes, rows, size), starts, ends, rows, offsets)
    found, at = grams(hashes, rows, tests.n)
    if not len(tests.seeds) or not len(found):
        return
    hit, seed = _look_up(tests.seeds, found)
    place = at[hit]
    item, shift, row = tests.seed_item[seed], tests.seed_at[seed], rows[place]
    if not len(row):
        return
    order = np.lexsort((place, item, row))
    place, item, shift, row = place[order], item[order], shift[order], row[order]
    bounds = np.searchsorted(rows, np.arange(len(offsets)))
    cut = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])))
    for a, b in zip(cut, np.append(cut[1:], len(row)), strict=True):
        target, r = tests.item(item[a]), row[a]
        size = len(target)
        slack = size // 4 + 5
        low = np.maximum(place[a:b] - shift[a:b] - slack, bounds[r])
        high = np.minimum(place[a:b] - shift[a:b] + size + slack, bounds[r + 1])
        best = (0, 0, 0)
        reach, opens = np.maximum.accumulate(high), np.append(True, low[1:] > np.maximum.accumulate(high)[:-1]) if b - a > 1 else np.array([True])
        begins = np.flatnonzero(opens)
        for x, y in zip(low[begins], reach[np.append(begins[1:], b - a) - 1], strict=True):
            score, end = align(target, hashes[x:y])
            if score > best[0] and score >= 2 * size * least and (score >= 2 * min(size, SURE) or in_order(target, hashes[x : x + end]) >= min(size, SURE)):
                best = (score, int(x), int(x) + end)
        similarity = best[0] / (2 * size)
        if best[0] and similarity >= least:
            _, back = align(target[::-1], hashes[best[1] : best[2]][::-1])
            begin = max(best[1], best[2] - back)
            yield int(r), int(item[a]), similarity, int(b - a), int(starts[begin] - offsets[r]), int(ends[best[2] - 1] - offsets[r])


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 3, rare: float = 1e-9, least: float = 0.5, words_at_once: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and test item found in it: doc_id, item_id, similarity, n_seeds, start, end.

    ``start`` and ``end`` are byte offsets of the aligned passage.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return reduce(DataFrame.unionByName, [_find(texts, items, n, rare, least) for items in _item_blocks(benchmark, words_at_once)])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 3, rare: float = 1e-9, least: float = 0.5, words_at_once: int = 2_000_000, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in which find_contamination finds no item.

    Each row is decided on in the task that holds it, with or without an id.
    """
    texts, scratch = docs.select(F.col(text_col).alias("text")), []
    *others, last = _item_blocks(benchmark, words_at_once)
    for items in others:  # written, so that a task ever holds one block of items
        docs = written(_drop(docs, _test_set(texts, items, n, rare), least, text_col), "decontaminated")
        discard(*scratch)
        scratch = [docs]
    return _drop(docs, _test_set(texts, last, n, rare), least, text_col)


def _item_blocks(benchmark: DataFrame, words_at_once: int) -> list[DataFrame]:
    """(item_id, text) of the test set, in blocks of about ``words_at_once`` words."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text"))
    n_words = items.agg(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^ \\x09-\\x0D]+")))).first()[0] or 0
    parts = max(1, -(-int(n_words) // words_at_once))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) for k in range(parts)]


def _test_set(texts: DataFrame, items: DataFrame, n: int, rare: float):
    """The items with their seeds, broadcast; word frequencies are those of ``texts``."""
    held = items.toArrow()
    tests = TestSet(held["item_id"].to_pylist(), held["text"], n)
    counts, total = _word_counts(texts, tests.vocabulary) if len(tests.vocabulary) else (np.zeros(0, np.int64), 0)
    tests.choose_seeds(counts, total, rare)
    return texts.sparkSession.sparkContext.broadcast(tests)


def _drop(docs: DataFrame, shared, least: float, text_col: str) -> DataFrame:
    def run(batches):
        tests = shared.value
        for batch in batches:
            stays = np.ones(batch.num_rows, dtype=bool)
            for a, _, data, offsets in text_blocks(batch.column(text_col)):
                stays[[r + a for r, *_ in _matches(tests, data, offsets, least)]] = False
            yield batch.filter(pa.array(stays))

    return docs.mapInArrow(run, docs.schema)


def _find(texts: DataFrame, items: DataFrame, n: int, rare: float, least: float) -> DataFrame:
    shared = _test_set(texts, items, n, rare)

    def run(batches):
        tests = shared.value
        for batch in batches:
            ids = batch.column("doc_id")
            for a, _, data, offsets in text_blocks(batch.column("text")):
                rows = [*_matches(tests, data, offsets, least)]
                if rows:
                    row, item, similarity, seeds, start, end = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([x + a for x in row])), pa.array([tests.ids[x] for x in item], pa.int64()), pa.array(similarity), pa.array(seeds, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["doc_id", "item_id", "similarity", "n_seeds", "start", "end"])

    return texts.mapInArrow(run, "doc_id long, item_id long, similarity double, n_seeds long, start long, end long")
