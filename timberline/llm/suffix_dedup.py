"""Removal of repeated byte strings through hash-compared suffix sorting.

A byte goes if a string of ``length`` bytes that covers it also starts earlier
(a smaller doc_id, or the same document at an earlier place). Every such
string holds an anchor: the seed of ``SEED`` bytes with the smallest hash
among its seeds, the leftmost of equals. Equal strings have the same anchor at
the same place, so it is enough to compare the strings around anchors with
equal seeds. Neighbouring strings share their anchor; together they form its
context, and a text of n bytes has about n / 35 of them.

1. Documents are dealt by id into chunks of about 12 MB. A chunk lists its
   anchors; a context that stood earlier in the same chunk is decided there,
   by its bytes. The first of each context goes by its seed's hash, with a
   128-bit BLAKE2b digest of the context's bytes: a (seed, digest) that stood
   earlier is a repeat as a whole, and a seed with several contexts is
   undecided. A very common passage reaches its task once per chunk, not once
   per copy.
   A seed with many contexts, in one chunk or in all together, is common: it
   stands at the edge of a passage that has very many surroundings. Where a
   chunk sees this, its contexts are dealt by (seed, digest) instead, and the
   seed's task is told, so that all of the seed's contexts count as common.
2. Undecided contexts are sent, as bytes, to the task of their seed. There
   their suffixes from the anchor on, and their reversed prefixes before it,
   are suffix-sorted: a mergesort whose comparisons find the common extension
   by binary search over polynomial prefix hashes. The bytes behind the
   extensions of neighbours in the sorted order are then compared, so that a
   hash collision can't pass (the sort is redone on plain bytes). Two strings
   are equal if they agree on both sides of the anchor; all but the first of
   equals are repeats.
3. The contexts of common seeds are too many for one task. Each chunk sends the
   first of their equal strings, as bytes; all but the first of all chunks are
   repeats. A string that stands in all surroundings is sent once per chunk.
4. Each chunk marks the bytes under repeats and cuts them out.

Polynomial hashes only choose what is compared: strings and contexts of one
chunk are equal if their bytes are, whole contexts of several chunks if their
digests are.

Defined results: a null text counts as empty; texts shorter than ``length``
lose nothing; rows that share a doc_id are ordered by text and the later row's
strings count as later; null ids come before all others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import chunk_count, discard, written
from ._text import blocks, byte_codes, column_bytes, content_hashes, mix64, powers, prefix_hashes, span_hashes

SEED = 32
PLACE_BITS = np.uint64(28)
NO_ID = -(2**63)
#: A seed with so many contexts in a chunk, or in all chunks, is common. This bounds a seed's task; results don't depend on it.
COMMON, COMMON_IN_ALL = 24, 4096
#: Work arrays of an anchor search take about 80 bytes for each of these.
ANCHOR_BLOCK = 1 << 20


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether data[a:a+n] equals data[b:b+n], for each a, b and n."""
    out = np.ones(len(a), dtype=bool)
    ends = np.cumsum(n)
    x = 0
    while x < len(a):
        y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + ANCHOR_BLOCK, side="right")))
        m = n[x:y]
        ramp = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        differs = data[np.repeat(a[x:y], m) + ramp] != data[np.repeat(b[x:y], m) + ramp]
        out[np.repeat(np.arange(x, y), m)[differs]] = False
        x = y
    return out


class Anchors:
    """The anchors of a chunk's rows; places count from the start of the row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        parts = [self._block(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], a, length) for a, b in blocks(offsets, ANCHOR_BLOCK)]
        self.row, self.at, self.first, self.last, self.seed, self.context = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in enumerate((np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64)))

    @staticmethod
    def _block(data, offsets, base, length):
        window = length - SEED + 1
        sizes = np.diff(offsets)
        counts = np.maximum(0, sizes - length + 1)
        total = int(counts.sum())
        if not total:
            return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
        prefix = prefix_hashes(data)
        up, down = powers(len(prefix))
        places = np.arange(len(data) - SEED + 1)
        seeds = mix64((prefix[SEED:] - prefix[:-SEED]) * down[: len(places)] + np.uint64(SEED))
        low = seeds & ~((np.uint64(1) << PLACE_BITS) - np.uint64(1)) | places.astype(np.uint64)
        span = 1
        while 2 * span <= window:  # the least of each window of seeds, by doubling
            low, span = np.minimum(low[:-span], low[span:]), 2 * span
        if span < window:
            low = np.minimum(low[: len(low) - (window - span)], low[window - span :])
        rows = np.repeat(np.arange(len(sizes)), counts)
        starts = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(offsets[:-1], counts)
        at = (low[starts] & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
        new = np.ones(total, dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (rows[1:] != rows[:-1])
        opens = np.flatnonzero(new)
        closes = np.append(opens[1:], total) - 1
        row, at, first, last = rows[opens], at[opens], starts[opens], starts[closes]
        other = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(byte_codes(0x5EED)[data] * up[:-1], out=other[1:])
        context = mix64(span_hashes(other, first, last + length) + (at - first).astype(np.uint64))
        shift = offsets[row]
        return [row + base, at - shift, first - shift, last - shift, seeds[at], context]

    def take(self, which: np.ndarray) -> Anchors:
        out = object.__new__(Anchors)
        for name in ("row", "at", "first", "last", "seed", "context"):
            setattr(out, name, getattr(self, name)[which])
        return out

    def split_repeats(self, data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the first of each context, rows being in order, and of the others, whose bytes are the same."""
        order = np.lexsort((np.arange(len(self.seed)), self.context, self.seed))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (self.seed[order][1:] != self.seed[order][:-1]) | (self.context[order][1:] != self.context[order][:-1])
        lead, later = order[new][np.cumsum(new) - 1][~new], order[~new]
        begin, size = offsets[self.row] + self.first, self.last + length - self.first
        same = (size[lead] == size[later]) & (self.at[lead] - self.first[lead] == self.at[later] - self.first[later])
        same[same] = same_bytes(data, begin[lead[same]], begin[later[same]], size[later[same]])
        return np.sort(np.append(order[new], later[~same])), later[same]

    def digests(self, data: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
        """128 bits for each context: two 64-bit numbers."""
        begin = offsets[self.row] + self.first
        raw, make = memoryview(np.ascontiguousarray(data)), hashlib.blake2b
        joined = b"".join([make(raw[x:y], digest_size=16).digest() for x, y in zip(begin.tolist(), (offsets[self.row] + self.last + length).tolist(), strict=True)])
        return np.frombuffer(joined, np.int64).reshape(-1, 2)


class Chunk:
    """A chunk's rows by (doc_id, text), with an ordinal among rows of one doc_id."""

    def __init__(self, rows: pa.Table):
        ids = rows["doc_id"].fill_null(NO_ID).to_numpy()
        data, offsets = column_bytes(rows["text"])
        order = np.argsort(ids, kind="stable")
        if (ids[order][1:] == ids[order][:-1]).any():
            raw = data.tobytes()
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], raw[offsets[i] : offsets[i + 1]])))
        column = rows["text"].cast(pa.large_binary()).fill_null(b"").combine_chunks().take(pa.array(order))
        self.data, self.offsets = column_bytes(column)
        self.ids = ids[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = self.ids[1:] != self.ids[:-1]
        self.ordinal = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else order

    def rows_of(self, ids: np.ndarray, ordinal: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, ids) + ordinal


def _gathered(batches) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


def _numpy(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows[n].to_numpy() for n in names]


def _decide(in_all: int):
    """Whole repeats (whole = true) and undecided contexts, of common seeds or not, of one task's anchors."""

    def run(batches):
        rows = _gathered(batches)
        if rows is None:
            return
        seed, c1, c2, ids, ordinal, at = _numpy(rows, "route", "c1", "c2", "doc_id", "ordinal", "at")  # a common seed's route holds one context
        spread = rows["spread"].to_numpy(zero_copy_only=False).astype(bool)
        order = np.lexsort((at, ordinal, ids, c2, c1, seed, spread))
        seed, c1, c2, spread, told = seed[order], c1[order], c2[order], spread[order], at[order] < 0
        new_seed, new_context = np.ones(len(order), dtype=bool), np.ones(len(order), dtype=bool)
        new_seed[1:] = (seed[1:] != seed[:-1]) | (spread[1:] != spread[:-1])
        new_context[1:] = new_seed[1:] | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1]) | (told[1:] != told[:-1])
        group = np.cumsum(new_seed) - 1
        contexts = np.bincount(group, weights=new_context & ~told)
        is_common = spread | ((np.bincount(group, weights=told) > 0) | (contexts >= in_all))[group]
        keep = ~told & (~new_context | is_common | (contexts > 1)[group])
        out = order[keep]
        yield pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(ordinal[out]), pa.array(at[out]), pa.array(~new_context[keep]), pa.array(is_common[keep])], ["doc_id", "ordinal", "at", "whole", "common"])

    return run


class Suffixes:
    """Suffixes of a buffer, each with an end, compared by hashed common extensions."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.sizes = np.append(data, np.uint8(0)), starts, ends - starts
        self.prefix = prefix_hashes(data)
        self.down = powers(len(self.prefix))[1]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension, by binary search over prefix hashes."""
        a, b = self.starts[i], self.starts[j]
        low, high = np.zeros(len(i), np.int64), np.minimum(self.sizes[i], self.sizes[j])
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = (self.prefix[a + mid] - self.prefix[a]) * self.down[a] == (self.prefix[b + mid] - self.prefix[b]) * self.down[b]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts strictly before suffix j."""
        n = self.common(i, j)
        end_i, end_j = n == self.sizes[i], n == self.sizes[j]
        return np.where(end_i, ~end_j, ~end_j & (self.data[self.starts[i] + np.where(end_i, 0, n)] < self.data[self.starts[j] + np.where(end_j, 0, n)]))

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes within each group (``group`` ascends): a bottom-up mergesort.

        All merges of a level run side by side: an element's place is its own
        rank plus its rank in the sibling run, found by binary search.
        """
        n = len(group)
        new = np.ones(n, dtype=bool)
        new[1:] = group[1:] != group[:-1]
        opens = np.flatnonzero(new)
        origin = opens[np.cumsum(new) - 1] if n else np.zeros(0, np.int64)
        size = np.diff(np.append(opens, n))[np.cumsum(new) - 1] if n else np.zeros(0, np.int64)
        order, width = np.arange(n), 1
        while width < size.max(initial=0):
            live = np.flatnonzero(size > width)
            start, q = origin[live], live - origin[live]
            left = (q // width) % 2 == 0
            pair = q // (2 * width) * (2 * width)
            low = np.where(left, np.minimum(pair + width, size[live]), pair)
            high = np.where(left, np.minimum(pair + 2 * width, size[live]), pair + width)
            base, mine = low.copy(), order[live]
            while (todo := np.flatnonzero(low < high)).size:
                mid = (low[todo] + high[todo]) >> 1
                x, y, from_left = mine[todo], order[start[todo] + mid], left[todo]
                sooner = self.before(np.where(from_left, y, x), np.where(from_left, x, y))
                right = sooner == from_left  # left elements pass smaller ones, right elements pass equal ones too
                low[todo], high[todo] = np.where(right, mid + 1, low[todo]), np.where(right, high[todo], mid)
            place = start + np.where(left, q, q - width) + (low - base)
            order[place] = mine
            width *= 2
        return order

    def ranked(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each suffix, and the extension shared with the one before it in rank (-1 at a group's start)."""
        order = self.sort(group)
        shared = self._shared(order, group)
        if not self.verified(order, shared):  # a collision: once more, on plain bytes
            raw = self.data.tobytes()
            order = np.array(sorted(range(len(group)), key=lambda i: (group[i], raw[self.starts[i] : self.starts[i] + self.sizes[i]])), dtype=np.int64)
            shared = self._shared(order, group)
            for k in np.flatnonzero(shared >= 0):
                a, b = (raw[self.starts[i] : self.starts[i] + self.sizes[i]] for i in (order[k - 1], order[k]))
                shared[k] = next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return rank, shared

    def _shared(self, order, group):
        shared = np.full(len(order), -1, np.int64)
        inner = np.flatnonzero(group[order][1:] == group[order][:-1]) + 1
        shared[inner] = self.common(order[inner - 1], order[inner])
        return shared

    def verified(self, order: np.ndarray, shared: np.ndarray) -> bool:
        """Whether neighbours agree on exactly the extensions found, byte by byte, and are in order."""
        inner = np.flatnonzero(shared >= 0)
        a, b, n = self.starts[order[inner - 1]], self.starts[order[inner]], shared[inner]
        ramp = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if (self.data[np.repeat(a, n) + ramp] != self.data[np.repeat(b, n) + ramp]).any():
            return False
        ended = n == self.sizes[order[inner - 1]]
        return bool((ended | ((n < self.sizes[order[inner]]) & (self.data[a + np.where(ended, 0, n)] < self.data[b + np.where(ended, 0, n)]))).all())


def repeated_strings(seed: np.ndarray, ids: np.ndarray, ordinal: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, contexts: tuple[np.ndarray, np.ndarray], length: int):
    """Index of the context and start of the string, for all strings but the first of equals."""
    data, offsets = contexts
    by_seed = np.lexsort((at, ordinal, ids, seed))  # within a seed: the order in which strings start
    anchor = offsets[:-1] + (at - first)
    right = Suffixes(data, anchor[by_seed], offsets[1:][by_seed])
    mirrored = data[::-1]
    left = Suffixes(mirrored, len(data) - anchor[by_seed], len(data) - offsets[:-1][by_seed])
    group = np.cumsum(np.append(0, np.diff(seed[by_seed]) != 0)) if len(seed) else np.zeros(0, np.int64)
    (rank_r, shared_r), (rank_l, shared_l) = right.ranked(group), left.ranked(group)
    before, after = (at - first)[by_seed], (at - last)[by_seed]
    places = np.arange(len(seed))
    for r in range(length - SEED + 1):  # strings that start r bytes before the anchor
        on = np.flatnonzero((before >= r) & (after <= r))
        if not len(on):
            continue
        class_l = np.maximum.accumulate(np.where(shared_l < r, places, 0))[rank_l[on]]
        class_r = np.maximum.accumulate(np.where(shared_r < length - r, places, 0))[rank_r[on]]
        order = np.lexsort((on, class_r, class_l))
        new = np.ones(len(on), dtype=bool)
        new[1:] = (class_l[order][1:] != class_l[order][:-1]) | (class_r[order][1:] != class_r[order][:-1])
        again = by_seed[on[order[~new]]]
        yield again, at[again] - r


def first_strings(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the strings of ``length`` bytes that start at ``at``, which ascends, are the first of equals, and which are later ones."""
    hashes = content_hashes(data, at, at + length)
    order = np.lexsort((np.arange(len(at)), hashes))
    new = np.ones(len(order), dtype=bool)
    new[1:] = hashes[order][1:] != hashes[order][:-1]
    lead, later = order[new][np.cumsum(new) - 1][~new], order[~new]
    same = same_bytes(data, at[lead], at[later], np.full(len(later), length))
    return np.sort(np.append(order[new], later[~same])), np.sort(later[same])


def _binary(data: np.ndarray, at: np.ndarray, length: int) -> pa.Array:
    """The strings of ``length`` bytes that start at ``at``."""
    out = np.empty((len(at), length), np.uint8)
    for k in range(length):
        out[:, k] = data[at + k]
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * length).astype(np.int32)), pa.py_buffer(out)])


def remove_repeats(docs: DataFrame, length: int = 100, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text", chunks: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, spans and kept (bytes)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = chunks or chunk_count(docs, "text")
    common, in_all = COMMON, COMMON_IN_ALL

    def chunked(df: DataFrame):
        """One chunk a task."""
        return df.withColumn("chunk", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(NO_ID))), F.lit(n)).cast("int")).repartitionById(n, "chunk").groupBy("chunk")

    rows = chunked(docs)

    def listed(part: pa.Table) -> pa.Table:
        chunk = Chunk(part)
        found = Anchors(chunk.data, chunk.offsets, length)
        found = found.take(found.split_repeats(chunk.data, chunk.offsets, length)[0])
        digests = found.digests(chunk.data, chunk.offsets, length)
        seeds, inverse, contexts = np.unique(found.seed, return_inverse=True, return_counts=True)
        spread = contexts[inverse] >= common
        told = seeds[contexts >= common]  # one row without an anchor tells the seed's task
        route = np.where(spread, mix64(found.seed * np.uint64(3) + digests[:, 0].view(np.uint64)), found.seed)
        blank = np.zeros(len(told), np.int64)
        return pa.table({
            "route": np.append(route, told).view(np.int64), "c1": np.append(digests[:, 0], blank), "c2": np.append(digests[:, 1], blank),
            "doc_id": np.append(chunk.ids[found.row], blank), "ordinal": np.append(chunk.ordinal[found.row], blank).astype(np.int32), "at": np.append(found.at, blank - 1).astype(np.int32), "spread": np.append(spread, blank > 0),
        })

    anchors = rows.applyInArrow(listed, "route long, c1 long, c2 long, doc_id long, ordinal int, at int, spread boolean")
    decided = written(anchors.repartition(n, "route").mapInArrow(_decide(in_all), "doc_id long, ordinal int, at int, whole boolean, common boolean"), "repeat-anchors")

    def flagged(chunk: Chunk, found: Anchors, marks: pa.Table) -> np.ndarray:
        """Indexes of the anchors that ``marks`` names."""
        ids, ordinal, at = _numpy(marks, "doc_id", "ordinal", "at")
        row = chunk.rows_of(ids, ordinal)
        return np.searchsorted(found.row * (1 << 32) + found.at, row * (1 << 32) + at)

    def undecided(part: pa.Table, marks: pa.Table) -> pa.Table:
        chunk = Chunk(part)
        found = Anchors(chunk.data, chunk.offsets, length)
        found = found.take(flagged(chunk, found, marks)) if marks.num_rows else found.take(np.zeros(0, np.int64))
        a, b = chunk.offsets[found.row] + found.first, chunk.offsets[found.row] + found.last + length
        raw = chunk.data.tobytes()
        return pa.table({"seed": found.seed.view(np.int64), "doc_id": chunk.ids[found.row], "ordinal": chunk.ordinal[found.row].astype(np.int32), "at": found.at.astype(np.int32), "first": found.first.astype(np.int32), "last": found.last.astype(np.int32), "context": pa.array([raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())})

    def compared(batches):
        held = _gathered(batches)
        if held is None:
            return
        seed, ids, ordinal, at, first, last = _numpy(held, "seed", "doc_id", "ordinal", "at", "first", "last")
        at, first, last = at.astype(np.int64), first.astype(np.int64), last.astype(np.int64)
        which, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for again, start in repeated_strings(seed, ids, ordinal, at, first, last, column_bytes(held["context"]), length):
            which.append(again)
            starts.append(start)
        which, starts = np.concatenate(which), np.concatenate(starts)
        order = np.lexsort((starts, which))
        which, starts = which[order], starts[order]
        new = np.ones(len(which), dtype=bool)  # strings that start side by side make one span
        new[1:] = (which[1:] != which[:-1]) | (starts[1:] != starts[:-1] + 1)
        opens = np.flatnonzero(new)
        closes = np.append(opens[1:], len(which))[: len(opens)] - 1
        yield pa.RecordBatch.from_arrays([pa.array(ids[which[opens]]), pa.array(ordinal[which[opens]]), pa.array(starts[opens], pa.int32()), pa.array(starts[closes] + length, pa.int32())], ["doc_id", "ordinal", "from", "until"])

    def listed_strings(part: pa.Table, marks: pa.Table) -> pa.Table:
        """The first of each chunk's equal strings, as bytes, and spans of the others."""
        chunk = Chunk(part)
        found = Anchors(chunk.data, chunk.offsets, length)
        found = found.take(np.sort(flagged(chunk, found, marks)) if marks.num_rows else np.zeros(0, np.int64))
        many = found.last - found.first + 1
        row, start = np.repeat(found.row, many), np.repeat(found.first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = chunk.offsets[row] + start
        firsts, again = first_strings(chunk.data, at, length) if len(at) else (at, at)
        opens = np.flatnonzero(np.append(True, (row[again][1:] != row[again][:-1]) | (start[again][1:] != start[again][:-1] + 1))) if len(again) else again
        closes = np.append(opens[1:], len(again))[: len(opens)].astype(np.int64) - 1
        rows_out = np.append(row[firsts], row[again[opens]])
        return pa.table({
            "string": pa.concat_arrays([_binary(chunk.data, at[firsts], length), pa.nulls(len(opens), pa.binary())]), "doc_id": chunk.ids[rows_out], "ordinal": chunk.ordinal[rows_out].astype(np.int32),
            "from": np.append(start[firsts], start[again[opens]]).astype(np.int32), "until": np.append(start[firsts] + length, start[again[closes]] + length).astype(np.int32),
        })

    contexts = rows.cogroup(chunked(decided.where("not whole and not common"))).applyInArrow(undecided, "seed long, doc_id long, ordinal int, at int, first int, last int, context binary")
    spans = written(contexts.repartition(n, "seed").mapInArrow(compared, "doc_id long, ordinal int, from int, until int"), "repeat-spans")
    crowded = decided.where("not whole and common")
    if crowded.limit(1).count():
        strings = written(rows.cogroup(chunked(crowded)).applyInArrow(listed_strings, "string binary, doc_id long, ordinal int, from int, until int"), "common-strings")
        earlier = Window.partitionBy("string").orderBy("doc_id", "ordinal", "from")  # a row per chunk at most
        later = strings.where("string IS NOT NULL").withColumn("place", F.row_number().over(earlier)).where("place > 1")
        both, before = spans.unionByName(strings.where("string IS NULL").drop("string")).unionByName(later.drop("string", "place")), spans
        spans = written(both, "repeat-spans")
        discard(before, strings)
    known = decided.where("whole").select("doc_id", "ordinal", "at", F.lit(-1).alias("until")).unionByName(spans.select("doc_id", "ordinal", F.col("from").alias("at"), "until"))

    def cut(part: pa.Table, repeats: pa.Table) -> pa.Table:
        chunk = Chunk(part)
        found = Anchors(chunk.data, chunk.offsets, length)
        whole = [found.split_repeats(chunk.data, chunk.offsets, length)[1]]
        edges = np.zeros(len(chunk.data) + 1, np.int32)
        if repeats.num_rows:
            is_whole = repeats["until"].to_numpy() < 0
            whole.append(flagged(chunk, found, repeats.filter(pa.array(is_whole))))
            ids, ordinal, a, b = (x[~is_whole] for x in _numpy(repeats, "doc_id", "ordinal", "at", "until"))
            base = chunk.offsets[chunk.rows_of(ids, ordinal)]
            np.add.at(edges, base + a, 1)
            np.add.at(edges, base + b, -1)
        whole = found.take(np.concatenate(whole))
        np.add.at(edges, chunk.offsets[whole.row] + whole.first, 1)
        np.add.at(edges, chunk.offsets[whole.row] + whole.last + length, -1)
        gone = np.cumsum(edges[:-1], dtype=np.int32) > 0
        kept = chunk.data[~gone].tobytes()
        sums = np.concatenate([[0], np.cumsum(gone)])
        removed = sums[chunk.offsets[1:]] - sums[chunk.offsets[:-1]]
        cuts = chunk.offsets - sums[chunk.offsets]
        opens, closes = gone.copy(), gone.copy()
        inner = np.zeros(len(gone) + 1, dtype=bool)
        inner[chunk.offsets] = True
        opens[1:] &= ~gone[:-1] | inner[1 : len(gone)]
        closes[:-1] &= ~gone[1:] | inner[1 : len(gone)]
        begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        of = np.searchsorted(chunk.offsets, begin, side="right") - 1
        n_spans = np.bincount(of, minlength=len(chunk.ids))
        texts = [kept[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        out = {
            "doc_id": pa.array(chunk.ids, mask=chunk.ids == NO_ID), "n_bytes": np.diff(chunk.offsets), "n_removed": removed, "n_spans": n_spans,
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
        }
        if with_text:
            shift = chunk.offsets[of]
            pairs = pa.StructArray.from_arrays([pa.array(begin - shift, pa.int32()), pa.array(end - shift, pa.int32())], ["start", "end"])
            out["spans"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_spans)]), pa.int32()), pairs)
            out["kept"] = pa.array(texts, pa.binary())
        return pa.table(out)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", spans array<struct<start:int,end:int>>, kept binary" if with_text else "")
    return rows.cogroup(chunked(known)).applyInArrow(cut, schema)
