"""Near-duplicate groups with an LSH forest of MinHash signatures.

A document's set holds the hashes of its distinct word shingles. Its signature
is cut into ``TREES`` orders of ``DEPTH`` minhashes each. In every order the
documents are sorted by their minhashes, over all tasks by range; neighbours
in the order are the documents with the longest common prefix.

1. Documents with equal sets are one class, represented by its smallest id.
2. A run of neighbours whose common prefix is ``SHALLOW`` minhashes or longer
   is a region. Where a run has more than ``REGION`` documents it is cut where
   common prefixes are shortest, deeper and deeper, so each region has a depth
   of its own. In such a crowded run every document also meets its nearest
   neighbours in the order (windows of ``WINDOW``, overlapping by half), so
   that a cut parts no neighbours. Runs still too large at full depth (very
   many near copies) become blocks that all hold the run's first document.
   Documents of a region whose sketches (a byte of each minhash) agree well
   enough are candidates.
3. Candidate pairs span candidate components, found by alternating star steps.
4. The texts of a component meet in blocks of ``BLOCK`` texts or
   ``COMPARED_BYTES``; there all pairs are compared on whole sets, as a product of incidence matrices over the
   shingles that occur twice. For a component of several blocks the first
   documents of what the blocks found meet next. After that, documents of one
   region that are still apart and whose sketches agree are compared, region
   by region; that is a bounded number of rows a document, however a
   component hangs together. A region of very long texts is dealt into parts
   there, and every two parts meet.
5. What crowded runs are cut into loses no link: documents of runs that hold
   several of the components found so far meet once more, exactly. By the
   prefix principle, two sets that are linked share one of the
   n - ceil(s * n) + 1 rarest shingles of each. All documents of such a
   shingle meet, in parts of bounded rows and bytes, every two parts that
   don't belong to one component; no sketch is asked.
6. The confirmed links give the components.

A pair is missed only if no chain of candidates joins it: it shares no run of
SHALLOW minhashes with a link in it, or, where its run isn't crowded, its
sketches disagree by far more than its similarity allows. The chance that a
pair shares no run is (1 - s ** 3) ** 16 for similarity s: 2.4e-7 at 0.85 and
1.0e-5 at 0.80. A crowded run counts as a whole in step 5, however it is cut
and wherever a task's range ends.

Tasks take regions and blocks one after another, in sorted order, and hold a
batch and one of them at a time; shuffles get more partitions as the corpus
grows (``PART_ROWS``, ``PART_BYTES``). What comes out of them is read by a task
for every ``TASK_ROWS`` documents or ``CHUNK_BYTES`` of text, two a core at least,
and not by more, however many partitions the session has: most tables here are
far smaller than the corpus. Runs are counted and joined as (document, hash);
paths move for crowded runs only.

Defined results: a text with fewer words than a shingle is one shingle of all
its words; a null text or one without words has no set and is linked with
nothing; rows that repeat a doc_id are the same document; a row whose id is
null keeps component_id null and is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import CHUNK_BYTES, discard, partitions, scratch, written
from ._text import mix64, text_blocks, word_hashes

TREES, DEPTH, SHALLOW = 16, 8, 3
REGION, WINDOW, BLOCK = 512, 64, 1000
#: The most bytes of text that are compared at once, unless one text has more.
COMPARED_BYTES = 32 << 20
#: Documents, and bytes of their texts, behind one partition of a shuffle.
PART_ROWS, PART_BYTES = 128_000, 128 << 20
#: Documents, beside CHUNK_BYTES of their texts, behind one task that reads a shuffle.
TASK_ROWS = 16_000
#: The most edges (16 bytes each) that one task folds to components; more are first reduced by star steps.
FOLDED = 1 << 17
#: How far below the wanted similarity a sketch may fall and still be checked; over four standard deviations.
MARGIN = 0.15

_MULTIPLIERS = (mix64(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADDENDS = (mix64(np.arange(1001, TREES * DEPTH + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, by row and value, and the bounds of the rows."""
    hashes, rows = word_hashes(data, offsets)
    docs = len(offsets) - 1
    words = np.bincount(rows, minlength=docs)
    count = max(0, len(hashes) - n + 1)
    joined = np.zeros(count, np.uint64)
    for k in range(n):
        joined = joined * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + count]
    at = np.flatnonzero(rows[:count] == rows[n - 1 : n - 1 + count]) if count else np.zeros(0, np.int64)
    keys, of = [mix64(joined[at])], [rows[at]]
    first = np.cumsum(words) - words
    for size in range(1, n):  # short texts: the whole sequence
        short = np.flatnonzero(words == size)
        whole = np.full(len(short), np.uint64(size))
        for k in range(size):
            whole = whole * np.uint64(0xD6E8FEB86659FD93) + hashes[first[short] + k]
        keys.append(mix64(whole))
        of.append(short)
    key, row = np.concatenate(keys), np.concatenate(of)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return key[new], np.searchsorted(row[new], np.arange(docs + 1))


def signatures(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minhashes of the rows that have a set."""
    filled = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(filled), TREES * DEPTH), np.uint32)
    if len(filled):
        x = (keys >> np.uint64(32)).astype(np.uint32)
        for k in range(TREES * DEPTH):
            out[:, k] = np.minimum.reduceat(x * _MULTIPLIERS[k] + _ADDENDS[k], bounds[filled])
    return out


SIGNED = "doc_id long, n long, bytes long, d1 long, d2 long, signature binary"


def _sign(words: int):
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column("text")):
                keys, bounds = shingle_sets(data, offsets, words)
                sizes = np.diff(bounds)
                signed = signatures(keys, bounds)
                digests = []
                for salt in (0x1B873593CC9E2D51, 0x85EBCA6BC2B2AE35):
                    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(keys ^ np.uint64(salt)), dtype=np.uint64)])
                    digests.append(mix64(sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
                packed = np.full(b - a, b"", dtype=object)
                packed[sizes > 0] = [x.tobytes() for x in signed]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(sizes, pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(digests[0]), pa.array(digests[1]), pa.array(packed.tolist(), pa.binary())], ["doc_id", "n", "bytes", "d1", "d2", "signature"])

    return run


def _plant(batches):
    """(node, tree, crowd, path) for each order: a hash of the first SHALLOW minhashes, and all of them as sortable bytes."""
    for trees, tree, nodes, crowd in _orders(batches):
        paths = pa.Array.from_buffers(pa.binary(), len(trees), [None, pa.py_buffer((np.arange(len(trees) + 1) * 4 * DEPTH).astype(np.int32)), pa.py_buffer(trees.astype(">u4"))])
        yield pa.RecordBatch.from_arrays([nodes, pa.array(tree, pa.int32()), crowd, paths], ["node", "tree", "crowd", "path"])


def _crowds(batches):
    """(node, crowd): what ``_plant`` gives, without paths."""
    for _, _, nodes, crowd in _orders(batches):
        yield pa.RecordBatch.from_arrays([nodes, crowd], ["node", "crowd"])


def _orders(batches):
    """(rows of minhashes, their tree, node and crowd) of a batch, TREES rows a document."""
    for batch in batches:
        if batch.num_rows:
            trees = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, DEPTH)
            tree = np.tile(np.arange(TREES), batch.num_rows)
            crowd = mix64(tree.astype(np.uint64))
            for d in range(SHALLOW):
                crowd = mix64(crowd * np.uint64(0xA0761D6478BD642F) + trees[:, d])
            nodes = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), TREES)
            yield trees, tree, pa.array(nodes), pa.array(crowd.view(np.int64))


def cut_regions(tree: np.ndarray, path: np.ndarray, node: np.ndarray, region: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, region) pairs of rows sorted by tree, path (rows of minhashes) and node; regions of one row are left out.

    A region's number is drawn from its first row, so parts of one run in
    different tasks are different regions.
    """
    m = len(node)
    same = (path[1:] == path[:-1]) & (tree[1:] == tree[:-1])[:, None]
    common = np.append(0, np.cumprod(same, axis=1).sum(axis=1)) if m else np.zeros(0, np.int64)  # with the row before
    rows, names, still = [], [], np.ones(m, dtype=bool)

    def add(which: np.ndarray, first: np.ndarray, kind: np.ndarray | int) -> None:
        rows.append(which)
        names.append(mix64(mix64(node[first].view(np.uint64) * np.uint64(TREES) + tree[first].astype(np.uint64)) + np.asarray(kind).astype(np.uint64)))

    for depth in range(SHALLOW, DEPTH + 1):
        opens = np.flatnonzero(common < depth)
        run = np.cumsum(common < depth) - 1
        size = np.diff(np.append(opens, m))[run] if m else run
        if depth == SHALLOW:
            crowded, start = np.flatnonzero(size > region), opens[run] if m else run
        done = np.flatnonzero(still & (size <= region))
        many = done[size[done] > 1]
        add(many, opens[run[many]], depth)
        still[done] = False
    left = np.flatnonzero(still)  # of full depth
    if len(left):
        first = opens[run[left]]
        block = (left - first) // region
        add(left, first, DEPTH + 1 + block)
        heads = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (block[1:] != block[:-1])) & (block > 0))
        add(first[heads], first[heads], DEPTH + 1 + block[heads])
    step = (crowded - start[crowded]) // (window // 2)
    for family in (0, 1):
        add(crowded, start[crowded], (1 << 40) + 2 * ((step + family) // 2) + family)
    return np.concatenate(rows), np.concatenate(names).view(np.int64)


def _neighbours(region: int, window: int):
    """(node, region) of a task's part of the orders, whose rows come sorted."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        sorted_rows = pa.Table.from_batches(held).combine_chunks()
        tree, node = (sorted_rows[c].to_numpy() for c in ("tree", "node"))
        path = np.frombuffer(b"".join(sorted_rows["path"].to_pylist()), ">u4").reshape(-1, DEPTH)
        at, names = cut_regions(tree, path, node, region, window)
        for a in range(0, len(at), 1 << 20):
            some = at[a : a + (1 << 20)]
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(names[a : a + (1 << 20)])], ["node", "region"])

    return run


def _sketch(batches):
    for batch in batches:
        if batch.num_rows:
            low = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(batch.num_rows, -1, 4)[:, :, 0]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), batch.column("bytes"), pa.array([x.tobytes() for x in low], pa.binary())], ["node", "n", "bytes", "sketch"])


def whole_groups(batches, *keys: str):
    """Tables of whole groups, from batches of rows that are sorted by ``keys``."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
        opens = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
        if held and tuple(ids[0]) != last:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if len(opens):
            yield pa.Table.from_batches([*held, batch[: opens[-1]]]).combine_chunks()
            held, batch = [], batch[opens[-1] :]
        held, last = [*held, batch], tuple(ids[-1])
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def spanning_stars(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix: the first index of each one's component."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] < 0:
            reached = np.zeros(len(linked), dtype=bool)
            reached[i] = True
            front = reached
            while front.any():
                front = linked[front].any(axis=0) & ~reached
                reached |= front
            root[reached] = i
    return root


def _close_in_regions(batches, percent: int):
    """(rows, index arrays of regions of one size, which of their pairs have agreeing sketches) over a task's regions, which come sorted."""
    for rows in whole_groups(batches, "region"):
        yield from _close_pairs(rows, percent)


def _close_pairs(rows: pa.Table, percent: int):
    least = max(0.0, percent / 100 - MARGIN)
    bar = TREES * DEPTH * (least * 255 / 256 + 1 / 256)
    region, node, n = (rows[c].to_numpy() for c in ("region", "node", "n"))
    order = np.lexsort((node, region))
    again = np.flatnonzero((node[order][1:] == node[order][:-1]) & (region[order][1:] == region[order][:-1])) + 1
    order = np.delete(order, again)
    region, n = region[order], n[order]
    sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(len(node), -1)[order]
    opens = np.flatnonzero(np.append(True, region[1:] != region[:-1]))
    sizes = np.diff(np.append(opens, len(region)))
    for size in np.unique(sizes[sizes > 1]).tolist():
        every = opens[sizes == size]
        step = max(1, (1 << 21) // (size * size))
        for k in range(0, len(every), step):
            at = every[k : k + step, None] + np.arange(size)
            s, m = sketch[at], n[at]
            agree = np.zeros((len(at), size, size), np.int16)
            for c in range(s.shape[2]):
                agree += s[:, :, None, c] == s[:, None, :, c]
            yield rows, order[at], (agree >= bar) & (100 * np.minimum(m[:, :, None], m[:, None, :]) >= percent * np.maximum(m[:, :, None], m[:, None, :]))


def _candidates(percent: int):
    """(a, b): stars that join what agrees in a region."""

    def run(batches):
        out_a, out_b = [], []
        for rows, at, close in _close_in_regions(batches, percent):
            node = rows["node"].to_numpy()
            if at.shape[1] == 2:
                pair = at[close[:, 0, 1]]
                out_a.append(node[pair[:, 0]])
                out_b.append(node[pair[:, 1]])
                continue
            for g in np.flatnonzero(close.sum(axis=(1, 2)) > at.shape[1]):
                root = spanning_stars(close[g])
                some = np.flatnonzero(root != np.arange(len(root)))
                out_a.append(node[at[g, root[some]]])
                out_b.append(node[at[g, some]])
        if out_a:
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _apart(percent: int, most: int):
    """(region as label, part, node, own) of documents that agree with one of another part of their component in their region.

    Texts of more than ``most`` bytes are dealt into heaps of about so many,
    and a part is two heaps: every two of them meet.
    """

    def run(batches):
        for rows, at, close in _close_in_regions(batches, percent):
            region, node, own, size = (rows[c].to_numpy() for c in ("region", "node", "own", "bytes"))
            asks = (close & (own[at][:, :, None] != own[at][:, None, :])).any(axis=2)
            heavy = (size[at] * asks).sum(axis=1) > most
            light = at[asks & ~heavy[:, None]]
            label, who, part = [region[light]], [light], [np.zeros(len(light), np.int64)]
            for g in np.flatnonzero(heavy).tolist():
                some = at[g][asks[g]]
                heap = (np.cumsum(size[some]) - size[some]) // most
                heaps = int(heap[-1]) + 1
                for other in range(heaps):
                    label.append(region[some])
                    who.append(some)
                    part.append(np.minimum(heap, other) * heaps + np.maximum(heap, other))
            which = np.concatenate(who)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(label)), pa.array(np.concatenate(part)), pa.array(node[which]), pa.array(own[which])], ["label", "part", "node", "own"])

    return run


def _fold(batches):
    """(a, b): edges of a task as stars around the smallest node of each component."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    edges = pa.Table.from_batches(held)
    nodes, at = np.unique(np.concatenate([edges["a"].to_numpy(), edges["b"].to_numpy()]), return_inverse=True)
    one, two = at[: len(edges)], at[len(edges) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[one], root[two]), np.maximum(root[one], root[two])
        apart = low != high
        if not apart.any():
            break
        one, two = one[apart], two[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    some = root != np.arange(len(root))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[root[some]]), pa.array(nodes[some])], ["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of its component for every node of (a, b) edges with a < b; edges are read twice.

    Alternating large and small star steps, while there are more edges than a
    task may fold; each pair of steps is written to the shared folder.
    Aggregates fold a hub's edges before the shuffle, and the join back to
    them is one that AQE can split. The rest is folded at once.
    """

    def total(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now, last = edges.select("a", "b"), []
    mark = total(now)
    while mark[0] > FOLDED:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b")
        # each edge is (smaller a, larger b): small star of b over its smaller neighbours
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()
        now = written(small, "edges")
        discard(*last)
        last, before, mark = [now], mark, total(now)
        if mark == before:
            break
    else:
        now = written(now.coalesce(1).mapInArrow(_fold, "a long, b long"), "edges")
        discard(*last)
    return now.select(F.col("b").alias("node"), F.col("a").alias("label"))


def overlaps(keys: np.ndarray, of: np.ndarray, docs: int) -> np.ndarray:
    """Sizes of all pairwise intersections of sets given as (key, document) pairs."""
    order = np.argsort(keys, kind="stable")
    keys, of = keys[order], of[order]
    new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1 if len(keys) else new
    of, column = of[shared], column[shared]
    column = np.cumsum(np.append(True, column[1:] != column[:-1])) - 1 if len(column) else column
    out = np.zeros((docs, docs), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        x, y = np.searchsorted(column, [a, a + 4096])
        seen = np.zeros((docs, 4096), np.float32)
        seen[of[x:y], column[x:y] - a] = 1
        out += seen @ seen.T
    return out


def _confirm(words: int, percent: int):
    """(a, b) links within each (label, part) of a task's rows, which come sorted, as stars around the first of each component found; only between rows of different ``own``, if there is such a column."""

    def run(batches):
        for rows in whole_groups(batches, "label", "part"):
            label, part = (rows[c].to_numpy() for c in ("label", "part"))
            opens = np.flatnonzero(np.append(True, (label[1:] != label[:-1]) | (part[1:] != part[:-1])))
            stars = [block(rows[a:b]) for a, b in zip(opens.tolist(), np.append(opens[1:], len(label)).tolist(), strict=True)]
            one, two = (np.concatenate([s[k] for s in stars]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], ["a", "b"])

    def block(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        node = rows["node"].to_numpy()
        keys, of, sizes = [], [], []
        for x, y, data, offsets in text_blocks(rows["text"]):
            k, bounds = shingle_sets(data, offsets, words)
            keys.append(k)
            of.append(np.repeat(np.arange(x, y), np.diff(bounds)))
            sizes.append(np.diff(bounds))
        n = np.concatenate(sizes)
        both = overlaps(np.concatenate(keys), np.concatenate(of), len(node))
        linked = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        linked &= (n > 0)[:, None] & (n > 0)[None, :]
        if "own" in rows.column_names:
            own = rows["own"].to_numpy()
            linked &= own[:, None] != own[None, :]
        one = node[spanning_stars(linked | linked.T)]
        some = one != node
        return one[some], node[some]

    return run


def _dealt(rows: DataFrame, n: int, few: int, *keys: str) -> DataFrame:
    """``rows`` by ``keys``, whole groups in sorted tasks; not in more tasks than the corpus needs, since a Python task of a few rows costs more than its work."""
    return rows.repartition(n, *keys).coalesce(few).sortWithinPartitions(*keys)


def _parts():
    """How many blocks of about ``BLOCK`` texts and ``COMPARED_BYTES`` a group's rows need."""
    return F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / COMPARED_BYTES)).cast("long")


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; linked if the sets' Jaccard similarity is at least ``percent`` %."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(texts.mapInArrow(_sign(words), SIGNED), "signatures")
    count, size = signed.agg(F.count("*"), F.sum("bytes")).first()
    n = max(partitions(docs.sparkSession), count // PART_ROWS, (size or 0) // PART_BYTES)
    few = max(2 * docs.sparkSession.sparkContext.defaultParallelism, count // TASK_ROWS, (size or 0) // CHUNK_BYTES)
    named = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(named.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("node"), F.max("bytes").alias("bytes"), F.first("signature").alias("signature")).coalesce(few), "set-classes")

    with scratch():
        # Regions of the forest: rows that share SHALLOW minhashes with another. Only those of crowded runs need their paths, sorted; such a run may span tasks
        signed_nodes = classes.select("node", "signature")
        planted = signed_nodes.mapInArrow(_crowds, "node long, crowd long")
        crowds = written(planted.groupBy("crowd").agg(F.count("*").alias("c")).where("c > 1").coalesce(few), "crowds")
        runs = written(crowds.where(F.col("c") > REGION).select("crowd").coalesce(1 + count // PART_ROWS), "crowded-runs")  # at most one for REGION documents and order
        small = crowds.where(F.col("c") <= REGION).select(F.col("crowd").alias("region"))
        # by shuffle at every size: the runs grow with the corpus
        regions = planted.withColumnRenamed("crowd", "region").join(small.hint("merge"), "region").select("node", "region").coalesce(few)
        crowded = None
        if runs.limit(1).count():
            forest = signed_nodes.mapInArrow(_plant, "node long, tree int, crowd long, path binary")
            crowded = written(forest.join(runs, "crowd"), "crowded")
            ordered = crowded.select("node", "tree", "path").repartitionByRange(n, "tree", "path", "node").coalesce(few).sortWithinPartitions("tree", "path", "node")
            regions = regions.unionByName(ordered.mapInArrow(_neighbours(REGION, WINDOW), "node long, region long"))
        regions = written(regions, "regions")
        sketches = classes.select("node", "n", "bytes", "signature").mapInArrow(_sketch, "node long, n long, bytes long, sketch binary")
        candidates = written(_dealt(regions.join(sketches, "node"), n, few, "region").mapInArrow(_candidates(percent), "a long, b long"), "candidates")
        labels = connected_components(candidates)
        roots = labels.select(F.col("label").alias("node"), "label").distinct()
        members = labels.unionByName(roots)

        # Exact comparison in blocks
        known = classes.select("node", "n", "d1", "d2")
        one_text = texts.withColumnRenamed("doc_id", "node")  # by shuffle at every size: the members grow with the corpus
        content = written(one_text.join(members.hint("merge"), "node").select("label", "node", F.octet_length("text").cast("long").alias("bytes"), "text").coalesce(few), "candidate-texts")
        several = written(content.groupBy("label").agg(_parts().alias("parts")).where("parts > 1").coalesce(few), "large-components")
        parts = F.coalesce("parts", F.lit(1))
        blocks = content.join(several, "label", "left").withColumn("part", F.pmod(F.xxhash64("node"), parts))
        found = written(_dealt(blocks, n, few, "label", "part").mapInArrow(_confirm(words, percent), "a long, b long"), "links")
        if several.limit(1).count():
            found = _across_blocks(content.join(several, "label"), found, regions, sketches, words, percent, n, few)
        final = connected_components(found)
        rest = crowded and _cut_apart(crowded, final, few)
        if rest and rest.limit(1).count():
            final = connected_components(found.unionByName(_across_cuts(one_text, rest, words, percent, n, few)))
        final = written(final, "components", lasting=True)

    reps = signed.join(known, ["n", "d1", "d2"], "left").select("doc_id", "n", F.coalesce("node", "doc_id").alias("node"))
    out = reps.join(final, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "node")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _across_blocks(large: DataFrame, found: DataFrame, regions: DataFrame, sketches: DataFrame, words: int, percent: int, n: int, few: int) -> DataFrame:
    """``found`` with the links between the blocks of components that have several."""

    def parts(edges: DataFrame) -> DataFrame:
        """Each document of a large component with the part of it that the links found so far join."""
        return large.select("label", "node", "bytes").join(connected_components(edges).select("node", F.col("label").alias("own")), "node", "left").withColumn("own", F.coalesce("own", "node"))

    def confirmed(groups: DataFrame) -> DataFrame:
        content = groups.join(large.select("node", "text"), "node")
        return written(_dealt(content, n, few, "label", "part").mapInArrow(_confirm(words, percent), "a long, b long"), "links")

    firsts = parts(found).where("node = own")
    crowd = firsts.groupBy("label").agg(_parts().alias("heads"))
    met = firsts.join(crowd, "label").withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("heads")).cast("int"))
    found = found.unionByName(confirmed(met.select("label", "part", "node")))
    placed = regions.join(parts(found).select("node", "own"), "node")
    mixed = placed.groupBy("region").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low < high").select("region")
    asking = _dealt(placed.join(mixed, "region").join(sketches, "node"), n, few, "region").mapInArrow(_apart(percent, COMPARED_BYTES // 2), "label long, part long, node long, own long")
    return found.unionByName(confirmed(asking))


def _cut_apart(crowded: DataFrame, components: DataFrame, few: int) -> DataFrame:
    """(node, own) of documents in ``crowded`` runs that hold several components."""
    owned = written(crowded.select("crowd", "node").join(components.select("node", F.col("label").alias("own")), "node", "left").withColumn("own", F.coalesce("own", "node")).coalesce(few), "crowd-owns")
    mixed = owned.groupBy("crowd").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low < high").select("crowd")
    return written(owned.join(mixed, "crowd").select("node", "own").distinct().coalesce(few), "cut-apart")


def _shingled(words: int):
    """(node, own, whole, bytes, n, key): the set of each text."""

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column("text")):
                keys, bounds = shingle_sets(data, offsets, words)
                sizes = np.diff(bounds)
                of = np.repeat(np.arange(a, b), sizes)
                length = pa.array(np.repeat(np.diff(offsets), sizes), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(of)), batch.column("own").take(pa.array(of)), batch.column("whole").take(pa.array(of)), length, pa.array(np.repeat(sizes, sizes), pa.int64()), pa.array(keys.view(np.int64))], ["node", "own", "whole", "bytes", "n", "key"])

    return run


def _across_cuts(texts: DataFrame, rest: DataFrame, words: int, percent: int, n: int, few: int) -> DataFrame:
    """Links between documents of ``rest`` (node, own) whose ``own`` differs, all of them: a join by the rarest shingles of each set.

    Of shingles that have the same documents one is enough. The documents of
    one are dealt into heaps, those of a large ``own`` into heaps of its own;
    every two heaps that hold more than one ``own`` between them meet.
    """
    content = written(texts.join(rest, "node").where("text IS NOT NULL").coalesce(few), "cut-texts")
    named = content.select("node", "own", F.xxhash64("text").alias("whole"), "text")  # an id may stand for several texts, or be repeated with one
    shingles = written(named.mapInArrow(_shingled(words), "node long, own long, whole long, bytes long, n long, key long"), "cut-shingles")
    asked = shingles.join(shingles.groupBy("key").agg(F.count("*").alias("df")), "key")
    rank = F.dense_rank().over(Window.partitionBy("node", "whole").orderBy("df", "key"))
    prefix = asked.withColumn("rank", rank).where(f"rank <= n - ({percent} * n + 99) div 100 + 1 AND df > 1").groupBy("key", "node", "own").agg(F.max("bytes").alias("bytes"))
    prefix = written(prefix.coalesce(few), "cut-prefixes")

    members = F.sum(F.xxhash64("node").cast("decimal(38,0)")), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)"))
    mixed = prefix.groupBy("key").agg(F.count("*").alias("c"), members[0].alias("m1"), members[1].alias("m2"), F.min("own").alias("low"), F.max("own").alias("high")).where("low < high")
    once = mixed.groupBy("c", "m1", "m2").agg(F.min("key").alias("key")).select("key")
    met = written(prefix.join(once, "key").coalesce(few), "cut-buckets")
    half = lambda rows, size: F.greatest(F.ceil(rows / (BLOCK // 2)), F.ceil(size / (COMPARED_BYTES // 2))).cast("long")
    owns = met.groupBy("key", "own").agg(F.count("*").alias("c"), F.sum("bytes").alias("size")).withColumn("parts", half(F.col("c"), F.col("size")))
    small = owns.where("parts = 1").groupBy("key").agg(half(F.sum("c"), F.sum("size")).alias("shared"))
    heap = F.when(F.col("parts") > 1, F.xxhash64("own", F.pmod(F.xxhash64("node", F.lit(2)), "parts"))).otherwise(F.pmod(F.xxhash64("own"), "shared"))
    dealt = met.join(owns.select("key", "own", "parts"), ["key", "own"]).join(small, "key", "left").select("key", "node", "own", heap.alias("heap"))
    dealt = written(dealt.coalesce(few), "cut-heaps")
    heaps = dealt.groupBy("key", "heap").agg(F.min("own").alias("low"), F.max("own").alias("high"))
    other = heaps.select("key", F.col("heap").alias("heap2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    two = heaps.join(other, "key").where("heap <= heap2 AND least(low, low2) < greatest(high, high2)")
    two = two.select("key", F.xxhash64("heap", "heap2").alias("part"), F.explode(F.array_distinct(F.array("heap", "heap2"))).alias("heap"))
    groups = dealt.join(two, ["key", "heap"]).select(F.col("key").alias("label"), "part", "node", "own")
    gathered = groups.join(content.select("node", "text"), "node")
    return written(_dealt(gathered, n, few, "label", "part").mapInArrow(_confirm(words, percent), "a long, b long"), "links")
