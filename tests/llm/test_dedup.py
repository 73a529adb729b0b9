import contextlib
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import ODD
from plain import AZ, components, cut_repeats
from pyspark.sql import functions as F

from timberline.llm import exact_dedup as ed
from timberline.llm import near_dedup as nd
from timberline.llm import suffix_dedup as sd


def sha(text):
    return hashlib.sha256((text or "").translate(AZ).encode()).hexdigest()


def test_exact_groups_of_odd_rows(odd, none):
    found = ed.exact_duplicates(odd).collect()
    assert len(found) == len(ODD) and ed.exact_duplicates(none).count() == 0
    groups = {}
    for d, t, *_ in ODD:
        groups.setdefault(sha(t), []).append(d)
    for r in found:
        mine = groups[r.text_sha256]
        best = max((d for d in mine if d is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (best, len(mine), r.doc_id is not None and r.doc_id == best)
    assert {r.doc_id for r in found if r.group_size == 4} == {6, 7, 8}


def test_cuckoo_filter_overflows_resizes_and_deletes():
    index = ed.CuckooIndex(2)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        index.insert(k, i, 1)
        index.insert(k, i + 1, 2)
    assert index.resizes > 3 and all(index.find(k) == [k, i + 1, 3] for i, k in enumerate(keys))
    assert all(index.delete(k) for k in keys[:1500]) and not index.delete(keys[0])
    assert all(index.find(k) is None for k in keys[:1500]) and all(index.find(k) for k in keys[1500:])
    again = ed.CuckooIndex.of_row(index.row(0))
    assert sorted(again.entries()) == sorted(index.entries()) and all(again.filter.contains(k) for k in keys[1500:])


def test_fingerprint_collisions_do_not_merge():
    index = ed.CuckooIndex(4)
    a = bytes(range(32))
    b = a[:14] + bytes(18)  # same fingerprint, buckets and content bucket
    index.insert(a, 1, 1)
    assert index.filter.contains(b) and index.find(b) is None
    index.insert(b, 2, 1)
    assert index.find(a) == [a, 1, 1] and index.find(b) == [b, 2, 1]
    index.delete(a)
    assert index.find(b) == [b, 2, 1]


def test_index_updates(spark, odd):
    digested = ed.digests(odd)
    index = ed.build_index(digested, 4)
    gone = digested.where("doc_id = 4").select("text_sha256")
    more = spark.createDataFrame([(99, sha("two words")), (98, sha("new"))], "doc_id long, text_sha256 string")
    found = {r.text_sha256: (r.keep_id, r.group_size) for r in ed.live_classes(ed.update_index(index, 4, more, gone)).collect()}
    assert sha("one") not in found and found[sha("two words")] == (99, 2) and found[sha("new")] == (98, 1)


@pytest.mark.parametrize(("words", "percent", "region", "block"), [(3, 85, 512, 1000), (3, 85, 4, 3), (5, 80, 8, 2)])
def test_near_components(documents, texts, monkeypatch, words, percent, region, block):
    monkeypatch.setattr(nd, "REGION", region)
    monkeypatch.setattr(nd, "BLOCK", block)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(documents, words, percent).collect()}
    assert found == components(texts, words, percent)


@pytest.mark.parametrize("size", [32 << 20, 1500])
def test_near_links_across_blocks(spark, monkeypatch, size):
    """A long chain: each text is like the next one only, so it hangs together through regions of all blocks, of texts or of bytes."""
    monkeypatch.setattr(nd, "COMPARED_BYTES", size)
    monkeypatch.setattr(nd, "REGION", 6)
    monkeypatch.setattr(nd, "WINDOW", 4)
    monkeypatch.setattr(nd, "BLOCK", 4)
    w = [f"w{i}" for i in range(200)]
    texts = {i: " ".join(w[3 * i : 3 * i + 100]) for i in range(24)}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    expected = components(texts, 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(docs).collect()} == expected
    assert len({c for _, c in expected.values()}) == 1


def test_a_cut_run_loses_no_link(spark, monkeypatch):
    """150 linked pairs in one run of documents that are all almost linked: regions, windows and blocks part most of them."""
    monkeypatch.setattr(nd, "REGION", 8)
    monkeypatch.setattr(nd, "WINDOW", 4)
    monkeypatch.setattr(nd, "BLOCK", 20)
    common = [f"c{k}" for k in range(100)]
    rows = [(150 * j + i, " ".join([*common, f"p{i}", f"q{i}", *(f"u{i}x{j}x{k}" for k in range(8))])) for i in range(150) for j in (0, 1)]
    rows += [(900, rows[0][1]), (901, None), (902, "c1 c2"), (0, rows[0][1])]  # a copy, nothing, a short one, a repeated row
    found = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=1).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {*((d, d % 150) for d in range(300)), (900, 0), (901, 901), (902, 902)}


def test_long_texts_meet_in_bounded_blocks(spark, monkeypatch):
    """No comparison holds more texts than COMPARED_BYTES allows, a few times over since they are dealt by hash, and none is lost."""
    held = spark.sparkContext.accumulator(0)
    seen = []
    monkeypatch.setattr(nd, "COMPARED_BYTES", 1 << 20)
    confirm = nd._confirm

    def watched(words, percent):
        run = confirm(words, percent)

        def note(batches):
            sizes = {}
            for batch in batches:
                for label, part, text in zip(*(batch.column(c).to_pylist() for c in ("label", "part", "text")), strict=True):
                    sizes[label, part] = sizes.get((label, part), 0) + len(text)
                held.add(sum(s > 4 << 20 for s in sizes.values()))
                yield batch

        seen.append(1)
        return lambda batches: run(note(batches))

    monkeypatch.setattr(nd, "_confirm", watched)
    base = " ".join(f"w{i}" for i in range(15_000))
    docs = spark.range(120).select(F.col("id").alias("doc_id"), F.concat(F.lit(base), F.lit(" end"), F.col("id").cast("string")).alias("text"))
    found = nd.near_duplicates(docs).collect()
    assert {r.component_id for r in found} == {0} and len(found) == 120 and held.value == 0 and len(seen) > 1


def test_groups_come_whole():
    rng = np.random.default_rng(5)
    for _ in range(50):
        keys = np.sort(rng.integers(0, 6, 40))
        cuts = np.sort(rng.integers(0, 41, 7)).tolist()
        table = pa.table({"k": keys, "one": np.zeros(40, np.int64), "at": np.arange(40)})
        batches = [b for a, z in zip([0, *cuts], [*cuts, 40], strict=True) for b in table[a:z].to_batches()]
        out = [t["k"].to_pylist() for t in nd.whole_groups(batches, "one", "k")]
        assert sum(out, []) == keys.tolist() and all(a[-1] != b[0] for a, b in zip(out, out[1:], strict=False))


def test_regions_are_neighbours_in_the_order():
    """Every two rows of a region share a prefix; each run is whole, cut deeper, or covered by windows and blocks."""
    rng = np.random.default_rng(6)
    path = rng.integers(0, 3, (900, nd.DEPTH)).astype(np.uint32)
    path[:200] = 7
    tree, node = rng.integers(0, 2, 900), rng.permutation(900)
    order = np.lexsort((node, *path.T[::-1], tree))
    tree, path, node = tree[order], path[order], node[order]
    at, names = nd.cut_regions(tree, path, node, 20, 8)
    met = {}
    for row, name in zip(at, names, strict=True):
        met.setdefault(name, []).append(row)
    pairs, depths = set(), set()
    for rows in met.values():
        assert len({(tree[r], *path[r, : nd.SHALLOW]) for r in rows}) == 1 and len(rows) <= 21
        pairs |= {(a, b) for a in rows for b in rows if a < b}
        depths.add(next((d for d in range(nd.DEPTH, 0, -1) if len({tuple(path[r, :d]) for r in rows}) == 1), 0))
    assert depths >= {3, 4, 8}
    for r in range(899):  # neighbours with a long enough common prefix always meet
        if tree[r] == tree[r + 1] and (path[r, : nd.SHALLOW] == path[r + 1, : nd.SHALLOW]).all():
            assert (r, r + 1) in pairs
    small = [r for r in range(900) if sum((tree == tree[r]) & (path[:, : nd.SHALLOW] == path[r, : nd.SHALLOW]).all(axis=1)) <= 20]
    for r in small:
        for q in small:
            assert r >= q or tree[r] != tree[q] or (path[r, : nd.SHALLOW] != path[q, : nd.SHALLOW]).any() or (r, q) in pairs or (q, r) in pairs


def test_near_odd_rows(odd, none):
    found = {r.doc_id: r for r in nd.near_duplicates(odd).collect()}
    assert found[1].n_shingles == 0 and found[1].component_id == 1 and found[2].component_id == 2 and found[3].kept
    assert {found[d].component_id for d in (6, 7, 8)} == {6} and found[4].n_shingles == 1
    assert found[None].component_id is None and found[None].kept
    assert found[10].component_id == 9 and nd.near_duplicates(none).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 9), (3, 4), (8, 9), (100, 101)]
    found = {r.node: r.label for r in nd.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {2: 1, 3: 1, 4: 1, 8: 5, 9: 5, 101: 100}


@pytest.mark.parametrize("folded", [1 << 17, 40, 0])
def test_components_folded_or_by_stars(spark, monkeypatch, folded):
    """Long chains, a hub and repeated edges: by one task, by star steps and then one task, by star steps alone."""
    monkeypatch.setattr(nd, "FOLDED", folded)
    rng = random.Random(3)
    edges = [(100 + k, 101 + k) for k in range(60)] + [(7, 300 + k) for k in range(50)] + [(900 - k, 901 - k) for k in range(40)] + [(2, 7), (2, 7)]
    rng.shuffle(edges)
    expected = {100 + k: 100 for k in range(1, 61)} | {300 + k: 2 for k in range(50)} | {7: 2} | {901 - k: 861 for k in range(40)}
    found = [(r.node, r.label) for r in nd.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()]
    assert sorted(found) == sorted(expected.items())
    assert nd.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_small_tables_have_few_parts(spark, documents, texts, monkeypatch):
    """Many partitions that nothing coalesces: tables behind a shuffle still come from two tasks a core at most, and no paths are written where no run is crowded."""
    made, put = [], nd.written
    monkeypatch.setattr(nd, "written", lambda df, name, **how: made.append((name, put(df, name, **how))) or made[-1][1])
    monkeypatch.setattr(nd, "discard", lambda *tables: None)
    seen = {}
    monkeypatch.setattr(nd, "scratch", contextlib.nullcontext)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        seen = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(documents.repartition(2)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    few = 2 * spark.sparkContext.defaultParallelism
    assert seen == components(texts, 3, 85)
    assert few < 64 and {name for name, df in made if len(df.inputFiles()) > 2 * few} == set()  # regions are the union of two
    assert not any("path" in df.columns for _, df in made)


@pytest.mark.parametrize(("common", "in_all"), [(24, 4096), (2, 4096), (10**9, 10**9), (10**9, 2)])
def test_suffix_removal(documents, texts, monkeypatch, common, in_all):
    """Whatever seeds are taken for common: by default, nearly all in a chunk, none, nearly all in all chunks."""
    monkeypatch.setattr(sd, "COMMON", common)
    monkeypatch.setattr(sd, "COMMON_IN_ALL", in_all)
    found = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(documents, chunks=5).collect()}
    assert found == dict(zip(sorted(texts), cut_repeats([texts[d] for d in sorted(texts)]), strict=True))


def anchors_of(texts):
    rows = pa.table({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})
    chunk = sd.Chunk(rows)
    return chunk, sd.Anchors(chunk.data, chunk.offsets, 100)


PASSAGES = [" ".join(f"{w}{k}{i}" for k in range(30)) for i, w in enumerate(("alpha", "beta", "gamma"))]
REPEATING = [PASSAGES[0], "x" + PASSAGES[1], PASSAGES[0] + "y", PASSAGES[2] + PASSAGES[1], PASSAGES[0], "z" * 400]


def test_contexts_of_a_chunk_survive_collisions():
    chunk, found = anchors_of(REPEATING)
    found.context[:] = 0
    found.seed[:] = 0
    firsts, later = found.split_repeats(chunk.data, chunk.offsets, 100)
    raw, base = chunk.data.tobytes(), chunk.offsets[found.row]
    context = [raw[x:y] for x, y in zip(base + found.first, base + found.last + 100, strict=True)]
    assert sorted([*firsts, *later]) == list(range(len(found.row))) and len(later)
    assert {context[k] for k in later} <= {context[k] for k in firsts}
    # Under one hash only the first of all can be an earlier copy, so contexts may stay that the digests of all chunks decide.
    assert len({tuple(d) for d in found.take(firsts).digests(chunk.data, chunk.offsets, 100)}) == len({context[k] for k in firsts})


def test_strings_of_a_chunk_survive_collisions(monkeypatch):
    data = np.frombuffer(("ab" * 40 + "abc" * 30 + "ab" * 40).encode(), np.uint8)
    at = np.arange(len(data) - 19)
    raw = data.tobytes()
    for broken in (False, True):
        if broken:
            monkeypatch.setattr(sd, "content_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
        firsts, later = sd.first_strings(data, at, 20)
        assert sorted([*firsts, *later]) == at.tolist() and {raw[x : x + 20] for x in later} <= {raw[x : x + 20] for x in firsts}
        assert broken or len({raw[x : x + 20] for x in firsts}) == len(firsts)
    assert sd._binary(data, at[:50], 20).to_pylist() == [raw[x : x + 20] for x in range(50)]


def test_seeds_that_collide_give_the_same_repeats():
    """Contexts of different seeds in one group: the sort tells them apart by their bytes."""
    chunk, found = anchors_of(REPEATING)
    raw, base = chunk.data.tobytes(), chunk.offsets[found.row]
    contexts = sd.column_bytes(pa.array([raw[x:y] for x, y in zip(base + found.first, base + found.last + 100, strict=True)], pa.binary()))

    def repeats(seed):
        return sorted((int(k), int(x)) for again, start in sd.repeated_strings(seed, found.row, np.zeros_like(found.row), found.at, found.first, found.last, contexts, 100) for k, x in zip(again, start, strict=True))

    seen, expected = set(), []
    for k, (row, first, last) in enumerate(zip(found.row, found.first, found.last, strict=True)):
        for x in range(first, last + 1):
            piece = raw[chunk.offsets[row] + x : chunk.offsets[row] + x + 100]
            expected += [(k, x)] * (piece in seen)
            seen.add(piece)
    assert repeats(found.seed) == expected and repeats(np.zeros_like(found.seed)) == expected


def test_digests_decide_whole_contexts(spark):
    """Rows of one seed and one half of the digest are one context only if the other half agrees."""
    rows = pa.table({"route": [7, 7, 7, 7], "c1": [1, 1, 1, 2], "c2": [5, 6, 5, 5], "doc_id": [1, 2, 3, 4], "ordinal": [0, 0, 0, 0], "at": [0, 0, 0, 0], "spread": [False] * 4})
    (out,) = sd._decide(100)(iter(rows.to_batches()))
    assert {r["doc_id"]: (r["whole"], r["common"]) for r in out.to_pylist()} == {1: (False, False), 2: (False, False), 3: (True, False), 4: (False, False)}
    (out,) = sd._decide(3)(iter(rows.to_batches()))
    assert {r["doc_id"]: (r["whole"], r["common"]) for r in out.to_pylist()} == {1: (False, True), 2: (False, True), 3: (True, True), 4: (False, True)}


def test_suffix_removal_around_a_common_passage(spark):
    """One passage in many surroundings, over several chunks, with the default bound."""
    rng = random.Random(7)
    passage = " ".join(rng.choice("lorem ipsum dolor sit amet tempor magna".split()) + str(i) for i in range(40))
    texts = {i: f"{rng.random()} {'x' * rng.randrange(90)} {passage} {rng.random()}" * (1 + i % 2) for i in range(150)}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    found = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(docs, chunks=3).collect()}
    assert found == dict(zip(texts, cut_repeats(texts.values()), strict=True))


def test_suffix_removal_of_odd_rows(odd, none):
    found = sd.remove_repeats(odd).collect()
    order = sorted(ODD, key=lambda r: (-1 if r[0] is None else r[0], (r[1] or "").encode()))
    expected = [(d, *x) for (d, *_), x in zip(order, cut_repeats([r[1] for r in order]), strict=True)]
    assert sorted(((r.doc_id, r.n_removed, r.n_spans, r.kept_sha256) for r in found), key=str) == sorted(expected, key=str)
    for r in found:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(s.end - s.start for s in r.spans) == r.n_removed
    assert sd.remove_repeats(none).count() == 0


def test_suffix_sort_matches_plain_sort_and_survives_collisions(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    starts = rng.integers(0, 2900, 400)
    group = np.sort(rng.integers(0, 5, 400))
    raw = data.tobytes()
    expected = sorted(range(400), key=lambda i: (group[i], raw[starts[i] : starts[i] + 80]))
    for broken in (False, True):
        made = sd.Suffixes(data, starts, starts + 80)
        if broken:
            made.prefix = np.zeros_like(made.prefix)  # every comparison collides
        rank, shared = made.ranked(group)
        got = np.argsort(rank)
        assert [raw[starts[i] : starts[i] + 80] for i in got] == [raw[starts[i] : starts[i] + 80] for i in expected]
        for k in range(1, 400):
            a, b = got[k - 1], got[k]
            if group[a] == group[b]:
                n = next((n for n in range(80) if raw[starts[a] + n] != raw[starts[b] + n]), 80)
                assert shared[k] == n


