"""Exact deduplication through a partitioned cuckoo-filter index.

A text's key is the SHA-256 of its bytes after lower-casing A-Z. Keys are
dealt over parts by hash; each part holds a cuckoo filter over the keys that
are live and, in buckets beside it, the whole keys with the row that stays and
the group's size. A key that the filter doesn't know is new without looking
further. A key that it seems to know is compared in full with the content of
its bucket, so a fingerprint collision never merges two texts. When an insert
finds no slot, the filter doubles and is refilled from the stored keys.

Copies are folded within each Arrow batch before the shuffle, so a text that
makes up a third of the corpus reaches its part as one row per batch.

Defined results: a null text counts as empty; rows with a null id count in
their group's size and never win; rows that repeat a doc_id and a text are one
document and share its decision; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import lower_ascii, partitions, written

SLOTS, MAX_KICKS = 4, 200
NO_ID = -(2**63)
#: Rows that a part of the index is planned for; a part is held by one task.
PART_ROWS = 200_000
INDEX_SCHEMA = "part int, log2_buckets int, fingerprints binary, digests binary, keeps binary, sizes binary"


class Overflow(Exception):
    """No free slot was found within MAX_KICKS moves."""


class CuckooFilter:
    """Four-slot buckets of 16-bit fingerprints with partial-key cuckoo hashing."""

    def __init__(self, log2_buckets: int):
        self.log2 = log2_buckets
        self.mask = (1 << log2_buckets) - 1
        self.slots = [[] for _ in range(1 << log2_buckets)]

    def places(self, digest: bytes) -> tuple[int, int, int]:
        """Fingerprint and the two buckets of a 32-byte digest."""
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") & self.mask
        return mark, first, self.other(first, mark)

    def other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def contains(self, digest: bytes) -> bool:
        mark, a, b = self.places(digest)
        return mark in self.slots[a] or mark in self.slots[b]

    def insert(self, digest: bytes) -> None:
        mark, a, b = self.places(digest)
        for bucket in (a, b):
            if len(self.slots[bucket]) < SLOTS:
                self.slots[bucket].append(mark)
                return
        bucket = b
        for kick in range(MAX_KICKS):
            held = self.slots[bucket]
            held[kick % SLOTS], mark = mark, held[kick % SLOTS]
            bucket = self.other(bucket, mark)
            if len(self.slots[bucket]) < SLOTS:
                self.slots[bucket].append(mark)
                return
        raise Overflow

    def delete(self, digest: bytes) -> bool:
        mark, a, b = self.places(digest)
        for bucket in (a, b):
            if mark in self.slots[bucket]:
                self.slots[bucket].remove(mark)
                return True
        return False


class CuckooIndex:
    """Live digests of one part: a filter in front of buckets of whole keys, each with what is known of it."""

    def __init__(self, log2_buckets: int = 4):
        self.filter = CuckooFilter(log2_buckets)
        self.buckets: dict[int, list[list]] = defaultdict(list)  # [digest, keep_id, size]
        self.resizes = 0

    @staticmethod
    def bucket_of(digest: bytes) -> int:
        return int.from_bytes(digest[10:14], "little")

    def entries(self):
        return chain.from_iterable(self.buckets.values())

    def find(self, digest: bytes) -> list | None:
        """The entry of a live digest: filter first, then the bucket's whole keys."""
        if not self.filter.contains(digest):
            return None
        return next((e for e in self.buckets.get(self.bucket_of(digest), ()) if e[0] == digest), None)

    def insert(self, digest: bytes, keep: int | None, size: int) -> None:
        """Add ``size`` rows of a text, the largest id among them being ``keep``."""
        entry = self.find(digest)
        if entry is not None:
            entry[1] = keep if entry[1] is None else entry[1] if keep is None else max(entry[1], keep)
            entry[2] += size
            return
        self.buckets[self.bucket_of(digest)].append([digest, keep, size])
        try:
            self.filter.insert(digest)
        except Overflow:
            self.resize()

    def resize(self) -> None:
        """Double until all stored keys fit; the filter itself can't be refilled from."""
        log2 = self.filter.log2
        while True:
            log2, self.resizes = log2 + 1, self.resizes + 1
            self.filter = CuckooFilter(log2)
            try:
                for digest, _, _ in self.entries():
                    self.filter.insert(digest)
                return
            except Overflow:
                continue

    def delete(self, digest: bytes) -> bool:
        """Take a digest out; False if it wasn't live."""
        entry = self.find(digest)
        if entry is None:
            return False
        self.buckets[self.bucket_of(digest)].remove(entry)
        self.filter.delete(digest)
        return True

    def row(self, part: int) -> dict:
        marks = np.zeros((1 << self.filter.log2, SLOTS), dtype="<u2")
        for at, held in enumerate(self.filter.slots):
            marks[at, : len(held)] = held
        digests, keeps, sizes = zip(*self.entries(), strict=True) if any(self.buckets.values()) else ((), (), ())
        return {
            "part": part, "log2_buckets": self.filter.log2, "fingerprints": marks.tobytes(), "digests": b"".join(digests),
            "keeps": np.array([NO_ID if k is None else k for k in keeps], dtype="<i8").tobytes(), "sizes": np.array(sizes, dtype="<i8").tobytes(),
        }

    @classmethod
    def of_row(cls, row: dict) -> CuckooIndex:
        index = cls(row["log2_buckets"])
        marks = np.frombuffer(row["fingerprints"], dtype="<u2").reshape(-1, SLOTS)
        index.filter.slots = [[m for m in held if m] for held in marks.tolist()]
        for at, (keep, size) in enumerate(zip(np.frombuffer(row["keeps"], "<i8").tolist(), np.frombuffer(row["sizes"], "<i8").tolist(), strict=True)):
            digest = row["digests"][32 * at : 32 * at + 32]
            index.buckets[cls.bucket_of(digest)].append([digest, None if keep == NO_ID else keep, size])
        return index


def text_digest(text_col: str):
    """A text's key as hexadecimal digits."""
    return F.sha2(lower_ascii(F.col(text_col)), 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256) of every row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(text_col).alias("text_sha256"))


def _fold(batches):
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch]).group_by("text_sha256").aggregate([("doc_id", "max"), ("text_sha256", "count")])
            yield pa.RecordBatch.from_arrays([rows["text_sha256"].combine_chunks(), rows["doc_id_max"].combine_chunks(), rows["text_sha256_count"].combine_chunks()], ["text_sha256", "keep_id", "n"])


def _dealt(digested: DataFrame, parts: int) -> DataFrame:
    folded = digested.mapInArrow(_fold, "text_sha256 string, keep_id long, n long")
    return folded.select(F.pmod(F.xxhash64("text_sha256"), F.lit(parts)).cast("int").alias("part"), "text_sha256", "keep_id", "n")


def _schema() -> pa.Schema:
    return pa.schema([("part", pa.int32()), ("log2_buckets", pa.int32()), *((c, pa.binary()) for c in ("fingerprints", "digests", "keeps", "sizes"))])


def _insert_all(index: CuckooIndex, rows: pa.Table) -> None:
    for digest, keep, n in zip(rows["text_sha256"].to_pylist(), rows["keep_id"].to_pylist(), rows["n"].to_pylist(), strict=True):
        index.insert(bytes.fromhex(digest), keep, n)


def build_index(digested: DataFrame, parts: int | None = None) -> DataFrame:
    """An index table of ``parts`` rows over (doc_id, text_sha256) rows; by default one for PART_ROWS rows."""
    parts = parts or max(2 * partitions(digested.sparkSession), -(-digested.count() // PART_ROWS))

    def build(rows: pa.Table) -> pa.Table:
        index = CuckooIndex(max(2, int(np.ceil(np.log2(max(1, rows.num_rows / 3))))))
        _insert_all(index, rows)
        return pa.Table.from_pylist([index.row(rows["part"][0].as_py())], schema=_schema())

    return _dealt(digested, parts).groupBy("part").applyInArrow(build, INDEX_SCHEMA)


def update_index(index: DataFrame, parts: int, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """The index after deleting digests (text_sha256 rows) and then inserting rows (doc_id, text_sha256)."""
    spark = index.sparkSession
    none = spark.createDataFrame([], "doc_id long, text_sha256 string")
    gone = (none if deleted is None else deleted).select(F.lit(None).cast("long").alias("doc_id"), "text_sha256")
    changes = _dealt(gone, parts).withColumn("n", F.lit(0).cast("long")).unionByName(_dealt(none if inserted is None else inserted, parts))

    def apply(held: pa.Table, rows: pa.Table) -> pa.Table:
        found = held.to_pylist()
        part = found[0]["part"] if found else rows["part"][0].as_py()
        now = CuckooIndex.of_row(found[0]) if found else CuckooIndex()
        for digest in rows.filter(pc.equal(rows["n"], 0))["text_sha256"].to_pylist():
            now.delete(bytes.fromhex(digest))
        _insert_all(now, rows.filter(pc.greater(rows["n"], 0)))
        return pa.Table.from_pylist([now.row(part)], schema=_schema())

    return index.groupBy("part").cogroup(changes.groupBy("part")).applyInArrow(apply, INDEX_SCHEMA)


def live_classes(index: DataFrame) -> DataFrame:
    """One row per live text: text_sha256, keep_id, group_size."""

    def unpack(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keeps, sizes = np.frombuffer(row["keeps"], "<i8"), np.frombuffer(row["sizes"], "<i8")
                names = [row["digests"][i : i + 32].hex() for i in range(0, len(row["digests"]), 32)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(keeps, mask=keeps == NO_ID), pa.array(sizes)], ["text_sha256", "keep_id", "group_size"])

    return index.mapInArrow(unpack, "text_sha256 string, keep_id long, group_size long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's group: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. The join back is on the
    digest with the large side preserved, so AQE can split a hot digest.
    """
    digested = written(digests(docs, id_col, text_col), "digests")
    classes = live_classes(written(build_index(digested), "cuckoo"))
    return digested.join(classes, "text_sha256", "left").select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")
