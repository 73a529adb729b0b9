"""Token counts through a cache keyed by content and tokenizer digests.

A document's key is the SHA-256 of its normalised content: for a tokenizer
that cuts at white space and drops it, runs of the bytes space and 0x09 to
0x0D become one space and the ends are trimmed, which leaves counts unchanged;
for others the content is taken as it is. Keys are joined to the
stored counts of the same tokenizer version (the digest of its file and of the
library's version); of each key that is missing, one document's text is
encoded, and the new counts are appended to the cache before all rows read
their count from it.

Encoding a text: where a tokenizer cuts at white space and drops it, the count
is the sum over white-space separated words. A worker keeps the counts of a
bounded number of words that it met more than once, over all its tasks, and
encodes the other words of a text together. Whether a tokenizer is of that
kind is read from its normaliser, pre-tokenizer and added tokens; any other
encodes whole texts.

Defined results: null text is empty text and has no tokens; rows that repeat a
doc_id keep a row each; rows whose doc_id is null count as well.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import shared_dir, written
from ._text import blocks, column_bytes

WORDS_KEPT = 200_000
#: Texts of about this many bytes are encoded at a time.
ENCODE_BYTES = 8 << 20
CACHE_SCHEMA = "content_sha256 string, n_tokens long, tokenizer_sha256 string"


def cuts_at_white_space(spec: dict) -> bool:
    """Whether a tokenizer file tells that no token spans white space, that white space gives no tokens and that words don't affect each other.

    True only where all of this can be seen: normalisers that leave words
    apart, a first pre-tokenizer that keeps the matches of a pattern without
    white space, added tokens without white space or stripping.
    """
    steps = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
    steps = steps["normalizers"] if steps["type"] == "Sequence" else [steps]
    for step in steps:
        to_one_space = step["type"] == "Replace" and step.get("pattern") == {"Regex": "\\s+"} and step.get("content") == " "
        if step["type"] not in ("NFC", "Lowercase") and not to_one_space:
            return False
    cut = spec.get("pre_tokenizer") or {"type": None}
    cut = cut["pretokenizers"][0] if cut["type"] == "Sequence" else cut
    if cut["type"] != "Split" or cut.get("behavior") != "Removed" or not cut.get("invert"):
        return False
    pattern = re.sub(r"\[\^[^\]]*\\s[^\]]*\]", "", cut["pattern"].get("Regex", " "))  # classes that leave white space out
    if re.search(r"[ .^\t\n]|\\[sSWDPXRhvCZ]|\\p\{[CZ]|\(\?", pattern):
        return False
    return not any(re.search(r"\s", a["content"]) or a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec.get("added_tokens", []))


class KnownWords(dict):
    """Counts by word, of two generations; a word that isn't there counts 0 and is noted in ``missed``."""

    def __init__(self):
        self.older: dict[bytes, int] = {}
        self.missed: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self.older.get(word)
        if n is None:
            self.missed.append(word)
            return 0
        self[word] = n
        return n

    def add(self, words: list[bytes], counts: list[int]) -> None:
        if len(self) + len(words) > WORDS_KEPT:
            self.older = dict(self)
            self.clear()
        self.update(zip(words, counts, strict=True))


class Encoder:
    """Counts tokens with a public tokenizer file (.json or .model)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.by_word = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.count_batch = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.count_batch = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as file:
                self.by_word = cuts_at_white_space(json.load(file))
        self.known = KnownWords()

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return self.count_batch(texts)
        split = [text.encode().split() for text in texts]  # at the bytes space and 0x09 to 0x0D only
        tally: Counter[bytes] = Counter()
        for words in split:
            tally.update(words)
        known = self.known
        often = [w for w, n in tally.items() if n > 1 and w not in known and w not in known.older]
        known.add(often, self.count_batch([w.decode() for w in often]))
        found, rest, look_up = [], [], known.__getitem__
        for words in split:
            known.missed = []
            found.append(sum(map(look_up, words)))
            rest.append(b" ".join(known.missed).decode())
        return [a + b for a, b in zip(found, self.count_batch(rest), strict=True)]


@lru_cache(maxsize=2)
def encoder_of(path: str, _digest: str) -> Encoder:
    """The worker's encoder of a file and version, kept from task to task."""
    return Encoder(path)


def tokenizer_digest(path: str) -> str:
    """Digest of the tokenizer's file and of its library's version."""
    import importlib.metadata

    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    digest = hashlib.sha256(f"{library} {importlib.metadata.version(library)}\n".encode())
    with open(path, "rb") as file:
        digest.update(file.read())
    return digest.hexdigest()


def normalised(text, collapse: bool) -> F.Column:
    if not collapse:
        return F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\x09-\\x0D]+", " "))


def encode_rows(rows: DataFrame, path: str, version: str) -> DataFrame:
    """(content_sha256, n_tokens) of (content_sha256, text) rows."""

    def run(batches):
        encoder = encoder_of(path, version)
        for batch in batches:
            _, offsets = column_bytes(batch.column("text"))
            for a, b in blocks(offsets, ENCODE_BYTES):
                counts = encoder.counts([x or "" for x in batch.column("text")[a:b].to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("content_sha256")[a:b], pa.array(counts, pa.int64())], ["content_sha256", "n_tokens"])

    return rows.mapInArrow(run, "content_sha256 string, n_tokens long")


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row.

    ``cache_path`` names a cache to use and extend; without it, a new one is
    made in the shared folder. The tokenizer's file must be readable at the
    same path by the executors.
    """
    import uuid

    spark = docs.sparkSession
    cache_path = cache_path or f"{shared_dir(spark).rstrip('/')}/tables/token-cache-{uuid.uuid4().hex}"
    version = tokenizer_digest(tokenizer_path)
    key_text = normalised(F.col("text"), Encoder(tokenizer_path).by_word)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keys = written(texts.select("doc_id", F.sha2(key_text, 256).alias("content_sha256"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")), "content-keys")

    def cache() -> DataFrame:
        try:
            stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
        except Exception as error:  # no cache has been written there yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return spark.createDataFrame([], CACHE_SCHEMA)
        return stored

    def stored() -> DataFrame:
        """One count per key, also where two runs appended the same one."""
        return cache().where(F.col("tokenizer_sha256") == version).groupBy("content_sha256").agg(F.max("n_tokens").alias("n_tokens"))

    # One row stands for all of a key's copies: the partial aggregate folds them before the shuffle.
    missing = keys.groupBy("content_sha256").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).join(stored(), "content_sha256", "left_anti")
    firsts = missing.where(F.col("doc_id").isNotNull())
    # A doc_id may stand on rows with different texts, so the key is compared as well.
    chosen = texts.join(firsts, "doc_id").where(F.sha2(key_text, 256) == F.col("content_sha256"))
    nameless = texts.where(F.col("doc_id").isNull()).withColumn("content_sha256", F.sha2(key_text, 256)).join(missing.where(F.col("doc_id").isNull()).select("content_sha256"), "content_sha256", "left_semi")
    single, several = (chosen.where(c).select("content_sha256", "text") for c in ("copies = 1", "copies > 1"))
    # Rows that repeat a doc_id and its text, or have none, are still to be folded.
    distinct = single.unionByName(several.unionByName(nameless.select("content_sha256", "text")).dropDuplicates(["content_sha256"]))
    encode_rows(distinct, tokenizer_path, version).withColumn("tokenizer_sha256", F.lit(version)).write.mode("append").parquet(cache_path)
    return keys.join(stored(), "content_sha256", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
