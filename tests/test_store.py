"""The token index, gated ingest, probes."""

import os
import time

import pytest
from pyspark.sql import functions as F

from timberline.plans import engine as engines
from timberline.plans.engine import Engine
from timberline.plans.registry import Source
from timberline.sources import store as stores
from timberline.sources.store import EntryStore
from timberline.streaming import ingest
from timberline.streaming.ingest import ingest_history, ingest_stream

AS_OF = "2026-08-10 12:00:00"


def entries(spark, n=400, files=8):
    return spark.range(n).select(
        F.lit("s").alias("source"), F.concat(F.lit("f"), (F.col("id") % files).cast("string")).alias("file"), F.lit(AS_OF).cast("timestamp").alias("ts"), F.lit("INFO").alias("level"),
        F.concat(F.lit("item number "), F.col("id").cast("string"), F.lit(" is done")).alias("message"), F.create_map(F.lit("k"), F.concat(F.lit("v"), F.col("id").cast("string"))).alias("fields"),
    )


@pytest.fixture
def kept(spark, tmp_path):
    kept = EntryStore(spark, str(tmp_path / "store"))
    kept.replace(entries(spark))
    return kept


def messages(found):
    return sorted(r.message for r in found.collect())


def test_a_rare_word_opens_few_parts(kept):
    assert len(kept.parts()) == 8 and kept.index() == 0
    found = kept.search("17")
    assert messages(found) == ["item number 17 is done"] and len(found.inputFiles()) == 1
    assert len(kept.search("V17 18").inputFiles()) == 2 and len(kept.search("V17 18").collect()) == 2  # v17 is a field's value
    assert kept.search("...").count() == 0 and kept.search("item").count() == 400
    assert messages(kept.search("number 17 is", phrase=True)) == ["item number 17 is done"] and len(kept.search("number 17 is", phrase=True).inputFiles()) == 1
    assert kept.search("17 number", phrase=True).count() == 0


def test_replaced_and_unindexed_parts(spark, kept):
    changed = entries(spark).where("file = 'f1'").withColumn("message", F.concat(F.lit("fresh"), F.regexp_replace("message", "number", "no")))
    kept.replace(changed)
    assert kept.search("number").count() == 350 and kept.search("no").count() == 50
    late = EntryStore(spark, kept.path, indexed=False)
    late.replace(entries(spark).where("file = 'f2'").withColumn("message", F.lit("unindexed words")))
    assert kept.search("unindexed").count() == 50 and messages(kept.search("17")) == ["freshitem no 17 is done"]  # read without an index
    assert kept.index() == 1 and kept.index() == 0 and len(kept.search("17").inputFiles()) == 1
    before = kept._side("_parts", "part string").count()
    assert kept.index(anew=True) == 8 and before == 10 and kept._side("_parts", "part string").count() == 8
    assert kept.search("unindexed").count() == 50


def test_too_many_parts(kept, monkeypatch):
    monkeypatch.setattr(stores, "MAX_PARTS", 3)
    assert kept.search("item").count() == 400 and len(kept.search("17").inputFiles()) == 1


def test_index_in_several_jobs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "PARTS_AT_ONCE", 3)
    kept = EntryStore(spark, str(tmp_path / "store"))
    kept.replace(entries(spark))
    assert kept._side("_parts", "part string").count() == 8 and all(len(kept.search(str(k)).collect()) == 1 for k in (0, 7, 399))


def test_search_agrees_with_filters(spark, kept):
    from timberline.functions import filters as f

    rows = kept.read()
    for words in ("v44 f3", "number 5"):
        assert messages(kept.search(words)) == messages(rows.where(f.term(words)))
        assert messages(kept.search(words, phrase=True)) == messages(rows.where(f.phrase(words)))


def test_purges_keep_the_index_right(spark, kept, tmp_path):
    kept.purge_source("s", to=str(tmp_path / "v2"))
    assert kept.read().count() == 0
    kept.replace(entries(spark, 10, 2))
    assert messages(kept.search("7")) == ["item number 7 is done"]


def test_a_busy_day_is_no_task_alone(spark, tmp_path):
    """One file's day is split where it is larger than a partition is meant to be."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        kept = EntryStore(spark, str(tmp_path / "store"), indexed=False)
        kept.replace(entries(spark, 60_000, 1).withColumn("message", F.sha2("message", 512)))
        assert len(kept.parts()) > 3 and kept.read().count() == 60_000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def log(path, *words, when=None):
    path.write_text("".join(f"2026-08-10 11:00:00,000 [INFO] {w}\n" for w in words))
    if when:
        os.utime(path, (when, when))


def test_unchanged_files_are_not_opened(spark, tmp_path, monkeypatch):
    logs, kept = tmp_path / "logs", EntryStore(spark, str(tmp_path / "store"))
    logs.mkdir()
    log(logs / "a b.log", "one", "two")
    log(logs / "c+d%.log", "three")
    read, lines_of = [], ingest.lines_of
    monkeypatch.setattr(ingest, "lines_of", lambda spark, paths, source: read.append(len(paths)) or lines_of(spark, paths, source))
    assert ingest_history(spark, kept, str(logs), "s", AS_OF) == 2 and read == [2]
    assert ingest_history(spark, kept, str(logs), "s", AS_OF) == 0 and read == [2]
    log(logs / "a b.log", "one", "two", "four")
    log(logs / "e.log", "five")
    assert ingest_history(spark, kept, str(logs), "s", AS_OF) == 2 and read == [2, 2]
    assert messages(kept.read()) == ["five", "four", "one", "three", "two"]
    assert ingest_history(spark, kept, str(logs), "other", AS_OF) == 3  # another source has its own
    kept.purge_source("s")
    assert ingest_history(spark, kept, str(logs), "s", AS_OF) == 3 and kept.read("s").count() == 5


def test_a_cut_off_ingest_is_done_again(spark, tmp_path, monkeypatch):
    logs, kept = tmp_path / "logs", EntryStore(spark, str(tmp_path / "store"))
    logs.mkdir()
    log(logs / "a.log", "one")
    with monkeypatch.context() as m:
        m.setattr(EntryStore, "record", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            ingest_history(spark, kept, str(logs), "s", AS_OF)
    assert ingest_history(spark, kept, str(logs), "s", AS_OF) == 1 and messages(kept.read()) == ["one"]


def test_the_stream_leaves_out_what_is_stored(spark, tmp_path):
    logs, kept = tmp_path / "logs", EntryStore(spark, str(tmp_path / "store"))
    logs.mkdir()
    log(logs / "a.log", "one")
    assert ingest_history(spark, kept, str(logs), "s", AS_OF) == 1
    log(logs / "b.log", "two")
    ingest_stream(spark, str(logs), "s", kept, str(tmp_path / "cp"), AS_OF, every="").awaitTermination()
    assert messages(kept.read()) == ["one", "two"] and kept._side("_files", stores.FINGERPRINT).count() == 2
    assert ingest_history(spark, kept, str(logs), "s", AS_OF) == 0


def test_probes(spark, tmp_path, monkeypatch):
    log(tmp_path / "a.log", "one", when=1_000_000)
    engine = Engine(spark)
    key = engine.sources.create(Source("s", "LOCAL_DIRECTORY", str(tmp_path))).id
    assert engine.logs(AS_OF).count() == 1 and engine.probe(key) == []
    log(tmp_path / "a.log", "one", "two")
    assert engine.probe(key) == [] and engine.logs(AS_OF).count() == 1  # within five seconds nothing is looked at
    monkeypatch.setattr(engines, "PROBE_SECONDS", 0.0)
    time.sleep(0.01)
    assert engine.probe(key) == ["a.log"] and engine.logs(AS_OF).count() == 2
    assert engine.probe(key) == []
    log(tmp_path / "b.log", "three")
    assert engine.probe(key) == ["b.log"] and engine.logs(AS_OF).count() == 3
