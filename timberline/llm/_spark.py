"""Session helpers shared by the operators."""

from __future__ import annotations

import contextlib
import contextvars
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER_AZ, LOWER_AZ)


def in_fold(key: Column, mod: int, remainder: int) -> Column:
    """Whether crc32(key as text) mod ``mod`` is ``remainder``."""
    return F.crc32(key.cast("string").cast("binary")) % mod == remainder


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named


_scopes: contextvars.ContextVar[tuple[list[DataFrame], ...]] = contextvars.ContextVar("scopes", default=())


@contextlib.contextmanager
def scratch():
    """Delete the tables that were ``written`` inside when the block ends; lasting ones belong to the block around it, if any."""
    made: list[DataFrame] = []
    token = _scopes.set((*_scopes.get(), made))
    try:
        yield
    finally:
        _scopes.reset(token)
        discard(*made)


def written(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts lineage (a lost executor costs no recomputation of what is
    written) and lets several jobs read one result. Shuffle files of the
    write are removed once it is done.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._scratch_path = path
    scopes = _scopes.get()[: -1 if lasting else None]
    if scopes:
        scopes[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


_cleaning = {"lock": threading.Lock(), "users": 0, "before": None}


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Have Spark delete an action's shuffle files when the action ends; the first user sets it, the last restores it."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with _cleaning["lock"]:
        if not _cleaning["users"]:
            _cleaning["before"] = spark.conf.get(key, None)
            spark.conf.set(key, "true")
        _cleaning["users"] += 1
    try:
        yield
    finally:
        with _cleaning["lock"]:
            _cleaning["users"] -= 1
            if not _cleaning["users"]:
                before = _cleaning["before"]
                spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle of the input's size gets."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Text that one task holds at a time.
CHUNK_BYTES = 12 << 20


def chunk_count(docs: DataFrame, text_col: str, each: int = CHUNK_BYTES) -> int:
    """Into how many chunks of about ``each`` bytes of text the rows go; not fewer than there are shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-total // each))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
