"""Shared helpers of the corpus operators: reading tables, the shared folder, bounded slices, and skew-safe group look-ups."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Hashable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.scratch import discard, shared_dir, stash

__all__ = ["BATCH_BYTES", "WORD_PATTERN", "attach", "discard", "held", "read", "release", "shared_dir", "ship", "slices", "stash"]

#: ASCII white space, the only separator of words in all contracts of this subpackage.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Most bytes of an Arrow batch (or one row, if that is larger), which is what a task and its Python worker hold at once.
BATCH_BYTES = 4 << 20


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, which may have another path than the driver, and bound their batches; once a session."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        spark.conf.set(limit, str(BATCH_BYTES))
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="riskloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_HELD: dict[str, tuple[Hashable, object]] = {}


def held(kind: str, key: Hashable, make: Callable[[], object]) -> object:
    """What ``make`` builds, kept in this Python worker until another key or another kind is asked for.

    Workers outlive their tasks; one model at a time is all that they hold between them.
    """
    if kind not in _HELD or _HELD[kind][0] != key:
        release()
        _HELD[kind] = (key, make())
        _give_back()
    return _HELD[kind][1]


def release() -> None:
    """Drop the model that this Python worker holds."""
    _HELD.clear()
    _give_back()


def _give_back() -> None:
    """Return freed memory to the system, where the C library can: workers outlive their tasks, and building a model or hashing
    a chunk leaves much of it behind."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batch: pa.RecordBatch, at: int, rows: int = 1024, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch, of at most ``rows`` rows, that end where column ``at`` reaches ``size`` bytes."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_pylist()
    first, held_bytes = 0, 0
    for k, n in enumerate(lengths, start=1):
        held_bytes += n
        if held_bytes >= size or k - first >= rows:
            yield batch.slice(first, k - first)
            first, held_bytes = k, 0
    if first < len(lengths):
        yield batch.slice(first)


def attach(df: DataFrame, key: str, salt: str, aggregates: dict[str, tuple[Column, str]], salts: int | None = None) -> DataFrame:
    """Give every row the aggregates of its ``key`` group, however large the group.

    ``aggregates`` maps an output name to (input column, one of ``min``, ``max``, ``sum``). Groups are summed
    per (key, salt) first, merged per key, and sent back only to the salts that the group has, so neither
    step brings a whole group to one task. Rows with a null key get nulls. There are as many salts as shuffle
    partitions, and 32 at least, so that a group that holds a third of all rows is spread over the whole cluster.
    """
    salts = salts or max(32, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    s = F.pmod(F.xxhash64(F.col(salt)), F.lit(salts)).cast("int")
    how = {"min": F.min, "max": F.max, "sum": F.sum}
    rows = df.withColumn("__salt", s)
    part = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key"), "__salt").agg(*[how[k](c).alias(n) for n, (c, k) in aggregates.items()])
    merged = part.groupBy("__key").agg(*[how[k](n).alias(n) for n, (_, k) in aggregates.items()], F.collect_set("__salt").alias("__salts"))
    back = merged.select("__key", F.explode("__salts").alias("__s"), *aggregates)
    return rows.join(back, (F.col(key) == F.col("__key")) & (F.col("__salt") == F.col("__s")), "left").drop("__key", "__s", "__salt")
