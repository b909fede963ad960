"""What the operators of this subpackage share: tables, shared storage, bounded samples."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII white space, as the contracts of the queries define it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Some columns of a table; columns that the caller doesn't name are never read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a local session gets a folder of its own; a cluster has no such folder that all can see, so
    there this raises ValueError.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = f"file://{tempfile.mkdtemp(prefix='lorelink-')}"
        found = _own_dirs[app]
    return found.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/lorelink/{what}-{uuid.uuid4().hex}"


def to_shared(spark: SparkSession, local: str) -> str:
    """Copy a file of the driver to the shared folder, whatever file system that is on; returns its path there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    to = f"{shared_path(spark, 'file')}/{os.path.basename(local)}"
    target = hadoop.Path(to)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyFromLocalFile(False, True, hadoop.Path(f"file://{os.path.abspath(local)}"), target)
    return to


_shipped: set[str] = set()
_added: set[tuple[str, str]] = set()


def add_file(spark: SparkSession, local: str) -> None:
    """SparkContext.addFile by way of the shared folder, once per application. A file's name must tell its content."""
    key = (spark.sparkContext.applicationId, os.path.basename(local))
    if key not in _added:
        spark.sparkContext.addFile(to_shared(spark, local))
        _added.add(key)


def ship(spark: SparkSession) -> None:
    """Give this package's code to the executors' Python workers, once per application, so none has to be installed there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).parent.parent
    with tempfile.TemporaryDirectory() as folder:
        target = f"{folder}/{root.name}-code.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(to_shared(spark, target))
    _shipped.add(sc.applicationId)


def release_memory() -> None:
    """Give memory that nothing uses any more back to the system."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


#: What workers keep from one task to the next, by name.
_kept: dict[str, dict] = {}


def kept_by_worker(name: str) -> dict:
    """A cache that lasts as long as the worker's tasks name it."""
    return _kept.setdefault(name, {})


def forget_all_but(name: str | None) -> None:
    for k, cache in _kept.items():
        if k != name:
            cache.clear()


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, cache: str | None = None) -> DataFrame:
    """mapInArrow, with this package's code at hand.

    Workers, which are used again, give back the memory that a task needed, and what other operators' tasks kept; `cache`
    is the name of what this one's keep.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_all_but(cache)
        try:
            yield from fn(batches)
        finally:
            release_memory()

    return df.mapInArrow(run, schema)


def settled(df: DataFrame, what: str) -> DataFrame:
    """df, written once to the shared folder and read again: its lineage ends there, so lost executors cost no rerun."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def held_out_rows(doc_id: Column, modulus: int, held_out: int) -> Column:
    """Whether crc32 of the id as text, modulo modulus, is held_out; false for null."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == held_out, F.lit(False))


def learning_rows(doc_id: Column, modulus: int, held_out: int) -> Column:
    """Rows that may be learnt from: those with an id that isn't held out."""
    return doc_id.isNotNull() & ~held_out_rows(doc_id, modulus, held_out)


def others(keep: list[str], *made: str) -> list[str]:
    """The columns of keep but those that the operator makes itself: where names clash, what it makes stands."""
    return [k for k in keep if k not in made]


def spread_sample(df: DataFrame, strata: str, key: str, each: int, seed: int) -> DataFrame:
    """About `each` rows of every value of `strata`, chosen by a hash of `key`: a bounded sample to fit a model on.

    One pass counts the values of the stratum (few), another keeps the rows whose hash is below the value's share. The
    choice depends on ids alone, so reruns, lost executors and other partitionings give the same rows. Should ids repeat,
    so that more rows than twice the expected number qualify, those with the smallest hashes are taken.
    """
    counts = df.groupBy(strata).agg(F.count("*").alias("n")).collect()
    place = (F.xxhash64(F.lit(seed), F.col(key)).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)).cast("double")
    keep = F.lit(False)
    for row in counts:
        keep = keep | (F.col(strata).eqNullSafe(F.lit(row[0])) & (place < min(1.0, each / row["n"])))
    return df.where(keep).orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.xxhash64(*df.columns)).limit(max(1, 2 * each * len(counts)))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a column of strings, without a copy where Arrow's layout allows it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
