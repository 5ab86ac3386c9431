"""What the text operators share: the shared folder, lineage cuts, hashing and batching helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null id where ids are compared; smaller than every real id.
NO_ID = -(2**63)
#: Bits of the table by which sieve() tells rows: 262,144 rows of 64 of them at most are broadcast.
SIEVE_BITS = 24


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where that is unset (local runs)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quantpanel-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system, so that any store works."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session may be gone by then
        pass


def remove_later(spark: SparkSession, path: str) -> None:
    """Deletes the folder when this process ends."""
    atexit.register(remove_at_exit, spark, path)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends there, and a lost executor loses nothing. And the
    folder, for remove() once nothing reads it any more; otherwise it goes when this process ends.

    Column names may repeat Parquet-unsafe characters only if the caller's do; the schema is kept as it is.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quantpanel-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_later(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """stored() without the folder."""
    return stored(df)[0]


def drop_shuffles(spark: SparkSession) -> None:
    """Shuffle files that nothing reads any more go when the driver's JVM collects its garbage, which may be long after the disk is full."""
    gc.collect()
    spark._jvm.System.gc()


def sieve(rows: DataFrame, ids: DataFrame, key: str, id_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among ids, the others: null keys and those surely not there), told by a broadcast table of bits, so that
    only the first need an exchange. The table has at most 2 ** SIEVE_BITS bits; the fuller, the more rows are in doubt."""
    bits = min(SIEVE_BITS, max(10, (16 * ids.count()).bit_length()))

    def at(column: str) -> tuple[Column, Column]:
        slot = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(1 << bits))
        return F.floor(slot / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))

    word, bit = at(id_col or key)
    words = cut(ids.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits")))
    word, bit = at(key)
    held = (word == F.col("_word")) & (F.col("_bits").bitwiseAND(bit) != 0) & F.col(key).isNotNull()
    return tuple(rows.join(F.broadcast(words), held, how) for how in ("left_semi", "left_anti"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. Texts of ASCII only take the built-in lower(), which does the same there and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element; wraps around."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` units together; a longer row stands alone."""
    at = total = 0
    for i, n in enumerate(lengths):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(lengths):
        yield at, len(lengths)


def text_slices(batches: Iterator[pa.RecordBatch], text_at: int = 1, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of at most `most` bytes of text (a longer text stands alone), so that few texts are Python
    objects at a time. What a batch took goes back to the system when it is done, as other workers share the executor's memory."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist()
        for i, j in slices(sizes, most):
            yield batch.slice(i, j - i)
        del batch
        give_back()


#: What clears the caches that operators keep in a Python worker from task to task.
CLEARED: list[Callable[[], None]] = []


def forget() -> None:
    """Clears other operators' caches, as workers are used again by the next stage, whose own memory comes on top."""
    for clear in CLEARED:
        clear()
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: Arrow's pool and the C heap keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not glibc
    _TRIM = None


@cache
def one_thread() -> None:
    """Matrix products of this worker take one thread, as each task has one core; the library's threads would spin beside it."""
    for path in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library := ctypes.CDLL(str(path)), name):
                getattr(library, name)(1)


def union_find(n: int):
    """find(i) and join(i, j) over 0..n-1; the root of a class is its smallest member."""
    up = list(range(n))

    def find(i: int) -> int:
        root = i
        while up[root] != root:
            root = up[root]
        while up[i] != root:
            up[i], i = root, up[i]
        return root

    def join(i: int, j: int) -> bool:
        i, j = find(i), find(j)
        if i == j:
            return False
        up[max(i, j)] = min(i, j)
        return True

    return find, join
