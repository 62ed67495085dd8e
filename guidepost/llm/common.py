"""Small helpers that several operators of this subpackage share.

Operators take a DataFrame and the names of its columns. They select only what they
need under names of their own, so extra or clashing columns never matter; every input
row gives one output row, also when rows repeat. Texts cross to Python as UTF-8 bytes.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step inside a task works on; bounds the memory of a task.
STEP_BYTES = 500_000

_HELD: dict[str, Callable[[], None]] = {}
_owner = ""


def holds(owner: str, clear: Callable[[], None]) -> None:
    """Name what a module keeps in its worker between tasks."""
    _HELD[owner] = clear


def begin(owner: str) -> None:
    """Workers serve one operator after another: drop what those before kept."""
    global _owner
    if owner == _owner:
        return
    _owner = owner
    for name, clear in _HELD.items():
        if name != owner:
            clear()
    give_back()


def give_back() -> None:
    """Return freed memory of this worker to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo ``k``; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(k)), F.lit(-1)).cast("int")


def utf8(col: Column) -> Column:
    """The whole text as bytes; a null text is empty."""
    return F.coalesce(col.cast("binary"), F.lit(b""))


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings for the jobs that run inside; ``__`` stands for a dot."""
    before = {k: spark.conf.get(k.replace("__", ".")) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k.replace("__", "."), v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k.replace("__", "."), v)


def store(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and is read many
    times. Rows that hold several whole texts go to Python in small batches, and shuffle
    files go when the write is done, as nothing reads them again."""
    spark = df.sparkSession
    with settings(spark, spark__sql__execution__arrow__maxBytesPerBatch="8m", spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    return spark.read.parquet(path)


def steps(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the incoming batches with about ``limit`` bytes of text each, whole rows only."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(np.frombuffer(batch.column(text).buffers()[1], np.int32, batch.num_rows + 1, 4 * batch.column(text).offset).astype(np.int64))
        ends = np.cumsum(sizes)
        lo = 0
        while lo < batch.num_rows:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
            part = batch.slice(lo, hi - lo)
            yield part, part.column(text).to_pylist()
            lo = hi


def map_text(df: DataFrame, fn: Callable[[pa.RecordBatch, list[bytes]], dict], schema: str, limit: int = STEP_BYTES) -> DataFrame:
    """Run ``fn(rows, texts) -> columns`` over slices of ``df``, whose ``text`` is binary."""
    names, owner = [f.name for f in _parsed(df, schema)], fn.__module__

    def run(batches):
        begin(owner)
        for rows, texts in steps(batches, limit=limit):
            cols = fn(rows, texts)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in (cols[n] for n in names)], names=names)
            cols = rows = texts = None
        give_back()

    return df.mapInArrow(run, schema)


def text_scores(scorer: Callable[[], Callable[[list[bytes]], np.ndarray]]):
    """A column function that scores texts, given as bytes, in slices of bounded size.
    ``scorer`` makes what scores them, once a task."""

    owner = scorer.__module__

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        begin(owner)
        fn = scorer()
        for text in batches:
            out = [fn(texts) for _, texts in steps([pa.RecordBatch.from_arrays([text], names=["text"])])]
            yield pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())
        fn = out = text = None
        give_back()

    return run


def _parsed(df: DataFrame, schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).fields


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that was written along the way and is not read any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
