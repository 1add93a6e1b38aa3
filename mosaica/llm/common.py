"""What the operators share: tables, scratch tables and Arrow batch helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Characters of text that are worked on at once inside an Arrow batch.
CHUNK_CHARS = 600_000
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


#: Bytes of an Arrow batch; Spark's own default suits workers of more memory.
BATCH_BYTES = "8m"

#: What a worker process keeps between tasks, by name: how to let it go.
CACHES: dict[str, Callable[[], None]] = {}


def begin_task(keep: str | None) -> None:
    for name, clear in CACHES.items():
        if name != keep:
            clear()


def end_task() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable, keep: str | None = None) -> Callable:
    """``run`` for ``mapInArrow``: lets go of the caches of other operators before it, and of freed memory behind it."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(keep)
        try:
            yield from run(batches)
        finally:
            end_task()

    return whole


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers, unless they start where they find it, and bounds Arrow batches, unless a session says how."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[2]
    if spark.conf.get(_BYTES, None) in (None, "64MB", "67108864b", "67108864"):
        spark.conf.set(_BYTES, BATCH_BYTES)
    if getattr(sc, "_mosaica_shipped", False):
        return
    sc._mosaica_shipped = True
    if str(root) not in os.environ.get("PYTHONPATH", "").split(os.pathsep) and Path.cwd() != root:
        out = Path(tempfile.mkdtemp(prefix="mosaica-")) / "mosaica.zip"
        with zipfile.ZipFile(out, "w") as z:
            for f in sorted((root / "mosaica").rglob("*.py")):
                z.write(f, f.relative_to(root))
        sc.addPyFile(str(out))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the shared one that the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (tests) is a temporary folder used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(spark, "_mosaica_scratch", None)
        if base is None:
            base = spark._mosaica_scratch = "file://" + tempfile.mkdtemp(prefix="mosaica-")
    return f"{base.rstrip('/')}/mosaica-{uuid.uuid4().hex}"


#: Seconds between two looks for shuffles that nobody holds, and when the last was.
RELEASE_S = 5.0
_RELEASED = [0.0]
#: Paths of written tables that nobody has discarded, in the order of writing.
_WRITTEN: dict[str, None] = {}


def save(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, lost executors do not matter.

    Shuffles of plans that nobody holds any more are let go.
    """
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    ship(spark)
    df.write.parquet(path)
    _WRITTEN[path] = None
    if time.monotonic() - _RELEASED[0] > RELEASE_S:
        gc.collect()
        spark._jvm.System.gc()
        _RELEASED[0] = time.monotonic()
    out = spark.read.schema(df.schema).parquet(path)
    out._mosaica_path = path
    return out


def written() -> list[str]:
    """Tables that ``save`` has written and nobody has discarded."""
    return list(_WRITTEN)


def sweep(spark: SparkSession, paths: list[str]) -> None:
    """Deletes written tables by path."""
    sc = spark.sparkContext
    for path in paths:
        if path in _WRITTEN:
            del _WRITTEN[path]
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def discard(*frames: DataFrame) -> None:
    """Deletes what ``save`` wrote; only for tables that no later plan reads."""
    for df in frames:
        if path := getattr(df, "_mosaica_path", None):
            sweep(df.sparkSession, [path])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(texts: list, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` characters together (one row at least)."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def text_chunks(column: pa.Array, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, list]]:
    """(first row, texts) of pieces of a text column, so that a batch is never whole in Python's memory."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    piece, begin = np.cumsum(sizes) // limit, 0
    for end in [*(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(column)]:
        if end > begin:
            yield begin, column.slice(begin, end - begin).to_pylist()
        begin = end
