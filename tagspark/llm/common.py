"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagspark.session import shared_folder as shared_dir


_LIBC = ctypes.CDLL(None)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


#: Folders that ``keep`` wrote in this process and nothing has removed yet, oldest first.
KEPT: list[str] = []


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    Cuts the lineage: a lost executor costs the tasks it ran, not the steps before. The rows also
    keep their places, so ids that depend on a task's number stay as they are. ``drop_kept`` removes the folder once the
    results made from it are written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    KEPT.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_kept(spark: SparkSession, start: int = 0, also: str | None = None) -> int:
    """Remove the folders that ``keep`` wrote, from number ``start`` on (``len(KEPT)`` at an earlier time), and the folder
    ``also``; the number removed. What was made from them must be written, and nothing may read them any more."""
    paths = KEPT[start:] + ([also] if also else [])
    del KEPT[start:]
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(paths)


def crc_bucket(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``: the folds of the learning contracts."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def bounded_sample(df: DataFrame, by: str, per_value: int, salt: str) -> DataFrame:
    """About ``per_value`` rows for each value of ``by`` (fewer where there are fewer).

    A row stays if a hash of its id falls under the share that its value needs, so neither a sort
    nor a group in one task is needed; the few values of ``by`` and their counts reach the driver.
    """
    counts = {r[0]: r[1] for r in df.groupBy(by).count().collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        if value is not None:
            share = F.when(F.col(by) == F.lit(value), F.lit(min(1.0, per_value / n))).otherwise(share)
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    return df.where(place < share)


def byte_list(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_list(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return [x or "" for x in column.to_pylist()]


#: Bytes of a batch that goes to a worker.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark application; they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_tagspark_shipped", False):
        return
    package, packed = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    # Spark copies the file when it is added
    place = Path(tempfile.mkdtemp(prefix="tagspark-")) / f"{package.name}.zip"
    place.write_bytes(packed.getvalue())
    sc.addPyFile(str(place))
    sc._tagspark_shipped = True


def in_batches(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with batches of bounded bytes, so that long texts swell neither workers nor executors.

    The session's own limit stays if it is lower.
    """
    ship(df.sparkSession)
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name)
    if not now.rstrip("bB").isdigit() or not 0 < int(now.rstrip("bB")) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def settle() -> None:
    """Give memory that a batch has used back to the system; workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Parts of a batch of about ``most`` text bytes each, one row at least; bounds what a worker holds."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)
    settle()


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weights (last: intercept) of a small regression by Newton steps; one class alone gives its own share."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ w, -30, 30)))


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with its own columns of these names renamed, and what selects them back."""
    moved = {c: f"{c}__own" for c in docs.columns if c in names}
    return docs.withColumnsRenamed(moved), [F.col(moved.get(c, c)).alias(c) for c in docs.columns]
