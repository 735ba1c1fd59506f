"""Shared pieces of the training-data operators: shared-folder tables, ordered blocks, packed columns."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a local master (all in one process, as in tests) gets one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        c = spark.sparkContext
        if c.master != "local" and not c.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = _own.get(c.applicationId) or _own.setdefault(c.applicationId, "file://" + tempfile.mkdtemp(prefix="unitloom-"))
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when this process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL = "fs.file.impl"
#: For steps over whole texts: rows that a task holds at once, in the reader and on the way to Python. Bounds memory alone, never a result.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.parquet.columnarReaderBatchSize": "512"}


def _plain_files(spark: SparkSession) -> dict[str, str]:
    """Settings under which files on local disks are written by Hadoop's plain local file system, unless the cluster names one of its own.

    Where Hadoop's native library is not there, each file and folder made starts a `chmod`, a copy of the executor until it runs; the usual one writes a checksum file beside each, with one more.
    """
    if spark._jsc.hadoopConfiguration().get(_LOCAL) or spark.conf.get(_LOCAL, None):
        return {}
    return {_LOCAL: "org.apache.hadoop.fs.RawLocalFileSystem", f"{_LOCAL}.disable.cache": "true"}


def stored(df: DataFrame, name: str, settings: dict[str, str] | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read back: its lineage ends there, so that a lost executor costs no recomputation.

    settings hold during the write alone. The shuffle files of the write have no use once it is done, and go then.
    """
    spark = df.sparkSession
    path, settings = shared_path(spark, name), {_CLEAN: "true"} | _plain_files(spark) | (settings or {})
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_stored_at"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored() tables that nothing is read from any more: what was made of them is stored itself."""
    for t in tables:
        _delete(t.sparkSession, t.__dict__["_stored_at"])


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _delete_written() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def range_bounds(df: DataFrame, key: str, n: int) -> list:
    """At most n - 1 ascending cut points that deal the non-null keys into ranges of like size.

    Only the key column is read. What comes to the driver is bounded by n; the
    cuts steer balance alone, any cuts give the same result.
    """
    if n < 2:
        return []
    shares = [i / n for i in range(1, n)]
    row = df.agg(F.percentile_approx(key, shares, max(10_000, 20 * n)).alias("cuts")).first()
    return sorted(set(row.cuts or []))


def range_block(key: str, bounds: list) -> Column:
    """Number of the range that a key lies in: 0 for nulls and keys below the first cut."""
    if not bounds:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(key))), F.lit(0))
