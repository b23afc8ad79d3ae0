"""Session helpers: tables by path, tables written to the shared folder, and size estimates."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textops

T = TypeVar("T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch, so that rows with very long texts do not gather in one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


_OWN: dict[str, str] = {}
_SCRATCH: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset and all runs on one machine, a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        folder = _OWN.setdefault(spark.sparkContext.applicationId, "") or f"file://{tempfile.mkdtemp(prefix='xylem-')}"
        _OWN[spark.sparkContext.applicationId] = folder
    return folder


def written(df: DataFrame, keep: bool = False) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder: lineage ends there, and a lost executor costs nothing.

    Within ``scratch`` the table goes with it, unless it is to ``keep``: then it goes with the scratch around that."""
    spark = df.sparkSession
    within = _SCRATCH[:-1] if keep else _SCRATCH
    path = f"{within[-1] if within else shared_dir(spark) + '/tables'}/{uuid.uuid4().hex}"
    # nothing reads this write's shuffles again, so they need not wait for the driver's garbage collection
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables ``written`` within are removed at its end; nothing that is still to be read may rest on them."""
    folder = f"{_SCRATCH[-1] if _SCRATCH else shared_dir(spark) + '/tables'}/{uuid.uuid4().hex}"
    _SCRATCH.append(folder)
    try:
        yield
    finally:
        _SCRATCH.pop()
        # an empty table in its place: of any store, without a way past Spark
        spark.range(0).coalesce(1).write.mode("overwrite").parquet(folder)


def others(df: DataFrame, added: tuple[str, ...]) -> list[str]:
    """The columns of ``df`` that stay beside ``added`` ones; names are the same whatever their case, as in Spark."""
    return [c for c in df.columns if c.lower() not in added]


def _give_back() -> None:
    textops.forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(work: Callable[[Iterator[T]], Iterator[T]]) -> Callable[[Iterator[T]], Iterator[T]]:
    """``work`` on a task's batches, after which a worker, as it lives on for other tasks, gives freed memory back."""

    @functools.wraps(work)
    def run(batches: Iterator[T]) -> Iterator[T]:
        pa.set_cpu_count(1)  # a task has one core, and each thread's pool would hold memory of its own
        yield from work(batches)
        _give_back()

    return run


def tidied_group(work: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """The same for ``work`` on a group, or on two groups of one key."""

    def one(a: pa.Table) -> pa.Table:
        pa.set_cpu_count(1)
        out = work(a)
        _give_back()
        return out

    def two(a: pa.Table, b: pa.Table) -> pa.Table:
        pa.set_cpu_count(1)
        out = work(a, b)
        _give_back()
        return out

    return two if work.__code__.co_argcount == 2 else one


def input_bytes(df: DataFrame) -> int | None:
    """Catalyst's estimate of the bytes of a DataFrame (for files, their size), of any store; nothing where there is none."""
    plan = getattr(df, "_jdf", None)  # a remote session has no plan to ask
    size = int(plan.queryExecution().optimizedPlan().stats().sizeInBytes()) if plan is not None else 1 << 60
    return size if size < 1 << 60 else None


def parts(df: DataFrame, bytes_each: int = 8 << 20) -> int:
    """How many buckets keep each bucket's share of the input near ``bytes_each``, however large it is."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), (input_bytes(df) or 0) // bytes_each + 1)


def tasks(buckets: int) -> int:
    """How many tasks to deal buckets to: one each, until that is more than a driver can watch."""
    return min(buckets, 100_000)
