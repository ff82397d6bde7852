"""Session settings and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoints go when nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package's code from the driver to the workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="gaitworks-")) / "gaitworks.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder: on a
    cluster a machine-local folder is gone with its machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if configured:
        if current.isEmpty():
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not current.isEmpty():
        return current.get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="gaitworks-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Tables below the shared folder that this process has made, and their sessions.
_scratch: dict[str, SparkSession] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared folder; what is written there goes with the scope or the driver's process."""
    path = f"{shared_dir(spark)}/gaitworks-{label}-{uuid.uuid4().hex}"
    _scratch[path] = spark
    return path


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Delete, at its end, the intermediate tables made within it.

    Results that are still to be computed read such tables: write or collect
    them inside the scope.
    """
    before = set(_scratch)
    try:
        yield
    finally:
        _clear([path for path in _scratch if path not in before])


def _clear(paths: list[str]) -> None:
    for path in paths:
        spark = _scratch.pop(path)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _clear_at_exit() -> None:
    try:
        _clear(list(_scratch))
    except Exception:  # noqa: BLE001 - the session may be gone; the cluster clears its shared folder itself
        return


@contextmanager
def setting(spark: SparkSession, key: str, value: object) -> Iterator[None]:
    """A setting of the session for what is run or opened inside; the one before it comes back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialized(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """Write a table to the shared folder as Parquet and read it back.

    It is computed once, cut off from its lineage, and its size is known.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_bytes(df: DataFrame) -> int:
    """The size of the files of a table that ``stored`` returned; no job is run for it."""
    spark, total = df.sparkSession, 0
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        total += system.getContentSummary(place).getLength()
    return total
