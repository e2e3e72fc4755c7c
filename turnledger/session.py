"""Session helpers shared by all subpackages: code shipping and shared-folder tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Most rows and bytes of an Arrow batch, where the session allows more.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_shipped: set[str] = set()
#: Folders that this process has asked for in shared folders, for ``remove_stored``.
_folders: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers once per application, as ``--py-files`` would, and keeps Arrow batches small,
    also with very long texts. Smaller bounds that the session already has stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        own = spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b")
        if not own.isdigit() or not 0 < int(own) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # already running from a shipped archive
        return
    archive = os.path.join(tempfile.mkdtemp(), "turnledger_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(archive)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where the session names none, a temporary folder is set on a local master (tests);
    on a cluster that is an error, as executors and driver do not share such folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-turnledger-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    folder = f"{shared_folder(spark)}/turnledger-{uuid.uuid4().hex}"
    _folders.add(folder)
    return f"{folder}/{name}"


def remove_stored(spark: SparkSession) -> int:
    """Removes the intermediate tables that this process has stored so far, and says how many. Call it when results are written: tables that
    still rest on them cannot be read afterwards."""
    path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    gone = list(_folders)
    for folder in gone:
        path(folder).getFileSystem(conf).delete(path(folder), True)
        _folders.discard(folder)
    return len(gone)


def use_state_store(spark: SparkSession) -> None:
    """Queries started from now on keep their state in RocksDB, which state with timers or a time to live needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None, group_rows: int | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage ends there, and losing an executor loses nothing. Tables of large rows
    can have row groups of at most ``group_rows``, as a task holds one: sizes in bytes are first looked at after a hundred rows."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if group_rows:
        writer = writer.option("parquet.block.row.count.limit", group_rows)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
