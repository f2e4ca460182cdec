"""Session helpers: table reading, the shared work folder and materialised cut points."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory, read by Spark (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach, as the session names it.

    That is ``spark.checkpoint.dir`` or what ``setCheckpointDir`` was given.  Only on one machine (master
    ``local``) a temporary folder is made where neither is set; a cluster without either is an error,
    since each executor would write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        given = context._jsc.sc().getCheckpointDir()
        if given.isDefined():
            return given.get().rstrip("/")
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lineupkit-")
        context.setCheckpointDir(found)
        found = context._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A short table from the driver's rows.  It goes by way of Arrow, which starts no Python worker."""
    names = [x.strip().split(" ")[0] for x in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    fields = [(n, kinds[x.strip().split(" ")[1]]) for n, x in zip(names, schema.split(", "), strict=True)]
    columns = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=pa.schema(fields)))


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/lineupkit/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: lineage ends here, executors may go.

    The shuffle files of the write are removed as it ends, since nothing reads them again.
    """
    spark = df.sparkSession
    path, before = work_path(spark, label), spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def _file_system(spark: SparkSession, path: str):
    """Hadoop's path and its file system."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    found, system = _file_system(spark, path)
    return system.exists(found)


def dealt(rows: DataFrame, key: str, size: int, task_size: int = 4 << 20) -> DataFrame:
    """``rows`` dealt by ``key`` among as many tasks as files of ``size`` bytes ask for, so a task's share stays the same as they grow.

    Small files leave the number to Spark.
    """
    tasks = -(-size // task_size)
    return rows.repartition(tasks, key) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(key)


def table_bytes(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Bytes of a table's files."""
    found, system = _file_system(spark, f"{sf_dir}/{name}.parquet")
    return system.getContentSummary(found).getLength()


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder, if it is there."""
    found, system = _file_system(spark, path)
    system.delete(found, True)


def drop_stash(df: DataFrame) -> None:
    """Remove the files of a stashed table, or of those that ``df`` is made of, which nothing reads any more.

    The path of a table that ``stash`` returned is known; only for what is made of one its files are listed.
    """
    path = getattr(df, "_stashed_at", None)
    for folder in [path] if path else {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lineupkit/" in folder:
            remove_path(df.sparkSession, folder)
