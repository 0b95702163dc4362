"""Tables and folders that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session or its context. There is no other."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not jdir.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fieldloom-"))  # one machine, one process
            jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jdir.get()
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write df once under the shared folder and read it back: lineage ends here, so a lost executor costs no recomputation.

    The files go by discard(), or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of stashed tables that nothing reads any more."""
    for df in tables:
        for path in {os.path.dirname(f) for f in df.inputFiles()}:
            where, system = _file_system(df.sparkSession, path)
            system.delete(where, True)


def folder(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, which goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    where, system = _file_system(spark, path)
    system.deleteOnExit(where)
    return path


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file, written by the driver."""
    where, system = _file_system(spark, path)
    out = system.create(where, True)
    out.write(bytearray(content))
    out.close()


def put_joined(spark: SparkSession, path: str, head: bytes, parts: str, tail: bytes, skip: int) -> None:
    """One file: head, the part files of a folder in their order less their first `skip` bytes in all, tail. The driver copies by a small buffer."""
    jvm = spark.sparkContext._jvm
    folder, system = _file_system(spark, parts)
    found = [x.getPath() for x in system.listStatus(folder) if x.getPath().getName().startswith("part-") and x.getLen()]
    where, target = _file_system(spark, path)
    out = target.create(where, True)
    out.write(bytearray(head))
    for i, part in enumerate(sorted(found, key=lambda x: (int(x.getName().split("-")[1]), x.getName()))):
        source = system.open(part)
        if not i:
            source.seek(skip)
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
        source.close()
    out.write(bytearray(tail))
    out.close()


def replace_folder(spark: SparkSession, path: str, name: str, file: str) -> None:
    """A folder holds nothing but a file, moved there under a name."""
    where, system = _file_system(spark, path)
    system.delete(where, True)
    system.mkdirs(where)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where, name)
    if not system.rename(_file_system(spark, file)[0], target):
        raise OSError(f"{file} can't be moved to {target}")


def remove(spark: SparkSession, path: str) -> None:
    where, system = _file_system(spark, path)
    system.delete(where, True)
