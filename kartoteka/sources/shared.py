"""Folders that the driver and all executors share, and tables in them that end with the application."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the warehouse; a local warehouse serves a local master alone."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there is None:
        there = spark.conf.get("spark.sql.warehouse.dir")
        if there.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return there.rstrip("/")


def own_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is removed when the JVM ends, however the session ended."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    _, fs, where = _opened(spark, path)
    fs.mkdirs(where)  # only what exists can be marked
    fs.deleteOnExit(where)
    return f"{path}/rows"


def _opened(spark: SparkSession, path: str):
    """(JVM, its file system of the path, the path)."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    _, fs, where = _opened(spark, path)
    return fs.exists(where)


def removed(spark: SparkSession, path: str) -> bool:
    """Removes a file or folder; whether it was there."""
    _, fs, where = _opened(spark, path)
    return fs.delete(where, True)


def joined(spark: SparkSession, parts: str, to: str, start: str = "", end: str = "", without: int = 0, empty: str = "") -> None:
    """The part files of a folder in the order of their numbers as one file, between start and end; or empty, without any bytes.

    without: so many bytes at the end of the last part that has any are left out. Bytes go from stream to stream.
    """
    jvm, fs, where = _opened(spark, parts)
    found = sorted((x.getPath().getName(), x.getLen(), x.getPath()) for x in fs.listStatus(where) if x.getPath().getName().startswith("part-") and x.getLen())
    _, target, goal = _opened(spark, to)
    out = target.create(goal, True)
    try:
        out.write(bytearray((start if found else empty).encode()))
        for k, (_, size, part) in enumerate(found):
            source = fs.open(part)
            try:
                jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, size - (without if k == len(found) - 1 else 0))
            finally:
                source.close()
        out.write(bytearray((end if found else "").encode()))
    finally:
        out.close()
