"""The few file operations the driver does itself, on whatever file system a path names."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _place(spark, path)
    return system.exists(where)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    system, where = _place(spark, pattern)
    return [status.getPath().toString() for status in system.globStatus(where) or []]


def delete(spark: SparkSession, path: str) -> int:
    """1 if there was such a folder."""
    system, where = _place(spark, path)
    return int(system.exists(where) and system.delete(where, True))


def first_line(spark: SparkSession, path: str) -> str:
    """The first line of a text file, which may be compressed in a way that its name tells."""
    jvm = spark.sparkContext._jvm
    system, where = _place(spark, path)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration()).getCodec(where)
    stream = system.open(where)
    stream = codec.createInputStream(stream) if codec else stream
    try:
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine() or ""
    finally:
        stream.close()


def kept_id(spark: SparkSession, path: str) -> str:
    """The id in a small file, made up and written when there is none."""
    system, where = _place(spark, path)
    if not system.exists(where):
        system.mkdirs(where.getParent())
        _, draft = _place(spark, f"{path}.{uuid.uuid4().hex}")
        out = system.create(draft)
        out.writeBytes(uuid.uuid4().hex)
        out.close()
        system.rename(draft, where)  # a writer that came first stays
    return first_line(spark, path)
