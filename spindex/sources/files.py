"""Small files and folders of any store that Spark reaches, by the driver, through Hadoop's file systems."""

from __future__ import annotations

import time
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Entry:
    """A file or folder of a listing."""

    name: str
    age_s: float


def _at(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf), p


def listing(spark: SparkSession, path: str) -> list[Entry]:
    """What lies in a folder, by name; nothing if it is not there."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return []
    now = time.time()
    return sorted((Entry(s.getPath().getName(), now - s.getModificationTime() / 1000) for s in fs.listStatus(p)), key=lambda e: e.name)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files in a folder."""
    fs, p = _at(spark, path)
    return fs.getContentSummary(p).getLength()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that is not there yet; False if it is."""
    fs, p = _at(spark, path)
    try:
        stream = fs.create(p, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName() or fs.exists(p):
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file, or a folder with all that lies in it; one that is gone is no error."""
    fs, p = _at(spark, path)
    fs.delete(p, True)
