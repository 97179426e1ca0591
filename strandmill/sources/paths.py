"""Files on any file system that Spark can read, through its Hadoop client."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _at(spark, path)
    return files.exists(where)


def size(spark: SparkSession, path: str) -> int:
    """The bytes of a file."""
    where, files = _at(spark, path)
    return files.getFileStatus(where).getLen()


def listing(spark: SparkSession, path: str, suffix: str) -> list[str]:
    """The file, or the files of a folder with a suffix, by name; a missing path raises when it is read."""
    where, files = _at(spark, path)
    if not files.exists(where) or not files.getFileStatus(where).isDirectory():
        return [path]
    return sorted(str(f.getPath().toString()) for f in files.listStatus(where) if f.isFile() and f.getPath().getName().endswith(suffix))


def head(spark: SparkSession, path: str, n: int = 65_536) -> bytes:
    """The first bytes of a file."""
    where, files = _at(spark, path)
    stream = files.open(where)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def make_folder(spark: SparkSession, path: str) -> None:
    where, files = _at(spark, path)
    files.mkdirs(where)


def write(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file, written over one that is there."""
    where, files = _at(spark, path)
    stream = files.create(where, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    """A file or folder with all that is in it, if it is there."""
    where, files = _at(spark, path)
    files.delete(where, True)
