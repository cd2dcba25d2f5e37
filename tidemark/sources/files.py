"""Small file-system helpers over the Hadoop API (any supported file system)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = _path(spark, path)
    return fs.exists(hadoop_path)


def delete(spark: SparkSession, path: str) -> None:
    hadoop_path, fs = _path(spark, path)
    fs.delete(hadoop_path, True)


def partitions(spark: SparkSession, path: str, column: str) -> dict[str, str]:
    """Values of a partition column that have a folder, with the folder."""
    hadoop_path, fs = _path(spark, path)
    if not fs.exists(hadoop_path):
        return {}
    found = {}
    for status in fs.listStatus(hadoop_path):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith(f"{column}="):
            found[name.split("=", 1)[1]] = status.getPath().toString()
    return found


def move(spark: SparkSession, path: str, target: str) -> None:
    """Give a file or folder another path of the same file system, where there is nothing yet."""
    hadoop_path, fs = _path(spark, path)
    to = _path(spark, target)[0]
    if fs.exists(to) or not fs.rename(hadoop_path, to):
        raise OSError(f"cannot move {path} to {target}")


def make(spark: SparkSession, path: str) -> None:
    hadoop_path, fs = _path(spark, path)
    fs.mkdirs(hadoop_path)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files of a folder, those of folders below it left out."""
    hadoop_path, fs = _path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(hadoop_path) if s.isFile()]


def size(spark: SparkSession, path: str) -> int:
    """Bytes of the files under a folder."""
    hadoop_path, fs = _path(spark, path)
    return fs.getContentSummary(hadoop_path).getLength()
