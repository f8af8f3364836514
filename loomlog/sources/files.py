"""Folders of a table, by Hadoop's file system: whatever storage the path names."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """Existing paths that match a glob pattern, in order."""
    files, root = _open(spark, pattern)
    return sorted(status.getPath().toString() for status in files.globStatus(root) or ())


def delete(spark: SparkSession, path: str) -> None:
    files, root = _open(spark, path)
    files.delete(root, True)


def read_text(spark: SparkSession, path: str) -> str:
    files, root = _open(spark, path)
    stream = files.open(root)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """The file appears with all of its text, or not at all."""
    files, part = _open(spark, f"{path}.part")
    stream = files.create(part, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    move(spark, f"{path}.part", path)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, whether or not there is one already."""
    files, root = _open(spark, path)
    files.create(root, True).close()


def move(spark: SparkSession, source: str, target: str) -> None:
    files, root = _open(spark, source)
    goal = spark._jvm.org.apache.hadoop.fs.Path(target)
    files.mkdirs(goal.getParent())
    if not files.rename(root, goal):
        raise OSError(f"cannot move {source} to {target}")
