"""Small files on the driver, through the file systems that Spark itself resolves."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def _resolved(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()), made


def glob(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, in lexical order; none if the folder is missing."""
    fs, path = _resolved(spark, pattern)
    return sorted(s.getPath().toString() for s in (fs.globStatus(path) or []))


def exists(spark: SparkSession, path: str) -> bool:
    fs, made = _resolved(spark, path)
    return fs.exists(made)


def write_text(spark: SparkSession, path: str, text: str) -> bool:
    """Writes UTF-8; a file that already has this content is left alone. Returns whether it wrote."""
    if exists(spark, path) and read_text(spark, path) == text:
        return False
    fs, made = _resolved(spark, path)
    out = fs.create(made, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    row = spark.read.format("binaryFile").load(path).select("content").first()
    return bytes(row["content"]).decode("utf-8")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``; a temporary one only where that is unset in local mode."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="skaldic-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``shared_folder`` named and all below it."""
    fs, made = _resolved(spark, path)
    fs.delete(made, True)
