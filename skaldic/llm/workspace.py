"""Tables that an operator writes between two of its jobs.

They cut lineage: a lost executor costs the tasks it ran, not the jobs before.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where it is unset in local mode."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="skaldic-")


class Workspace:
    """A folder of intermediate Parquet tables below the shared root."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._made = 0

    def new_path(self, tag: str) -> str:
        self._made += 1
        return f"{self.path}/{self._made:03d}-{tag}"

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        """``df`` written and read back: computed once, without lineage."""
        path = self.new_path(tag)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a table from ``keep`` that no later plan reads."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if self.path in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def unused_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for columns of an operator's own, none of them a column of ``df`` in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def own_columns(df: DataFrame) -> list[Column]:
    """Every column of ``df``, whatever signs are in its name."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
