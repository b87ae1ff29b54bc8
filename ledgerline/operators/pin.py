"""Frames pinned in the cluster's checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..shared import shared_folder


def pinned(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder: lineage is cut and later reads see the same rows in the same parts.

    A frame that this function returned is returned as it is.
    """
    if getattr(df, "_pinned", False):
        return df
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    held = df.checkpoint()
    held._pinned = True
    return held


class Pins:
    """Tables of an iteration in the checkpoint folder, each replaced by its successor.

    ``put`` writes a frame as Parquet, so that its size is known to the joins it takes part in, and reads it back; ``drop``
    deletes what no later round reads. The rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.made = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        where, files = self._at(self.root)
        files.mkdirs(where)
        files.deleteOnExit(where)
        self._paths: dict[int, str] = {}

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def put(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(back)] = path
        return back

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            where, files = self._at(self._paths.pop(id(df)))
            files.delete(where, True)
