"""State of a stream by key, as files below the shared folder: every batch writes the keys it changed and nothing else.

Files of one level are merged, ``FAN`` at a time, into one of the next, so that a row is rewritten once a level, a lookup reads few
files, and what a batch writes follows the batch, not the age of the stream. A file is named by its level and its last batch; which
files hold the state before a batch follows from the batch number alone, so a batch that is replayed after a failure sees what it saw
the first time and overwrites what it wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FAN = 8


class KeyedState:
    """Rows of ``schema`` (a DDL string with the ``keys``), the newest one per key; ``alive`` tells rows that are still wanted."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], schema: str, fan: int = FAN):
        self.spark, self.folder, self.keys, self.fan = spark, folder, keys, fan
        self.schema = f"{schema}, _batch bigint"
        self.columns = [c for c in spark.createDataFrame([], schema).columns if c not in keys]

    def _path(self, level: int, upto: int) -> str:
        return f"{self.folder}/level={level}/upto={upto}"

    def _file_system(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _written(self, path: str) -> bool:
        place, system = self._file_system(f"{path}/_SUCCESS")
        return system.exists(place)

    def files(self, before: int) -> list[str]:
        """The files that together hold the state before a batch, newest first."""
        out, upto = [], before - 1
        while upto >= 0:
            level = 0
            while (upto + 1) % self.fan ** (level + 1) == 0:
                level += 1
            while level and not self._written(self._path(level, upto)):
                level -= 1
            out.append(self._path(level, upto))
            upto -= self.fan ** level
        return out

    def _newest(self, paths: list[str], alive: Column | None) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*self.columns, "_batch"), "_batch").alias("r")).select(*self.keys, "r.*")
        return newest if alive is None else newest.where(alive)

    def before(self, batch: int, alive: Column | None = None) -> DataFrame:
        """The state before a batch: one row per key."""
        return self._newest(self.files(batch), alive).drop("_batch")

    def put(self, batch: int, rows: DataFrame, alive: Column | None = None) -> None:
        """Write a batch's keys, then merge full levels; rows that are not ``alive`` any more go on the way."""
        rows.select(*self.keys, *self.columns, F.lit(batch).cast("bigint").alias("_batch")).write.mode("overwrite").parquet(self._path(0, batch))
        level = 0
        while (batch + 1) % self.fan ** (level + 1) == 0:
            step = self.fan ** level
            parts = [self._path(level, batch - k * step) for k in range(self.fan)]
            self._newest(parts, alive).write.mode("overwrite").parquet(self._path(level + 1, batch))
            # The files merged one turn earlier are no longer needed, not even if this batch is replayed.
            for k in range(self.fan, 2 * self.fan):
                place, system = self._file_system(self._path(level, batch - k * step))
                system.delete(place, True)
            level += 1
