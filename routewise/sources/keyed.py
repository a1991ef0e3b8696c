"""Keyed tables (S05): insert-if-absent into a target that is never shuffled.

The target is a Parquet table bucketed and sorted by its key.  A load hashes only its
own rows to the table's buckets; the anti-join reads each bucket of the target where it
lies, key column only, and the new rows are written as more files of the same buckets.
Its cost in shuffle is that of the load, whatever has been loaded before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from . import landing as L
from .tables import path_exists


class KeyedTable:
    """A table below ``root`` with one row a key.  The number of buckets is part of its
    path, so a table is never read with another number than it was written with."""

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = 64):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.path = f"{root.rstrip('/')}/{key}_{buckets}"
        self._name = f"keyed_{uuid.uuid4().hex}"  # the catalog entry is this object's own
        self._open = False

    def frame(self) -> DataFrame | None:
        """The table's rows, known to be bucketed; None before the first load."""
        if not self._open:
            if not path_exists(self.spark, self.path):
                return None
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(self.path).schema.fields)
            self.spark.sql(f"CREATE TABLE {self._name} ({columns}) USING parquet CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
            self._open = True
        return self.spark.table(self._name)

    def absent(self, batch: DataFrame, order: list[str]) -> DataFrame:
        """The first row of each of the batch's keys that the table doesn't hold."""
        # winners first: a key with a third of the batch is combined before the shuffle
        winners = L.first_writer_wins(batch, self.key, order).repartition(self.buckets, self.key)
        target = self.frame()
        return winners if target is None else winners.join(target.select(self.key), self.key, "left_anti")

    def insert(self, batch: DataFrame, order: list[str]) -> None:
        """Append the absent rows.  A load that is run again inserts nothing more."""
        rows = self.absent(batch, order)
        out = rows.write.format("parquet").mode("append").option("compression", "snappy").bucketBy(self.buckets, self.key).sortBy(self.key)
        out.option("path", self.path).saveAsTable(self._name)
        self._open = True
        self.spark.catalog.refreshTable(self._name)

    def close(self) -> None:
        """Drop the catalog entry; the files stay."""
        if self._open:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name}")
            self._open = False


def load_in_deliveries(landing: DataFrame, root: str, key: str, order: list[str], prepare, cutoffs: list[str], buckets: int = 64) -> DataFrame:
    """Load a landing frame delivery by delivery, split at the landing dates cutoffs, and
    return the table.  prepare(frame) gives a delivery's valid rows."""
    table = KeyedTable(landing.sparkSession, root, key, buckets)
    bounds = [None, *cutoffs, None]
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        part = landing
        if lo:
            part = part.where(f"_date >= date'{lo}'")
        if hi:
            part = part.where(f"_date < date'{hi}'")
        table.insert(prepare(part), order)
    return table.frame()
