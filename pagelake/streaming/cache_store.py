"""The result cache of a stream as a kept table: one part per micro-batch, merged level by level.

Folders: parts/<name> hold cache rows; manifest/version=n names the parts that count, each with its level and the batches
it covers. A part of level 0 is one batch. FAN parts of a level become one part of the next, written anew by
`merged`; a new manifest makes it count, and folders that no manifest names any more are removed after that.
So the number of parts grows with the logarithm of the batches and expired rows go.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelake.operators.cache import CACHE_SCHEMA, path_exists
from pagelake.plans.skew import union_all

FAN = 8
PART = "name STRING, level INT, first_batch LONG, last_batch LONG"


def merged(entries: DataFrame, horizon: Column) -> DataFrame:
    """The rows that a look-up at or after the horizon can still find: none that expired before it, and of a key's
    rows created up to it only the last (of equal times the one with the greatest expiry, then data)."""
    alive = entries.where(F.col("expires_at") > horizon)
    old = alive.where(F.col("created_at") <= horizon)
    last = Window.partitionBy("key").orderBy(F.col("created_at").desc(), F.col("expires_at").desc(), F.col("data").desc())
    newest = old.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_rank")
    return newest.unionByName(alive.where(F.col("created_at") > horizon))


class CacheStore:
    """A cache at a path with one writer, the stream."""

    def __init__(self, spark: SparkSession, path: str, fan: int = FAN):
        self.spark, self.path, self.fan = spark, path, fan

    def parts(self) -> tuple[int, list]:
        """The newest manifest's number and its parts."""
        if not path_exists(self.spark, f"{self.path}/manifest"):
            return 0, []
        table = self.spark.read.schema(f"{PART}, version LONG").parquet(f"{self.path}/manifest")
        newest = table.agg(F.max("version")).first()[0]
        return newest or 0, table.where(F.col("version") == newest).orderBy("first_batch").collect() if newest else []

    def _commit(self, version: int, parts: list) -> None:
        rows = [(p["name"], p["level"], p["first_batch"], p["last_batch"]) for p in parts]
        self.spark.createDataFrame(rows, PART).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")

    def _folder(self, name: str) -> str:
        return f"{self.path}/parts/{name}"

    def rows(self, parts: list) -> DataFrame:
        found = [self.spark.read.schema(CACHE_SCHEMA).parquet(self._folder(p["name"])) for p in parts]
        return union_all(found) if found else self.spark.createDataFrame([], CACHE_SCHEMA)

    def before(self, batch_id: int, now=None) -> DataFrame:
        """The rows of earlier batches, live ones only where `now` is given. A batch that is replayed doesn't see its own."""
        rows = self.rows([p for p in self.parts()[1] if p["last_batch"] < batch_id])
        return rows if now is None else rows.where(F.col("expires_at") > F.lit(now))

    def add(self, entries: DataFrame, batch_id: int) -> None:
        """Store a batch's rows; storing a batch again replaces them."""
        version, parts = self.parts()
        name = f"batch-{batch_id}-{uuid.uuid4().hex}"
        entries.write.parquet(self._folder(name))
        kept = [p for p in parts if p["last_batch"] != batch_id]
        self._commit(version + 1, [*kept, {"name": name, "level": 0, "first_batch": batch_id, "last_batch": batch_id}])
        self.clean()

    def compact(self, batch_id: int, horizon) -> bool:
        """Merge the lowest level that has `fan` parts of batches before this one. Look-ups from the horizon on find the same rows.

        Only earlier batches are merged, so this batch, if it is replayed, still finds what it found at first.
        """
        version, parts = self.parts()
        earlier = [p for p in parts if p["last_batch"] < batch_id]
        for level in sorted({p["level"] for p in earlier}):
            some = [p for p in earlier if p["level"] == level]
            if len(some) < self.fan:
                continue
            name = f"level-{level + 1}-{uuid.uuid4().hex}"
            merged(self.rows(some), F.lit(horizon)).sortWithinPartitions("key").write.parquet(self._folder(name))
            whole = {"name": name, "level": level + 1, "first_batch": some[0]["first_batch"], "last_batch": max(p["last_batch"] for p in some)}
            names = {p["name"] for p in some}
            self._commit(version + 1, sorted([p for p in parts if p["name"] not in names] + [whole], key=lambda p: p["first_batch"]))
            self.clean()
            return True
        return False

    def clean(self) -> None:
        """Remove folders of parts and manifests that don't count any more (also those of runs that failed)."""
        version, parts = self.parts()
        names = {p["name"] for p in parts}
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for kind, counts in (("parts", lambda n: n in names), ("manifest", lambda n: n == f"version={version}" or not n.startswith("version="))):
            place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
            for status in files.listStatus(place) if files.exists(place) else []:
                if not counts(status.getPath().getName()):
                    files.delete(status.getPath(), True)
