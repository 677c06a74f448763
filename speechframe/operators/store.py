"""Stored tables with upserts by key that rewrite only what they touch.

Rows live in buckets by a hash of their key, a folder a bucket and generation.
An upsert reads and writes the buckets of its own keys alone; a small
file, replaced at once, says which generation of each bucket counts.  A
failed or repeated upsert leaves what counts as it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import storage
from . import upsert

CURRENT = "current.json"


class KeyedStore:
    """A table at a folder; ``schema`` includes ``keys``. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, keys: list[str], buckets: int = 64):
        self.spark, self.folder, self.schema, self.keys, self.buckets = spark, folder.rstrip("/"), schema, keys, buckets

    def current(self) -> dict:
        """What counts: the generation of each bucket that has rows, and the last batch."""
        if f"{self.folder}/{CURRENT}" not in storage.sizes(self.folder, CURRENT):
            return {"generations": {}, "batch": None}
        with storage.open_input(f"{self.folder}/{CURRENT}") as f:
            return json.loads(f.read())

    def _rows(self, generations: dict[str, str]) -> DataFrame:
        if not generations:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{g}/bucket={b}" for b, g in generations.items()])

    def read(self) -> DataFrame:
        return self._rows(self.current()["generations"])

    def upsert(self, new: DataFrame, rules: dict[str, str], batch: int | None = None) -> list[int]:
        """Merges ``new`` (one row a key) in by ``upsert.merge``'s rules; returns the buckets rewritten. A batch number that isn't above the last changes nothing."""
        now = self.current()
        if batch is not None and now["batch"] is not None and batch <= now["batch"]:
            return []
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = storage.cut(new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]))
        touched = sorted(r.b for r in new.select(bucket.alias("b")).distinct().collect())  # at most as many as there are buckets
        if touched:
            old = self._rows({str(b): now["generations"][str(b)] for b in touched if str(b) in now["generations"]})
            merged = upsert.merge(old, new, self.keys, rules).select(*self.schema.names)
            generation = f"gen-{uuid.uuid4().hex}"
            merged.withColumn("bucket", bucket).repartition(min(len(touched), self.buckets), "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{generation}")
            now["generations"] |= {str(b): generation for b in touched}
        now["batch"] = batch if batch is not None else now["batch"]
        storage.write_whole(self.folder, CURRENT, json.dumps(now).encode())
        return touched
