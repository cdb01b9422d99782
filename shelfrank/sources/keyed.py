"""Documents stored by key, upserted bucket by bucket.

A key's hash names its bucket. An upsert merges the buckets that its keys fall into, and no others, into new files, and
then publishes a manifest that names every bucket's files; until then readers follow the manifest before. Manifests are
numbered, and a number is taken once: of two upserts at once the later one finds its number taken, and either only puts
its buckets over the new manifest or, where both changed a bucket, merges again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import places
from .chips import upserted


class Conflict(RuntimeError):
    """Other writers were first, again and again."""


class KeyedTable:
    """A table of documents in a folder, one for each key. buckets: as many as its size at the end asks for, about a
    gigabyte each; they are fixed when the table is first written."""

    TRIES = 20

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "title", buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self.manifests = places.Manifests(spark, f"{self.path}/manifests")

    # What is committed.

    def manifest(self, number: int | None = None) -> dict:
        """The last one, or the one of a number: {number, buckets: how many, files: folder by bucket}."""
        number, body = (number, self.manifests.read(number)) if number else self.manifests.last()
        return {"number": number, "buckets": self.buckets, "files": {}} | body

    def _bucket(self, key: Column, manifest: dict) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(manifest["buckets"])).cast("int")

    def _read(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        files = manifest["files"]
        wanted = [f"{self.path}/{files[b]}" for b in (files if buckets is None else map(str, buckets)) if b in files]
        return self.spark.read.schema(self.schema).parquet(*wanted) if wanted else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """All documents, as of the last manifest."""
        return self._read(self.manifest())

    def lookup(self, keys: list[str]) -> DataFrame:
        """The documents of some keys; only their buckets are read."""
        now = self.manifest()
        asked = self.spark.createDataFrame([(k,) for k in keys], "k string")
        buckets = [r[0] for r in asked.select(self._bucket(F.col("k"), now)).distinct().collect()]
        return self._read(now, buckets).where(F.col(self.key).isin(keys))

    # Upserts.

    def upsert(self, new: DataFrame, supplied: dict[str, Column] | None = None) -> dict:
        """Sets new documents over the stored ones by key, as `upserted` does, and gives the manifest. Two new documents of
        one key, or one without, are an error, and so nothing is changed."""
        given = {c: F.col(f"__has_{c}") for c in supplied or {}}
        told = [*(c for c in new.columns if c in self.schema_names()), *(has.alias(f"__has_{c}") for c, has in (supplied or {}).items())]
        rows = places.staged(new.select(*told), "upsert")  # read several times, computed once
        if rows.groupBy(self.key).count().where("count > 1").limit(1).count():
            raise ValueError("two new documents have one key")
        done, base = None, self.manifest()
        for _ in range(self.TRIES):
            if done is None:
                touched = [r[0] for r in rows.select(self._bucket(F.col(self.key), base)).distinct().collect()]  # as many as buckets
                done = self._merged(base, touched, rows, given)
            if self._publish(base, done):
                return self.manifest(base["number"] + 1)
            now = self.manifest()
            if any(now["files"].get(b) != base["files"].get(b) for b in done):
                done = None  # another writer changed one of our buckets
            base = now
        raise Conflict("other writers were first")

    def schema_names(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def _merged(self, base: dict, touched: list[int], rows: DataFrame, given: dict[str, Column]) -> dict[str, str]:
        """The touched buckets with the new documents, written; their folders by bucket."""
        merged = upserted(self._read(base, touched), rows, self.key, given)
        name = f"data/{uuid.uuid4().hex}"
        placed = merged.withColumn("__bucket", self._bucket(F.col(self.key), base))
        # A task a bucket, so a bucket is a file. Keys are unique and hashed, so buckets are of one size.
        placed.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{name}")
        return {str(b): f"{name}/__bucket={b}" for b in touched}

    def _publish(self, base: dict, done: dict[str, str]) -> bool:
        return self.manifests.put(base["number"] + 1, {"buckets": base["buckets"], "files": base["files"] | done})

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes older manifests, and folders that none of the last ones names: what upserts replaced, or left when they
        died. Not beside a running upsert, whose files no manifest names yet."""
        held = {f.split("/")[1] for n in self.manifests.numbers()[-keep:] for f in self.manifest(n)["files"].values()}
        self.manifests.forget(keep)
        gone = [name for name in places.listed(self.spark, f"{self.path}/data") if name not in held]
        for name in gone:
            places.removed(self.spark, f"{self.path}/data/{name}")
        return gone
