"""Versioned tables: folders of Parquet, and pointer files that name those which make up the current version."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"
#: Folders of an appended table beyond which it is written anew as one.
MOST_PARTS = 64


class Store:
    """A table under a path that all executors share. Readers see one whole version; a failed write leaves none.

    A keyed table lies in `buckets` buckets by a hash of its keys, so that a batch rewrites only those that it
    touches (merge_buckets). A table that only grows is appended to (append). Each change is a pointer file of its own,
    renamed into place, so none is ever half there; pointers are ordered by batch, and within a batch by revision.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self) -> dict:
        """The newest pointer. folders: bucket -> the folders that hold it; the bucket "" is a whole table."""
        at = self._path(f"{self.path}/_pointers")
        none = {"folders": {}, "schema": None, "batch": -1, "revision": 0, "meta": {}}
        if not self._fs.exists(at):
            return none
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(at) if s.getPath().getName().endswith(".json"))
        if not names:
            return none
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.path}/_pointers/{names[-1]}").first()[0])

    def _commit(self, now: dict, folders: dict, schema: StructType, batch: int, meta: dict | None) -> None:
        revision = now["revision"] + 1 if batch == now["batch"] else 0
        body = json.dumps({"folders": folders, "schema": schema.json(), "batch": batch, "revision": revision, "meta": {**now["meta"], **(meta or {})}})
        self._fs.mkdirs(self._path(f"{self.path}/_pointers"))
        draft = self._path(f"{self.path}/_pointers/{uuid.uuid4().hex}.draft")
        out = self._fs.create(draft, True)
        out.write(bytearray(body.encode()))
        out.close()
        if not self._fs.rename(draft, self._path(f"{self.path}/_pointers/{batch + 1:012d}-{revision:06d}.json")):
            raise RuntimeError(f"batch {batch} was written by another")

    @staticmethod
    def _version(batch: int) -> str:
        return f"v{batch + 1:012d}-{uuid.uuid4().hex[:8]}"

    @property
    def batch(self) -> int:
        """The last batch that is in the table."""
        return self._pointer()["batch"]

    @property
    def meta(self) -> dict:
        return self._pointer()["meta"]

    def bucket_of(self, keys: list[str]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets))

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The table, or some of its buckets; None if nothing was ever written. A table that is not in buckets is read whole."""
        now = self._pointer()
        if now["schema"] is None:
            return None
        wanted = now["folders"] if buckets is None or "" in now["folders"] else {str(b): now["folders"].get(str(b), []) for b in buckets}
        schema = StructType.fromJson(json.loads(now["schema"]))
        paths = [f"{self.path}/{f}" for own in wanted.values() for f in own]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, df: DataFrame, batch: int, meta: dict | None = None, keys: list[str] | None = None) -> None:
        """Makes df the current version as of a batch, in buckets if keys are given. A batch that is in already changes nothing."""
        now = self._pointer()
        if batch > now["batch"]:
            self._write(now, df, batch, meta, keys)

    def replace(self, df: DataFrame, meta: dict | None = None, keys: list[str] | None = None) -> None:
        """Makes df the current version without a batch of its own: roll-backs, discarded rows."""
        now = self._pointer()
        self._write(now, df, now["batch"], meta, keys)

    def _write(self, now: dict, df: DataFrame, batch: int, meta: dict | None, keys: list[str] | None) -> None:
        if keys:
            folders = self._bucketed(df.withColumn(BUCKET, self.bucket_of(keys)), batch)
        else:
            version = self._version(batch)
            df.write.parquet(f"{self.path}/{version}")
            folders = {"": [version]}
        self._commit(now, folders, df.schema, batch, meta)

    def append(self, df: DataFrame, batch: int | None, meta: dict | None = None) -> None:
        """Adds rows as of a batch, or without one of its own."""
        now = self._pointer()
        if batch is None:
            batch = now["batch"]
        elif batch <= now["batch"]:
            return
        parts = now["folders"].get("", [])
        if len(parts) >= MOST_PARTS:
            self._write(now, self.read().unionByName(df), batch, meta, None)
            return
        version = self._version(batch)
        df.write.parquet(f"{self.path}/{version}")
        self._commit(now, {"": [*parts, version]}, df.schema, batch, meta)

    def _bucketed(self, df: DataFrame, batch: int) -> dict:
        version = self._version(batch)
        df.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{version}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{version}"))]
        return {n.split("=")[1]: [f"{version}/{n}"] for n in names if n.startswith(f"{BUCKET}=")}

    def merge_buckets(self, df: DataFrame, touched: list[int], batch: int | None, keys: list[str], meta: dict | None = None) -> None:
        """Puts df in the place of the touched buckets, as of a batch or without one of its own; the others stay as they are."""
        now = self._pointer()
        if batch is None:
            batch = now["batch"]
        elif batch <= now["batch"]:
            return
        fresh = self._bucketed(df.withColumn(BUCKET, self.bucket_of(keys)), batch)
        kept = {b: f for b, f in now["folders"].items() if b and int(b) not in touched}
        self._commit(now, kept | fresh, df.schema, batch, meta)

    def vacuum(self) -> None:
        """Deletes folders that the current version does not need."""
        needed = reduce(lambda a, b: a | {f.split("/")[0] for f in b}, self._pointer()["folders"].values(), set())
        for s in self._fs.listStatus(self._path(self.path)):
            name = s.getPath().getName()
            if name.startswith("v") and name not in needed:
                self._fs.delete(s.getPath(), True)
