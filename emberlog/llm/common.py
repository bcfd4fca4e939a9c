"""Helpers shared by the training-data operators: shared-folder tables, bounded bitmaps, components."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.shipping import ship

_OWN_FOLDER: list[str] = []
#: Paths of the tables that stored() made, in order.
_MADE: list[str] = []
SMALL_BYTES = 256 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. One that is small and in fewer files than there are cores is dealt out anew, since a
    file of one row group is one task; larger tables are read as they lie. This changes the plan only, never a result."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    few = len(df.inputFiles()) < cores and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL_BYTES
    return df.repartition(cores) if few else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local one stands in only where the session names none and all
    runs in one process (tests); on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append(tempfile.mkdtemp(prefix="emberlog-"))
    return f"file://{_OWN_FOLDER[0]}"


def held(docs: DataFrame, **columns: Column) -> DataFrame:
    """docs as one column `row` beside columns of the operator's own, so that names cannot clash; see freed()."""
    return docs.select(F.struct("*").alias("row"), *(c.alias(n) for n, c in columns.items()))


def freed(df: DataFrame, names: list[str], **columns: Column) -> DataFrame:
    """The columns `names` of the rows of held(), those in `columns` replaced."""
    return df.select(*(columns[n].alias(n) if n in columns else F.col("row").getField(n).alias(n) for n in names))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session may have ended before the interpreter  # noqa: BLE001
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, and a lost executor loses nothing.

    The table goes when the interpreter ends, or earlier through drop_stored().
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete_at_exit, spark, path)
    _MADE.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def tables_made() -> int:
    """How many tables stored() has made so far; see drop_since()."""
    return len(_MADE)


def drop_since(keep: DataFrame, count: int) -> None:
    """Deletes all tables that stored() made after the first `count`, but `keep`, which nothing of theirs feeds any more."""
    kept = getattr(keep, "_stored_at", None)
    for path in _MADE[count:]:
        if path != kept:
            _delete(keep.sparkSession, path)
    _MADE[count:] = [kept] if kept in _MADE[count:] else []


def drop_stored(df: DataFrame) -> None:
    """Deletes a table made by stored() that nothing reads any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        _delete(df.sparkSession, path)


def released(df: DataFrame) -> None:
    """Lets Spark delete the shuffle files of finished steps now. Else they stay until the driver's next garbage
    collection, half an hour at worst, and fill the executors' disks meanwhile."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


BITS = 1 << 24
_BLOCK = 1 << 16


def key_bitmap(keys: DataFrame, key: str, bits: int = BITS, hashed: bool = False) -> np.ndarray:
    """A bitmap of `bits` bits over a hash of `key` (or over `key`, if hashed): its size is fixed, whatever the number of keys.

    Every key that is in `keys` tests true; others do with the share of set bits. It only thins
    rows out before a shuffle; the join behind it decides. Built block by block on the executors.
    """
    at = keys.select(F.pmod(F.col(key) if hashed else F.xxhash64(key), F.lit(bits)).alias("b")).distinct()

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(_BLOCK, np.uint8)
        b = pdf["b"].to_numpy()
        on[b % _BLOCK] = 1
        return pd.DataFrame({"i": [int(b[0] // _BLOCK)], "m": [np.packbits(on).tobytes()]})

    rows = at.groupBy((F.col("b") / _BLOCK).cast("long").alias("g")).applyInPandas(block, "i long, m binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[r["i"] * (_BLOCK // 8) : (r["i"] + 1) * (_BLOCK // 8)] = np.frombuffer(bytes(r["m"]), np.uint8)
    return out


def in_bitmap(spark: SparkSession, bitmap: np.ndarray):
    """A function (Column) -> boolean Column over a bitmap of key_bitmap()."""
    sent = spark.sparkContext.broadcast(bitmap)
    bits = len(bitmap) * 8

    @F.pandas_udf("boolean")
    def on(b: pd.Series) -> pd.Series:
        i = b.to_numpy()
        return pd.Series((sent.value[i >> 3] >> (7 - (i & 7)).astype(np.uint8)) & 1 == 1)

    return lambda column: on(F.pmod(F.xxhash64(column), F.lit(bits)))


def thin_out(df: DataFrame, column: str, keys: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """The rows of df whose column may be among keys: all that are, and few others (see key_bitmap)."""
    return df.where(in_bitmap(df.sparkSession, key_bitmap(keys, key, bits))(F.col(column)))


def split_off(df: DataFrame, column: str, keys: DataFrame, key: str, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(rows whose column may be among keys, rows whose column is not): the second part needs no join and no shuffle."""
    may = in_bitmap(df.sparkSession, key_bitmap(keys, key, bits))(F.col(column))
    return df.where(may), df.where(~may)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of each connected component, for nodes that have an edge.

    Labels fall to the smallest neighbour's label and then to that label's label, so a chain of
    length d takes about log d rounds. Each round is written to the shared folder; nothing but a
    count comes to the driver. Hub nodes only meet in aggregates that combine map-side and in inner
    joins whose large partitions adaptive execution splits.
    """
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    # Each node's smaller neighbours are first tied to the smallest of them: the many stars that share their
    # centres then leave about one edge a node.
    e = stored(e.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    low = e.join(e.groupBy("hi").agg(F.min("lo").alias("m")), "hi")
    tied = low.select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("a"), F.col("m").alias("b")).distinct()
    both = stored(tied.union(tied.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    drop_stored(e)
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("root").alias("low"))
        lower = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "low").alias("mid"))
        above = labels.select(F.col("node").alias("mid"), F.col("root").alias("top"))
        step = stored(lower.join(above, "mid").select("node", "was", F.least("mid", "top").alias("root")), "labels")
        moved = step.where("root <> was").limit(1).count()
        drop_stored(labels)
        labels = step.select("node", "root")
        labels._stored_at = step._stored_at
        if not moved:
            drop_stored(both)
            return labels
