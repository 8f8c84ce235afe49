"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary one on a lone machine, as in tests, and an error on a cluster.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sentrylake-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def drop_scratch(spark: SparkSession) -> None:
    """Deletes the tables that operators have left; results that still read them must be stored before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/sentrylake")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sentrylake/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage of df by writing it as Parquet to the shared folder; a lost executor does not lose it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def global_rank(df: DataFrame, orders: list[Column], name: str, rank: str = "rank") -> DataFrame:
    """df with ``rank``, its rows' places (from 0) in the total order, without any single-partition window.

    Rows are range-partitioned and sorted; each row's place in its partition and the partitions' sizes give its rank.
    Only the partitions' sizes (a row each) are summed in one place. The result is cut off from its lineage.
    """
    ranged = df.repartitionByRange(*orders).sortWithinPartitions(*orders).withColumn("_at", F.monotonically_increasing_id())
    ranged = materialize(ranged, name)
    part = F.shiftright("_at", 33)
    sizes = {r["p"]: r["n"] for r in ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for p in sorted(sizes):
        starts.append((int(p), total))
        total += sizes[p]
    if not starts:
        return ranged.withColumn(rank, F.lit(None).cast("long")).drop("_at")
    spark = df.sparkSession
    offsets = F.broadcast(spark.createDataFrame(starts, "_p long, _start long"))  # a row for each partition
    ranged = ranged.withColumn("_p", part).join(offsets, "_p")
    return ranged.withColumn(rank, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_p", "_start")


def join_by_key(left: DataFrame, keyed: DataFrame, key: str, share: int, how: str = "left") -> DataFrame:
    """Joins ``keyed`` (unique ``key``, with ``n_rows``: that key's rows in left) to left.

    Keys with at least ``share`` rows are joined by broadcast, so that none makes a hot task. With N rows in left there
    are at most N / share of these; callers pass share = N / 1000 or more, so at most 1000 rows are broadcast.
    """
    hot = F.broadcast(keyed.where(F.col("n_rows") >= share).withColumn("_hot", F.lit(True)))
    names = [c for c in keyed.columns if c != key]
    rest = keyed.where(F.col("n_rows") < share)
    first = left.join(hot, key, "left")
    cool = first.where(F.col("_hot").isNull()).drop("_hot", *names).join(rest, key, how)
    warm = first.where(F.col("_hot")).drop("_hot")
    return warm.unionByName(cool)


def unit_hash(*cols: Column) -> Column:
    """A double in (0, 1) from an MD5 of the columns' text; the same in every run and on every engine."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))
