"""Keyed tables on Parquet and cuts of lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder on a lone machine, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sentrylake-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/sentrylake/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written to and read from the shared folder, so that loops don't grow plans and lost executors cost little."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def last_of(updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last by ``order``; ties go to the greatest of the other values."""
    rest = [c for c in updates.columns if c not in keys]
    if not rest:
        return updates.distinct()
    last = F.struct(*order, F.to_json(F.struct(*rest)).alias("_rest"))
    out = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), last).alias("_row"))
    return out.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(updates.columns)


def upserted(stored: DataFrame, updates: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """stored with the rows of updates in place of those with equal keys; of updates with equal keys the last by ``order`` counts."""
    updates = last_of(updates, keys, order or [])
    return stored.join(updates.select(*keys), keys, "left_anti").unionByName(updates, allowMissingColumns=True)


def merged(stored: DataFrame, updates: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """A partial update: columns of updates replace stored ones where they aren't null; new keys and new columns are added.

    Of updates with equal keys, each column's last value by ``order`` that isn't null counts.
    """
    fresh = [c for c in updates.columns if c not in keys]
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*(order or []), F.col(c)))).alias(f"_new_{c}")
    out = stored.join(updates.groupBy(*keys).agg(*map(last, fresh)), keys, "full_outer")
    old = [c for c in stored.columns if c not in keys]
    value = lambda c: (F.coalesce(f"_new_{c}", c) if c in fresh and c in old else F.col(c) if c in old else F.col(f"_new_{c}")).alias(c)
    return out.select(*keys, *map(value, dict.fromkeys([*old, *fresh])))


def upsert_counts(stored: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """outcome, n: rows of updates without a key (failed), replaced by a later one, and keys inserted and replaced."""
    good = updates.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    known = good.select(*keys).distinct().join(stored.select(*keys).distinct().withColumn("_old", F.lit(True)), keys, "left")
    parts = [
        known.groupBy(F.when(F.col("_old"), "replaced").otherwise("inserted").alias("outcome")).agg(F.count(F.lit(1)).alias("n")),
        updates.agg(F.count(F.lit(1)).alias("n")).join(good.agg(F.count(F.lit(1)).alias("g")), F.lit(True)).select(F.lit("failed").alias("outcome"), (F.col("n") - F.col("g")).alias("n")),
    ]
    return parts[0].unionByName(parts[1])


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or no rows where it isn't there yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes the tables that cuts of lineage have left; results that still read them must be stored before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/sentrylake")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
