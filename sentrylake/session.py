"""Settings that a session should have for this engine. All can be set at run time."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM leaves methods of over 8000 bytes of byte code to the interpreter. Wide projections (normalisation, sensors, the graph)
    # would be one such method in whole-stage code; beyond this limit Spark compiles their expressions to small methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Large results are mostly ids made of digests: as text they take 10 bytes a row with this codec and 17.8 with Spark's default.
    "spark.sql.parquet.compression.codec": "zstd",
    # state of findings that goes by the clock needs it
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def tuned(spark: SparkSession) -> SparkSession:
    """The session with these settings."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark
