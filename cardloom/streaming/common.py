"""Running a stream over files to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.operators import lineage

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; times become zoned, as watermarks need them."""
    static = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(static.schema).parquet(f"{sf_dir}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Run the stream over all that is there, into Parquet in the shared folder, and read that.

    The session's state store is as before when the stream has ended, and the stream's own state is removed.
    """
    spark, setting = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    folder = lineage.new_folder(spark, name)
    spark.conf.set(setting, STATE_STORE)
    try:
        query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)
    lineage.remove(spark, f"{folder}/state")
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
