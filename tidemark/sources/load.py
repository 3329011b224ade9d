"""Synthetic load: requests with a fixed payload, as a table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAYLOAD = '{"event":"load","level":"INFO","message":"synthetic load record"}'


def requests(spark: SparkSession, count: int, workers: int = 8, topic: str = "load", payload: str = PAYLOAD) -> DataFrame:
    """n, worker and ``body`` of ``count`` requests, dealt over ``workers`` partitions."""
    body = F.concat(F.lit('{"topic":"'), F.lit(topic), F.lit('","payload":'), F.lit(payload), F.lit("}"))
    return spark.range(0, count, 1, workers).select(F.col("id").alias("n"), F.spark_partition_id().alias("worker"), body.alias("body"))


def request_stream(spark: SparkSession, per_second: int, topic: str = "load", payload: str = PAYLOAD) -> DataFrame:
    """n, ts and ``body`` at a steady rate."""
    body = F.concat(F.lit('{"topic":"'), F.lit(topic), F.lit('","payload":'), F.lit(payload), F.lit("}"))
    rate = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return rate.select(F.col("value").alias("n"), F.col("timestamp").alias("ts"), body.alias("body"))
