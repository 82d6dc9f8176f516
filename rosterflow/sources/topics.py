"""Message topics: needs the Kafka connector on the class path of the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterflow.sources.envelopes import publish_rows


def read_topic(spark: SparkSession, servers: str, topics: str, max_per_trigger: int) -> DataFrame:
    """Messages as a stream; ``seq`` orders them within their partition of the topic.

    A micro-batch takes at most ``max_per_trigger`` messages, which bounds what
    one key can bring into it.
    """
    raw = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", topics).option("maxOffsetsPerTrigger", max_per_trigger).load())
    return raw.select(
        F.col("value").cast("string").alias("value"), F.col("topic"), F.col("partition"),
        F.col("offset").alias("seq"))


def publish(envelopes: DataFrame, servers: str, topic: str) -> None:
    """Writes envelopes as messages with their headers."""
    (
        publish_rows(envelopes).write.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("topic", topic).option("includeHeaders", "true").save())
