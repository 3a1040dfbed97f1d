"""Other tables read as events, without copying them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.functions.predicates import Layout


def events_view(spark: SparkSession, sf_dir: str, sparse: bool = False) -> tuple[DataFrame, Layout]:
    """The events table: user as entity, event_type as a tag, the k of props as a number tag with an index.

    sparse keeps k only below 50, so that tags may be absent.
    """
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    view = raw.select(
        (F.col("event_id") + 1).alias("id"),
        F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("ts"),
        F.lit(None).cast("string").alias("entity_str"),
        F.col("user_id").alias("entity_i64"),
        "event_type",
        (F.when(k < 50, k) if sparse else k).alias("k"),
    )
    return view, Layout(text_tags={"event_type": "event_type"}, number_tags={"k": "k"}, indexes={"k": "k"}, has_map=False)


def orders_view(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Layout]:
    """Orders as events: customer as entity, status and priority as tags, the order's key as id."""
    raw = spark.read.parquet(f"{sf_dir}/orders.parquet")
    view = raw.select(F.col("o_orderkey").cast("long").alias("id"), F.lit(0).cast("long").alias("ts"), F.lit(None).cast("string").alias("entity_str"), F.col("o_custkey").cast("long").alias("entity_i64"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return view, Layout(text_tags={"status": "status", "priority": "priority"}, has_map=False)
