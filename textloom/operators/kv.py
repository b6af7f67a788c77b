"""Ordered key-value rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.numbering import numbered


def insert(store: DataFrame, values: DataFrame) -> DataFrame:
    """Append rows of payload; rows without a key take the next ones, in order of payload, without gaps."""
    if "key" not in values.columns:
        values = values.withColumn("key", F.lit(None).cast("long"))
    given, free = values.where("key is not null").select("key", "payload"), values.where("key is null").select("payload")
    old = store.select("key", "payload").unionByName(given)
    last = old.agg(F.coalesce(F.max("key"), F.lit(-1))).first()[0]
    return old.unionByName(numbered(free, "payload").select((F.col("number") + last + 1).cast("long").alias("key"), "payload"))


def search(store: DataFrame, key: int) -> DataFrame:
    return store.where(F.col("key") == key)


def search_value(store: DataFrame, payload: str) -> DataFrame:
    return store.where(F.col("payload") == payload)


def update(store: DataFrame, key: int, payload: str) -> DataFrame:
    return store.withColumn("payload", F.when(F.col("key") == key, F.lit(payload)).otherwise(F.col("payload")))


def ordered(store: DataFrame) -> DataFrame:
    return store.orderBy("key")
