"""Anagram index and exact anagram lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import anagram_key


def anagram_index(words: DataFrame) -> DataFrame:
    return words.where("word <> ''").select(anagram_key("word").alias("akey"), "word")


def anagram_lookup(queries: DataFrame, index: DataFrame) -> DataFrame:
    """qid, query, matches (sorted) for each query; an empty list where nothing matches."""
    asked = queries.withColumn("akey", anagram_key("query"))
    found = asked.join(index, "akey", "left").groupBy("qid", "query")
    return found.agg(F.array_sort(F.collect_list("word")).alias("matches"))
