"""Explicit schemas of tables that are read from lines."""

from pyspark.sql import types as T

ANAGRAM = T.StructType([T.StructField("akey", T.StringType()), T.StructField("word", T.StringType())])
