"""The XML cleaner as one job: an XML dump in, lines of cleaned pages out."""

from __future__ import annotations

from pyspark.sql import SparkSession

from textloom.sources.readers import broken_pages, read_pages
from textloom.sources.writers import clean_pages, write_lines, xml_lines


def clean_dump(spark: SparkSession, source: str, target: str, closing: bool = True, quarantine: str | None = None) -> None:
    """Pages of source with their own id, title and text, templates stripped and words cleaned, as lines in target.

    Other tags are left out. Broken pages give what can be recovered of them; quarantine: a folder for the broken pages themselves
    (Parquet: problem, raw, file, id, title, text). closing: with the end tags of fields.
    """
    write_lines(xml_lines(clean_pages(read_pages(spark, source)), closing), target)
    if quarantine is not None:
        broken_pages(spark, source).write.parquet(quarantine)
