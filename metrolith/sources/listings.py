"""Links and files listed in HTML pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def links(pages: DataFrame, key: str, html: str, pattern: str = r'<a href="(/[^"]*)"') -> DataFrame:
    """(key, href): every link of every page, by built-in regular expressions."""
    return pages.select(key, F.explode(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))).alias("href"))


def listed_files(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, file, modified, size) of a server's directory listing: name, time and size on one line each."""
    row = F.explode(F.split(html, "\n"))
    pattern = r'href="([^"/?][^"]*)".*?(\d{4}-\d{2}-\d{2} \d{2}:\d{2})\s+([0-9.]+)([KMG]?)'
    lines = pages.select(key, row.alias("line")).where(F.col("line").rlike(pattern))
    part = lambda i: F.regexp_extract("line", pattern, i)
    scale = F.when(part(4) == "K", 1024).when(part(4) == "M", 1024**2).when(part(4) == "G", 1024**3).otherwise(1)
    return lines.select(key, part(1).alias("file"), F.to_timestamp_ntz(part(2), F.lit("yyyy-MM-dd HH:mm")).alias("modified"), (part(3).cast("double") * scale).cast("long").alias("size"))
