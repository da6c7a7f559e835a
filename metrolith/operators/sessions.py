"""Runs, islands and sessions in ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(a: Column, b: Column) -> Column:
    """b - a in seconds, with microseconds."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return (us(b) - us(a)) / 1e6


def with_sessions(df: DataFrame, keys: Sequence[str], at: str, tie: str, gap_s: float) -> DataFrame:
    """Rows with a session number by key: a new one after a gap of more than gap_s."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    new = F.coalesce(seconds(F.lag(at).over(w), F.col(at)) > gap_s, F.lit(True))
    return df.withColumn("_new", new.cast("int")).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def islands(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Runs of consecutive integers by key: first, last, length."""
    i = F.col(number) - F.row_number().over(Window.partitionBy(*keys).orderBy(number))
    d = df.select(*keys, number).distinct().withColumn("_i", i)
    return d.groupBy(*keys, "_i").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("n")).drop("_i")


def slow_stops(df: DataFrame, key: Sequence[str], at: str, speed: str, below: float, least_s: float) -> DataFrame:
    """Stops: consecutive rows slower than `below` that last at least `least_s` seconds."""
    w = Window.partitionBy(*key).orderBy(at)
    d = df.withColumn("_slow", F.col(speed) < below)
    d = d.withColumn("_edge", F.coalesce((F.col("_slow") != F.lag("_slow").over(w)).cast("int"), F.lit(1)))
    d = d.withColumn("_run", F.sum("_edge").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_slow")
    s = d.groupBy(*key, "_run").agg(F.min(at).alias("stopped_at"), F.max(at).alias("left_at"), F.count("*").alias("fixes"))
    return s.withColumn("stop_s", seconds(F.col("stopped_at"), F.col("left_at"))).where(F.col("stop_s") >= least_s).drop("_run")


def pack_hours(df: DataFrame, key: Sequence[str], at: str, value: str, least: int = 60) -> DataFrame:
    """Hours that have all their minutes, as arrays in minute order; the last value of a minute counts."""
    m = df.groupBy(*key, F.date_trunc("minute", at).alias("minute")).agg(F.max_by(value, F.struct(at, value)).alias("v"))
    h = m.groupBy(*key, F.date_trunc("hour", "minute").alias("hour")).agg(F.array_sort(F.collect_list(F.struct("minute", "v"))).alias("vs"))
    return h.where(F.size("vs") >= least).select(*key, "hour", F.transform("vs", lambda x: x["v"]).alias("values"))


def split_at(df: DataFrame, keys: Sequence[str], order: str, cut: Column) -> DataFrame:
    """Lines split at marked vertices: a running sum of the marks numbers the pieces; a cut vertex ends one piece and
    starts the next, so it stands in both. The first and last vertices cut nothing."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_last", F.max(order).over(Window.partitionBy(*keys))).withColumn("_first", F.min(order).over(Window.partitionBy(*keys)))
    d = d.withColumn("_cut", (cut & (F.col(order) > F.col("_first")) & (F.col(order) < F.col("_last"))).cast("int"))
    d = d.withColumn("piece", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    again = d.where("_cut = 1").withColumn("piece", F.col("piece") - 1)
    return d.unionByName(again).drop("_cut", "_last", "_first")
