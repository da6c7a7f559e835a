"""Whether sources and builds are fresh, and which are due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_status(sources: DataFrame, fetches: DataFrame, now: Column) -> DataFrame:
    """The state of every scheduled source and stream at `now`.

    sources: source, schedule_s, stale_s (seconds; streams have stale_s and no schedule). fetches: source, started_at, id,
    ok (null while running), error. A scheduled source is fresh up to its schedule and a grace (a quarter of it, 15
    minutes at least), late up to three schedules and the grace, then stale; a stream is fresh up to stale_s. A source
    that never succeeded is "never". failures counts those since the last success. One aggregation, one join.
    """
    at = F.struct("started_at", "id")
    f = fetches.groupBy("source").agg(
        F.max(F.when(F.col("ok"), at)).alias("good"), F.max(F.when(F.col("ok").isNotNull(), F.struct("started_at", "id", "ok"))).alias("tried"))
    failed = fetches.join(f.select("source", "good"), "source").where(
        (F.col("ok") == F.lit(False)) & (F.col("started_at") > F.coalesce(F.col("good.started_at"), F.lit("0001-01-01").cast("timestamp_ntz"))))
    failed = failed.groupBy("source").agg(F.count("*").alias("failures"), F.max_by("error", at).alias("last_error"))
    s = sources.where("schedule_s is not null or stale_s is not null").join(f, "source", "left").join(failed, "source", "left")
    s = s.withColumn("last_ok_at", F.col("good.started_at")).withColumn("age_s", F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_ok_at").cast("timestamp")))
    grace = F.greatest(F.col("schedule_s") / 4, F.lit(900.0))
    state = (
        F.when(F.col("last_ok_at").isNull(), "never")
        .when(F.col("stale_s").isNotNull(), F.when(F.col("age_s") < F.col("stale_s"), "fresh").otherwise("stale"))
        .when(F.col("age_s") < F.col("schedule_s") + grace, "fresh").when(F.col("age_s") < 3 * F.col("schedule_s") + grace, "late").otherwise("stale"))
    return s.select(
        "source", "last_ok_at", "age_s", state.alias("state"), F.col("tried.started_at").alias("last_try_at"), F.col("tried.ok").alias("last_try_ok"),
        F.coalesce("failures", F.lit(0)).alias("failures"), "last_error")


def due(status: DataFrame, sources: DataFrame, now: Column, retry_s: int = 900) -> DataFrame:
    """Sources to run: a schedule has passed since the last success, and a retry interval since the last attempt."""
    since = lambda c: F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col(c).cast("timestamp"))
    s = status.join(sources.select("source", "schedule_s"), "source").where("schedule_s is not null")
    ready = (F.col("last_ok_at").isNull() | (since("last_ok_at") >= F.col("schedule_s"))) & (F.col("last_try_at").isNull() | (since("last_try_at") >= F.least("schedule_s", F.lit(retry_s))))
    return s.where(ready).select("source")


def pending_marks(marks: DataFrame, covered: DataFrame) -> DataFrame:
    """What is still to be built: marks (build, marker, counter) less those that a successful run saw at its start.

    A marker whose counter has moved on since is pending still.
    """
    seen = covered.groupBy("build", "marker").agg(F.max("counter").alias("seen"))
    return marks.join(seen, ["build", "marker"], "left").where(F.col("seen").isNull() | (F.col("counter") > F.col("seen"))).select("build", "marker", "counter")
