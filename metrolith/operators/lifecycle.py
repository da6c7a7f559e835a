"""Lifecycles of things that snapshots or readings show: opened, changed, gone, returned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_snapshot(held: DataFrame, snapshot: DataFrame, seen_at: Column, key: str = "source_id") -> DataFrame:
    """Events after a full snapshot, with what happened to each.

    held: key, content_hash, observed_lo, observed_hi, active, updated_at; snapshot: key, content_hash. Events not held
    open; those missing close at seen_at; those that return open again with their first bound. updated_at moves when
    the content changed, or the event was not active.
    """
    s = snapshot.select(key, F.col("content_hash").alias("new_hash")).dropDuplicates([key])
    m = held.join(s, key, "full")
    inside, known = F.col("new_hash").isNotNull(), F.col("active").isNotNull()
    same = (F.col("content_hash") == F.col("new_hash")) & F.col("active")
    state = F.when(inside & ~known, "new").when(inside & same, "unchanged").when(inside, "changed").when(F.col("active"), "gone").otherwise("past")
    return m.select(
        key, F.coalesce("new_hash", "content_hash").alias("content_hash"),
        F.when(known, F.col("observed_lo")).otherwise(seen_at).alias("observed_lo"),
        F.when(inside, F.lit(None)).when(F.col("active"), seen_at).otherwise(F.col("observed_hi")).cast("timestamp_ntz").alias("observed_hi"),
        inside.alias("active"),
        F.when(inside & same, F.col("updated_at")).when(inside | F.col("active"), seen_at).otherwise(F.col("updated_at")).alias("updated_at"),
        state.alias("state"),
    )


def spells(snapshots: DataFrame, key: Sequence[str], seen_at: str) -> DataFrame:
    """Runs of consecutive snapshots that show a key: islands over the numbered snapshots; a run's end is the first
    snapshot without it, or null if it shows to the last."""
    times = snapshots.select(F.col(seen_at)).distinct().withColumn("_n", F.row_number().over(Window.orderBy(seen_at)))
    ends = times.select((F.col("_n") - 1).alias("_last"), F.col(seen_at).alias("closed_at"))
    s = snapshots.select(*key, seen_at).distinct().join(F.broadcast(times), seen_at)  # one row for each snapshot
    island = F.col("_n") - F.row_number().over(Window.partitionBy(*key).orderBy("_n"))
    runs = s.withColumn("_island", island).groupBy(*key, "_island").agg(F.min(seen_at).alias("opened_at"), F.max(seen_at).alias("last_seen"), F.count("*").alias("n_seen"), F.max("_n").alias("_last"))
    return runs.join(F.broadcast(ends), "_last", "left").drop("_last", "_island")


def lifecycles(snapshots: DataFrame, key: Sequence[str], seen_at: str, content: str) -> DataFrame:
    """What merging all snapshots in turn ends with: one row for each key, its observed range from the first sight to the
    end of the last run, whether it is active, how often it returned, and when it last changed or came back."""
    runs = spells(snapshots, key, seen_at)
    w = Window.partitionBy(*key).orderBy(seen_at)
    changes = snapshots.withColumn("_changed", F.coalesce(F.col(content) != F.lag(content).over(w), F.lit(True)))
    changed = changes.where("_changed").groupBy(*key).agg(F.max(seen_at).alias("content_at"))
    r = runs.groupBy(*key).agg(F.min("opened_at").alias("observed_lo"), F.max_by("closed_at", "opened_at").alias("observed_hi"), (F.count("*") - 1).alias("returns"), F.max("opened_at").alias("_opened"))
    r = r.join(changed, list(key))
    return r.select(*key, "observed_lo", "observed_hi", F.col("observed_hi").isNull().alias("active"), "returns", F.greatest("_opened", "content_at", F.coalesce("observed_hi", "content_at")).alias("updated_at"))


def value_intervals(readings: DataFrame, key: Sequence[str], at: str, value: str, tie: str) -> DataFrame:
    """Intervals of one value: each starts where the value differs from the reading before and ends at the next change;
    null values close an interval and open none."""
    w = Window.partitionBy(*key).orderBy(at, tie)
    c = readings.withColumn("_new", ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).where("_new")
    return c.withColumn("until", F.lead(at).over(w)).where(F.col(value).isNotNull()).select(*key, F.col(value), F.col(at).alias("since"), "until")


def open_episodes(weeks: DataFrame, key: Sequence[str], week: str, amount: str) -> DataFrame:
    """The episode that the latest week is in, by key: how far back the amount has been above zero without a break,
    and whether it reaches the first week read, so that its start is a lower bound."""
    w = Window.partitionBy(*key).orderBy(week)
    n = weeks.withColumn("_n", F.row_number().over(w))
    last = n.groupBy(*key).agg(F.max("_n").alias("_last"), F.max(F.when(F.col(amount) <= 0, F.col("_n"))).alias("_dry"))
    inside = n.join(last, list(key)).where(F.col("_n") > F.coalesce("_dry", F.lit(0)))
    return inside.groupBy(*key).agg(F.min(week).alias("since"), F.max(week).alias("latest"), F.count("*").alias("weeks"), F.max_by(amount, week).alias("amount"), F.max(amount).alias("peak"), (F.min("_n") == 1).alias("since_is_lower_bound"))


def quiet_lifecycles(reports: DataFrame, key: str, at: str, size: str, now: Column, quiet_days: Sequence[tuple[float, int]], default_days: int) -> DataFrame:
    """Events known from reports alone: open until they have been quiet for as many days as their greatest size asks.

    quiet_days: (least size, days), tried from the largest size down.
    """
    days = F.lit(default_days)
    for least, n in sorted(quiet_days):
        days = F.when(F.col("peak") >= least, n).otherwise(days)
    e = reports.groupBy(key).agg(F.min(at).alias("opened_at"), F.max(at).alias("last_at"), F.max(size).alias("peak"), F.count("*").alias("reports"))
    e = e.withColumn("quiet_days", days).withColumn("closes_at", F.expr(f"last_at + make_dt_interval(quiet_days)"))
    return e.withColumn("is_open", F.col("closes_at") > now)
