"""Rules by date, and states that readings set and silences end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrolith.operators.sessions import seconds

# Levels from the strongest to the weakest, and weekday codes by number (Monday first).
LEVELS = ("emergency", "order", "notice", "season", "default")
WEEKDAYS = ("MO", "TU", "WE", "TH", "FR", "SA", "SU")

RULE = (
    "id string, position int, level string, value string, starts timestamp, ends timestamp, yearly_from int, yearly_to int, "
    "weekdays array<int>, monthdays array<int>, minute_from int, minute_to int"
)


def _local(day: Column, minutes: Column, zone: str) -> Column:
    """A local day plus minutes after its midnight, as UTC; times of day are wall clock times, so days keep their length."""
    d = F.date_add(day, F.floor(minutes / 1440).cast("int"))
    wall = F.timestamp_seconds(F.unix_date(d).cast("long") * 86400 + (minutes % 1440) * 60)
    return F.to_utc_timestamp(wall, zone)


def occurrences(rules: DataFrame, lo: Column, hi: Column, zone: str) -> DataFrame:
    """Every interval within [lo, hi) in which a rule is in force: (id, position, level, value, a, b), in UTC.

    A rule recurs by month and day (yearly_from..yearly_to as month * 100 + day, over the new year if that is earlier), by
    weekday (0 is Monday), by day of the month, or by minutes of the day (minute_to may pass 1440, into the next day). An
    occurrence counts if it starts within the rule's dates. A rule that doesn't recur is in force throughout its dates.
    """
    recurs = F.expr("yearly_from is not null or weekdays is not null or monthdays is not null or minute_from is not null")
    keep = ["id", "position", "level", "value"]
    whole = rules.where(~recurs).select(*keep, F.greatest(lo, "starts").alias("a"), F.least(hi, "ends").alias("b"))
    local = lambda t: F.to_date(F.from_utc_timestamp(t, zone))
    r = rules.where(recurs)
    first = F.greatest(F.date_sub(local(lo), 2), local(F.col("starts")))
    last = F.least(local(hi), local(F.col("ends")))
    r = r.where(first <= last).withColumn("day", F.explode(F.sequence(first, last)))
    md = F.month("day") * 100 + F.dayofmonth("day")
    by_year = F.when(F.col("yearly_from").isNull(), True).when(F.col("yearly_from") <= F.col("yearly_to"), md.between(F.col("yearly_from"), F.col("yearly_to"))).otherwise((md >= F.col("yearly_from")) | (md <= F.col("yearly_to")))
    by_week = F.col("weekdays").isNull() | F.array_contains("weekdays", F.weekday("day"))
    by_month = F.col("monthdays").isNull() | F.array_contains("monthdays", F.dayofmonth("day"))
    r = r.where(by_year & by_week & by_month)
    r = r.withColumn("from", _local(F.col("day"), F.coalesce("minute_from", F.lit(0)), zone)).withColumn("to", _local(F.col("day"), F.coalesce("minute_to", F.lit(1440)), zone))
    r = r.where((F.col("starts").isNull() | (F.col("starts") <= F.col("from"))) & (F.col("ends").isNull() | (F.col("from") < F.col("ends"))))
    r = r.select(*keep, F.greatest(lo, "from").alias("a"), F.least(hi, F.col("to"), F.col("ends")).alias("b"))
    return whole.union(r).where("a < b")


def timeline(rules: DataFrame, lo: Column, hi: Column, zone: str = "UTC", keys: Sequence[str] = ()) -> DataFrame:
    """Spans that cover [lo, hi) end to end, each with the winning rule, or none: the strongest level, then the latest
    listed. Neighbouring spans of one rule are joined.

    Occurrences become +1 and -1 events; each rule's count runs over the cuts of its key, and the best live rule wins.
    """
    o = occurrences(rules, lo, hi, zone)
    if keys:
        o = o.join(rules.select("id", *keys), "id")
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level")).cast("int")
    o = o.withColumn("strength", F.struct((-rank).alias("r"), F.col("position").alias("p"), F.col("id").alias("id"), F.col("value").alias("value")))
    edges = o.select(*keys, F.col("a").alias("t")).union(o.select(*keys, F.col("b").alias("t")))
    ends = (rules.select(*keys).distinct() if keys else rules.sparkSession.range(1).select()).select(*keys, F.explode(F.array(lo, hi)).alias("t"))
    cuts = edges.union(ends).distinct()
    w = Window.partitionBy(*keys).orderBy("t")
    parts = cuts.withColumn("until", F.lead("t").over(w)).where("until is not null")
    on = (parts["t"] < o["b"]) & (parts["until"] > o["a"])
    for k in keys:
        on = on & parts[k].eqNullSafe(o[k])
    live = parts.join(o.select(*[o[k] for k in keys], "a", "b", "strength"), on, "left").groupBy(*[parts[k] for k in keys], parts["t"], parts["until"]).agg(F.max("strength").alias("best"))
    live = live.withColumn("_new", (~F.col("best.id").eqNullSafe(F.lag("best.id").over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    live = live.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = live.groupBy(*keys, "_run").agg(F.min("t").alias("since"), F.max("until").alias("until"), F.first("best.id").alias("rule"), F.first("best.value").alias("value"))
    return spans.drop("_run")


def state_at(rules: DataFrame, when: Column, zone: str = "UTC") -> DataFrame:
    """One row: the winning rule and its value at a moment, nulls if none is in force."""
    o = occurrences(rules, when, when + F.expr("interval 1 microsecond"), zone)
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    return o.agg(F.max(F.struct((-rank).alias("r"), "position", "id", "value")).alias("b")).select(F.col("b.id").alias("rule"), F.col("b.value").alias("value"))


def gauge_state(flow: Column, stage: Column, flow_on: float, stage_on: float, stage_off: float, slack: float = 0.0) -> Column:
    """on, off, or null between the thresholds and without a reading: the state before holds."""
    return (
        F.when(flow.isNotNull(), F.when(flow >= flow_on, "on").otherwise("off")).when(stage.isNull(), None)
        .when(stage >= stage_on, "on").when(stage <= stage_off + slack, "off"))


def gauge_spans(readings: DataFrame, key: str, at: str, tie: str, state: Column, now: Column, silence_s: float) -> DataFrame:
    """Spans of on, off and unknown by gauge as of `now`; the last has no end.

    A reading between the thresholds keeps the state before it. A silence longer than silence_s is unknown from
    silence_s after its first end; readings that say nothing do not end it. Nothing is claimed before the first on or off.
    """
    r = readings.where(F.col(at) <= now).withColumn("_s", state)
    w = Window.partitionBy(key).orderBy(at, tie)
    known = F.max(F.col("_s").isNotNull()).over(w.rowsBetween(Window.unboundedPreceding, 0))
    r = r.withColumn("_known", known).where("_known").withColumn("_next", F.lead(at).over(w))
    silent = seconds(F.col(at), F.coalesce("_next", now))
    broken = F.when(F.col("_next").isNull(), silent >= silence_s).otherwise(silent > silence_s)
    said = r.select(key, F.col(at).alias("t"), F.lit(1).alias("k"), F.col(tie).alias("_tie"), F.col("_s").alias("s")).where("s is not null")
    stop = r.where(broken).select(key, (F.col(at) + F.expr(f"interval {silence_s:.0f} seconds")).alias("t"), F.lit(0).alias("k"), F.col(tie).alias("_tie"), F.lit("unknown").alias("s"))
    e = said.union(stop)
    v = Window.partitionBy(key).orderBy("t", "k", "_tie")
    e = e.withColumn("_before", F.lag("s").over(v)).where("_before is null or s <> _before")
    return e.select(key, F.col("s").alias("state"), F.col("t").alias("since"), F.lead("t").over(v).alias("until"))
