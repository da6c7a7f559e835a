"""Vehicle fixes: steps, route votes, map matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrolith.operators.sessions import seconds

# Thresholds of steps and of the vote.
GAP_S, STILL_M, STILL_BACK_M, ALONG_MAX_MS = 150.0, 15.0, 30.0, 40.0
MIN_FIXES, MIN_SHARE, MIN_MARGIN = 10, 0.55, 0.15


def steps(fixes: DataFrame, vehicle: str, at: str, tie: str, x: str, y: str, m: str | None = None, shape: str | None = None,
          gap_s: float = GAP_S, still_m: float = STILL_M, along_ms: float = ALONG_MAX_MS) -> DataFrame:
    """The step from each fix to the vehicle's next: gap, still, along or straight, and its speed in m/s.

    m is the place along a shape; without it steps are gap, still or straight.
    """
    w = Window.partitionBy(vehicle).orderBy(at, tie)
    d = fixes.withColumn("dt", seconds(F.col(at), F.lead(at).over(w)))
    d = d.withColumn("c", F.hypot(F.lead(x).over(w) - F.col(x), F.lead(y).over(w) - F.col(y)))
    dm = F.when(F.lead(shape).over(w) == F.col(shape), F.lead(m).over(w) - F.col(m)) if m and shape else F.lit(None).cast("double")
    d = d.withColumn("dm", dm)
    along = F.col("dm").isNotNull() & (F.col("dt") > 0) & F.col("dm").between(0, 3 * F.col("c") + 100) & (F.col("dm") <= along_ms * F.col("dt"))
    still = (F.col("c") < still_m) | F.coalesce((F.col("dm") >= -STILL_BACK_M) & (F.col("dm") < 0), F.lit(False))
    kind = F.when(F.col("dt").isNull(), None).when(F.col("dt") > gap_s, "gap").when(still, "still").when(along, "along").otherwise("straight")
    speed = F.when(F.col("step") == "still", 0.0).when(F.col("step") == "along", F.col("dm") / F.col("dt")).when((F.col("step") == "straight") & (F.col("dt") > 0), F.col("c") / F.col("dt"))
    return d.withColumn("step", kind).withColumn("step_speed_ms", speed)


def vote(hits: DataFrame, trip: str, candidate: str, fixes: DataFrame, min_fixes: int = MIN_FIXES, min_share: float = MIN_SHARE, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The candidate that most of a trip's fixes are near, if it leads clearly.

    hits: a row for each (trip, candidate) with its `hits`; fixes: each trip's `fixes`. Ties go to the lower candidate.
    """
    r = hits.join(fixes, trip).withColumn("share", F.col("hits") / F.col("fixes"))
    w = Window.partitionBy(trip).orderBy(F.desc("hits"), candidate)
    r = r.withColumn("rank", F.row_number().over(w)).withColumn("runner_up", F.lead(candidate).over(w)).withColumn("runner_up_share", F.lead("share").over(w))
    r = r.where((F.col("rank") == 1) & (F.col("fixes") >= min_fixes) & (F.col("share") >= min_share) & (F.col("share") - F.coalesce("runner_up_share", F.lit(0.0)) >= min_margin))
    return r.select(trip, candidate, F.round("share", 3).alias("share"), "runner_up", F.round("runner_up_share", 3).alias("runner_up_share"))


def service_date(at: Column, zone: str) -> Column:
    """The local date of a UTC time."""
    return F.to_date(F.from_utc_timestamp(at, zone))


def playback(steps_: DataFrame, vehicle: str, at: str, until: Column, window_s: float, newest_s: float) -> DataFrame:
    """Steps that overlap [until - window, until], and each vehicle's newest fix if it is no older than newest_s."""
    at_s, until_s = F.unix_micros(F.col(at).cast("timestamp")) / 1e6, F.unix_micros(until.cast("timestamp")) / 1e6
    d = steps_.where(at_s <= until_s)
    newest = F.row_number().over(Window.partitionBy(vehicle).orderBy(F.desc(at))) == 1
    d = d.withColumn("newest", newest)
    overlaps = F.coalesce(at_s + F.col("dt") >= until_s - window_s, F.lit(False))
    return d.where(overlaps | (F.col("newest") & (at_s >= until_s - newest_s)))


def project(px: np.ndarray, py: np.ndarray, xs: np.ndarray, ys: np.ndarray, ms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point, (distance along, distance off) at its nearest place on every segment: point x segment."""
    dx, dy = np.diff(xs), np.diff(ys)
    length2 = np.maximum(dx * dx + dy * dy, 1e-12)
    t = np.clip(((px[:, None] - xs[:-1]) * dx + (py[:, None] - ys[:-1]) * dy) / length2, 0, 1)
    off = np.hypot(px[:, None] - (xs[:-1] + t * dx), py[:, None] - (ys[:-1] + t * dy))
    return ms[:-1] + t * np.sqrt(length2), off


MATCHED = "vehicle string, ts double, shape string, m double, off double"


def map_match(fixes: DataFrame, shapes: pd.DataFrame, near_m: float = 40.0, gap_s: float = GAP_S, back_m: float = 60.0, ahead_m: float = 60.0,
              ahead_ms: float = 30.0, switch_cost: float = 25.0, free_back_m: float = 30.0) -> DataFrame:
    """Each vehicle's fixes (vehicle, ts, x, y) placed on shapes in time order.

    The cheapest place wins: the distance off the shape, a cost for leaving the shape of the fix before, and the metres
    gone back beyond a free few. After a gap the chain starts anew; within one, places on the same shape are looked for
    in a window that grows with the time passed. shapes (shape, x, y in order) are few: they go to every task.
    """
    lines = {}
    for name, g in shapes.groupby("shape", sort=True):
        xs, ys = g["x"].to_numpy(float), g["y"].to_numpy(float)
        lines[name] = (xs, ys, np.concatenate([[0], np.cumsum(np.hypot(np.diff(xs), np.diff(ys)))]))

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "x", "y"])
        out, last = [], None
        for r in pdf.itertuples(index=False):
            on = last is not None and last[1] is not None and r.ts - last[0] <= gap_s
            best = None
            for name, (xs, ys, ms) in lines.items():
                along, off = project(np.array([r.x]), np.array([r.y]), xs, ys, ms)
                along, off = along[0], off[0]
                cost = off.copy()
                if on and name == last[1]:
                    inside = (along >= last[2] - back_m) & (along <= last[2] + ahead_ms * (r.ts - last[0]) + ahead_m)
                    cost = np.where(inside, cost + np.maximum(last[2] - along - free_back_m, 0), np.inf)
                elif on:
                    cost = cost + switch_cost
                cost = np.where(off <= near_m, cost, np.inf)
                i = int(np.argmin(cost))
                if np.isfinite(cost[i]) and (best is None or (round(cost[i], 6), name) < best[0]):
                    best = ((round(cost[i], 6), name), name, float(along[i]), float(off[i]))
            place = best[1:] if best else (None, None, None)
            out.append((r.vehicle, r.ts, *place))
            last = (r.ts, place[0], place[1])
        return pd.DataFrame(out, columns=["vehicle", "ts", "shape", "m", "off"])

    return fixes.select("vehicle", "ts", "x", "y").groupBy("vehicle").applyInPandas(chain, MATCHED)


def provisional_routes(fixes: DataFrame, vehicle: str, trip: str, at: str, step_in: str, near: str, needed: int = 4) -> DataFrame:
    """Fixes with a route for trips that no source names: from the fix on at which the last `needed` fixes that came along
    a shape were each near one route alone, and the same. A gap starts the count anew.

    near: an array of the routes near a fix; step_in: the kind of the step that led to it.
    """
    w = Window.partitionBy(vehicle, trip).orderBy(at)
    f = fixes.withColumn("_run", F.sum((F.coalesce(F.col(step_in), F.lit("")) == "gap").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    one = F.when(F.size(near) == 1, F.get(near, F.lit(0)))
    last = Window.partitionBy(vehicle, trip, "_run").orderBy(at).rowsBetween(1 - needed, 0)
    along = f.where(F.col(step_in) == "along").withColumn("_one", one)
    along = along.withColumn("_sure", (F.count("_one").over(last) == needed) & (F.min("_one").over(last) == F.max("_one").over(last)))
    found = along.where("_sure").groupBy(vehicle, trip, "_run").agg(F.min_by("_one", at).alias("_route"), F.min(at).alias("_from"))
    out = f.join(found, [vehicle, trip, "_run"], "left").withColumn("route", F.when(F.col(at) >= F.col("_from"), F.col("_route")))
    return out.drop("_run", "_route", "_from")


def reprocess(rows: DataFrame, changed: DataFrame, key: str, at: str, again) -> DataFrame:
    """Rows after a dimension changed: of each changed key (key, since) the rows from `since` on are made anew by `again`,
    which gets them in one table; all others stay."""
    c = changed.groupBy(F.col(key).alias("_key")).agg(F.min("since").alias("_since"))
    j = rows.join(c, rows[key] == F.col("_key"), "left")
    redo = F.col("_since").isNotNull() & (F.col(at) >= F.col("_since"))
    return j.where(~redo).drop("_key", "_since").unionByName(again(j.where(redo).drop("_key", "_since")))
