"""Views over matched sources: lanes by priority, cross-sections, summaries of places, states of paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrolith.operators import spatial
from metrolith.operators.latest import distinct_on, latest_per_key

#: Which source is asked first, by class of road, and which sources are trusted there.
PRIORITY = {
    "state": ("hpms", "osm", "city", "regional"), "arterial": ("city", "osm", "regional", "hpms"),
    "local": ("osm", "regional"), "other": ("osm", "city", "regional", "hpms"),
}
TRUSTED, TRUSTED_ELSEWHERE = {"state": ("hpms", "osm")}, ("city", "osm")
DEFAULT_CONFIDENCE, SINGLE_LANE_FACTOR = 0.2, 0.5


def road_class(functional: Column, route_system: Column, arterial_source: Column) -> Column:
    arterial = functional.isin("Principal Arterial", "Minor Arterial")
    return (
        F.when(functional.isin("Interstate", "Ramp") | (arterial & route_system.isin("SH", "US", "IN")), "state")
        .when(arterial | arterial_source.isNotNull(), "arterial").when(functional.isin("Collector", "Local"), "local").otherwise("other"))


def resolve_lanes(segments: DataFrame, readings: DataFrame) -> DataFrame:
    """One row for each segment: through lanes, where they come from, confidence, conflict and all candidates.

    segments: segment, functional, one_way, route_system. readings: segment, source, through, single_lane, share,
    confidence, source_id. Each source's best match by share counts. The regional source's 2, mostly a default, counts only where a
    trusted source says 2 as well. Local streets without a source are taken as 1 + 1. Trusted sources and a usable
    regional source that differ by more than one lane are in conflict.
    """
    best = distinct_on(readings, ["segment", "source"], [F.desc_nulls_last("share"), F.desc_nulls_last("confidence"), F.col("source_id")])
    names = ("hpms", "city", "osm", "regional")
    sides = [F.max(F.when(F.col("source") == n, F.struct("through", "single_lane", "confidence"))).alias(n) for n in names]
    s = segments.join(best.groupBy("segment").agg(*sides), "segment", "left")
    s = s.withColumn("road_class", road_class(F.col("functional"), F.col("route_system"), F.col("city.through")))
    said = lambda of: F.array(*[F.col(f"{n}.through") for n in of])
    trusted = said(TRUSTED_ELSEWHERE)
    for cls, of in TRUSTED.items():
        trusted = F.when(F.col("road_class") == cls, said(of)).otherwise(trusted)
    s = s.withColumn("trusted", F.array_compact(trusted))
    usable = F.col("regional.through").isNotNull() & ((F.col("regional.through") != 2) | F.array_contains("trusted", 2))
    through = {n: F.col(f"{n}.through") if n != "regional" else F.when(usable, F.col("regional.through")) for n in names}
    source = F.lit(None).cast("string")
    for cls, order in PRIORITY.items():
        first = F.coalesce(*[F.when(through[n].isNotNull(), F.lit(n)) for n in order], *([F.lit("default")] if cls == "local" else []))
        source = F.when(F.col("road_class") == cls, first).otherwise(source)
    s = s.withColumn("source", source)
    pick = lambda f: F.coalesce(*[F.when(F.col("source") == n, f(n)) for n in names])
    say = F.array_compact(F.concat("trusted", F.array(through["regional"])))
    conf = pick(lambda n: F.col(f"{n}.confidence") * F.when(F.col(f"{n}.single_lane"), SINGLE_LANE_FACTOR).otherwise(1.0))
    return s.select(
        "segment", "road_class", F.when(F.col("source") == "default", F.when(F.col("one_way"), 1).otherwise(2)).otherwise(pick(lambda n: through[n])).alias("through"),
        "source", F.round(F.when(F.col("source") == "default", DEFAULT_CONFIDENCE).otherwise(conf), 4).alias("confidence"),
        F.coalesce(F.array_max(say) - F.array_min(say) > 1, F.lit(False)).alias("conflict"),
        F.array_join(F.array_compact(F.array(*[F.when(F.col(f"{n}.through").isNotNull(), F.concat(F.lit(f"{n}="), F.col(f"{n}.through"))) for n in names])), ",").alias("candidates"),
    )


def cross_sections(sides: DataFrame, key: str, left: str, right: str, flags: Sequence[str]) -> DataFrame:
    """Two sides of each segment as rows, and together: widths that agree, and flags of either side as a sorted list."""
    rows = sides.select(key, F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col(left).alias("width")), F.struct(F.lit("right").alias("side"), F.col(right).alias("width")))).alias("s"), *flags).select(key, "s.*", *flags)
    return rows.groupBy(key).agg(
        F.max("width").alias("widest"), F.bool_and(F.col("width").isNotNull()).alias("both_known"), F.bool_or(F.col("width") > 0).alias("any_side"),
        *[F.bool_or(f).alias(f) for f in flags]).withColumn("flags", F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in flags])))


def place_summary(points: DataFrame, facts: DataFrame, radius: float, cluster_radius: float) -> DataFrame:
    """Clusters of points, and what lies around their centres: nearest fact, greatest value, counts by kind."""
    c = spatial.clusters(points, "id", cluster_radius).groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("members"))
    near = spatial.radius_join(c, facts, radius).groupBy("cluster").agg(
        F.min(F.struct("d", "r_id")).alias("nearest"), F.max("r_value").alias("max_value"), F.count("*").alias("facts"), F.countDistinct("r_kind").alias("kinds"))
    return c.join(near, "cluster", "left").select("cluster", "members", "x", "y", F.col("nearest.r_id").alias("nearest_id"), F.col("nearest.d").alias("nearest_d"), "max_value", F.coalesce("facts", F.lit(0)).alias("facts"), F.coalesce("kinds", F.lit(0)).alias("kinds"))


def path_states(paths: DataFrame, reports: DataFrame, now: Column, fresh_s: float) -> DataFrame:
    """The state of each path: its newest report, if that is fresh enough, else unknown; with the days since."""
    r = latest_per_key(reports, ["path"], ["at", "report_id"], ["at", "report_id", "condition"])
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("at").cast("timestamp"))
    p = paths.join(r, "path", "left").withColumn("age_s", age)
    return p.withColumn("state", F.when(F.col("condition").isNull(), "unknown").when(F.col("age_s") > fresh_s, "outdated").otherwise(F.col("condition")))


# Growth classes of crops by how tall they stand.
GROWTH = {"corn": "tall", "sorghum": "tall", "sugar beets": "row", "potatoes": "row", "onions": "row", "wheat": "grain", "barley": "grain", "alfalfa": "hay", "grass": "hay"}


def crop_years(fields: DataFrame, key: str, first_year: int, crops: str) -> DataFrame:
    """An array of crops, one for each year, as rows; and the newest with its growth class."""
    y = fields.select(key, F.posexplode(crops).alias("i", "crop")).select(key, (F.col("i") + first_year).alias("year"), "crop")
    growth = F.create_map(*[F.lit(x) for kv in GROWTH.items() for x in kv])
    return y.withColumn("growth", F.coalesce(F.try_element_at(growth, F.lower("crop")), F.lit("other")))


def fade(seasons: Column, steps: int = 3) -> Column:
    """How much of a scar still shows after so many growing seasons."""
    return F.greatest(F.lit(0.0), (steps - seasons) / steps)


def clamped(text: Column, least: int, most: int, default: int) -> Column:
    """A number that a request gives as text, within its bounds; the default where it is none."""
    return F.least(F.greatest(F.coalesce(text.try_cast("int"), F.lit(default)), F.lit(least)), F.lit(most))
