"""Scans of the kinds of files that city data comes in, with Spark's own readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_checked(spark: SparkSession, path: str, schema: str | T.StructType, box: tuple[str, str, float, float, float, float] | None = None, **options) -> DataFrame:
    """A CSV whose header has to name the schema's columns, and whose rows have to fit it; optionally within a box
    (x column, y column, x0, y0, x1, y1)."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    header = [c.strip() for c in spark.read.text(path).first()[0].split(options.get("sep", ","))]
    missing = [f.name for f in schema.fields if f.name not in header]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    every = T.StructType([schema[h] if h in schema.names else T.StructField(h, T.StringType()) for h in header])
    df = spark.read.options(header=True, mode="FAILFAST", enforceSchema=False, **options).schema(every).csv(path).select(*schema.names)
    if box:
        x, y, x0, y0, x1, y1 = box
        df = df.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))
    return df


def gtfs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """routes, trips, shapes with their points in order, and stops with the sorted routes that serve them, of an unpacked feed."""
    read = lambda n: spark.read.options(header=True).csv(f"{folder}/{n}.txt")
    routes, trips = read("routes"), read("trips")
    at = F.struct(F.col("shape_pt_sequence").cast("int").alias("i"), F.col("shape_pt_lon").cast("double").alias("x"), F.col("shape_pt_lat").cast("double").alias("y"))
    shapes = read("shapes").groupBy("shape_id").agg(F.array_sort(F.collect_list(at)).alias("p"))
    shapes = shapes.select("shape_id", F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))
    served = read("stop_times").select("trip_id", "stop_id").distinct().join(trips.select("trip_id", "route_id"), "trip_id")
    served = served.groupBy("stop_id").agg(F.array_sort(F.collect_set("route_id")).alias("routes"))
    stops = read("stops").join(served, "stop_id", "left").withColumn("routes", F.coalesce("routes", F.array().cast("array<string>")))
    return {"routes": routes, "trips": trips, "shapes": shapes, "stops": stops}


def nested_json(raw: DataFrame, column: str, schema: str, path: Sequence[str]) -> DataFrame:
    """Rows of arrays in JSON texts: the text is parsed once by the schema, and each array on the path is taken apart.

    Names on the path are field names; fields around an array stay as columns.
    """
    df = raw.withColumn("_j", F.from_json(column, schema))
    keep = [c for c in raw.columns if c != column]
    at = "_j"
    for i, name in enumerate(path):
        outer = [f for f in df.schema[at].dataType.names if f != name]
        df = df.select(*keep, *[F.col(f"{at}.{f}").alias(f) for f in outer], F.explode(F.col(f"{at}.{name}")).alias(f"_{i}"))
        keep, at = keep + outer, f"_{i}"
    inner = df.schema[at].dataType
    return df.select(*keep, *([F.col(f"{at}.*")] if isinstance(inner, T.StructType) else [F.col(at).alias(path[-1])]))


def kml_placemarks(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, ring) of each polygon placemark; a ring that isn't closed is closed, one of under 4 points dropped."""
    schema = "name string, description string, Polygon struct<outerBoundaryIs:struct<LinearRing:struct<coordinates:string>>>"
    df = spark.read.options(rowTag="Placemark").schema(schema).format("xml").load(path)
    parts = F.filter(F.split(F.trim("Polygon.outerBoundaryIs.LinearRing.coordinates"), r"\s+"), lambda p: p != "")
    ring = F.transform(parts, lambda p: F.struct(F.get(F.split(p, ","), F.lit(0)).cast("double").alias("x"), F.get(F.split(p, ","), F.lit(1)).cast("double").alias("y")))
    df = df.select("name", "description", ring.alias("ring")).where("ring is not null")
    closed = F.when(F.element_at("ring", 1) != F.element_at("ring", -1), F.concat("ring", F.slice("ring", 1, 1))).otherwise(F.col("ring"))
    return df.where("size(ring) > 0").withColumn("ring", closed).where("size(ring) >= 4")


def gpx_points(spark: SparkSession, path: str) -> DataFrame:
    """(epoch, lat, lon) of the track points, in time order."""
    df = spark.read.options(rowTag="trkpt").schema("_lat double, _lon double, time timestamp").format("xml").load(path)
    return df.select(F.unix_millis("time").alias("epoch_ms"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon")).orderBy("epoch_ms")


def fixed_columns(spark: SparkSession, path: str, columns: Sequence[tuple[str, int, int, str]], only: str | None = None) -> DataFrame:
    """Text tables by position: (name, first character, length, type); lines that don't match `only` are left out, and
    fields that don't parse are null."""
    t = spark.read.text(path)
    if only:
        t = t.where(F.col("value").rlike(only))
    return t.select(*[F.expr(f"try_cast(nullif(trim(substring(value, {at}, {n})), '') as {kind})").alias(name) for name, at, n, kind in columns])


def tagged(ways: DataFrame, consumers: dict[str, Column]) -> DataFrame:
    """Each way with its one owner: the first consumer whose tag filter takes it, null if none does."""
    owner = F.lit(None).cast("string")
    for name, takes in reversed(consumers.items()):
        owner = F.when(F.coalesce(takes, F.lit(False)), F.lit(name)).otherwise(owner)
    return ways.withColumn("owner", owner)


def not_yet_read(files: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Backfill: files that weren't read before, oldest first."""
    return files.join(seen.select(key), key, "left_anti").orderBy(key)


def decode_polyline(text: Column, precision: int = 5) -> Column:
    """The points of an encoded polyline, by built-in functions: characters to chunks, chunks to signed steps, sums to points."""
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    codes = F.transform(places, lambda i: F.ascii(F.substring(text, i, F.lit(1))) - 63)
    state = F.aggregate(
        codes,
        F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("bigint").alias("v"), F.lit(0).alias("s")),
        lambda a, c: F.struct(
            F.when(c < 32, F.concat(a["out"], F.array(a["v"] + F.call_function("shiftleft", c.bitwiseAND(F.lit(31)).cast("bigint"), a["s"])))).otherwise(a["out"]).alias("out"),
            F.when(c < 32, F.lit(0).cast("bigint")).otherwise(a["v"] + F.call_function("shiftleft", c.bitwiseAND(F.lit(31)).cast("bigint"), a["s"])).alias("v"),
            F.when(c < 32, 0).otherwise(a["s"] + 5).alias("s")))
    steps = F.transform(state["out"], lambda v: F.when(v % 2 == 1, -F.floor(v / 2) - 1).otherwise(F.floor(v / 2)))
    n = F.floor(F.size(steps) / 2).cast("int")
    total = lambda k, i: F.aggregate(F.sequence(F.lit(0), i), F.lit(0).cast("bigint"), lambda a, j: a + F.get(steps, 2 * j + k)) / 10**precision
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(total(1, i).alias("x"), total(0, i).alias("y")))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
