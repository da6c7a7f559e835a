"""Networks of lines that share vertices: pieces, nodes, joints, arms, cross-sections and lists for review."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrolith.operators.sessions import split_at

# Metres of a lane, lanes where nothing is known, and the narrowest and widest road.
LANE_M, DEFAULT_LANES, NARROWEST_M, WIDEST_M = 3.3, 2, 3.0, 30.0


def pieces(vertices: DataFrame, way: str, order: str, node: str) -> DataFrame:
    """(way, piece, from_node, to_node, path): ways split at nodes that another way, or the same again, runs through."""
    shared = vertices.groupBy(node).agg((F.count("*") > 1).alias("_shared"))
    split = split_at(vertices.join(shared, node), [way], order, F.col("_shared"))
    p = split.groupBy(way, "piece").agg(F.array_sort(F.collect_list(F.struct(order, node))).alias("_p")).where("size(_p) > 1")
    at = lambda i: F.element_at("_p", i)[node]
    return p.select(way, "piece", at(1).alias("from_node"), at(-1).alias("to_node"), F.transform("_p", lambda x: x[node]).alias("path"))


def ends(pieces_: DataFrame, key: Column) -> DataFrame:
    """(node, arm, towards, side): both ends of every piece; `towards` is the next vertex from there."""
    first = F.struct(F.lit("from").alias("side"), F.col("from_node").alias("node"), F.get("path", F.lit(1)).alias("towards"))
    last = F.struct(F.lit("to").alias("side"), F.col("to_node").alias("node"), F.element_at("path", -2).alias("towards"))
    return pieces_.select(key.alias("arm"), F.explode(F.array(first, last)).alias("e")).select("e.node", "arm", "e.towards", "e.side")


def nodes(ends_: DataFrame) -> DataFrame:
    """(node, degree, arms): how many piece ends meet at each node, and of how many pieces."""
    return ends_.groupBy("node").agg(F.count("*").alias("degree"), F.countDistinct("arm").alias("arms"))


def joints(ends_: DataFrame) -> DataFrame:
    """(node, a, b): nodes where exactly two pieces meet, end to end."""
    j = ends_.groupBy("node").agg(F.count("*").alias("n"), F.min("arm").alias("a"), F.max("arm").alias("b"))
    return j.where("n = 2 and a <> b").select("node", "a", "b")


def arms(ends_: DataFrame, places: DataFrame, least: int = 3) -> DataFrame:
    """(node, arm, side, bearing, next_arm, gap): the arms of junctions in the order of their bearings, with the next one
    clockwise and the angle up to it; the last is followed by the first. places: node, x, y. Ties by arm and side."""
    at = lambda n: places.select(F.col("node").alias(n), F.col("x").alias(f"{n}_x"), F.col("y").alias(f"{n}_y"))
    e = ends_.join(nodes(ends_).where(F.col("degree") >= least).select("node"), "node").join(at("node"), "node").join(at("towards"), "towards")
    e = e.withColumn("bearing", F.pmod(F.degrees(F.atan2(F.col("towards_x") - F.col("node_x"), F.col("towards_y") - F.col("node_y"))), F.lit(360.0)))
    w = Window.partitionBy("node").orderBy("bearing", "arm", "side")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.coalesce(F.lead("bearing").over(w), F.first("bearing").over(whole) + 360)
    return e.select("node", "arm", "side", "bearing", F.coalesce(F.lead("arm").over(w), F.first("arm").over(whole)).alias("next_arm"), (following - F.col("bearing")).alias("gap"))


def cross_section(rows: DataFrame, lanes: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows with lanes, their source and a width: the first of the (source, lanes) that says something, else the default."""
    source, value = F.lit("default"), F.lit(DEFAULT_LANES)
    for name, said in reversed(lanes):
        source, value = F.when(said.isNotNull(), F.lit(name)).otherwise(source), F.coalesce(said, value)
    width = F.least(F.greatest(value * LANE_M, F.lit(NARROWEST_M)), F.lit(WIDEST_M))
    return rows.withColumn("lanes", value).withColumn("lanes_source", source).withColumn("width_m", width)


def review(lists: Sequence[tuple[str, DataFrame, Column]]) -> DataFrame:
    """(kind, id): what each rule's rows say, as one list."""
    out = None
    for kind, rows, key in lists:
        now = rows.select(F.lit(kind).alias("kind"), key.cast("string").alias("id"))
        out = now if out is None else out.unionByName(now)
    return out
