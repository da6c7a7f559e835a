"""Joins and aggregations by place. Distance joins meet in grid cells: an equality join on the cell, then the exact test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrolith.functions import geo
from metrolith.operators.along import overlaps

#: What rounding may take from a share or a length, as a part of it.
SLACK = 1e-9


def cells(x: Column, y: Column, size: float) -> Column:
    return F.struct(F.floor(x / size).alias("cx"), F.floor(y / size).alias("cy"))


def around(x: Column, y: Column, size: float) -> Column:
    """The cell of a point and its eight neighbours."""
    cx, cy = F.floor(x / size), F.floor(y / size)
    return F.array(*[F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])


def radius_join(left: DataFrame, right: DataFrame, radius: float, lx: str = "x", ly: str = "y", rx: str = "x", ry: str = "y") -> DataFrame:
    """Pairs of a left and a right row within `radius`, with their distance `d`; right columns are prefixed r_.

    Left rows go to nine cells of the radius' size, right rows to one, so each pair is met once.
    """
    l = left.withColumn("_cell", F.explode(around(F.col(lx), F.col(ly), radius)))
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("_cell", cells(F.col(f"r_{rx}"), F.col(f"r_{ry}"), radius))
    j = l.join(r, "_cell").drop("_cell")
    return j.withColumn("d", F.sqrt((F.col(lx) - F.col(f"r_{rx}")) ** 2 + (F.col(ly) - F.col(f"r_{ry}")) ** 2)).where(F.col("d") <= radius)


def nearest_within(left: DataFrame, right: DataFrame, radius: float, left_id: Sequence[str], tie: Sequence[str], accept: Column | None = None, **at) -> DataFrame:
    """Each left row's nearest right row within the radius that `accept` allows; ties by the given r_ columns."""
    j = radius_join(left, right, radius, **at)
    if accept is not None:
        j = j.where(accept)
    rank = F.row_number().over(Window.partitionBy(*left_id).orderBy("d", *tie))
    return j.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def in_box(df: DataFrame, box: tuple[float, float, float, float], x: str = "x", y: str = "y") -> DataFrame:
    """Rows in a box (x0, y0, x1, y1): plain comparisons, which reach the Parquet scan as statistics filters."""
    return df.where((F.col(x) >= box[0]) & (F.col(x) <= box[2]) & (F.col(y) >= box[1]) & (F.col(y) <= box[3]))


def top_in_box(df: DataFrame, box: tuple[float, float, float, float], order: Sequence[Column], k: int) -> DataFrame:
    """The first k + 1 rows in a box: the one too many says that there are more."""
    return in_box(df, box).orderBy(*order).limit(k + 1)


def tile_counts(df: DataFrame, lon: str, lat: str, zoom: int, aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates by Web Mercator tile."""
    return df.groupBy(F.lit(zoom).alias("z"), geo.tile_x(F.col(lon), zoom).alias("tx"), geo.tile_y(F.col(lat), zoom).alias("ty")).agg(*aggregates)


def attach(points: DataFrame, facts: DataFrame, radius: float, point_id: str, aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates of the facts within a radius, for every point; points without any keep a row."""
    near = radius_join(points, facts, radius)
    return points.join(near.groupBy(point_id).agg(*aggregates), point_id, "left")


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float, x: str = "x", y: str = "y", ring: str = "ring") -> DataFrame:
    """Points with the polygons that hold them. Polygons (ring: array of (x, y)) go to the cells of their box; the exact test
    is an even-odd count over the ring's edges, within the plan."""
    p = polygons.withColumn("_xs", F.transform(ring, lambda v: v["x"])).withColumn("_ys", F.transform(ring, lambda v: v["y"]))
    low = lambda c: F.floor(F.array_min(c) / size).cast("long")
    high = lambda c: F.floor(F.array_max(c) / size).cast("long")
    p = p.withColumn("_cx", F.explode(F.sequence(low("_xs"), high("_xs")))).withColumn("_cy", F.explode(F.sequence(low("_ys"), high("_ys"))))
    p = p.withColumn("_cell", F.struct(F.col("_cx").alias("cx"), F.col("_cy").alias("cy"))).drop("_cx", "_cy", "_xs", "_ys")
    q = points.withColumn("_cell", cells(F.col(x), F.col(y), size))
    return q.join(p, "_cell").where(geo.inside_ring(F.col(x), F.col(y), F.col(ring))).drop("_cell")


def densify(lines: DataFrame, line: str, step: float, points: str = "points") -> DataFrame:
    """Points every `step` metres along lines (points: array of (x, y)), with the length each stands for and its bearing."""
    seg = lines.select("*", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(points) - 1), lambda i: F.struct(F.get(points, i - 1).alias("a"), F.get(points, i).alias("b")))).alias("seg", "_s"))
    seg = seg.withColumn("_dx", F.col("_s.b.x") - F.col("_s.a.x")).withColumn("_dy", F.col("_s.b.y") - F.col("_s.a.y"))
    seg = seg.withColumn("_len", F.sqrt(F.col("_dx") ** 2 + F.col("_dy") ** 2)).where("_len > 0")
    seg = seg.withColumn("_n", F.greatest(F.lit(1), F.ceil(F.col("_len") / step).cast("int")))
    seg = seg.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("_t", (F.col("_i") + 0.5) / F.col("_n"))
    return seg.select(
        line, "seg", F.col("_i").alias("i"), (F.col("_s.a.x") + F.col("_t") * F.col("_dx")).alias("x"), (F.col("_s.a.y") + F.col("_t") * F.col("_dy")).alias("y"),
        (F.col("_len") / F.col("_n")).alias("len"), geo.bearing(F.col("_dx"), F.col("_dy")).alias("bearing"))


def _summed(parts: DataFrame, keys: Sequence[str], dealt: Sequence[str]) -> DataFrame:
    """Shares, overlaps and differences of bearings from the parts of along.overlaps(), which are shuffled once, by `dealt`."""
    got = parts.repartition(*dealt).groupBy(*keys, "quarter").agg(F.sum("m").alias("m"), (F.sum("turned") / F.sum("m")).alias("diff"), F.first("length_m").alias("length_m"))
    got = got.groupBy(*keys).agg(F.sum("m").alias("overlap_m"), F.max("diff").alias("bearing_diff"), F.first("length_m").alias("length_m"))
    return got.select(*keys, (F.col("overlap_m") / F.col("length_m")).alias("share"), "overlap_m", "bearing_diff", "length_m")


def covered(these: DataFrame, others: DataFrame, this: str, other: str, near: float, step: float) -> DataFrame:
    """(this, other, share, overlap_m, bearing_diff): how much of each line lies within `near` of another, and how their
    bearings differ there, weighted by length. A closed line (its first point is its last) has the difference of its worst
    quarter, so that a loop is not taken for a line that it only crosses."""
    got = _summed(overlaps(these, others, this, other, near, step), ["this", "other"], ["this", "other"])
    return got.withColumnRenamed("this", this).withColumnRenamed("other", other)


def match_lines(targets: DataFrame, lines: DataFrame | None, near: float, step: float, min_share: float = 0.6, max_bearing: float = 20.0, names_agree: Column | None = None,
                min_line: float | None = None, min_overlap: float = 0.0) -> DataFrame:
    """Lines that run along a target: (target, line, share, overlap_m, bearing_diff, confidence, of).

    Both are densified; a target's point is covered by a line if one of that line's points lies within `near` of it. The
    share is the covered part of the target's length, the bearing difference that of the covered points, weighted by
    length. A pair matches from min_share on if its bearings differ by max_bearing at most; confidence is the share times
    the cosine of the difference, halved where names (columns target_name, line_name) are known to differ. With min_line,
    a pair below min_share still matches if the line is that long and has min_share of its own length along the target:
    `of` says whose share counted, the target's or the line's, and share, overlap and bearings are its. Overlaps of less
    than min_overlap metres are no match. All these bounds have a slack of SLACK, so that what lies on one does not hang
    on the order in which its parts were added up. Without lines, targets are matched with each other; there are no names then.
    """
    found = ["share", "overlap_m", "bearing_diff", "length_m"]
    enough = (F.col("share") >= min_share * (1 - SLACK)) & (F.col("overlap_m") >= min_overlap * (1 - SLACK))
    if lines is None and min_line is not None:
        # One way of a pair is the target's share, the other way the line's: both ways meet, and each is both.
        parts = overlaps(targets, None, "target", "target", near, step, min_share, min_overlap).withColumn("lo", F.least("this", "other")).withColumn("hi", F.greatest("this", "other"))
        got = _summed(parts, ["lo", "hi", "this"], ["lo", "hi"]).where(enough)
        way = lambda c: F.max(F.when(F.col("this") == F.col(c), F.struct(*found)))
        got = got.groupBy("lo", "hi").agg(way("lo").alias("f"), way("hi").alias("b"))
        long = lambda c: F.when(F.col(f"{c}.length_m") >= min_line, F.col(c))
        both = [F.struct(F.col(t).alias("target"), F.col(l).alias("line"), F.coalesce(F.col(x), long(y)).alias("v"), F.when(F.col(x).isNotNull(), "target").otherwise("line").alias("of")) for t, l, x, y in (("lo", "hi", "f", "b"), ("hi", "lo", "b", "f"))]
        got = got.select(F.inline(F.array(*both))).where("v is not null").select("target", "line", "v.*", "of")
    elif min_line is not None:
        parts = overlaps(targets, lines, "target", "line", near, step, min_share, min_overlap).select(F.col("this").alias("target"), F.col("other").alias("line"), F.lit("target").alias("of"), "quarter", "m", "turned", "length_m")
        back = overlaps(lines, targets, "line", "target", near, step, min_share, min_overlap).where(F.col("length_m") >= min_line)
        parts = parts.unionByName(back.select(F.col("other").alias("target"), F.col("this").alias("line"), F.lit("line").alias("of"), "quarter", "m", "turned", "length_m"))
        got = _summed(parts, ["target", "line", "of"], ["target", "line"]).where(enough)
        best = F.max(F.struct("of", *found)).alias("v")  # "target" comes after "line"
        got = got.groupBy("target", "line").agg(best).select("target", "line", "v.*")
    else:
        parts = overlaps(targets, lines, "target", "line", near, step, min_share, min_overlap)
        got = _summed(parts, ["this", "other"], ["this", "other"]).where(enough).withColumnRenamed("this", "target").withColumnRenamed("other", "line").withColumn("of", F.lit("target"))
    got = got.drop("length_m")
    if lines is not None and "target_name" in targets.columns and "line_name" in lines.columns and names_agree is not None:
        got = got.join(targets.select("target", "target_name"), "target").join(lines.select("line", "line_name"), "line")
        factor = F.when(names_agree == F.lit(False), 0.5).otherwise(1.0)
    else:
        factor = F.lit(1.0)
    got = got.where(F.col("bearing_diff") <= max_bearing * (1 + SLACK))
    return got.select("target", "line", "share", "overlap_m", "bearing_diff", F.round(F.least("share", F.lit(1.0)) * F.cos(F.radians("bearing_diff")) * factor, 3).alias("confidence"), "of")


def shared_area(a: DataFrame, b: DataFrame, size: float, a_id: str, b_id: str) -> DataFrame:
    """Shares of each a-polygon's area that each b-polygon covers, measured in cells of `size`: those whose centre a polygon
    holds. An approximation: its error falls with the size of the cells."""
    def burnt(p: DataFrame, key: str) -> DataFrame:
        low = lambda c: F.floor(F.array_min(F.transform("ring", lambda v: v[c])) / size).cast("long")
        high = lambda c: F.floor(F.array_max(F.transform("ring", lambda v: v[c])) / size).cast("long")
        p = p.withColumn("cx", F.explode(F.sequence(low("x"), high("x")))).withColumn("cy", F.explode(F.sequence(low("y"), high("y"))))
        return p.where(geo.inside_ring((F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size, F.col("ring"))).select(key, "cx", "cy")

    x = burnt(a, a_id)
    both = x.join(burnt(b, b_id), ["cx", "cy"]).groupBy(a_id, b_id).agg(F.count("*").alias("n"))
    return both.join(x.groupBy(a_id).agg(F.count("*").alias("cells")), a_id).select(a_id, b_id, (F.col("n") * size * size).alias("area"), (F.col("n") / F.col("cells")).alias("share"))


def greedy_pairs(candidates: DataFrame, left: str, right: str, cost: str) -> DataFrame:
    """One-to-one pairs as the greedy choice of the globally cheapest pair would have them.

    A pair is taken once it is the cheapest of both its ends; rounds repeat on what is left. That gives the greedy
    result, since cheaper pairs never depend on dearer ones; ties by the ends.
    """
    from metrolith.io import cut

    order = F.struct(cost, left, right)
    c, taken = cut(candidates.select(left, right, cost)), None
    while True:  # the cheapest pair of all is taken in every round, so this ends
        best_l = c.groupBy(left).agg(F.min(order).alias("o")).select("o.*")
        best_r = c.groupBy(right).agg(F.min(order).alias("o")).select("o.*")
        now = cut(best_l.join(best_r, [left, right, cost]).select(left, right, cost))
        taken = now if taken is None else taken.union(now)
        c = cut(c.join(now.select(left), left, "left_anti").join(now.select(right), right, "left_anti"))
        if not c.limit(1).count():
            return taken


def stable_ids(old: DataFrame, new: DataFrame, key: str, radius: float) -> DataFrame:
    """(new_id, old_id, how): ids that things keep from one edition to the next. Those with the same key (once on each
    side) come first, then the closest pairs within the radius of what is left, greedily; both editions have id, key, x, y."""
    once = lambda df, name: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias(name), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    same = once(new, "new_id").join(once(old, "old_id"), key).select("new_id", "old_id", F.lit("key").alias("how"))
    rest_new = new.join(same.select(F.col("new_id").alias("id")), "id", "left_anti").select("id", "x", "y")
    rest_old = old.join(same.select(F.col("old_id").alias("id")), "id", "left_anti").select("id", "x", "y")
    near = radius_join(rest_new, rest_old, radius).select(F.col("id").alias("new_id"), F.col("r_id").alias("old_id"), "d")
    return same.union(greedy_pairs(near, "new_id", "old_id", "d").select("new_id", "old_id", F.lit("near").alias("how")))


def clusters(points: DataFrame, key: str, radius: float, same: Sequence[str] = ()) -> DataFrame:
    """Single linkage: points chained by steps of `radius`, within equal `same` columns; the cluster is its smallest key."""
    from metrolith.operators.graph import connected_components

    pairs = radius_join(points, points, radius).where(F.col(key) > F.col(f"r_{key}"))
    for c in same:
        pairs = pairs.where(F.col(c).eqNullSafe(F.col(f"r_{c}")))
    found = connected_components(pairs.select(F.col(key).alias("a"), F.col(f"r_{key}").alias("b")))
    return points.join(found, points[key] == found["node"], "left").select(points["*"], F.coalesce("component", key).alias("cluster"))


def crossings(lines: DataFrame, line: str, size: float, points: str = "points") -> DataFrame:
    """(a, b, x, y): where segments of different lines cross, a < b. Segments meet in the cells that their boxes touch; a
    crossing counts in the one cell that holds it."""
    seg = lines.select(line, F.posexplode(F.transform(F.sequence(F.lit(1), F.size(points) - 1), lambda i: F.struct(F.get(points, i - 1).alias("p"), F.get(points, i).alias("q")))).alias("n", "s"))
    seg = seg.where("s.p is not null and s.q is not null").select(line, "n", F.col("s.p.x").alias("x0"), F.col("s.p.y").alias("y0"), F.col("s.q.x").alias("x1"), F.col("s.q.y").alias("y1"))
    span = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / size), F.floor(F.greatest(a, b) / size)))
    seg = seg.withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1"))
    o = seg.select("cx", "cy", *[F.col(c).alias(f"o_{c}") for c in (line, "n", "x0", "y0", "x1", "y1")])
    j = seg.join(o, ["cx", "cy"]).where(F.col(line) < F.col(f"o_{line}"))
    ux, uy, vx, vy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("o_x1") - F.col("o_x0"), F.col("o_y1") - F.col("o_y0")
    wx, wy = F.col("o_x0") - F.col("x0"), F.col("o_y0") - F.col("y0")
    det = F.nullif(ux * vy - uy * vx, F.lit(0.0))
    j = j.withColumn("t", (wx * vy - wy * vx) / det).withColumn("u", (wx * uy - wy * ux) / det).where(F.col("t").between(0, 1) & F.col("u").between(0, 1))
    j = j.withColumn("x", F.col("x0") + F.col("t") * ux).withColumn("y", F.col("y0") + F.col("t") * uy)
    j = j.where((F.floor(F.col("x") / size) == F.col("cx")) & (F.floor(F.col("y") / size) == F.col("cy")))
    return j.select(F.col(line).alias("a"), F.col(f"o_{line}").alias("b"), "x", "y")


def neighbours(lines: DataFrame, near: float, step: float, least_m: float) -> DataFrame:
    """(line, other, shared_m): lines that run near each other for least_m metres or more."""
    m = match_lines(lines.withColumnRenamed("line", "target"), None, near, step, 0.0, 90.0, min_overlap=least_m)
    return m.select(F.col("target").alias("line"), F.col("line").alias("other"), F.col("overlap_m").alias("shared_m"))


def apart(rows: DataFrame, from_: DataFrame, radius: float, key: str) -> DataFrame:
    """Rows that have none of `from_` within the radius."""
    return rows.join(radius_join(rows, from_, radius).select(key).distinct(), key, "left_anti")


def misses(lines: DataFrame, matches: DataFrame, targets: DataFrame, near: float, step: float, line: str = "line") -> DataFrame:
    """(line, near): lines without a match, and whether any target lies within `near`: a real miss, or a line elsewhere."""
    rest = lines.join(matches.select(line), line, "left_anti")
    close = radius_join(densify(rest, line, step), densify(targets, "target", step), near).select(line).distinct().withColumn("near", F.lit(True))
    return rest.select(line).join(close, line, "left").select(line, F.coalesce("near", F.lit(False)).alias("near"))


def coverage(targets: DataFrame, matches: DataFrame, source: str, target: str = "target") -> DataFrame:
    """By source: targets, those with a match, matches, the share that is covered."""
    m = targets.select(target, source).join(matches.select(target, F.lit(1).alias("_m")), target, "left")
    c = m.groupBy(source).agg(F.countDistinct(target).alias("lines"), F.countDistinct(F.when(F.col("_m") == 1, F.col(target))).alias("matched"), F.count("_m").alias("matches"))
    return c.withColumn("covered", F.col("matched") / F.col("lines"))


def nearest_in_turn(left: DataFrame, right: DataFrame, tries: Sequence[tuple[float, Column | None]], left_id: str, tie: Sequence[str]) -> DataFrame:
    """Each left row's nearest by the first of the tries (radius, condition) that finds one; `try` numbers it."""
    rest, out = left, None
    for i, (radius, accept) in enumerate(tries):
        found = nearest_within(rest, right, radius, [left_id], tie, accept).withColumn("try", F.lit(i))
        out = found if out is None else out.unionByName(found)
        rest = rest.join(found.select(left_id), left_id, "left_anti")
    return out


def unit_shares(shapes: DataFrame, units: DataFrame, size: float, shape: str, unit: str, least: float = 0.01) -> DataFrame:
    """(shape, unit, area, share): how much of each shape's area each unit has, in cells as in shared_area; parts below `least` go.
    A shape of fewer than three vertices has no area: the units that hold a vertex share it equally."""
    areal = F.size("ring") >= 3
    area = shared_area(shapes.where(areal), units, size, shape, unit).where(F.col("area") >= least)
    spots = shapes.where(~areal).select(shape, F.explode("ring").alias("v")).select(shape, "v.x", "v.y")
    held = points_in_polygons(spots, units, size).select(shape, unit).distinct()
    n = held.groupBy(shape).agg(F.count("*").alias("n"))
    return area.unionByName(held.join(n, shape).select(shape, unit, F.lit(0.0).alias("area"), (1 / F.col("n")).alias("share")))
