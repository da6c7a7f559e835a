"""Named queries for the steps of the builds: networks, grids, aggregates as JSON, shares, sweeps, marks and scalar rules.

As in queries.py, the driver's tables stand in for the platform's own.
"""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from metrolith.functions import color, geo, names
from metrolith.io import table
from metrolith.operators import network, raster, records, spatial, stats, status
from metrolith.plans import views
from metrolith.plans.queries import GRID, NOW, PTS, _grid, events, points, query

# --- networks ------------------------------------------------------------------------------------------------------
# Orders are ways, their items vertices; two items of one part and quantity are one node.

VERTICES = "v AS (SELECT l_orderkey AS way, l_linenumber AS n, min(l_partkey * 100 + CAST(l_quantity AS BIGINT)) AS node FROM lineitem GROUP BY 1, 2)"
PIECES = VERTICES + """, sh AS (SELECT node, count(*) > 1 AS shared FROM v GROUP BY 1), c AS (SELECT v.*, shared AND n > min(n) OVER w AND n < max(n) OVER w AS cut FROM v JOIN sh USING (node) WINDOW w AS (PARTITION BY way)),
k AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY way ORDER BY n ROWS UNBOUNDED PRECEDING) AS piece FROM c), u AS (SELECT way, piece, n, node FROM k UNION ALL SELECT way, piece - 1, n, node FROM k WHERE cut),
pc AS (SELECT way, CAST(piece AS BIGINT) AS piece, list(node ORDER BY n) AS path FROM u GROUP BY 1, 2 HAVING count(*) > 1)"""
ENDS = PIECES + """, en AS (SELECT way || ':' || piece AS arm, path[1] AS node, path[2] AS towards, 'from' AS side FROM pc UNION ALL SELECT way || ':' || piece, path[-1], path[-2], 'to' FROM pc)"""


def _pieces(spark, sf):
    v = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("way"), F.col("l_linenumber").alias("n")).agg(F.min(F.col("l_partkey") * 100 + F.col("l_quantity").cast("long")).alias("node"))
    return network.pieces(v, "way", "n", "node")


def _ends(spark, sf):
    return network.ends(_pieces(spark, sf), F.concat_ws(":", "way", "piece"))


@query(f"WITH {PIECES} SELECT way, piece, path[1] AS from_node, path[-1] AS to_node, array_to_string(path, '-') AS path FROM pc")
def road_pieces(spark, sf):
    return _pieces(spark, sf).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), "-"))


@query(f"WITH {ENDS} SELECT node, count(*) AS degree, count(DISTINCT arm) AS arms FROM en GROUP BY 1")
def road_nodes(spark, sf):
    return network.nodes(_ends(spark, sf))


@query(f"WITH {ENDS} SELECT node, min(arm) AS a, max(arm) AS b FROM en GROUP BY 1 HAVING count(*) = 2 AND min(arm) <> max(arm)")
def road_joints(spark, sf):
    return network.joints(_ends(spark, sf))


ARMS = ENDS + """, d AS (SELECT node FROM en GROUP BY 1 HAVING count(*) >= 3), b AS (SELECT en.*, ((degrees(atan2(CAST(towards % 317 - node % 317 AS DOUBLE), CAST((towards // 317) % 331 - (node // 317) % 331 AS DOUBLE))) % 360) + 360) % 360 AS bearing FROM en JOIN d USING (node)),
o AS (SELECT *, row_number() OVER w AS r, lead(arm) OVER w AS na, lead(bearing) OVER w AS nb, first(arm) OVER w AS fa, first(bearing) OVER w AS fb FROM b WINDOW w AS (PARTITION BY node ORDER BY bearing, arm, side))"""


@query(f"WITH {ARMS} SELECT node, arm, side, round(bearing, 4) AS bearing, coalesce(na, fa) AS next_arm, round(coalesce(nb, fb + 360) - bearing, 4) AS gap FROM o")
def junction_arms(spark, sf):
    """Nodes lie on a made-up grid, by their numbers."""
    e = _ends(spark, sf)
    places = e.select("node").union(e.select("towards")).distinct().select("node", (F.col("node") % 317).cast("double").alias("x"), (F.expr("node div 317") % 331).cast("double").alias("y"))
    return network.arms(e, places).withColumn("bearing", F.round("bearing", 4)).withColumn("gap", F.round("gap", 4))


@query(f"""WITH {ENDS}, n AS (SELECT node, count(*) AS degree FROM en GROUP BY 1), r AS (SELECT 'loop' AS kind, way || ':' || piece AS id FROM pc WHERE path[1] = path[-1] UNION ALL SELECT 'dead_end', CAST(node AS VARCHAR) FROM n WHERE degree = 1
  UNION ALL SELECT 'crowded', CAST(node AS VARCHAR) FROM n WHERE degree >= 6 UNION ALL SELECT 'single_segment', way || ':' || piece FROM pc WHERE len(path) = 2) SELECT kind, count(*) AS n, min(id) AS first FROM r GROUP BY 1""")
def review_lists(spark, sf):
    p, e = _pieces(spark, sf), _ends(spark, sf)
    n, key = network.nodes(e), F.concat_ws(":", "way", "piece")
    r = network.review([("loop", p.where("from_node = to_node"), key), ("dead_end", n.where("degree = 1"), F.col("node")), ("crowded", n.where("degree >= 6"), F.col("node")), ("single_segment", p.where("size(path) = 2"), key)])
    return r.groupBy("kind").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("""WITH r AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_size % 12 + 1 END AS osm, CASE WHEN p_size % 3 = 0 THEN 4 END AS rule, CASE WHEN p_size % 5 = 0 THEN 1 END AS hpms FROM part)
SELECT p_partkey, coalesce(osm, rule, hpms, 2) AS lanes, CASE WHEN osm IS NOT NULL THEN 'osm' WHEN rule IS NOT NULL THEN 'rule' WHEN hpms IS NOT NULL THEN 'hpms' ELSE 'default' END AS lanes_source, round(CAST(least(greatest(coalesce(osm, rule, hpms, 2) * 3.3, 3), 30) AS DOUBLE), 4) AS width_m FROM r""")
def cross_section(spark, sf):
    s = F.col("p_size")
    said = [("osm", F.when(s % 4 == 0, s % 12 + 1)), ("rule", F.when(s % 3 == 0, F.lit(4))), ("hpms", F.when(s % 5 == 0, F.lit(1)))]
    return network.cross_section(table(spark, sf, "part"), said).select("p_partkey", "lanes", "lanes_source", F.round("width_m", 4).alias("width_m"))


# --- aggregates ----------------------------------------------------------------------------------------------------

@query("""SELECT o_custkey, '[' || string_agg('{"k":' || o_orderkey || ',"s":"' || o_orderstatus || '"' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ',"p":"' || o_orderpriority || '"' END || '}', ',' ORDER BY o_orderkey) || ']' AS orders FROM orders GROUP BY 1""")
def json_rows(spark, sf):
    """Rows as one array of objects for each key, in order; what is null stands in none."""
    o = F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("p"))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.to_json(F.array_sort(F.collect_list(o))).alias("orders"))


@query("""WITH m AS (SELECT event_id, json_merge_patch(json_object('type', event_type, 'k', CAST(user_id AS VARCHAR), 'old', 'x'), CASE WHEN event_id % 2 = 0 THEN json_object('k', 'new', 'extra', CAST(event_id AS VARCHAR)) ELSE json_object('note', 'odd') END) AS j FROM events)
SELECT event_id, j ->> 'type' AS type, j ->> 'k' AS k, j ->> 'extra' AS extra, j ->> 'note' AS note, len(json_keys(j)) AS n FROM m""")
def json_merge(spark, sf):
    """Objects as maps, the second's keys over the first's."""
    m = events(spark, sf).select("event_id", F.create_map(F.lit("type"), "event_type", F.lit("k"), F.col("user_id").cast("string"), F.lit("old"), F.lit("x")).alias("a"),
                                 F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.lit("new"), F.lit("extra"), F.col("event_id").cast("string"))).otherwise(F.create_map(F.lit("note"), F.lit("odd"))).alias("b"))
    m = m.select("event_id", records.merged_maps(F.col("a"), F.col("b")).alias("j"))
    j = F.to_json("j")
    return m.select("event_id", *[F.get_json_object(j, f"$.{c}").alias(c) for c in ("type", "k", "extra", "note")], F.size("j").cast("long").alias("n"))


@query("""SELECT l_suppkey, round(sum(l_discount * l_quantity) FILTER (l_linenumber <> 3) / sum(l_quantity) FILTER (l_linenumber <> 3), 6) AS mean FROM lineitem GROUP BY 1""")
def weighted_means(spark, sf):
    """Items that say nothing don't weigh."""
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(stats.weighted_mean(F.when(F.col("l_linenumber") != 3, F.col("l_discount")), F.col("l_quantity")), 6).alias("mean"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(1.0 / count(*) OVER (PARTITION BY l_orderkey), 6) AS share FROM lineitem""")
def equal_shares(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(1.0 / F.count("*").over(Window.partitionBy("l_orderkey")), 6).alias("share"))


@query(f"""WITH p AS ({PTS}) SELECT kind, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY value, id)) AS line, round(sum(sqrt((x - px) ** 2 + (y - py) ** 2)), 3) AS metres, count(DISTINCT (floor(x / 50), floor(y / 50))) AS cells
FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM p WINDOW w AS (PARTITION BY kind ORDER BY value, id)) GROUP BY 1""")
def spatial_aggregates(spark, sf):
    """Of each kind's points: the box, the line through them in order, its length, and the cells that they touch."""
    w = Window.partitionBy("kind").orderBy("value", "id")
    step = F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2)
    p = points(spark, sf).withColumn("step", step)
    line = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("value", "id"))), lambda s: s["id"].cast("string")), ","))
    return p.groupBy("kind").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), line.alias("line"), F.round(F.sum("step"), 3).alias("metres"), F.countDistinct(spatial.cells(F.col("x"), F.col("y"), 50.0)).alias("cells"))


@query("""WITH s AS (SELECT l_suppkey, year(l_shipdate) AS y, l_returnflag AS m, sum(l_quantity) AS v FROM lineitem WHERE year(l_shipdate) BETWEEN 1993 AND 1995 AND l_returnflag IN ('A', 'N', 'R') GROUP BY 1, 2, 3) SELECT l_suppkey AS zone, CAST(y AS INT) AS year, CASE m WHEN 'A' THEN 'pop' WHEN 'N' THEN 'hh' ELSE 'jobs' END AS measure, v AS value FROM s""")
def growth_unpivot(spark, sf):
    """Columns named by measure and year, as the tables of forecasts have them, back to rows."""
    names_ = {"A": "POP", "N": "HH", "R": "JOBS"}
    cols = [F.sum(F.when((F.year("l_shipdate") == y) & (F.col("l_returnflag") == f), F.col("l_quantity"))).alias(f"{n}_{y}") for f, n in names_.items() for y in (1993, 1994, 1995)]
    wide = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("zone")).agg(*cols)
    return stats.year_columns(wide, "zone", r"^([A-Z]+)_([0-9]{4})$")


@query("""WITH t(threshold) AS (VALUES (10.0), (20.0), (30.0), (40.0)) SELECT l_returnflag AS box, CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (l_quantity >= threshold) AS kept, count(*) FILTER (l_quantity < threshold) AS dropped, round(coalesce(sum(l_extendedprice) FILTER (l_quantity >= threshold), 0), 2) AS weight FROM lineitem CROSS JOIN t GROUP BY 1, 2""")
def threshold_sweep(spark, sf):
    d = stats.sweep(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", [10.0, 20.0, 30.0, 40.0], "l_extendedprice")
    return d.select(F.col("l_returnflag").alias("box"), "threshold", "kept", "dropped", F.round("weight", 2).alias("weight"))


@query("""WITH e AS (SELECT l_suppkey AS reach, l_returnflag AS said, l_quantity AS m FROM lineitem UNION ALL SELECT l_suppkey, l_linestatus, l_quantity / 4 FROM lineitem WHERE l_linenumber > 2), s AS (SELECT reach, said, sum(m) AS m FROM e GROUP BY 1, 2), t AS (SELECT *, m / sum(m) OVER (PARTITION BY reach) AS share FROM s) SELECT reach, said, round(share, 6) AS share FROM t WHERE share >= 0.2""")
def evidence_vote(spark, sf):
    """What the sources say of a reach, by length; shares of a fifth and more count."""
    li = table(spark, sf, "lineitem")
    e = li.select(F.col("l_suppkey").alias("reach"), F.col("l_returnflag").alias("said"), F.col("l_quantity").alias("m")).unionByName(
        li.where("l_linenumber > 2").select(F.col("l_suppkey").alias("reach"), F.col("l_linestatus").alias("said"), (F.col("l_quantity") / 4).alias("m")))
    return stats.shares(e, ["reach"], ["said"], F.col("m")).where("share >= 0.2").select("reach", "said", F.round("share", 6).alias("share"))


@query("""WITH c AS (SELECT l_suppkey AS mapunit, l_partkey AS component, l_quantity AS pct, l_discount AS slope, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_partkey, l_orderkey, l_linenumber) AS r FROM lineitem)
SELECT mapunit, max(component) FILTER (r = 1) AS dominant, max(pct) FILTER (r = 1) AS pct, round(sum(pct * slope) / sum(pct), 6) AS slope FROM c GROUP BY 1""")
def dominant_component(spark, sf):
    """The largest component of each map unit, beside a mean over all by their shares."""
    li = table(spark, sf, "lineitem")
    order = F.struct((-F.col("l_quantity")).alias("o"), "l_partkey", "l_orderkey", "l_linenumber")
    return li.groupBy(F.col("l_suppkey").alias("mapunit")).agg(F.min_by("l_partkey", order).alias("dominant"), F.min_by("l_quantity", order).alias("pct"), F.round(stats.weighted_mean(F.col("l_discount"), F.col("l_quantity")), 6).alias("slope"))


# --- marks, rules and scalar functions -----------------------------------------------------------------------------

@query("""WITH m AS (SELECT event_type AS build, 'm' || (user_id % 9) AS marker, count(*) AS counter FROM events GROUP BY 1, 2), c AS (SELECT event_type AS build, 'm' || (user_id % 9) AS marker, count(*) AS counter FROM events WHERE ts < TIMESTAMP '2024-01-30 12:00:00' OR user_id % 9 < 4 GROUP BY 1, 2)
SELECT m.* FROM m LEFT JOIN c USING (build, marker) WHERE c.counter IS NULL OR m.counter > c.counter""")
def pending_builds(spark, sf):
    marks = lambda e: e.groupBy(F.col("event_type").alias("build"), F.concat(F.lit("m"), F.col("user_id") % 9).alias("marker")).agg(F.count("*").alias("counter"))
    e = events(spark, sf)
    return status.pending_marks(marks(e), marks(e.where("ts < timestamp_ntz '2024-01-30 12:00:00' or user_id % 9 < 4")))


@query("""WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'abc' WHEN 1 THEN '0' WHEN 2 THEN '99999' WHEN 3 THEN CAST(user_id AS VARCHAR) END AS w, ts FROM events)
SELECT event_id, least(greatest(coalesce(TRY_CAST(w AS INT), 60), 1), 900) AS window_s, least(ts, TIMESTAMP '2024-01-15 00:00:00') AS at FROM r""")
def request_window(spark, sf):
    """A window as a request gives it: text, clamped to 1 to 900 seconds, 60 if it says nothing; its end never in the future."""
    w = F.expr("case event_id % 5 when 0 then 'abc' when 1 then '0' when 2 then '99999' when 3 then cast(user_id as string) end")
    at = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return events(spark, sf).select("event_id", views.clamped(w, 1, 900, 60).alias("window_s"), F.least("ts", at).alias("at"))


@query("""SELECT o_orderkey, round(greatest(0, (3 - (1998 - year(o_orderdate))) / 3), 6) AS fade FROM orders""")
def scar_fade(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.round(views.fade(F.lit(1998) - F.year("o_orderdate")), 6).alias("fade"))


@query(r"""WITH t AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN ' N/A ' WHEN 1 THEN '-' WHEN 2 THEN ' ' || p_name || ' ' WHEN 3 THEN 'Unknown' WHEN 4 THEN '' ELSE p_type END AS t, p_name || ' & Ünit #' || p_size AS n FROM part)
SELECT p_partkey, CASE WHEN lower(trim(t)) IN ('', '-', 'n/a', 'na', 'none', 'null', 'unknown', '<null>') THEN NULL ELSE trim(t) END AS said, replace(trim(regexp_replace(lower(n), '[^a-z0-9]+', ' ', 'g')), ' ', '-') AS slug, 'café ' || p_size AS mended FROM t JOIN part USING (p_partkey)""")
def text_rules(spark, sf):
    """Junk to null, slugs, and text that was read in the wrong encoding."""
    p = table(spark, sf, "part")
    t = F.when(F.col("p_size") % 6 == 0, " N/A ").when(F.col("p_size") % 6 == 1, "-").when(F.col("p_size") % 6 == 2, F.concat(F.lit(" "), "p_name", F.lit(" "))).when(F.col("p_size") % 6 == 3, "Unknown").when(F.col("p_size") % 6 == 4, "").otherwise(F.col("p_type"))
    n = F.concat("p_name", F.lit(" & Ünit #"), "p_size")
    return p.select("p_partkey", names.null_junk(t).alias("said"), names.slug(n).alias("slug"), names.mended(F.concat(F.lit("cafÃ©"), F.lit(" "), "p_size")).alias("mended"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / 0.3048, 6) AS feet, round(l_quantity / 1.609344, 6) AS mph, round((l_quantity - l_tax) / nullif(l_quantity + l_tax, 0), 6) AS ndvi, round(round(l_extendedprice / 250) * 250, 2) AS quantised,
  round(cos(radians(l_discount * 400)) * (2 * pi() * 6378137 / (256 * 2 ** 12)), 6) AS resolution, epoch_ms(l_orderkey * 86400000) AS at FROM lineitem""")
def unit_rules(spark, sf):
    c = F.col
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(color.feet(c("l_quantity")), 6).alias("feet"), F.round(color.mph(c("l_quantity")), 6).alias("mph"), F.round(color.ndvi(c("l_quantity"), c("l_tax")), 6).alias("ndvi"),
        F.round(geo.quantised(c("l_extendedprice"), 250.0), 2).alias("quantised"), F.round(geo.ground_resolution(c("l_discount") * 400, 12), 6).alias("resolution"), color.from_epoch_ms(c("l_orderkey") * 86400000).cast("timestamp_ntz").alias("at"))


# --- places --------------------------------------------------------------------------------------------------------

SIX = [(1, 20.0), (2, 25.0), (3, 30.0), (4, 35.0), (5, 40.0), (6, 45.0)]


@query(f"WITH p AS ({PTS}), c AS (SELECT id, x, y FROM p WHERE kind = 0)" + "".join(f", f{k} AS (SELECT c.id, arg_min(p.id, (sqrt((c.x - p.x) ** 2 + (c.y - p.y) ** 2), p.id)) AS near{k}, count(*) AS n{k}, round(max(p.value), 6) AS top{k} FROM c JOIN p ON p.kind = {k} AND sqrt((c.x - p.x) ** 2 + (c.y - p.y) ** 2) <= {r} GROUP BY 1)" for k, r in SIX)
       + " SELECT c.id, " + ", ".join(f"near{k}, coalesce(n{k}, 0) AS n{k}, top{k}" for k, _ in SIX) + " FROM c" + "".join(f" LEFT JOIN f{k} USING (id)" for k, _ in SIX))
def places_and_facts(spark, sf):
    """Six tables of facts around each place, each with a radius of its own: the nearest, how many, the greatest value."""
    p = points(spark, sf)
    out = p.where("kind = 0").select("id", "x", "y")
    for k, r in SIX:
        facts = [F.min_by("r_id", F.struct("d", "r_id")).alias(f"near{k}"), F.count("*").alias(f"n{k}"), F.round(F.max("r_value"), 6).alias(f"top{k}")]
        out = spatial.attach(out, p.where(F.col("kind") == k), r, "id", facts) if k == 1 else out.join(spatial.attach(p.where("kind = 0").select("id", "x", "y"), p.where(F.col("kind") == k), r, "id", facts).drop("x", "y"), "id")
    return out.drop("x", "y").na.fill(0, [f"n{k}" for k, _ in SIX])


@query(f"""WITH p AS ({PTS}), a AS (SELECT * FROM p WHERE kind = 0), t AS (SELECT a.id, p.id AS r, sqrt((a.x - p.x) ** 2 + (a.y - p.y) ** 2) AS d, CASE WHEN p.kind = 7 AND sqrt((a.x - p.x) ** 2 + (a.y - p.y) ** 2) <= 15 THEN 0 ELSE 1 END AS try FROM a JOIN p ON p.kind > 4 AND sqrt((a.x - p.x) ** 2 + (a.y - p.y) ** 2) <= 30),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY try, d, r) AS n FROM t) SELECT id, r AS r_id, try FROM k WHERE n = 1""")
def nearest_in_turn(spark, sf):
    """The nearest of the right kind close by, else the nearest of any of the others."""
    p = points(spark, sf)
    return spatial.nearest_in_turn(p.where("kind = 0"), p.where("kind > 4"), [(15.0, F.col("r_kind") == 7), (30.0, None)], "id", ["r_id"]).select("id", "r_id", "try")


@query()
def stable_ids(spark, sf):
    """Two editions of the points: of every third the key is lost, and all have moved a little."""
    p = points(spark, sf)
    old = p.select("id", F.col("id").cast("string").alias("key"), "x", "y")
    new = p.select((F.col("id") + 1_000_000).alias("id"), F.when(F.col("id") % 3 != 0, F.col("id").cast("string")).alias("key"), (F.col("x") + 0.5).alias("x"), "y")
    return spatial.stable_ids(old, new, "key", 10.0)


# --- grids ---------------------------------------------------------------------------------------------------------

@query(f"WITH {GRID}, r AS (SELECT *, row_number() OVER (PARTITION BY row // 10, col // 10 ORDER BY v DESC, row, col) AS k FROM g) SELECT row, col, v FROM r WHERE k <= 2")
def first_cells_in_block(spark, sf):
    return raster.first_in_block(_grid(spark, sf), 10, [F.desc("v"), F.col("row"), F.col("col")], 2)


@query(f"""WITH RECURSIVE {GRID}, m AS (SELECT row, col, row * 50 + col AS id FROM g WHERE v < 44), e AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1), r(id, c) AS (SELECT id, id FROM m UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id), c AS (SELECT id, min(c) AS clump FROM r GROUP BY 1),
s AS (SELECT clump, count(*) AS cells, max(row) - min(row) + 1 AS high, max(col) - min(col) + 1 AS wide FROM c JOIN m USING (id) GROUP BY 1) SELECT * FROM s WHERE greatest(high, wide) >= 3 AND cells <= 2 * greatest(high, wide)""")
def thin_clumps(spark, sf):
    return raster.thin(raster.components(_grid(spark, sf).where("v < 44"), 50), 3, 2)


@query(f"WITH {GRID} SELECT a.row, a.col, round(min(sqrt((a.row - b.row) ** 2 + (a.col - b.col) ** 2)), 6) AS distance FROM g a JOIN g b ON b.v >= 50 AND sqrt((a.row - b.row) ** 2 + (a.col - b.col) ** 2) <= 4 GROUP BY 1, 2")
def mask_distance(spark, sf):
    g = _grid(spark, sf)
    return raster.distance_to(g, g.where("v >= 50"), 4).withColumn("distance", F.round("distance", 6))


@query(f"WITH {GRID} SELECT row, col, CASE WHEN v >= 49 THEN 'water' WHEN row % 7 = 0 THEN 'road' WHEN v >= 40 AND col % 2 = 0 THEN 'tree' ELSE 'grass' END AS cls FROM g")
def class_stack(spark, sf):
    rules = [(F.col("v") >= 49, "water"), (F.col("row") % 7 == 0, "road"), ((F.col("v") >= 40) & (F.col("col") % 2 == 0), "tree")]
    return _grid(spark, sf).select("row", "col", raster.stacked(rules, "grass").alias("cls"))


@query(f"""WITH p AS ({PTS}), s AS (SELECT kind AS k, avg(x) AS mx, avg(y) AS my, var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy FROM p GROUP BY 1),
d AS (SELECT p.id, s.k, sqrt(((x - mx) ** 2 * yy - 2 * (x - mx) * (y - my) * xy + (y - my) ** 2 * xx) / (xx * yy - xy ** 2)) AS d FROM p JOIN s ON xx * yy > xy ** 2) SELECT id, arg_min(k, (d, k)) AS nearest_class, round(min(d), 6) AS distance FROM d GROUP BY 1""")
def nearest_texture(spark, sf):
    p = points(spark, sf)
    return raster.mahalanobis_pair(p, p, "kind", "x", "y").select("id", "nearest_class", F.round("distance", 6).alias("distance"))


@query(f"WITH {GRID} SELECT row % 8 AS zone, count(*) AS cells, " + ", ".join(f"round(count(*) FILTER (v >= {t}) / count(*), 6) AS m{t}" for t in (10, 20, 30, 40, 49)) + " FROM g GROUP BY 1")
def five_mask_shares(spark, sf):
    g = _grid(spark, sf).withColumn("zone", F.col("row") % 8)
    s = raster.mask_shares(g, "zone", {f"m{t}": F.col("v") >= t for t in (10, 20, 30, 40, 49)})
    return s.select("zone", "cells", *[F.round(f"m{t}", 6).alias(f"m{t}") for t in (10, 20, 30, 40, 49)])


@query(f"""WITH {GRID}, z AS (SELECT (row * 7 + col) % 300 AS zone, row * 7 % 5 AS clump, count(*) AS cells, count(*) FILTER (v >= 45) AS hits FROM g GROUP BY 1, 2), c AS (SELECT clump, sum(hits) / sum(cells) AS s FROM z GROUP BY 1)
SELECT zone, clump, cells, round(CASE WHEN cells < 3 THEN s ELSE hits / cells END, 6) AS share, CASE WHEN cells < 3 THEN 'clump' ELSE 'zone' END AS of FROM z JOIN c USING (clump)""")
def share_or_clump(spark, sf):
    g = _grid(spark, sf).withColumn("zone", (F.col("row") * 7 + F.col("col")) % 300).withColumn("clump", F.col("row") * 7 % 5)
    return raster.share_or_clump(g, "zone", "clump", F.col("v") >= 45, 3).withColumn("share", F.round("share", 6))


@query(f"""WITH p AS ({PTS}), b AS (SELECT kind, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM p WHERE value > 0 GROUP BY 1), c AS (SELECT kind, floor((floor(y0 / 10) - 2) / 8) * 8 AS r0, floor((floor(x0 / 10) - 2) / 8) * 8 AS c0, ceil((ceil(y1 / 10) + 2) / 8) * 8 AS r1, ceil((ceil(x1 / 10) + 2) / 8) * 8 AS c1 FROM b)
SELECT kind, """ + ", ".join(f"CAST(least(greatest({v}, 0), {n}) AS BIGINT) AS {a}" for v, n, a in (("r0", 40, "row0"), ("c0", 30, "col0"), ("r1", 40, "row1"), ("c1", 30, "col1"))) + " FROM c")
def grid_windows(spark, sf):
    b = points(spark, sf).where("value > 0").groupBy("kind").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return b.select("kind", raster.window_of(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], 10.0, 8, 2, 40, 30).alias("w")).select("kind", "w.*")


@query("""WITH z(zone, x0, y0) AS (VALUES (1, -200, -200), (2, -95, -150), (3, 10, 35)), c AS (SELECT zone, x0, y0, cx, cy, (cx + 0.5) * 10 AS x, (cy + 0.5) * 10 AS y FROM z, range(-40, 60) a(cx), range(-40, 60) b(cy)) SELECT zone, cy AS row, cx AS col FROM c WHERE y >= y0 AND y < y0 + 150 AND x >= x0 + (y - y0) / 3 AND x < x0 + 120 + (y - y0) / 3""")
def rasterised(spark, sf):
    """Slanted boxes as cells."""
    rings = [(z, [(float(x), float(y)), (x + 120.0, float(y)), (x + 170.0, y + 150.0), (x + 50.0, y + 150.0)]) for z, x, y in ((1, -200, -200), (2, -95, -150), (3, 10, 35))]
    return raster.rasterise(spark.createDataFrame(rings, "zone int, ring array<struct<x:double,y:double>>"), 10.0, "zone")


@query(f"""WITH {GRID}, a AS (SELECT g.row, g.col, (e.v - w.v) / 2.0 AS east, (n.v - s.v) / 2.0 AS north FROM g JOIN g n ON n.row = g.row - 1 AND n.col = g.col JOIN g s ON s.row = g.row + 1 AND s.col = g.col JOIN g w ON w.row = g.row AND w.col = g.col - 1 JOIN g e ON e.row = g.row AND e.col = g.col + 1),
b AS (SELECT row, col, degrees(atan(sqrt(east ** 2 + north ** 2))) AS slope, ((degrees(atan2(-east, -north)) % 360) + 360) % 360 AS aspect FROM a) SELECT row, col, round(slope, 5) AS slope, round(sin(radians(40)) * cos(radians(slope)) + cos(radians(40)) * sin(radians(slope)) * cos(radians(135 - aspect)), 6) AS sun FROM b""")
def sunlit_cells(spark, sf):
    return raster.illumination(_grid(spark, sf), "v", 40.0, 135.0).select("row", "col", F.round("slope", 5).alias("slope"), F.round("sun", 6).alias("sun"))


# --- texture, shares of units, directions --------------------------------------------------------------------------

def _taps(sigma: float) -> str:
    """A Gaussian's taps as a SQL table (i, w)."""
    reach = math.ceil(3 * sigma)
    raw = [math.exp(-i * i / (2 * sigma * sigma)) for i in range(-reach, reach + 1)]
    return ", ".join(f"({i}, {w / sum(raw)!r}::DOUBLE)" for i, w in zip(range(-reach, reach + 1), raw))


TEXTURE = f"""{GRID}, t1(i, w) AS (VALUES {_taps(1.0)}), t2(i, w) AS (VALUES {_taps(math.sqrt(3.0))}),
f AS (SELECT row + a.i AS row, col + b.i AS col, sum(v * a.w * b.w) AS s, sum(a.w * b.w) AS d FROM g, t1 a, t1 b GROUP BY 1, 2),
h AS (SELECT row + a.i AS row, col + b.i AS col, sum(s * a.w * b.w) AS s, sum(d * a.w * b.w) AS d FROM f, t2 a, t2 b GROUP BY 1, 2)"""


@query(f"""WITH {TEXTURE} SELECT g.row % 4 AS zone, 0 AS octave, count(*) AS cells, round(avg((f.s / f.d - h.s / h.d) ** 2), 6) AS energy FROM g JOIN f USING (row, col) JOIN h USING (row, col) WHERE h.d >= 0.75 GROUP BY 1
UNION ALL SELECT row % 4, 1, count(*), round(avg((fs / fd - s / d) ** 2), 6) FROM (SELECT l.row, l.col, l.s / l.d AS fr, l.s AS fs, l.d AS fd, w.s, w.d FROM
(SELECT h.row // 2 AS row, h.col // 2 AS col, sum(CASE WHEN g.v IS NULL THEN 0 ELSE 1 END) / 4 AS u, sum(h.s) / 4 AS s, sum(h.d) / 4 AS d FROM (SELECT * FROM h WHERE row >= 0 AND col >= 0) h LEFT JOIN g ON g.row = h.row AND g.col = h.col GROUP BY 1, 2) l
JOIN (SELECT x.row + a.i AS row, x.col + b.i AS col, sum(x.s * a.w * b.w) AS s, sum(x.d * a.w * b.w) AS d FROM (SELECT CAST(floor(row / 2) AS BIGINT) AS row, CAST(floor(col / 2) AS BIGINT) AS col, sum(s) / 4 AS s, sum(d) / 4 AS d FROM h GROUP BY 1, 2) x, (VALUES {_taps(math.sqrt(4.0 - 4.25 / 4.0))}) a(i, w), (VALUES {_taps(math.sqrt(4.0 - 4.25 / 4.0))}) b(i, w) GROUP BY 1, 2) w USING (row, col) WHERE l.u >= 0.5 AND w.d >= 0.75) GROUP BY 1""")
def texture_energies(spark, sf):
    bands = [raster.octave_bands(_grid(spark, sf), "v", k).withColumn("octave", F.lit(k)) for k in (0, 1)]
    b = bands[0].unionByName(bands[1])
    return b.groupBy((F.col("row") % 4).alias("zone"), "octave").agg(F.count("*").alias("cells"), F.round(F.avg(F.col("band") ** 2), 6).alias("energy"))


@query("""WITH u(unit, x0, y0) AS (VALUES ('a', -200, -200), ('b', -100, -150), ('c', 60, 40)), s(shape, x0, y0) AS (VALUES (1, -160, -120), (2, 0, 0)), cells AS (SELECT (i + 0.5) * 10 AS x, (j + 0.5) * 10 AS y FROM range(-40, 40) a(i), range(-40, 40) b(j)),
c AS (SELECT shape, x, y, count(*) OVER (PARTITION BY shape) AS n FROM s JOIN cells ON x BETWEEN x0 AND x0 + 150 AND y BETWEEN y0 AND y0 + 150), v(shape, x, y) AS (VALUES (3, -90, -90), (3, 70.5, 60.5), (4, 390, 390)),
h AS (SELECT DISTINCT shape, unit FROM v JOIN u ON x BETWEEN x0 AND x0 + 150 AND y BETWEEN y0 AND y0 + 150)
SELECT shape, unit, count(*) * 100.0::DOUBLE AS area, round(count(*) / any_value(n), 6) AS share FROM c JOIN u ON x BETWEEN u.x0 AND u.x0 + 150 AND y BETWEEN u.y0 AND u.y0 + 150 GROUP BY 1, 2
UNION ALL SELECT shape, unit, 0.0, round(1.0 / count(*) OVER (PARTITION BY shape), 6) FROM h""")
def unit_shares(spark, sf):
    """Shapes with an area, and two that are only points; the last lies in no unit."""
    box = lambda x, y: [(float(x), float(y)), (x + 150.0, float(y)), (x + 150.0, y + 150.0), (float(x), y + 150.0)]
    units = spark.createDataFrame([("a", box(-200, -200)), ("b", box(-100, -150)), ("c", box(60, 40))], "unit string, ring array<struct<x:double,y:double>>")
    shapes = spark.createDataFrame([(1, box(-160, -120)), (2, box(0, 0)), (3, [(-90.0, -90.0), (70.5, 60.5)]), (4, [(390.0, 390.0)])], "shape int, ring array<struct<x:double,y:double>>")
    return spatial.unit_shares(shapes, units, 10.0, "shape", "unit").withColumn("share", F.round("share", 6))


WAYS = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL), s AS (SELECT vec_id, unnest([0, 1]) AS k, e FROM e), q AS (SELECT vec_id, k, e[1 + 2 * k] AS rx, e[2 + 2 * k] AS ry, e[3 + 2 * k] AS cx, e[4 + 2 * k] AS cy, unnest(['from', 'to']) AS side, unnest([e[7], e[9]]) AS px, unnest([e[8], e[10]]) AS py FROM s),
t AS (SELECT *, sqrt((cx - rx) ** 2 + (cy - ry) ** 2) AS len, least(1, greatest(0, ((px - rx) * (cx - rx) + (py - ry) * (cy - ry)) / ((cx - rx) ** 2 + (cy - ry) ** 2))) AS t FROM q), d AS (SELECT *, sqrt((rx + t * (cx - rx) - px) ** 2 + (ry + t * (cy - ry) - py) ** 2) AS d, coalesce(sum(len) OVER (PARTITION BY vec_id, side ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + t * len AS along FROM t),
n AS (SELECT vec_id, side, arg_min(along, (d, k)) AS along, min(d) AS d FROM d GROUP BY 1, 2)"""


@query(f"WITH {WAYS} SELECT a.vec_id, round(a.d, 6) AS start_distance, round(a.along, 6) AS start_along, a.along <= b.along AS same_way FROM n a JOIN n b USING (vec_id) WHERE a.side = 'from' AND b.side = 'to'")
def drawn_same_way(spark, sf):
    """Lines of three vertices and segments of two, from the components of vectors."""
    at = lambda i: F.struct(F.get("embedding", F.lit(i)).cast("double").alias("x"), F.get("embedding", F.lit(i + 1)).cast("double").alias("y"))
    lines = table(spark, sf, "embeddings").where("embedding is not null").select("vec_id", F.array(at(0), at(2), at(4)).alias("line"), F.array(at(6), at(8)).alias("seg"))
    near = geo.located(F.col("line"), F.col("seg")[0])
    return lines.select("vec_id", F.round(near["distance"], 6).alias("start_distance"), F.round(near["along"], 6).alias("start_along"), geo.drawn_same_way(F.array("line"), F.array("seg")).alias("same_way"))
