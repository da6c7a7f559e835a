import random
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from metrolith.functions import geo, names
from metrolith.operators import graph, latest, lifecycle, raster, records, spatial, temporal, transit


def ts(text):
    return F.lit(text).cast("timestamp")


def rules(spark, *specs):
    keys = ["id", "position", "level", "value", "s", "e", "yearly_from", "yearly_to", "weekdays", "monthdays", "minute_from", "minute_to"]
    rows = [tuple(({"position": i, "id": f"r{i}"} | s).get(k) for k in keys) for i, s in enumerate(specs)]
    schema = "id string, position int, level string, value string, s string, e string, yearly_from int, yearly_to int, weekdays array<int>, monthdays array<int>, minute_from int, minute_to int"
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("starts", F.col("s").cast("timestamp")).withColumn("ends", F.col("e").cast("timestamp"))


def spans(df):
    return [(r.since.isoformat(sep=" "), r.until.isoformat(sep=" "), r.value) for r in df.orderBy("since").collect()]


def test_rules_over_a_clock_change(spark):
    """Night hours in Boise on the days around 2026-03-08, when clocks go from 2 to 3."""
    r = rules(spark, {"level": "default", "value": "night", "minute_from": 22 * 60, "minute_to": 30 * 60})
    got = spans(temporal.timeline(r, ts("2026-03-07 12:00:00"), ts("2026-03-09 20:00:00"), "America/Boise"))
    assert got == [
        ("2026-03-07 12:00:00", "2026-03-07 13:00:00", "night"), ("2026-03-07 13:00:00", "2026-03-08 05:00:00", None),
        ("2026-03-08 05:00:00", "2026-03-08 12:00:00", "night"), ("2026-03-08 12:00:00", "2026-03-09 04:00:00", None),
        ("2026-03-09 04:00:00", "2026-03-09 12:00:00", "night"), ("2026-03-09 12:00:00", "2026-03-09 20:00:00", None),
    ]


def test_rules_levels_and_order(spark):
    r = rules(
        spark, {"level": "default", "value": "a"}, {"level": "default", "value": "b", "weekdays": [0]},
        {"level": "order", "value": "c", "s": "2026-01-06 06:00:00", "e": "2026-01-06 12:00:00"}, {"level": "season", "value": "w", "yearly_from": 1231, "yearly_to": 102})
    got = spans(temporal.timeline(r, ts("2026-01-01 00:00:00"), ts("2026-01-08 00:00:00")))
    assert got == [
        ("2026-01-01 00:00:00", "2026-01-03 00:00:00", "w"), ("2026-01-03 00:00:00", "2026-01-05 00:00:00", "a"), ("2026-01-05 00:00:00", "2026-01-06 00:00:00", "b"),
        ("2026-01-06 00:00:00", "2026-01-06 06:00:00", "a"), ("2026-01-06 06:00:00", "2026-01-06 12:00:00", "c"), ("2026-01-06 12:00:00", "2026-01-08 00:00:00", "a"),
    ]
    assert temporal.state_at(r, ts("2026-01-06 07:00:00")).collect() == [("r2", "c")]
    assert spans(temporal.timeline(rules(spark, {"level": "order", "value": "x", "s": "2030-01-01 00:00:00"}), ts("2026-01-01 00:00:00"), ts("2026-01-02 00:00:00"))) == [("2026-01-01 00:00:00", "2026-01-02 00:00:00", None)]


def test_gauge_spans(spark):
    h = lambda n: datetime(2026, 5, 1 + n // 24, n % 24)
    rows = [("g", h(0), 0, "?"), ("g", h(1), 1, "on"), ("g", h(2), 2, None), ("g", h(3), 3, "off"), ("g", h(60), 4, None), ("g", h(61), 5, "off")]
    df = spark.createDataFrame([(k, t, i, None if s in (None, "?") else s) for k, t, i, s in rows], "g string, t timestamp_ntz, i int, s string")
    got = temporal.gauge_spans(df, "g", "t", "i", F.col("s"), F.lit("2026-05-03 14:00:00").cast("timestamp_ntz"), 48 * 3600)
    assert [(r.state, r.since, r.until) for r in got.orderBy("since").collect()] == [("on", h(1), h(3)), ("off", h(3), h(51)), ("unknown", h(51), h(61)), ("off", h(61), None)]


def test_merge_versions(spark):
    t1, t2, t3 = (F.lit(f"2026-01-0{i} 00:00:00").cast("timestamp_ntz") for i in (1, 2, 3))
    snap = lambda *r: spark.createDataFrame([("s", i, h, h) for i, h in r], "source string, source_id string, version_hash string, payload string")
    held = spark.createDataFrame([], "source string, source_id string, version_hash string, payload string, first_seen timestamp_ntz, last_seen timestamp_ntz, removed_at timestamp_ntz")
    held = records.merge_versions(held, snap(("a", "1"), ("b", "1")), t1)
    held = records.merge_versions(held, snap(("a", "2")), t2)
    held = records.merge_versions(held, snap(("a", "2"), ("b", "1")), t3)
    d = lambda n: None if n is None else datetime(2026, 1, n)
    got = {(r.source_id, r.version_hash): (r.first_seen, r.last_seen, r.removed_at) for r in held.collect()}
    assert got == {("a", "1"): (d(1), d(1), d(2)), ("a", "2"): (d(2), d(3), None), ("b", "1"): (d(1), d(3), None)}


def test_lifecycle_returns(spark):
    t = [F.lit(f"2026-01-0{i} 00:00:00").cast("timestamp_ntz") for i in range(1, 5)]
    held = spark.createDataFrame([], "source_id string, content_hash string, observed_lo timestamp_ntz, observed_hi timestamp_ntz, active boolean, updated_at timestamp_ntz")
    states = []
    for at, rows in zip(t, ([("a", "1"), ("b", "1")], [("a", "1")], [("a", "2"), ("b", "1")], [("a", "2"), ("b", "1")])):
        m = lifecycle.merge_snapshot(held, spark.createDataFrame(rows, "source_id string, content_hash string"), at)
        states.append({r.source_id: r.state for r in m.collect()})
        held = m.drop("state")
    assert states == [{"a": "new", "b": "new"}, {"a": "unchanged", "b": "gone"}, {"a": "changed", "b": "changed"}, {"a": "unchanged", "b": "unchanged"}]
    b = held.where("source_id = 'b'").first()
    assert (b.observed_lo, b.observed_hi, b.active, b.updated_at) == (datetime(2026, 1, 1), None, True, datetime(2026, 1, 3))


def test_check_snapshot():
    records.check_snapshot(10, 5)
    for active, found in ((10, 4), (0, 0)):
        with pytest.raises(ValueError):
            records.check_snapshot(active, found)


@pytest.mark.parametrize("a, b, want", [
    ("N Ten Mile Rd", "TENMILE RD", True), ("W Linder Ave", "LINDER RD", True), ("Brookside Ln", "BROOKESIDE LN", True), ("Hill Road Pkwy", "HILL RD", True),
    ("SH-16", "N Hwy 16", True), ("SH-16", "US 20", False), ("Main St", "SH-44", None), (None, "Main St", None), ("Oak St", "Elm St", False),
])
def test_names_agree(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(names.names_agree(F.col("a"), F.col("b")).alias("x")).first().x is want


def test_greedy_pairs_match_brute_force(spark):
    r = random.Random(1)
    c = [(i, j, float(r.randint(1, 40))) for i in range(14) for j in range(14) if r.random() < 0.4]
    want, used = set(), set()
    for d, i, j in sorted((d, i, j) for i, j, d in c):
        if ("l", i) not in used and ("r", j) not in used:
            want.add((i, j))
            used |= {("l", i), ("r", j)}
    got = spatial.greedy_pairs(spark.createDataFrame(c, "l int, r int, d double"), "l", "r", "d").collect()
    assert {(x.l, x.r) for x in got} == want


def test_line_match(spark):
    pts = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    t = spark.createDataFrame([(1, pts((0, 0), (100, 0)))], "target int, points array<struct<x:double,y:double>>")
    l = spark.createDataFrame([(1, pts((0, 5), (100, 5))), (2, pts((50, -50), (50, 50))), (3, pts((0, 5), (40, 5))), (4, pts((100, -4), (0, -4)))], "line int, points array<struct<x:double,y:double>>")
    got = {r.line: r for r in spatial.match_lines(t, l, 10.0, 5.0).collect()}
    assert set(got) == {1, 4} and got[1].share == pytest.approx(1) and got[4].bearing_diff == pytest.approx(0) and got[1].confidence == 1.0


def test_shared_area(spark):
    ring = lambda x0, y0, x1, y1: [{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
    a = spark.createDataFrame([(1, ring(0, 0, 10, 10))], "a int, ring array<struct<x:double,y:double>>")
    b = spark.createDataFrame([(7, ring(5, 0, 20, 10)), (8, ring(50, 50, 60, 60))], "b int, ring array<struct<x:double,y:double>>")
    assert [(r.a, r.b, r.area, r.share) for r in spatial.shared_area(a, b, 1.0, "a", "b").collect()] == [(1, 7, 50.0, 0.5)]


def test_geometry(spark):
    d = spark.range(1)
    e, n = geo.to_utm(F.lit(-116.2), F.lit(43.6), 11)
    r = d.select(e.alias("e"), n.alias("n"), geo.lens_area(F.lit(1.0), F.lit(1.0), F.lit(0.0)).alias("full"), geo.lens_area(F.lit(1.0), F.lit(1.0), F.lit(2.5)).alias("none")).first()
    assert r.e == pytest.approx(564570, abs=60) and r.n == pytest.approx(4827700, abs=400) and r.full == pytest.approx(3.14159265) and r.none == 0
    ids = [x[0] for x in spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 0)], "x long, y long").select(geo.hilbert_tile_id(F.col("x"), F.col("y"), 1)).collect()]
    assert ids == [1, 2, 3, 4]
    zoom3 = spark.range(64).select((F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"))
    got = {r.t: (r.x, r.y) for r in zoom3.select("x", "y", geo.hilbert_tile_id(F.col("x"), F.col("y"), 3).alias("t")).collect()}
    assert sorted(got) == list(range(21, 85))
    assert all(abs(got[t][0] - got[t + 1][0]) + abs(got[t][1] - got[t + 1][1]) == 1 for t in range(21, 84))


def test_graph(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(r.randint(100, 160), r.randint(100, 160)) for _ in range(30)] + [(None, 5), (7, 7)]
    got = {x.node: x.component for x in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61))
    for a, b in edges:
        if a is not None and a != b:
            assert got[a] == got[b]
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert graph.topological_order({"c": (1, ["a"]), "b": (0, []), "a": (5, ["b"])}) == ["b", "a", "c"]
    with pytest.raises(ValueError):
        graph.topological_order({"a": (0, ["b"]), "b": (0, ["a"])})


def test_spaced_peaks_match_brute_force(spark):
    r = random.Random(8)
    pts = [(i, r.random() * 30, r.random() * 30, float(r.randint(1, 20))) for i in range(60)]
    want = []
    for p in sorted(pts, key=lambda p: (-p[3], p[0])):
        if all((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 > 25 for q in want):
            want.append(p)
    got = raster.spaced_peaks(spark.createDataFrame(pts, "id long, x double, y double, h double"), "id", "h", 5.0).collect()
    assert {g.id for g in got} == {p[0] for p in want}


def test_map_match(spark):
    shapes = pd.DataFrame({"shape": ["a", "a", "b", "b"], "x": [0.0, 1000.0, 0.0, 1000.0], "y": [0.0, 0.0, 30.0, 30.0]})
    fixes = [("v", 30.0 * i, 100.0 * i, 12.0 if i != 3 else 17.0) for i in range(8)] + [("w", 0.0, 50.0, 500.0)]
    got = transit.map_match(spark.createDataFrame(fixes, "vehicle string, ts double, x double, y double"), shapes).orderBy("vehicle", "ts").collect()
    assert [g["shape"] for g in got] == ["a"] * 8 + [None]  # one fix nearer to b doesn't change shapes
    assert got[2].m == pytest.approx(200)


def test_steps(spark):
    rows = [("v", 0, 0.0, 0.0, 0.0), ("v", 10, 3.0, 0.0, 3.0), ("v", 20, 103.0, 0.0, 103.0), ("v", 30, 203.0, 0.0, 900.0), ("v", 500, 900.0, 0.0, 950.0)]
    df = spark.createDataFrame(rows, "v string, s long, x double, y double, m double").withColumn("t", F.timestamp_seconds("s")).withColumn("shape", F.lit("a"))
    got = transit.steps(df, "v", "t", "s", "x", "y", "m", "shape").orderBy("s").collect()
    assert [(g.step, g.step_speed_ms) for g in got] == [("still", 0.0), ("along", 10.0), ("straight", 10.0), ("gap", None), (None, None)]


def test_latest(spark):
    df = spark.createDataFrame([("10",), ("2",), ("x",), ("A2",), (None,)], "r string")
    assert [x.r for x in df.orderBy(*latest.natural_order("r")).collect()][:2] == ["2", "10"]
    rows = spark.createDataFrame([(1, i, i == 0) for i in range(5)], "k int, t int, keep boolean")
    assert sorted(x.t for x in latest.prune_newest(rows, ["k"], [F.desc("t")], 2, F.col("keep")).collect()) == [0, 3, 4]


def test_provisional_routes(spark):
    steps = ["along", "along", "still", "along", "along", "along", "gap", "along", "along", "along", "along"]
    near = [["a"], ["a", "b"], ["a"], ["a"], ["a"], ["a"], ["a"], ["b"], ["b"], ["b"], ["b"]]
    df = spark.createDataFrame([("v", "t", i, s, n) for i, (s, n) in enumerate(zip(steps, near))], "v string, trip string, i int, step string, near array<string>")
    got = [r["route"] for r in transit.provisional_routes(df, "v", "trip", "i", "step", "near").orderBy("i").collect()]
    assert got == [None] * 10 + ["b"]
    got = [r["route"] for r in transit.provisional_routes(df, "v", "trip", "i", "step", "near", 3).orderBy("i").collect()]
    assert got == [None] * 5 + ["a"] + [None] * 3 + ["b", "b"]


def test_reprocess(spark):
    rows = spark.createDataFrame([("a", 1, "old"), ("a", 2, "old"), ("b", 2, "old")], "k string, t int, v string")
    got = transit.reprocess(rows, spark.createDataFrame([("a", 2)], "k string, since int"), "k", "t", lambda df: df.withColumn("v", F.lit("new")))
    assert sorted(map(tuple, got.collect())) == [("a", 1, "old"), ("a", 2, "new"), ("b", 2, "old")]


def test_nearest_in_turn(spark):
    cams = spark.createDataFrame([(1, 0.0, 0.0, "Main"), (2, 100.0, 0.0, "Oak"), (3, 900.0, 0.0, "Elm")], "id int, x double, y double, street string")
    places = spark.createDataFrame([(10, 5.0, 0.0, "Oak"), (11, 30.0, 0.0, "Main"), (12, 130.0, 0.0, "Pine")], "id int, x double, y double, street string")
    got = spatial.nearest_in_turn(cams, places, [(80.0, F.col("street") == F.col("r_street")), (50.0, None)], "id", ["r_id"]).collect()
    assert {r.id: (r.r_id, r["try"]) for r in got} == {1: (11, 0), 2: (12, 1)}


def test_match_by_either_share(spark):
    """A short line along a long target counts by its own share; a loop that a line crosses does not, by its worst quarter."""
    line = lambda *p: [(float(x), float(y)) for x, y in p]
    schema = "array<struct<x:double,y:double>>"
    targets = spark.createDataFrame([("long", line((0, 0), (400, 0))), ("loop", line((0, 100), (40, 100), (40, 140), (0, 140), (0, 100)))], f"target string, points {schema}")
    lines = spark.createDataFrame([("side", line((100, 3), (160, 3))), ("stub", line((200, 3), (210, 3))), ("across", line((-40, 120), (80, 120))), ("same", line((0, 101), (40, 101), (40, 141), (0, 141), (0, 101)))], f"line string, points {schema}")
    got = {(r.target, r.line): (r.of, round(r.share, 3)) for r in spatial.match_lines(targets, lines, 6.0, 5.0, min_line=20.0).collect()}
    assert got == {("long", "side"): ("line", 1.0), ("loop", "same"): ("target", 1.0)}
    assert {(r.target, r.line) for r in spatial.match_lines(targets, lines, 6.0, 5.0).collect()} == {("loop", "same")}
    m = spatial.match_lines(targets, lines, 6.0, 5.0, min_line=20.0)
    assert {r.line: r.near for r in spatial.misses(lines, m, targets, 8.0, 5.0).collect()} == {"stub": True, "across": True}


def test_stable_ids(spark):
    """The same key first, then the closest pairs, one to one."""
    schema = "id long, key string, x double, y double"
    old = spark.createDataFrame([(1, "a", 0.0, 0.0), (2, "b", 10.0, 0.0), (3, "c", 20.0, 0.0), (4, "d", 500.0, 0.0), (5, "e", 22.0, 0.0)], schema)
    new = spark.createDataFrame([(11, "a", 21.0, 0.0), (12, None, 11.0, 0.0), (13, None, 20.5, 0.0), (14, "z", 90.0, 0.0), (15, None, 22.5, 0.0)], schema)
    got = {(r.new_id, r.old_id, r.how) for r in spatial.stable_ids(old, new, "key", 5.0).collect()}
    assert got == {(11, 1, "key"), (12, 2, "near"), (13, 3, "near"), (15, 5, "near")}


def test_long_chains_end(spark):
    """Ways are followed to their end, and a length below zero, with which they need not end, is an error."""

    edges = spark.range(20).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(1.0).alias("w"))
    d = graph.distances(edges.where("a < 12"), spark.range(1).select(F.col("id").alias("node"))).collect()
    assert {(r.node, r.distance) for r in d} == {(i, float(i)) for i in range(13)}
    with pytest.raises(ValueError):
        graph.distances(edges.withColumn("w", F.lit(-1.0)), spark.range(1).select(F.col("id").alias("node")))


def test_drawn_same_way_picks_the_nearest_part(spark):
    line = "array(array(named_struct('x', 0D, 'y', 0D), named_struct('x', 5D, 'y', 0D), named_struct('x', 10D, 'y', 0D)), array(named_struct('x', 10D, 'y', 50D), named_struct('x', 0D, 'y', 50D)))"
    seg = lambda x0, x1, y: f"array(array(named_struct('x', {x0}D, 'y', {y}D), named_struct('x', {x1}D, 'y', {y}D)))"
    df = spark.sql(f"select {line} l, {seg(1, 9, 2)} a, {seg(9, 1, 2)} b, {seg(1, 9, 49)} c, {seg(3, 3, 1)} d")
    assert tuple(df.select(*[geo.drawn_same_way(F.col("l"), F.col(c)) for c in "abcd"]).first()) == (True, False, False, True)


def test_as_of_within_matches_brute_force_and_is_not_broadcast(spark):
    from datetime import date, timedelta

    r, start = random.Random(4), date(1969, 11, 1)
    left = [(i, r.choice("ab"), start + timedelta(days=r.randint(0, 120))) for i in range(80)] + [(80, "a", None), (81, None, start)]
    right = [(i, r.choice("ac"), start + timedelta(days=r.randint(0, 120))) for i in range(60)] + [(60, "a", None), (61, None, start)]
    l, s = spark.createDataFrame(left, "id int, k string, day date"), spark.createDataFrame(right, "other int, k string, at date")
    d = latest.as_of_within(l, s, ["k"], "day", "at", 9, [F.desc_nulls_last("at"), F.col("other")], ["id"])
    want = {}
    for i, k, day in left:
        near = [(-at.toordinal(), o) for o, key, at in right if key == k and k and day and at and 0 <= (day - at).days <= 9]
        want[i] = min(near)[1] if near else None
    assert {x.id: x.other for x in d.collect()} == want and d.columns == ["id", "k", "day", "other", "at"]
    assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()


def _brute_overlaps(lines, near, step):
    """(this, other) -> (share, overlap_m, bearing_diff), point by point."""
    import math

    def points(v):
        segs = [(p, q, math.dist(p, q)) for p, q in zip(v, v[1:]) if math.dist(p, q) > 0]
        total, at, out = sum(s[2] for s in segs), 0.0, []
        for p, q, m in segs:
            n = max(1, math.ceil(m / step))
            for i in range(n):
                t = (i + 0.5) / n
                part = int(4 * (at + t * m) / total) if v[0] == v[-1] else 0
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1]), m / n, math.degrees(math.atan2(q[0] - p[0], q[1] - p[1])) % 360, part))
            at += m
        return out, total

    made, got = {k: points(v) for k, v in lines.items()}, {}
    for a, (mine, total) in made.items():
        for b, (others, _) in made.items():
            parts = {}
            for x, y, m, bearing, part in mine if a != b else []:
                d = min(others, key=lambda o: (math.dist((x, y), o[:2]), o[0], o[1]))
                if math.dist((x, y), d[:2]) <= near:
                    turn = abs(bearing - d[3]) % 180
                    old = parts.get(part, (0.0, 0.0))
                    parts[part] = (old[0] + m, old[1] + m * min(turn, 180 - turn))
            if parts:
                over = sum(m for m, _ in parts.values())
                got[a, b] = (over / total, over, max(t / m for m, t in parts.values()))
    return got


def test_line_overlaps_match_brute_force_over_tiles(spark):
    """Tiles are 300 wide: lines within one, over several, closed, and below zero; ids are texts."""
    r = random.Random(5)
    lines = {}
    for i in range(40):
        x, y = r.uniform(-700, 700), r.uniform(-60, 60)
        v = [(x, y)]
        for _ in range(r.randint(1, 6)):
            v.append((v[-1][0] + r.uniform(-150, 150), v[-1][1] + r.uniform(-15, 15)))
        lines[f"l{i}"] = v + [v[0]] * (i % 5 == 0)
        if i % 4 == 0:
            lines[f"m{i}"] = [(a + 1.5, b + 2.0) for a, b in v]
    rows = [(k, [{"x": x, "y": y} for x, y in v]) for k, v in lines.items()]
    d = spark.createDataFrame([*rows, ("none", None), ("one", [{"x": 1.0, "y": 1.0}])], "line string, points array<struct<x:double,y:double>>")
    want = _brute_overlaps(lines, 3.0, 2.0)
    got = {(x.line, x.other): (x.share, x.overlap_m, x.bearing_diff) for x in spatial.covered(d, d.withColumnRenamed("line", "other"), "line", "other", 3.0, 2.0).where("line <> other").collect()}
    assert got.keys() == want.keys() and len(want) > 60 and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    near = {(x.line, x.other): x.shared_m for x in spatial.neighbours(d, 3.0, 2.0, 20.0).collect()}
    assert near == {k: pytest.approx(v[1]) for k, v in want.items() if v[1] >= 20}
    t = d.withColumnRenamed("line", "target")
    match = {(x.target, x.line): (x.of, round(x.share, 6)) for x in spatial.match_lines(t, None, 3.0, 2.0, 0.4, 30.0, min_line=100.0).collect()}
    assert match == {(x.target, x.line): (x.of, round(x.share, 6)) for x in spatial.match_lines(t, d, 3.0, 2.0, 0.4, 30.0, min_line=100.0).where("target <> line").collect()}
    assert {k for k, (of, _) in match.items() if of == "target"} == {k for k, v in want.items() if v[0] >= 0.4 and v[2] <= 30} and {of for of, _ in match.values()} == {"target", "line"}


def test_line_on_a_bound_matches(spark):
    """1064 covers three of the five parts of 264: whether that is 0.6 hung on the order of the sum."""
    lines = {264: [(14400.0 + 40 * n, q) for n, q in ((1, 10.0), (2, 3.0), (3, 17.0))]}
    pts = [{"x": float(x), "y": y} for x, y in lines[264]]
    d = spark.createDataFrame([(1, pts), (2, pts[:2])], "line int, points array<struct<x:double,y:double>>")
    share = spatial.covered(d, d.withColumnRenamed("line", "other"), "line", "other", 5.0, 10.0).where("line = 1 and other = 2").first().share
    m = spatial.match_lines(d.withColumnRenamed("line", "target"), None, 5.0, 10.0, min_share=share * (1 + 1e-12))
    assert (1, 2) in {(x.target, x.line) for x in m.collect()}


def test_lines_are_dealt_out_once(spark):
    """Points and pairs of points stay in their tiles: only segments, and the sums of lines over several tiles, are shuffled."""
    pts = [{"x": 40.0 * i, "y": 0.0} for i in range(5)]
    d = spark.createDataFrame([(1, pts), (2, pts)], "line int, points array<struct<x:double,y:double>>")
    for m in (spatial.match_lines(d.withColumnRenamed("line", "target"), None, 12.0, 20.0, min_line=20.0), spatial.neighbours(d, 12.0, 20.0, 40.0)):
        plan = m._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 2 and "Join" not in plan


def test_spaced_peaks_of_a_dense_table(spark):
    """3,000 points within a few spacings, with copies, equal heights and points without a place: as by hand, and no pairs of points."""
    r = random.Random(12)
    pts = [(i, r.randint(-40, 40) / 2, r.randint(-40, 40) / 2, float(r.randint(1, 300))) for i in range(3000)]
    want = []
    for p in sorted(pts, key=lambda p: (-p[3], p[0])):
        if all((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 > 9 for q in want):
            want.append(p)
    bad = [(3000, None, 1.0, 999.0), (3001, float("nan"), 1.0, 999.0), (3002, 1.0, float("inf"), 999.0)]
    d = spark.createDataFrame(pts + bad, "id long, x double, y double, h double")
    assert sorted(tuple(g) for g in raster.spaced_peaks(d, "id", "h", 3.0).collect()) == sorted(want)
