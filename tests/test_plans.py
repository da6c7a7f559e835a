from datetime import datetime

import pytest
from pyspark.sql import functions as F

from metrolith.functions import color
from metrolith.plans import scheduler
from metrolith.sources import robots


def test_robots(spark):
    text = "User-agent: *\nDisallow: /\n\nUser-agent: metro\nUser-agent: other\nDisallow: /a/  # no\nAllow: /a/b\nDisallow: /*.pdf$\nCrawl-delay: 5\n"
    rules, delay = robots.parse(text, "Metro/1.0")
    assert delay == 5.0
    paths = ["/", "/a/x", "/a/b/c", "/x.pdf", "/x.pdf?y", "/a/b.pdf"]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(robots.allowed(F.col("p"), rules)).collect()]
    assert got == [True, False, True, False, True, False]
    assert robots.parse(text, "nobody")[0] == [(False, "/")]


def test_scheduler(spark):
    done = []
    r = scheduler.Registry()
    r.add("b", lambda s: done.append("b"), 3600, needs=("a",))
    r.add("a", lambda s: done.append("a"), 3600)
    r.add("bad", lambda s: 1 / 0, 60, order=-1)
    r.add("stream", lambda s: done.append("stream"), stale_s=60)
    with pytest.raises(ValueError):
        r.add("a", print)
    with pytest.raises(ValueError):
        r.add("c", print, 1, 1)
    log = spark.createDataFrame([], scheduler.FETCHES)
    log = r.run_due(spark, log, datetime(2026, 1, 1, 12))
    assert done == ["a", "b"] and {(x.source, x.ok) for x in log.collect()} == {("a", True), ("b", True), ("bad", False)}
    assert log.where("source = 'bad'").first().error.startswith("ZeroDivisionError")
    log = r.run_due(spark, log, datetime(2026, 1, 1, 12, 30))
    assert done == ["a", "b"] and log.where("source = 'bad'").count() == 2
    log = r.run_due(spark, log, datetime(2026, 1, 1, 13))
    assert done == ["a", "b"] * 2
    assert scheduler.pull_since(log, "a", 600).first().since == datetime(2026, 1, 1, 12, 50)


def test_reads_are_watched(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    scheduler.check_reads(df, {"/root/testdata/sf0.001"})
    with pytest.raises(PermissionError):
        scheduler.check_reads(df, {"/elsewhere"})


def test_sql_functions(spark):
    scheduler.register_functions(spark)
    assert spark.sql("SELECT surface_class('gravel'), no_public_access(map('access', 'private')), no_public_access(map('access', 'private', 'foot', 'yes'))").first()[:] == ("gravel", True, False)
    assert [tuple(r) for r in spark.sql("SELECT * FROM line_points(0D, 0D, 10D, 0D, 4D)").collect()] == [(0, 0.0, 0.0), (1, pytest.approx(10 / 3), 0.0), (2, pytest.approx(20 / 3), 0.0), (3, 10.0, 0.0)]


def test_colours_and_units(spark):
    d = spark.range(1)
    l, a, b = color.oklab(F.lit("#ff0000"))
    r = d.select(l.alias("l"), a.alias("a"), b.alias("b"), color.contrast(F.lit("#000000"), F.lit("#ffffff")).alias("c"), color.difference(F.lit("#123456"), F.lit("#123456")).alias("d"),
                 color.kp_thirds(F.lit(4.33)).alias("k1"), color.kp_thirds(F.lit(4.67)).alias("k2"), color.kp_thirds(F.lit(5.0)).alias("k3"), color.with_clock(F.lit("2026-01-02").cast("date"), F.lit("7:30")).alias("t"), color.with_clock(F.lit("2026-01-02").cast("date"), F.lit("99")).alias("m")).first()
    assert (round(r.l, 3), round(r.a, 3), round(r.b, 3)) == (0.628, 0.225, 0.126) and round(r.c, 6) == 21 and r.d == 0
    assert (r.k1, r.k2, r.k3) == ("4+", "5-", "5o") and (r.t, r.m) == (datetime(2026, 1, 2, 7, 30), datetime(2026, 1, 2))


def test_line_queries_take_every_order(spark, tmp_path):
    """Orders that no modulo picks: three alike and one far off, by hand."""
    from metrolith.plans.queries import QUERIES

    lines = {1: [25.0, 25.0, 25.0], 401: [15.0, 15.0, 15.0], 801: [7.0, 7.0, 7.0], 1201: [45.0, 45.0, 45.0]}
    rows = [(k, n, q) for k, v in lines.items() for n, q in enumerate(v, start=1)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    pairs = {(a, b) for a in (1, 401, 801) for b in (1, 401, 801) if a != b}
    match = QUERIES["line_match"](spark, str(tmp_path)).collect()
    assert {(r.target, r.line) for r in match} == pairs and all(r.share == 1.0 and r.confidence == 1.0 for r in match)
    near = QUERIES["line_neighbours"](spark, str(tmp_path)).collect()
    # They lie at 25, 25 and 27, within 8 of each other.
    assert {(r.line, r.other) for r in near} == pairs and all(r.shared_m == 80.0 for r in near)
