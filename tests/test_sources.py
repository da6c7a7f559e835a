import json
import sqlite3
import struct
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from metrolith.sources import feeds, geopackage, listings, sinks
from metrolith.sources.paged import PagedFeatures
from metrolith.streaming import streams


class Service:
    """Fails on pages of over three ids, and leaves one id out of any page but its own."""

    def ids(self):
        return [5, 3, 9, 1, 7, 11, 3]

    def records(self, ids):
        if len(ids) > 3:
            raise OSError("too much")
        return [{"id": i, "b": i * i, "a": "x"} for i in ids if i != 9 or len(ids) == 1]


class Broken(Service):
    def records(self, ids):
        return [{"id": i} for i in ids if i != 7]


def service():
    return Service()


def broken():
    return Broken()


def test_paged_features(spark, monkeypatch):
    import sys
    from pathlib import Path

    spark.sparkContext.addPyFile(str(Path(__file__)))
    spark.dataSource.register(PagedFeatures)
    read = lambda f: spark.read.format("paged_features").options(fetcher=f"test_sources:{f}", page=4, partitions=2).load()
    got = {r.id: json.loads(r.payload) for r in read("service").collect()}
    assert got == {i: {"a": "x", "b": i * i} for i in (1, 3, 5, 7, 9, 11)}
    with pytest.raises(Exception, match="not given"):
        read("broken").collect()


def test_csv_checked(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("x,extra,y,n\n1.5,q,2.5,3\n9,q,9,4\n")
    got = feeds.csv_checked(spark, str(p), "n int, x double, y double", ("x", "y", 0, 0, 5, 5)).collect()
    assert [tuple(r) for r in got] == [(3, 1.5, 2.5)]
    with pytest.raises(ValueError, match="lacks z"):
        feeds.csv_checked(spark, str(p), "z int")
    p.write_text("x,extra,y,n\nten,q,2.5,3\n")
    with pytest.raises(Exception):
        feeds.csv_checked(spark, str(p), "x double").collect()


def test_gtfs(spark, tmp_path):
    for name, text in {
        "routes": "route_id,route_short_name\nr1,1\nr2,2\n", "trips": "trip_id,route_id\nt1,r2\nt2,r1\n", "shapes": "shape_id,shape_pt_sequence,shape_pt_lat,shape_pt_lon\ns,10,2,20\ns,2,1,10\n",
        "stops": "stop_id,stop_name\na,A\nb,B\n", "stop_times": "trip_id,stop_id\nt1,a\nt2,a\nt1,a\n",
    }.items():
        (tmp_path / f"{name}.txt").write_text(text)
    g = feeds.gtfs(spark, str(tmp_path))
    assert [(p.x, p.y) for p in g["shapes"].first().points] == [(10.0, 1.0), (20.0, 2.0)]
    assert {r.stop_id: r.routes for r in g["stops"].collect()} == {"a": ["r1", "r2"], "b": []}


def test_nested_json_and_fixed_text(spark, tmp_path):
    raw = spark.createDataFrame([(1, '{"issued": "x", "sites": [{"id": "a", "data": [{"t": 1, "v": 2.5}, {"t": 2}]}, {"id": "b", "data": []}]}')], "n int, body string")
    got = feeds.nested_json(raw, "body", "issued string, sites array<struct<id:string,data:array<struct<t:int,v:double>>>>", ["sites", "data"])
    assert [tuple(r) for r in got.orderBy("t").collect()] == [(1, "x", "a", 1, 2.5), (1, "x", "a", 2, None)]
    p = tmp_path / "t.txt"
    p.write_text("HEAD\nabc  12 3.5\nxyz   - 4.0\n")
    got = feeds.fixed_columns(spark, str(p), [("k", 1, 3, "string"), ("n", 4, 4, "int"), ("v", 8, 4, "double")], "^[a-z]")
    assert [tuple(r) for r in got.orderBy("k").collect()] == [("abc", 12, 3.5), ("xyz", None, 4.0)]


def test_xml(spark, tmp_path):
    p = tmp_path / "a.kml"
    p.write_text("<kml><Placemark><name>s</name><Polygon><outerBoundaryIs><LinearRing><coordinates> 0,0,0 1,0 1,1 </coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark><Placemark><name>none</name></Placemark></kml>")
    got = feeds.kml_placemarks(spark, str(p)).collect()
    assert [(r.name, [(q.x, q.y) for q in r.ring]) for r in got] == [("s", [(0, 0), (1, 0), (1, 1), (0, 0)])]
    p = tmp_path / "a.gpx"
    p.write_text('<gpx><trk><trkseg><trkpt lat="1" lon="2"><time>2026-01-01T00:00:02Z</time></trkpt><trkpt lat="3" lon="4"><time>2026-01-01T00:00:01Z</time></trkpt></trkseg></trk></gpx>')
    assert [(r.lat, r.lon) for r in feeds.gpx_points(spark, str(p)).collect()] == [(3.0, 4.0), (1.0, 2.0)]


def test_polyline(spark):
    df = spark.createDataFrame([("_p~iF~ps|U_ulLnnqC_mqNvxq`@",), ("",)], "p string")
    got = [[(round(p.x, 5), round(p.y, 5)) for p in r[0]] for r in df.select(feeds.decode_polyline(F.col("p"))).collect()]
    assert got == [[(-120.2, 38.5), (-120.95, 40.7), (-126.453, 43.252)], []]


def test_geopackage(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "a.gpkg")
    db.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
    db.execute("insert into gpkg_geometry_columns values ('roads', 'shape')")
    db.execute("create table roads (fid integer, shape blob, name text)")
    line = struct.pack("<2sBBi", b"GP", 0, 1, 4326) + struct.pack("<BII", 1, 2, 2) + struct.pack("<4d", 1, 2, 3, 4)
    ring = struct.pack("<2sBBi", b"GP", 0, 3, 26911) + struct.pack("<4d", 0, 1, 0, 1) + struct.pack("<BIII", 1, 1003, 1, 3) + struct.pack("<9d", 0, 0, 9, 1, 0, 9, 1, 1, 9)
    db.executemany("insert into roads values (?, ?, ?)", [(1, line, "A"), (2, ring, None)])
    db.commit()
    db.close()
    got = {json.loads(r.attributes)["fid"]: r for r in geopackage.layer(spark, str(tmp_path / "*.gpkg"), "roads").collect()}
    assert got[1].srs == 4326 and [(p.x, p.y) for p in got[1].points] == [(1, 2), (3, 4)]
    assert got[2].srs == 26911 and [(p.x, p.y) for p in got[2].points] == [(0, 0), (1, 0), (1, 1)]


def test_listed_files(spark):
    html = '<a href="../">up</a>\n<a href="smoke1.kml">smoke1.kml</a>   2026-10-06 12:30  4.0K\n<a href="smoke2.kml">x</a> 2026-10-07 01:00  17\n'
    got = listings.listed_files(spark.createDataFrame([(1, html)], "k int, html string"), "k", "html").orderBy("file").collect()
    assert [(r.file, r.modified, r.size) for r in got] == [("smoke1.kml", datetime(2026, 10, 6, 12, 30), 4096), ("smoke2.kml", datetime(2026, 10, 7, 1), 17)]


def test_ownership_of_tags(spark):
    ways = spark.createDataFrame([(1, {"highway": "path"}), (2, {"waterway": "canal", "highway": "path"}), (3, {})], "id int, tags map<string,string>")
    tag = lambda k: F.col("tags")[k]
    got = feeds.tagged(ways, {"water": tag("waterway").isNotNull(), "trails": tag("highway") == "path"}).orderBy("id").collect()
    assert [r.owner for r in got] == ["trails", "water", None]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 10.0, 20.0, "a", datetime(2026, 1, 1)), (2, 10.0, 20.0, None, datetime(2026, 1, 2))], "id long, x double, y double, name string, at timestamp_ntz")
    got = [json.loads(r.value) for r in sinks.geojson_features(df, "Point", F.struct("x", "y"), ["id", "name"]).collect()]
    assert got[0] == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [10.0, 20.0]}, "properties": {"id": 1, "name": "a"}}
    for _ in range(2):
        sinks.write_archive(df, str(tmp_path / "raw"), "at")
    assert spark.read.parquet(str(tmp_path / "raw")).groupBy("date").count().orderBy("date").collect()[0]["count"] == 1
    tiles = sinks.vector_tiles(df, "stops", "id", "x", "y", 4, ["name"]).collect()
    assert len(tiles) == 1 and tiles[0].features == 2
    body = bytes(tiles[0].tile)
    assert body[0] == 0x1A and b"stops" in body and b"name" in body and sinks.packed(body)[:2] == b"\x1f\x8b"


def test_stream_equals_batch_over_many_files(spark, tmp_path):
    """Files read one by one, out of order and twice, give what one batch gives."""
    from metrolith.io import table

    e = table(spark, "/root/testdata/sf0.001", "events").where("user_id < 8")
    root = str(tmp_path / "in")
    for i in range(4):
        e.where(F.col("event_id") % 4 == i).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{root}/events.parquet")
    e.where("event_id % 4 = 1").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{root}/events.parquet")
    s = spark.readStream.schema(spark.read.parquet(f"{root}/events.parquet").schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/events.parquet")
    got = streams.run_available(streams.once_by_key(s, ["event_id"], "ts", "60 days"), "append")
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in e.collect())
    late = streams.run_available(streams.mark_late(s.select(F.col("user_id").cast("string").alias("key"), F.unix_seconds("ts").cast("double").alias("ts"), F.col("event_id").alias("id"))), "append")
    placed = {r.placed for r in late.collect()}
    assert {"newest", "late"} <= placed <= {"newest", "late", "earlier"}


def test_late_rows_by_hand(spark, tmp_path):
    """Batch by batch: between the newest and the oldest is late, before the oldest a chain of its own."""
    root = str(tmp_path / "late")
    schema = "key string, ts double, id long"
    for i, rows in enumerate(([("a", 10.0, 1), ("a", 20.0, 2), ("b", 5.0, 3)], [("a", 15.0, 4), ("a", 25.0, 5), ("a", 3.0, 6)], [("a", 4.0, 7), ("a", 2.0, 8), ("a", 25.0, 9), ("b", 6.0, 10)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(root)
        time.sleep(1.1)  # files are read in the order of their times
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(root)
    got = {r.id: r.placed for r in streams.run_available(streams.mark_late(s), "append").collect()}
    assert got == {1: "newest", 2: "newest", 3: "newest", 4: "late", 5: "newest", 6: "earlier", 7: "late", 8: "earlier", 9: "newest", 10: "newest"}


def test_snapshot_table(spark, tmp_path):
    t = streams.SnapshotTable(spark, str(tmp_path / "t"))
    snap = lambda *r: spark.createDataFrame(list(r), "source_id string, content_hash string")
    at = lambda n: F.lit(f"2026-01-0{n} 00:00:00").cast("timestamp_ntz")
    assert t.merge(snap(("a", "1")), 0, at(1))
    assert not t.merge(snap(("a", "1")), 1, at(2))  # same digest: a heartbeat only
    assert t.merge(snap(("b", "1")), 2, at(3))
    assert t.merge(snap(("b", "1"), ("a", "1")), 2, at(3))  # the batch again, with more: it replaces itself
    got = {r.source_id: r.active for r in t.at(2).collect()}
    assert got == {"a": True, "b": True} and t.versions == [0, 2] and t.heartbeats == [0, 1, 2]
    again = streams.SnapshotTable(spark, str(tmp_path / "t"))  # a stream that starts again goes on where it was
    assert again.versions == [0, 2] and not again.merge(snap(("b", "1"), ("a", "1")), 3, at(4))
    assert again.merge(snap(("b", "1")), 4, at(5)) and {r.source_id: r.active for r in again.at(4).collect()} == {"a": False, "b": True}
