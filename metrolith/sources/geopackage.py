"""GeoPackage (SQLite) layers, read from bytes, so that files may be on any store that Spark reads."""

from __future__ import annotations

import json
import sqlite3
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def geometry(blob: bytes) -> tuple[int, list[tuple[float, float]]]:
    """(srs id, points) of a point, line or polygon's outer ring in GeoPackage binary: a header, then well-known binary."""
    if blob[:2] != b"GP":
        raise ValueError("not a GeoPackage geometry")
    order = "<" if blob[3] & 1 else ">"
    srs = struct.unpack(order + "i", blob[4:8])[0]
    at = 8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[blob[3] >> 1 & 7]

    def read(at: int) -> tuple[list[tuple[float, float]], int]:
        order = "<" if blob[at] == 1 else ">"
        kind = struct.unpack(order + "I", blob[at + 1 : at + 5])[0]
        width = 8 * (2 + (kind // 1000 in (1, 2)) + 2 * (kind // 1000 == 3))
        at, kind = at + 5, kind % 1000

        def points(at: int, n: int):
            return [struct.unpack(order + "dd", blob[at + i * width : at + i * width + 16]) for i in range(n)], at + n * width

        if kind == 1:
            return points(at, 1)
        n = struct.unpack(order + "I", blob[at : at + 4])[0]
        at += 4
        if kind == 2:
            return points(at, n)
        first: list = []
        for i in range(n):  # rings of a polygon, or parts of a multi geometry: the first is kept
            if kind == 3:
                m = struct.unpack(order + "I", blob[at : at + 4])[0]
                got, at = points(at + 4, m)
            else:
                got, at = read(at)
            first = first or got
        return first, at

    return srs, read(at)[0]


def layer(spark: SparkSession, path: str, table: str) -> DataFrame:
    """(file, srs, points, attributes): the rows of a layer in every GeoPackage at the path; a file is read in one task."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                db = sqlite3.connect(":memory:")
                db.deserialize(bytes(content))
                column = db.execute("select column_name from gpkg_geometry_columns where table_name = ?", (table,)).fetchone()[0]
                cursor = db.execute('select * from "' + table.replace('"', '""') + '"')
                names = [d[0] for d in cursor.description]
                while got := cursor.fetchmany(5000):
                    out = []
                    for r in got:
                        r = dict(zip(names, r))
                        srs, points = geometry(r.pop(column))
                        out.append((name, srs, [{"x": x, "y": y} for x, y in points], json.dumps(r, default=str)))
                    yield pd.DataFrame(out, columns=["file", "srs", "points", "attributes"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(rows, "file string, srs int, points array<struct<x:double,y:double>>, attributes string")
