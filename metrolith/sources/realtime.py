"""Vehicle positions of a GTFS-realtime feed (public protobuf format), read by Spark as binary files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "path string, ts timestamp, vehicle_id string, vehicle_label string, trip_id string, route_id string, lon double, lat double, bearing float, "
    "speed_ms float, stop_id string, stop_sequence int, status int, feed_ts timestamp"
)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message: integers, floats, and bytes for what has a length."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 1:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        elif kind == 2:
            size, at = _varint(data, at)
            if at + size > len(data):
                raise ValueError("a field ends after its message")
            value, at = data[at:at + size], at + size
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


def positions(data: bytes) -> Iterator[tuple]:
    """Rows of one feed, as SCHEMA without the path; entities without a vehicle, a position, an id or a time go."""
    message = list(fields(data))
    at = next((v for n, b in message if n == 1 for m, v in fields(b) if m == 3), None)
    text = lambda m, n: m[n].decode() if m.get(n) else None
    for entity in (dict(fields(b)) for n, b in message if n == 2):
        v = dict(fields(entity[4])) if 4 in entity else {}
        if 2 not in v:
            continue
        trip, place, vehicle = dict(fields(v.get(1, b""))), dict(fields(v[2])), dict(fields(v.get(8, b"")))
        who, when = text(vehicle, 1) or text(vehicle, 2) or text(entity, 1), v.get(5) or at
        if who and when:
            yield when, who, text(vehicle, 2), text(trip, 1), text(trip, 5), place.get(2, 0.0), place.get(1, 0.0), place.get(3), place.get(5), text(v, 7), v.get(3), v.get(4), at or None


def vehicle_positions(spark: SparkSession, path: str) -> DataFrame:
    """Positions of all feed files under a path. A file that isn't a feed fails the read."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                rows = pd.DataFrame([(file, *r) for r in positions(bytes(content))], columns=names)
                for c in ("ts", "feed_ts"):
                    rows[c] = pd.to_datetime(rows[c], unit="s", utc=True)
                yield rows.astype({"stop_sequence": "Int32", "status": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, SCHEMA).withColumn("path", F.element_at(F.split("path", "/"), -1))
