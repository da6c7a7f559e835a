"""Sinks: GeoJSON features, vector tiles, dated archives, versioned tables."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrolith.functions import geo


def geojson_features(df: DataFrame, kind: str, coordinates: Column, properties: Sequence[str], digits: int = 6) -> DataFrame:
    """One GeoJSON feature for each row, as a text; coordinates are a (x, y) struct, or an array of them for lines."""
    pair = lambda p: F.array(F.round(p["x"], digits), F.round(p["y"], digits))
    shape = pair(coordinates) if kind == "Point" else F.transform(coordinates, pair)
    shape = F.array(shape) if kind == "Polygon" else shape
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), shape.alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def write_archive(df: DataFrame, root: str, at: str) -> None:
    """Raw rows by date of `at`; a date's folder is replaced whole, so that a repeated write changes nothing."""
    df.withColumn("date", F.to_date(at)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(root)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _zigzag(n: int) -> int:
    return n << 1 ^ n >> 63


def point_tile(name: str, features: list[tuple[int, int, int, dict]], extent: int = 4096) -> bytes:
    """A vector tile of one layer of points: (id, x, y, properties) in tile units, by the public vector tile format 2."""
    keys: dict[str, int] = {}
    values: dict[tuple, int] = {}
    out = [b"\x78\x02", _field(1, name.encode())]
    for i, x, y, props in features:
        tags = []
        for k, v in props.items():
            if v is not None:
                tags += [keys.setdefault(k, len(keys)), values.setdefault((type(v).__name__, v), len(values))]
        geometry = [1 << 3 | 1, _zigzag(x), _zigzag(y)]
        body = b"\x08" + _varint(i) + _field(2, b"".join(map(_varint, tags))) + b"\x18\x01" + _field(4, b"".join(map(_varint, geometry)))
        out.append(_field(2, body))
    out += [_field(3, k.encode()) for k in keys]
    for _, v in values:
        out.append(_field(4, b"\x38" + bytes([v]) if isinstance(v, bool) else b"\x20" + _varint(v & (1 << 64) - 1) if isinstance(v, int) else b"\x19" + struct.pack("<d", v) if isinstance(v, float) else _field(1, str(v).encode())))
    return _field(3, b"".join(out) + b"\x28" + _varint(extent))


def vector_tiles(df: DataFrame, layer: str, key: str, lon: str, lat: str, zoom: int, properties: Sequence[str], extent: int = 4096, most: int = 50_000) -> DataFrame:
    """(z, tx, ty, features, tile): gzip-able vector tiles of points, in key order within a tile.

    A tile holds at most `most` features, those of the smallest keys, as tile servers do; `features` counts all.
    """
    n = 2**zoom
    r = F.radians(lat)
    fx, fy = (F.col(lon) + 180) / 360 * n, (1 - F.log(F.tan(r) + 1 / F.cos(r)) / 3.141592653589793) / 2 * n
    p = df.select(F.col(key).cast("long").alias("_id"), geo.tile_x(F.col(lon), zoom).alias("tx"), geo.tile_y(F.col(lat), zoom).alias("ty"),
                  F.floor((fx - F.floor(fx)) * extent).cast("int").alias("_x"), F.floor((fy - F.floor(fy)) * extent).cast("int").alias("_y"), *properties)
    from pyspark.sql import Window

    w = Window.partitionBy("tx", "ty")
    p = p.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy("_id"))).where(F.col("_r") <= most)

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_r")
        rows = [(int(i), int(x), int(y), {k: v.item() if hasattr(v, "item") else v for k, v in zip(properties, props)}) for i, x, y, *props in pdf[["_id", "_x", "_y", *properties]].itertuples(index=False)]
        return pd.DataFrame({"z": [zoom], "tx": [int(pdf["tx"].iloc[0])], "ty": [int(pdf["ty"].iloc[0])], "features": [int(pdf["_n"].iloc[0])], "tile": [point_tile(layer, rows, extent)]})

    return p.groupBy("tx", "ty").applyInPandas(cut, "z int, tx long, ty long, features long, tile binary")


def packed(tile: bytes) -> bytes:
    """A tile as servers send it."""
    c = zlib.compressobj(9, zlib.DEFLATED, 31)
    return c.compress(tile) + c.flush()
