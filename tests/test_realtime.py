import struct

import pytest

from metrolith.sources import realtime


def field(number, value):
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    if isinstance(value, int):
        out = b""
        while value > 127:
            out, value = out + bytes([value & 127 | 128]), value >> 7
        return bytes([number << 3]) + out + bytes([value])
    value = value.encode() if isinstance(value, str) else value
    assert len(value) < 128
    return bytes([number << 3 | 2, len(value)]) + value


def entity(id_, *vehicle):
    return field(2, field(1, id_) + field(4, b"".join(vehicle)))


PLACE = field(2, field(1, 43.5) + field(2, -116.25) + field(3, 90.0))
FEED = field(1, field(1, "2.0") + field(3, 1_700_000_000)) + b"".join([
    entity("e1", field(1, field(1, "t1") + field(5, "r1")), PLACE, field(3, 7), field(4, 2), field(5, 1_700_000_100), field(7, "s9"), field(8, field(1, "bus 1") + field(2, "B1"))),
    entity("e2", PLACE),
    entity("e3", field(8, field(1, "no place"))),
    field(2, field(1, "no vehicle")),
])


def test_vehicle_positions(spark, tmp_path):
    (tmp_path / "a.pb").write_bytes(FEED)
    (tmp_path / "empty.pb").write_bytes(b"")
    df = realtime.vehicle_positions(spark, str(tmp_path)).selectExpr("*", "unix_timestamp(ts) at", "unix_timestamp(feed_ts) feed_at").drop("ts", "feed_ts")
    first, second = sorted((r.asDict() for r in df.collect()), key=lambda r: r["vehicle_id"])
    assert first == dict(path="a.pb", vehicle_id="bus 1", vehicle_label="B1", trip_id="t1", route_id="r1", lon=-116.25, lat=43.5, bearing=90.0, speed_ms=None, stop_id="s9", stop_sequence=7, status=2, at=1_700_000_100, feed_at=1_700_000_000)
    assert (second["vehicle_id"], second["at"], second["trip_id"], second["status"]) == ("e2", 1_700_000_000, None, None)


def test_cut_off_feed():
    with pytest.raises((ValueError, IndexError)):
        list(realtime.positions(FEED[:-5]))
