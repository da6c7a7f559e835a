"""Colours, indices and units as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The public sRGB, OKLab and WCAG constants.
LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))


def linear(v: Column) -> Column:
    """An sRGB channel of 0 to 1, without its gamma."""
    return F.when(v <= 0.04045, v / 12.92).otherwise(((v + 0.055) / 1.055) ** 2.4)


def channels(hex_: Column) -> tuple[Column, Column, Column]:
    """r, g and b of 0 to 1 of a text like #1e90ff."""
    part = lambda at: F.conv(F.substring(hex_, at, 2), 16, 10).cast("double") / 255
    return part(2), part(4), part(6)


def oklab(hex_: Column) -> tuple[Column, Column, Column]:
    """(L, a, b)."""
    rgb = [linear(c) for c in channels(hex_)]
    lms = [F.cbrt(sum((k * c for k, c in zip(row, rgb)), F.lit(0.0))) for row in LMS]
    return tuple(sum((k * c for k, c in zip(row, lms)), F.lit(0.0)) for row in LAB)


def difference(a: Column, b: Column) -> Column:
    """The distance of two colours in OKLab."""
    return F.sqrt(sum(((x - y) ** 2 for x, y in zip(oklab(a), oklab(b))), F.lit(0.0)))


def luminance(hex_: Column) -> Column:
    r, g, b = (linear(c) for c in channels(hex_))
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def contrast(a: Column, b: Column) -> Column:
    """The contrast ratio, 1 to 21."""
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def ndvi(nir: Column, red: Column) -> Column:
    return (nir - red) / F.nullif(nir + red, F.lit(0.0))


def feet(metres: Column) -> Column:
    return metres / 0.3048


def mph(kmh: Column) -> Column:
    return kmh / 1.609344


def kp_thirds(kp: Column) -> Column:
    """An index in thirds as it is written: 4.33 is 4+, 4.67 is 5-."""
    n = F.round(kp * 3).cast("int")
    return F.concat(F.floor((n + 1) / 3).cast("string"), F.element_at(F.array(F.lit("o"), F.lit("+"), F.lit("-")), n % 3 + 1))


def from_epoch_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def with_clock(day: Column, clock: Column) -> Column:
    """A date with a time like 0730, 7:30 or 730; midnight where the time says nothing."""
    digits = F.lpad(F.regexp_replace(F.coalesce(clock, F.lit("")), "[^0-9]", ""), 4, "0")
    ok = digits.rlike("^([01][0-9]|2[0-3])[0-5][0-9]$")
    minutes = F.when(ok, F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int")).otherwise(0)
    return F.timestamp_seconds(F.unix_date(day).cast("long") * 86400 + minutes * 60)
