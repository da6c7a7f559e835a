"""Street names, identifiers and cleaning of texts."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Directions, suffixes with their abbreviations, and how route designations look.
DIRECTIONS = ("N", "S", "E", "W", "NE", "NW", "SE", "SW", "NORTH", "SOUTH", "EAST", "WEST", "EB", "WB", "NB", "SB")
SUFFIXES = {
    "ROAD": "RD", "AVENUE": "AVE", "AV": "AVE", "BOULEVARD": "BLVD", "STREET": "ST", "HIGHWAY": "HWY", "PARKWAY": "PKWY", "LANE": "LN",
    "DRIVE": "DR", "PLACE": "PL", "COURT": "CT", "CIRCLE": "CIR", "TERRACE": "TER", "TRAIL": "TRL", "EXPRESSWAY": "EXPY", "FREEWAY": "FWY", "CROSSING": "XING",
}
ABBREVIATED = (*sorted(set(SUFFIXES.values())), "WAY", "LOOP", "CV", "SQ", "ALY", "PATH")
ROUTE_NAME = r"^(I|US|SH|SR|STATE HWY|HWY|INTERSTATE)[ -]?\d+\b"
ROUTE_NUMBER = r"\b(?:I|US|SH|SR|HWY|HIGHWAY|INTERSTATE)[ -]?(\d{1,3})\b"
SIMILAR = 0.85


def normal_street(name: Column) -> Column:
    """Upper case words without directions at the ends, suffixes abbreviated; null for blanks and route designations."""
    plain = F.trim(F.regexp_replace(F.upper(name), "[^A-Z0-9 ]", " "))
    suffixes = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    tokens = F.transform(F.filter(F.split(plain, " +"), lambda t: t != ""), lambda t: F.coalesce(F.try_element_at(suffixes, t), t))
    way = "(?:" + "|".join(sorted(DIRECTIONS, key=len, reverse=True)) + ")"
    joined = F.array_join(tokens, " ")
    joined = F.regexp_replace(F.regexp_replace(joined, f"^(?:{way} )+(?=[^ ])", ""), f"(?<=[^ ])(?: {way})+$", "")
    return F.when((joined == "") | joined.rlike(ROUTE_NAME), None).otherwise(joined)


def street_core(normal: Column) -> Column:
    """The name without suffix and spaces."""
    return F.replace(F.regexp_replace(normal, "(?<=[^ ]) (?:" + "|".join(ABBREVIATED) + ")$", ""), F.lit(" "), F.lit(""))


def route_numbers(name: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.replace(F.upper(F.coalesce(name, F.lit(""))), F.lit("-"), F.lit(" ")), F.lit(ROUTE_NUMBER), F.lit(1)))


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """How much of two texts matches block by block; no built-in function has this measure."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def names_agree(a: Column, b: Column, fuzzy: bool = True) -> Column:
    """True, False, or null where two names can't be compared."""
    ra, rb = route_numbers(a), route_numbers(b)
    ca, cb = street_core(normal_street(a)), street_core(normal_street(b))
    short, long_ = F.when(F.length(ca) <= F.length(cb), ca).otherwise(cb), F.when(F.length(ca) <= F.length(cb), cb).otherwise(ca)
    alike = F.when(F.length(short) >= 6, likeness(ca, cb) >= SIMILAR).otherwise(False) if fuzzy else F.lit(False)
    return (
        F.when((F.size(ra) > 0) & (F.size(rb) > 0), F.arrays_overlap(ra, rb)).when(ca.isNull() | cb.isNull(), None)
        .when(ca == cb, True).when((F.length(short) >= 4) & long_.startswith(short), True).otherwise(alike))


def name_key(name: Column) -> Column:
    """Lower case, with runs of anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def slug(name: Column) -> Column:
    return F.regexp_replace(name_key(name), " ", "-")


def short_id(*parts: Column) -> Column:
    """A 48-bit number from the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("long")


def null_junk(text: Column, junk: tuple[str, ...] = ("", "-", "n/a", "na", "none", "null", "unknown", "<null>")) -> Column:
    """Trimmed text, or null where it says nothing."""
    t = F.trim(text)
    return F.when(F.lower(t).isin(*junk), None).otherwise(t)


def mended(text: Column) -> Column:
    """Text that was UTF-8 read as Latin-1, read again; other text stays."""
    again = F.decode(F.encode(text, "ISO-8859-1"), "UTF-8")
    return F.when(text.rlike("[Â-ô][\u0080-¿]") & ~F.contains(again, F.lit("�")), again).otherwise(text)
