"""Newest row by key, top rows by group, and as-of joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _columns(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order. State nulls in the order; ties beyond it are the caller's."""
    return top_per_group(df, keys, order, 1).drop("rank")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key with their rank, from 1. Spark limits groups before it shuffles them."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def latest_per_key(df: DataFrame, keys: Sequence[str], by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """For each key the values of the row with the greatest `by`, ties broken by the values; no sort, partial aggregation."""
    top = F.max(F.struct(*by, *[v for v in values if v not in by])).alias("_top")
    return df.groupBy(*keys).agg(top).select(*keys, *[F.col(f"_top.{v}").alias(v) for v in values])


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, values: Sequence[str]) -> DataFrame:
    """Each left row with the values of the newest right row of its key that is not after it; nulls if there is none.

    Both sides are sorted once by (key, time) and the last value is carried forward, so a hot key costs a sort and never
    a product. `values` must not be among the left's columns.
    """
    held = F.struct(*values)
    rows = left.select(*keys, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(held.alias("h")).schema["h"].dataType).alias("_held"))
    facts = right.select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(rows.schema["_left"].dataType).alias("_left"), held.alias("_held"))
    carried = Window.partitionBy(*keys).orderBy("_at", "_side", "_held").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.unionByName(facts).withColumn("_held", F.last("_held", ignorenulls=True).over(carried)).where("_side = 1")
    return out.select("_left.*", *[F.col(f"_held.{v}").alias(v) for v in values])


def as_of_within(left: DataFrame, right: DataFrame, keys: Sequence[str], left_day: str, right_day: str, back: int, order: Sequence[Column], left_id: Sequence[str]) -> DataFrame:
    """The best right row whose day is the left's or up to `back` days earlier: an equality join on spans of back + 1 days, then a rank.

    Right rows stand in two spans, so that left rows meet all of theirs in their own. Sides are merged, never broadcast: by
    its estimated size a table would be taken for smaller than its copies are."""
    span = lambda day, n: F.floor((F.unix_date(F.col(day).cast("date")) + n) / F.lit(back + 1))
    days = right.withColumn("_span", F.explode(F.array(span(right_day, 0), span(right_day, back + 1)))).hint("merge")
    l = left.withColumn("_span", span(left_day, 0)).alias("l")
    met = F.col(f"r.{right_day}").between(F.date_sub(F.col(f"l.{left_day}"), back), F.col(f"l.{left_day}"))
    for c in [*keys, "_span"]:
        met = met & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    others = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    joined = l.join(days.alias("r"), met, "left").select(*[F.col(f"l.{c}") for c in left.columns], *others)
    return distinct_on(joined, left_id, order)


def prune_newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: int, protected: Column) -> DataFrame:
    """Retention: the newest `keep` rows of each key, and protected ones whatever their age."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where((F.col("_rank") <= keep) | protected).drop("_rank")


def natural_order(name: str) -> list[Column]:
    """Numbers before texts, numbers by value: how routes are listed."""
    number = F.try_to_number(F.col(name), F.lit("999999999")).cast("long")
    return [number.isNull(), number, F.col(name)]
