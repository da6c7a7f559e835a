"""Weighted, distributional and categorical statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_mean(value: Column, weight: Column) -> Column:
    """Rows without a value don't weigh."""
    w = F.when(value.isNotNull(), weight)
    return F.sum(value * w) / F.nullif(F.sum(w), F.lit(0))


def shares(df: DataFrame, group: Sequence[str], part: Sequence[str], weight: Column) -> DataFrame:
    """Each part's share of its group's weight."""
    s = df.groupBy(*group, *part).agg(F.sum(weight).alias("weight"))
    return s.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy(*group)))


def mode(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """The commonest value of each group; ties go to the smallest."""
    c = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), value))
    return c.withColumn("_r", first).where("_r = 1").drop("_r")


def accumulate(df: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """Sums that can be merged: n, sums, squares and products. merge() adds them up, finish() reads them."""
    return df.groupBy(*group).agg(F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"), *[F.sum(e).alias(a) for a, e in (
        ("sx", F.col(x)), ("sy", F.col(y)), ("sxx", F.col(x) * F.col(x)), ("syy", F.col(y) * F.col(y)), ("sxy", F.col(x) * F.col(y)))])


def merge(parts: DataFrame, group: Sequence[str]) -> DataFrame:
    return parts.groupBy(*group).agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def finish(sums: DataFrame) -> DataFrame:
    """Means, sample covariance and correlation."""
    cov = lambda a, b, p: (F.col(p) - F.col(a) * F.col(b) / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0))
    s = sums.withColumn("mean_x", F.col("sx") / F.col("n")).withColumn("mean_y", F.col("sy") / F.col("n"))
    s = s.withColumn("cov_xy", cov("sx", "sy", "sxy")).withColumn("_vx", cov("sx", "sx", "sxx")).withColumn("_vy", cov("sy", "sy", "syy"))
    return s.withColumn("corr", F.col("cov_xy") / F.nullif(F.sqrt(F.col("_vx") * F.col("_vy")), F.lit(0.0))).drop("_vx", "_vy")


def histogram(df: DataFrame, group: Sequence[str], value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(group, bin, n); values outside go to the end bins."""
    b = F.least(F.greatest(F.floor((F.col(value) - lo) / (hi - lo) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).isNotNull()).groupBy(*group, b.alias("bin")).agg(F.count("*").alias("n"))


def histogram_quantile(hist: DataFrame, group: Sequence[str], q: float, lo: float, hi: float, bins: int) -> DataFrame:
    """A quantile from a histogram, by interpolation within the bin where the running count passes q of all."""
    w = Window.partitionBy(*group)
    h = hist.withColumn("_cum", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("n").over(w))
    h = h.where(F.col("_cum") >= q * F.col("_all")).withColumn("_r", F.row_number().over(w.orderBy("bin"))).where("_r = 1")
    inside = (q * F.col("_all") - (F.col("_cum") - F.col("n"))) / F.col("n")
    return h.select(*group, (lo + (F.col("bin") + inside) * ((hi - lo) / bins)).alias("quantile"))


def otsu(hist: DataFrame, group: Sequence[str]) -> DataFrame:
    """The bin that parts a histogram with the greatest variance between the two sides; ties to the lower bin."""
    w = Window.partitionBy(*group)
    run = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    h = hist.withColumn("n0", F.sum("n").over(run)).withColumn("s0", F.sum(F.col("n") * F.col("bin")).over(run))
    h = h.withColumn("n1", F.sum("n").over(w) - F.col("n0")).withColumn("s1", F.sum(F.col("n") * F.col("bin")).over(w) - F.col("s0")).where("n1 > 0")
    between = F.col("n0") * F.col("n1") * (F.col("s0") / F.col("n0") - F.col("s1") / F.col("n1")) ** 2
    first = F.row_number().over(w.orderBy(F.desc("between"), "bin"))
    return h.withColumn("between", between).withColumn("_r", first).where("_r = 1").select(*group, F.col("bin").alias("threshold_bin"), "between")


def average_rank(value: str, group: Sequence[str]) -> Column:
    """Ranks from 1, ties by their mean."""
    w = Window.partitionBy(*group)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*group, value)) - 1) / 2


def spearman(df: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation by group."""
    r = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_x", average_rank(x, group)).withColumn("_y", average_rank(y, group))
    return r.groupBy(*group).agg(F.corr("_x", "_y").alias("rho"), F.count("*").alias("n"))


def best_cycle(df: DataFrame, group: Sequence[str], seconds: Column, cycles: Sequence[float]) -> DataFrame:
    """The cycle in whose phase the times agree most: the greatest mean resultant length; ties to the shorter cycle.

    All cycles are summed in one pass: no row is repeated for them.
    """
    sums = []
    for i, c in enumerate(cycles):
        a = seconds * (2 * math.pi / c)
        sums += [F.sum(F.cos(a)).alias(f"c{i}"), F.sum(F.sin(a)).alias(f"s{i}")]
    s = df.groupBy(*group).agg(F.count("*").alias("n"), *sums)
    each = F.array(*[F.struct((F.sqrt(F.col(f"c{i}") ** 2 + F.col(f"s{i}") ** 2) / F.col("n")).alias("resultant"), F.lit(-float(c)).alias("minus")) for i, c in enumerate(cycles)])
    best = F.array_max(each)
    return s.select(*group, "n", (-best["minus"]).alias("cycle"), best["resultant"].alias("resultant"))


def agreement(df: DataFrame, group: Sequence[str], match: Column) -> DataFrame:
    """How many of a zone's cells match, of how many."""
    a = df.groupBy(*group).agg(F.count_if(match).alias("matching"), F.count("*").alias("total"))
    return a.withColumn("agreement", F.col("matching") / F.col("total"))


def flows(df: DataFrame, origin: str, destination: str, weight: Column, inside: Sequence, other="other") -> DataFrame:
    """An origin-destination table over the members of `inside`; the rest is one column."""
    to = F.when(F.col(destination).isin(list(inside)), F.col(destination).cast("string")).otherwise(other)
    return df.withColumn("_to", to).groupBy(origin).pivot("_to", [*map(str, inside), other]).agg(F.sum(weight)).na.fill(0)


def pooled(df: DataFrame, levels: Sequence[Sequence[str]], value: str, least: Sequence[int]) -> DataFrame:
    """For each key of the finest level the mean at the first level that has enough rows: finest first, then coarser ones.

    levels[i] are the columns of level i (none: the whole), which the finest holds all; least[i] is how many rows it needs.
    """
    finest = list(levels[0])
    out = df.select(*finest).distinct()
    picked, at = F.lit(None).cast("double"), F.lit(None).cast("int")
    for i, l in enumerate(levels):
        each = (df.groupBy(*l) if l else df).agg(F.avg(value).alias(f"_m{i}"), F.count(value).alias(f"_n{i}"))
        out = out.join(each, list(l)) if l else out.crossJoin(F.broadcast(each))  # the whole is one row
    for i in reversed(range(len(levels))):
        enough = F.col(f"_n{i}") >= least[i]
        picked, at = F.when(enough, F.col(f"_m{i}")).otherwise(picked), F.when(enough, i).otherwise(at)
    return out.select(*finest, picked.alias("pooled"), at.alias("level"))


def spend(df: DataFrame, order: Sequence[Column], cost: str, budget: float, group: Sequence[str] = ()) -> DataFrame:
    """The plan by priority: rows in order while the running cost stays within the budget."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)


def spend_skipping(df: DataFrame, group: Sequence[str], order: Sequence[str], cost: str, budget: float) -> DataFrame:
    """The plan by priority that skips what no longer fits and goes on: what is taken depends on all before, so each
    group is walked in order. Groups are plans of one round, which are short."""
    import pandas as pd

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        left, keep = budget, []
        for c in pdf[cost]:
            keep.append(c <= left)
            left -= c if keep[-1] else 0
        return pdf[keep]

    return df.groupBy(*group).applyInPandas(walk, df.schema)


def looked_up(df: DataFrame, tables: Sequence[tuple[DataFrame, str, str]], value: str, default: Column | None = None) -> DataFrame:
    """A value from the first table that knows the row: (table, the row's key, the table's key) in turn, then the default."""
    found = []
    for i, (t, own, key) in enumerate(tables):
        one = t.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_k{i}")).agg(F.min(value).alias(f"_v{i}"))
        df = df.join(one, df[own] == one[f"_k{i}"], "left").drop(f"_k{i}")
        found.append(F.col(f"_v{i}"))
    df = df.withColumn(value, F.coalesce(*found, *([default] if default is not None else [])))
    return df.drop(*[f"_v{i}" for i in range(len(tables))])


def visible(df: DataFrame, cls: str, least_zoom: dict[str, int], zoom: int) -> DataFrame:
    """Rows whose class shows at a zoom; classes that aren't listed never do."""
    return df.where(F.col(cls).isin([c for c, z in least_zoom.items() if z <= zoom]))


def sweep(df: DataFrame, keys: Sequence[str], value: str, thresholds: Sequence[float], weight: str) -> DataFrame:
    """For each of some thresholds how many rows of a key it keeps and drops, and the weight that it keeps.

    One pass: the thresholds are columns of the aggregation, no row is repeated for them.
    """
    keep = lambda t: F.col(value) >= t
    each = [F.struct(F.lit(float(t)).alias("threshold"), F.count_if(keep(t)).alias("kept"), F.count_if(~keep(t)).alias("dropped"), F.coalesce(F.sum(F.when(keep(t), F.col(weight))), F.lit(0.0)).alias("weight")).alias(f"t{i}") for i, t in enumerate(thresholds)]
    d = df.groupBy(*keys).agg(*each)
    return d.select(*keys, F.inline(F.array(*[F.col(f"t{i}") for i in range(len(thresholds))])))


def year_columns(wide: DataFrame, key: str, pattern: str) -> DataFrame:
    """(key, year, measure, value): columns whose names tell a measure and a year, as rows; empty ones make none."""
    import re

    told = [(c, m) for c in wide.columns if (m := re.match(pattern, c))]
    rows = F.array(*[F.struct(F.lit(int(m[2])).alias("year"), F.lit(m[1].lower()).alias("measure"), F.col(c).alias("value")) for c, m in told])
    return wide.select(key, F.inline(rows)).where("value is not null")
