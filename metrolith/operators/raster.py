"""Grids as long tables of (row, col, value): focal, block and component operators as joins and aggregations."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrolith.io import cut, stored
from metrolith.operators.graph import connected_components

#: Peaks of a round that are broadcast; more are met by a shuffle.
FEW_PEAKS = 10_000


def focal(cells: DataFrame, value: str, keys: Sequence[str] = (), reach: int = 1) -> DataFrame:
    """Mean, least, greatest and number of the values around each cell, itself included; each value goes to its neighbours."""
    shift = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]))
    spread = cells.select(*keys, "row", "col", F.col(value).alias("_v"), shift.alias("_s"))
    spread = spread.select(*keys, (F.col("row") + F.col("_s.i")).alias("row"), (F.col("col") + F.col("_s.j")).alias("col"), "_v")
    near = spread.groupBy(*keys, "row", "col").agg(F.avg("_v").alias("focal_mean"), F.min("_v").alias("focal_min"), F.max("_v").alias("focal_max"), F.count("_v").alias("focal_n"))
    return cells.join(near, [*keys, "row", "col"])


def blocks(cells: DataFrame, size: int, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates by square block."""
    return cells.groupBy(*keys, F.floor(F.col("row") / size).alias("brow"), F.floor(F.col("col") / size).alias("bcol")).agg(*aggregates)


def first_in_block(cells: DataFrame, size: int, order: Sequence[Column], n: int) -> DataFrame:
    """The first n cells of each block."""
    w = Window.partitionBy(F.floor(F.col("row") / size), F.floor(F.col("col") / size)).orderBy(*order)
    return cells.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def components(cells: DataFrame, width: int) -> DataFrame:
    """Clumps of cells that touch by side or corner: each cell's clump, its size and extent. width: cells in a row."""
    c = cells.select("row", "col", (F.col("row") * width + F.col("col")).alias("id"))
    # Half of the neighbours see the others.
    ahead = F.explode(F.array(*[F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    edges = c.select(F.col("id").alias("a"), ahead.alias("n")).select("a", "n.row", "n.col").join(c.withColumnRenamed("id", "b"), ["row", "col"]).select("a", "b")
    found = connected_components(edges)
    c = c.join(found, c["id"] == found["node"], "left").select("row", "col", F.coalesce("component", "id").alias("clump"))
    c = cut(c)
    sizes = c.groupBy("clump").agg(F.count("*").alias("cells"), (F.max("row") - F.min("row") + 1).alias("high"), (F.max("col") - F.min("col") + 1).alias("wide"))
    return c.join(sizes, "clump")


def thin(clumps: DataFrame, long_: int, across: int) -> DataFrame:
    """Clumps that are long and narrow: walls and fences."""
    c = clumps.select("clump", "cells", "high", "wide").distinct()
    return c.where((F.greatest("high", "wide") >= long_) & (F.col("cells") <= across * F.greatest("high", "wide")))


def resample(values: DataFrame, factor: float, lo: str, hi: str, value: str) -> DataFrame:
    """Values over intervals, averaged into intervals of `factor` by the lengths that they share."""
    first, last = F.floor(F.col(lo) / factor).cast("long"), (F.ceil(F.col(hi) / factor) - 1).cast("long")
    v = values.where(F.col(hi) > F.col(lo)).withColumn("bin", F.explode(F.sequence(first, F.greatest(first, last))))
    v = v.withColumn("_w", F.least(F.col(hi), (F.col("bin") + 1) * factor) - F.greatest(F.col(lo), F.col("bin") * factor)).where("_w > 0")
    return v.groupBy("bin").agg((F.sum(F.col(value) * F.col("_w")) / F.sum("_w")).alias("mean"), F.sum("_w").alias("covered"))


def distance_to(cells: DataFrame, mask: DataFrame, reach: int) -> DataFrame:
    """Each cell's distance, in cells, to the nearest of the mask, if one lies within `reach`."""
    from metrolith.operators.spatial import nearest_within

    x = lambda df: df.select("row", "col", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    near = nearest_within(x(cells), x(mask), float(reach), ["row", "col"], ["r_row", "r_col"])
    return near.select("row", "col", F.col("d").alias("distance"))


def stacked(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """The first rule that holds names the class."""
    out = F.lit(default)
    for condition, name in reversed(rules):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def mahalanobis(cells: DataFrame, classes: DataFrame, bands: Sequence[str]) -> DataFrame:
    """The nearest class of each cell by Mahalanobis distance with diagonal covariance; classes have <band>_mean and
    <band>_var. Classes are few, and each cell looks them all up in one array, so no row is multiplied."""
    table = classes.agg(F.array_sort(F.collect_list(F.struct("cls", *[c for b in bands for c in (f"{b}_mean", f"{b}_var")]))).alias("t"))
    d = lambda k: sum(((F.col(b) - k[f"{b}_mean"]) ** 2 / k[f"{b}_var"] for b in bands), F.lit(0.0))
    with_t = cells.withColumn("_t", table.scalar())
    best = F.array_min(F.transform("_t", lambda k: F.struct(F.sqrt(d(k)).alias("distance"), k["cls"].alias("cls"))))
    return with_t.withColumn("_b", best).withColumn("cls", F.col("_b.cls")).withColumn("distance", F.col("_b.distance")).drop("_t", "_b")


def mahalanobis_pair(cells: DataFrame, samples: DataFrame, cls: str, x: str, y: str) -> DataFrame:
    """The nearest class of each cell by Mahalanobis distance with full covariance over two bands; means and covariances are
    those of the samples of each class. Classes are few, and each cell looks them all up in one array."""
    m = samples.groupBy(F.col(cls).alias("k")).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_samp(x).alias("xx"), F.var_samp(y).alias("yy"), F.covar_samp(x, y).alias("xy"))
    table = m.where(F.col("xx") * F.col("yy") > F.col("xy") ** 2).agg(F.array_sort(F.collect_list(F.struct("k", "mx", "my", "xx", "yy", "xy"))).alias("t"))
    dx, dy = lambda k: F.col(x) - k["mx"], lambda k: F.col(y) - k["my"]
    d2 = lambda k: (dx(k) ** 2 * k["yy"] - 2 * dx(k) * dy(k) * k["xy"] + dy(k) ** 2 * k["xx"]) / (k["xx"] * k["yy"] - k["xy"] ** 2)
    best = F.array_min(F.transform("_t", lambda k: F.struct(F.sqrt(d2(k)).alias("distance"), k["k"].alias("cls"))))
    return cells.withColumn("_t", table.scalar()).withColumn("_b", best).withColumn("nearest_class", F.col("_b.cls")).withColumn("distance", F.col("_b.distance")).drop("_t", "_b")


def rasterise(polygons: DataFrame, size: float, key: str) -> DataFrame:
    """(key, row, col): cells whose centre a polygon (ring: array of (x, y)) holds."""
    from metrolith.functions.geo import inside_ring

    low = lambda c: F.floor(F.array_min(F.transform("ring", lambda v: v[c])) / size).cast("long")
    high = lambda c: F.floor(F.array_max(F.transform("ring", lambda v: v[c])) / size).cast("long")
    p = polygons.withColumn("row", F.explode(F.sequence(low("y"), high("y")))).withColumn("col", F.explode(F.sequence(low("x"), high("x"))))
    return p.where(inside_ring((F.col("col") + 0.5) * size, (F.col("row") + 0.5) * size, F.col("ring"))).select(key, "row", "col")


def window_of(x0: Column, y0: Column, x1: Column, y1: Column, size: float, snap: int, pad: int, rows: int, cols: int) -> Column:
    """The cells (row0, col0, row1, col1, half open) that cover a box, padded, snapped outwards to multiples of `snap` and
    clipped to a grid."""
    low = lambda v: F.floor((F.floor(v / size) - pad) / snap) * snap
    high = lambda v: F.ceil((F.ceil(v / size) + pad) / snap) * snap
    clip = lambda v, n: F.least(F.greatest(v, F.lit(0)), F.lit(n)).cast("long")
    return F.struct(clip(low(y0), rows).alias("row0"), clip(low(x0), cols).alias("col0"), clip(high(y1), rows).alias("row1"), clip(high(x1), cols).alias("col1"))


def mask_shares(cells: DataFrame, zone: str, masks: dict[str, Column]) -> DataFrame:
    """Each zone's number of cells, and the share of them in every mask."""
    return cells.groupBy(zone).agg(F.count("*").alias("cells"), *[(F.count_if(F.coalesce(m, F.lit(False))) / F.count("*")).alias(n) for n, m in masks.items()])


def share_or_clump(cells: DataFrame, zone: str, clump: str, mask: Column, least: int) -> DataFrame:
    """(zone, cells, share, of): the share of a zone's cells in a mask; zones of fewer than `least` cells take their clump's."""
    z = cells.groupBy(zone, clump).agg(F.count("*").alias("cells"), F.count_if(mask).alias("hits"))
    c = z.groupBy(clump).agg((F.sum("hits") / F.sum("cells")).alias("clump_share"))
    few = F.col("cells") < least
    return z.join(c, clump).select(zone, clump, "cells", F.when(few, F.col("clump_share")).otherwise(F.col("hits") / F.col("cells")).alias("share"), F.when(few, "clump").otherwise("zone").alias("of"))


def illumination(cells: DataFrame, value: str, altitude: float, azimuth: float, size: float = 1.0) -> DataFrame:
    """Cells that have all four neighbours, with slope, aspect (degrees from north) and the cosine of the sun's angle."""
    side = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(i).alias("i"), F.lit(j).alias("j")) for n, i, j in (("n", 1, 0), ("s", -1, 0), ("w", 0, 1), ("e", 0, -1))]))
    sent = cells.select("row", "col", F.col(value).alias("_v"), side.alias("s")).select((F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"), "s.n", "_v")
    at = sent.groupBy("row", "col").agg(*[F.max(F.when(F.col("n") == n, F.col("_v"))).alias(f"_{n}") for n in "nsew"]).dropna()
    east, north = (F.col("_e") - F.col("_w")) / (2 * size), (F.col("_n") - F.col("_s")) / (2 * size)
    d = cells.join(at, ["row", "col"]).withColumn("slope", F.degrees(F.atan(F.sqrt(east**2 + north**2)))).withColumn("aspect", F.pmod(F.degrees(F.atan2(-east, -north)), F.lit(360.0)))
    up, turn = F.radians(F.lit(float(altitude))), F.radians(F.lit(float(azimuth)) - F.col("aspect"))
    sun = F.sin(up) * F.cos(F.radians("slope")) + F.cos(up) * F.sin(F.radians("slope")) * F.cos(turn)
    return d.withColumn("sun", sun).drop("_n", "_s", "_e", "_w")


def _blurred(cells: DataFrame, sigma: float, keys: Sequence[str]) -> DataFrame:
    """Sums and weights (s, d) blurred by a Gaussian, rows first and then columns; three deviations wide."""
    reach = math.ceil(3 * sigma)
    raw = [math.exp(-i * i / (2 * sigma * sigma)) for i in range(-reach, reach + 1)]
    taps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w / sum(raw)).alias("w")) for i, w in zip(range(-reach, reach + 1), raw)])
    for axis in ("row", "col"):
        spread = cells.select(*keys, "row", "col", "u", "s", "d", F.explode(taps).alias("t"))
        moved = {axis: (F.col(axis) + F.col("t.i")).alias(axis)}
        own = F.when(F.col("t.i") == 0, F.col("u"))
        spread = spread.select(*keys, *[moved.get(c, F.col(c)) for c in ("row", "col")], own.alias("u"), (F.col("s") * F.col("t.w")).alias("s"), (F.col("d") * F.col("t.w")).alias("d"))
        cells = spread.groupBy(*keys, "row", "col").agg(F.coalesce(F.max("u"), F.lit(0.0)).alias("u"), F.sum("s").alias("s"), F.sum("d").alias("d"))
    return cells


def octave_bands(cells: DataFrame, value: str, octave: int, support: float = 0.75, keys: Sequence[str] = ()) -> DataFrame:
    """Texture of one octave k: (keys, row, col, band) on cells of 2^k, the difference of a Gaussian blur of one cell of that
    level and one of two. Cells that aren't there, or have no value, weigh nothing; a cell counts where half of it is there
    and the wider blur has `support`. The mean square of `band` by zone is the octave's energy."""
    level = cells.where(F.col(value).isNotNull()).select(*keys, "row", "col", F.lit(1.0).alias("u"), F.col(value).cast("double").alias("s"), F.lit(1.0).alias("d"))
    had = 0.0
    for k in range(octave + 1):
        if had < 1.0:
            level, had = _blurred(level, math.sqrt(1.0 - had * had), keys), 1.0
        wide = _blurred(level, math.sqrt(4.0 - had * had), keys)
        if k == octave:
            ratio = F.when(F.col("d") > 0, F.col("s") / F.col("d")).otherwise(0.0)
            fine = level.select(*keys, "row", "col", ratio.alias("_fine"))
            return wide.where((F.col("u") >= 0.5) & (F.col("d") >= support)).join(fine, [*keys, "row", "col"]).select(*keys, "row", "col", (F.col("_fine") - ratio).alias("band"))
        half = [F.floor(F.col(c) / 2).alias(c) for c in ("row", "col")]
        level = wide.groupBy(*keys, *half).agg(*[(F.sum(c) / 4).alias(c) for c in ("u", "s", "d")])
        had = math.sqrt(4.25) / 2


def spaced_peaks(points: DataFrame, key: str, height: str, spacing: float) -> DataFrame:
    """Peaks from the tallest down, none closer than `spacing` to a taller one that was kept.

    A round looks at cells in which all points are closer than `spacing`: the tallest of a cell is kept once no cell that
    its spacing reaches has a taller one left, and what lies around kept peaks goes. Only points and the tallest of cells
    are ever dealt out, never pairs of points, so a dense table costs no more than a sparse one. Ties by key; points that
    have no finite place are left out.
    """
    side, reach = spacing / 1.5, (-2, -1, 0, 1, 2)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    cell = lambda c: F.floor(F.col(c) / side).cast("long")
    p = stored(points.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), height).where(finite("x") & finite("y")).withColumn("cx", cell("x")).withColumn("cy", cell("y")))
    order, kept = F.struct(F.col(height).alias("h"), (-F.col(key)).alias("k")), None
    away = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in reach for j in reach])
    # How far a cell is from a point, along one axis; a cell that rounding may have moved is taken for near.
    gap = lambda c, n: F.greatest(F.lit(0.0), n * side - F.col(c), F.col(c) - (n + 1) * side)
    while True:  # the tallest of all that are left is kept in every round, so this ends
        tops = cut(p.groupBy("cx", "cy").agg(F.max(order).alias("top"), F.max_by(F.struct(key, "x", "y", height), order).alias("p")))
        around = tops.select("*", F.explode(away).alias("d")).select("top", "p", "p.x", "p.y", (F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy"))
        around = around.where(gap("x", F.col("cx")) ** 2 + gap("y", F.col("cy")) ** 2 <= spacing**2 * (1 + 1e-9))
        met = around.join(tops.select("cx", "cy", F.col("top").alias("other")), ["cx", "cy"])
        now = cut(met.groupBy("top", "p").agg(F.max("other").alias("other")).where("top = other").select("p.*"))
        kept = now if kept is None else kept.union(now)
        near = now.select(F.col("x").alias("px"), F.col("y").alias("py"), F.explode(away).alias("d")).select("px", "py", (cell("px") + F.col("d.i")).alias("nx"), (cell("py") + F.col("d.j")).alias("ny"))
        if now.count() <= FEW_PEAKS:
            near = F.broadcast(near)
        close = F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2) <= spacing
        p = stored(p.join(near, (F.col("cx") == F.col("nx")) & (F.col("cy") == F.col("ny")) & close, "left_anti"))
        if p.isEmpty():
            return kept
