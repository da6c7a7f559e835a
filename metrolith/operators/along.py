"""Lines along other lines, tile by tile: segments are dealt out once, and points, pairs and most sums never leave a tile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

#: A tile's side, in steps or radii, whichever is longer.
TILE = 100
#: Pairs of points that are looked at together, and lines whose segments are dealt out together.
PAIRS, LINES = 1 << 20, 4096
#: What a bound is lowered by in a tile: what lies on it is for the caller to judge.
ROUNDING = 1e-8
FLOATS = ("x0", "y0", "x1", "y1", "before", "length")
SUMS = "quarter int, m double, turned double, length_m double"


def overlaps(these: DataFrame, others: DataFrame | None, this: str, other: str, near: float, step: float, least_share: float = 0.0, least_m: float = 0.0) -> DataFrame:
    """(this, other, quarter, m, turned, length_m): parts of the lengths of these lines that lie within `near` of the others
    (None: of each other), of which the sums count; `turned` is the difference of bearings times the length.

    Lines (points: array of (x, y)) go to tiles as segments, with those of other lines within `near` of the tile. Each
    point belongs to one tile, which has all that is near it. A line that lies in one tile has its sums there: they are
    left out if they are surely below least_share of its length or least_m. Other lines' parts are for the caller to add up and
    to hold against these. A tile is worked on whole, its pairs of points bit by bit. Lines without an id are left out.
    """
    tile = TILE * max(near, step)
    a, b = these.schema[this].dataType, (these if others is None else others).schema[this if others is None else other].dataType
    s = StructType([*StructType.fromDDL("tx long, ty long").fields, StructField("a", a), StructField("b", b), *StructType.fromDDL(", ".join(f"{c} double" for c in FLOATS) + ", closed boolean, whole boolean").fields])
    dealt = these.select(F.col(this).alias("a"), F.lit(None).cast(b).alias("b"), "points")
    if others is not None:
        dealt = dealt.unionByName(others.select(F.lit(None).cast(a).alias("a"), F.col(other).alias("b"), "points"))
    dealt = dealt.where("a is not null or b is not null").select("a", "b", F.transform("points", lambda p: p["x"].cast("double")).alias("xs"), F.transform("points", lambda p: p["y"].cast("double")).alias("ys"))
    dealt = dealt.mapInArrow(_segments(near, tile), s).repartition("tx", "ty").sortWithinPartitions("tx", "ty")
    out = StructType([StructField("this", a), StructField("other", b), *StructType.fromDDL(SUMS).fields])
    return dealt.mapInArrow(_tiles(near, step, tile, others is None, least_share * (1 - ROUNDING), least_m * (1 - ROUNDING), to_arrow_type(a), to_arrow_type(b)), out)


def _ranges(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for every n."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _segments(near: float, tile: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, LINES) for whole in batches for lo in range(0, whole.num_rows, LINES)):
            n = np.asarray(batch.column(2).value_lengths().fill_null(0)).astype(np.int64)
            line = np.repeat(np.arange(len(n)), n)
            x, y = (c.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns[2:])
            first, last = np.cumsum(n) - n, np.cumsum(n) - 1
            closed, some = np.zeros(len(n), bool), n > 0
            closed[some] = (x[first[some]] == x[last[some]]) & (y[first[some]] == y[last[some]])
            at = np.flatnonzero(line[1:] == line[:-1])
            long = np.sqrt((x[at + 1] - x[at]) ** 2 + (y[at + 1] - y[at]) ** 2)
            at, long = at[long > 0], long[long > 0]  # a vertex without a place breaks its line
            if not len(at):
                continue
            of = line[at]
            length = np.bincount(of, long, len(n))
            new = np.flatnonzero(np.diff(of, prepend=-1))
            sums = np.cumsum(long) - long
            before = sums - np.repeat(sums[new], np.diff(np.append(new, len(of))))
            x0, y0, x1, y1 = x[at], y[at], x[at + 1], y[at + 1]
            lows, highs = (np.minimum(x0, x1), np.minimum(y0, y1)), (np.maximum(x0, x1), np.maximum(y0, y1))
            whole = np.ones(len(n), bool)
            for lo, hi in zip(lows, highs):
                lo, hi = np.floor(np.minimum.reduceat(lo, new) / tile), np.floor(np.maximum.reduceat(hi, new) / tile)
                whole[of[new]] &= lo == hi
            tx, ty = (np.floor((lo - near) / tile).astype(np.int64) for lo in lows)
            nx, ny = (np.floor((hi + near) / tile).astype(np.int64) - t + 1 for hi, t in zip(highs, (tx, ty)))
            i = np.repeat(np.arange(len(at)), nx * ny)
            k = _ranges(nx * ny)
            row = pa.array(of[i])
            yield pa.RecordBatch.from_arrays(
                [pa.array(tx[i] + k // ny[i]), pa.array(ty[i] + k % ny[i]), batch.column(0).take(row), batch.column(1).take(row), *(pa.array(c[i]) for c in (x0, y0, x1, y1, before)),
                 pa.array(length[of[i]]), pa.array(closed[of[i]]), pa.array(whole[of[i]])],
                names=["tx", "ty", "a", "b", *FLOATS, "closed", "whole"])

    return run


def _tiles(near: float, step: float, tile: float, mutual: bool, least_share: float, least_m: float, a: pa.DataType, b: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            tx, ty = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cuts = [0, *(np.flatnonzero((np.diff(tx) != 0) | (np.diff(ty) != 0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if held and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) != (tx[lo], ty[lo]):
                    yield from worked(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from worked(held)

    def worked(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        column = lambda c: t.column(c).chunk(0)
        ids, others = (column(c).dictionary_encode() for c in ("a", "b"))
        own, far = (np.asarray(d.indices.fill_null(-1)).astype(np.int64) for d in (ids, others))
        if mutual:
            others, far = ids, own
        if not len(ids.dictionary) or not len(others.dictionary):
            return
        x0, y0, x1, y1, before, length = (np.asarray(column(c)) for c in FLOATS)
        closed, whole = (column(c).to_numpy(zero_copy_only=False) for c in ("closed", "whole"))
        dx, dy = x1 - x0, y1 - y0
        long = np.sqrt(dx**2 + dy**2)
        bearing = (np.degrees(np.arctan2(dx, dy)) + 360) % 360
        n = np.maximum(1, np.ceil(long / step)).astype(np.int64)
        seg = np.repeat(np.arange(len(n)), n)
        part = (_ranges(n) + 0.5) / n[seg]
        x, y = x0[seg] + part * dx[seg], y0[seg] + part * dy[seg]
        here = (own[seg] >= 0) & (np.floor(x / tile) == t.column("tx")[0].as_py()) & (np.floor(y / tile) == t.column("ty")[0].as_py())
        there = far[seg] >= 0
        if not here.any() or not there.any():
            return
        cx, cy = (np.floor(v / near).astype(np.int64) for v in (x, y))
        cx, cy = cx - cx.min() + 1, cy - cy.min() + 1
        high = int(cy.max()) + 2
        key = cx * high + cy
        # The other lines' points by cell; these lines' points find three runs of three cells in them.
        q = np.flatnonzero(there)
        q = q[np.argsort(key[q], kind="stable")]
        p = np.flatnonzero(here)
        sorted_key = key[q]
        lo = np.stack([np.searchsorted(sorted_key, key[p] + d * high - 1, "left") for d in (-1, 0, 1)], axis=1)
        hi = np.stack([np.searchsorted(sorted_key, key[p] + d * high + 1, "right") for d in (-1, 0, 1)], axis=1)
        many = np.cumsum((hi - lo).sum(axis=1))
        m_of = (long / n)[seg]
        quarter = np.where(closed[seg], np.floor(4 * (before[seg] + part * long[seg]) / length[seg]).clip(0, 3), 0).astype(np.int64)
        wide = len(others.dictionary)
        found: list[tuple[np.ndarray, ...]] = []
        begin = 0
        while begin < len(p):
            end = max(begin + 1, int(np.searchsorted(many, (many[begin - 1] if begin else 0) + PAIRS, "right")))
            size = (hi[begin:end] - lo[begin:end]).ravel()
            i = np.repeat(np.repeat(p[begin:end], 3), size)
            j = q[np.repeat(lo[begin:end].ravel(), size) + _ranges(size)]
            begin = end
            if mutual:
                apart = own[seg[i]] != far[seg[j]]
                i, j = i[apart], j[apart]
            d = np.sqrt((x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2)
            close = d <= near
            i, j, d = i[close], j[close], d[close]
            if not len(i):
                continue
            turn = np.abs(bearing[seg[i]] - bearing[seg[j]]) % 180
            turn = np.minimum(turn, 180 - turn)
            # The nearest point of each other line counts; of equally near ones that of the least place, then bearing.
            pair = i * wide + far[seg[j]]
            order = np.argsort(pair)
            pair, d, j, turn = pair[order], d[order], j[order], turn[order]
            starts = np.flatnonzero(np.diff(pair, prepend=-1))
            best = np.flatnonzero(d == np.repeat(np.minimum.reduceat(d, starts), np.diff(np.append(starts, len(d)))))
            if len(best) > len(starts):
                best = best[np.lexsort((turn[best], y[j[best]], x[j[best]], pair[best]))]
                best = best[np.flatnonzero(np.diff(pair[best], prepend=-1))]
            i, o = pair[best] // wide, pair[best] % wide
            found.append(_added((own[seg[i]] * 4 + quarter[i]) * wide + o, m_of[i], m_of[i] * turn[best]))
        if not found:
            return
        which, m, turned = _added(*(np.concatenate(c) for c in zip(*found)))
        line, o, quarters = which // wide // 4, which % wide, which // wide % 4
        total, inside = np.zeros(len(ids.dictionary)), np.zeros(len(ids.dictionary), bool)
        total[own[own >= 0]], inside[own[own >= 0]] = length[own >= 0], whole[own >= 0]
        # All of a line that lies in this tile is known.
        _, of = np.unique(line * wide + o, return_inverse=True)
        enough = np.bincount(of, m)[of]
        keep = ~inside[line] | ((enough >= least_share * total[line]) & (enough >= least_m))
        line, o, quarters, m, turned = line[keep], o[keep], quarters[keep], m[keep], turned[keep]
        for lo_ in range(0, len(line), 50_000):
            s = slice(lo_, lo_ + 50_000)
            yield pa.RecordBatch.from_arrays(
                [ids.dictionary.take(pa.array(line[s])).cast(a), others.dictionary.take(pa.array(o[s])).cast(b), pa.array(quarters[s].astype(np.int32)), pa.array(m[s]), pa.array(turned[s]), pa.array(total[line[s]])],
                names=["this", "other", "quarter", "m", "turned", "length_m"])

    return run


def _added(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The sums of values by key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    return key[starts], *(np.add.reduceat(v[order], starts) for v in values)
