"""Connected components and reachability over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrolith.io import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an undirected edge table; component is the smallest node reachable.

    Alternates large-star and small-star contraction, which ends after O(log^2 n) rounds whatever the
    diameter. Every round is two aggregations and a join; no neighbour list is ever gathered. Null ends
    and loops are ignored, repeated edges count once, and an empty table gives an empty result.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    e = cut(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        # Large star: every larger neighbour of u is tied to the smallest node that u sees.
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        large = cut(large)
        # Small star: u and its smaller neighbours are tied to the smallest of them.
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        if _same(e, new):
            e = new
            break
        e = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _same(x: DataFrame, y: DataFrame) -> bool:
    """Whether two duplicate-free edge tables are equal, by count and two hash sums."""
    def digest(df: DataFrame):
        return df.agg(
            F.count("*"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
            F.sum(F.hash("v", "u").cast("decimal(38,0)")),
        ).first()

    return digest(x) == digest(y)


def distances(edges: DataFrame, heads: DataFrame, a: str = "a", b: str = "b", length: str = "w") -> DataFrame:
    """(node, head, distance): every node's shortest way from its nearest head along directed edges; ties to the lower head.

    Rounds of relaxation from the frontier that changed: a round is a join and an aggregation. Lengths are not negative,
    so the rounds end, after as many as the longest of the shortest ways has hops. A negative length is an error.
    """
    e = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(length).cast("double").alias("w")))
    if e.where("w < 0").limit(1).count():
        raise ValueError("an edge has a negative length")
    best = cut(heads.select(F.col(heads.columns[0]).alias("node")).distinct().select("node", F.struct(F.lit(0.0).alias("d"), F.col("node").alias("head")).alias("best")))
    front = best
    while True:
        step = front.join(e, front["node"] == e["a"]).select(F.col("b").alias("node"), F.struct((F.col("best.d") + F.col("w")).alias("d"), F.col("best.head").alias("head")).alias("best"))
        step = step.groupBy("node").agg(F.min("best").alias("new"))
        m = cut(best.join(step, "node", "full").select("node", "best", "new", (F.col("new").isNotNull() & (F.col("best").isNull() | (F.col("new") < F.col("best")))).alias("better")))
        best = m.select("node", F.when(F.col("better"), F.col("new")).otherwise(F.col("best")).alias("best"))
        front = m.where("better").select("node", F.col("new").alias("best"))
        if not front.limit(1).count():
            return best.select("node", F.col("best.head").alias("head"), F.col("best.d").alias("distance"))


def reachable(edges: DataFrame, start: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, hops) from the start nodes along directed edges, by fewest hops."""
    d = distances(edges.select(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(1.0).alias("w")), start)
    return d.select("node", F.col("distance").cast("int").alias("hops"))


def topological_order(items: dict[str, tuple[int, list[str]]]) -> list[str]:
    """Names after what they need, ties by number and then name; a cycle or an unknown need is an error. For registries."""
    left = {n: set(needs) for n, (_, needs) in items.items()}
    unknown = sorted({x for needs in left.values() for x in needs} - left.keys())
    if unknown:
        raise ValueError(f"unknown: {', '.join(unknown)}")
    out: list[str] = []
    while left:
        ready = sorted((n for n, needs in left.items() if needs <= set(out)), key=lambda n: (items[n][0], n))
        if not ready:
            raise ValueError(f"in a cycle: {', '.join(sorted(left))}")
        out.append(ready[0])
        del left[ready[0]]
    return out
