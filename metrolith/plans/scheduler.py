"""Running what is due, and watching over what plans read."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolith.operators import graph, status

FETCHES = "source string, started_at timestamp_ntz, finished_at timestamp_ntz, id long, ok boolean, error string"


class Registry:
    """Sources with their schedules, needs and what they run; names are unique, and a source is scheduled or a stream."""

    def __init__(self):
        self.entries: dict[str, tuple[int | None, int | None, int, list[str], Callable]] = {}

    def add(self, name: str, run: Callable, schedule_s: int | None = None, stale_s: int | None = None, order: int = 0, needs: tuple[str, ...] = ()) -> None:
        if name in self.entries:
            raise ValueError(f"{name} is there already")
        if schedule_s is not None and stale_s is not None:
            raise ValueError(f"{name} is scheduled or a stream, not both")
        self.entries[name] = (schedule_s, stale_s, order, list(needs), run)

    def order(self) -> list[str]:
        return graph.topological_order({n: (e[2], e[3]) for n, e in self.entries.items()})

    def sources(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n, e[0], e[1]) for n, e in self.entries.items()], "source string, schedule_s long, stale_s long")

    def run_due(self, spark: SparkSession, fetches: DataFrame, now: datetime) -> DataFrame:
        """The fetch log with the attempts of this round: due sources run in order, and a failure stops no other."""
        at = F.lit(now.isoformat(" ")).cast("timestamp_ntz")
        s = self.sources(spark)
        ready = {r["source"] for r in status.due(status.source_status(s, fetches, at), s, at).collect()}
        rows, n = [], (fetches.agg(F.max("id")).first()[0] or 0)
        for name in self.order():
            if name in ready:
                n += 1
                try:
                    self.entries[name][4](spark)
                    rows.append((name, now, now, n, True, None))
                except Exception as e:  # noqa: BLE001 - whatever a source raises is its own failure
                    rows.append((name, now, now, n, False, f"{type(e).__name__}: {e}"[:500]))
        return fetches.unionByName(spark.createDataFrame(rows, FETCHES))


def check_reads(df: DataFrame, allowed: set[str]) -> None:
    """An error if a plan reads a file outside the allowed folders."""
    wrong = sorted(f for f in df.inputFiles() if not any(f"{a.rstrip('/')}/" in f"{f}/" for a in allowed))
    if wrong:
        raise PermissionError(f"not to be read here: {', '.join(wrong[:3])}")


def pull_since(fetches: DataFrame, source: str, overlap_s: int) -> DataFrame:
    """Where an incremental read starts: the last success less an overlap; null before the first."""
    good = fetches.where((F.col("source") == source) & F.col("ok")).agg(F.max("started_at").alias("t"))
    return good.select((F.col("t") - F.expr(f"interval {overlap_s} seconds")).alias("since"))


def register_functions(spark: SparkSession) -> None:
    """SQL functions over tags and surfaces, and a table function that cuts a line into points."""
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION surface_class(surface STRING) RETURNS STRING RETURN
        CASE WHEN surface IN ('asphalt', 'concrete', 'paved', 'paving_stones', 'chipseal') THEN 'paved'
             WHEN surface IN ('gravel', 'fine_gravel', 'compacted', 'pebblestone') THEN 'gravel'
             WHEN surface IN ('dirt', 'earth', 'ground', 'grass', 'sand', 'mud', 'unpaved') THEN 'natural' END""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION no_public_access(tags MAP<STRING, STRING>) RETURNS BOOLEAN RETURN
        coalesce(tags['foot'], tags['access'], 'yes') IN ('no', 'private') AND coalesce(tags['foot'], '') NOT IN ('yes', 'designated', 'permissive')""")
    from pyspark.sql.functions import udtf

    @udtf(returnType="i: int, x: double, y: double")
    class LinePoints:
        def eval(self, x0: float, y0: float, x1: float, y1: float, step: float):
            length = ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5
            n = max(1, int(-(-length // step)))
            for i in range(n + 1):
                yield i, x0 + (x1 - x0) * i / n, y0 + (y1 - y0) * i / n

    spark.udtf.register("line_points", LinePoints)
