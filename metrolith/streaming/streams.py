"""Structured Streaming forms of the operators: exactly once by key, windows, sessions, lifecycles, late rows, gauges."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from metrolith.io import shared_dir
from metrolith.operators import lifecycle


def file_stream(spark: SparkSession, folder: str, name: str, per_batch: int = 1000) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def once_by_key(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """The first row of each key; repeats within the delay are dropped, and state older than that is let go."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, at: str, delay: str, length: str, keys: list[str], aggregates: list[Column], slide: str | None = None) -> DataFrame:
    """Aggregates by tumbling (or sliding) window."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    return _flat(stream.withWatermark(at, delay).groupBy(w, *keys).agg(*aggregates), "window")


def _flat(df: DataFrame, window: str) -> DataFrame:
    return df.select(F.col(f"{window}.start").alias("start"), F.col(f"{window}.end").alias("end"), *[c for c in df.columns if c != window])


def session_windows(stream: DataFrame, at: str, delay: str, gap: str, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates by session: rows of a key that follow each other within the gap."""
    return _flat(stream.withWatermark(at, delay).groupBy(F.session_window(at, gap), *keys).agg(*aggregates), "session_window")


def run_available(stream: DataFrame, mode: str, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All that is there now, through the stream, as a table in the shared folder.

    Each micro-batch is written to a folder named by its number, so a batch that is run again replaces itself. With
    mode "update" or "complete", `keep` picks what counts of all batches (the column _epoch has their numbers).
    """
    spark = stream.sparkSession
    root = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/_epoch={epoch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("_epoch", IntegerType())])
    out = spark.read.schema(schema).option("basePath", f"{root}/out").parquet(f"{root}/out")
    return (keep(out) if keep else out).drop("_epoch")


def newest_epoch(keys: list[str], values: list[str]) -> Callable[[DataFrame], DataFrame]:
    """For update mode: each key as its last batch left it."""
    def keep(out: DataFrame) -> DataFrame:
        return out.groupBy(*keys).agg(F.max_by(F.struct(*values), "_epoch").alias("_v")).select(*keys, "_v.*", F.lit(0).alias("_epoch"))

    return keep


class SnapshotTable:
    """Lifecycles kept as versions of a Parquet table, for foreachBatch: each batch is a full snapshot.

    Version n is what batch n left; a batch that is run again starts from the version before it and replaces its own.
    A batch with the same digest as the last changes nothing but the time of the heartbeat.
    """

    SCHEMA = "source_id string, content_hash string, observed_lo timestamp_ntz, observed_hi timestamp_ntz, active boolean, updated_at timestamp_ntz"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _logged(self) -> list[tuple[int, int, str]]:
        """(batch, the version that holds it, its digest), as the folder has them: a stream that starts again goes on."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/log")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return []
        return sorted((r["epoch"], r["version"], r["digest"]) for r in self.spark.read.schema("version int, digest string, epoch int").parquet(f"{self.root}/log").collect())  # a row a batch

    @property
    def versions(self) -> list[int]:
        return sorted({v for _, v, _ in self._logged()})

    @property
    def heartbeats(self) -> list[int]:
        return [e for e, _, _ in self._logged()]

    def at(self, version: int | None) -> DataFrame:
        if version is None:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.root}/v{version}")

    def merge(self, snapshot: DataFrame, epoch: int, seen_at: Column) -> bool:
        """Whether the snapshot changed anything."""
        before, held = max(((v, d) for e, v, d in self._logged() if e < epoch), default=(None, None))
        digest = str(tuple(snapshot.agg(F.count("*"), F.sum(F.xxhash64("source_id", "content_hash").cast("decimal(38,0)"))).first()))
        log = lambda version: self.spark.range(1).select(F.lit(version).alias("version"), F.lit(digest).alias("digest")).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/log/epoch={epoch}")
        if held == digest:
            log(before)
            return False
        merged = lifecycle.merge_snapshot(self.at(before), snapshot, seen_at).drop("state")
        merged.write.mode("overwrite").parquet(f"{self.root}/v{epoch}")
        log(epoch)
        return True


LATE = "key string, ts double, id long, placed string"


def mark_late(stream: DataFrame) -> DataFrame:
    """Rows of (key, ts, id), each placed: newest; late, if earlier batches had both newer and older rows of its key; or
    earlier, if it is older than all of them: such rows make a chain of their own, which joins the oldest.

    State is two numbers for each key.
    """
    def place(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, oldest = state.get if state.exists else (float("-inf"), float("-inf"))
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        placed = ["newest" if t >= newest else "earlier" if t < oldest else "late" for t in rows["ts"]]
        first = float(rows["ts"].min())
        state.update((max(newest, float(rows["ts"].max())), min(oldest, first) if state.exists else first))
        yield pd.DataFrame({"key": key[0], "ts": rows["ts"], "id": rows["id"], "placed": placed})

    return stream.select("key", "ts", "id").groupBy("key").applyInPandasWithState(place, LATE, "newest double, oldest double", "append", GroupStateTimeout.NoTimeout)


GAUGE = "key string, state string, since double"


def gauge_changes(stream: DataFrame, silence_s: float) -> DataFrame:
    """Changes of state by key, from rows of (key, ts, state), state null where a reading doesn't tell.

    A silence of over silence_s seconds is unknown from silence_s after the last reading; it shows when the next reading
    comes. State is the last reading's time and the state in force.
    """
    def changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, now = state.get if state.exists else (None, None)
        out = []
        for r in pd.concat(list(batches)).sort_values("ts").itertuples(index=False):
            if now is not None and now != "unknown" and r.ts - last > silence_s:
                out.append((key[0], "unknown", last + silence_s))
                now = "unknown"
            told = None if r.state is None or r.state != r.state else r.state
            if told is not None and told != now:
                out.append((key[0], told, r.ts))
                now = told
            if now is not None:
                last = r.ts
        if now is not None:
            state.update((float(last), now))
        yield pd.DataFrame(out, columns=["key", "state", "since"])

    return stream.select("key", "ts", "state").groupBy("key").applyInPandasWithState(changes, GAUGE, "last double, now string", "append", GroupStateTimeout.NoTimeout)
