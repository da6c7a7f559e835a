"""Versioned records: hashes, merges, guards and keys of snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(columns: Sequence[str]) -> Column:
    """sha-256 of the named columns as JSON with sorted keys; nulls are written, so they count as content."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def merge_versions(held: DataFrame, snapshot: DataFrame, seen_at: Column, complete: bool = True) -> DataFrame:
    """Record versions after a snapshot (slowly changing records).

    held: source, source_id, version_hash, payload, first_seen, last_seen, removed_at. snapshot: source, source_id,
    version_hash, payload. A new hash is a new version; one already held is seen again and no longer removed; with a
    complete snapshot, versions of its sources that it lacks are removed as of seen_at. One full outer join.
    """
    key = ["source", "source_id", "version_hash"]
    new = snapshot.groupBy(*key).agg(F.min("payload").alias("new_payload"))
    seen = F.col("new_payload").isNotNull()
    m = held.join(new, key, "full")
    of = F.lit(False)
    if complete:  # only sources of the snapshot retire versions
        m = m.join(snapshot.select("source").distinct().withColumn("_of", F.lit(True)), "source", "left")
        of = F.coalesce("_of", F.lit(False))
    return m.select(
        *key, F.coalesce("payload", "new_payload").alias("payload"),
        F.coalesce(F.col("first_seen"), seen_at).alias("first_seen"),
        F.when(seen, seen_at).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(seen, F.lit(None)).when(F.col("removed_at").isNull() & of, seen_at).otherwise(F.col("removed_at")).cast("timestamp_ntz").alias("removed_at"),
    )


def versions_of_snapshots(snapshots: DataFrame, source_id: str, seen_at: str, version: str) -> DataFrame:
    """The versions that merging all full snapshots in turn ends with, at once.

    Each version: first and last time seen, and when the first snapshot without it came after the last that had it.
    """
    times = snapshots.select(F.col(seen_at).alias("t")).distinct()
    following = times.withColumn("next_t", F.lead("t").over(Window.orderBy("t")))  # one row for each snapshot
    v = snapshots.groupBy(source_id, version).agg(F.min(seen_at).alias("first_seen"), F.max(seen_at).alias("last_seen"))
    return v.join(following, v["last_seen"] == following["t"]).drop("t").withColumnRenamed("next_t", "removed_at")


def upsert(held: DataFrame, staged: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Typed rows after a full snapshot, with what happened to each: new, changed, unchanged, reactivated or retired.

    held has an `active` column. Rows that the snapshot lacks keep their values and become inactive ("gone" if they were
    already). Values are compared null-safely.
    """
    s = staged.select(F.col(key), *[F.col(v).alias(f"_new_{v}") for v in values], F.lit(True).alias("_in"))
    m = held.join(s, key, "full")
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"_new_{v}"))
    inside = F.col("_in").isNotNull()
    state = (
        F.when(F.col("active").isNull(), "new").when(inside & ~F.col("active"), "reactivated")
        .when(inside & same, "unchanged").when(inside, "changed").when(F.col("active"), "retired").otherwise("gone")
    )
    return m.select(key, *[F.when(inside, F.col(f"_new_{v}")).otherwise(F.col(v)).alias(v) for v in values], inside.alias("active"), state.alias("state"))


def check_snapshot(active: int, found: int, share: float = 0.5) -> None:
    """Refuse a snapshot that is empty or would retire most of what is held."""
    if found == 0 or found < share * active:
        raise ValueError(f"{found} records against {active} active; not taken as a full snapshot")


def guard(snapshot_counts: DataFrame, found: str, active: str, share: float = 0.5) -> DataFrame:
    """The same as a column, where many snapshots are judged at once."""
    return snapshot_counts.withColumn("refused", (F.col(found) == 0) | (F.col(found) < share * F.col(active)))


def insert_if_absent(held: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows whose key isn't held, one for each key: the first in the given order."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.join(held.select(*keys).distinct(), list(keys), "left_anti").withColumn("_n", first).where("_n = 1").drop("_n")


def suffix_keys(rows: DataFrame, key: str, content: Sequence[str]) -> DataFrame:
    """Stable keys: exact repeats are dropped, other rows of one key get #2, #3, ... by the order of their content hash."""
    r = rows.withColumn("content_hash", content_hash(content)).dropDuplicates([key, "content_hash"])
    n = F.row_number().over(Window.partitionBy(key).orderBy("content_hash"))
    return r.withColumn("_n", n).withColumn("stable_key", F.when(F.col("_n") == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit("#"), F.col("_n")))).drop("_n")


def sole_pairs(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """(new_id, old_id) where a key without nulls stands once on either side."""
    known = F.lit(True)
    for k in key:
        known = known & F.col(k).isNotNull()
    sole = lambda df: df.where(known).groupBy(*key).agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1").drop("n")
    return sole(new).withColumnRenamed("id", "new_id").join(sole(old).withColumnRenamed("id", "old_id"), list(key)).select("new_id", "old_id")


def pair_republished(old: DataFrame, new: DataFrame) -> DataFrame:
    """(new_id, old_id): records of (id, code, line) that came back under other ids.

    Ids on both sides stay what they are. Of the rest, code and line together pair first, then a sole code, then a sole line.
    """
    left, right = old.join(new.select("id"), "id", "left_anti"), new.join(old.select("id"), "id", "left_anti")
    found = None
    for key in (["code", "line"], ["code"], ["line"]):
        pairs = sole_pairs(left, right, key)
        found = pairs if found is None else found.union(pairs)
        left = left.join(pairs, left["id"] == pairs["old_id"], "left_anti")
        right = right.join(pairs, right["id"] == pairs["new_id"], "left_anti")
    return found


def is_republish(old: DataFrame, new: DataFrame, share: float = 0.5) -> DataFrame:
    """One row: whether most new ids are unknown and most old ones are gone."""
    m = old.select("id", F.lit(1).alias("o")).distinct().join(new.select("id", F.lit(1).alias("n")).distinct(), "id", "full")
    c = m.agg(F.count("o").alias("known"), F.count("n").alias("found"), F.count_if(F.col("o").isNull()).alias("fresh"), F.count_if(F.col("n").isNull()).alias("gone"))
    return c.withColumn("republish", (F.col("known") > 0) & (F.col("found") > 0) & (F.col("fresh") > share * F.col("found")) & (F.col("gone") > share * F.col("known")))


def content_digest(df: DataFrame, group: Sequence[str], columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A version of each group for caches: the md5 of its rows' md5s, written out in order. Rows are hashed before they
    meet, so a group gathers a few bytes for each row."""
    row = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(o) for o in order], row.alias("_row"))))
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(rows, lambda r: r["_row"]), ",")).alias("digest"))


def append_layer_version(versions: DataFrame, layer: str, version: str, at: str, strictness: dict[str, int], terms: str) -> DataFrame:
    """The current version of each layer: the newest row, under the strictest of its inputs' terms."""
    rank = F.lit(None).cast("int")
    for name, r in strictness.items():
        rank = F.when(F.col(terms) == name, r).otherwise(rank)
    return versions.groupBy(layer).agg(F.max_by(version, F.struct(at, version)).alias("current"), F.max_by(terms, rank).alias("strictest"), F.count("*").alias("versions"))


def ownership(claims: DataFrame, item: str, owner: str) -> DataFrame:
    """The partition check: items that no owner or several claim. An ownerless item has a null owner."""
    c = claims.groupBy(item).agg(F.countDistinct(owner).alias("owners"), F.array_sort(F.collect_set(owner)).alias("claimed_by"))
    return c.where("owners <> 1")


def changed_sources(state: DataFrame, signature: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Sources to read again: those whose signature (count, greatest id, last edit) differs from the one held."""
    held = state.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    s = signature.join(held, key, "left")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return s.where(~same).select(signature.columns)


def merged_maps(a: Column, b: Column) -> Column:
    """The keys of both, the second's values over the first's; null values go."""
    kept = F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))
    return F.map_filter(F.map_concat(kept, b), lambda k, v: v.isNotNull())
