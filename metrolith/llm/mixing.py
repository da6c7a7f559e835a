"""Mixing sources to target weights along a time-varying curriculum.

Native: DataFrame functions only.

Each source has a target number of words and a weight schedule over training time t in [0, 1]. The integral of the
schedule, scaled to the target, is the source's cumulative word demand; inverting it at the place where a document
copy stands in its source's order gives that copy's training position. Sorting by position gives the mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from metrolith.io import cut, stored
from metrolith.llm.text import word_count

#: Knots (t, weight) of piecewise linear schedules: level, fading, rising. Sources take them in turn.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)))
#: Rows of the whole table for each bucket of the order, and the most buckets; both only deal out the work.
BUCKET_ROWS, MOST_BUCKETS = 500, 65_536


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """(source, idx, source_size, target) for each source of (source, size).

    Sources in code point order, null last, take the weights in turn and share `share` times all words. A target
    stops at `most` times its source's size, and the excess is dealt out again by weight until none is above. That
    process ends where targets are min(cap, level * weight): sources are capped in order of cap / weight.
    The windows run over one row for each source.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("idx", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("idx") % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    whole = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(whole) * F.lit(float(share))).withColumn("all_w", F.sum("w").over(whole))
    before = Window.orderBy(F.col("cap") / F.col("w"), "idx").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("capped", level > F.col("cap") / F.col("w"))
    kept = lambda c: F.sum(F.when(F.col("capped"), F.col(c)).otherwise(F.lit(0.0))).over(whole)
    s = s.withColumn("level", (F.col("total") - kept("cap")) / F.nullif(F.col("all_w") - kept("w"), F.lit(0.0)))
    return s.select("source", "idx", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w"))).alias("target"))


def _segments(schedules) -> tuple[Column, Column]:
    """The schedules' segments with the integral before each, and the whole integrals; both by schedule."""
    rows, wholes = [], []
    for knots in schedules:
        cum, out = 0.0, []
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            out.append(F.struct(F.lit(t0).alias("t"), F.lit(float(w0)).alias("w"), F.lit((w1 - w0) / (t1 - t0)).alias("slope"), F.lit(cum).alias("cum")))
            cum += (w0 + w1) / 2 * (t1 - t0)
        rows.append(F.array(*out))
        wholes.append(F.lit(cum))
    return F.array(*rows), F.array(*wholes)


def training_position(done: Column, schedule: Column, schedules=SCHEDULES) -> Column:
    """The time at which a schedule's integral reaches the share `done` of its whole."""
    rows, wholes = _segments(schedules)
    need = done * F.get(wholes, schedule)
    at = F.element_at(F.filter(F.get(rows, schedule), lambda s: (s["cum"] <= need) | (s["cum"] == 0.0)), -1)
    rest = F.greatest(need - at["cum"], F.lit(0.0))
    root = at["w"] + F.sqrt(F.greatest(at["w"] * at["w"] + 2 * at["slope"] * rest, F.lit(0.0)))
    return F.least(F.lit(1.0), at["t"] + F.when(root > 0, 2 * rest / root).otherwise(F.lit(0.0)))


def mix_plan(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
             schedules=SCHEDULES, doc_id: str = "doc_id", text: str = "text", source: str = "source", row: Column | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, positions) for every document, and `row`, if given, as row_key.

    A source's documents stand in the order of a hash. The mix takes round(target) words of that order: whole passes,
    then the start of another, so the last document taken may be cut. `taken` counts words, repeats included;
    `positions` has the training position of each copy.

    Null texts have size 0; null sources are one source, the last. Rows are not told apart by doc_id, which may be
    null or repeated; repeated rows follow each other in the order. Empty tables give empty results. Other columns are
    ignored, whatever their names. The same rows always give the same result, however they are partitioned.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), *([row.alias("row_key")] if row is not None else []))
    d = stored(d.withColumn("ord", F.xxhash64("doc_id", "source", "size")))
    rows = d.count()
    buckets = max(1, min(MOST_BUCKETS, rows // BUCKET_ROWS))
    place = F.shiftrightunsigned("ord", 11).cast("double") * F.lit(2.0**-53)
    d = d.withColumn("bucket", F.floor(place * buckets)).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    src = cut(source_targets(d, weights, share, most))
    src = src.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key"), "idx", "source_size", "target", F.round("target").cast("long").alias("words"))
    sums = d.groupBy("key", "bucket").agg(F.sum("size").alias("of_bucket"))
    run = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("of_bucket").over(run), F.lit(0))).drop("of_bucket")
    sums = sums.join(src, "key")
    d = d.join(cut(sums), ["key", "bucket"])
    inside = Window.partitionBy("key", "bucket").orderBy("ord", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.withColumn("passes", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0)))
    part = F.least(F.greatest(F.expr("words - passes * source_size - ahead"), F.lit(0)), F.col("size"))
    d = d.withColumn("part", part).withColumn("copies", F.col("passes") + (F.col("part") > 0).cast("long"))
    at = lambda j: training_position((j * F.col("source_size") + F.col("ahead")) / F.col("words"), F.col("idx") % len(schedules), schedules)
    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), at)).otherwise(F.array().cast("array<double>"))
    return d.select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("part")).alias("taken"), "copies", positions.alias("positions"), *(["row_key"] if row is not None else []))


def range_sorted(plan: DataFrame) -> DataFrame:
    """One row for each copy of the mix, range-sorted by training position: the order in which to train."""
    return plan.select("*", F.posexplode("positions").alias("copy", "position")).orderBy("position", "doc_id", "copy")


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word; null and texts of no more words are as they are."""
    return F.when(n < word_count(text), F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), n), "")).otherwise(text)


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """The mix as documents, range-sorted by the training position of each copy, with their own columns.

    Each stands as often as the mix takes it; the copy that ends a source's share is cut after the words that are taken,
    so sources have the words of their targets. Documents that the mix doesn't take are left out. Rows and their plan
    meet by a hash of all their columns: rows that are equal in every column share their plans out among them.
    """
    doc_id, text = (kw.get(k, k) for k in ("doc_id", "text"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    row = F.xxhash64(*[c if not isinstance(f.dataType, MapType) else F.map_entries(c) for c, f in zip(names, docs.schema)])
    plan = mix_plan(docs, row=row, **kw).where("taken > 0")
    each = F.transform("positions", lambda p, i: F.struct(p.alias("position"), F.least(F.col("size"), F.col("taken") - i * F.col("size")).cast("int").alias("words")))
    plan = plan.groupBy(F.col("row_key").alias("_row")).agg(F.sort_array(F.collect_list(F.struct("doc_id", each.alias("copies")))).alias("_plans"))
    d = docs.withColumn("_row", row).withColumn("_nth", F.row_number().over(Window.partitionBy("_row").orderBy(F.lit(0))) - 1)
    joined = d.join(plan, "_row").withColumn("_copy", F.explode(F.get("_plans", F.col("_nth"))["copies"]))
    again = joined.withColumn(text, first_words(F.col(f"`{text}`"), F.col("_copy.words"))).orderBy("_copy.position", F.col(f"`{doc_id}`"))
    return again.select(*names)
