"""MinHash fingerprints of whole texts, their likeness, and near-duplicate classes through signature bands."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrolith.io import cut, stored
from metrolith.llm.substring import _BYTES, _WORDS, _ranges
from metrolith.llm.text import by_size, in_pieces, lean
from metrolith.operators.graph import connected_components

SHINGLE, PERMUTATIONS, SEED = 5, 128, 7
SLICE = 2 << 20
#: Texts, or pieces of very long ones, whose shingles are hashed at a time.
PARTS = 4096
#: Bands of a signature; at a likeness of 0.8, 1 - (1 - 0.8^4)^32 leaves out two pairs in ten million.
BANDS = 32


def _coefficients(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, n, dtype=np.uint64)


def shingle_hashes(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): 64-bit hashes of every text's k-word shingles; fewer words are one shingle, none none."""
    joined = [b" ".join(t.lower().split()) for t in texts]
    words = np.fromiter((j.count(b" ") + 1 if j else 0 for j in joined), np.int64, len(joined))
    counts = np.where(words == 0, 0, np.maximum(words - k + 1, 1))
    data = np.frombuffer(b" ".join([j for j in joined if j]), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), counts
    spaces = np.flatnonzero(data == 32)
    each = _ranges(data.astype(np.uint64), np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(data)]]), _BYTES)
    some, n = words[words > 0], counts[words > 0]
    first = np.concatenate([[0], np.cumsum(some)])[:-1]
    at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n)
    return _ranges(each, at, np.minimum(at + k, np.repeat(first + some, n)), _WORDS), counts


def signatures(texts: list[bytes], permutations: int = PERMUTATIONS, seed: int = SEED, k: int = SHINGLE) -> np.ndarray:
    """A row of `permutations` 16-bit values for each text: the least of a universal hash a x + b over its shingles.

    The 64-bit least is brought down to 16 bits; two different ones agree by chance once in 65,536. A text without
    words has the row of all ones.
    """
    out = np.full((len(texts), permutations), 0xFFFF, np.uint16)
    least, seen = np.full((len(texts), permutations), np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(len(texts), bool)
    parts, of = in_pieces(texts, k)
    for lo in range(0, len(parts), PARTS):  # so that batches of very long texts take no more memory
        some, found = _least(parts[lo : lo + PARTS], permutations, seed, k)
        np.minimum.at(least, of[lo : lo + PARTS][some], found)
        seen[of[lo : lo + PARTS][some]] = True
    out[seen] = ((least[seen] ^ (least[seen] >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.uint16)
    return out


def _least(texts: list[bytes], permutations: int, seed: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have shingles, and the least of each hash over them."""
    a, b = _coefficients(permutations, seed)
    hashes, counts = shingle_hashes(texts, k)
    some = np.flatnonzero(counts)
    least = np.full((len(some), permutations), np.uint64(0xFFFFFFFFFFFFFFFF))
    if not len(some):
        return some, least
    ends = np.cumsum(counts[some])
    begins = np.concatenate([[0], ends[:-1]])
    step = 1 << 15  # shingles at a time stay in the cache
    for lo in range(0, len(hashes), step):
        hi = min(lo + step, len(hashes))
        i, j = np.searchsorted(ends, lo, "right"), np.searchsorted(begins, hi, "left")
        cuts, part = np.maximum(begins[i:j] - lo, 0), hashes[lo:hi]
        for p in range(permutations):
            least[i:j, p] = np.minimum(least[i:j, p], np.minimum.reduceat(part * a[p] + b[p], cuts))
    return some, least


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The share of equal values by row: an estimate of the Jaccard similarity of the shingle sets."""
    return (x == y).mean(axis=-1)


def edited(text: str, following: str) -> str:
    """The last quarter of a text replaced by the first as many code points of another."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _bucketed(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, last, doc_id, text): ranges of doc_id; each bucket also gets the first row of the next one, flagged last.

    The bounds are quantiles, the first rows are one for each bucket: both are small, whatever the table. They come from
    the ids alone; texts are read once.
    """
    bounds = [int(x) for x in docs.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.2 / buckets)] if buckets > 1 else []
    bounds = sorted(set(bounds))
    at = F.lit(0)
    if bounds:
        above = F.array(*map(F.lit, bounds))
        at = F.coalesce(F.size(F.filter(above, lambda b: b <= F.col("doc_id"))), F.lit(0))
    d = docs.withColumn("bucket", at.cast("int"))
    firsts = d.groupBy("bucket").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("nulls")).orderBy("bucket").collect()
    if not firsts:
        return d.select("bucket", F.lit(False).alias("last"), "doc_id", "text")
    # The first row of a bucket goes to the one before it as well, that of the first to the last.
    to, null_to = {}, None
    for before, row in zip([firsts[-1], *firsts[:-1]], firsts):
        if row["nulls"]:
            null_to = before["bucket"]
        else:
            to[row["first"]] = before["bucket"]
    known = F.create_map(*[F.lit(x) for pair in to.items() for x in pair]) if to else F.create_map().cast("map<bigint,int>")
    also = F.when(F.col("doc_id").isNull(), F.lit(null_to).cast("int")).otherwise(F.try_element_at(known.cast("map<bigint,int>"), F.col("doc_id")))
    place = lambda bucket, last: F.struct(bucket.alias("bucket"), F.lit(last).alias("last"))
    both = F.when(also.isNull(), F.array(place(F.col("bucket"), False))).otherwise(F.array(place(F.col("bucket"), False), place(also, True)))
    return d.withColumn("at", F.explode(both)).select("at.bucket", "at.last", "doc_id", "text")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame, permutations: int = PERMUTATIONS, seed: int = SEED, k: int = SHINGLE,
                          doc_id: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """The fingerprint of every text and of its edited text, and how like it is to the edited and to the next text's.

    A text's last floor(n_chars / 4) code points are replaced by the first as many (or all) of the next document by
    ascending doc_id; after the last comes the first. A fingerprint is a MinHash signature in hex: equal texts have
    equal ones, and likeness (0 to 1) is the share of equal values. Texts without words are alike among themselves only.

    Null texts count as empty. Null doc_ids come first; rows of one doc_id follow each other by text, so the order is
    total up to equal rows. A single row is its own next. Empty tables give empty results; other columns are ignored.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    n = buckets or int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = _bucketed(d, n)

    def finished(rows: list[tuple], nexts: list[str]) -> pa.RecordBatch:
        texts = [t for _, t in rows]
        edits = [edited(t, f) for t, f in zip(texts, nexts)]
        follow = [] if not rows else [nexts[-1]]
        coded = [t.encode() for t in edits]
        sig = signatures([t.encode() for t in texts + follow] + coded, permutations, seed, k)
        own, after, new = sig[: len(rows)], sig[1 : len(rows) + 1], sig[len(rows) + len(follow) :]
        hexed = lambda s: [x.tobytes().hex() for x in s.astype(">u2")]
        columns = [
            [i for i, _ in rows], [len(t) for t in texts], [hashlib.sha256(e).hexdigest() for e in coded], hexed(own), hexed(new),
            likeness(own, new), likeness(own, after),
        ]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=[x.split()[0] for x in OUT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of one bucket whose successors aren't all known
        size, of, done = 0, None, False
        for batch in batches:
            rows = (x for part in by_size(batch, 3) for x in zip(*(c.to_pylist() for c in part.columns)))
            for bucket, last, key, t in rows:
                if bucket != of:
                    assert not held or done
                    held, size, of, done = [], 0, bucket, False
                if done:  # more rows share the next bucket's first doc_id
                    continue
                if last:
                    if held:
                        yield finished(held, [x for _, x in held[1:]] + [t])
                    held, done = [], True
                    continue
                held.append((key, t))
                size += len(t)
                if size >= SLICE and len(held) > 1:
                    yield finished(held[:-1], [x for _, x in held[1:]])
                    held = held[-1:]
                    size = len(held[0][1])

    dealt = d.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "last", F.asc_nulls_first("doc_id"), "text")
    return dealt.mapInArrow(lean(run), OUT)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS, permutations: int = PERMUTATIONS, seed: int = SEED,
                    k: int = SHINGLE, rounds: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id) for every row: classes of texts linked by a Jaccard similarity of `threshold` or more.

    Texts with the same set of shingles are one class to begin with, and one of them stands for all. Bands of the
    signatures bring classes together; each candidate pair's similarity is verified on the sets of shingle hashes.
    First come a few rounds in which each bucket's members meet one of them, a different one each time: pairs as many as
    members. After that, only pairs of a bucket whose members don't hang together yet are verified: all of those, so no
    link between different texts is lost that shares a band. class_id is the smallest doc_id of a class.

    Null texts count as empty and are one class with texts without words; null doc_ids keep their rows. Repeated rows
    are exact copies. Empty tables give empty results; other columns are ignored.
    """
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in by_size(whole, 1)):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            parts, of = in_pieces(texts, k)
            hashes, counts = shingle_hashes(parts, k)
            cuts = np.cumsum(np.bincount(of, counts, len(texts)).astype(np.int64)) if len(texts) else []
            found = [np.unique(h) for h in np.split(hashes, cuts[:-1])] if len(texts) else []
            sig = signatures(texts, permutations, seed, k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found], pa.binary()),
                 pa.array([s.view(np.int64).tolist() for s in found], pa.list_(pa.int64())),
                 pa.array([[int.from_bytes(hashlib.blake2b(bytes([i]) + x.tobytes(), digest_size=8).digest(), "little", signed=True) for i, x in enumerate(np.split(s, bands))] for s in sig], pa.list_(pa.int64()))],
                names=["doc_id", "cls", "shingles", "bands"])

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    d = stored(d.mapInArrow(lean(sets), "doc_id long, cls binary, shingles array<long>, bands array<long>"))
    classes = stored(d.groupBy("cls").agg(F.min("doc_id").alias("low"), F.first("shingles").alias("shingles"), F.first("bands").alias("bands")))
    banded = classes.select("cls", F.explode("bands").alias("band"))
    shared = cut(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"))
    banded = stored(banded.join(shared, "band"))
    held = classes.select("cls", "shingles")

    def verified(pairs: DataFrame) -> DataFrame:
        both = cut(pairs.distinct()).join(held.select(F.col("cls").alias("a"), F.col("shingles").alias("s")), "a").join(held.select(F.col("cls").alias("b"), F.col("shingles").alias("t")), "b")
        common = F.size(F.array_intersect("s", "t"))
        return cut(both.where(common >= threshold * (F.size("s") + F.size("t") - common)).select("a", "b"))

    def joined(links: DataFrame) -> DataFrame:
        """The members of buckets, with what they hang together with so far."""
        ties = connected_components(links).withColumnRenamed("node", "cls")
        return cut(banded.join(cut(ties), "cls", "left").select("cls", "band", F.coalesce("component", "cls").alias("component")))

    links, members = None, banded.withColumn("component", F.col("cls"))
    for i in range(rounds):
        leaders = cut(members.groupBy("band").agg(F.min(F.struct(F.xxhash64("cls", F.lit(i)).alias("h"), F.col("cls").alias("a"), F.col("component").alias("c"))).alias("l")))
        pairs = members.join(leaders, "band").where(F.col("component") != F.col("l.c"))
        now = verified(pairs.select(F.least("l.a", "cls").alias("a"), F.greatest("l.a", "cls").alias("b")))
        links = now if links is None else cut(links.union(now))
        members = joined(links)
    apart = members.alias("x").join(members.alias("y"), "band").where("x.component < y.component")
    links = cut(links.union(verified(apart.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")))))
    ties = cut(connected_components(links))
    of = classes.join(ties.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "low", F.coalesce("component", "cls").alias("component"))
    of = cut(of)
    least = cut(of.groupBy("component").agg(F.min("low").alias("class_id")))
    of = cut(of.join(least, "component").select("cls", "class_id"))
    return d.select("doc_id", "cls").join(of, "cls").select("doc_id", "class_id")
