"""SimHash fingerprints, and near-duplicate groups by bit-sliced comparison."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrolith.io import cut, stored
from metrolith.llm.text import by_size, in_pieces, lean
from metrolith.operators.graph import connected_components

# The five primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Members of a bucket that are compared at once; larger buckets are split by further bits they agree on.
MOST_IN_BUCKET = 2048


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64_ranges(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of data[start : start + length] for every range; data is uint8, followed by 8 bytes of padding at least."""
    n = len(data) - 7
    u64 = np.ndarray((n,), "<u8", data, strides=(1,))
    u32 = np.ndarray((n,), "<u4", data, strides=(1,))
    seed = np.uint64(seed)
    lengths = lengths.astype(np.int64)
    out = np.empty(len(starts), np.uint64)
    order = np.argsort(lengths, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
        length, at = int(lengths[some[0]]), starts[some].astype(np.int64)
        end = at + length
        if length >= 32:
            begin = (int(seed) + int(P1) + int(P2), int(seed) + int(P2), int(seed), int(seed) - int(P1))
            acc = [np.full(len(at), v % 2**64, np.uint64) for v in begin]
            for _ in range(length // 32):
                for i in range(4):
                    acc[i] = _rotl(acc[i] + u64[at + 8 * i] * P2, 31) * P1
                at = at + 32
            h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for v in acc:
                h = (h ^ (_rotl(v * P2, 31) * P1)) * P1 + P4
        else:
            h = np.full(len(at), (int(seed) + int(P5)) % 2**64, np.uint64)
        h = h + np.uint64(length)
        rest = length % 32
        for _ in range(rest // 8):
            h = _rotl(h ^ (_rotl(u64[at] * P2, 31) * P1), 27) * P1 + P4
            at = at + 8
        if rest % 8 >= 4:
            h = _rotl(h ^ (u32[at].astype(np.uint64) * P1), 23) * P2 + P3
            at = at + 4
        for _ in range(rest % 4):
            h = _rotl(h ^ (data[at].astype(np.uint64) * P5), 11) * P1
            at = at + 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        out[some] = h ^ (h >> np.uint64(32))
    return out


def shingle_ranges(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, lengths, counts): the k-word shingles of every text, words joined by one space.

    A text of fewer words has one shingle, the whole of it; one without words has none.
    """
    joined = [b" ".join(t.split()) for t in texts]
    data = np.frombuffer(b" ".join([*joined, b"        "]), np.uint8)
    sizes = np.fromiter(map(len, joined), np.int64, len(joined))
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    words = np.fromiter((j.count(b" ") + 1 if j else 0 for j in joined), np.int64, len(joined))
    counts = np.where(words == 0, 0, np.maximum(words - k + 1, 1))
    # Word starts of all texts, in order; a text without words has none.
    spaces = np.flatnonzero(data == 32)
    inner = np.ones(len(spaces), bool)
    text_ends = begins + sizes
    inner[np.searchsorted(spaces, text_ends)] = False
    inner[np.searchsorted(spaces, text_ends[-1] if len(text_ends) else 0):] = False
    word_starts = np.sort(np.concatenate([begins[words > 0], spaces[inner] + 1]))
    first = np.concatenate([[0], np.cumsum(words)])[:-1]
    total = int(counts.sum())
    of = np.repeat(np.arange(len(joined)), counts)
    within = np.arange(total) - np.repeat(np.concatenate([[0], np.cumsum(counts)])[:-1], counts)
    w0 = first[of] + within
    last = np.minimum(w0 + k, (first + words)[of])  # one past the last word
    starts = word_starts[w0]
    at_end = last >= (first + words)[of]
    ends = np.where(at_end, text_ends[of], word_starts[np.minimum(last, len(word_starts) - 1)] - 1 if len(word_starts) else 0)
    return data, starts, ends - starts, counts


def simhashes(texts: list[bytes], k: int = 3, seed: int = 42, words: int = 1) -> np.ndarray:
    """The fingerprint of each text, from UTF-8 bytes: a bit is set if it is in over half of the shingles' hashes.

    With several `words` a row of them for each text: the hashes are widened by mixing.
    """
    parts, of = in_pieces(texts, k)
    sums, counts, at = np.zeros((len(texts), 64 * words), np.int32), np.zeros(len(texts), np.int64), 0
    for some in _in_slices(parts):
        found, n = _votes([t.lower() for t in some], k, seed, words)
        np.add.at(sums, of[at : at + len(some)], found)
        np.add.at(counts, of[at : at + len(some)], n)
        at += len(some)
    out = np.packbits(sums * 2 > counts[:, None], axis=1, bitorder="little").view(np.uint64).reshape(len(texts), words)
    return out[:, 0] if words == 1 else out


def _votes(texts: list[bytes], k: int, seed: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text how many shingles' hashes have each bit, and the number of shingles."""
    data, starts, lengths, counts = shingle_ranges(texts, k)
    hashes = xxh64_ranges(data, starts, lengths, seed)
    out = np.zeros((len(texts), 64 * words), np.int32)
    some = np.flatnonzero(counts)
    if len(some):
        ends = np.cumsum(counts[some])
        begins = np.concatenate([[0], ends[:-1]])
        step = (1 << 16) // words
        for lo in range(0, len(hashes), step):  # by pieces, so that very long texts take no more memory
            hi = min(lo + step, len(hashes))
            i, j = np.searchsorted(ends, lo, "right"), np.searchsorted(begins, hi, "left")
            wide = np.stack([hashes[lo:hi] if w == 0 else _mixed(hashes[lo:hi], w) for w in range(words)], axis=1)
            bits = np.unpackbits(wide.view(np.uint8).reshape(hi - lo, -1), axis=1, bitorder="little")
            cuts = np.maximum(begins[i:j] - lo, 0)
            out[some[i:j]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    return out, counts


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt * int(P1) % 2**64)) * P2
    x = (x ^ (x >> np.uint64(29))) * P3
    return x ^ (x >> np.uint64(32))


def _in_slices(texts: list[bytes], most_bytes: int = 2 << 20) -> Iterator[list[bytes]]:
    some: list[bytes] = []
    size = 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= most_bytes:
            yield some
            some, size = [], 0
    if some:
        yield some


def fingerprints(docs: DataFrame, k: int = 3, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long. Null texts count as empty: fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in by_size(whole, 1)):
            fp = simhashes([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()], k, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, fp long")


def close_pairs(values: np.ndarray, group: np.ndarray, radius: int, begin: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (i, j), i < j, of values of one group that differ in at most `radius` bits; rows are sorted by group.

    They come some at a time, so that a group of many close values takes no more memory than one of few. With `begin`,
    value i is compared with those from begin[i] on, and not with all later ones.

    Values are 64-bit words, or rows of several. Bit planes are stored vertically: word b of plane p has bit p of values
    64b..64b+63. Each query runs down the planes of every block that holds later members of its group, and carry-save
    counters add up 64 distances at once. What leaves the counters is above the radius for good; a block is abandoned
    once no distance in it can still be small enough.
    """
    n, width = len(values), 64 * (values.size // max(len(values), 1))
    blocks = -(-n // 64)
    padded = np.zeros((blocks * 64, width // 64), np.uint64)
    padded[:n] = values.reshape(n, -1)
    bits = np.unpackbits(padded.view(np.uint8).reshape(blocks * 64, -1), axis=1, bitorder="little")  # value x plane
    planes = np.packbits(bits.reshape(blocks, 64, width).transpose(2, 0, 1), axis=2, bitorder="little").reshape(width, blocks, 8)
    planes = np.ascontiguousarray(planes).view(np.uint64).reshape(width, blocks)
    ends = np.concatenate([np.flatnonzero(np.diff(group)) + 1, [n]])
    end_of = ends[np.searchsorted(ends, np.arange(n), "right")] if n else ends
    begin = np.arange(1, n + 1) if begin is None else begin
    queries = np.flatnonzero(end_of > begin)
    first, last = begin[queries] // 64, (end_of[queries] - 1) // 64
    per = last - first + 1
    depth = max(1, int(radius + 1).bit_length())
    step = 1 << 15
    bounds = np.searchsorted(np.cumsum(per), np.arange(step, int(per.sum()) + step, step), "left") + 1
    for some in np.split(np.arange(len(queries)), bounds[bounds < len(queries)]):
        if not len(some):
            continue
        q = np.repeat(queries[some], per[some])
        within = np.arange(len(q)) - np.repeat(np.concatenate([[0], np.cumsum(per[some])])[:-1], per[some])
        b = np.repeat(first[some], per[some]) + within
        lo = np.clip(begin[q] - 64 * b, 0, 64)
        hi = np.clip(end_of[q] - 64 * b, 0, 64)
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        upto = lambda x: np.where(x >= 64, full, (np.uint64(1) << (x % 64).astype(np.uint64)) - np.uint64(1))
        alive = upto(hi) & ~upto(lo)
        counter = [np.zeros(len(q), np.uint64) for _ in range(depth)]
        over = np.zeros(len(q), np.uint64)
        for p in range(width):
            if p % 64 == 0:
                value = padded[q, p // 64]
            same = (value >> np.uint64(p % 64)) & np.uint64(1)
            carry = planes[p][b] ^ (np.uint64(0) - same)
            for c in range(depth):  # carry-save: add one bit to 64 counters
                counter[c], carry = counter[c] ^ carry, counter[c] & carry
            over |= carry
            if p % 8 == 7 and (p > radius or p == width - 1):
                # Distances above the radius: those whose counter, read from its highest bit, is greater.
                greater, equal = over.copy(), full
                for c in reversed(range(depth)):
                    if not radius >> c & 1:
                        greater |= counter[c] & equal
                        equal = equal & ~counter[c]
                    else:
                        equal = equal & counter[c]
                alive &= ~greater
                keep = np.flatnonzero(alive)
                if len(keep) < 0.7 * len(alive):
                    q, b, value, alive, over = q[keep], b[keep], value[keep], alive[keep], over[keep]
                    counter = [x[keep] for x in counter]
                if not len(q):
                    break
        if len(q):
            hits = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, lane = np.nonzero(hits)
            yield q[row], 64 * b[row] + lane


def linked(values: np.ndarray, group: np.ndarray, radius: int, begin: np.ndarray | None = None) -> np.ndarray:
    """For each value the smallest index that it reaches by close pairs."""
    root = np.arange(len(values))
    for i, j in close_pairs(values, group, radius, begin):
        a, b = root[i], root[j]
        apart = a != b
        if apart.any():
            root = _spanning(len(values), a[apart], b[apart])[root]
    return root


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each, over the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[root]
        if np.array_equal(new, root):
            break
        root = new
    return root


def _mask_tree(radius: int, levels: int) -> list[list[tuple[int, list[int]]]]:
    """By level: (mask, its finer masks). Values within the radius agree on one of radius + 1 parts of any set of bits."""
    def parts(free: list[int]) -> list[int]:
        return [sum(1 << int(x) for x in p) for p in np.array_split(free, radius + 1) if len(p)]

    out, masks = [], parts(list(range(64)))
    for _ in range(levels):
        finer = {m: [m | p for p in parts([i for i in range(64) if not m >> i & 1])] for m in masks}
        out.append([(m, finer[m]) for m in masks])
        masks = sorted({x for f in finer.values() for x in f})
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, radius: int = 2, most: int = MOST_IN_BUCKET) -> DataFrame:
    """(a, b): links among the distinct values `fp` that join exactly those reachable by steps of `radius` bits at most.

    Values within the radius agree on one of radius + 1 parts of their bits, so they meet in a bucket keyed by that
    part. Buckets of one are dropped, and those of more than `most` are split again by the bits that are left, where
    the same holds: the split is exact, and since values are distinct it ends. Within a bucket, the found pairs are
    brought down to a spanning star for each part that hangs together, so links never exceed members.
    """
    spark = fps.sparkSession
    levels = _mask_tree(radius, 4 if radius <= 2 else 3)
    masks = [m for m, _ in levels[0]]
    members = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    found = []
    for depth, level in enumerate(levels):
        members = members.withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = cut(members.groupBy("mask", "part").agg(F.count("*").alias("n")).where("n > 1"))
        sized = members.join(sizes, ["mask", "part"])
        last = depth == len(levels) - 1
        found.append(_compare(sized if last else sized.where(F.col("n") <= most), radius))
        if last or not sizes.where(F.col("n") > most).limit(1).count():
            break
        finer = F.lit(None).cast("array<bigint>")
        for m, more in level:
            finer = F.when(F.col("mask") == _signed(m), F.array(*[F.lit(_signed(x)) for x in more])).otherwise(finer)
        # Two ways can lead to one bucket; each value is wanted there once.
        members = cut(sized.where(F.col("n") > most).select("fp", F.explode(finer).alias("mask")).distinct())
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _compare(sized: DataFrame, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def compared(rows: np.ndarray) -> pa.RecordBatch:
            mask, part, fp = rows
            new = (np.diff(mask) != 0) | (np.diff(part) != 0)
            group = np.concatenate([[0], np.cumsum(new)]) if len(fp) else np.zeros(0, np.int64)
            root = linked(fp.view(np.uint64), group, radius)
            tied = np.flatnonzero(root != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[tied]), pa.array(fp[root[tied]])], names=["a", "b"])

        for batch in batches:
            rows = np.stack([np.ascontiguousarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns])
            rows = np.concatenate([*held, rows], axis=1) if held else rows
            change = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0))
            whole = int(change[-1]) + 1 if len(change) else 0
            if whole:
                yield compared(np.ascontiguousarray(rows[:, :whole]))
            held = [np.ascontiguousarray(rows[:, whole:])]  # the last bucket may go on
        if held and held[0].shape[1]:
            yield compared(held[0])

    dealt = sized.select("mask", "part", "fp").repartition("mask", "part").sortWithinPartitions("mask", "part", "fp")
    return dealt.mapInArrow(lean(run), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 2, k: int = 3, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Texts are lower-cased in A-Z and cut into words at ASCII white space; shingles of k words, repeats included, vote
    for the bits. Fingerprints that differ in at most `radius` bits are linked; component_id is the smallest doc_id
    reachable. Exact copies, repeated rows and all texts without words (null, empty; fingerprint 0) share a fingerprint
    and so a component. A null doc_id keeps its row, but never names a component unless all its members are null.
    Very long texts are hashed piece by piece, so they take no more memory than others. Empty tables give empty results; other columns are ignored.
    """
    fps = stored(fingerprints(docs, k, seed, doc_id, text))
    low = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    ties = cut(connected_components(cut(links(low, radius).distinct())))
    # Fingerprints with links: the smallest doc_id of their component. The rest stand alone.
    of = low.join(ties.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    of = cut(of)
    least = cut(of.groupBy("component").agg(F.min("low").alias("component_id")))
    of = cut(of.select("fp", "component").join(least, "component").select("fp", "component_id"))
    out = fps.join(of, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Words of a wide fingerprint, tables of sampled bits, bits of a table's key, and bits by which large buckets are split.
WORDS, TABLES, KEY_BITS, MORE_BITS, LEVELS = 6, 50, 14, 8, 5


def radius_of(similarity: float, bits: int, slack: float = 1.0) -> int:
    """The distance of wide fingerprints that stands for a Jaccard similarity of shingle sets.

    Sets of one size with the similarity J have the cosine 2J / (1 + J), and each bit differs with the probability
    acos(cosine) / pi. `slack` standard deviations above the mean are allowed.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * p + slack * math.sqrt(bits * p * (1 - p)))


def _sampled(words: int, tables: int, seed: int) -> np.ndarray:
    """For each table an order of all bits: its key takes the first ones."""
    r = np.random.default_rng(seed)
    return np.stack([r.permutation(64 * words) for _ in range(tables)])


def _keys(fps: np.ndarray, order: np.ndarray, bits: int) -> np.ndarray:
    """The key of each fingerprint: the bits at the first `bits` places of the order (one order, or one for each)."""
    unpacked = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    picked = unpacked[:, order[:bits]] if order.ndim == 1 else np.take_along_axis(unpacked, order[:, :bits], axis=1)
    return picked.astype(np.int64) @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def text_key(text: Column | str) -> Column:
    """128 bits that tell a text from others; null and empty are the same."""
    return F.unhex(F.md5(F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))))


def similar_groups(docs: DataFrame, similarity: float = 0.8, k: int = 5, seed: int = 42, words: int = WORDS, tables: int = TABLES,
                   key_bits: int = KEY_BITS, most: int = MOST_IN_BUCKET, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component_id, component, text_key) for every row: groups of texts whose shingle sets have a Jaccard similarity of about
    `similarity` or more, by fingerprints of 64 * words bits that lie within radius_of(similarity).

    That radius is too wide for the exact buckets of near_duplicates(). Here each of `tables` tables keys its buckets by
    key_bits sampled bits; members of a bucket are compared bit-sliced, as there. A pair at the radius' mean shares a
    bucket of some table with a probability of 99 percent, one at the radius of 97 percent; key_bits should grow with the logarithm
    of the number of documents, and tables with it. Buckets of more than `most` are keyed by more bits first, in all of
    which near copies mostly agree; then what does not hang together yet in such a bucket is compared all the same, in
    pairs of blocks. So the size of a bucket does not decide which of its members are grouped.

    Nulls, empty texts, repeated rows and empty tables are as in near_duplicates(). Groups whose members' doc_ids are all
    null share a null component_id; `component` tells all groups apart.
    """
    radius = radius_of(similarity, 64 * words)
    order = _sampled(words, tables, seed)
    names = [f"w{i}" for i in range(words)]
    fp_schema = ", ".join(f"{w} long" for w in names)

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in by_size(whole, 1)):
            fp = simhashes([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()], k, seed, words).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(np.ascontiguousarray(fp[:, i])) for i in range(words))], names=["doc_id", "text_key", *names])

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), text_key(text).alias("text_key"))
    fps = stored(d.mapInArrow(lean(wide), "doc_id long, text_key binary, " + fp_schema).withColumn("node", F.xxhash64(*names)))
    low = stored(fps.groupBy("node", *names).agg(F.min("doc_id").alias("low")))

    def columns(batch: pa.RecordBatch, at: int) -> np.ndarray:
        return np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[at : at + words]], axis=1) if batch.num_rows else np.zeros((0, words), np.int64)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                fp = columns(batch, 1)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), t, np.int32)), pa.array(_keys(fp, order[t], key_bits)), *batch.columns], names=["mask", "part", "node", *names])

    def longer(bits: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                table = batch.column(0).to_numpy()
                fp = columns(batch, 2)
                part = _keys(fp, order[table], bits) if len(fp) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part), *batch.columns[1:]], names=["mask", "part", "node", *names])

        return run

    schema = "mask int, part long, node long, " + fp_schema
    members = low.select("node", *names).mapInArrow(lean(keyed), schema)
    found, bits, large = None, key_bits, None
    for level in range(LEVELS):
        sizes = cut(members.groupBy("mask", "part").agg(F.count("*").alias("n")).where("n > 1"))
        sized = members.join(sizes, ["mask", "part"])
        now = _compare_wide(sized.where(F.col("n") <= most), names, radius)
        found = now if found is None else found.union(now)
        if level == LEVELS - 1 or not sizes.where(F.col("n") > most).limit(1).count():
            break
        bits += MORE_BITS
        over = stored(sized.where(F.col("n") > most).select("mask", "part", "node", *names))
        large = over if large is None else large
        members = over.drop("part").mapInArrow(lean(longer(bits)), schema)
    ties = cut(connected_components(cut(found.distinct())))
    if large is not None:
        more = cut(_compare_wide(_block_pairs(large, ties, names, most), names, radius, blocks=True).distinct())
        ties = cut(connected_components(ties.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)))
    of = low.join(ties, "node", "left").select("node", "low", F.coalesce("component", "node").alias("component"))
    of = cut(of)
    least = cut(of.groupBy("component").agg(F.min("low").alias("component_id")))
    of = cut(of.select("node", "component").join(least, "component").select("node", "component", "component_id"))
    return fps.select("doc_id", "text_key", "node").join(of, "node").select("doc_id", "component_id", "component", "text_key")


def _block_pairs(large: DataFrame, ties: DataFrame, names: list[str], most: int) -> DataFrame:
    """Members of large buckets, once for each pair (i, j) of blocks that they are compared in; `side` 1 is the block j.

    The members of a bucket's largest component hang together already: they are not compared with each other, but the
    rest are with all. Blocks, dealt by hash, have about `most` members, so a bucket's pairs are spread over tasks.
    """
    m = stored(large.join(ties, "node", "left").withColumn("component", F.coalesce("component", "node")))
    sizes = cut(m.groupBy("mask", "part", "component").agg(F.count("*").alias("n")))
    sizes = sizes.groupBy("mask", "part").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"))
    blocks = lambda n: F.ceil(n / most).cast("int")
    sizes = sizes.select("mask", "part", F.col("top.component").alias("top"), blocks(F.col("all") - F.col("top.n")).alias("rest"), blocks(F.col("top.n")).alias("tops")).where("rest > 0")
    m = m.join(cut(sizes), ["mask", "part"])
    dealt = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    m = m.withColumn("block", F.when(F.col("component") == F.col("top"), F.col("rest") + dealt("tops")).otherwise(dealt("rest")))
    first = F.transform(F.sequence(F.lit(0), F.least(F.col("block"), F.col("rest") - 1)), lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), (i != F.col("block")).cast("int").alias("side")))
    # As the first of a pair; the pair of a block with itself is there already.
    later = F.when(F.col("block") < F.col("rest"), F.transform(F.sequence(F.col("block") + 1, F.col("rest") + F.col("tops") - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"), F.lit(0).alias("side")))).otherwise(F.expr("array()"))
    return m.select("mask", "part", "node", *names, F.explode(F.concat(first, later)).alias("pair")).select("mask", "part", "node", *names, "pair.i", "pair.j", "pair.side")


def _compare_wide(sized: DataFrame, names: list[str], radius: int, blocks: bool = False) -> DataFrame:
    """(a, b): links within each bucket; with `blocks`, within each pair of blocks, between its sides or in the one block."""
    by = ["mask", "part", *(["i", "j"] if blocks else [])]
    rest = [*(["side"] if blocks else []), "node"]
    at = len(by) + len(rest)

    def changes(rows: np.ndarray) -> np.ndarray:
        return np.flatnonzero((np.diff(rows[: len(by)], axis=1) != 0).any(axis=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def compared(rows: np.ndarray) -> pa.RecordBatch:
            n = rows.shape[1]
            starts = np.concatenate([[0], changes(rows) + 1])
            sizes = np.diff(np.append(starts, n))
            group, begin = np.repeat(np.arange(len(starts)), sizes), None
            if blocks:
                # Between two blocks, the first's members meet the second's, which come after them, and those meet none.
                ones = np.add.reduceat(rows[at - 2], starts)
                split = starts + sizes - ones
                two = np.repeat(rows[2, starts] != rows[3, starts], sizes)
                begin = np.where(two, np.where(rows[at - 2] == 1, n, np.repeat(split, sizes)), np.arange(1, n + 1))
            root = linked(np.ascontiguousarray(rows[at:].T).view(np.uint64), group, radius, begin)
            tied = np.flatnonzero(root != np.arange(n))
            return pa.RecordBatch.from_arrays([pa.array(rows[at - 1][tied]), pa.array(rows[at - 1][root[tied]])], names=["a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            rows = np.concatenate([*held, rows], axis=1) if held else rows
            change = changes(rows)
            whole = int(change[-1]) + 1 if len(change) else 0
            if whole:
                yield compared(rows[:, :whole])
            held = [rows[:, whole:]]  # the last bucket may go on
        if held and held[0].shape[1]:
            yield compared(held[0])

    dealt = sized.select(*by, *rest, *names).repartition(*by).sortWithinPartitions(*by, *rest)
    return dealt.mapInArrow(lean(run), "a long, b long")
