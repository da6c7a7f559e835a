"""Language-model scoring: cross-entropy difference between a target and a background n-gram model.

Both models are interpolated bigram models over one vocabulary, that of lower-cased words, with one smoothing.
The background's counts, from the whole corpus, are matched to the target's mass, so that the models differ in what
they saw and not in how much. A document's score is its mean loss per token under the target model less that under the
background model: the lower, the more like the target. A document's own counts are left out of both models when it is
scored, so that no text looks familiar for having been learned from; a copy elsewhere counts.

Counts are exact, by 64-bit hashes of words and pairs, and grow with the corpus:

1. Texts are dealt into chunks of a bounded number of tokens, kept as places in a chunk's own list of words.
2. Each chunk sends its distinct words and pairs with their counts, already added up, to buckets by the hashes' first bits.
3. A bucket adds up what came for each hash, and answers each chunk with the totals, in the order in which it was asked.
4. A chunk meets its answers, which hold all that its own documents need. No task and no driver holds a whole model.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrolith.io import stored
from metrolith.llm.substring import _BYTES, _mix, _ranges
from metrolith.llm.text import by_size, lean, lean_group, lean_pair

#: The smoothing takes the vocabulary to have 2^WORD_BITS words at least.
WORD_BITS = 18
#: Tokens of a chunk, beyond which the next one begins, and the least number of buckets.
CHUNK_TOKENS, LEAST_BUCKETS = 2_000_000, 256


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, number of words by text)."""
    joined = [b" ".join(t.lower().split()) for t in texts]
    counts = np.fromiter((j.count(b" ") + 1 if j else 0 for j in joined), np.int64, len(joined))
    data = np.frombuffer(b" ".join([j for j in joined if j]), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), counts
    spaces = np.flatnonzero(data == 32)
    h = _ranges(data.astype(np.uint64), np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(data)]]), _BYTES)
    return h, counts


def _pack(a: np.ndarray) -> bytes:
    """Byte by byte, so that the high bytes of small numbers stand together."""
    return zlib.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), 1)


def _unpack(packed: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


CHUNK = "chunk long, doc_ids array<long>, sizes array<long>, words binary, tokens binary, n long, starts long"


def _chunks(docs: DataFrame) -> DataFrame:
    """A row for each chunk of (doc_id, text): its documents, its words by falling count, and its tokens by place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def whole() -> pa.RecordBatch:
            ids = pa.chunked_array([x[0] for x in held]).combine_chunks()
            sizes, h = (np.concatenate([x[i] for x in held]) for i in (1, 2))
            words, at, times = np.unique(h, return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            row = {
                "chunk": (task << 32) + made, "doc_ids": ids.to_pylist(), "sizes": sizes.tolist(),
                "words": _pack(np.diff(words[order], prepend=np.uint64(0))), "tokens": _pack(place[at]), "n": len(h), "starts": int((sizes > 0).sum()),
            }
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip(row.values(), kinds)], names=list(row))

        for batch in (b for part in batches for b in by_size(part, 1)):
            h, sizes = token_hashes([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])
            held.append((batch.column(0), sizes, h))
            if sum(len(x[2]) for x in held) >= CHUNK_TOKENS:
                yield whole()
                held, made = [], made + 1
        if held:
            yield whole()

    return docs.mapInArrow(lean(run), CHUNK)


class _Grams:
    """What a chunk knows of its words and pairs; the same whenever it is read."""

    def __init__(self, words: bytes, tokens: bytes, sizes: np.ndarray):
        self.hashes = np.cumsum(_unpack(words, "<u8"), dtype=np.uint64)
        self.token = _unpack(tokens, "<u4").astype(np.int64)
        n = len(self.hashes)
        before = np.concatenate([[n], self.token[:-1]])[: len(self.token)]
        ends = np.cumsum(sizes)
        before[(ends - sizes)[sizes > 0]] = n  # before the first word stands a mark
        self.before = before
        pairs, self.pair = np.unique(before * (n + 1) + self.token, return_inverse=True)
        self.pair_before, self.pair_word = pairs // (n + 1), pairs % (n + 1)
        before_hash = np.concatenate([self.hashes, np.zeros(1, np.uint64)])[self.pair_before]
        pair_hash = _mix(self.hashes[self.pair_word] + before_hash * np.uint64(0x9E3779B97F4A7C15))
        # The last bit tells words (0) from pairs (1).
        keys = np.concatenate([_mix(self.hashes) & ~np.uint64(1), pair_hash | np.uint64(1)])
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def counts(self, on: np.ndarray) -> np.ndarray:
        """By key: times seen, times seen in the target, and for words the times before another, and those in the target."""
        n, m = len(self.hashes), len(self.pair_word)
        out = np.zeros((4, n + m), np.uint32)
        for side, some in ((0, slice(None)), (1, on)):
            out[side, :n] = np.bincount(self.token[some], minlength=n)
            out[side, n:] = np.bincount(self.pair[some], minlength=m)
            out[side + 2, :n] = np.bincount(self.before[some], minlength=n + 1)[:n]
        return out[:, self.order]


def _in_own(doc: np.ndarray, what: np.ndarray) -> np.ndarray:
    """For each token, how often the same stands in its own document."""
    if not len(what):
        return np.zeros(0)
    _, at, times = np.unique(doc * (int(what.max()) + 1) + what, return_inverse=True, return_counts=True)
    return times[at].astype(np.float64)


def _is_target(places: pa.Table, n: int) -> np.ndarray:
    """Which of a chunk's n documents are the target, from its row of places, if it has one."""
    out = np.zeros(n, bool)
    for at in places["places"].to_pylist():
        out[at] = True
    return out


def _asked(chunks: DataFrame, targets: DataFrame, bits: int) -> DataFrame:
    kinds = {"bucket": pa.int32(), "chunk": pa.int64(), "keys": pa.binary(), "counts": pa.binary()}

    def run(docs: pa.Table, places: pa.Table) -> pa.Table:
        out = []
        for row in docs.to_pylist():
            sizes = np.array(row["sizes"], np.int64)
            g = _Grams(row["words"], row["tokens"], sizes)
            counts = g.counts(np.repeat(_is_target(places, len(sizes)), sizes))
            bucket = (g.keys >> np.uint64(64 - bits)).astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(bucket)] if len(bucket) else []
            out += [(int(bucket[lo]), row["chunk"], _pack(np.diff(g.keys[lo:hi], prepend=np.uint64(0))), _pack(counts[:, lo:hi].reshape(-1))) for lo, hi in zip(cuts, cuts[1:])]
        columns = list(zip(*out)) if out else [()] * len(kinds)
        return pa.table({c: pa.array(v, type=t) for (c, t), v in zip(kinds.items(), columns)})

    docs = chunks.select("chunk", "sizes", "words", "tokens").groupBy("chunk")
    return docs.cogroup(targets.groupBy("chunk")).applyInArrow(lean_pair(run), "bucket int, chunk long, keys binary, counts binary")


def _answered(asked: DataFrame) -> DataFrame:
    """Totals over all chunks for what each asked, and (once for a bucket) the number of its distinct words."""

    def add(rows: pa.Table) -> pa.Table:
        keys = [np.cumsum(_unpack(x, "<u8"), dtype=np.uint64) for x in rows["keys"].to_pylist()]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        ends = np.cumsum([len(k) for k in keys])
        counts = [_unpack(x, "<u4").reshape(4, -1) for x in rows["counts"].to_pylist()]
        totals = np.zeros((4, len(distinct)), np.uint64)
        for i in range(4):
            # Sums in float64 are exact up to 2^53.
            totals[i] = np.bincount(at, np.concatenate([c[i] for c in counts]), len(distinct)).astype(np.uint64)
        packed = [_pack(np.ascontiguousarray(totals[:, at[hi - len(k) : hi]]).reshape(-1)) for k, hi in zip(keys, ends)]
        words = [int((distinct & np.uint64(1) == 0).sum())] + [0] * (len(keys) - 1)
        return pa.table({"bucket": rows["bucket"], "chunk": rows["chunk"], "totals": pa.array(packed, pa.binary()), "words": pa.array(words, pa.int64())})

    return asked.groupBy("bucket").applyInArrow(lean_group(add), "bucket int, chunk long, totals binary, words long")


def score(docs: DataFrame, target_ids: DataFrame, strength: float = 2.0, word_bits: int = WORD_BITS) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of (doc_id, text): mean losses in bits per token, and their
    difference. Rows whose id is among the distinct target_ids are the target. Rows are scored without their own counts;
    repeated rows count for each other.

    Null and empty texts have no tokens and zeros. Null doc_ids and repeated rows keep their rows. Very long texts are
    scored whole. Empty tables give empty results.
    """
    chunks = stored(_chunks(docs))
    # Ids grow with the corpus: they are joined by sorting at every size, and without the texts, which stay in their chunks.
    places = chunks.select("chunk", F.posexplode("doc_ids").alias("place", "id"), "sizes").select("chunk", "place", "id", F.get("sizes", F.col("place")).alias("size"))
    found = places.join(target_ids.hint("merge"), F.col("id") == F.col(target_ids.columns[0]))
    targets = stored(found.groupBy("chunk").agg(F.collect_list("place").alias("places"), F.sum("size").alias("n_target"), F.count_if(F.col("size") > 0).alias("starts_target")))
    total = lambda *names: [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]
    known = chunks.agg(F.count("*").alias("chunks"), *total("n", "starts")).first().asDict() | targets.agg(*total("n_target", "starts_target")).first().asDict()
    targets = targets.select("chunk", "places")
    bits = (max(LEAST_BUCKETS, known["chunks"] // 2) - 1).bit_length()
    answers = stored(_answered(_asked(chunks, targets, bits)))
    vocabulary = max(1 << word_bits, (answers.agg(F.sum("words")).first()[0] or 0) + 1)
    mass, starts = (known["n"], known["n_target"]), (known["starts"], known["starts_target"])
    share = mass[1] / max(mass[0], 1)  # matched mass

    def run(docs: pa.Table, totals: pa.Table) -> pa.Table:
        out = []
        given = totals.filter(pc.is_valid(totals["totals"])).sort_by("bucket")
        by_bucket = [_unpack(x, "<u8").reshape(4, -1) for x in given["totals"].to_pylist()]
        places = totals.filter(pc.is_valid(totals["places"]))
        for row in docs.to_pylist():
            sizes = np.array(row["sizes"], np.int64)
            g = _Grams(row["words"], row["tokens"], sizes)
            total = np.zeros((4, len(g.keys)))
            if by_bucket:
                total[:, g.order] = np.concatenate(by_bucket, axis=1)
            n, ends, means = len(g.hashes), np.concatenate([[0], np.cumsum(sizes)]), []
            doc = np.repeat(np.arange(len(sizes)), sizes)
            own = [_in_own(doc, x) for x in (g.token, g.before, g.pair)]
            target = _is_target(places, len(sizes))
            for side, scale in ((1, 1.0), (0, share)):
                in_model = 1.0 if side == 0 else target[doc].astype(np.float64)
                word = (total[side, :n][g.token] - own[0] * in_model) * scale
                left = np.append(total[side + 2, :n], starts[side])[g.before] - own[1] * in_model
                unigram = (word + 1.0) / ((mass[side] - sizes[doc] * in_model) * scale + vocabulary)
                pair = (total[side, n:][g.pair] - own[2] * in_model) * scale
                loss = -np.log2((pair + strength * unigram) / (left * scale + strength))
                sums = np.concatenate([[0.0], np.cumsum(loss)])
                means.append((sums[ends[1:]] - sums[ends[:-1]]) / np.maximum(sizes, 1))
            out.append(pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "n_tokens": sizes, "target_loss": means[0], "background_loss": means[1], "score": means[0] - means[1]}))
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *((c, pa.float64()) for c in ("target_loss", "background_loss", "score"))])
        return pa.concat_tables(out) if out else schema.empty_table()

    docs = chunks.select("chunk", "doc_ids", "sizes", "words", "tokens").groupBy("chunk")
    told = answers.select("chunk", "bucket", "totals").unionByName(targets, allowMissingColumns=True)
    return docs.cogroup(told.groupBy("chunk")).applyInArrow(lean_pair(run), "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """score() of every row, with the rows whose id is in the one column of target_ids as the target.

    Without any target row the target model knows no counts, so its probabilities are all equal. Other columns are ignored.
    """
    ids = target_ids.select(F.col(target_ids.columns[0]).cast("long").alias("_target_id")).where("_target_id is not null").distinct()
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return score(d, ids, **kw)
