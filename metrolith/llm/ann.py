"""Maximum inner product search with score-aware (anisotropic) product quantisation and exact reranking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metrolith.io import cut, stored
from metrolith.llm.text import lean

CODES = 16  # four bits


@dataclass(frozen=True)
class Codebook:
    """`centres` is subspace x 16 x width; `weight` is how much more a parallel residual costs than one across."""

    centres: np.ndarray
    weight: float
    error: float  # root mean square residual of the sample, by which reranking widens its threshold

    @property
    def width(self) -> int:
        return self.centres.shape[2]


def parallel_weight(dimensions: int, threshold: float) -> float:
    """h_parallel / h_orthogonal of the score-aware loss for inner products above `threshold` (of unit vectors)."""
    return max(1.0, (dimensions - 1) * threshold**2 / (1 - threshold**2))


def _assign(x: np.ndarray, centres: np.ndarray, weight: float, sweeps: int) -> np.ndarray:
    """Codes by coordinate descent on |r|^2 + (weight - 1) (r.x)^2 / |x|^2, subspace after subspace."""
    n, (subspaces, _, width) = len(x), centres.shape
    parts = x.reshape(n, subspaces, width)
    norms = np.maximum((x * x).sum(1), 1e-30)
    codes = np.empty((n, subspaces), np.int64)
    along = np.zeros((n, subspaces))  # r_s . x_s
    for s in range(subspaces):
        codes[:, s] = ((parts[:, s, None, :] - centres[s]) ** 2).sum(2).argmin(1)
        along[:, s] = ((parts[:, s] - centres[s][codes[:, s]]) * parts[:, s]).sum(1)
    total = along.sum(1)
    for _ in range(sweeps):
        for s in range(subspaces):
            r = parts[:, s, None, :] - centres[s]
            a = (r * parts[:, s, None, :]).sum(2)
            rest = total - along[:, s]
            loss = (r * r).sum(2) + (weight - 1) * (rest[:, None] + a) ** 2 / norms[:, None]
            codes[:, s] = loss.argmin(1)
            along[:, s] = a[np.arange(n), codes[:, s]]
            total = rest + along[:, s]
    return codes


def fit(x: np.ndarray, width: int = 2, threshold: float = 0.2, rounds: int = 6, seed: int = 1) -> Codebook:
    """Codebooks of a sample: Lloyd's rounds under the score-aware loss, each cluster's centre by its normal equations."""
    n, d = x.shape
    pad = -d % (2 * width)
    x = np.pad(x, ((0, 0), (0, pad)))
    subspaces = x.shape[1] // width
    r = np.random.default_rng(seed)
    parts = x.reshape(n, subspaces, width)
    centres = np.stack([parts[r.choice(n, CODES, replace=n < CODES), s] for s in range(subspaces)])
    weight = parallel_weight(d, threshold)
    norms = np.maximum((x * x).sum(1), 1e-30)
    eye = np.eye(width)
    for i in range(rounds + 4):
        w = 1.0 if i < 4 else weight  # plain rounds first
        codes = _assign(x, centres, w, 0 if i < 4 else 1)
        picked = np.stack([centres[s][codes[:, s]] for s in range(subspaces)], 1)
        along = ((parts - picked) * parts).sum(2)
        total = along.sum(1)
        for s in range(subspaces):
            p = parts[:, s]
            lift = (w - 1) * ((total - along[:, s]) + (p * p).sum(1)) / norms
            for c in range(CODES):
                m = codes[:, s] == c
                if not m.any():
                    centres[s, c] = p[r.integers(n)]
                    continue
                a = m.sum() * eye + (w - 1) * (p[m].T / norms[m]) @ p[m]
                centres[s, c] = np.linalg.solve(a, (p[m] * (1 + lift[m])[:, None]).sum(0))
    codes = _assign(x, centres, weight, 2)
    picked = np.stack([centres[s][codes[:, s]] for s in range(subspaces)], 1)
    return Codebook(centres, weight, float(np.sqrt(((parts - picked) ** 2).sum((1, 2)).mean())))


def encode(x: np.ndarray, book: Codebook) -> np.ndarray:
    """Two four-bit codes to a byte."""
    x = np.pad(x, ((0, 0), (0, book.centres.shape[0] * book.width - x.shape[1])))
    codes = _assign(x, book.centres, book.weight, 2).astype(np.uint8)
    return codes[:, 0::2] | codes[:, 1::2] << 4


def tables(q: np.ndarray, book: Codebook) -> np.ndarray:
    """For each query and byte of a code: the inner product of every pair of centres; query x byte x 256."""
    q = np.pad(q, ((0, 0), (0, book.centres.shape[0] * book.width - q.shape[1])))
    one = np.einsum("qsw,scw->qsc", q.reshape(len(q), -1, book.width), book.centres).astype(np.float32)
    return (one[:, 1::2, :, None] + one[:, 0::2, None, :]).reshape(len(q), -1, CODES * CODES)


def scan_block(q: np.ndarray, ids: np.ndarray, codes: np.ndarray, book: Codebook, k: int, rerank: int, slack: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (ids, scanned scores) of a block's best by the tables: `rerank` of them, ties to the smaller id, and
    all within twice `slack` times the query's length of the k-th, so that crowds of close vectors stay whole."""
    columns = np.ascontiguousarray(codes.T)
    out = []
    for lo in range(0, len(q), 64):
        for i, lut in enumerate(tables(q[lo : lo + 64], book), lo):
            scan = lut[0][columns[0]]
            for b in range(1, len(columns)):
                scan += lut[b][columns[b]]
            some = best(ids, scan, k, rerank, 2 * slack * np.linalg.norm(q[i]))
            out.append((ids[some], scan[some]))
    return out


def best(ids: np.ndarray, scan: np.ndarray, k: int, rerank: int, slack: float) -> np.ndarray:
    """Places of the `rerank` best scores, ties to the smaller id, and of all within slack of the k-th best."""
    if len(scan) <= rerank:
        return np.arange(len(scan))
    least = min(np.partition(scan, len(scan) - rerank)[len(scan) - rerank], np.partition(scan, len(scan) - k)[len(scan) - k] - slack)
    some = np.flatnonzero(scan >= least)
    if len(some) > rerank:
        order = some[np.lexsort((ids[some], -scan[some]))]
        close = scan[order] >= scan[order[k - 1]] - slack
        some = order[: max(rerank, int(close.sum()))]
    return some


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in one order of summation, so that equal vectors have equal scores wherever they stand."""
    out = np.zeros(len(x))
    for i in range(x.shape[1]):
        out += x[:, i] * q[i]
    return out


def valid_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors of doubles. Null ids, and vectors that are null, empty, zero or hold null or non-finite
    components, take no part. Rows of one vec_id count once, by the smallest vector."""
    v = F.col(embedding).cast("array<double>")
    r = rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    r = r.where("vec_id is not null and v is not null").where(finite & F.exists("v", lambda x: x != 0))
    return r.groupBy("vec_id").agg(F.min("v").alias("v"))


def search(rows: DataFrame, is_query, k: int = 20, sample: int = 20_000, width: int = 2, threshold: float = 0.2, rerank: int = 200,
           margin: float = 1.0, block_rows: int = 32_768, block_queries: int = 4096, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k nearest found by inner product, ties to the smaller vec_id.

    `is_query` is a condition over vec_id. The codebook is fitted on at most `sample` vectors (those of the smallest id
    hashes); every vector is coded and scanned. Equal vectors are one in the index, under their smallest id: of its ids,
    the k + 1 smallest are all that an answer can hold. Only ids and codes, a few bytes a vector, meet the queries, in
    blocks; for each query the best of all blocks by the scan are then scored exactly where the vectors lie. With no
    more than k candidates, all are returned.

    See valid_vectors() for rows that take no part; vectors of another length than the sample's commonest do not
    either. Empty tables give empty results; other columns are ignored.
    """
    spark = rows.sparkSession
    valid = stored(valid_vectors(rows, vec_id, embedding))
    schema = "query_id long, rank int, vec_id long, score double"
    lengths = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    d = lengths["d"]
    valid = valid.where(F.size("v") == d).withColumn("same", F.md5(F.array_join(F.transform("v", lambda x: (x + F.lit(0.0)).cast("string")), ",")))
    nq = valid.where(is_query).count()
    if not nq:
        return spark.createDataFrame([], schema)
    # A vector's ids, the smallest k + 1: counted before they meet, so that no task holds those of a very common vector.
    place = F.row_number().over(Window.partitionBy("same").orderBy("vec_id"))
    ids = stored(valid.select("same", "vec_id").withColumn("place", place).where(F.col("place") <= k + 1).withColumn("u", F.min("vec_id").over(Window.partitionBy("same"))).select("u", "vec_id", "place"))
    firsts = ids.where("place = 1").select(F.col("u").alias("vec_id"))
    found = stored(valid.drop("same").join(firsts, "vec_id").select(F.col("vec_id").alias("u"), "v"))
    n = found.count()
    some = found.orderBy(F.xxhash64("u"), "u").limit(sample).select("v").toArrow().column("v")
    book = fit(some.combine_chunks().flatten().to_numpy().reshape(-1, d), width, threshold)
    slack = margin * book.error / np.sqrt(d)
    blocks, query_blocks = -(-n // block_rows), -(-nq // block_queries)

    def coded(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            codes = encode(x, book) if len(x) else np.zeros((0, 1), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], names=["u", "codes"])

    block_of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = found.mapInArrow(lean(coded), "u long, codes binary").select("*", block_of("u", blocks).alias("rb"), numbers(query_blocks).alias("qb"))
    queries = valid.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    left = queries.select("*", block_of("query_id", query_blocks).alias("qb"), numbers(blocks).alias("rb"))

    def met(asked: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(part):
            return pd.DataFrame({"query_id": [], "u": [], "scan": []})
        codes = np.frombuffer(b"".join(part["codes"]), np.uint8).reshape(len(part), -1)
        hits = scan_block(np.stack(asked["q"].to_list()), part["u"].to_numpy(), codes, book, k + 1, rerank, slack)
        return pd.DataFrame({"query_id": asked["query_id"], "u": [u for u, _ in hits], "scan": [s for _, s in hits]})

    hits = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(met, "query_id long, u array<long>, scan array<float>")

    def merged(of: pd.DataFrame) -> pd.DataFrame:
        us, scan = np.concatenate(of["u"].to_list()), np.concatenate(of["scan"].to_list())
        keep = best(us, scan, k + 1, rerank, 2 * slack * np.linalg.norm(of["q"].iloc[0]))
        return pd.DataFrame({"query_id": of["query_id"].iloc[0], "u": us[keep], "rb": 0})

    wanted = stored(hits.join(queries, "query_id").groupBy("query_id").applyInPandas(merged, "query_id long, u long, rb int").withColumn("rb", block_of("u", blocks)))
    asked = wanted.groupBy("rb", "query_id").agg(F.collect_list("u").alias("us")).join(queries, "query_id").select("rb", "query_id", "us", "q")

    def scored(asked: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        out_q, out_u, out_s = [], [], []
        if len(asked) and len(part):
            part = part.sort_values("u")
            known, x = part["u"].to_numpy(), np.stack(part["v"].to_list())
            for query_id, us, q in zip(asked["query_id"], asked["us"], asked["q"]):
                out_q.append(np.full(len(us), query_id))
                out_u.append(us)
                out_s.append(products(x[np.searchsorted(known, us)], q))
        each = [np.concatenate(o) if o else [] for o in (out_q, out_u, out_s)]
        return pd.DataFrame(dict(zip(("query_id", "u", "score"), each)))

    exact = asked.groupBy("rb").cogroup(found.select(block_of("u", blocks).alias("rb"), "u", "v").groupBy("rb")).applyInPandas(scored, "query_id long, u long, score double")
    # The k + 1 best vectors hold the k best ids, the query's own aside.
    near = Window.partitionBy("query_id").orderBy(F.desc("score"), "u")
    exact = cut(exact.withColumn("near", F.row_number().over(near)).where(F.col("near") <= k + 1).drop("near"))
    out = exact.join(ids, "u").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
