"""Exact top-k inner products through a pivot-distance index.

Vectors get one more component, sqrt(M - |x|^2) with M the largest squared norm, so that a larger inner product is a
smaller distance to the query (which gets 0 there). Each vector's key is its nearest pivot and the distance to it; the
index is sorted by key and cut into blocks, each an annulus around a pivot. A query takes annuli from its own distance
outwards. By the triangle inequality no vector of an annulus can be nearer than the gap between the query's distance to
the pivot and the annulus; a query stops at the first one beyond its k-th best so far, which starts as that among a sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.shared import mapped, pack, scratch, stored, unpack

K, SCALE, PIVOTS, PIVOT_SAMPLE, ANNULUS, QUERY_CHUNK = 5, 256, 32, 4096, 512, 8192
HELD = 64  # annuli looked at together by a task
EXACT = 1 << 53


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, vec): floor(scale * x) of each component. Vectors that are null, empty or have null or non-finite parts leave."""
    x = F.col(vec_col).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & x.isNotNull() & fine & (F.size(x) > 0)).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("vec"))


def _matrix(col: pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    values = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.int64)
    return values.reshape(len(col), -1)


def _distances(x: np.ndarray, norms: np.ndarray, top: float, pivots: np.ndarray) -> np.ndarray:
    """Distances to the pivots in the larger space; pivots have all components."""
    extra = np.sqrt(np.maximum(top - norms, 0))
    full = np.concatenate([x.astype(np.float64), extra[:, None]], 1)
    square = (full**2).sum(1)[:, None] - 2 * full @ pivots.T + (pivots**2).sum(1)
    return np.sqrt(np.maximum(square, 0))


def choose_pivots(x: np.ndarray, top: float, n: int = PIVOTS) -> np.ndarray:
    """Far-apart vectors of a sample, each next one the farthest from those before; then one round of means."""
    norms = (x.astype(np.float64) ** 2).sum(1)
    full = np.concatenate([x.astype(np.float64), np.sqrt(np.maximum(top - norms, 0))[:, None]], 1)
    chosen = [0]
    far = ((full - full[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(full)) and far.max() > 0:
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, ((full - full[chosen[-1]]) ** 2).sum(1))
    pivots = full[chosen]
    near = np.argmin((full**2).sum(1)[:, None] - 2 * full @ pivots.T + (pivots**2).sum(1), 1)
    return np.stack([full[near == i].mean(0) if (near == i).any() else pivots[i] for i in range(len(pivots))])


def _products(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact inner products, rows by queries, as int64; by whole numbers where doubles wouldn't be exact."""
    bound = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * rows.shape[1]
    if bound < EXACT:
        return np.rint(rows.astype(np.float64) @ queries.T.astype(np.float64)).astype(np.int64)
    exact = rows.astype(object) @ queries.T.astype(object)
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.known = np.zeros((n, k), bool)

    def least(self) -> np.ndarray:
        """The k-th best score, or minus infinity."""
        return np.where(self.known[:, -1], self.score[:, -1].astype(np.float64), -np.inf)

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """scores: rows by queries. Only those that reach the k-th best are looked at."""
        ok = (scores >= self.score[queries, -1]) & (ids[:, None] != own[queries][None, :])
        ok |= ~self.known[queries, -1][None, :] & (ids[:, None] != own[queries][None, :])
        row, at = np.nonzero(ok)
        if not len(row):
            return
        hit, inverse = np.unique(at, return_inverse=True)
        q = queries[hit]
        all_q = np.concatenate([inverse, np.repeat(np.arange(len(q)), self.k)])
        all_s = np.concatenate([scores[row, at], self.score[q].reshape(-1)])
        all_i = np.concatenate([ids[row], self.id[q].reshape(-1)])
        all_k = np.concatenate([np.ones(len(row), bool), self.known[q].reshape(-1)])
        order = np.lexsort((all_i, -np.maximum(all_s, -np.iinfo(np.int64).max), ~all_k, all_q))
        place = np.arange(len(order)) - np.searchsorted(all_q[order], all_q[order])
        keep = order[place < self.k]
        self.score[q], self.id[q], self.known[q] = (x[keep].reshape(len(q), self.k) for x in (all_s, all_i, all_k))


def _index(rows: DataFrame, pivots: np.ndarray, top: float) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                d = _distances(x, (x.astype(np.float64) ** 2).sum(1), top, pivots)
                p = np.argmin(d, 1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p.astype(np.int32)), pa.array(d[np.arange(len(p)), p])], ["id", "vec", "pivot", "distance"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            p, d = b.column(2).to_numpy(), b.column(3).to_numpy()
            x, ids = _matrix(b.column(1)), b.column(0).to_numpy()
            cuts = np.r_[np.flatnonzero(np.r_[True, p[1:] != p[:-1]]), len(p)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                for k in range(i, j, ANNULUS):
                    e = min(j, k + ANNULUS)
                    yield pa.RecordBatch.from_arrays([pa.array([int(p[k])], pa.int32()), pa.array([float(d[k])]), pa.array([float(d[e - 1])]), pa.array([pack(ids[k:e], x[k:e])], pa.binary())], ["pivot", "inner", "outer", "payload"])

    keyed = mapped(rows, key, "id long, vec array<long>, pivot int, distance double")
    # The id breaks ties, so a vector that many rows share is dealt out, too.
    ranged = stored(keyed, "keys").repartitionByRange(n, "pivot", "distance", "id").sortWithinPartitions("pivot", "distance", "id")
    return mapped(ranged, block, "pivot int, inner double, outer double, payload binary")


def thresholds(sample_ids: np.ndarray, sample: np.ndarray, own: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score among the sampled rows: no final k-th best is less. Minus infinity if they are too few."""
    best = Best(len(queries), k)
    for i in range(0, len(sample), ANNULUS):
        best.add(np.arange(len(queries)), _products(sample[i : i + ANNULUS], queries), sample_ids[i : i + ANNULUS], own)
    return best.least()


def search(blocks: list[tuple], own: np.ndarray, q: np.ndarray, known: np.ndarray, pivots: np.ndarray, top: float, k: int, work: list[int] | None = None) -> Best:
    """The best of ``blocks`` (pivot, inner, outer, payload) for each query; ``work`` collects products computed.

    Each query takes the annuli in the order of their gap, outwards from its own distances to the pivots, and stops at the
    first one that lies beyond what its k-th best score allows; ``known`` are k-th best scores known before.
    """
    square = (q.astype(np.float64) ** 2).sum(1)
    full = np.concatenate([q.astype(np.float64), np.zeros((len(q), 1))], 1)
    away = np.sqrt(np.maximum((full**2).sum(1)[:, None] - 2 * full @ pivots.T + (pivots**2).sum(1), 0))
    pivot, inner, outer = (np.array([b[c] for b in blocks]) for c in range(3))
    gap = np.maximum(np.maximum(inner - away[:, pivot], away[:, pivot] - outer), 0)
    order = np.argsort(gap, axis=1, kind="stable")
    best, live, held = Best(len(q), k), np.arange(len(q)), {}
    for step in range(len(blocks)):
        # Squared distance of the k-th best; a hair more for rounding.
        reach = square[live] + top - 2 * np.maximum(best.least()[live], known[live])
        mine = order[live, step]
        near = ~(gap[live, mine] * (1 - 1e-9) - 1e-6 > np.sqrt(np.maximum(reach, 0)))
        live, mine = live[near], mine[near]  # annuli come by their gap, so a query that stops is done
        if not len(live):
            break
        for i in np.unique(mine):
            if i not in held:
                held[i] = unpack(blocks[i][3])
            ids, x = held[i]
            on = live[mine == i]
            best.add(on, _products(x, q[on]), ids, own)
            if work is not None:
                work.append(len(on) * len(x))
    return best


def _search(blocks: DataFrame, queries: tuple[np.ndarray, ...], pivots: np.ndarray, top: float, k: int):
    """(broadcast, rows): the best of each partition, HELD annuli at a time."""
    shared = blocks.sparkSession.sparkContext.broadcast((*queries, pivots, top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q, known, pivots, top = shared.value
        known = known.copy()

        def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            best = search(held, own, q, known, pivots, top, k)
            np.maximum(known, best.least(), out=known)
            at, rank = np.nonzero(best.known & (best.score >= np.where(np.isfinite(known), known, -np.inf)[:, None]))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(best.id[at, rank]), pa.array(best.score[at, rank])], ["query_id", "vec_id", "score"])

        held: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("pivot", "inner", "outer", "payload"))):
                held.append(row)
                if len(held) >= HELD:
                    yield from flush(held)
                    held = []
        if held:
            yield from flush(held)

    return shared, mapped(blocks, run, "query_id long, vec_id long, score long")


def top_k(rows: DataFrame, is_query, k: int = K, chunk: int = QUERY_CHUNK) -> DataFrame:
    """Of quantised rows (id, vec): each query's k best others: query_id, rank, vec_id, score.

    ``is_query``: a condition on id. Ties go to the smaller id; fewer than k others give fewer rows; an empty table gives
    none. All vectors must have the same length. A row whose id repeats counts once, with its largest vector. Queries go
    chunk by chunk: a chunk is broadcast, its results are written, and its broadcast goes before the next one comes, so no
    more than a chunk is ever held. Scores beyond 64 bits saturate.
    """
    spark = rows.sparkSession
    rows = stored(rows.groupBy("id").agg(F.max("vec").alias("vec")), "vectors")
    schema = "query_id long, rank int, vec_id long, score long"
    norm = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    top, lengths, n_queries = rows.agg(F.max(norm), F.count_distinct(F.size("vec")), F.count_if(is_query)).first()
    if top is None or not n_queries:
        return spark.createDataFrame([], schema)
    if lengths > 1:
        raise ValueError("vectors of different lengths")
    sampled = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("id", "vec").toArrow()
    sample_ids, sample = sampled.column(0).to_numpy(), _matrix(sampled.column(1))
    pivots = choose_pivots(sample, top)
    blocks = stored(_index(rows, pivots, top), "annuli")
    chunks = -(-n_queries // chunk)
    numbered = rows.filter(is_query).withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)))
    path = scratch(spark, "nearest")
    for c in range(chunks):
        got = numbered.filter(F.col("chunk") == c).select("id", "vec").toArrow()
        own, q = got.column(0).to_numpy(), _matrix(got.column(1)) if got.num_rows else np.zeros((0, sample.shape[1]), np.int64)
        shared, part = _search(blocks, (own, q, thresholds(sample_ids, sample, own, q, k)), pivots, top, k)
        part.write.parquet(f"{path}/chunk={c}")
        shared.destroy()
    found = spark.read.schema("query_id long, vec_id long, score long").parquet(path)
    # A rank with a limit is cut in each task before rows are moved.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best others of every fiftieth vector; cases as in ``quantised`` and ``top_k``."""
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows, F.col("id") % 50 == 0)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
