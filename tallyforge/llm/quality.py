"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text is counted in terms of two kinds: shapes of words (classes of their bytes, runs as one) and recurrences (a word is
the same as the one so many words before it, or as none of those). Square roots of the shares of each kind are reduced by
a truncated singular value decomposition of a bounded labelled sample. The sample's vectors and labels are broadcast
(at most 2 * SAMPLE rows of DIMS numbers, whatever the corpus); each document's cosines with all of them are one matrix
product per block, and its nearest neighbours vote with weights by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.shared import flat, hash_ranges, id_array, ints, mapped, slices
from tallyforge.llm.shingles import word_spans

SAMPLE, DIMS, NEIGHBOURS, SHARPNESS = 1500, 48, 21, 8
FOLDS, THRESHOLD = 5, 0.3
SHAPES, RECURRENCES = 1024, 4  # numbers of shapes (by hash), and of words looked back


def _classes() -> np.ndarray:
    """Small letters, capitals, digits, bytes beyond ASCII, white space, and each mark."""
    c = np.zeros(256, np.uint8)
    c[97:123], c[65:91], c[48:58], c[128:], c[9:14] = 1, 2, 3, 4, 5
    marks = [b for b in range(32, 127) if not chr(b).isalnum()]
    c[marks] = 6 + np.arange(len(marks))
    return c


_CLASS = _classes()


def terms(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Documents by terms: roots of the shares of word shapes, then of recurrences; zeros without words."""
    n = len(off) - 1
    starts, ends, at = word_spans(buf, off)
    own = np.repeat(np.arange(n), np.diff(at))
    c = _CLASS[buf]
    begins = np.zeros(len(buf) + 1, bool)
    begins[starts] = True
    inside = np.zeros(len(buf) + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.subtract.at(inside, ends, 1)
    new = begins[:-1].copy()
    new[1:] |= c[1:] != c[:-1]
    place = np.flatnonzero(new & (np.cumsum(inside)[:-1] > 0))
    first, last = np.searchsorted(place, starts), np.searchsorted(place, ends)
    shape = (hash_ranges(c[place], first, last - first) % np.uint64(SHAPES)).astype(np.int64)
    shapes = np.bincount(own * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES)
    code = hash_ranges(buf, starts, ends - starts)
    again = np.zeros((len(code), RECURRENCES + 1))
    for d in range(1, RECURRENCES + 1):
        again[d:, d] = (code[d:] == code[:-d]) & (own[d:] == own[:-d])
    again[:, 0] = 1
    back = np.stack([np.bincount(own, weights=x, minlength=n) for x in again.T], 1)
    share = lambda x: np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1))
    return np.concatenate([share(shapes), share(back)], 1).astype(np.float32)


@dataclass
class Voters:
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        v = x @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(x), 0.5)
        near = np.maximum(self.project(x) @ self.vectors.T, 0).astype(np.float64)
        k = min(NEIGHBOURS, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        w = np.take_along_axis(near, at, 1) ** SHARPNESS
        total = w.sum(1)
        voted = (w * self.labels[at]).sum(1) / np.maximum(total, 1e-12)
        return np.clip(np.where((total > 1e-12) & (x.sum(1) > 0), voted, self.labels.mean()), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Voters:
    """Voters from at most ``sample`` labelled texts of each class, the least by a hash of their id.

    Rows with crc32(id as text) mod 5 = 0 are held out. Of repeated labels the largest counts, of rows that repeat an id one
    text; null ids, null labels and labels without a row don't count. Without labels all scores are 0.5.
    """
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna().filter(F.crc32(F.col("id").cast("string")) % FOLDS != 0)
    own = own.groupBy("id").agg(F.max("label").alias("label"))
    own = own.filter("label = 0").orderBy(F.xxhash64("id"), "id").limit(sample).unionAll(own.filter("label = 1").orderBy(F.xxhash64("id"), "id").limit(sample))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(own), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x = terms(*flat(b.column(0))).astype(np.float16)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2).cast(pa.string()), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "id", "terms"])

    one = mapped(rows.select("text", "label", "id"), run, "label int, id string, terms binary").groupBy("label", "id").agg(F.max("terms").alias("terms"))
    got = one.toArrow().sort_by([("id", "ascending")])
    y = np.asarray(got.column("label").to_numpy(), np.float64)
    width = SHAPES + RECURRENCES + 1
    if not len(y):
        return Voters(np.zeros((width, 1), np.float32), np.zeros((0, 1), np.float32), y)
    x = np.frombuffer(b"".join(got.column("terms").to_pylist()), np.float16).reshape(len(y), width).astype(np.float32)
    q = np.random.default_rng(7).standard_normal((width, DIMS + 8)).astype(np.float32)
    for _ in range(4):  # subspace iteration
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    voters = Voters((q @ vt.T)[:, :DIMS].astype(np.float32), np.zeros((0, 1)), y)
    voters.vectors = voters.project(x).astype(np.float32)
    return voters


def score(docs: DataFrame, voters: Voters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row, whatever repeats; null, empty and blank texts get the share of label 1 in the sample.

    Very long texts are counted whole. Other columns aren't read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                yield pa.RecordBatch.from_arrays([id_array(ints(part.column(0))[0]), pa.array(shared.value.scores(terms(*flat(part.column(1)))))], ["doc_id", "score"])

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, score double")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every row of documents, from labels of the rows that aren't held out; cases as in ``score``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
