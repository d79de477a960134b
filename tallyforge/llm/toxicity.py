"""Toxicity by cumulative-link ordinal regression on the words of a text and the stems of longer ones.

P(grade <= k) = sigmoid(cut_k - w . x), with one weight vector for all ordered cuts and x the set of a text's words, and
of their first STEM bytes where they are longer: insults come with many endings.
The output is the expected grade. Labels only say toxic or not, so the grades of toxic training texts (1 to 3) follow
from how many different telling words they have: words that are nearly only in toxic texts of the sample. Weights are
fitted by proximal gradient steps with an L1 penalty, so most words weigh nothing and long clean texts stay at grade 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.shared import flat, hash_ranges, mapped, release, ship, slices

SAMPLE, GRADES, PENALTY, STEPS, THRESHOLD = 2000, 4, 0.001, 400, 0.75
STEM = 5
LEAST_TEXTS = 4
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words (runs of letters, A-Z as a-z) and stems of each text, and n + 1 offsets."""
    buf = _LOWER[buf]
    inside = _LETTER[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1] if len(buf) else False
    edge[off] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    own = inside[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[own], ends[own]
    doc = np.searchsorted(off, starts, "right") - 1
    long = np.flatnonzero(ends - starts > STEM)
    h = np.concatenate([hash_ranges(buf, starts, ends - starts), ~hash_ranges(buf, starts[long], np.full(len(long), STEM))])
    doc = np.concatenate([doc, doc[long]])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(off)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Severity:
    vocabulary: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def expected(self, h: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Expected grade of each text: the sum of P(grade > k)."""
        eta = np.zeros(len(off) - 1)
        if len(self.vocabulary):
            at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
            w = np.where(self.vocabulary[at] == h, self.weights[at], 0)
            eta = np.diff(np.r_[0, np.cumsum(w)][off])
        return _sigmoid(eta[:, None] - self.cuts).sum(1)


def learn(h: np.ndarray, off: np.ndarray, toxic: np.ndarray) -> Severity:
    doc = np.repeat(np.arange(len(toxic)), np.diff(off))
    vocabulary, code, df = np.unique(h, return_inverse=True, return_counts=True)
    bad = np.bincount(code, weights=toxic[doc], minlength=len(vocabulary))
    telling = (df >= LEAST_TEXTS) & (bad >= 0.85 * df)
    hits = np.bincount(doc, weights=telling[code], minlength=len(toxic))
    grade = np.where(toxic > 0, 1 + (hits >= 2) + (hits >= 4), 0).astype(int)
    keep = df >= LEAST_TEXTS
    number = np.cumsum(keep) - 1
    use = keep[code]
    doc, col = doc[use], number[code[use]]
    w, cuts, n = np.zeros(int(keep.sum())), np.array([0.0, 1.0, 2.0]), max(1, len(toxic))
    v, vc, t = w, cuts, 1.0
    step = 4.0
    size = np.bincount(doc, minlength=len(toxic)).max(initial=1)
    step = 4.0 * n / max(1.0, min(float(size), 400.0) * n / 40)
    for _ in range(STEPS):
        eta = np.bincount(doc, weights=v[col], minlength=len(toxic))
        edges = np.r_[-np.inf, vc, np.inf]
        up, lo = _sigmoid(edges[grade + 1] - eta), _sigmoid(edges[grade] - eta)
        p = np.maximum(up - lo, 1e-12)
        slope = 1 - up - lo
        g = np.bincount(col, weights=slope[doc], minlength=len(w)) / n
        du, dl = up * (1 - up) / p, lo * (1 - lo) / p
        gc = np.array([-du[grade == k].sum() + dl[grade == k + 1].sum() for k in range(GRADES - 1)]) / n
        new = v - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * PENALTY, 0)
        nc = np.maximum.accumulate(vc - np.clip(gc, -1, 1) + 1e-3 * np.arange(GRADES - 1))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vc, t = new + (t - 1) / t2 * (new - w), nc, t2
        w, cuts = new, nc
    live = w != 0
    return Severity(vocabulary[keep][live], w[live], cuts)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Severity:
    """A model from at most ``sample`` labelled texts of each class, the least by a hash of their id.

    Of repeated labels the largest counts, of rows that repeat an id one text; null ids, null labels and labels without a
    row don't count. Without labels every text has the same severity.
    """
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
    own = own.groupBy("id").agg(F.max("label").alias("label"))
    own = own.filter("label = 0").orderBy(F.xxhash64("id"), "id").limit(sample).unionAll(own.filter("label = 1").orderBy(F.xxhash64("id"), "id").limit(sample))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(own), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            h, off = words(*flat(b.column(0)))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2).cast(pa.string()), pa.array([h[i:j].tobytes() for i, j in zip(off[:-1], off[1:])], pa.binary())], ["label", "id", "words"])

    one = mapped(rows.select("text", "label", "id"), run, "label int, id string, words binary").groupBy("label", "id").agg(F.max("words").alias("words"))
    got = one.toArrow().sort_by([("id", "ascending")])
    parts = [np.frombuffer(x, _U) for x in got.column(2).to_pylist()]
    off = np.r_[0, np.cumsum([len(x) for x in parts])].astype(np.int64)
    return learn(np.concatenate(parts) if parts else np.zeros(0, _U), off, np.asarray(got.column(0).to_numpy(), float))


def severity(spark: SparkSession, model: Severity, text: Column) -> Column:
    """The expected grade (0 to 3) of a text column; null and empty texts have that of no words, very long ones are read whole.

    A column expression: only the texts travel to Python, and no name can clash with those of other columns.
    """
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        parts = [shared.value.expected(*words(*flat(b.column(0)))) for b in slices([batch], "text")]
        release()
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return run(text.cast("string"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, severity and toxic (severity >= THRESHOLD) of every row, whatever repeats; an empty table gives no rows."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    graded = docs.select("doc_id", severity(spark, fit(docs, labels), F.col("text")).alias("severity"))
    return graded.withColumn("toxic", F.col("severity") >= THRESHOLD)
