"""Token ids in compressed segments: a static range asymmetric numeral system (rANS) over interleaved lanes.

A *segment* holds the ids of consecutive documents. All its blocks share one frequency table (scaled to 2 ** 18). A block
is coded by ``LANES`` interleaved states: id i of the block belongs to lane i mod LANES. The block header keeps each
lane's end state and the place of its words (the checkpoints) and a CRC-32 of the ids, so blocks decode independently
and in parallel, and a damaged one is noticed. Segments are rows of a Parquet table, so Spark's commit protocol writes
them on any store, once, whatever executors get lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.shared import flat, id_array, ints, mapped, pack, scratch, slices, unpack
from tallyforge.llm.words import BLOCK as TEXTS
from tallyforge.llm.words import byte_cache

MAGIC, BITS, LANES, BLOCK = b"TFR1", 18, 64, 1 << 16
SEGMENT_IDS = 4 << 20
LOW = np.uint64(1 << 31)
_U = np.uint64

SEGMENTS = "part int, before long, n_tokens long, payload binary"  # before: ids of the part's segments up to here
_SEGMENTS = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and their shares of 2 ** BITS, each at least 1."""
    if int(ids.max()) < 1 << 22:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts).astype(np.uint32)
        counts = counts[symbols]
    else:
        symbols, counts = np.unique(ids, return_counts=True)
    if len(symbols) > 1 << (BITS - 1):
        raise ValueError(f"more than {1 << (BITS - 1)} different ids in a segment")
    f = np.maximum(1, counts * (1 << BITS) // max(1, counts.sum())).astype(np.int64)
    over = int(f.sum()) - (1 << BITS)
    for i in np.argsort(-f, kind="stable"):
        if over <= 0:
            f[i] -= over
            break
        take = min(over, int(f[i]) - 1)
        f[i] -= take
        over -= take
    return symbols, f


def encode(ids: np.ndarray) -> bytes:
    """Any number of ids below 2 ** 32 as one segment body."""
    ids = np.asarray(ids, np.uint32)
    if not len(ids):
        return MAGIC + pack(np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64))
    symbols, f = frequencies(ids)
    cum = np.r_[0, np.cumsum(f)[:-1]].astype(_U)
    f = f.astype(_U)
    if int(symbols[-1]) < 1 << 22:
        number = np.zeros(int(symbols[-1]) + 1, np.int32)
        number[symbols] = np.arange(len(symbols), dtype=np.int32)
        code = number[ids]
    else:
        code = np.searchsorted(symbols, ids)
    blocks = -(-len(ids) // BLOCK)
    sizes = np.minimum(BLOCK, len(ids) - np.arange(blocks) * BLOCK)
    lane_n = (sizes[:, None] + LANES - 1 - np.arange(LANES)) // LANES  # ids of each lane
    steps = int(lane_n.max())
    table = np.zeros((steps, blocks, LANES), np.int32)
    padded = np.zeros(blocks * steps * LANES, np.int32)
    for b in range(blocks):
        padded[b * steps * LANES : b * steps * LANES + sizes[b]] = code[b * BLOCK : b * BLOCK + sizes[b]]
    table[:] = padded.reshape(blocks, steps, LANES).transpose(1, 0, 2)
    table, n = table.reshape(steps, -1), lane_n.reshape(-1)
    x = np.full(blocks * LANES, LOW, _U)
    words, owners = [], []
    lanes = np.arange(blocks * LANES)
    for t in range(steps - 1, -1, -1):
        whole = t < sizes.min() // LANES
        on = lanes if whole else np.flatnonzero(t < n)
        s = table[t] if whole else table[t, on]
        fs, xs = f[s], x if whole else x[on]
        full = np.flatnonzero(xs >= (fs << _U(63 - BITS)))
        words.append(xs[full].astype(np.uint32))
        owners.append(on[full].astype(np.int32))
        xs[full] >>= _U(32)
        q = xs // fs
        x[on] = xs + q * (_U(1 << BITS) - fs) + cum[s]
    words, owners = np.concatenate(words)[::-1], np.concatenate(owners)[::-1]
    order = np.argsort(owners.astype(np.uint16) if len(x) <= 1 << 16 else owners, kind="stable")  # radix; each lane's words in the order in which it reads them
    counts = np.bincount(owners, minlength=len(x)).astype(np.uint32)
    sums = np.array([zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4").tobytes()) for b in range(blocks)], np.uint32)
    return MAGIC + pack(symbols, f.astype(np.uint32), np.array([len(ids)]), sums, x, counts, words[order])


def decode(body: bytes, only: np.ndarray | None = None) -> np.ndarray:
    """The ids of a segment, or of the blocks numbered in ``only``; raises ValueError if a checksum differs."""
    if body[:4] != MAGIC:
        raise ValueError("not a token segment")
    parts = unpack(body[4:])
    symbols, f, size = parts[:3]
    if len(parts) == 3:
        return np.zeros(0, np.uint32)
    sums, x, counts, words = parts[3:]
    total = int(size[0])
    blocks = len(sums)
    sizes = np.minimum(BLOCK, total - np.arange(blocks) * BLOCK)
    at = np.r_[0, np.cumsum(counts.astype(np.int64))[:-1]]
    keep = np.arange(blocks) if only is None else np.asarray(only)
    lanes = (keep[:, None] * LANES + np.arange(LANES)).reshape(-1)
    x, at, sizes = x[lanes].copy(), at[lanes].copy(), sizes[keep]
    n = ((sizes[:, None] + LANES - 1 - np.arange(LANES)) // LANES).reshape(-1)
    look = np.repeat(np.arange(len(f), dtype=np.int32), f)
    cum = np.r_[0, np.cumsum(f.astype(np.int64))[:-1]].astype(_U)
    f = f.astype(_U)
    steps = int(n.max())
    out = np.zeros((steps, len(x)), np.int32)
    words = np.r_[words, np.uint32(0)]
    every = np.arange(len(x))
    for t in range(steps):
        whole = t < sizes.min() // LANES
        on = every if whole else np.flatnonzero(t < n)
        xs = x if whole else x[on]
        slot = xs & _U((1 << BITS) - 1)
        s = look[slot.view(np.int64)]
        out[t, on] = s
        xs = f[s] * (xs >> _U(BITS)) + slot - cum[s]
        low = np.flatnonzero(xs < LOW)
        hungry = on[low]
        xs[low] = (xs[low] << _U(32)) | words[at[hungry]]
        at[hungry] += 1
        x[on] = xs
    rows = out.reshape(steps, len(keep), LANES).transpose(1, 0, 2).reshape(len(keep), -1)
    done = [symbols[r[:k]].astype(np.uint32) for r, k in zip(rows, sizes)]
    for b, ids in zip(keep, done):
        if zlib.crc32(ids.astype("<u4").tobytes()) != sums[b]:
            raise ValueError(f"block {b} is damaged")
    return np.concatenate(done)


def _segment(part: int, before: int, docs: list[np.ndarray], lens: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
    body = encode(np.concatenate(ids) if ids else np.zeros(0, np.uint32))
    head = pack(np.concatenate(docs), np.concatenate(lens))
    payload = len(head).to_bytes(8, "little") + head + body
    return pa.record_batch([[part], [before], [int(sum(x.sum() for x in lens))], pa.array([payload], pa.binary())], schema=_SEGMENTS)


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = SEGMENT_IDS) -> None:
    """Encodes whole texts, appends ``end_id`` to each document and writes segments in ascending order of ids.

    Null and empty texts are just the end id. Rows of one id (ties) are written in the order of their texts; a null id
    comes first. Other columns aren't read. An empty table gives an empty set of segments. Documents are dealt out by
    range of id, so the order of parts, of segments in a part and of rows in a segment is that of the ids.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, before = byte_cache(tokenizer), TaskContext.get().partitionId(), 0
        held: tuple[list, list, list] = ([], [], [])
        size = 0
        for b in slices(batches, "text", TEXTS):
            ids, off = cache.texts(*flat(b.column(1)))
            lens = np.diff(off)
            ends = np.cumsum(lens + 1)
            full = np.full(int(ends[-1]), end_id, np.uint32)
            inner = np.ones(len(full), bool)
            inner[ends - 1] = False
            full[inner] = ids
            for x, y in zip(held, (ints(b.column(0))[0], (lens + 1).astype(np.uint32), full)):
                x.append(y)
            size += len(full)
            if size >= segment_ids:
                yield _segment(part, before, *held)
                held, size, before = ([], [], []), 0, before + size
        if held[0]:
            yield _segment(part, before, *held)

    mapped(rows, run, SEGMENTS).write.option("compression", "uncompressed").parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """Per document: doc_id, start (ids before it), n_tokens, ids_crc32, and the ids as a binary column on demand."""
    table = spark.read.schema(SEGMENTS).parquet(path)
    # One number for each part that a task wrote, not for each segment or document.
    totals = dict(table.groupBy("part").agg(F.sum("n_tokens")).collect())
    ahead, sum_ = {}, 0
    for part in sorted(totals):
        ahead[part] = sum_
        sum_ += totals[part]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, before, _, payload in zip(*(c.to_pylist() for c in b.columns)):
                head = int.from_bytes(payload[:8], "little")
                docs, lens = unpack(payload[8 : 8 + head])
                all_ids = decode(payload[8 + head :]).astype("<u4")
                off = np.r_[0, np.cumsum(lens.astype(np.int64))]
                sums = [zlib.crc32(all_ids[i:j]) for i, j in zip(off[:-1], off[1:])]
                out = [id_array(docs), pa.array(off[:-1] + ahead[part] + before), pa.array(np.diff(off)), pa.array(sums, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if ids:
                    out.append(pa.array([all_ids[i:j].tobytes() for i, j in zip(off[:-1], off[1:])], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return mapped(table, run, schema)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the token segments of all documents and returns what is read back from them."""
    path = scratch(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_tokens(spark, path)
