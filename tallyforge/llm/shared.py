"""What the operators of this subpackage share: scratch tables, shipping of code, Arrow text blocks and packed blobs.

Large intermediate data travel between stages as *blobs*: one row holds the packed numpy records of one map batch for
one bucket, so a shuffle moves thousands of compressed rows instead of millions of small ones.
"""

from __future__ import annotations

import ast
import math
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.shipping import ship as _ship

BLOCK_BYTES = 1 << 20
ASCII_SPACE = np.array([9, 10, 11, 12, 13, 32], np.uint8)
NULL_ID = -(1 << 63)

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Makes a session ready for Python workers: they can import this package, and what they are sent at a time is bounded.

    Rows can be long, so a batch is bounded by bytes: the session's bound (64 MB by itself) goes down to 4 MB.
    """
    _ship(spark)
    said = spark.conf.get(BATCH_BYTES).lower().rstrip("b")
    if not said.isdigit() or int(said) > 4 << 20:
        spark.conf.set(BATCH_BYTES, str(4 << 20))


def released(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same, giving back unused memory in the end: workers are kept for later tasks, of other operators too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return run


def release() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names; a temporary one only in local mode, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="tallyforge-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
        import atexit

        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage, and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def buckets(spark: SparkSession) -> int:
    """Number of blob buckets: one for each shuffle partition, as each batch of a map task makes a row for each bucket."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_bucket(df: DataFrame, *order: str) -> DataFrame:
    """Deals blobs out by bucket; a task sees whole buckets, one after the other."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", *order)


def mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(released(f), schema)


# ---- Arrow text ----


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each holds about ``limit`` bytes of ``column`` (or one row, if that is longer)."""
    for b in batches:
        if b.num_rows == 0:
            continue
        n = np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
        at = np.cumsum(n) // limit
        cuts = np.r_[0, np.flatnonzero(at[1:] != at[:-1]) + 1, b.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:]):
            yield b.slice(i, j - i)


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and n + 1 offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def ints(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A whole-number column as int64 with NULL_ID for null, and the mask of nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    null = np.asarray(col.is_null().to_numpy(zero_copy_only=False), bool)
    return np.asarray(pc.fill_null(col.cast(pa.int64()), NULL_ID).to_numpy(zero_copy_only=False), np.int64), null


def id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def binary(buf: np.ndarray, off: np.ndarray) -> pa.Array:
    """A binary array over ``buf`` without a copy; under 2 GB."""
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off, np.int32)), pa.py_buffer(np.ascontiguousarray(buf))])


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices that run through [start, start + len) of each entry, one after the other."""
    end = np.cumsum(lens)
    total = int(end[-1]) if len(end) else 0
    return np.repeat(starts - (end - lens), lens) + np.arange(total)


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK &= ~_LETTER


def word_cuts(buf: np.ndarray, off: np.ndarray, space: np.ndarray = ASCII_SPACE, marks: bool = False) -> np.ndarray:
    """Where a text can be cut so that each part is tokenized alone: before a blank that follows no white space.

    Parts are a run of blanks and what follows up to the next one. Behind a multi-byte character that could be white
    space of Unicode there is no cut; a longer part is never wrong. Each text that isn't empty starts a part.
    """
    is_space = np.zeros(256, bool)
    is_space[space] = True
    any_space = np.zeros(256, bool)
    any_space[ASCII_SPACE] = True
    cut = np.zeros(len(buf), bool)
    if len(buf) > 1:
        cut[1:] = is_space[buf[1:]] & ~any_space[buf[:-1]]
        odd = np.flatnonzero(cut & (np.r_[np.uint8(0), buf[:-1]] >= 0x80))
        lead = buf[np.maximum(odd - 2, 0)]
        cut[odd[~((lead >= 0xC3) & (lead <= 0xDF))]] = False
        if marks:
            letter = _LETTER[buf]
            letter[1:] |= (buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
            cut[1:] |= letter[:-1] & _MARK[buf[1:]]
    cut[off[:-1][off[:-1] < off[1:]]] = True
    return np.flatnonzero(cut)


# ---- blobs ----

BLOB = "bucket int, kind int, payload binary"
_BLOB = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])


def pack(*arrays: np.ndarray) -> bytes:
    """Column after column, so that zstd finds like bytes side by side."""
    head = repr([(a.dtype.str, a.shape) for a in arrays]).encode()
    return zstandard.ZstdCompressor(level=1).compress(b"".join([len(head).to_bytes(4, "little"), head, *(a.tobytes() for a in arrays)]))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = bytearray(zstandard.ZstdDecompressor().decompress(blob))
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for kind, shape in ast.literal_eval(raw[4:at].decode()):
        out.append(np.frombuffer(raw, kind, math.prod(shape), at).reshape(shape))
        at += out[-1].nbytes
    return out


def scatter(bucket: np.ndarray, *arrays: np.ndarray, kind: int = 0) -> pa.RecordBatch:
    """One blob row for each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, int)
    moved = [a[order] for a in arrays]
    ends = np.r_[cuts[1:], len(b)]
    rows = [pack(*(a[i:j] for a in moved)) for i, j in zip(cuts, ends)]
    return blob_rows(b[cuts], rows, kind)


def blob_rows(bucket: np.ndarray, rows: list[bytes], kind: int = 0) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.asarray(bucket, np.int32)), pa.array(np.full(len(rows), kind, np.int32)), pa.array(rows, pa.binary())], schema=_BLOB)


def bucket_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Whole buckets from rows sorted by bucket: (bucket, [(kind, payload)])."""
    now, rows = None, []
    for batch in batches:
        for b, k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if b != now and rows:
                yield now, rows
                rows = []
            now = b
            rows.append((k, p))
    if rows:
        yield now, rows


def joined(rows: list[bytes]) -> list[np.ndarray]:
    """The arrays of several blobs of one layout, end to end."""
    return [np.concatenate(x) for x in zip(*map(unpack, rows))]


# ---- hashing ----

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(_U, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


#: Masks that leave the first n bytes of a little-endian word.
KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], _U)
ODD = _U(0x9E3779B97F4A7C15)
LONG_RANGE = 256


def words_at(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one little-endian number, zeros behind the end; a view, not a copy of each."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


def hash_ranges(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes, eight bytes a round, each round through the finaliser; long ones by xxhash.

    No linear structure is left over which different ranges could meet other than by chance; up to eight bytes never do.
    """
    lens = np.broadcast_to(np.asarray(lens, np.int64), np.shape(starts))
    h = mix(lens.astype(_U) + ODD)
    view = words_at(buf)
    live, done = np.flatnonzero((lens > 0) & (lens <= LONG_RANGE)), 0
    while len(live):
        left = lens[live] - done
        with np.errstate(over="ignore"):
            h[live] = mix(h[live] + (view[starts[live] + done] & KEEP[np.minimum(left, 8)]) * ODD)
        live, done = live[left > 8], done + 8
    for i in np.flatnonzero(lens > LONG_RANGE):
        h[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : starts[i] + lens[i]])
    return h


def window_hashes(buf: np.ndarray, width: int) -> np.ndarray:
    """The hash of each window of ``width`` bytes, a power of two from 8: halves are put together."""
    h, now = mix(words_at(buf)[: max(len(buf) - 7, 0)]), 8
    with np.errstate(over="ignore"):
        while now < width:
            h, now = mix(h[: max(len(h) - now, 0)] * ODD + h[now:]), now * 2
    return h


def sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    """Least of each run of w values: prefixes and suffixes of blocks of w."""
    n = len(h) - w + 1
    rows = -(-len(h) // w) + 1
    x = np.full(rows * w, np.iinfo(h.dtype).max, h.dtype)
    x[: len(h)] = h
    x = x.reshape(rows, w)
    ahead = np.minimum.accumulate(x, axis=1).reshape(-1)
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def text_hashes(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each whole text."""
    raw = memoryview(np.ascontiguousarray(buf))
    return np.array([xxhash.xxh3_64_intdigest(raw[i:j]) for i, j in zip(off[:-1].tolist(), off[1:].tolist())], _U)


def fresh(name: str, *taken: str) -> str:
    """A column name that none of ``taken`` has, whatever the case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; on each machine, as files aren't shipped."""
    import public_tokenizers

    return public_tokenizers.path(name) if not os.path.isabs(name) else name
