"""Removal of repeated passages: a depth-limited suffix sort over bytes.

Ordering all suffixes down to ``length`` bytes would move each byte's suffix. Instead suffixes are placed through anchors:
each window of ``length`` bytes has one, the first of its 32-byte strings with the least hash. Equal windows have it at the
same place, so windows are only compared among those whose anchors have the same string.

1. Anchors are grouped by a hash of their string; only where it occurs again their windows' bytes are dealt out.
2. Most-significant-digit passes of ``DIGIT`` bytes order the anchors by all that their windows cover. Whoever has the
   same bytes as an earlier one is covered whole.
3. The windows of the others are ordered by the same passes down to ``length`` bytes; windows alone leave after each pass.
   The equal groups left at the end are exactly the repeated windows, and all but the first of each are covered.
4. Covered bytes are removed from their documents.

Hashes only choose and bring together; bytes alone decide what is equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.shared import BLOB, KEEP, blob_rows, bucket_groups, buckets, by_bucket, flat, ints, joined, mapped, mix, ragged, scatter, sliding_least, slices, stored, text_hashes, unpack, window_hashes, words_at

LENGTH, GRAM, DIGIT = 100, 32, 8
CHUNK = 8_000  # anchors whose windows are sorted at a time
SLICE = 1 << 20  # bytes of text looked at at a time
DEALT = 8 << 20  # bytes of text that are dealt out at a time
HELD = 200_000  # anchors in a batch of blobs
SHOWN_HELD = 60_000  # anchors with their surroundings in a batch of blobs
PORTION = 2 << 20  # compressed bytes of a bucket, about, that are unpacked at once
PLACE = (1 << 24) - 1  # bits that tell the place in a part beside the hash
PART = 1 << 20  # windows of a part
_U = np.uint64
DOCS, COVERED, ASKED, SHOWN = 0, 1, 2, 3


def anchors(buf: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(place, document, string hash, bytes of its windows to the left, to the right).

    A window's anchor is the first of its strings with the least hash; an anchor's windows follow each other.
    """
    inside = np.zeros(len(buf) + 1, np.int32)  # windows that stay in their document
    whole = np.flatnonzero(np.diff(off) >= length)
    np.add.at(inside, off[whole], 1)
    np.subtract.at(inside, off[whole + 1] - length + 1, 1)
    inside = np.cumsum(inside) > 0
    parts = [_part(buf[i : i + PART + length - 1], inside[i : i + PART], length, i) for i in range(0, max(len(buf) - length + 1, 1), PART)]
    at, gram, left, right = (np.concatenate(x) for x in zip(*parts))
    return at, np.searchsorted(off, at, "right") - 1, gram, left, right


def _part(buf: np.ndarray, inside: np.ndarray, length: int, begin: int) -> tuple[np.ndarray, ...]:
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none.astype(_U), none, none
    h = window_hashes(buf, GRAM)
    low = sliding_least((h & ~_U(PLACE)) | np.arange(len(h), dtype=_U), length - GRAM + 1)
    start = np.flatnonzero(inside[: len(low)])
    place = (low[start] & _U(PLACE)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else none
    at, first, last = place[new], start[new], start[np.r_[new[1:], len(place)] - 1] if len(new) else none
    return at + begin, h[at], at - first, last + length - at - GRAM


def _key(batch: pa.RecordBatch, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets, ids and a hash of each text, which tells rows of one id apart."""
    buf, off = flat(batch.column(text_col))
    return buf, off, ints(batch.column(id_col))[0], text_hashes(buf, off)


def _bucket(ids: np.ndarray, n: int) -> np.ndarray:
    return (mix(ids.view(_U)) % _U(n)).astype(np.int32)


def _spread(held: list[tuple[np.ndarray, ...]], n: int, kind: int = 0) -> pa.RecordBatch:
    """Blobs of records whose first column, a hash, tells the bucket."""
    cols = [np.concatenate(x) for x in zip(*held)]
    return scatter((cols[0] % _U(n)).astype(np.int32), *cols, kind=kind)


def _find(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    n_buckets = buckets(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in slices(batches, text_col, SLICE):
            buf, off, ids, tie = _key(b, id_col, text_col)
            at, doc, gram, left, right = anchors(buf, off, length)
            held.append((gram, ids[doc], tie[doc], (at - off[doc]).astype(np.uint32), left.astype(np.uint16), right.astype(np.uint16)))
            if sum(len(x[0]) for x in held) >= HELD:
                yield _spread(held, n_buckets)
                held = []
        if held and sum(len(x[0]) for x in held):
            yield _spread(held, n_buckets)

    return mapped(docs.select(id_col, text_col), run, BLOB)


def _group(found: DataFrame) -> DataFrame:
    """Anchors whose string occurs again, by document: their windows must be seen."""
    n_buckets = buckets(found.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in bucket_groups(batches):
            gram, *rest = joined([p for _, p in rows])
            order = np.argsort(gram, kind="stable")
            same = gram[order][1:] == gram[order][:-1]
            order = order[np.r_[False, same] | np.r_[same, False]]
            if len(order):
                gram, (ids, tie, at, left, right) = gram[order], (x[order] for x in rest)
                order = np.lexsort((at, ids))
                yield scatter(_bucket(ids[order], n_buckets), *(x[order] for x in (ids, tie, at, gram, left, right)), kind=ASKED)

    return mapped(by_bucket(found), run, BLOB)


def _deal(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Whole rows as compressed Arrow blobs by document, for the steps that need texts."""
    n_buckets = buckets(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=1))
        for b in _together(batches, text_col, DEALT):
            to = _bucket(ints(b.column(id_col))[0], n_buckets)
            out = []
            for k in np.unique(to):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema, options=options) as w:
                    w.write_batch(b.take(pa.array(np.flatnonzero(to == k))))
                out.append(sink.getvalue().to_pybytes())
            yield blob_rows(np.unique(to), out, DOCS)

    return mapped(docs, run, BLOB)


def _together(batches: Iterator[pa.RecordBatch], text_col: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``limit`` bytes of text, or one row if that is longer: small ones are put together."""
    held, n = [], 0
    for b in slices(batches, text_col, limit):
        size = pc.sum(pc.binary_length(b.column(text_col))).as_py() or 0
        if held and n + size > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
        held.append(b)
        n += size
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _rows(rows: list[tuple[int, bytes]], text_col: str) -> Iterator[pa.RecordBatch]:
    return _together((b for k, p in rows if k == DOCS for b in pa.ipc.open_stream(p)), text_col, SLICE)


def _lookup(ids: np.ndarray, tie: np.ndarray, want_ids: np.ndarray, want_tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(wanted, row) numbers of all matches by id and tie."""
    name = lambda i, t: mix(i.view(_U)) + t
    with np.errstate(over="ignore"):
        own, want = name(ids, tie), name(want_ids, want_tie)
    order = np.argsort(want, kind="stable")
    lo, hi = np.searchsorted(want, own, "left", order), np.searchsorted(want, own, "right", order)
    row = np.repeat(np.arange(len(own)), hi - lo)
    which = order[ragged(lo, hi - lo)]
    real = (ids[row] == want_ids[which]) & (tie[row] == want_tie[which])
    return which[real], row[real]


def _show(asked: DataFrame, dealt: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """The surroundings of the anchors that were asked for, by string."""
    n_buckets = buckets(dealt.sparkSession)
    side = length - GRAM
    width = 2 * side + GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in bucket_groups(batches):
            wanted = [p for k, p in rows if k == ASKED]
            if not wanted:
                continue
            want_ids, want_tie, at, gram, left_of, right_of = joined(wanted)
            held, n = [], 0
            for b in _rows(rows, text_col):
                buf, off, ids, tie = _key(b, id_col, text_col)
                which, row = _lookup(ids, tie, want_ids, want_tie)
                if not len(which):
                    continue
                place = off[row] + at[which]
                left, right = left_of[which].astype(np.int64), right_of[which].astype(np.int64)
                for i in range(0, len(which), 20_000):
                    s = slice(i, i + 20_000)
                    cells = place[s, None] - side + np.arange(width)
                    seen = buf[np.clip(cells, 0, len(buf) - 1)]
                    seen[(cells < (place - left)[s, None]) | (cells >= (place + GRAM + right)[s, None])] = 0
                    held.append((gram[which[s]], ids[row[s]], tie[row[s]], at[which[s]], left[s].astype(np.uint16), right[s].astype(np.uint16), seen))
                    n += len(seen)
                    if n >= SHOWN_HELD:
                        yield _spread(held, n_buckets, SHOWN)
                        held, n = [], 0
            if held:
                yield _spread(held, n_buckets, SHOWN)

    return mapped(by_bucket(asked.unionAll(dealt), "kind"), run, BLOB)


def ordered(rows: np.ndarray, group: np.ndarray, digit: Callable[[np.ndarray, int], np.ndarray], passes: int) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes: rows in the order of their digits within their group, and numbers of equal classes.

    After each pass rows that are alone leave. Groups must be sorted; equal rows stay in the order in which they came.
    """
    for d in range(passes):
        if not len(rows):
            break
        key = digit(rows, d)
        new = np.r_[True, group[1:] != group[:-1]]
        odd = ~new & np.r_[False, key[1:] != key[:-1]]
        number = np.cumsum(new) - 1
        mixed = np.zeros(int(number[-1]) + 1, bool)
        mixed[number[odd]] = True
        at = np.flatnonzero(mixed[number])  # groups with different digits are sorted, in their places
        order = at[np.lexsort((key[at], number[at]))]
        rows[at], key[at] = rows[order], key[order]
        new |= np.r_[False, key[1:] != key[:-1]]
        number = np.cumsum(new) - 1
        keep = (np.bincount(number) > 1)[number]
        rows, group = rows[keep], number[keep]
    return rows, group


def repeated_whole(seen: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Anchors with the surroundings of an earlier one of their group."""
    width = seen.shape[1]
    view = words_at(seen.reshape(-1))

    def digit(rows: np.ndarray, d: int) -> np.ndarray:
        if not d:
            return (left[rows].astype(_U) << _U(32)) | right[rows].astype(_U)
        return (view[rows * width + (d - 1) * DIGIT] & KEEP[min(DIGIT, width - (d - 1) * DIGIT)]).byteswap()

    rows, number = ordered(np.arange(len(seen)), group, digit, 1 + -(-width // DIGIT))
    return rows[np.r_[False, number[1:] == number[:-1]]] if len(rows) else rows


def equal_windows(seen: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, shift) of all windows that aren't the first of theirs. Anchors of one group come in order of place.

    Windows start at ``shift`` bytes of the surroundings; those of one group and shift are ordered by all their bytes.
    """
    side, width = length - GRAM, seen.shape[1]
    count = np.maximum(right.astype(np.int64) - (side - left.astype(np.int64)) + 1, 0)
    own = np.repeat(np.arange(len(seen)), count)
    shift = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(side - left.astype(np.int64), count)
    cell = group[own] * (side + 1) + shift
    order = np.argsort(cell, kind="stable")
    own, shift, cell = own[order], shift[order], cell[order]
    view = words_at(seen.reshape(-1))

    def digit(rows: np.ndarray, d: int) -> np.ndarray:
        return (view[own[rows] * width + shift[rows] + d * DIGIT] & KEEP[min(DIGIT, length - d * DIGIT)]).byteswap()

    rows, number = ordered(np.arange(len(own)), cell, digit, -(-length // DIGIT))
    again = rows[np.r_[False, number[1:] == number[:-1]]] if len(rows) else rows
    return own[again], shift[again]


def _portions(rows: list[bytes], n_buckets: int) -> Iterator[list[np.ndarray]]:
    """A bucket's records by ranges of their first column, a hash, so that only some of the bytes are unpacked at once."""
    parts = 1 + sum(map(len, rows)) // PORTION
    for k in range(parts):
        some = []
        for blob in rows:
            cols = unpack(blob)
            mine = cols[0] // _U(n_buckets) % _U(parts) == k
            some.append([x[mine] for x in cols] if parts > 1 else cols)
        cols = [np.concatenate(x) for x in zip(*some)]
        if len(cols[0]):
            yield cols


def _sort(shown: DataFrame, length: int) -> DataFrame:
    """Covered stretches, by document."""
    n_buckets = buckets(shown.sparkSession)
    side = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, ids, tie, at, left, right, seen in (x for _, rows in bucket_groups(batches) for x in _portions([p for _, p in rows], n_buckets)):
            order = np.lexsort((at, tie, ids, gram))
            gram, ids, tie, at, left, right = (x[order] for x in (gram, ids, tie, at, left, right))
            seen = seen[order]
            found = []

            def covered(o: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
                found.append((ids[o], tie[o], start.astype(np.uint32), end.astype(np.uint32)))

            group = np.cumsum(np.r_[True, gram[1:] != gram[:-1]]) - 1
            whole = repeated_whole(seen, left, right, group)
            covered(whole, at[whole].astype(np.int64) - left[whole], at[whole].astype(np.int64) + GRAM + right[whole])
            rest = np.ones(len(gram), bool)
            rest[whole] = False
            rest &= (np.bincount(group[rest], minlength=int(group[-1]) + 1) > 1)[group]
            kinds, group = np.flatnonzero(rest), group[rest]
            ends = np.r_[np.flatnonzero(np.diff(group)) + 1, len(group)]
            i = 0
            while i < len(group):  # whole groups at a time
                j = int(ends[np.searchsorted(ends, min(i + CHUNK, len(group)))])
                s = kinds[i:j]
                own, shift = equal_windows(seen[s], left[s], right[s], group[i:j], length)
                i = j
                if not len(own):
                    continue
                order = np.lexsort((shift, own))
                own, shift = own[order], shift[order]
                first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (shift[1:] != shift[:-1] + 1)])
                last = np.r_[first[1:], len(own)] - 1
                o = s[own[first]]
                covered(o, at[o].astype(np.int64) - side + shift[first], at[o].astype(np.int64) - side + shift[last] + length)
            cols = [np.concatenate(x) for x in zip(*found)]
            if len(cols[0]):
                order = np.lexsort((cols[2], cols[0]))
                cols = [x[order] for x in cols]
                yield scatter(_bucket(cols[0], n_buckets), *cols, kind=COVERED)

    return mapped(by_bucket(shown), run, BLOB)


def _removed(dealt: DataFrame, covered: DataFrame, docs: DataFrame, id_col: str, text_col: str, stats: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in bucket_groups(batches):
            known = [p for k, p in rows if k == COVERED]
            cover = joined(known) if known else [np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.uint32), np.zeros(0, np.uint32)]
            for b in _rows(rows, text_col):
                buf, off, ids, tie = _key(b, id_col, text_col)
                which, row = _lookup(ids, tie, cover[0], cover[1])
                edge = np.zeros(len(buf) + 1, np.int32)
                np.add.at(edge, off[row] + cover[2][which], 1)
                np.subtract.at(edge, off[row] + cover[3][which], 1)
                gone = np.cumsum(edge)[:-1] > 0
                start = gone.copy()
                start[1:] &= ~gone[:-1]
                first = off[:-1][off[:-1] < off[1:]]
                start[first] = gone[first]
                removed = np.diff(np.r_[0, np.cumsum(gone)][off])
                spans = np.diff(np.r_[0, np.cumsum(start)][off])
                kept = buf[~gone]
                to = off - np.r_[0, np.cumsum(removed)]
                texts = [kept[i:j].tobytes() for i, j in zip(to[:-1].tolist(), to[1:].tolist())]
                if stats:
                    yield pa.RecordBatch.from_arrays([b.column(id_col).cast(pa.int64()), pa.array(np.diff(off)), pa.array(removed), pa.array(spans), pa.array([hashlib.sha256(t).hexdigest() for t in texts])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
                else:
                    was = b.column(text_col)
                    text = pc.if_else(pa.array(removed > 0), pa.array([t.decode("utf-8", "ignore") if r else "" for t, r in zip(texts, removed)], was.type), was)
                    cols = [text if c == text_col else b.column(c) for c in b.schema.names]
                    yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" if stats else fields
    return mapped(by_bucket(dealt.unionAll(covered)), run, schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", stats: bool = False) -> DataFrame:
    """Removes each byte that lies in a string of ``length`` bytes that also starts earlier in the order (id, place).

    Rows keep their columns, and the text what is left of it (bytes of characters that were cut apart go, too); with
    ``stats``, what was removed from each row instead. Null and empty texts stay. Rows with one id are ordered by a hash
    of their texts; rows that repeat both share one result, as one document. A null id is the least. Long texts are whole.
    """
    if not GRAM < length < 1 << 15:
        raise ValueError(f"length must be over {GRAM} and under {1 << 15}")
    docs = docs.select(id_col, text_col) if stats else docs
    asked = stored(_group(_find(docs, id_col, text_col, length)), "asked")
    dealt = _deal(docs, id_col, text_col)
    covered = stored(_sort(_show(asked, dealt if stats else _deal(docs.select(id_col, text_col), id_col, text_col), id_col, text_col, length), length), "covered")
    return _removed(dealt, covered, docs, id_col, text_col, stats)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from every row of documents; cases as in ``remove_repeats``."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), stats=True)
