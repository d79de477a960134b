"""Exact Jaccard join of shingle sets by set-relation skipping.

Index lists hold, per prefix shingle, the sets that have it, with size and position. A list is cut into blocks of one
(size, position) each; pairs of blocks whose sizes or positions rule a link out are skipped before a set is looked at.

Answers follow from those of similar sets in two places. In a list, the sets of one component so far have one set whose
differences (by bitmaps) are computed; the others only look at what is near enough to it. Where overlaps are counted, a
set's overlaps come from those of a similar set and the index lists of the shingles in which the two differ.

Components come first: each set of a list is compared with one leader, then components are joined by spanning forests
within the lists, then whatever pairs are left between components. All links lie inside components, so the number of links
comes last: all pairs of a component's sets are compared exactly. A large component is dealt out by classes of size, of
which only the same and the next can link, and by salts inside a class; a task compares two such blocks at a time.
Identical sets are one set throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.components import components, merged
from tallyforge.llm.shared import BLOB, NULL_ID, bucket_groups, buckets, by_bucket, flat, fresh, ints, joined, mapped, mix, ragged, scatter, slices, stored
from tallyforge.llm.shingles import shingle_sets

BITS = 1024
FREQUENT, ORDERED = 16, 1_000_000  # documents from which a shingle comes late in the order; at most so many do, the most frequent ones
SLICE = 2 << 20  # bytes of text looked at at a time
BROADCAST_IDS = 1_000_000  # rows of two or three numbers up to which a side is broadcast
SHORT, PAIRS = 64, 1 << 17  # lists up to this length are taken together, about so many pairs at a time
LIST_SETS = 1024  # about so many sets of a list on one side of a piece of work
BLOCK_SETS, BLOCK_SHINGLES = 256, 1 << 19  # about so many at most in a block of sets that are compared at once
_U = np.uint64


def set_ids(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 63-bit number of each set, equal for equal sets."""
    with np.errstate(over="ignore"):
        sums = np.r_[_U(0), np.add.accumulate(mix(sets ^ _U(0x5851F42D4C957F2D)))]
        return (mix(sums[off[1:]] - sums[off[:-1]] + np.diff(off).astype(_U)) >> _U(1)).astype(np.int64)


def bitmaps(sets: np.ndarray, off: np.ndarray) -> list[bytes]:
    """Parities of classes of shingles (their low bits): sets differ in at least as many shingles as these in bits.

    As many classes as a set has shingles, to the next power of two, and BITS at least.
    """
    n = np.diff(off)
    own = np.repeat(np.arange(len(n)), n)
    out: list[bytes] = [b""] * len(n)
    for i in range(0, len(n), 512):  # 512 documents at a time
        j = min(i + 512, len(n))
        part = slice(off[i], off[j])
        counts = np.bincount((own[part] - i) * BITS + (sets[part] & _U(BITS - 1)).astype(np.int64), minlength=(j - i) * BITS)
        out[i:j] = [r.tobytes() for r in np.packbits((counts & 1).astype(np.uint8).reshape(-1, BITS), axis=1)]
    for d in np.flatnonzero(n > BITS):
        bits = 1 << int(n[d] - 1).bit_length()
        counts = np.bincount((sets[off[d] : off[d + 1]] & _U(bits - 1)).astype(np.int64), minlength=bits)
        out[d] = np.packbits((counts & 1).astype(np.uint8)).tobytes()
    return out


def folded(bitmap: bytes, size: int) -> np.ndarray:
    """The bitmap of fewer classes, ``size`` bytes."""
    x = np.frombuffer(bitmap, _U)
    return np.bitwise_xor.reduce(x.reshape(-1, size // 8), axis=0)


def differing(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())


def needed(a, b, percent: int):
    """Least overlap of sets of these sizes that makes a link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_size(n, percent: int):
    return np.where(n > 0, n - -(-percent * n // 100) + 1, 0)


def _near(df: DataFrame) -> DataFrame:
    """For a join: broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("key"))


def _measure(rows: DataFrame, words: int) -> DataFrame:
    """kind 0: a document's set; kind 1: blobs of shingles that are in two documents of a batch or more, and how many."""
    n_buckets = buckets(rows.sparkSession)
    schema = "kind int, doc_id long, sid long, n long, bitmap binary, bucket int, payload binary, key long"
    names = ["kind", "doc_id", "sid", "n", "bitmap", "bucket", "payload", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            sets, off = shingle_sets(*flat(b.column(1)), words)
            k = b.num_rows
            null = pa.nulls(k, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), b.column(0), pa.array(set_ids(sets, off)), pa.array(np.diff(off)), pa.array(bitmaps(sets, off), pa.binary()), pa.nulls(k, pa.int32()), null, b.column(2)], names)
            order = np.sort(sets)
            at = np.flatnonzero(np.r_[True, order[1:] != order[:-1]]) if len(order) else np.zeros(0, int)
            count = np.diff(np.r_[at, len(order)])
            more = count > 1
            tokens = order[at[more]]
            if len(tokens):
                s = scatter((tokens % _U(n_buckets)).astype(np.int32), tokens, count[more].astype(np.int64))
                k = s.num_rows
                none = pa.nulls(k, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), none, none, none, pa.nulls(k, pa.binary()), s.column(0), s.column(2), none], names)

    return mapped(rows, run, schema)


def _frequent(counts: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in bucket_groups(batches):
            tokens, n = joined([p for _, p in rows])
            order = np.argsort(tokens)
            tokens, n = tokens[order], n[order]
            at = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
            total = np.add.reduceat(n, at)
            keep = total >= least
            yield pa.RecordBatch.from_arrays([pa.array(tokens[at[keep]].view(np.int64)), pa.array(total[keep])], ["token", "df"])

    # The order may be any, as long as all documents have the same; its size is bounded, and what it leaves out is rarer.
    frequent = mapped(by_bucket(counts.select("bucket", "kind", "payload")), run, "token long, df long")
    got = frequent.orderBy(F.desc("df"), "token").limit(ORDERED).toArrow()
    tokens = np.asarray(got.column(0).to_numpy()).view(_U)
    order = np.argsort(tokens)
    return tokens[order], np.asarray(got.column(1).to_numpy())[order]


def _postings(rows: DataFrame, words: int, percent: int, tokens: np.ndarray, df: np.ndarray) -> DataFrame:
    """Blobs of (shingle, set, size, position) for each set's prefix in the order (frequency, hash)."""
    n_buckets = buckets(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            sets, off = shingle_sets(*flat(b.column(1)), words)
            sid, n = set_ids(sets, off), np.diff(off)
            _, first = np.unique(sid, return_index=True)
            if len(tokens):
                at = np.minimum(np.searchsorted(tokens, sets), len(tokens) - 1)
                weight = np.where(tokens[at] == sets, df[at], 0)
                some = np.add.reduceat(np.r_[weight, 0], np.minimum(off[:-1], len(weight)))
                for d in np.flatnonzero((some > 0) & (n > 0)):
                    part = slice(off[d], off[d + 1])
                    sets[part] = sets[part][np.argsort(weight[part], kind="stable")]
            p = np.zeros(len(n), np.int64)
            p[first] = prefix_size(n[first], percent)
            own = np.repeat(np.arange(len(n)), p)
            pos = np.arange(len(own)) - np.repeat(np.cumsum(p) - p, p)
            token = sets[off[own] + pos]
            yield scatter((token % _U(n_buckets)).astype(np.int32), token, sid[own], n[own].astype(np.uint32), pos.astype(np.uint32))

    return mapped(rows, run, BLOB)


def _reaches(na, pa_, nb, pb, percent: int):
    """Whether sets with a common shingle at these positions can still overlap enough."""
    return 1 + np.minimum(na - pa_ - 1, nb - pb - 1) >= needed(na, nb, percent)


def _candidates(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs (token null): those of lists of two, and of longer lists each set with the leader; and the rows of longer lists.

    The leader is the set with the least hash, so that alike lists have the same one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in bucket_groups(batches):
            token, sid, n, pos = joined([p for _, p in rows])
            order = np.argsort(token, kind="stable")
            same = token[order][1:] == token[order][:-1]
            order = order[np.r_[False, same] | np.r_[same, False]]
            order = order[np.lexsort((mix(sid[order].view(_U)), token[order]))]
            token, sid, n, pos = token[order], sid[order], n[order].astype(np.int64), pos[order].astype(np.int64)
            if not len(token):
                continue
            new = np.r_[True, (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])]
            token, sid, n, pos = token[new], sid[new], n[new], pos[new]
            at = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            size = np.diff(np.r_[at, len(token)])
            lead, size = np.repeat(at, size), np.repeat(size, size)
            long = size > 2
            if long.any():
                yield pa.RecordBatch.from_arrays([pa.array(token[long].view(np.int64)), pa.array(sid[long]), pa.nulls(int(long.sum()), pa.int64()), pa.array(n[long]), pa.array(pos[long])], ["token", "a", "b", "n", "pos"])
            one = np.flatnonzero(lead != np.arange(len(token)))
            two = lead[one]
            ok = (100 * np.minimum(n[one], n[two]) >= percent * np.maximum(n[one], n[two])) & _reaches(n[one], pos[one], n[two], pos[two], percent)
            x, y = sid[one[ok]], sid[two[ok]]
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
            none = pa.nulls(len(pairs), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none, none], ["token", "a", "b", "n", "pos"])

    return mapped(by_bucket(postings), run, "token long, a long, b long, n long, pos long")


def open_blocks(na: np.ndarray, pa_: np.ndarray, nb: np.ndarray, pb: np.ndarray, percent: int) -> np.ndarray:
    """Which blocks of one side, each a (size, position), can have links with which of the other; whole blocks are skipped."""
    na, pa_ = na[:, None], pa_[:, None]
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & _reaches(na, pa_, nb, pb, percent)


class Side:
    """One side of a pair of list blocks: sets in the order (size, position), and where each (size, position) block begins."""

    def __init__(self, row: np.ndarray, n: np.ndarray, pos: np.ndarray, group: np.ndarray, maps: np.ndarray):
        self.row = row[np.lexsort((pos[row], n[row]))]
        self.n, self.pos, self.group, self.maps = (x[self.row] for x in (n, pos, group, maps))
        self.first = np.flatnonzero(np.r_[True, (self.n[1:] != self.n[:-1]) | (self.pos[1:] != self.pos[:-1])]) if len(row) else np.zeros(0, int)
        self.block = np.repeat(np.arange(len(self.first)), np.diff(np.r_[self.first, len(row)]))


def short_pairs(starts: np.ndarray, size: np.ndarray, n: np.ndarray, pos: np.ndarray, group: np.ndarray, maps: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """(list, row, row, difference of bitmaps) for many short lists at once, each a run of rows; skipped like blocks of one set."""
    out = [(np.zeros(0, int),) * 4]
    step = np.cumsum(size * (size - 1) // 2) // PAIRS
    for k in np.unique(step):
        at, m = starts[step == k], size[step == k]
        row = ragged(at, m)
        more = np.repeat(at + m, m) - row - 1
        left, right, piece = np.repeat(row, more), ragged(row + 1, more), np.repeat(np.repeat(at, m), more)
        ok = (group[left] != group[right]) & (100 * np.minimum(n[left], n[right]) >= percent * np.maximum(n[left], n[right])) & _reaches(n[left], pos[left], n[right], pos[right], percent)
        left, right, piece = left[ok], right[ok], piece[ok]
        cost = np.bitwise_count(maps[left] ^ maps[right]).sum(1).astype(np.int64)
        near = cost <= n[left] + n[right] - 2 * needed(n[left], n[right], percent)
        out.append((piece[near], left[near], right[near], cost[near]))
    return tuple(np.concatenate(x) for x in zip(*out))


def list_pairs(a: Side, b: Side, percent: int, work: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number in a, number in b, difference of bitmaps) of sets of different groups that the bitmaps leave.

    Blocks are skipped by size and position before any bitmap is read. Of the sets of one group the first has its
    differences computed; another one y of them, at a distance d from it, can only reach what is at most d farther from
    the first than a link allows, so only for that y's own differences are computed. ``work`` collects how many are.
    """
    if not len(a.row) or not len(b.row):
        return (np.zeros(0, int),) * 3
    open_ = open_blocks(a.n[a.first], a.pos[a.first], b.n[b.first], b.pos[b.first], percent)
    order = np.argsort(a.group, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(a.group[order]) != 0, True])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i, j in zip(cuts[:-1], cuts[1:]):
        members = order[i:j]
        other = b.group != a.group[members[0]]
        cols = np.flatnonzero(open_[np.unique(a.block[members])].any(0)[b.block] & other)
        if not len(cols):
            continue
        base = members[0]
        away = np.bitwise_count(b.maps[cols] ^ a.maps[base]).sum(1).astype(np.int64)
        if work is not None:
            work.append(len(cols))
        for y in members:
            at = open_[a.block[y]][b.block[cols]]
            allowed = a.n[y] + b.n[cols] - 2 * needed(a.n[y], b.n[cols], percent)
            if y == base:
                at &= away <= allowed
                hit, diff = cols[at], away[at]
            else:
                step = int(np.bitwise_count(a.maps[y] ^ a.maps[base]).sum())
                at &= away - step <= allowed
                hit = cols[at]
                diff = np.bitwise_count(b.maps[hit] ^ a.maps[y]).sum(1).astype(np.int64)
                if work is not None:
                    work.append(len(hit))
                near = diff <= allowed[at]
                hit, diff = hit[near], diff[near]
            if len(hit):
                out.append((np.full(len(hit), y), hit, diff))
    if not out:
        return (np.zeros(0, int),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def forest(left: np.ndarray, right: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Edges of a spanning forest of least cost, by Kruskal's method."""
    names, code = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = code[: len(left)].tolist(), code[len(left) :].tolist()
    parent = list(range(len(names)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    taken = []
    for e in np.argsort(cost, kind="stable").tolist():
        x, y = top(a[e]), top(b[e])
        if x != y:
            parent[x] = y
            taken.append(e)
    return np.array(taken, int)


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows sorted by keys in tables that hold whole groups: what the next batch may go on with waits for it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([ints(b.column(c))[0] for c in keys], 1)
        at = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        if held and any(held[-1].column(c)[held[-1].num_rows - 1].as_py() != x for c, x in zip(keys, k[0].tolist())):
            yield pa.Table.from_batches(held)
            held = []
        if len(at):
            last = int(at[-1])
            yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = []
            b = b.slice(last)
        held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _by_keys(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Each group of rows with the same keys; rows come sorted by them."""
    for t in _whole(batches, keys):
        k = np.stack([ints(t.column(c))[0] for c in keys], 1)
        at = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(1), True]).tolist()
        yield from (t.slice(i, j - i) for i, j in zip(at[:-1], at[1:]))


def _matrix(bitmaps: pa.ChunkedArray) -> np.ndarray:
    """The bitmaps folded to BITS, a row each."""
    buf, off = flat(bitmaps)
    width = BITS // 8
    if (np.diff(off) == width).all():
        return np.frombuffer(buf.tobytes(), _U).reshape(-1, width // 8)
    return np.stack([folded(buf[i:j].tobytes(), width) for i, j in zip(off[:-1], off[1:])])


def _list_pairs(rows: DataFrame, percent: int, all_pairs: bool) -> DataFrame:
    """Pairs of lists between groups that the bitmaps leave: a spanning forest by difference, or all.

    A long list is dealt out by salts, and each pair of salts is one piece of work.
    """
    keys = ["token", "salt", "salt2"]
    own = F.pmod(F.xxhash64("sid"), "salts")
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1), lambda x: F.struct(F.least(x, own).alias("salt"), F.greatest(x, own).alias("salt2"), (x < own).cast("int").alias("side")))
    dealt = rows.withColumn("p", F.explode(pairs)).select("token", "sid", "n", "pos", "grp", "bitmap", "p.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches, keys):
            token, salt, salt2, side, sid, n, pos, group = (ints(t.column(c))[0] for c in (*keys, "side", "sid", "n", "pos", "grp"))
            maps = _matrix(t.column("bitmap"))
            cuts = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]) | (salt2[1:] != salt2[:-1]), True])
            size = np.diff(cuts)
            short = (size <= SHORT) & (salt[cuts[:-1]] == salt2[cuts[:-1]])
            found = [short_pairs(cuts[:-1][short], size[short], n, pos, group, maps, percent)]
            for i, j in zip(cuts[:-1][~short], cuts[1:][~short]):
                at = np.arange(i, j)
                a = Side(at[side[i:j] == 0], n, pos, group, maps)
                b = a if salt[i] == salt2[i] else Side(at[side[i:j] == 1], n, pos, group, maps)
                left, right, cost = list_pairs(a, b, percent)
                once = (left < right) | (a is not b)
                found.append((np.full(int(once.sum()), i), a.row[left[once]], b.row[right[once]], cost[once]))
            piece, left, right, cost = (np.concatenate(x) for x in zip(*found))
            if len(left) and not all_pairs:
                # Groups are told apart by their piece of work, so this is a forest for each.
                names = np.unique(np.stack([np.r_[piece, piece], np.r_[group[left], group[right]]], 1), axis=0, return_inverse=True)[1].reshape(-1)
                e = forest(names[: len(left)], names[len(left) :], cost)
                left, right = left[e], right[e]
            x, y = sid[left], sid[right]
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mapped(dealt.repartition(n, *keys).sortWithinPartitions(*keys, "n", "pos"), run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("sid").alias("b"), F.col("shingles").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            overlap, na, nb = [], [], []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
                overlap.append(int((y[at] == x).sum()) if len(y) else 0), na.append(len(x)), nb.append(len(y))
            o, na, nb = (np.array(v, np.int64) for v in (overlap, na, nb))
            ok = 100 * o >= percent * (na + nb - o)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], ["a", "b"])

    both = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")
    return mapped(both, run, "a long, b long")


def _sets(docs: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """(sid, shingles) of the representatives of the chosen sets, made anew from their texts."""
    ids = chosen.select("doc_id", "sid")
    ids = _near(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            sets, off = shingle_sets(*flat(b.column(1)), words)
            made = set_ids(sets, off)
            own = np.flatnonzero(made == b.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(made[own]), pa.array([sets[off[i] : off[i + 1]].tobytes() for i in own], pa.binary())], ["sid", "shingles"])

    return mapped(docs.join(ids, "doc_id").select("doc_id", "text", "sid"), run, "sid long, shingles binary").dropDuplicates(["sid"])


def overlaps(sets: list[np.ndarray], split: int, work: list[int] | None = None) -> np.ndarray:
    """Numbers of common shingles of the first ``split`` sets and the others; of all sets if split is 0.

    The first set's numbers come from the index lists of all its shingles, those of each other one from the numbers of the
    set before it (in the order of their first shingles) and the lists of the differing shingles alone, where these are
    the fewer. ``work`` collects how many lists are read for each set.
    """
    rows, cols = (sets[:split], sets[split:]) if split else (sets, sets)
    tokens = np.concatenate(cols)
    own = np.repeat(np.arange(len(cols)), [len(x) for x in cols])
    order = np.argsort(tokens, kind="stable")
    names, starts, lens = np.unique(tokens[order], return_index=True, return_counts=True)
    own = own[order]

    def lists(x: np.ndarray) -> np.ndarray:
        """How often each column is in the lists of these shingles."""
        if work is not None:
            work.append(len(x))
        at = np.minimum(np.searchsorted(names, x), len(names) - 1)
        at = at[names[at] == x]
        return np.bincount(own[ragged(starts[at], lens[at])], minlength=len(cols))

    out = np.zeros((len(rows), len(cols)), np.int64)
    last = None
    for i in sorted(range(len(rows)), key=lambda i: rows[i][:1].tolist()):
        x = rows[i]
        if last is not None:
            was = rows[last]
            more, less = np.setdiff1d(x, was, True), np.setdiff1d(was, x, True)
        if last is None or len(more) + len(less) >= len(x):
            out[i] = lists(x)
        else:
            out[i] = out[last] + lists(more) - lists(less)
        last = i
    return out


def _block_links(rows: DataFrame, percent: int) -> DataFrame:
    """(sid, links) of each block pair: how many rows of the other sets there link with a set. Rows are sorted by pair and side."""
    key = ["component", "class", "salt", "up", "salt2"]

    def counted(t: pa.Table) -> pa.RecordBatch:
        sid, n, copies, side = (ints(t.column(c))[0] for c in ("sid", "n", "copies", "side"))
        sets = [np.frombuffer(x.as_buffer(), _U) for x in t.column("shingles").combine_chunks()]
        split = int((side == 0).sum())
        if split < len(sets):
            o = overlaps(sets, split)
            link = 100 * o >= percent * (n[:split, None] + n[None, split:] - o)
            got = np.r_[link @ copies[split:], copies[:split] @ link]
        elif t.column("salt")[0] == t.column("salt2")[0] and not t.column("up")[0].as_py():
            o = overlaps(sets, 0)
            link = 100 * o >= percent * (n[:, None] + n[None, :] - o)
            np.fill_diagonal(link, False)
            got = link @ copies
        else:  # the other block has no sets
            got = np.zeros(len(sets), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(sid), pa.array(got.astype(np.int64))], ["sid", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_keys(batches, key):
            yield counted(t)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mapped(rows.repartition(n, *key).sortWithinPartitions(*key, "side"), run, "sid long, links long")


def _degrees(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(sid, n_links): for each set of members (sid, component, n, copies), the rows of other sets that link with it."""
    big = members.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("s")).filter((F.col("m") > BLOCK_SETS) | (F.col("s") > BLOCK_SHINGLES)).select("component")
    # Sizes of linked sets differ by a factor of 100 / percent at most, so by one class; a hair more, for rounding.
    step = max(math.log(100 / percent), 0.01) * (1 + 1e-9)
    classed = members.join(F.broadcast(big.withColumn("big", F.lit(1))), "component", "left").withColumn("class", F.when(F.col("big") == 1, F.floor(F.log("n") / step)).otherwise(0).cast("long"))
    salts = classed.filter("big = 1").groupBy("component", "class").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("salts"))
    salts = stored(salts, "salts")
    for name, by in (("above", 1), ("below", -1)):
        other = salts.select("component", (F.col("class") - by).alias("class"), F.col("salts").alias(name))
        classed = classed.join(F.broadcast(other), ["component", "class"], "left")
    classed = classed.join(F.broadcast(salts), ["component", "class"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    classed = classed.withColumn("own", F.pmod(F.xxhash64("sid"), "salts"))
    each = lambda n, f: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), f)).otherwise(F.array())
    pair = lambda c, salt, up, salt2, side: F.struct(c.alias("class"), salt.alias("salt"), F.lit(up).alias("up"), salt2.alias("salt2"), side.cast("int").alias("side"))
    c, own = F.col("class"), F.col("own")
    pairs = F.concat(
        each("salts", lambda x: pair(c, F.least(x, own), 0, F.greatest(x, own), x < own)),
        each("above", lambda x: pair(c, own, 1, x, F.lit(0))),
        each("below", lambda x: pair(c - 1, x, 1, own, F.lit(1))),
    )
    dealt = sets.join(classed.select("sid", "component", "n", "copies", pairs.alias("pairs")), "sid")
    dealt = dealt.select("sid", "component", "n", "copies", "shingles", F.explode("pairs").alias("p")).select("sid", "component", "n", "copies", "shingles", "p.*")
    return _block_links(dealt, percent).groupBy("sid").agg(F.sum("links").alias("n_links"))


def _classes(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, count: bool) -> DataFrame:
    """Per row: doc_id (NULL_ID for null), key (of the text), n, class (a number), component (its least doc_id), n_links (null without count).

    Rows are told apart by doc_id and key, as ids may repeat.
    """
    rows = _rows(docs, id_col, text_col)
    measured = stored(_measure(rows, words), "sets")
    own = measured.filter("kind = 0")
    tokens, df = _frequent(measured.filter("kind = 1"), FREQUENT)
    found = stored(_candidates(_postings(rows, words, percent, tokens, df), percent), "candidates")
    # One document stands for each set.
    reps = stored(own.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.first("bitmap").alias("bitmap"), F.count("*").alias("copies")), "representatives")
    maps = reps.select("sid", "n", "bitmap")
    lists = found.filter("token IS NOT NULL").select("token", F.col("a").alias("sid"), "n", "pos")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                differ = np.array([differing(x, y) for x, y in zip(b.column("bitmapa").to_pylist(), b.column("bitmapb").to_pylist())])
                na, nb = ints(b.column("na"))[0], ints(b.column("nb"))[0]
                ok = pa.array((differ <= na + nb - 2 * needed(na, nb, percent)) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)))
                yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], ["a", "b"])

    def verified(pairs: DataFrame) -> DataFrame:
        sides = [maps.select(*(F.col(c).alias(c + s) for c in maps.columns)) for s in "ab"]
        both = pairs.distinct().join(sides[0].withColumnRenamed("sida", "a"), "a").join(sides[1].withColumnRenamed("sidb", "b"), "b")
        left = stored(mapped(both, near, "a long, b long"), "pairs")
        involved = left.select(F.col("a").alias("sid")).unionAll(left.select(F.col("b").alias("sid"))).distinct()
        sets = stored(_sets(rows, reps.join(involved, "sid", "left_semi"), words), "shingle-sets")
        return stored(_verified(left, sets, percent), "links")

    links = verified(found.filter("token IS NULL").select("a", "b"))
    groups = components(links)
    for all_pairs in (False, True):
        own_group = groups.select(F.col("node").alias("sid"), F.col("component").alias("grp"))
        grouped = stored(lists.join(own_group, "sid", "left").withColumn("grp", F.coalesce("grp", "sid")), "lists")
        # Lists with one component have nothing left to answer.
        open_ = stored(grouped.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.ceil(F.count("*") / LIST_SETS).cast("long").alias("salts")).filter("lo <> hi").select("token", "salts"), "open-tokens")
        lists = stored(grouped.drop("salts").join(_near(open_), "token"), "open-lists")
        if lists.isEmpty():
            break
        more = stored(_list_pairs(lists.join(maps.select("sid", "bitmap"), "sid"), percent, all_pairs).distinct().join(links, ["a", "b"], "left_anti"), "more-pairs")
        lists = lists.drop("grp")
        if more.isEmpty():
            break
        new = verified(more)
        groups = merged(groups, new)
        links = links.unionAll(new)
    degree = None
    if count:
        linked = reps.select("sid", "doc_id", "n", "copies").join(groups.select(F.col("node").alias("sid"), "component"), "sid")
        linked = stored(linked, "linked-sets")
        degree = stored(_degrees(_sets(rows, linked, words), linked.drop("doc_id"), percent), "degrees")
    # Components are numbered by their sets so far; each takes the least doc_id of its sets.
    members = reps.select(F.col("sid").alias("node"), "doc_id").join(groups, "node")
    least = members.groupBy("component").agg(F.min("doc_id").alias("least"))
    groups = members.join(least, "component").select(F.col("node").alias("sid"), "component", "least")
    per_set = reps.select("sid", "doc_id", "copies").join(groups, "sid", "left")
    if count:
        per_set = per_set.join(degree, "sid", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1)
    else:
        per_set = per_set.withColumn("n_links", F.lit(None).cast("long"))
    per_set = per_set.select("sid", F.coalesce("component", "sid").alias("class"), F.coalesce("least", "doc_id").alias("component"), "n_links")
    return own.select("doc_id", "sid", "key", "n").join(per_set, "sid", "left")

def jaccard_classes(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, n_links.

    Documents link when 100 * intersection >= percent * union of their sets. component_id: the least doc_id reachable by
    links. n_links: the other rows that link with this one, those of an equal set too. Null, empty and
    blank texts have no set and link with nothing, so they are components of their own. Rows of one doc_id count as linked
    if their sets do; a null doc_id stays null and counts as the least. Very long texts are whole sets like any other;
    other columns aren't read; an empty table gives no rows.
    """
    out = _classes(docs, words, percent, id_col, text_col, True)
    null = F.lit(None).cast("long")
    alone = F.col("n") == 0
    return out.select(
        F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).otherwise(null).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.when(alone, F.col("doc_id")).otherwise(F.col("component")) != NULL_ID, F.when(alone, F.col("doc_id")).otherwise(F.col("component"))).alias("component_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
    )


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Leaves one row of each class, with all columns: the least id; of several rows of it the one with the largest set.

    Of rows that repeat id and text one stays, the one with the largest JSON form. Rows without words all stay; a null id
    is the least. Columns may have any name and type. An empty table gives no rows.
    """
    own = stored(_classes(docs, words, percent, id_col, text_col, False).filter("n > 0").select("doc_id", "key", "n", "class"), "classes")
    id_, key, full = (fresh(c, *docs.columns) for c in ("id", "key", "row"))
    best = own.groupBy("class").agg(F.min(F.struct("doc_id", -F.col("n"), "key")).alias("best")).select("class", F.col("best.doc_id").alias("best_id"), F.col("best.key").alias("best_key"))
    drop = own.join(best, "class").filter("doc_id <> best_id OR key <> best_key").select(F.col("doc_id").alias(id_), F.col("key").alias(key)).distinct()
    again = stored(own.groupBy(F.col("doc_id").alias(id_), F.col("key").alias(key)).count().filter("count > 1").select(id_, key), "repeated-rows")
    keyed = docs.withColumns({id_: F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), key: F.xxhash64(F.col(text_col).cast("string"))})
    left = keyed.join(_near(stored(drop, "dropped")), [id_, key], "left_anti")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if again.isEmpty():
        return left.select(*columns)
    # An aggregate takes one row of many, so they don't meet in a task.
    one = left.join(_near(again), [id_, key], "left_semi").groupBy(id_, key).agg(F.max_by(F.struct(*columns), F.to_json(F.struct(*columns))).alias(full)).select(f"{full}.*")
    return left.join(_near(again), [id_, key], "left_anti").select(*columns).unionByName(one)


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of four words, links from 85 per cent; cases as in ``jaccard_classes``."""
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85)
