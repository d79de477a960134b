"""Best-fit packing of token pieces into fixed sequences by linear grouping.

Only the counts of piece lengths (at most ``capacity`` numbers) come to the driver. The plan is made on them: large
lengths are rounded up within groups of equal cardinality, a linear programme over patterns of the few rounded sizes
gives configurations, actual lengths replace the rounded ones, and small lengths then go to the fullest sequence that
still takes them. Counts stand for any number of equal sequences, so planning doesn't depend on the number of documents.
Pieces then find their places by their rank among those of their length.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.shared import flat, fresh, id_array, ints, mapped, slices, stored
from tallyforge.llm.words import BLOCK, word_cache

CAPACITY, GROUPS, LARGE = 4096, 24, 8


def cut_pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each document's ids plus ``end_id``, cut into pieces of ``capacity`` ids; null text counts as empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(tokenizer)
        for b in slices(batches, "text", BLOCK):
            ids, off = cache.texts(*flat(b.column(1)))
            ids, end = ids.astype("<u4"), np.array([end_id], "<u4").tobytes()
            doc, piece, start, length, sums, raw = [], [], [], [], [], []
            for d, (i, j) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                n = j - i + 1
                for k in range(0, n, capacity):
                    body = ids[i + k : min(j, i + k + capacity)].tobytes() + (end if k + capacity >= n else b"")
                    doc.append(d), piece.append(k // capacity), start.append(k), length.append(min(capacity, n - k)), sums.append(zlib.crc32(body))
                    raw.append(body) if with_ids else None
            cols = [id_array(ints(b.column(0))[0][doc]), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(sums, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(raw, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    return mapped(rows, run, schema)


# ---- the plan, on counts ----


def patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """Whole multiples of size patterns from the linear programme's solution, rounded down. sizes: descending, distinct."""
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(3 * m):  # any basis on the way is a feasible plan
        x = np.linalg.solve(basis, demand)
        price = np.linalg.solve(basis.T, np.ones(m))
        # Knapsack over capacities; the best pattern at the dual prices.
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(1, capacity + 1):
            fit = sizes <= c
            best[c] = best[c - 1]
            if fit.any():
                v = np.where(fit, best[c - np.minimum(sizes, c)] + price, -1)
                k = int(np.argmax(v))
                if v[k] > best[c] + 1e-12:
                    best[c], pick[c] = v[k], k
        if best[capacity] <= 1 + 1e-7:
            break
        new, c = np.zeros(m), capacity
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                new[pick[c]] += 1
                c -= int(sizes[pick[c]])
        step = np.linalg.solve(basis, new)
        ratio = np.where(step > 1e-9, x / np.maximum(step, 1e-9), np.inf)
        basis[:, int(np.argmin(ratio))] = new
    x = np.linalg.solve(basis, demand)
    return [(int(k), basis[:, i].astype(int)) for i, k in enumerate(np.floor(x + 1e-9)) if k >= 1]


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, list[int]]]:
    """(how many sequences, lengths in each), for {length: count}; every piece has its place."""
    left = {k: v for k, v in counts.items() if v > 0}
    done: list[tuple[int, list[int]]] = []
    if n := left.pop(capacity, 0):
        done.append((n, [capacity]))
    large = sorted((k for k in left if k > capacity // LARGE), reverse=True)
    open_: dict[int, list[tuple[int, list[int]]]] = {}  # by room left

    def put(n: int, items: list[int]) -> None:
        open_.setdefault(capacity - sum(items), []).append((n, items))

    if large:
        total = sum(left[k] for k in large)
        group: list[list[list[int]]] = []
        filled = 0
        for k in large:  # equal cardinality: cut by rank, also inside a length
            n = left[k]
            while n:
                if not group or filled >= -(-total // groups):
                    group.append([])
                    filled = 0
                take = min(n, -(-total // groups) - filled)
                group[-1].append([k, take])
                filled, n = filled + take, n - take
        tops = [g[0][0] for g in group]
        sizes = np.array(sorted(set(tops), reverse=True))
        queue = {int(s): [run for g, t in zip(group, tops) if t == s for run in g] for s in sizes}
        demand = np.array([sum(n for _, n in queue[int(s)]) for s in sizes], float)
        for times, pattern in patterns(sizes, demand, capacity):
            slots = [int(s) for s, k in zip(sizes, pattern) for _ in range(k)]
            while times:  # actual lengths for rounded ones, as long as each slot's run lasts
                lengths, run = [], times
                use: dict[int, int] = {}
                for s in slots:
                    use[s] = use.get(s, 0) + 1
                if not all(queue[s] for s in use):
                    break
                for s, k in use.items():
                    if queue[s][0][1] >= k:
                        run = min(run, queue[s][0][1] // k)
                    else:
                        run = 1
                taken = {s: [] for s in use}
                for s, k in use.items():
                    if queue[s][0][1] >= k * run:
                        queue[s][0][1] -= k * run
                        taken[s] = [queue[s][0][0]] * k
                    else:
                        for _ in range(k):
                            while queue[s] and not queue[s][0][1]:
                                queue[s].pop(0)
                            if queue[s]:
                                taken[s].append(queue[s][0][0])
                                queue[s][0][1] -= 1
                    while queue[s] and not queue[s][0][1]:
                        queue[s].pop(0)
                for s in slots:
                    if taken[s]:
                        lengths.append(taken[s].pop())
                put(run, lengths)
                times -= run
        left = {k: v for k, v in left.items() if k <= capacity // LARGE}
        for q in queue.values():
            for k, n in q:
                left[k] = left.get(k, 0) + n
    rooms = np.zeros(capacity + 2, bool)
    for r in open_:
        rooms[r] = True
    for k in sorted(left, reverse=True):  # best fit, many equal sequences at a time
        n = left[k]
        while n:
            at = np.flatnonzero(rooms[k:])
            if not len(at):
                each = min(capacity // k, n)
                times = n // each
                open_.setdefault(capacity - each * k, []).append((times, [k] * each))
                rooms[capacity - each * k] = True
                n -= times * each
                continue
            r = k + int(at[0])
            times, items = open_[r].pop()
            each = min(r // k, n)
            use = min(times, n // each)
            if use < times:
                open_[r].append((times - use, items))
            rooms[r] = bool(open_[r])
            open_.setdefault(r - each * k, []).append((use, items + [k] * each))
            rooms[r - each * k] = True
            n -= use * each
    return done + [x for v in open_.values() for x in v]


def places(packed: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of its runs; within a run the sequence grows with the rank."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for times, items in packed:
        at = 0
        for k in items:
            runs.setdefault(k, []).append((ranks.get(k, 0), first, at))
            ranks[k] = ranks.get(k, 0) + times
            at += k
        first += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in runs.items()}


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, length_col: str = "length") -> DataFrame:
    """Adds sequence_id and offset to a table of pieces; repeated rows each get their own place.

    Lengths must be 1 to ``capacity``. Which piece of a length gets which place is arbitrary. A piece's rank is its
    number in a salted group of its length plus the sizes of the groups before, so no length is ranked by one task.
    """
    row, salt, own_n, ahead, rank = (fresh(c, *pieces.columns) for c in ("row", "salt", "own_n", "ahead", "rank"))
    # The number of a row is written with it, so whoever reads it again, after whatever loss, sees the same one.
    numbered = stored(pieces.withColumn(row, F.monotonically_increasing_id()), "pieces")
    counts = {int(k): int(n) for k, n in numbered.groupBy(length_col).count().collect()}  # at most ``capacity`` rows
    where = places(plan(counts, capacity, groups))
    salts = math.isqrt(sum(counts.values())) + 1  # as many salts of a length as rows of a salt
    numbered = numbered.withColumn(salt, F.pmod(F.xxhash64(row), F.lit(salts)))
    own = numbered.groupBy(length_col, salt).agg(F.count("*").alias(own_n))
    earlier = Window.partitionBy(length_col).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    before = own.withColumn(ahead, F.coalesce(F.sum(own_n).over(earlier), F.lit(0))).drop(own_n)
    ranked = numbered.withColumn(rank, F.row_number().over(Window.partitionBy(length_col, salt).orderBy(row)) - 1)
    ranked = ranked.join(before, [length_col, salt]).withColumn(rank, F.col(rank) + F.col(ahead))
    ranked = ranked.select(*pieces.columns, rank)
    held = where

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            length, number = ints(b.column(length_col))[0], ints(b.column(rank))[0]
            sequence, offset = np.empty_like(length), np.empty_like(length)
            order = np.argsort(length, kind="stable")
            cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(length[order]) != 0]), len(order)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                at = order[i:j]
                ranks, firsts, offs = held[int(length[at[0]])]
                k = np.searchsorted(ranks, number[at], "right") - 1
                sequence[at], offset[at] = firsts[k] + number[at] - ranks[k], offs[k]
            cols = [*b.columns[:-1], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:-1], "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return mapped(ranked, run, f"{fields}, sequence_id long, offset long")


def best_fit_pack(docs: DataFrame, **options) -> DataFrame:
    """Tokenizes, cuts and packs documents. Empty texts are one end id; an empty table gives no rows."""
    return pack_pieces(cut_pieces(docs, **options), options.get("capacity", CAPACITY))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids. Repeated rows and ids are documents of their own; null texts are empty."""
    return best_fit_pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
