"""Bytes and bits: records and blocks with checksums, body digests, index slots, seeded draws.

Records are little-endian: id 16, debit 8, credit 8, amount 8, remaining 8, ledger 4, budget 16 bytes. A block has 60 of
them, then a CRC-32C of these 4080 bytes. All is done by numpy on whole Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.shipping import ship
from tallyforge.operators import ledger
from tallyforge.sources import tables
from tallyforge.sources.tables import DUCKDB, HOLDS, SPARK

_U = np.uint64
RECORD = np.dtype([("id", "<u8"), ("id_high", "<u8"), ("debit", "<u8"), ("credit", "<u8"), ("amount", "<i8"), ("remaining", "<i8"), ("ledger", "<u4"), ("budget", "<u8"), ("budget_high", "<u8")])
PER_BLOCK, BLOCK_BYTES = 60, 4096
BODY_BYTES = PER_BLOCK * RECORD.itemsize

# The Castagnoli polynomial, reflected; the digest's multiplier; the generator's mixing constants.
CASTAGNOLI = 0x82F63B78
MIX = 0x517CC1B727220A95
SEED_MULTIPLIER, SEED_MASK = 0x9E3779B97F4A7C15, 0x5DEECE66D5AA1234


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(CASTAGNOLI), t >> 1).astype(np.uint32)
    return t


_TABLE = _crc_table()


def crc32c(rows: np.ndarray) -> np.ndarray:
    """the CRC-32C of each row of bytes, all rows a byte at a time."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        crc = _TABLE[(crc ^ column) & 0xFF] ^ (crc >> 8)
    return crc ^ np.uint32(0xFFFFFFFF)


def stamped(records: np.ndarray) -> np.ndarray:
    """Blocks of 4096 bytes of records, each with its checksum; the last one is filled with zeros."""
    n = -(-len(records) // PER_BLOCK)
    out = np.zeros((n, BLOCK_BYTES), np.uint8)
    body = np.zeros((n * PER_BLOCK, RECORD.itemsize), np.uint8)
    body[: len(records)] = np.frombuffer(records.tobytes(), np.uint8).reshape(-1, RECORD.itemsize)
    out[:, :BODY_BYTES] = body.reshape(n, BODY_BYTES)
    out[:, BODY_BYTES : BODY_BYTES + 4] = crc32c(out[:, :BODY_BYTES]).astype("<u4").view(np.uint8).reshape(-1, 4)
    return out


def intact(blocks: np.ndarray) -> np.ndarray:
    said = np.ascontiguousarray(blocks[:, BODY_BYTES : BODY_BYTES + 4]).view("<u4")[:, 0]
    return said == crc32c(blocks[:, :BODY_BYTES])


FIELDS = ("id", "debit", "credit", "amount", "remaining", "ledger", "budget")


def write_blocks(holds: DataFrame) -> DataFrame:
    """(part, block, payload) from rows of ``FIELDS``; parts are dealt out by ledger, so a block holds neighbours."""
    ship(holds.sparkSession)
    n = int(holds.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, np.zeros(0, RECORD)

        def blocks(records: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            made = stamped(records)
            out = pa.RecordBatch.from_arrays([pa.array(np.full(len(made), part, np.int32)), pa.array(number + np.arange(len(made), dtype=np.int64)), pa.array([x.tobytes() for x in made], pa.binary())], ["part", "block", "payload"])
            number += len(made)
            return out

        for b in batches:
            new = np.zeros(b.num_rows, RECORD)
            for f in FIELDS:
                new[f] = b.column(f).to_numpy(zero_copy_only=False)
            held = np.concatenate([held, new])
            whole = len(held) // PER_BLOCK * PER_BLOCK
            if whole:
                yield blocks(held[:whole])
                held = held[whole:]
        if len(held):
            yield blocks(held)

    rows = holds.select(*FIELDS).repartition(n, "ledger").sortWithinPartitions("ledger", "id")
    return rows.mapInArrow(run, "part int, block long, payload binary")


def read_blocks(blocks: DataFrame) -> DataFrame:
    """The records of blocks, each with ``intact``: whether its block's checksum holds. Records of a damaged block are as they read."""
    ship(blocks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            raw = np.frombuffer(b"".join(b.column("payload").to_pylist()), np.uint8).reshape(-1, BLOCK_BYTES)
            good = np.repeat(intact(raw), PER_BLOCK)
            records = np.frombuffer(np.ascontiguousarray(raw[:, :BODY_BYTES]).tobytes(), RECORD)
            own = (records["id"] != 0) | (records["id_high"] != 0)
            cols = [pa.array(records[f][own].astype(np.int64)) for f in FIELDS]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(good[own])], [*FIELDS, "intact"])

    return blocks.mapInArrow(run, ", ".join(f"{f} long" for f in FIELDS) + ", intact boolean")


def hold_records(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT hold_id AS id, debit_account AS debit, credit_account AS credit, amount, remaining, ledger, CASE WHEN hold_id % 3 = 0 THEN hold_id ELSE 0 END AS budget FROM ({ledger._hold_fold(SPARK)}) h WHERE remaining > 0")


def record_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open holds through the record format and its blocks, read back."""
    tables.register(spark, sf_dir)
    return read_blocks(write_blocks(hold_records(spark)))


# ---- digests and slots ----


def digest(words: np.ndarray) -> np.ndarray:
    """Each row of eight words into one: rotate left by five, xor a word, multiply; modulo 2 ** 64."""
    h = np.full(len(words), MIX, _U)
    with np.errstate(over="ignore"):
        for w in words.astype(_U).T:
            h = (((h << _U(5)) | (h >> _U(59))) ^ w) * _U(MIX)
    return h


def body_digest(spark: SparkSession, tx_id: Column, debit: Column, credit: Column, amount: Column, ref: Column, ledger_: Column, flags: Column) -> Column:
    """The digest of a request's body, as a signed number of the same bits. Ids have no high words here."""
    ship(spark)

    @F.arrow_udf("long")
    def run(tx: pa.Array, d: pa.Array, c: pa.Array, a: pa.Array, r: pa.Array, le: pa.Array, f: pa.Array) -> pa.Array:
        t, d, c, a, r, le, f = (x.to_numpy(zero_copy_only=False).astype(np.int64).view(_U) for x in (tx, d, c, a, r, le, f))
        none = np.zeros(len(t), _U)
        return pa.array(digest(np.stack([t, none, d, c, a, r, none, (le << _U(16)) | f], 1)).view(np.int64))

    return run(tx_id, debit, credit, amount, ref, ledger_, flags)


def body_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all hold requests."""
    tables.register(spark, sf_dir)
    h, zero = spark.sql(HOLDS), F.lit(0).cast("long")
    return h.select("hold_id", F.hex(body_digest(spark, F.col("hold_id"), F.col("debit_account"), F.col("credit_account"), F.col("amount"), zero, F.col("ledger"), F.lit(1).cast("long"))).alias("digest"))


def index_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15, P16, 2.9g: an index slot of fingerprint (16 bits, never 0), a mark for shared ones and address (47 bits), and back; the two buckets of an entry."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey")
    fields = o.select("o_orderkey", F.greatest(F.pmod(key * 40503, F.lit(65536)), F.lit(1)).alias("fp"), (key % 97 == 0).cast("long").alias("ambiguous"), F.pmod(F.unix_date(F.col("o_orderdate").cast("date")).cast("long"), F.lit(63)).alias("segment"), F.floor(key / 60).alias("block"), (key % 60).alias("slot"))
    address = F.shiftleft("segment", 41).bitwiseOR(F.shiftleft("block", 6)).bitwiseOR(F.col("slot"))
    word = F.shiftleft("fp", 48).bitwiseOR(F.shiftleft("ambiguous", 47)).bitwiseOR(address)
    home = F.col("o_orderkey").bitwiseAND(1023)
    step = F.pmod(F.col("fp") * 31, F.lit(1024))
    other = home.bitwiseXOR(F.when(step == 0, 1).otherwise(step))
    packed = fields.withColumn("word", word).withColumn("home", home).withColumn("alternate", other)
    back = F.col("word").bitwiseAND((1 << 47) - 1)
    return packed.select("o_orderkey", F.hex("word").alias("word"), F.shiftrightunsigned("word", 48).alias("fingerprint"), (F.shiftrightunsigned("word", 47).bitwiseAND(1) == 1).alias("ambiguous"), F.shiftrightunsigned(back, 41).alias("segment"), F.shiftrightunsigned(back, 6).bitwiseAND((1 << 35) - 1).alias("block"), back.bitwiseAND(63).alias("slot"), "home", "alternate")


# ---- draws ----

DRAWS = 8


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def seeds(spark: SparkSession, n: int) -> DataFrame:
    """Start states of generators 0 to n - 1: the seed mixed once, never 0; products by halves, as BIGINT would overflow."""
    low, high = SEED_MULTIPLIER & 0xFFFFFFFF, SEED_MULTIPLIER >> 32
    s = F.col("id")
    mixed = F.shiftleft((s * high).bitwiseAND(0xFFFFFFFF), 32)
    total = s * low  # below 2 ** 63 for seeds below 2 ** 31
    # The sum of both modulo 2 ** 64: halves again, with the carry from the lower one.
    below = mixed.bitwiseAND(0xFFFFFFFF) + total.bitwiseAND(0xFFFFFFFF)
    above = F.shiftrightunsigned(mixed, 32) + F.shiftrightunsigned(total, 32) + F.shiftrightunsigned(below, 32)
    product = F.shiftleft(above.bitwiseAND(0xFFFFFFFF), 32).bitwiseOR(below.bitwiseAND(0xFFFFFFFF))
    return spark.range(n).select(F.col("id").alias("seed"), product.bitwiseXOR(_signed(SEED_MASK)).bitwiseOR(1).alias("state"))


def stepped(state: Column) -> Column:
    """The next state of a xorshift generator."""
    x = state.bitwiseXOR(F.shiftleft(state, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    return x.bitwiseXOR(F.shiftleft(x, 17))


def seeded_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9d, 2.9e, X2: the first draws of seeds, as bits, as a number from 0 to 1, and as an exponential gap with a mean of 1000."""
    states = seeds(spark, 100).select("seed", F.aggregate(F.sequence(F.lit(1), F.lit(DRAWS)), F.array(F.col("state")), lambda a, _: F.concat(a, F.array(stepped(F.element_at(a, -1))))).alias("states"))
    rows = states.select("seed", F.posexplode("states")).filter("pos > 0")
    unit = F.shiftrightunsigned("col", 11) / float(1 << 53)
    return rows.select("seed", F.col("pos").cast("long").alias("draw"), F.hex("col").alias("bits"), F.round(unit, 9).alias("unit"), F.floor(-F.log(1 - unit) * 1000 + 1e-9).cast("long").alias("gap"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (record_blocks, body_digests, index_slots, seeded_draws)}


def _wide(x: int | str) -> str:
    return f"CAST({x} AS UHUGEINT)"


_M64 = _wide((1 << 64) - 1)


def _duck_digest(words: list[str]) -> str:
    """The fold with 128-bit numbers, cut to 64 bits after each step."""
    h = _wide(MIX)
    steps = []
    for i, w in enumerate(words):
        rotated = f"(((h{i} * 32) & {_M64}) | (h{i} // 576460752303423488))"
        steps.append(f"(xor({rotated}, {_wide(w)}) * {_wide(MIX)}) & {_M64} AS h{i + 1}")
    out = f"SELECT *, {h} AS h0 FROM w"
    for s in steps:
        out = f"SELECT *, {s} FROM ({out}) q"
    return out


def _duck_step(x: str, name: str, source: str) -> str:
    return f"""SELECT *, xor(c, (c * 131072) & {_M64}) AS {name} FROM (SELECT * EXCLUDE (c), xor(b, b // 128) AS c FROM (SELECT *, xor({x}, ({x} * 8192) & {_M64}) AS b, {_wide(0)} AS c FROM ({source}) s0) s1) s2"""


def _duck_draws() -> str:
    q = f"SELECT range AS seed, xor((CAST(range AS UHUGEINT) * {_wide(SEED_MULTIPLIER)}) & {_M64}, {_wide(SEED_MASK)}) | {_wide(1)} AS x0 FROM range(100)"
    for i in range(DRAWS):
        q = f"SELECT * EXCLUDE (b, c) FROM ({_duck_step(f'x{i}', f'x{i + 1}', q)}) t"
    rows = " UNION ALL ".join(f"SELECT seed, CAST({i} AS BIGINT) AS draw, x{i} AS x FROM q" for i in range(1, DRAWS + 1))
    return f"WITH q AS MATERIALIZED ({q}), r AS ({rows}), u AS (SELECT *, CAST(x // 2048 AS DOUBLE) / 9007199254740992.0::DOUBLE AS unit FROM r) SELECT seed, draw, to_hex(CAST(x AS UBIGINT)) AS bits, round(unit, 9) AS unit, CAST(floor(-ln(1 - unit) * 1000 + 1e-9) AS BIGINT) AS gap FROM u"


_SLOT = f"""SELECT o_orderkey, greatest((o_orderkey * 40503) % 65536, 1) AS fp, o_orderkey % 97 = 0 AS shared, {DUCKDB.day('o_orderdate')} % 63 AS segment, o_orderkey // 60 AS block, o_orderkey % 60 AS slot, o_orderkey % 1024 AS home FROM orders"""

ORACLE_SQL = {
    "record_blocks": f"SELECT hold_id AS id, debit_account AS debit, credit_account AS credit, amount, remaining, ledger, CASE WHEN hold_id % 3 = 0 THEN hold_id ELSE 0 END AS budget, true AS intact FROM ({ledger._hold_fold(DUCKDB)}) h WHERE remaining > 0",
    "body_digests": f"WITH w AS ({HOLDS}) SELECT hold_id, to_hex(CAST(h8 AS UBIGINT)) AS digest FROM ({_duck_digest(['hold_id', '0', 'debit_account', 'credit_account', 'amount', '0', '0', 'ledger * 65536 + 1'])}) d",
    "index_slots": f"""WITH s AS ({_SLOT}) SELECT o_orderkey, to_hex(CAST(CAST(fp AS UHUGEINT) * {_wide(1 << 48)} + CAST(CASE WHEN shared THEN 140737488355328 ELSE 0 END + segment * 2199023255552 + block * 64 + slot AS UHUGEINT) AS UBIGINT)) AS word,
      fp AS fingerprint, shared AS ambiguous, segment, block, slot, home, xor(home, CASE WHEN (fp * 31) % 1024 = 0 THEN 1 ELSE (fp * 31) % 1024 END) AS alternate FROM s""",
    "seeded_draws": _duck_draws(),
}
