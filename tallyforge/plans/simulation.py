"""Generated traffic, judged and audited: many seeds at once, one ledger for each."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.shipping import ship
from tallyforge.operators.wire import SEED_MASK, SEED_MULTIPLIER
from tallyforge.plans import judge
from tallyforge.plans.judge import LINKED, PENDING, POST, VOID

EXTERNAL, USERS, MASK = 1, 6, (1 << 64) - 1
REQUESTS = "ledger long, at timestamp, phase int, tx_id long, pending_ref long, debit_account long, credit_account long, amount long, flags int, end_of_batch boolean"


class Draws:
    """The seeded generator; the same stream as ``wire.seeded_draws``."""

    def __init__(self, seed: int):
        self.state = ((seed * SEED_MULTIPLIER & MASK) ^ SEED_MASK) | 1

    def below(self, n: int) -> int:
        x = self.state
        x ^= x << 13 & MASK
        x ^= x >> 7
        x ^= x << 17 & MASK
        self.state = x
        return x % n


class Traffic:
    """A client that is often wrong. Of eight things it does two are posts, one a repeat, two holds, a settlement, a void and a chain."""

    def __init__(self, seed: int):
        self.draws, self.n, self.last, self.holds = Draws(seed), 100, None, []

    def account(self, other: int = 0) -> int:
        while (a := 10 + self.draws.below(USERS)) == other:
            pass
        return a

    def body(self, ref: int, debit: int, credit: int, amount: int, flags: int) -> tuple:
        self.n += 1
        return self.n, ref, debit, credit, amount, flags

    def act(self) -> list[tuple]:
        """Bodies of one submission."""
        what, d = self.draws.below(8), self.draws
        if what < 2:
            debit = self.account()
            self.last = self.body(0, debit, self.account(debit), 1 + d.below(500), 0)
            return [self.last]
        if what == 2:
            return [self.last] if self.last else []
        if what < 5:
            debit = EXTERNAL if d.below(4) == 0 else self.account()
            hold = self.body(0, debit, self.account(debit), 1 + d.below(500), PENDING)
            self.holds.append(hold)
            return [hold]
        if what < 7:
            if not self.holds:
                return []
            tx, _, debit, credit, amount, _ = self.holds[d.below(len(self.holds))]
            return [self.body(tx, debit, credit, 1 + d.below(amount + 200) if what == 5 else 0, POST if what == 5 else VOID)]
        a = self.account()
        amount = 1 + d.below(400)
        kind = d.below(4)  # whole; too much; no last leg; an invalid leg
        legs = [self.body(0, EXTERNAL, a, amount, LINKED), self.body(0, a, self.account(a), amount + (100_000 if kind == 1 else 0), LINKED if kind == 2 else 0)]
        if kind == 3:
            legs.insert(1, self.body(0, a, a, amount, LINKED))
        return legs


def messy(spark: SparkSession, seeds: int, steps: int) -> DataFrame:
    """Requests of each seed, one ledger each; all follow from the seed."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for seed in b.column(0).to_pylist():
                traffic, rows = Traffic(seed), []
                for user in range(USERS):
                    rows.append([traffic.body(0, EXTERNAL, 10 + user, 2_000, 0)])
                rows += [x for _ in range(steps) if (x := traffic.act())]
                flat = [(seed, 0, *leg, i == len(legs) - 1) for legs in rows for i, leg in enumerate(legs)]
                at = pa.array(range(len(flat)), pa.int64()).cast(pa.timestamp("us", "UTC"))
                cols = list(zip(*flat))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
                arrays = [pa.array(c, t) for c, t in zip(cols, types)]
                names = ["ledger", "phase", "tx_id", "pending_ref", "debit_account", "credit_account", "amount", "flags", "end_of_batch"]
                yield pa.RecordBatch.from_arrays([arrays[0], at, *arrays[1:]], [names[0], "at", *names[1:]])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.range(0, seeds, 1, n).mapInArrow(run, REQUESTS)


def _accounts(spark: SparkSession, seeds: int) -> DataFrame:
    """Each seed's ledger has its own accounts; ids repeat, so they are told apart by a shift."""
    users = F.explode(F.array(*(F.lit(a) for a in [EXTERNAL, *range(10, 10 + USERS)])))
    return spark.range(seeds).select(F.col("id").alias("ledger"), users.alias("a")).select((F.col("ledger") * 1000 + F.col("a")).cast("long").alias("account_id"), "ledger", (F.col("a") != EXTERNAL).alias("constrained"))


def simulate(spark: SparkSession, seeds: int, steps: int) -> DataFrame:
    """Per seed, how often each path was reached, and the first identity that doesn't hold, or nothing."""
    shift = F.col("ledger") * 1000
    asked = messy(spark, seeds, steps).withColumns({"debit_account": F.col("debit_account") + shift, "credit_account": F.col("credit_account") + shift})
    accounts = _accounts(spark, seeds)
    judged = judge.judge_seq(asked, accounts)
    count = lambda name, condition: F.count_if(condition).alias(name)
    col = F.col
    reached = judged.groupBy("ledger").agg(
        F.count("*").alias("requests"), count("committed", col("outcome") == "Committed"), count("duplicates", col("outcome") == "Duplicate"), count("rejected", col("outcome") == "Rejected"),
        count("poor", col("error") == "InsufficientBalance"), count("exceeds", col("error") == "SettleExceedsRemaining"), count("gone", col("error") == "PendingRefNotFound"),
        count("unterminated", col("error") == "LinkedChainUnterminated"), count("chained", col("chain") > 0), count("voided", col("kind") == "Void"),
    )
    balances = judge.judge_balances(asked, accounts)
    total = lambda c: F.sum(c).alias(c)
    sums = balances.groupBy("ledger").agg(*(total(c) for c in judge.BALANCES.names[2:]), F.min(F.least(*judge.BALANCES.names[2:])).alias("least"))
    open_ = judge.effects(judged).filter("kind <> 'Post'").groupBy("ledger").agg(F.sum(F.when(col("kind") == "Hold", col("amount")).otherwise(-col("amount"))).alias("held"))
    broken = (
        F.when(col("debits_posted") != col("credits_posted"), "posted sides differ")
        .when(col("debits_pending") != col("credits_pending"), "pending sides differ")
        .when(col("least") < 0, "a column is negative")
        .when(col("debits_pending") != F.coalesce("held", F.lit(0)), "holds and pending columns differ")
        .when(col("requests") != col("committed") + col("duplicates") + col("rejected"), "outcomes don't add up")
        .otherwise("")
    )
    return reached.join(sums, "ledger").join(open_, "ledger", "left").select(col("ledger").alias("seed"), *reached.columns[1:], broken.alias("broken"))


def simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 seeds of 300 steps each; no table is read."""
    return simulate(spark, 40, 300)


# ---- load ----

WORKLOADS = ("single-phase", "hold-settle", "partial-settle", "void-heavy", "hot-lane", "linked")
LOAD_ACCOUNTS, LOAD_REQUESTS, FUNDING, AMOUNT = 1000, 3000, 1_000_000_000, 1000


def _share(i: Column, salt: int) -> Column:
    """A share from 0 to 1 that follows from a place and a salt."""
    return F.pmod(i * 7_368_787 + salt * 104_729, F.lit(1_000_003)) / 1_000_003.0


def load_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six workloads as requests; a resolution comes five requests after its hold."""
    rows = spark.range(LOAD_REQUESTS).crossJoin(F.broadcast(spark.createDataFrame([(w,) for w in WORKLOADS], "workload string")))
    i, w = F.col("id"), F.col("workload")
    turn = F.when(w == "single-phase", 0).when(w == "hot-lane", 0).when(w == "linked", i % 2).otherwise(F.pmod(F.floor(i / 5), F.lit(2)))
    place = F.when((w == "linked") | (turn == 0), i).otherwise(i - 5)  # the hold that a resolution is for
    skew = F.when(w == "hot-lane", 4.0).otherwise(1.0)
    debit = F.floor(F.pow(_share(place, 1), skew) * LOAD_ACCOUNTS).cast("long")
    credit = F.pmod(debit + 1 + F.floor(_share(place, 2) * (LOAD_ACCOUNTS - 1)).cast("long"), F.lit(LOAD_ACCOUNTS))
    resolves = (turn == 1) & (w != "linked")
    flags = F.when(w.isin("single-phase", "hot-lane"), 0).when(w == "linked", F.when(turn == 0, LINKED).otherwise(0)).when(turn == 0, PENDING).when(w == "void-heavy", VOID).otherwise(POST)
    amount = F.when(resolves & (w == "partial-settle"), AMOUNT // 3).when(resolves & (w == "void-heavy"), 0).otherwise(AMOUNT)
    main = rows.select("workload", (i + 1 + LOAD_ACCOUNTS).alias("tx_id"), F.when(resolves, place + 1 + LOAD_ACCOUNTS).otherwise(0).cast("long").alias("pending_ref"), (debit + 10).alias("debit_account"), (credit + 10).alias("credit_account"), amount.cast("long").alias("amount"), flags.cast("int").alias("flags"))
    fund = spark.range(LOAD_ACCOUNTS).crossJoin(F.broadcast(spark.createDataFrame([(x,) for x in WORKLOADS], "workload string")))
    first = fund.select("workload", (i + 1).alias("tx_id"), F.lit(0).cast("long").alias("pending_ref"), F.lit(1).cast("long").alias("debit_account"), (i + 10).alias("credit_account"), F.lit(FUNDING).cast("long").alias("amount"), F.lit(0).alias("flags"))
    return first.unionByName(main)


# ---- capacity ----

# Nanoseconds a request costs in each stage.
STAGES = {"intake": 181, "judge": 93, "propose": 5, "apply": 135, "answer": 50}
PLANS = [("idle", 100_000, 2_000_000, 65_536, 400_000), ("busy", 2_000_000, 2_000_000, 65_536, 400_000), ("over", 3_000_000, 2_000_000, 65_536, 400_000), ("slots", 1_000_000, 90_000_000, 65_536, 2_000_000), ("device", 500_000, 2_000_000, 65_536, 20_000)]
READS_PER_REQUEST, SLO_NS = 0.1, 5_000_000


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a plan's rate, commit latency, slots and device allow, and what limits it first.

    A core that is a share u busy holds a request for its cost / (1 - u).
    """
    p = spark.createDataFrame(PLANS, "plan string, rate long, latency_ns long, slots long, iops long")
    cost, col = sum(STAGES.values()), F.col
    core, slots, device = F.lit(1e9 / cost), col("slots") / (col("latency_ns") / 1e9), col("iops") / READS_PER_REQUEST
    most = F.least(core, slots, device)
    got = F.least(col("rate").cast("double"), most)
    limit = F.when(col("rate") <= most, "none").when(core == most, "core").when(slots == most, "slots").otherwise("device")
    waits = F.when(got < core, F.least(F.lit(1e9), cost / (1 - got / core))).otherwise(1e9)
    return p.select("plan", F.floor(got).cast("long").alias("throughput"), F.round(got / core, 6).alias("core_use"), limit.alias("limited_by"), F.floor(col("latency_ns") + waits).cast("long").alias("latency_ns"))


def required_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By ten halvings, the slowest commit at which a plan still carries 95 % of its rate within its latency target."""
    p = spark.createDataFrame(PLANS, "plan string, rate long, latency_ns long, slots long, iops long")
    cost, col = sum(STAGES.values()), F.col
    core = 1e9 / cost

    def meets(latency: Column) -> Column:
        most = F.least(F.lit(core), col("slots") / (latency / 1e9), col("iops") / READS_PER_REQUEST)
        got = F.least(col("rate").cast("double"), most)
        busy = F.when(got < core, cost / (1 - got / core)).otherwise(1e9)
        return (got >= 0.95 * col("rate")) & (latency + busy <= SLO_NS)

    def halve(s: Column, _: Column) -> Column:
        middle = (s["low"] + s["high"]) / 2
        ok = meets(middle)
        return F.struct(F.when(ok, middle).otherwise(s["low"]).alias("low"), F.when(ok, s["high"]).otherwise(middle).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.struct(F.lit(0.0).alias("low"), F.lit(10_000_000.0).alias("high")), halve)
    return p.select("plan", F.round(found["low"], 3).alias("latency_ns"))


QUERIES = {f.__name__: f for f in (simulation, load_requests, predictions, required_latency)}


def _duck_load() -> str:
    share = lambda salt: f"(((place * 7368787 + {salt * 104_729}) % 1000003 + 1000003) % 1000003 / 1000003.0::DOUBLE)"
    values = ", ".join(f"('{w}')" for w in WORKLOADS)
    return f"""WITH w AS (SELECT * FROM (VALUES {values}) v(workload)),
      a AS (SELECT range AS i, workload, CASE WHEN workload IN ('single-phase', 'hot-lane') THEN 0 WHEN workload = 'linked' THEN range % 2 ELSE (range // 5) % 2 END AS turn FROM range({LOAD_REQUESTS}), w),
      b AS (SELECT *, turn = 1 AND workload <> 'linked' AS resolves, CASE WHEN turn = 1 AND workload <> 'linked' THEN i - 5 ELSE i END AS place FROM a),
      c AS (SELECT *, CAST(floor(pow({share(1)}, CASE WHEN workload = 'hot-lane' THEN 4 ELSE 1 END) * {LOAD_ACCOUNTS}) AS BIGINT) AS d, CAST(floor({share(2)} * {LOAD_ACCOUNTS - 1}) AS BIGINT) AS away FROM b)
      SELECT workload, i + {1 + LOAD_ACCOUNTS} AS tx_id, CASE WHEN resolves THEN place + {1 + LOAD_ACCOUNTS} ELSE 0 END AS pending_ref, d + 10 AS debit_account, (d + 1 + away) % {LOAD_ACCOUNTS} + 10 AS credit_account,
        CAST(CASE WHEN resolves AND workload = 'partial-settle' THEN {AMOUNT // 3} WHEN resolves AND workload = 'void-heavy' THEN 0 ELSE {AMOUNT} END AS BIGINT) AS amount,
        CAST(CASE WHEN workload IN ('single-phase', 'hot-lane') THEN 0 WHEN workload = 'linked' THEN CASE WHEN turn = 0 THEN 8 ELSE 0 END WHEN turn = 0 THEN 1 WHEN workload = 'void-heavy' THEN 4 ELSE 2 END AS INTEGER) AS flags FROM c
      UNION ALL SELECT workload, range + 1, 0, 1, range + 10, {FUNDING}, 0 FROM range({LOAD_ACCOUNTS}), w"""


_COST = sum(STAGES.values())
_PLANS = "(VALUES " + ", ".join(f"('{p}', {r}::BIGINT, {lat}::BIGINT, {s}::BIGINT, {i}::BIGINT)" for p, r, lat, s, i in PLANS) + ") p(plan, rate, latency_ns, slots, iops)"
_CORE = f"(1e9::DOUBLE / {_COST})"


def _duck_required() -> str:
    most = f"least({_CORE}, slots / (mid / 1e9::DOUBLE), iops / {READS_PER_REQUEST}::DOUBLE)"
    got = f"least(rate::DOUBLE, {most})"
    ok = f"({got} >= 0.95::DOUBLE * rate AND mid + CASE WHEN {got} < {_CORE} THEN {_COST} / (1 - {got} / {_CORE}) ELSE 1e9 END <= {SLO_NS})"
    return f"""WITH RECURSIVE s AS (SELECT plan, rate, slots, iops, 0 AS i, 0.0::DOUBLE AS low, 10000000.0::DOUBLE AS high FROM {_PLANS}
      UNION ALL SELECT plan, rate, slots, iops, i + 1, CASE WHEN {ok} THEN mid ELSE low END, CASE WHEN {ok} THEN high ELSE mid END FROM (SELECT *, (low + high) / 2 AS mid FROM s WHERE i < 10) m)
      SELECT plan, round(low, 3) AS latency_ns FROM s WHERE i = 10"""


ORACLE_SQL = {
    "load_requests": _duck_load(),
    "predictions": f"""WITH a AS (SELECT *, {_CORE} AS core, slots / (latency_ns / 1e9::DOUBLE) AS s, iops / {READS_PER_REQUEST}::DOUBLE AS d FROM {_PLANS}), b AS (SELECT *, least(core, s, d) AS most, least(rate::DOUBLE, core, s, d) AS got FROM a)
      SELECT plan, CAST(floor(got) AS BIGINT) AS throughput, round(got / core, 6) AS core_use, CASE WHEN rate <= most THEN 'none' WHEN core = most THEN 'core' WHEN s = most THEN 'slots' ELSE 'device' END AS limited_by,
      CAST(floor(latency_ns + CASE WHEN got < core THEN least(1e9, {_COST} / (1 - got / core)) ELSE 1e9 END) AS BIGINT) AS latency_ns FROM b""",
    "required_latency": _duck_required(),
}
