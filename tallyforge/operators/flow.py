"""What happens to requests on their way: batches, answers, faults, expiry, limits and reports.

Each query is a DataFrame plan; ``ORACLE_SQL`` states its result in another form.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions.folds import Fold, fold
from tallyforge.operators import ledger
from tallyforge.sources import tables
from tallyforge.sources.tables import DUCKDB, HOLDS, near

BATCH_SIZE, BATCH_MAX, LINGER = 4, 6, 3_600_000_000
PARK, VOIDS_A_TICK, INTAKE = 40, 16, 64
FLUSH_DAYS, RESIDENT_DAYS = 30, 60
STOP_LANES = 3


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("cents", F.round(F.col("value") * 100).cast("long"))


_E = "e AS (SELECT *, epoch_us(ts) AS us, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"


# ---- W5: lanes ----


class Lane(Fold):
    def __init__(self) -> None:
        self.available, self.rejected = ledger.OPENING, 0

    def row(self, amount: int) -> Iterable[tuple]:
        if amount <= self.available:
            self.available -= amount
        else:
            self.rejected += 1
        return ()

    def end(self, key: tuple) -> Iterable[tuple]:
        yield key[0], self.available, self.rejected


def judge_epoch_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per lane, holds against the opening funds in order; a rejected one takes nothing."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") + 1000).alias("lane"), "o_orderdate", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("amount"))
    return fold(o, ["lane"], ["o_orderdate", "o_orderkey", "amount"], ["amount"], Lane, "lane long, available long, rejected long")


# ---- W10: batches ----


class Batcher(Fold):
    """Units (single effects, or whole chains) into batches: closed from ``size`` on, never over ``most``, none older than ``linger``."""

    def __init__(self, size: int = BATCH_SIZE, most: int = BATCH_MAX, linger: int = LINGER):
        self.size, self.most, self.linger = size, most, linger
        self.batch, self.held, self.opened = 1, 0, 0

    def _next(self) -> None:
        self.batch, self.held = self.batch + 1, 0

    def place(self, legs: int, now: int) -> int:
        if self.held and now - self.opened >= self.linger:
            self._next()
        fresh = not self.held
        if self.held and self.held + legs > self.most:  # the chain would be cut, so what was before it goes alone
            self._next()
        if fresh:
            self.opened = now
        mine = self.batch
        self.held += legs
        if self.held >= self.size:
            self._next()
        return mine

    def row(self, user: int, unit: int, legs: int, now: int) -> Iterable[tuple]:
        yield user, unit, legs, self.place(legs, now)


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10, 2.10c: the effects of a submitter in proposals; a unit is an event, or a chain of them that its last leg completes."""
    tables.register(spark, sf_dir)
    chains = spark.sql(ledger._chains(tables.SPARK)).join(_events(spark, sf_dir).select("event_id", "us"), "event_id")
    unit = F.when(F.col("chain") > 0, -F.col("chain")).otherwise(F.col("event_id") + 1)
    units = chains.groupBy("user_id", unit.alias("unit")).agg(F.count("*").alias("legs"), F.max("us").alias("us"), F.max("event_id").alias("last"))
    return fold(units, ["user_id"], ["last"], ["user_id", "unit", "legs", "us"], Batcher, "user_id long, unit long, legs long, batch long")


# ---- answers ----


def stale_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made before all earlier requests of the lane were applied; those are asked again."""
    e = _events(spark, sf_dir)
    lane = Window.partitionBy("user_id")
    asked = e.select("user_id", "event_id", F.col("us").alias("at"), F.lit(1).alias("asks"), F.lit(0).alias("done"), F.lit(1).alias("turn"))
    done = e.select("user_id", "event_id", (F.col("us") + F.col("cents") * 1000 + 1).alias("at"), F.lit(0), F.lit(1), F.lit(0))
    order = lane.orderBy("at", "turn", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = asked.unionAll(done).select("*", F.coalesce(F.sum("asks").over(order), F.lit(0)).alias("expected"), F.coalesce(F.sum("done").over(order), F.lit(0)).alias("applied")).filter("asks = 1")
    return seen.select("event_id", "user_id", "expected", "applied", (F.col("applied") < F.col("expected")).alias("stale"))


def judgeable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request can be judged once the duplicate check has answered, and the engine too if it resolves a hold."""
    e = _events(spark, sf_dir)
    checked = e.select("event_id", (F.col("us") + 500).alias("checked_at"))
    looked_up = e.filter("event_type = 'purchase' AND event_id % 10 <> 3").select("event_id", (F.col("us") + F.col("cents")).alias("found_at"))
    both = e.select("event_id", "event_type").join(checked, "event_id", "left").join(looked_up, "event_id", "left")
    ready = F.when(F.col("event_type") != "purchase", F.col("checked_at")).when(F.col("found_at").isNotNull(), F.greatest("checked_at", "found_at"))
    return both.select("event_id", ready.alias("ready_at"), ready.isNotNull().alias("judgeable"))


def commit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6, 2.10k, 2.10l: commits must come in the order of proposals; the first that doesn't seals the node, and what follows waits."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    node = (F.col("o_custkey") % 100).alias("node")
    proposed = o.select(node, "o_orderkey", F.row_number().over(Window.partitionBy(F.col("o_custkey") % 100).orderBy("o_orderkey")).alias("i"))
    # Every 50th commit of a node changes places with the one after it.
    swapped = F.when(F.col("i") % 50 == 0, F.col("i") + 1).when((F.col("i") % 50 == 1) & (F.col("i") > 1), F.col("i") - 1).otherwise(F.col("i"))
    committed = proposed.select("node", F.col("o_orderkey").alias("committed"), swapped.alias("i"))
    both = proposed.join(committed, ["node", "i"], "left")
    first = F.min(F.when(~F.col("committed").eqNullSafe(F.col("o_orderkey")), F.col("i")))
    return both.groupBy("node").agg(F.count("*").alias("proposed"), first.cast("long").alias("sealed_at"), F.coalesce(first - 1, F.count("*")).cast("long").alias("applied"))


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lanes with lost requests answer: a gap, then quarantine; from the third such lane on the whole node stops."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_custkey") + 1000).alias("lane"), F.col("o_orderdate").alias("tm"))
    seqs = o.withColumn("seq", F.row_number().over(Window.partitionBy("lane").orderBy("tm", "o_orderkey"))).filter("o_orderkey % 997 <> 0")
    gaps = seqs.withColumn("last", F.coalesce(F.lag("seq").over(Window.partitionBy("lane").orderBy("tm", "o_orderkey")), F.lit(0))).withColumn("gap", F.col("seq") != F.col("last") + 1)
    first = gaps.filter("gap").groupBy("lane").agg(F.min(F.struct("tm", "o_orderkey")).alias("broken"))
    third = first.orderBy("broken").limit(STOP_LANES).groupBy().agg(F.when(F.count("*") == STOP_LANES, F.max("broken")).alias("stopped"))
    at = F.struct("tm", "o_orderkey")
    answer = F.when(at > F.col("stopped"), "FailStop").when(at > F.col("broken"), "AccountQuarantined").when(at == F.col("broken"), "SeqGap").otherwise("")
    return gaps.join(near(first), "lane", "left").crossJoin(F.broadcast(third)).select("o_orderkey", "lane", answer.alias("error"))


# ---- expiry ----


def _outstanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voids that expiry has proposed and that have no answer yet."""
    tables.register(spark, sf_dir)
    return spark.sql(ledger.expiring_holds(tables.SPARK))


def _live(spark: SparkSession) -> DataFrame:
    return spark.sql(ledger.open_holds(tables.SPARK))


def expiry_reoffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9, J10, U3, 2.10g: declined voids that are still outstanding, and whose hold still lives, are offered again."""
    out = _outstanding(spark, sf_dir)
    declined = spark.sql(f"SELECT hold_id FROM ({HOLDS}) h WHERE hold_id % 5 = 0")
    live = _live(spark).filter("hold_id % 15 <> 0").select("hold_id")
    offered = out.join(declined, out.pending_ref == declined.hold_id, "left_semi")
    return offered.join(live, offered.pending_ref == live.hold_id, "left_semi").select("tx_id", "pending_ref", "amount")


def lookups_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settlements whose hold isn't known to be gone; only those ask the engine."""
    tables.register(spark, sf_dir)
    gone = spark.sql(f"SELECT hold_id FROM ({ledger._hold_fold(tables.SPARK)}) h WHERE remaining = 0")
    asked = spark.sql(f"SELECT hold_id, line, part, amount FROM ({tables.SETTLES}) s WHERE line > 1")
    return asked.join(gone, "hold_id", "left_anti").groupBy("hold_id").agg(F.count("*").alias("lookups"), F.sum("amount").cast("long").alias("amount"))


def expiry_parking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """So many voids of a ledger are parked and admitted a few a tick, behind the clients; the others are declined."""
    n = F.row_number().over(Window.partitionBy("ledger").orderBy("expired_on", "pending_ref")) - 1
    return _outstanding(spark, sf_dir).withColumn("n", n).select("tx_id", "ledger", F.when(F.col("n") < PARK, F.floor(F.col("n") / VOIDS_A_TICK)).cast("long").alias("tick"), (F.col("n") >= PARK).alias("declined"))


def intake_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2, 2.10a, 2.10j: per user, how many ticks its requests take, at most so many a tick, and how many are left of the last one."""
    n = F.count("*")
    return _events(spark, sf_dir).groupBy("event_type").agg(F.ceil(n / INTAKE).cast("long").alias("ticks"), F.pmod(n, F.lit(INTAKE)).cast("long").alias("in_last"))


def evictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idle entries leave, the longest idle first, a few a round; one that is still busy stays."""
    e = _events(spark, sf_dir)
    last = e.groupBy("user_id").agg(F.max("us").alias("last"))
    now = e.agg(F.max("us").alias("now"))
    idle = last.crossJoin(F.broadcast(now)).filter(F.col("now") - F.col("last") > 6 * 3_600_000_000)
    shard = F.pmod(F.col("user_id"), F.lit(8))
    return idle.select("user_id", F.floor((F.row_number().over(Window.partitionBy(shard).orderBy("last", "user_id")) - 1) / 16).cast("long").alias("round"))


# ---- reports ----

CAUSES = {"click": "ComponentQueue", "view": "PendingEngine", "purchase": "Consensus", "signup": "AcksUnread"}


def _cause(column: str) -> Column:
    out = F.lit("None")
    for kind, cause in CAUSES.items():
        out = F.when(F.col(column) == kind, cause).otherwise(out)
    return out


def client_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24, 2.10j: submissions that had to wait, by what for, and the share of them met while intake stood still."""
    e = _events(spark, sf_dir).withColumn("cause", _cause("event_type"))
    paused = F.count_if(F.col("cents") > 5000)
    return e.groupBy("cause").agg(F.count("*").alias("waits"), paused.alias("while_paused"), F.round(paused / F.count("*"), 6).alias("share"))


def record_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records appended, those that died in the buffer, and where the reads of the others were answered, by month.

    A hold appends a record, each settlement that leaves a rest another one; the next one supersedes it and reads it.
    """
    tables.register(spark, sf_dir)
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("long")
    holds = spark.sql(HOLDS).select("hold_id", day("held_at").alias("day"), F.lit(0).alias("line"), F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("amount"))
    settles = spark.sql(tables.SETTLES).select("hold_id", day("settled_at").alias("day"), F.col("line"), F.col("part").cast("long"), "amount").join(spark.sql(HOLDS).select("hold_id"), "hold_id", "left_semi")
    w = Window.partitionBy("hold_id").orderBy("day", "line", "part", "amount")
    rows = holds.unionAll(settles).withColumn("age", F.lead("day").over(w) - F.col("day"))
    age = F.col("age")
    buffered = F.count_if(age <= FLUSH_DAYS)
    return rows.groupBy(F.floor(F.col("day") / 30).alias("month")).agg(
        F.count("*").alias("appended"), buffered.alias("died_in_buffer"), F.round(buffered / F.count("*"), 6).alias("died_share"),
        F.count_if((age > FLUSH_DAYS) & (age <= RESIDENT_DAYS)).alias("resident_reads"), F.count_if(age > RESIDENT_DAYS).alias("store_reads"), F.count_if(age.isNull()).alias("unread"),
    )


def run_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run passes if its latency target, the identities and all counters of faults hold; runs are users, here."""
    e = _events(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    runs = e.groupBy("user_id").agg(F.max("cents").alias("worst"), F.sum(F.when(F.col("n") % 2 == 1, 1).otherwise(-1)).alias("off"), F.count_if(F.col("event_type") == "signup").alias("gaps"), F.count_if(F.col("event_id") % 211 == 0).alias("overflowed"))
    code = F.when(F.col("worst") > 15_000, "latency").when(F.col("off") != 0, "identities").when(F.col("gaps") > 2, "gaps").when(F.col("overflowed") > 0, "overflow")
    return runs.select("user_id", code.isNull().alias("passed"), F.coalesce(code, F.lit("")).alias("broken"))


def run_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S20, 2.9k: one JSON line for each kind of request."""
    e = _events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("submitted"), F.sum("cents").cast("long").alias("cents"), F.max("cents").alias("worst"))
    return e.select("event_type", F.to_json(F.struct(F.col("event_type").alias("workload"), "submitted", F.struct("cents", "worst").alias("totals"))).alias("line"))


RING = 5


def log_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S22, 2.9j: the last few log lines of each user as text, and how many were dropped before them."""
    e = _events(spark, sf_dir)
    w = Window.partitionBy("user_id")
    rows = e.select("user_id", "event_id", "event_type", "cents", F.row_number().over(w.orderBy(F.desc("event_id"))).alias("back"), F.count("*").over(w).alias("n"))
    text = F.format_string("%s #%d: %d.%02d", F.upper("event_type"), "event_id", F.floor(F.col("cents") / 100), F.pmod("cents", F.lit(100)))
    return rows.filter(F.col("back") <= RING).select("user_id", "event_id", text.alias("line"), F.greatest(F.col("n") - RING, F.lit(0)).cast("long").alias("dropped"))


OPTIONS = [("accounts", "100k"), ("accounts", "1m"), ("accounts", "17"), ("share", "30%"), ("share", "0.3"), ("span", "5s"), ("span", "200us"), ("span", "3ms"), ("span", "7ns"), ("range", "1:250"), ("share", "x"), ("accounts", "1g"), ("range", "5")]
UNITS = {"k": 1_000, "m": 1_000_000, "b": 1_000_000_000, "ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000}


def parsed_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9i: counts with k, m and b, shares and per cents, times in ns to s, ranges; null for what is none of them."""
    rows = spark.createDataFrame(OPTIONS, "kind string, text string")
    number = lambda pattern, group=1: F.regexp_extract("text", pattern, group)
    unit = lambda pattern: F.element_at(F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv)), number(pattern, 2))
    count, span = r"^(\d+)([kmb]?)$", r"^(\d+)(ns|us|ms|s)$"
    amount = F.when((F.col("kind") == "accounts") & F.col("text").rlike(count), number(count).try_cast("long") * F.coalesce(F.when(number(count, 2) != "", F.try_element_at(F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv)), number(count, 2))), F.lit(1)))
    amount = amount.when((F.col("kind") == "span") & F.col("text").rlike(span), number(span).try_cast("long") * F.try_element_at(F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv)), number(span, 2)))
    amount = amount.when((F.col("kind") == "range") & F.col("text").rlike(r"^\d+:\d+$"), number(r"^(\d+):(\d+)$").try_cast("long"))
    share = F.when(F.col("text").rlike(r"^\d+(\.\d+)?%$"), number(r"^([\d.]+)%$").try_cast("double") / 100).when(F.col("text").rlike(r"^\d+(\.\d+)?$"), F.col("text").try_cast("double"))
    return rows.select("kind", "text", amount.cast("long").alias("number"), F.when((F.col("kind") == "range") & F.col("text").rlike(r"^\d+:\d+$"), number(r"^(\d+):(\d+)$", 2).try_cast("long")).alias("upper"), F.when(F.col("kind") == "share", F.round(share, 6)).alias("share"))


CONFIGS = [("default", 4096, 64, 4096, 64, 3, 64, 10_000), ("no intake", 0, 64, 4096, 64, 3, 64, 10_000), ("no legs", 4096, 64, 4096, 0, 3, 64, 10_000), ("tiny batch", 4096, 64, 4096, 64, 3, 64, 32), ("order", 4096, 64, 32, 64, 3, 64, 10_000), ("never stops", 4096, 64, 4096, 64, 0, 64, 10_000)]


def config_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first thing that is wrong with a configuration, or nothing."""
    c = spark.createDataFrame(CONFIGS, "config string, intake long, voids long, park long, legs long, stop_lanes long, batch_size long, batch_max long")
    zero = F.least("intake", "voids", "park", "legs", "stop_lanes", "batch_size") <= 0
    error = F.when(zero, "nothing may be 0").when(F.col("batch_size") > F.col("batch_max"), "a batch is full before it may be").when(F.col("legs") > F.col("batch_max"), "a chain fits no batch").when(F.col("voids") > F.col("park"), "a tick admits more than can be parked")
    return c.select("config", F.coalesce(error, F.lit("")).alias("error"))


def seed_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over runs (days, here), sums of what each reached, the worst wait, and whether all paths were reached."""
    e = _events(spark, sf_dir).groupBy(F.to_date("ts").alias("seed")).pivot("event_type", sorted(CAUSES)).agg(F.count(F.lit(1))).na.fill(0)
    worst = _events(spark, sf_dir).groupBy(F.to_date("ts").alias("seed")).agg(F.max("cents").alias("worst"))
    return e.join(worst, "seed").agg(*(F.sum(c).alias(f"{c}s") for c in sorted(CAUSES)), F.max("worst").alias("worst"), F.count_if(F.least(*sorted(CAUSES)) == 0).alias("runs_that_miss_a_path"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    judge_epoch_lanes, batches, stale_answers, judgeable, commit_order, quarantine, expiry_reoffers, lookups_needed, expiry_parking, intake_ticks, evictions,
    client_waits, record_traffic, run_verdicts, run_report_json, log_ring, parsed_options, config_checks, seed_coverage,
)}


_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CAUSES.items())
_EXPIRING = ledger.expiring_holds(DUCKDB)

ORACLE_SQL = {
    "judge_epoch_lanes": ledger.judge_epoch_lanes_sql(),
    "batches": f"""
      WITH RECURSIVE {_E}, c AS (SELECT c.*, us FROM ({ledger._chains(DUCKDB)}) c JOIN e USING (event_id)),
      u AS (SELECT user_id, CASE WHEN chain > 0 THEN -chain ELSE event_id + 1 END AS unit, count(*) AS legs, max(us) AS us, max(event_id) AS last FROM c GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last) AS i FROM u),
      f AS (
        SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(1 AS BIGINT) AS next, CAST(0 AS BIGINT) AS held, CAST(0 AS BIGINT) AS opened, CAST(0 AS BIGINT) AS batch FROM r
        UNION ALL
        SELECT user_id, i, mine + CASE WHEN total >= {BATCH_SIZE} THEN 1 ELSE 0 END, CASE WHEN total >= {BATCH_SIZE} THEN 0 ELSE total END, since, mine FROM (
          SELECT user_id, i, CASE WHEN cut THEN next2 + 1 ELSE next2 END AS mine, CASE WHEN cut THEN legs ELSE held2 + legs END AS total, CASE WHEN held2 = 0 THEN us ELSE opened END AS since FROM (
            SELECT *, held2 > 0 AND held2 + legs > {BATCH_MAX} AS cut FROM (
              SELECT r.*, f.opened, CASE WHEN f.held > 0 AND r.us - f.opened >= {LINGER} THEN f.next + 1 ELSE f.next END AS next2, CASE WHEN f.held > 0 AND r.us - f.opened >= {LINGER} THEN 0 ELSE f.held END AS held2
              FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1) a) b) c)
      SELECT user_id, CAST(unit AS BIGINT) AS unit, legs, batch FROM f JOIN r USING (user_id, i)""",
    "stale_answers": f"""WITH {_E}, s AS (SELECT a.event_id, a.user_id, a.us,
        (SELECT count(*) FROM e b WHERE b.user_id = a.user_id AND (b.us, b.event_id) < (a.us, a.event_id)) AS expected,
        (SELECT count(*) FROM e b WHERE b.user_id = a.user_id AND b.us + b.cents * 1000 + 1 <= a.us) AS applied FROM e a)
      SELECT event_id, user_id, expected, applied, applied < expected AS stale FROM s""",
    "judgeable": f"WITH {_E} SELECT event_id, CASE WHEN event_type <> 'purchase' THEN us + 500 WHEN event_id % 10 <> 3 THEN greatest(us + 500, us + cents) END AS ready_at, event_type <> 'purchase' OR event_id % 10 <> 3 AS judgeable FROM e",
    "commit_order": "WITH n AS (SELECT o_custkey % 100 AS node, count(*) AS proposed FROM orders GROUP BY 1) SELECT node, proposed, CASE WHEN proposed >= 50 THEN CAST(50 AS BIGINT) END AS sealed_at, CASE WHEN proposed >= 50 THEN 49 ELSE proposed END AS applied FROM n",
    "quarantine": f"""WITH s AS (SELECT o_orderkey, 1000 + o_custkey AS lane, o_orderdate AS tm, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq FROM orders),
      k AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY seq) AS i, seq - row_number() OVER (PARTITION BY lane ORDER BY seq) AS shift FROM s WHERE o_orderkey % 997 <> 0),
      b AS (SELECT lane, min((tm, o_orderkey)) AS broken FROM k WHERE shift > 0 GROUP BY lane), t AS (SELECT broken AS stopped FROM b ORDER BY broken LIMIT 1 OFFSET {STOP_LANES - 1})
      SELECT o_orderkey, lane, CASE WHEN (tm, o_orderkey) > (SELECT stopped FROM t) THEN 'FailStop' WHEN (tm, o_orderkey) > broken THEN 'AccountQuarantined' WHEN (tm, o_orderkey) = broken THEN 'SeqGap' ELSE '' END AS error FROM k LEFT JOIN b USING (lane)""",
    "expiry_reoffers": f"SELECT tx_id, pending_ref, amount FROM ({_EXPIRING}) x WHERE pending_ref % 5 = 0 AND pending_ref % 15 <> 0",
    "lookups_needed": f"SELECT hold_id, count(*) AS lookups, CAST(sum(amount) AS BIGINT) AS amount FROM ({tables.SETTLES}) s WHERE line > 1 AND NOT EXISTS (SELECT 1 FROM ({ledger._hold_fold(DUCKDB)}) h WHERE h.hold_id = s.hold_id AND h.remaining = 0) GROUP BY hold_id",
    "expiry_parking": f"SELECT tx_id, ledger, CASE WHEN n <= {PARK} THEN (n - 1) // {VOIDS_A_TICK} END AS tick, n > {PARK} AS declined FROM (SELECT *, row_number() OVER (PARTITION BY ledger ORDER BY expired_on, pending_ref) AS n FROM ({_EXPIRING}) x) y",
    "intake_ticks": f"SELECT event_type, (count(*) + {INTAKE - 1}) // {INTAKE} AS ticks, count(*) % {INTAKE} AS in_last FROM events GROUP BY event_type",
    "evictions": f"WITH {_E}, l AS (SELECT user_id, max(us) AS last FROM e GROUP BY user_id) SELECT user_id, (row_number() OVER (PARTITION BY user_id % 8 ORDER BY last, user_id) - 1) // 16 AS round FROM l WHERE (SELECT max(us) FROM e) - last > 21600000000",
    "client_waits": f"WITH {_E} SELECT CASE event_type {_CASES} ELSE 'None' END AS cause, count(*) AS waits, count(*) FILTER (cents > 5000) AS while_paused, round(count(*) FILTER (cents > 5000) / count(*)::DOUBLE, 6) AS share FROM e GROUP BY 1",
    "record_traffic": f"""WITH h AS ({HOLDS}), v AS (SELECT hold_id, {DUCKDB.day('held_at')} AS day, 0 AS line, 0 AS part, 0 AS amount FROM h UNION ALL SELECT hold_id, {DUCKDB.day('settled_at')}, line, part, amount FROM ({tables.SETTLES}) s WHERE hold_id IN (SELECT hold_id FROM h)),
      a AS (SELECT day // 30 AS month, lead(day) OVER (PARTITION BY hold_id ORDER BY day, line, part, amount) - day AS age FROM v)
      SELECT month, count(*) AS appended, coalesce(sum((age <= {FLUSH_DAYS})::INT), 0)::BIGINT AS died_in_buffer, round(coalesce(sum((age <= {FLUSH_DAYS})::INT), 0) / count(*)::DOUBLE, 6) AS died_share, coalesce(sum((age > {FLUSH_DAYS} AND age <= {RESIDENT_DAYS})::INT), 0)::BIGINT AS resident_reads,
        coalesce(sum((age > {RESIDENT_DAYS})::INT), 0)::BIGINT AS store_reads, count(*) - count(age) AS unread FROM a GROUP BY month""",
    "run_verdicts": f"""WITH {_E}, r AS (SELECT user_id, max(cents) AS worst, count(*) % 2 AS off, count(*) FILTER (event_type = 'signup') AS gaps, count(*) FILTER (event_id % 211 = 0) AS overflowed FROM e GROUP BY user_id),
      c AS (SELECT user_id, CASE WHEN worst > 15000 THEN 'latency' WHEN off <> 0 THEN 'identities' WHEN gaps > 2 THEN 'gaps' WHEN overflowed > 0 THEN 'overflow' ELSE '' END AS broken FROM r) SELECT user_id, broken = '' AS passed, broken FROM c""",
    "run_report_json": f"""WITH {_E} SELECT event_type, '{{"workload":"' || event_type || '","submitted":' || count(*) || ',"totals":{{"cents":' || CAST(sum(cents) AS BIGINT) || ',"worst":' || max(cents) || '}}}}' AS line FROM e GROUP BY event_type""",
    "log_ring": f"""WITH {_E}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e)
      SELECT user_id, event_id, upper(event_type) || ' #' || event_id || ': ' || cents // 100 || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS line, greatest(n - {RING}, 0) AS dropped FROM n WHERE i > n - {RING}""",
    "parsed_options": """SELECT * FROM (VALUES ('accounts', '100k', 100000::BIGINT, NULL::BIGINT, NULL::DOUBLE), ('accounts', '1m', 1000000, NULL, NULL), ('accounts', '17', 17, NULL, NULL), ('share', '30%', NULL, NULL, 0.3), ('share', '0.3', NULL, NULL, 0.3),
      ('span', '5s', 5000000000, NULL, NULL), ('span', '200us', 200000, NULL, NULL), ('span', '3ms', 3000000, NULL, NULL), ('span', '7ns', 7, NULL, NULL), ('range', '1:250', 1, 250, NULL), ('share', 'x', NULL, NULL, NULL), ('accounts', '1g', NULL, NULL, NULL), ('range', '5', NULL, NULL, NULL)) v(kind, text, number, upper, share)""",
    "config_checks": "SELECT * FROM (VALUES ('default', ''), ('no intake', 'nothing may be 0'), ('no legs', 'nothing may be 0'), ('tiny batch', 'a batch is full before it may be'), ('order', 'a tick admits more than can be parked'), ('never stops', 'nothing may be 0')) v(config, error)",
    "seed_coverage": f"""WITH {_E}, s AS (SELECT CAST(ts AS DATE) AS seed, {', '.join(f"count(*) FILTER (event_type = '{c}') AS {c}" for c in sorted(CAUSES))}, max(cents) AS worst FROM e GROUP BY 1)
      SELECT {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}s' for c in sorted(CAUSES))}, max(worst) AS worst, count(*) FILTER (least({', '.join(sorted(CAUSES))}) = 0) AS runs_that_miss_a_path FROM s""",
}
