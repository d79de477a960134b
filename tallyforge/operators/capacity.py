"""Capacity model: what a demand, a policy and a set of limits ask of each sized structure.

Inputs are relations: two curves given by knots, and a grid of configurations. A curve is read at a configuration's own
windows by a range join with its knots, so a sweep is the same query over a larger grid. All relations here are a handful
of rows (knots, parts, configurations); nothing is read from the tables.

The SQL that the results are held against reads the curves by nested conditions instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The published unit costs (name, owner, unit, bytes) and the example deployment.
PARTS = [
    ("work slots", "sequencer", "slot", 228),
    ("deferred dispatches", "sequencer", "slot", 4),
    ("lane state", "sequencer", "account", 32),
    ("open batch effects", "sequencer", "effect", 112),
    ("batches awaiting consensus", "sequencer", "batch", 40),
    ("spare batch buffers", "sequencer", "effect", 116),
    ("ack backlog", "sequencer", "entry", 80),
    ("queued pending writes", "sequencer", "effect", 80),
    ("account records", "accounts", "account", 48),
    ("account index", "accounts", "bucket", 17),
    ("idem keys", "idem", "bucket", 33),
    ("pending index", "pending engine", "slot", 8),
    ("pending budget groups", "pending engine", "bucket", 33),
    ("pending overlay", "pending engine", "bucket", 49),
    ("pending writeback buffer", "pending engine", "block", 4096),
    ("pending resident blocks", "pending engine", "block", 4096),
    ("pending stored blocks", "pending engine", "block", 4096),
    ("volume read cache", "pending engine", "block", 4096),
    ("volume write lane", "pending engine", "block", 4096),
    ("volume read pool", "pending engine", "block", 4096),
    ("pending record", "pending engine", "record", 68),
    ("kept log", "consensus", "effect", 112),
    ("proposals in flight", "consensus", "batch", 32),
]
LIFETIMES = [(1.0, 0.50), (4.0, 0.70), (24.0, 0.88), (168.0, 0.96)]
LOAD = [(1 / 60, 12e6), (1.0, 30e6), (4.0, 90e6), (24.0, 300e6)]
ACCOUNTS, HOLD_SHARE, RECORDS_PER_HOLD, COMMIT_SECONDS = 100_000_000, 0.90, 1.2, 0.010
BLOCK_BYTES, RECORD_BYTES, SNAPSHOT_EFFECTS, INDEX_BUDGET = 4096, 68, 1_000_000, 8 << 30
PER_BLOCK = BLOCK_BYTES // RECORD_BYTES
LIMITS = {"work_slots": 65_536, "client_queue": 65_536, "batch_max": 10_000, "batch_queued": 10_000, "raft_in_flight": 8, "engine_write_backlog": 16_384, "overlay_soft_limit": 1_048_576, "read_cache_blocks": 64, "write_lane_blocks": 0, "read_pool_blocks": 0}
RESIDENCY_HOURS = (1, 2, 4, 8, 24, 72, 168)
FLUSH_HOURS = (0.25, 1, 4, 12, 24)
DISK = "pending stored blocks"
CONFIG = "config string, retention_days int, grace_days int, flush_hours double, residency_hours double, idem_hours double"
EXAMPLE = [("example", 30, 1, 1.0, 24.0, 1.0)]


def up(x: Column) -> Column:
    """Up to a whole number; a hair over one, as doubles leave it, isn't the next."""
    return F.ceil(F.round(x, 6)).cast("long")


def next_power(x: Column) -> Column:
    return F.when(x <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(x - 1))))


def buckets_for(n: Column) -> Column:
    """2.9b: buckets of a hash map for n entries."""
    return F.when(n <= 0, 0).when(n <= 3, 4).when(n <= 7, 8).otherwise(next_power(F.floor(n * 8 / 7).cast("long"))).cast("long")


def index_slots_for(holds: Column) -> Column:
    """2.9c: slots of a table of buckets of four at a load of 0.90 at most; the number of buckets is a power of two."""
    return F.when(holds <= 0, 0).otherwise(4 * F.greatest(F.lit(2).cast("long"), next_power(up(up(holds / 0.9) / 4)))).cast("long")


def knots(spark: SparkSession, points: list[tuple[float, float]]) -> DataFrame:
    """Each stretch of a curve: (x0, y0, x1, y1). One window over a handful of rows."""
    w = Window.orderBy("x1")
    rows = spark.createDataFrame([(float(x), float(y)) for x, y in points], "x1 double, y1 double")
    return rows.select(F.lag("x1").over(w).alias("x0"), F.lag("y1").over(w).alias("y0"), "x1", "y1")


def _between(asked: DataFrame, at: str, stretches: DataFrame) -> DataFrame:
    """Range join of the asked places with the stretches that they fall into."""
    return asked.join(F.broadcast(stretches), (F.col(at) > F.col("x0")) & (F.col(at) <= F.col("x1")), "left")


def resolved_by(asked: DataFrame, at: str, name: str, points: list[tuple[float, float]] = LIFETIMES) -> DataFrame:
    """Adds the share of holds resolved ``at`` hours after they are made: linear from (0, 0) on, flat at the end."""
    found = _between(asked, at, knots(asked.sparkSession, [(0.0, 0.0), *points]).filter("x0 IS NOT NULL"))
    value = F.col("y0") + (F.col(at) - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))
    return found.select(*asked.columns, F.when(F.col(at) <= 0, 0.0).otherwise(F.coalesce(value, F.lit(points[-1][1]))).alias(name))


def busiest(asked: DataFrame, at: str, name: str, points: list[tuple[float, float]] = LOAD) -> DataFrame:
    """Adds what the busiest window of ``at`` hours carries: the first rate below the first knot, days repeat past the last."""
    found = _between(asked, at, knots(asked.sparkSession, points).filter("x0 IS NOT NULL"))
    value = F.col("y0") + (F.col(at) - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))
    (x, y), (x_end, y_end) = points[0], points[-1]
    rate = F.when(F.col(at) <= 0, 0.0).when(F.col(at) <= x, y * (F.col(at) / x)).when(F.col(at) > x_end, y_end * (F.col(at) / x_end))
    return found.select(*asked.columns, F.coalesce(rate, value).alias(name))


def mean_life(asked: DataFrame, cap: str, name: str, points: list[tuple[float, float]] = LIFETIMES) -> DataFrame:
    """Adds the area above the lifetime curve up to ``cap`` hours; a knot beyond counts as one at the cap."""
    stretches = knots(asked.sparkSession, [(0.0, 0.0), *points]).filter("x0 IS NOT NULL")
    both = asked.crossJoin(F.broadcast(stretches)).withColumn("x1", F.least("x1", cap))  # a handful of knots
    span = F.greatest(F.col("x1") - F.col("x0"), F.lit(0.0))
    inside = F.col("x0") < F.col(cap)
    area = both.groupBy(*asked.columns).agg(
        F.sum(F.when(inside, span * (2 - F.col("y0") - F.col("y1")) / 2).otherwise(0.0)).alias("area"),
        F.max(F.when(inside, F.col("x1"))).alias("end"),
        F.max(F.when(inside, F.col("y1"))).alias("share"),
    )
    return area.select(*asked.columns, (F.col("area") + F.greatest(F.col(cap) - F.col("end"), F.lit(0.0)) * (1 - F.col("share"))).alias(name))


def demands(configs: DataFrame) -> DataFrame:
    """What each configuration asks for before any structure is priced."""
    c = configs.withColumn("retention_hours", F.col("retention_days") * F.lit(24.0)).withColumn("day", F.lit(24.0))
    for at, name in (("flush_hours", "by_flush"), ("residency_hours", "by_residency"), ("retention_hours", "by_retention")):
        c = resolved_by(c, at, name)
    for at, name in (("flush_hours", "tx_flush"), ("residency_hours", "tx_residency"), ("idem_hours", "tx_idem"), ("day", "tx_day")):
        c = busiest(c, at, name)
    c = mean_life(c, "retention_hours", "life_hours")
    col = F.col
    (first_hours, first_tx) = LOAD[0]
    c = c.withColumn("holds_day", col("tx_day") * HOLD_SHARE).withColumn("written_share", 1 - col("by_flush"))
    c = c.withColumn("in_flight", up(F.lit(first_tx / (first_hours * 3600)) * COMMIT_SECONDS)).withColumn("live_holds", up(col("holds_day") / 24 * col("life_hours")))
    per_record = HOLD_SHARE * RECORDS_PER_HOLD
    c = c.withColumn("unwritten", up(col("tx_flush") * per_record)).withColumn("resident", up(col("tx_residency") * per_record * col("written_share")))
    c = c.withColumn("stored", up(col("tx_day") * per_record * col("written_share") * (col("retention_days") + col("grace_days"))))
    live = F.greatest(F.lit(0.0), col("live_holds") - col("tx_flush") * HOLD_SHARE)
    c = c.withColumn("dead_share", F.when(col("stored") > 0, F.greatest(F.lit(0.0), col("stored") - live) / col("stored")).otherwise(0.0))
    c = c.withColumn("resolution_reads", col("holds_day") / 86400 * F.greatest(F.lit(0.0), col("by_retention") - col("by_residency")))
    return c.withColumn("sweep_reads", up(col("holds_day") * (1 - col("by_retention")) * RECORDS_PER_HOLD / PER_BLOCK) / 86400)


def parts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PARTS, "name string, owner string, unit string, unit_bytes long")


#: Lines whose count is a limit that the node is configured with.
BY_LIMIT = {
    "deferred dispatches": LIMITS["work_slots"],
    "open batch effects": LIMITS["batch_queued"],
    "batches awaiting consensus": LIMITS["raft_in_flight"],
    "spare batch buffers": (LIMITS["raft_in_flight"] + 1) * LIMITS["batch_max"],
    "ack backlog": LIMITS["client_queue"],
    "queued pending writes": LIMITS["engine_write_backlog"],
    "volume read cache": LIMITS["read_cache_blocks"],
    "volume write lane": LIMITS["write_lane_blocks"],
    "volume read pool": LIMITS["read_pool_blocks"],
    "kept log": SNAPSHOT_EFFECTS,
    "proposals in flight": LIMITS["raft_in_flight"],
}


def sizing(configs: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    """The lines of the sizing report for each configuration. A line without a unit cost fails."""
    spark, col = configs.sparkSession, F.col
    costs = parts(spark) if costs is None else costs
    blocks = lambda c: up(col(c) / PER_BLOCK)
    derived = {
        "work slots": col("in_flight"),
        "lane state": F.lit(ACCOUNTS),
        "account records": F.lit(ACCOUNTS),
        "account index": buckets_for(F.lit(ACCOUNTS)),
        "idem keys": buckets_for(up(col("tx_idem"))),
        "pending index": index_slots_for(col("live_holds")),
        "pending budget groups": buckets_for(F.lit(0)),
        "pending writeback buffer": blocks("unwritten"),
        "pending resident blocks": blocks("resident"),
        DISK: blocks("stored"),
    }
    limits = {k: F.lit(v) for k, v in BY_LIMIT.items()} | {"pending overlay": buckets_for(F.lit(LIMITS["overlay_soft_limit"]))}
    lines = [F.struct(F.lit(n).alias("name"), c.cast("long").alias("count"), F.lit(k).alias("kind"), F.lit(LIMITS["work_slots"] if n == "work slots" else None).cast("long").alias("dial")) for k, x in (("derived", derived), ("dial", limits)) for n, c in x.items()]
    rows = demands(configs).select("config", F.explode(F.array(*lines)).alias("l")).select("config", "l.*")
    priced = rows.join(F.broadcast(costs), "name", "left")
    known = F.when(col("unit_bytes").isNull(), F.raise_error(F.concat(F.lit("no such sized part: "), col("name")))).otherwise(col("unit_bytes"))
    return priced.select("config", "name", "owner", "unit", known.cast("long").alias("unit_bytes"), "count", (col("count") * known).cast("long").alias("bytes"), "kind", "dial", F.coalesce(col("count") > col("dial"), F.lit(False)).alias("over_dial"))


def _configs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, CONFIG)


def sizing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizing report of the example deployment."""
    return sizing(_configs(spark, EXAMPLE))


def memory_by_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory of each component and of all, and what is disk, apart."""
    lines = sizing_lines(spark, sf_dir)
    return lines.withColumn("place", F.when(F.col("name") == DISK, "disk").otherwise("memory")).rollup("place", "owner").agg(F.sum("bytes").cast("long").alias("bytes")).filter("place IS NOT NULL").select("place", F.coalesce("owner", F.lit("all")).alias("owner"), "bytes")


def plan_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a grid of plans, lines over their limit and an index over its budget of bytes."""
    grid = _configs(spark, [(f"retention {d}", d, 1, 1.0, 24.0, 1.0) for d in (2, 7, 30, 90, 365)])
    lines = sizing(grid)
    return lines.filter((F.col("over_dial")) | (F.col("name") == "pending index") & (F.col("bytes") > INDEX_BUDGET // 4)).select("config", "name", "count", "bytes")


def demand_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the example deployment implies before any structure is priced."""
    return demands(_configs(spark, EXAMPLE)).select("config", F.round("life_hours", 6).alias("life_hours"), "live_holds", "in_flight", "unwritten", "resident", "stored", F.round("dead_share", 6).alias("dead_share"), F.round("resolution_reads", 6).alias("resolution_reads"), F.round("sweep_reads", 6).alias("sweep_reads"))


WINDOWS = (0.0, 0.01, 1 / 60, 0.5, 1.0, 2.0, 4.0, 10.0, 24.0, 36.0, 48.0)


def load_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions of the busiest window of a width, and their mean rate a second."""
    asked = busiest(spark.createDataFrame([(float(w),) for w in WINDOWS], "hours double"), "hours", "tx")
    return asked.select(F.round("hours", 6).alias("hours"), F.round("tx", 3).alias("tx"), F.when(F.col("hours") > 0, F.round(F.col("tx") / F.col("hours") / 3600, 3)).alias("rate"))


def curve_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: of several load curves, knots that carry less than a narrower window, or at a higher rate."""
    curves = {"example": LOAD, "falls": [(1.0, 30e6), (4.0, 20e6)], "speeds up": [(1.0, 30e6), (4.0, 130e6)], "no width": [(0.0, 1.0), (1.0, 2.0)]}
    rows = spark.createDataFrame([(c, float(x), float(y)) for c, p in curves.items() for x, y in p], "curve string, hours double, tx double")
    w = Window.partitionBy("curve").orderBy("hours")
    before = rows.withColumn("h0", F.lag("hours").over(w)).withColumn("t0", F.lag("tx").over(w))
    faster = F.try_divide("tx", "hours") > F.try_divide("t0", "h0") * 1.0000001
    return before.groupBy("curve").agg(F.count_if(F.col("hours") <= 0).alias("no_width"), F.count_if(F.col("tx") < F.col("t0")).alias("falls"), F.count_if(faster).alias("speeds_up"))


def residency_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a longer residency buys in reads and costs in blocks."""
    grid = _configs(spark, [(str(h), 30, 1, 1.0, float(h), 1.0) for h in RESIDENCY_HOURS])
    blocks = sizing(grid).filter("name = 'pending resident blocks'").select("config", F.col("count").alias("blocks"), F.col("bytes").alias("memory_bytes"))
    return demands(grid).join(F.broadcast(blocks), "config").select(F.col("residency_hours").alias("hours"), F.round("by_residency", 6).alias("hit_share"), "blocks", "memory_bytes", F.round("resolution_reads", 6).alias("reads"))


def flush_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a wider flush window keeps off the disk and costs in memory."""
    grid = _configs(spark, [(str(h), 30, 1, float(h), 24.0, 1.0) for h in FLUSH_HOURS])
    lines = sizing(grid).groupBy("config").agg(F.sum(F.when(F.col("name") == "pending writeback buffer", F.col("bytes"))).alias("buffer_bytes"), F.sum(F.when(F.col("name") == DISK, F.col("bytes"))).alias("disk_bytes"), F.sum(F.when(F.col("name") != DISK, F.col("bytes"))).alias("memory_bytes"))
    return demands(grid).join(F.broadcast(lines), "config").select(F.col("flush_hours").alias("hours"), F.round("written_share", 6).alias("written_share"), "buffer_bytes", "disk_bytes", "memory_bytes", F.round("dead_share", 6).alias("dead_share"))


CAPACITIES = [("default", 1_000_000, 0.5, 2, 1, 0.5, 1, 24), ("month", 150_000_000, 0.12, 30, 1, 0.5, 1, 24), ("tiny", 100, 1.0, 1, 0, 1.0, 1, 1)]


def declared_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes that follow from what a node is declared to hold."""
    rows = spark.createDataFrame(CAPACITIES, "plan string, arrivals long, survivors double, retention long, grace long, after_flush double, flush_hours long, residency_hours long")
    col, life = F.col, F.col("retention") + F.col("grace")
    hourly = F.floor(col("arrivals") / 24).cast("long")
    most = F.floor(col("arrivals") * col("survivors")).cast("long") * life
    blocks = lambda x: F.greatest(F.lit(1).cast("long"), F.ceil(x / PER_BLOCK).cast("long"))
    return rows.select("plan", most.alias("maximum"), F.ceil(most / 0.9).cast("long").alias("slots"), blocks(hourly * col("flush_hours")).alias("flush_blocks"), blocks(F.floor(hourly * col("residency_hours") * col("after_flush"))).alias("resident_blocks"), (life + 1).alias("live_segments"))


#: What a later publication of the unit costs could be: one part is larger, one is gone, one is new.
LATER = [(n, o, u, b + 4 * (n == "pending record")) for n, o, u, b in PARTS if n != "volume read pool"] + [("volume audit ring", "pending engine", "entry", 24)]


def parts_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: parts that are new, gone or changed between two publications."""
    was, now = parts(spark), spark.createDataFrame(LATER, "name string, owner string, unit string, unit_bytes long")
    both = was.alias("w").join(now.alias("n"), "name", "full_outer")
    change = F.when(F.col("w.unit_bytes").isNull(), "new").when(F.col("n.unit_bytes").isNull(), "gone").when(F.col("w.unit_bytes") != F.col("n.unit_bytes"), "changed")
    return both.select("name", change.alias("change"), F.col("w.unit_bytes").alias("was"), F.col("n.unit_bytes").alias("now")).filter("change IS NOT NULL")


def unpriced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the report that a publication has no unit cost for; the later one lacks one."""
    now = spark.createDataFrame(LATER, "name string, owner string, unit string, unit_bytes long")
    return sizing_lines(spark, sf_dir).select("name").join(F.broadcast(now), "name", "left_anti")


def footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per ledger, bytes of its accounts' and holds' tables, how full they are, and an alarm from 0.8."""
    customers, orders = spark.read.parquet(f"{sf_dir}/customer.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet")
    ledger = (F.col("c_nationkey").cast("long") + 1).alias("ledger")
    held = orders.filter("o_orderstatus <> 'F'").groupBy("o_custkey").agg(F.count("*").alias("holds"))
    used = customers.join(held, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(ledger).agg(F.count("*").alias("accounts"), F.coalesce(F.sum("holds"), F.lit(0)).cast("long").alias("holds"))
    part = lambda name, entries, capacity, unit: F.struct(F.lit(name).alias("part"), entries.alias("entries"), capacity.alias("capacity"), F.lit(unit).cast("long").alias("unit_bytes"))
    a, h = F.col("accounts"), F.col("holds")
    rows = used.select("ledger", F.explode(F.array(part("account records", a, a, 48), part("account index", a, buckets_for(a), 17), part("pending index", h, index_slots_for(h), 8))).alias("p")).select("ledger", "p.*")
    fill = F.when(F.col("capacity") > 0, F.col("entries") / F.col("capacity")).otherwise(0.0)
    return rows.select("ledger", "part", "entries", "capacity", (F.col("capacity") * F.col("unit_bytes")).alias("bytes"), F.round(fill, 6).alias("fill"), ((fill >= 0.8) & (F.col("part") != "account records")).alias("alarm"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    sizing_lines, memory_by_owner, plan_breaches, demand_report, load_curve, curve_faults, residency_curve, flush_curve, declared_capacity, parts_changes, unpriced_lines, footprint,
)}


# ---- the same in SQL ----


def _steps(points: list[tuple[float, float]], at: str, before: str, after: str) -> str:
    out = [before]
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out.append(f"WHEN {at} <= {x1!r}::DOUBLE THEN {y0!r}::DOUBLE + ({at} - {x0!r}::DOUBLE) * ({y1!r}::DOUBLE - {y0!r}::DOUBLE) / ({x1!r}::DOUBLE - {x0!r}::DOUBLE)")
    return f"(CASE {' '.join(out)} ELSE {after} END)"


def _resolved(at: str) -> str:
    return _steps([(0.0, 0.0), *LIFETIMES], at, f"WHEN {at} <= 0 THEN 0.0::DOUBLE", f"{LIFETIMES[-1][1]}::DOUBLE")


def _busiest(at: str) -> str:
    (x, y), (xe, ye) = LOAD[0], LOAD[-1]
    return _steps(LOAD, at, f"WHEN {at} <= 0 THEN 0.0::DOUBLE WHEN {at} <= {x!r}::DOUBLE THEN {y!r}::DOUBLE * ({at} / {x!r}::DOUBLE)", f"{ye!r}::DOUBLE * ({at} / {xe!r}::DOUBLE)")


def _up(x: str) -> str:
    return f"CAST(ceil(round({x}, 6)) AS BIGINT)"


def _power(x: str) -> str:
    return f"(CASE WHEN {x} <= 1 THEN 1 ELSE CAST(1 AS BIGINT) << CAST(length(bin({x} - 1)) AS INTEGER) END)"


def _buckets(n: str) -> str:
    return f"CAST(CASE WHEN {n} <= 0 THEN 0 WHEN {n} <= 3 THEN 4 WHEN {n} <= 7 THEN 8 ELSE {_power(f'({n} * 8 // 7)')} END AS BIGINT)"


def _slots(n: str) -> str:
    quarter = _up(f"{_up(f'{n} / 0.9')} / 4.0")
    return f"CAST(CASE WHEN {n} <= 0 THEN 0 ELSE 4 * greatest(2, {_power(quarter)}) END AS BIGINT)"


def _life() -> str:
    """Areas below each stretch, cut at the retention."""
    out = []
    for (x0, y0), (x1, y1) in zip([(0.0, 0.0), *LIFETIMES], LIFETIMES):
        out.append(f"CASE WHEN rh > {x0} THEN (least(rh, {x1}::DOUBLE) - {x0}) * (2 - {y0}::DOUBLE - {y1}::DOUBLE) / 2 ELSE 0 END")
    return f"({' + '.join(out)} + greatest(rh - {LIFETIMES[-1][0]}, 0) * (1 - {LIFETIMES[-1][1]}::DOUBLE))"


def _demands(rows: list[tuple]) -> str:
    values = ", ".join(f"('{c}', {r}, {g}, {f}::DOUBLE, {s}::DOUBLE, {i}::DOUBLE)" for c, r, g, f, s, i in rows)
    per = f"{HOLD_SHARE * RECORDS_PER_HOLD!r}::DOUBLE"
    peak = LOAD[0][1] / (LOAD[0][0] * 3600)
    return f"""
    c AS (SELECT *, rd * 24.0::DOUBLE AS rh FROM (VALUES {values}) v(config, rd, gd, fh, sh, ih)),
    r AS (SELECT *, {_resolved('fh')} AS by_flush, {_resolved('sh')} AS by_residency, {_resolved('rh')} AS by_retention, {_busiest('fh')} AS tx_flush, {_busiest('sh')} AS tx_residency, {_busiest('ih')} AS tx_idem, {_busiest('24.0::DOUBLE')} AS tx_day, {_life()} AS life_hours FROM c),
    d AS (SELECT *, tx_day * {HOLD_SHARE}::DOUBLE AS holds_day, 1 - by_flush AS written_share, {_up(f'{peak!r}::DOUBLE * {COMMIT_SECONDS}::DOUBLE')} AS in_flight FROM r),
    e AS (SELECT *, {_up('holds_day / 24 * life_hours')} AS live_holds, {_up(f'tx_flush * {per}')} AS unwritten, {_up(f'tx_residency * {per} * written_share')} AS resident, {_up(f'tx_day * {per} * written_share * (rd + gd)')} AS stored,
      holds_day / 86400 * greatest(0, by_retention - by_residency) AS resolution_reads, {_up(f'holds_day * (1 - by_retention) * {RECORDS_PER_HOLD}::DOUBLE / {PER_BLOCK}')} / 86400.0::DOUBLE AS sweep_reads FROM d),
    demands AS (SELECT *, CASE WHEN stored > 0 THEN greatest(0, stored - greatest(0, live_holds - tx_flush * {HOLD_SHARE}::DOUBLE)) / stored::DOUBLE ELSE 0 END AS dead_share FROM e)"""


def _parts(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join(f"('{n}', '{o}', '{u}', {b}::BIGINT)" for n, o, u, b in rows) + ") p(name, owner, unit, unit_bytes)"


def _lines(rows: list[tuple]) -> str:
    derived = {
        "work slots": "in_flight", "lane state": str(ACCOUNTS), "account records": str(ACCOUNTS), "account index": _buckets(str(ACCOUNTS)), "idem keys": _buckets(_up("tx_idem")), "pending index": _slots("live_holds"),
        "pending budget groups": "0", "pending writeback buffer": _up(f"unwritten / {PER_BLOCK}.0"), "pending resident blocks": _up(f"resident / {PER_BLOCK}.0"), DISK: _up(f"stored / {PER_BLOCK}.0"),
    }
    limits = {k: str(v) for k, v in BY_LIMIT.items()} | {"pending overlay": _buckets(str(LIMITS["overlay_soft_limit"]))}
    one = [f"SELECT config, '{n}' AS name, CAST({c} AS BIGINT) AS count, '{k}' AS kind FROM demands" for k, x in (("derived", derived), ("dial", limits)) for n, c in x.items()]
    return f"""{_demands(rows)}, counted AS ({' UNION ALL '.join(one)}),
    lines AS (SELECT config, name, owner, unit, unit_bytes, count, CAST(count * unit_bytes AS BIGINT) AS bytes, kind, CASE WHEN name = 'work slots' THEN CAST({LIMITS['work_slots']} AS BIGINT) END AS dial,
      name = 'work slots' AND count > {LIMITS['work_slots']} AS over_dial FROM counted JOIN {_parts(PARTS)} USING (name))"""


def _oracles() -> dict[str, str]:
    grid = [(f"retention {d}", d, 1, 1.0, 24.0, 1.0) for d in (2, 7, 30, 90, 365)]
    residency = [(str(h), 30, 1, 1.0, float(h), 1.0) for h in RESIDENCY_HOURS]
    flush = [(str(h), 30, 1, float(h), 24.0, 1.0) for h in FLUSH_HOURS]
    windows = ", ".join(f"({w!r}::DOUBLE)" for w in WINDOWS)
    capacities = ", ".join(map(str, CAPACITIES))
    differ = f"WITH w AS (SELECT * FROM {_parts(PARTS)}), n AS (SELECT * FROM {_parts(LATER)})"
    return {
        "sizing_lines": f"WITH {_lines(EXAMPLE)} SELECT * FROM lines",
        "memory_by_owner": f"WITH {_lines(EXAMPLE)}, m AS (SELECT CASE WHEN name = '{DISK}' THEN 'disk' ELSE 'memory' END AS place, owner, bytes FROM lines) SELECT place, owner, CAST(sum(bytes) AS BIGINT) AS bytes FROM m GROUP BY ALL UNION ALL SELECT place, 'all', CAST(sum(bytes) AS BIGINT) FROM m GROUP BY place",
        "plan_breaches": f"WITH {_lines(grid)} SELECT config, name, count, bytes FROM lines WHERE over_dial OR name = 'pending index' AND bytes > {INDEX_BUDGET // 4}",
        "demand_report": f"WITH {_demands(EXAMPLE)} SELECT config, round(life_hours, 6) AS life_hours, live_holds, in_flight, unwritten, resident, stored, round(dead_share, 6) AS dead_share, round(resolution_reads, 6) AS resolution_reads, round(sweep_reads, 6) AS sweep_reads FROM demands",
        "load_curve": f"SELECT round(h, 6) AS hours, round(tx, 3) AS tx, CASE WHEN h > 0 THEN round(tx / h / 3600, 3) END AS rate FROM (SELECT h, {_busiest('h')} AS tx FROM (VALUES {windows}) v(h))",
        "curve_faults": "SELECT * FROM (VALUES ('example', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)), ('falls', 0, 1, 0), ('speeds up', 0, 0, 1), ('no width', 1, 0, 0)) v(curve, no_width, falls, speeds_up)",
        "residency_curve": f"WITH {_lines(residency)} SELECT sh AS hours, round(by_residency, 6) AS hit_share, count AS blocks, bytes AS memory_bytes, round(resolution_reads, 6) AS reads FROM demands JOIN lines USING (config) WHERE name = 'pending resident blocks'",
        "flush_curve": f"WITH {_lines(flush)}, s AS (SELECT config, CAST(sum(bytes) FILTER (name = 'pending writeback buffer') AS BIGINT) AS buffer_bytes, CAST(sum(bytes) FILTER (name = '{DISK}') AS BIGINT) AS disk_bytes, CAST(sum(bytes) FILTER (name <> '{DISK}') AS BIGINT) AS memory_bytes FROM lines GROUP BY config) SELECT fh AS hours, round(written_share, 6) AS written_share, buffer_bytes, disk_bytes, memory_bytes, round(dead_share, 6) AS dead_share FROM demands JOIN s USING (config)",
        "declared_capacity": f"""WITH c AS (SELECT * FROM (VALUES {capacities}) v(plan, arrivals, survivors, retention, grace, after_flush, flush_hours, residency_hours)),
          m AS (SELECT *, CAST(floor(arrivals * survivors::DOUBLE) AS BIGINT) * (retention + grace) AS maximum, arrivals // 24 AS hourly FROM c)
          SELECT plan, maximum, CAST(ceil(maximum / 0.9::DOUBLE) AS BIGINT) AS slots, greatest(1, CAST((hourly * flush_hours + {PER_BLOCK - 1}) // {PER_BLOCK} AS BIGINT)) AS flush_blocks,
          greatest(1, CAST((CAST(floor(hourly * residency_hours * after_flush::DOUBLE) AS BIGINT) + {PER_BLOCK - 1}) // {PER_BLOCK} AS BIGINT)) AS resident_blocks, CAST(retention + grace + 1 AS BIGINT) AS live_segments FROM m""",
        "parts_changes": f"{differ} SELECT n.name, 'new' AS change, NULL::BIGINT AS was, n.unit_bytes AS now FROM n WHERE name NOT IN (SELECT name FROM w) UNION ALL SELECT name, 'gone', unit_bytes, NULL FROM w WHERE name NOT IN (SELECT name FROM n) UNION ALL SELECT w.name, 'changed', w.unit_bytes, n.unit_bytes FROM w JOIN n ON w.name = n.name AND w.unit_bytes <> n.unit_bytes",
        "unpriced_lines": f"WITH {_lines(EXAMPLE)} SELECT name FROM lines WHERE name NOT IN (SELECT name FROM {_parts(LATER)})",
        "footprint": f"""WITH u AS (SELECT CAST(c_nationkey AS BIGINT) + 1 AS ledger, count(DISTINCT c_custkey) AS accounts, count(o_orderkey) AS holds FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'F') o ON o_custkey = c_custkey GROUP BY 1),
          p AS (SELECT ledger, 'account records' AS part, accounts AS entries, accounts AS capacity, 48 AS unit FROM u UNION ALL SELECT ledger, 'account index', accounts, {_buckets('accounts')}, 17 FROM u UNION ALL SELECT ledger, 'pending index', holds, {_slots('holds')}, 8 FROM u)
          SELECT ledger, part, entries, capacity, capacity * unit AS bytes, round(CASE WHEN capacity > 0 THEN entries / capacity::DOUBLE ELSE 0 END, 6) AS fill, part <> 'account records' AND capacity > 0 AND entries / capacity::DOUBLE >= 0.8 AS alarm FROM p""",
    }


ORACLE_SQL = _oracles()
