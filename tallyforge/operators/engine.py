"""Views of the engine's own work: overlays, survivors, load of the index, the device, and figures of a run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.operators import capacity, ledger
from tallyforge.operators.flow import _E, _events
from tallyforge.plans import judge
from tallyforge.plans.recovery import folder
from tallyforge.sources import tables, units
from tallyforge.sources.tables import DUCKDB, HOLDS, SPARK

INDEX_SLOTS, SERVICE_US, TAIL_US = 4096, 30_000_000, 300_000_000


def _holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark, sf_dir)
    return spark.sql(ledger._hold_fold(SPARK))


def overlay_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a hold has left as the judge sees it: the record, less what decisions that aren't applied yet take of it.

    In flight are the last settlements of holds by line; ``reserved`` over all is the overlay's total, 0 once all is applied.
    """
    records = _holds(spark, sf_dir).select("hold_id", F.col("remaining").alias("recorded"))
    last = spark.sql(tables.SETTLES).groupBy("hold_id").agg(F.max_by("amount", F.struct("line", "part", "amount")).alias("taken"), F.max("line").alias("lines")).filter("lines % 2 = 1")
    seen = records.join(last, "hold_id", "left")
    taken = F.least(F.coalesce("taken", F.lit(0)), F.col("recorded"))
    return seen.select("hold_id", "recorded", taken.alias("reserved"), (F.col("recorded") - taken).alias("remaining"))


def survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A buffer's records that the index still points at are carried on, the others are dropped."""
    latest = _holds(spark, sf_dir).filter("remaining > 0 AND status <> 'F'").select("hold_id", F.col("accepted").alias("version"))
    version = F.row_number().over(Window.partitionBy("hold_id").orderBy("settled_at", "line", "part", "amount"))
    written = spark.sql(HOLDS).select("hold_id", F.lit(0).cast("long").alias("version")).unionAll(spark.sql(tables.SETTLES).select("hold_id", version.cast("long")))
    on = ["hold_id", "version"]
    kept, gone = written.join(latest, on, "left_semi"), written.join(latest, on, "left_anti")
    return kept.select("hold_id", "version", F.lit(True).alias("carried")).unionAll(gone.select("hold_id", "version", F.lit(False)))


def segment_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live entries of each day segment and of all, and the share of the index that they take."""
    live = _holds(spark, sf_dir).filter("remaining > 0 AND status <> 'F'")
    segment = F.pmod(F.unix_date(F.col("held_at").cast("date")).cast("long"), F.lit(ledger.SEGMENTS))
    rows = live.rollup(segment.alias("segment")).agg(F.count("*").alias("live"))
    return rows.select(F.coalesce("segment", F.lit(-1)).alias("segment"), "live", F.round(F.col("live") / INDEX_SLOTS, 6).alias("load"))


def index_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9c, A14: per ledger, slots that its live holds need at the load target, and how full they then are."""
    live = _holds(spark, sf_dir).filter("remaining > 0 AND status <> 'F'").groupBy("ledger").agg(F.count("*").alias("live"))
    return live.withColumn("slots", capacity.index_slots_for(F.col("live"))).withColumn("load", F.round(F.col("live") / F.col("slots"), 6))


def device_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A device for each user that serves one read at a time; one in 16 is slow, one in 64 fails, one in 128 comes damaged."""
    e = _events(spark, sf_dir)
    service = F.when(F.col("event_id") % 16 == 0, TAIL_US).otherwise(SERVICE_US).cast("long")
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    rows = e.withColumn("service", service).withColumn("before", F.coalesce(F.sum("service").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # free when all before is served: the largest arrival less what was served before it, plus all that was
    begins = F.max(F.col("us") - F.col("before")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("before")
    fault = F.when(F.col("event_id") % 64 == 0, "refused").when(F.col("event_id") % 128 == 1, "damaged").otherwise("")
    return rows.select("event_id", "user_id", begins.alias("begins"), (begins + F.col("service")).alias("done"), fault.alias("fault"))


def volume_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads, bytes, faults, longest wait and largest queue of each volume (users by eight), and of all together."""
    q = device_queue(spark, sf_dir).join(_events(spark, sf_dir).select("event_id", "us"), "event_id").withColumn("volume", F.pmod(F.col("user_id"), F.lit(8)))
    marks = q.select("user_id", F.explode(F.array(F.struct(F.col("us").alias("at"), F.lit(1).alias("step")), F.struct(F.col("done").alias("at"), F.lit(-1).alias("step")))).alias("m")).select("user_id", "m.*")
    depth = marks.groupBy("user_id", "at").agg(F.sum("step").alias("step")).withColumn("depth", F.sum("step").over(Window.partitionBy("user_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    peaks = depth.groupBy(F.pmod(F.col("user_id"), F.lit(8)).alias("volume")).agg(F.greatest(F.max("depth"), F.lit(0)).alias("deepest"))
    one = q.groupBy("volume").agg(F.count("*").alias("reads"), F.count_if(F.col("fault") == "refused").alias("refused"), F.count_if(F.col("fault") == "damaged").alias("damaged"), F.max(F.col("begins") - F.col("us")).alias("longest_wait")).join(peaks, "volume")
    merged = one.groupBy().agg(F.lit(-1).cast("long").alias("volume"), *(F.sum(c).alias(c) for c in ("reads", "refused", "damaged")), F.max("longest_wait").alias("longest_wait"), F.max("deepest").alias("deepest"))
    return one.unionByName(merged).withColumn("bytes", F.col("reads") * 4096)


def cold_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of one block that are asked for while it is on its way share one read; per user's block of ten events."""
    e = _events(spark, sf_dir).withColumn("block", F.floor(F.col("event_id") / 10))
    w = Window.partitionBy("block").orderBy("us", "event_id")
    opens = e.withColumn("late", F.coalesce(F.col("us") - F.lag("us").over(w) > TAIL_US, F.lit(True)))
    return opens.groupBy("block").agg(F.count("*").alias("asked"), F.count_if("late").alias("reads"), F.round(1 - F.count_if("late") / F.count("*"), 6).alias("shared"))


def run_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day: requests a second, mean wait for a commit, effects a batch, busy share, core use and nanoseconds a request."""
    e = _events(spark, sf_dir).groupBy(F.floor(F.col("us") / 86_400_000_000).alias("day")).agg(F.count("*").alias("n"), F.sum("cents").alias("spent"), F.count_if(F.col("cents") > 2500).alias("busy"), F.count_distinct("user_id").alias("batches"))
    n = F.col("n")
    return e.select("day", F.round(n / 86400, 9).alias("a_second"), F.round(F.col("spent") / F.col("batches") / 1000, 6).alias("commit_wait"), F.round(n / F.col("batches"), 6).alias("effects_a_batch"), F.round(F.col("busy") / n, 6).alias("busy_share"), F.round(F.col("spent") / 86_400_000_000, 9).alias("core_use"), F.round(F.col("spent") * 1000 / n, 3).alias("nanos_a_request"))


def lane_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each lane (users by eight, slow answers), most answers waiting at once behind an earlier one."""
    e = _events(spark, sf_dir).withColumn("lane", F.pmod(F.col("user_id"), F.lit(8)))
    r = e.select("lane", F.col("event_id").alias("seq"), (F.col("us") + F.col("cents") * 1_000_000).alias("ready_at")).withColumn("released", F.max("ready_at").over(Window.partitionBy("lane").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    waits = r.filter("released > ready_at")
    marks = waits.select("lane", F.explode(F.array(F.struct(F.col("ready_at").alias("at"), F.lit(1).alias("step")), F.struct(F.col("released").alias("at"), F.lit(-1).alias("step")))).alias("m")).select("lane", "m.*")
    depth = marks.groupBy("lane", "at").agg(F.sum("step").alias("step")).withColumn("depth", F.sum("step").over(Window.partitionBy("lane").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return depth.groupBy("lane").agg(F.max("depth").alias("deepest"))


def bounded_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9a, F13: sums that don't fit are no sums; differences stop at 0; quotients go up; values stay between bounds."""
    top = (1 << 63) - 1
    rows = spark.sql("SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM parquet.`" + f"{sf_dir}/orders.parquet`")
    v, key = F.col("v"), F.col("o_orderkey")
    near_top = F.lit(top) - key * 10_000
    return rows.select("o_orderkey", F.try_add(near_top, v).alias("sum"), F.greatest(key * 100 - v, F.lit(0)).alias("less"), F.ceil(v / 4096).cast("long").alias("blocks"), F.least(F.greatest(v, F.lit(1_000_000)), F.lit(20_000_000)).alias("held"))


def published_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit costs through their document, with how many of a part fit a block."""
    path = folder(spark, "units")
    units.publish(spark, capacity.PARTS, path)
    return units.load(spark, path).withColumn("a_block", F.floor(F.col("block_bytes") / F.col("unit_bytes")).cast("long"))


def request_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For all flags and both kinds of ids, the kind of a request, whether it looks a hold up, and whether a client may send it."""
    rows = spark.range(16).select(F.col("id").cast("int").alias("flags"), F.explode(F.array(F.lit(7).cast("long"), F.lit(-7).cast("long"))).alias("tx_id"))
    kind = judge.kind(F.col("flags"), F.col("tx_id"))
    return rows.select("flags", "tx_id", kind.alias("kind"), judge.needs_pending_lookup(kind).alias("looks_up"), judge.is_client(kind).alias("client"), (F.col("flags").bitwiseAND(8) != 0).alias("linked"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (overlay_view, survivors, segment_load, index_occupancy, device_queue, volume_counters, cold_reads, run_figures, lane_depths, bounded_arithmetic, published_units, request_kinds)}

_FOLD = ledger._hold_fold(DUCKDB)
_SERVER = f"""{_E}, o AS (SELECT *, CASE WHEN event_id % 16 = 0 THEN {TAIL_US} ELSE {SERVICE_US} END AS service, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM e),
  f AS (SELECT event_id, user_id, us, service, i, us AS begins, us + service AS done FROM o WHERE i = 1
    UNION ALL SELECT o.event_id, o.user_id, o.us, o.service, o.i, greatest(o.us, f.done), greatest(o.us, f.done) + o.service FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1),
  q AS (SELECT *, CASE WHEN event_id % 64 = 0 THEN 'refused' WHEN event_id % 128 = 1 THEN 'damaged' ELSE '' END AS fault FROM f)"""

ORACLE_SQL = {
    "overlay_view": f"""WITH s AS ({tables.SETTLES}), l AS (SELECT hold_id, arg_max(amount, (line, part, amount)) AS taken, max(line) AS lines FROM s GROUP BY hold_id)
      SELECT h.hold_id, h.remaining AS recorded, least(coalesce(taken, 0), h.remaining) AS reserved, h.remaining - least(coalesce(taken, 0), h.remaining) AS remaining FROM ({_FOLD}) h LEFT JOIN (SELECT * FROM l WHERE lines % 2 = 1) t USING (hold_id)""",
    "survivors": f"""WITH s AS ({tables.SETTLES}), h AS ({HOLDS}), f AS MATERIALIZED ({_FOLD}), w AS (SELECT hold_id, CAST(0 AS BIGINT) AS version FROM h UNION ALL SELECT hold_id, row_number() OVER (PARTITION BY hold_id ORDER BY settled_at, line, part, amount) FROM s)
      SELECT w.hold_id, w.version, coalesce(f.remaining > 0 AND f.status <> 'F' AND f.accepted = w.version, false) AS carried FROM w LEFT JOIN f USING (hold_id)""",
    "segment_load": f"WITH l AS MATERIALIZED (SELECT {DUCKDB.day('held_at')} % {ledger.SEGMENTS} AS segment FROM ({_FOLD}) f WHERE remaining > 0 AND status <> 'F') SELECT segment, count(*) AS live, round(count(*) / {INDEX_SLOTS}.0::DOUBLE, 6) AS load FROM l GROUP BY segment UNION ALL SELECT -1, count(*), round(count(*) / {INDEX_SLOTS}.0::DOUBLE, 6) FROM l",
    "index_occupancy": f"WITH l AS (SELECT ledger, count(*) AS live FROM ({_FOLD}) f WHERE remaining > 0 AND status <> 'F' GROUP BY ledger), s AS (SELECT *, {capacity._slots('live')} AS slots FROM l) SELECT ledger, live, slots, round(live / slots::DOUBLE, 6) AS load FROM s",
    "device_queue": f"WITH RECURSIVE {_SERVER} SELECT event_id, user_id, begins, done, fault FROM q",
    "volume_counters": f"""WITH RECURSIVE {_SERVER}, d AS (SELECT a.user_id, a.us, (SELECT count(*) FROM q b WHERE b.user_id = a.user_id AND b.us <= a.us AND b.done > a.us) AS depth FROM q a),
      v AS (SELECT user_id % 8 AS volume, count(*) AS reads, count(*) FILTER (fault = 'refused') AS refused, count(*) FILTER (fault = 'damaged') AS damaged, max(begins - us) AS longest_wait FROM q GROUP BY 1),
      p AS (SELECT user_id % 8 AS volume, max(depth) AS deepest FROM d GROUP BY 1), j AS (SELECT * FROM v JOIN p USING (volume))
      SELECT volume, reads, refused, damaged, longest_wait, deepest, reads * 4096 AS bytes FROM j UNION ALL SELECT -1, CAST(sum(reads) AS BIGINT), CAST(sum(refused) AS BIGINT), CAST(sum(damaged) AS BIGINT), max(longest_wait), max(deepest), CAST(sum(reads) * 4096 AS BIGINT) FROM j""",
    "cold_reads": f"WITH {_E}, g AS (SELECT event_id // 10 AS block, CASE WHEN us - lag(us) OVER (PARTITION BY event_id // 10 ORDER BY us, event_id) <= {TAIL_US} THEN 0 ELSE 1 END AS opens FROM e) SELECT block, count(*) AS asked, CAST(sum(opens) AS BIGINT) AS reads, round(1 - sum(opens) / count(*)::DOUBLE, 6) AS shared FROM g GROUP BY block",
    "run_figures": f"""WITH {_E}, d AS (SELECT us // 86400000000 AS day, count(*)::DOUBLE AS n, sum(cents)::DOUBLE AS spent, count(*) FILTER (cents > 2500) AS busy, count(DISTINCT user_id) AS batches FROM e GROUP BY 1)
      SELECT day, round(n / 86400, 9) AS a_second, round(spent / batches / 1000, 6) AS commit_wait, round(n / batches, 6) AS effects_a_batch, round(busy / n, 6) AS busy_share, round(spent / 86400000000, 9) AS core_use, round(spent * 1000 / n, 3) AS nanos_a_request FROM d""",
    "lane_depths": f"""WITH {_E}, x AS (SELECT user_id % 8 AS lane, event_id AS seq, us + cents * 1000000 AS ready_at FROM e), r AS (SELECT *, max(ready_at) OVER (PARTITION BY lane ORDER BY seq) AS released FROM x), w AS (SELECT * FROM r WHERE released > ready_at)
      SELECT lane, max(n) AS deepest FROM (SELECT a.lane, (SELECT count(*) FROM w b WHERE b.lane = a.lane AND b.ready_at <= a.ready_at AND b.released > a.ready_at) AS n FROM w a) d GROUP BY lane""",
    "published_units": f"SELECT CAST(4096 AS BIGINT) AS block_bytes, *, 4096 // unit_bytes AS a_block FROM {capacity._parts(capacity.PARTS)}",
    "request_kinds": """WITH r AS (SELECT CAST(f AS INTEGER) AS flags, CAST(t AS BIGINT) AS tx_id FROM range(16) a(f), (VALUES (7), (-7)) b(t)), k AS (SELECT *, CASE flags % 8 WHEN 0 THEN 'SinglePhase' WHEN 1 THEN 'Hold' WHEN 2 THEN 'Settle' WHEN 4 THEN CASE WHEN tx_id < 0 THEN 'VoidExpiry' ELSE 'VoidClient' END END AS kind FROM r)
      SELECT flags, tx_id, kind, kind IN ('Settle', 'VoidClient', 'VoidExpiry') AS looks_up, kind <> 'VoidExpiry' AS client, flags >= 8 AS linked FROM k""",
    "bounded_arithmetic": f"""WITH o AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders), s AS (SELECT *, CAST({(1 << 63) - 1} AS HUGEINT) - o_orderkey * 10000 + v AS wide FROM o)
      SELECT o_orderkey, CASE WHEN wide <= {(1 << 63) - 1} THEN CAST(wide AS BIGINT) END AS sum, greatest(o_orderkey * 100 - v, 0) AS less, (v + 4095) // 4096 AS blocks, least(greatest(v, 1000000), 20000000) AS held FROM s""",
}
