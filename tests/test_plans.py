"""Worked cases and faults: capacity figures, batches, checksums, snapshots, generated traffic."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tallyforge.operators import capacity, wire
from tallyforge.operators.flow import Batcher
from tallyforge.plans import judge, recovery, simulation
from tallyforge.sources import snapshots, units

SF = "/root/testdata/sf0.001"


def test_the_example_deployment_has_the_known_figures(spark):
    d = capacity.demand_report(spark, SF).first()
    assert (d.life_hours, d.live_holds, d.in_flight, d.unwritten, d.resident, d.stored) == (39.75, 447_187_500, 2_000, 32_400_000, 162_000_000, 5_022_000_000)
    assert (round(d.dead_share, 5), d.resolution_reads, d.sweep_reads) == (0.91633, 250.0, 2.5)
    lines = {r.name: r for r in capacity.sizing_lines(spark, SF).collect()}
    assert len(lines) == 22 and lines["pending index"].bytes == 4_294_967_296 and lines["idem keys"].bytes == 2_214_592_512 and lines["account index"].bytes == 2_281_701_376
    assert lines["pending stored blocks"].bytes == 342_835_200_000
    assert [(r.hours, round(r.hit_share, 4), r.blocks, round(r.reads, 2)) for r in capacity.residency_curve(spark, SF).orderBy("hours").collect()][:3] == [(1.0, 0.5, 270_000, 1437.5), (2.0, 0.5667, 450_000, 1229.17), (4.0, 0.7, 810_000, 812.5)]
    plan = capacity.declared_capacity(spark, SF).filter("plan = 'default'").first()
    assert tuple(plan)[1:] == (1_500_000, 1_666_667, 695, 8_334, 4)


def test_a_line_without_a_unit_cost_fails(spark):
    costs = capacity.parts(spark).filter("name <> 'kept log'")
    with pytest.raises(Exception, match="no such sized part: kept log"):
        capacity.sizing(capacity._configs(spark, capacity.EXAMPLE), costs).collect()


def test_unit_costs_come_from_their_document(spark, tmp_path):
    units.publish(spark, capacity.PARTS, str(tmp_path / "u"))
    got = units.load(spark, str(tmp_path / "u"))
    assert capacity.sizing(capacity._configs(spark, capacity.EXAMPLE), got.select("name", "owner", "unit", "unit_bytes")).count() == 22
    units.publish(spark, [("a", "b", "c", 0)], str(tmp_path / "v"))
    with pytest.raises(Exception, match="no unit cost: a"):
        units.load(spark, str(tmp_path / "v")).collect()


def test_batches_keep_chains_whole():
    b = Batcher(size=2, most=2, linger=100)
    assert [b.place(1, 0), b.place(2, 1)] == [1, 2]
    b = Batcher(size=4, most=6, linger=100)
    assert [b.place(k, t) for k, t in ((1, 0), (1, 5), (1, 150), (3, 160), (1, 161), (3, 162), (3, 163))] == [1, 1, 2, 2, 3, 3, 4]


def test_checksums_see_each_flipped_bit(spark):
    assert wire.crc32c(np.frombuffer(b"123456789", np.uint8)[None])[0] == 0xE3069283
    __spark_entry__.queries()["record_blocks"](spark, SF)  # registers the tables
    blocks = wire.write_blocks(wire.hold_records(spark)).collect()
    bad = bytearray(blocks[0].payload)
    bad[777] ^= 4
    rows = [(r.part, r.block, bytes(bad) if i == 0 else bytes(r.payload)) for i, r in enumerate(blocks)]
    got = wire.read_blocks(spark.createDataFrame(rows, "part int, block long, payload binary"))
    n = sum(1 for i in range(wire.PER_BLOCK) if any(bad[i * 68 : i * 68 + 16]))
    assert got.filter("NOT intact").count() == n and got.count() == wire.hold_records(spark).count()


def test_a_digest_tells_bodies_apart():
    rows = np.array([[1, 0, 10, 11, 100, 0, 0, 1 << 16], [1, 0, 10, 11, 101, 0, 0, 1 << 16], [1, 0, 10, 11, 100, 0, 0, 1 << 16]], np.uint64)
    a, b, c = wire.digest(rows)
    assert a == c != b


@pytest.fixture(scope="module")
def snapshot(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("snap"))
    asked = judge.requests(spark, SF)
    judge.effects(judge.judge_seq(asked, spark.sql(judge.ACCOUNTS))).write.parquet(f"{path}/log")
    log = spark.read.parquet(f"{path}/log")
    coverage = log.groupBy("ledger").agg(F.max("ordinal").alias("ordinal"))
    snapshots.write(f"{path}/1", recovery.state(log), coverage, 1)
    return path, log


def test_a_snapshot_is_the_judges_state(spark, snapshot):
    path, log = snapshot
    got = snapshots.read(spark, f"{path}/1")
    live = judge.judge_balances(judge.requests(spark, SF), spark.sql(judge.ACCOUNTS))
    assert judge.differences(live, got["balances"]).first()[:2] == (0, 0)
    assert recovery.behind(log, got["coverage"]).isEmpty() and recovery.behind(log, got["coverage"].limit(0)).count() == log.count()
    assert got["holds"].agg(F.sum("remaining")).first()[0] == live.agg(F.sum("debits_pending")).first()[0]
    assert got["groups"].filter("members < 1 OR remaining < 1").isEmpty()


def test_damaged_snapshots_are_refused(spark, snapshot):
    path, log = snapshot
    coverage = log.groupBy("ledger").agg(F.max("ordinal").alias("ordinal"))
    snapshots.write(f"{path}/2", recovery.state(log), coverage, 2)
    kept = spark.read.parquet(f"{path}/2/holds").collect()
    spark.createDataFrame(kept[1:], spark.read.parquet(f"{path}/2/holds").schema).write.mode("overwrite").parquet(f"{path}/2/holds")
    with pytest.raises(snapshots.Damaged, match="holds"):
        snapshots.read(spark, f"{path}/2")
    with pytest.raises(snapshots.Damaged, match="manifest"):
        snapshots.read(spark, f"{path}/3")
    assert snapshots.newest(spark, [f"{path}/{i}" for i in (1, 2, 3)])[0] == f"{path}/1"
    assert snapshots.due(100, 10, 90) and not snapshots.due(99, 10, 90)


def test_generated_traffic_reaches_all_paths_and_breaks_nothing(spark):
    got = simulation.simulate(spark, 12, 200)
    rows = got.collect()
    assert [r.seed for r in sorted(rows)] == list(range(12)) and all(r.broken == "" for r in rows)
    total = got.agg(*(F.sum(c).alias(c) for c in got.columns[1:-1])).first()
    assert min(total) > 0
    assert sorted(map(tuple, simulation.simulate(spark, 12, 200).collect())) == sorted(map(tuple, rows))
