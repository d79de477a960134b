"""Streams over files, one micro-batch for each step of the input."""

import datetime as dt

from tallyforge.streaming import dedup, expiry


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def steps(spark, tmp_path, schema, batches, start):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        start(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_repeats_within_the_window(spark, tmp_path):
    schema = "tx_id long, arrival long, body string, at timestamp"
    batches = [
        [(7, 1, "x", at(0)), (7, 2, "x", at(1)), (9, 3, None, at(1))],
        [(7, 4, "y", at(20)), (8, 5, "z", at(21)), (9, 6, None, at(22))],
        [(8, 7, "z", at(300))],  # by then 7, 8 and 9 have been forgotten
        [(7, 8, "y", at(301)), (8, 9, "late", at(302))],
    ]
    got = {r.arrival: r.verdict for r in steps(spark, tmp_path, schema, batches, lambda s: dedup.start(s, str(tmp_path / "out"), str(tmp_path / "check"))).collect()}
    assert got == {1: "Fresh", 2: "DuplicateSameBody", 3: "Fresh", 4: "DuplicateDifferentBody", 5: "Fresh", 6: "DuplicateSameBody", 7: got[7], 8: "Fresh", 9: "DuplicateDifferentBody"}
    assert got[7] in ("Fresh", "DuplicateSameBody")  # the window ends with the watermark, which follows the batch


def test_holds_expire_by_timer_and_are_offered_again(spark, tmp_path):
    schema = "hold_id long, kind string, amount long, at timestamp"
    day = 1440
    batches = [
        [(1, "Hold", 100, at(0)), (2, "Hold", 50, at(0)), (3, "Hold", 70, at(20 * day)), (1, "Settle", 30, at(day))],
        [(2, "Settle", 50, at(21 * day))],
        [(9, "Hold", 1, at(33 * day))],
        [(9, "Settle", 1, at(34 * day + 200))],
        [(1, "Void", 70, at(35 * day))],
        [(8, "Hold", 1, at(40 * day))],
    ]
    rows = steps(spark, tmp_path, schema, batches, lambda s: expiry.start(s, str(tmp_path / "out"), str(tmp_path / "check"))).collect()
    got = {(r.hold_id, r.tx_id, r.amount, r.offer) for r in rows}
    assert (1, -1, 70, 1) in got and all(r.hold_id == 1 for r in rows)  # 2 was settled, 3 is younger
    assert max(r.offer for r in rows) >= 2 and len({r.offer for r in rows}) == len(rows)


def test_sessions_and_days_are_those_of_a_batch(spark):
    rows = [(1, at(0)), (1, at(10)), (1, at(50)), (2, at(5))]
    got = dedup.sessions(spark.createDataFrame(rows, "user_id long, at timestamp")).collect()
    assert sorted((r.user_id, r.n) for r in got) == [(1, 1), (1, 2), (2, 1)]
    effects = spark.createDataFrame([("Post", 5, at(0)), ("Post", 7, at(1439)), ("Hold", 1, at(1441))], "kind string, amount long, at timestamp")
    assert sorted((str(r.day), r.kind, r.n, r.amount) for r in dedup.daily(effects).collect()) == [("2024-01-01", "Post", 2, 12), ("2024-01-02", "Hold", 1, 1)]
