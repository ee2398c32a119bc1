from __future__ import annotations

import pytest

from covenantry.operators import overview
from covenantry.plans import overview as O
from tests.oracle import compare

SQL = O.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    compare(spark, "/root/testdata/sf0.001", O.queries()[name], SQL[name])


def test_admitted_requests_against_brute_force(spark):
    import random

    draw = random.Random(4)
    rows = [(draw.choice("abc"), at, k) for k, at in enumerate(sorted(draw.randint(0, 400) for _ in range(200)))] + [("d", 5, 900), ("d", 5, 901), ("d", 5, 902)]
    want, log = {}, {}
    for client, at, k in sorted(rows, key=lambda r: (r[1], r[2])):
        held = [t for t in log.get(client, []) if t > at - 20]
        want[k] = len(held) < 2
        log[client] = held + [at] * want[k]
    got = {r.id: r.allowed for r in overview.admitted(spark.createDataFrame(rows, "client string, at long, id long"), 2, 20).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)
    assert O.queries()["admitted_requests"](spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def slow_admissions(rows, most, seconds):
    want, log = {}, {}
    for client, at, k in sorted(rows, key=lambda r: (r[1], r[2])):
        held = [t for t in log.get(client, []) if t > at - seconds]
        want[k] = len(held) < most
        log[client] = held + [at] * want[k]
    return want


@pytest.mark.parametrize(("most", "seconds", "gap"), [(1, 5, 3), (3, 10, 3), (3, 10, 4), (5, 60, 11), (4, 1, 1)])
def test_admissions_of_a_client_without_pauses(spark, most, seconds, gap):
    import random

    draw, rows, at = random.Random(most), [], 0
    for k in range(3000):  # no pause as long as the window, loads that come and go
        at += draw.randint(0, gap) if (k // 300) % 2 else draw.randint(gap // 2, min(2 * gap, seconds - 1) if seconds > 1 else 1)
        rows.append(("hot" if k % 5 else None, at - 1000, k))
    table = spark.createDataFrame([*rows, ("hot", None, 9000), (None, None, 9001)], "client string, at long, id long")
    got = {r.id: r.allowed for r in overview.admitted(table.repartition(7), most, seconds).collect()}
    assert got.pop(9000) is None and got.pop(9001) is None
    want = slow_admissions(rows, most, seconds)
    assert got == want and 0 < sum(want.values()) < len(want)
    assert overview.admitted(table.limit(0), most, seconds).count() == 0


def test_only_stretches_over_the_limit_are_gone_through_in_order(spark):
    rows = [("hot", 10 * k, k) for k in range(5000)] + [("hot", 20_000, 6000 + k) for k in range(9)]
    loads = overview._loads(spark.createDataFrame(rows, "client string, at long, id long"), 7, 60)
    assert {r.slot for r in overview.busy_slots(loads).collect()} == {20_000 // 60, 20_000 // 60 + 1}


def test_streamed_admissions_go_on_from_batch_to_batch(spark, tmp_path):
    import random
    from datetime import UTC, datetime

    from pyspark.sql import functions as F

    from covenantry.streaming import limits

    draw, rows, at = random.Random(2), [], 1_700_000_000
    for k in range(400):
        at += draw.choice([0, 1, 2, 3, 40]) if k < 399 else 100_000  # the last one moves the clock on, so that timers fire
        rows.append((draw.choice("ab"), at, k))
    late = ("a", rows[0][1] + 1, 999)
    schema = "client string, at long, id long"
    requests = lambda df: df.withColumn("ts", F.timestamp_seconds("at"))
    for part in (rows[:130], rows[130:260], rows[260:], [late]):
        df = spark.createDataFrame(part, schema)
        df.repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        found = limits.stream_admitted(spark, f"{tmp_path}/in", df.schema, requests, f"{tmp_path}/out", f"{tmp_path}/log", 3, 20, "1 minute")
    got = {r.id: r.allowed for r in found.collect()}
    assert datetime.fromtimestamp(rows[0][1], UTC).year == 2023 and 999 not in got, "a request behind the watermark has no answer"
    assert got == slow_admissions(rows, 3, 20)
    assert got == {r.id: r.allowed for r in overview.admitted(spark.createDataFrame(rows, schema), 3, 20).collect()}
