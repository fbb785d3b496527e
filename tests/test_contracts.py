"""Rules counted while a job reads, places of users with very many facts, and the contact log's snapshots."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keepwell.operators import contracts, verdict
from keepwell.plans import jobs
from keepwell.sources import io


def test_every_kind_of_rule_meets_a_fault(views):
    got = {(r["table"], r["rule"]): r["violations"] for r in jobs.c1_all_rules(views).collect()}
    assert {t for t, _ in got} == set(contracts.DOMAINS) | {"products", "reviews"} and len(got) == 34
    for name, faults in jobs.FAULTS.items():
        for column in faults:
            assert any(n > 0 for (t, rule), n in got.items() if t == name and rule.startswith(column)), (name, column)
    assert got["users", "full_name not null"] == 0


def test_the_watch_reads_nothing_twice(spark, views):
    watch = contracts.Watch()
    rows = watch.over("orders", jobs.faulty(views)["orders"])
    by_user = rows.where(F.col("order_status") == "DELIVERED").groupBy("user_id").count()
    assert by_user._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    by_user.collect()
    got = {r["rule"]: r["violations"] for r in watch.found(spark).collect()}
    want = {r["rule"]: r["violations"] for r in contracts.violations("orders", jobs.faulty(views)["orders"]).collect()}
    assert got == want and want["order_status in domain"] > 0


@pytest.mark.parametrize("hot", [0, 3, 10_000])
def test_places_are_the_same_for_hot_users(spark, hot):
    facts = spark.createDataFrame([(u, datetime(2024, 1, 1) + timedelta(hours=i % 5), i) for u, n in ((1, 40), (2, 3), (3, 1), (None, 2)) for i in range(n)], "user_id long, created_at timestamp_ntz, n int")
    got = sorted((r["user_id"], r["place"], r["n"]) for r in verdict.newest_first(facts, ["n"], hot=hot).collect())
    want = []
    for u, n in ((1, 40), (2, 3), (3, 1)):
        want += [(u, p + 1, i) for p, i in enumerate(sorted(range(n), key=lambda i: (-(i % 5), i)))]
    assert got == sorted(want)


def contacts(spark, *pairs):
    return spark.createDataFrame(list(pairs), "user_id long, contacted_on date")


def test_a_log_of_fifty_days_compacts_to_a_row_a_user(spark, tmp_path):
    path = str(tmp_path / "log")
    first = date(2024, 1, 1)
    io.append_contacts(contacts(spark, *[(u, first + timedelta(days=d)) for d in range(50) for u in (d % 7, 100)]), path)
    assert len(list((tmp_path / "log").glob("run_date=*"))) == 50
    want = {u: max(first + timedelta(days=d) for d in range(50) if d % 7 == u) for u in range(7)} | {100: date(2024, 2, 19)}
    began = io.read_contacts(spark, path)  # a reader that began before
    io.compact_contacts(spark, path)
    now = {r["user_id"]: r["contacted_on"] for r in io.read_contacts(spark, path).collect()}
    assert now == want and io.read_contacts(spark, path).count() == 8
    assert began.count() == 100  # its files are still there
    io.compact_contacts(spark, path)  # nothing came: nothing happens
    assert began.count() == 100
    # a late date stays in the log, and after the next snapshot the first days are gone
    io.append_contacts(contacts(spark, (3, date(2024, 1, 5)), (500, date(2024, 1, 5)), (100, date(2024, 3, 1)), (7, None)), path)
    newer = want | {100: date(2024, 3, 1), 500: date(2024, 1, 5)}
    last = lambda: {r["user_id"]: r["d"] for r in io.read_contacts(spark, path).groupBy("user_id").agg(F.max("contacted_on").alias("d")).collect()}
    assert last() == newer
    io.compact_contacts(spark, path)
    assert last() == newer and io.read_contacts(spark, path).count() == 9
    assert {p.name for p in (tmp_path / "log").glob("run_date=*")} == {"run_date=2024-02-20", "run_date=2024-03-01"}


def test_a_snapshot_counts_once_it_is_whole(spark, tmp_path):
    path = str(tmp_path / "log")
    io.append_contacts(contacts(spark, (1, date(2024, 1, 1)), (1, date(2024, 1, 2))), path)
    io.compact_contacts(spark, path)
    (tmp_path / "log/_snapshots/upto=2024-01-02/_SUCCESS").unlink()  # as while it is being written
    assert io.read_contacts(spark, path).count() == 2


def test_places_are_dealt_out_by_the_number_of_facts(spark, monkeypatch):
    """A task has about TASK_FACTS facts, however many there are and however few partitions a shuffle has."""
    from keepwell.operators import verdict

    facts = spark.range(1000).selectExpr("id % 100 AS user_id", "id AS n", "timestamp_seconds(id) AS created_at")
    want = sorted(map(tuple, verdict.newest_first(facts, ["n"]).collect()))
    monkeypatch.setattr(verdict, "TASK_FACTS", 50)
    many = verdict.newest_first(facts, ["n"])
    assert many.rdd.getNumPartitions() == 20 and sorted(map(tuple, many.collect())) == want
    assert all(place == 10 - n // 100 for _, n, _, place in want)
