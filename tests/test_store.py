"""The bucketed fact store and the daily roll-up."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keepwell.operators import activity, features, rollup
from keepwell.sources import store


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def root(spark, views, tmp_path_factory):
    path = tmp_path_factory.mktemp("store").as_uri()
    for n in ("users", "orders", "tickets", "reviews", "truth"):
        at, grain = ("placed_at", "year") if n == "orders" else (None, "day")
        store.write_table(getattr(views, n), path, n, at=at, grain=grain, buckets=4)
    store.write_table(views.log, path, "log", at="event_timestamp", buckets=4)
    return path


def test_features_need_no_exchange(spark, views, root):
    """Nothing is exchanged where sizes allow no broadcast either, and the rows are the same."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = features.build_features(*[store.open_table(spark, root, n) for n in ("users", "orders", "tickets", "reviews", "truth")])
        assert "Exchange" not in plan_of(table)
        plain = features.build_features(views.users, views.orders, views.tickets, views.reviews, views.truth)
        assert plan_of(plain).count("Exchange") > 3
        rounded = lambda df: rows(df.select([F.round(c, 6).alias(c) for c in df.columns]))
        assert rounded(table) == rounded(plain)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_window_reads_its_days(spark, views, root):
    as_of = datetime(2024, 1, 31)
    log = store.in_folders(store.open_table(spark, root, "log"), "2024-01-11")
    trend = activity.login_trend(log, as_of, 20, 10)
    assert "Exchange" not in plan_of(trend)
    assert rows(trend) == rows(activity.login_trend(views.log, as_of, 20, 10))
    days = {r[0] for r in store.open_table(spark, root, "log").select("of_day").distinct().collect()}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert folders_read(activity.login_trend(log, as_of, 20, 10), "event_timestamp") == len([d for d in days if "2024-01-11" <= d < store.TIMELESS]) < len(days)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_another_session_learns_the_layout(spark, root):
    before = rows(store.open_table(spark, root, "orders").drop("of_year"))
    store.forget(spark, root, "orders")
    again = store.open_table(spark, root, "orders")
    assert rows(again.drop("of_year")) == before
    assert "Exchange" not in plan_of(again.groupBy("user_id").count())


def test_rows_that_come_later(spark, tmp_path):
    path = tmp_path.as_uri()
    facts = lambda xs: spark.createDataFrame(xs, "user_id long, at timestamp_ntz, n int")
    first = [(1, datetime(2024, 1, 1, 5), 1), (2, None, 2), (None, datetime(2024, 2, 3), 3)]
    store.write_table(facts(first), path, "facts", at="at", grain="month", buckets=2)
    more = [(1, datetime(2024, 1, 9), 4), (3, datetime(2024, 3, 1), 5)]
    both = store.add_rows(facts(more), path, "facts")
    assert rows(both.select("user_id", "at", "n")) == sorted(first + more, key=str)
    assert [r["n"] for r in store.in_folders(both, "2024-02", "2024-03").orderBy("n").collect()] == [3, 5]
    assert [r["n"] for r in store.in_folders(both, "2024-01").orderBy("n").collect()] == [1, 3, 4, 5]
    assert "Exchange" not in plan_of(both.groupBy("user_id").agg(F.sum("n")))
    assert store.write_table(facts([]), path, "facts", at="at", grain="month", buckets=2).count() == 0  # written anew


def day(d, hour=0, minute=0):
    return datetime(2024, 1, d, hour, minute)


@pytest.mark.parametrize("as_of", [day(25), day(25, 13, 30)], ids=["midnight", "midday"])
@pytest.mark.parametrize("closed", [3, 9, 16, 24, 30])
def test_trend_from_days(spark, tmp_path, as_of, closed):
    """Closed days from the roll-up, others from the log, with logins on the very borders; the log holds rows of closed days
    that must not be counted again, and future rows."""
    start, border = as_of - timedelta(days=20), as_of - timedelta(days=10)
    times = [day(d, h) for d in range(1, 31) for h in (0, 13)] + [start, border, border, start - timedelta(minutes=1), border + timedelta(minutes=1)]
    log = spark.createDataFrame([(i % 3, "LOGIN" if i % 5 else "LOGOUT", t) for i, t in enumerate(times)], "user_id long, event_type string, event_timestamp timestamp_ntz")
    log = log.withColumn("of_day", F.date_format("event_timestamp", "yyyy-MM-dd")).persist()
    daily = log.where("event_type = 'LOGIN'").groupBy("user_id", F.date_trunc("day", "event_timestamp").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("logins"))
    path = str(tmp_path / "days")
    rollup.merge_days(daily.where(F.col("day") < day(min(closed, 10) + 1)), path)
    rollup.merge_days(daily.where(F.col("day").between(day(min(closed, 10)), day(closed))), path)  # the last day comes again
    days = rollup.read_days(spark, path)
    assert rollup.closed_until(days) == day(closed).date()
    got = rollup.trend_from_days(days, log, as_of, 20, 10)
    assert rows(got) == rows(activity.login_trend(log, as_of, 20, 10))


def folders_read(df, column):
    """Folders of the scan that reads a column, as the scan itself counted them."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size())]
    (scan,) = [x for x in scans if column in x.output().toString()]
    return scan.metrics().apply("numPartitions").value()


def test_two_raw_days_are_read(spark, tmp_path):
    """With all days closed, the log gives the days of the two borders alone; at midnight only that of the second."""
    log = spark.createDataFrame([(1, "LOGIN", day(d, h)) for d in range(1, 31) for h in (0, 13)], "user_id long, event_type string, event_timestamp timestamp_ntz")
    path = tmp_path.as_uri()
    stored = store.write_table(log, path, "log", at="event_timestamp", buckets=2)
    daily = log.groupBy("user_id", F.date_trunc("day", "event_timestamp").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("logins"))
    rollup.merge_days(daily, f"{path}/days")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan at hand is the one that ran
    try:
        for as_of, most in ((day(25), 1), (day(25, 13), 2)):
            trend = rollup.trend_from_days(rollup.read_days(spark, f"{path}/days"), stored, as_of, 20, 10)
            assert folders_read(trend, "event_timestamp") == most
            assert rows(trend) == rows(activity.login_trend(log, as_of, 20, 10))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_no_days_yet(spark, tmp_path):
    log = spark.createDataFrame([(1, "LOGIN", day(20))], "user_id long, event_type string, event_timestamp timestamp_ntz").withColumn("of_day", F.lit("2024-01-20"))
    got = rollup.trend_from_days(rollup.read_days(spark, str(tmp_path / "none")), log, day(25), 20, 10)
    assert rows(got) == [(1, 0, 1)]
