from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keepwell.operators import activity
from keepwell.plans.jobs import JOBS
from keepwell.streaming import dedup, versions
from keepwell.streaming import jobs as streams


def test_daily_logins_equal_the_batch_on_closed_days(views):
    got = {tuple(r) for r in JOBS["r1_daily_logins"](views).select("user_id", "day", "logins").collect()}
    batch = views.log.where("event_type = 'LOGIN'").groupBy("user_id", F.date_trunc("day", "event_timestamp").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("logins"))
    want = {tuple(r) for r in batch.collect()}
    last = max(day for _, day, _ in want)
    assert got <= want and {x for x in want if (last - x[1]).days >= 2} <= got


def test_running_orders_equal_the_batch(views):
    got = {tuple(r) for r in JOBS["r2_running_orders"](views).select("user_id", "last_order", "total_orders").collect()}
    assert got == {tuple(r) for r in activity.last_orders(views.orders).collect()}


def arriving(spark, folder, batches, schema):
    """Each batch is a file that arrives after the one before."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return streams.read_stream(spark, f"{folder}/in", schema)


def at(day, hour=0):
    return datetime(2024, 1, day, hour)


def test_late_logins_are_dropped(spark, tmp_path):
    """The watermark stands a day behind the newest login; a row older than it has no effect once its day was given out."""
    schema = "user_id long, event_type string, event_timestamp timestamp_ntz"
    batches = [[(1, "LOGIN", at(1, 8)), (1, "LOGOUT", at(1, 9)), (2, "LOGIN", at(1, 23))], [(1, "LOGIN", at(2, 1)), (1, "LOGIN", at(1, 22)), (2, "LOGIN", at(4, 5))], [(2, "LOGIN", at(3, 6))], [(1, "LOGIN", at(1, 10)), (1, "LOGIN", at(9))]]
    streams.run_available(streams.daily_logins(arriving(spark, tmp_path, batches, schema)), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r["user_id"], r["day"].day): r["logins"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 1): 2, (2, 1): 1, (1, 2): 1, (2, 4): 1, (2, 3): 1}  # the last batch's login of day 1 came too late


def test_duplicates_across_batches(spark, tmp_path):
    schema = "user_id long, product_id long, order_id long, created_at timestamp_ntz"
    batches = [[(1, 1, 5, at(1)), (1, 1, None, at(1))], [(1, 1, 5, at(1, 3)), (1, 2, 5, at(1)), (1, 1, None, at(1))], [(1, 2, 5, at(1, 5)), (2, 1, 5, at(2))]]
    streams.run_available(streams.first_reviews(arriving(spark, tmp_path, batches, schema)), str(tmp_path / "out"), str(tmp_path / "state"))
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("user_id", "product_id", "order_id").collect()]
    assert sorted(got, key=str) == sorted([(1, 1, 5), (1, 1, None), (1, 2, 5), (1, 1, None), (2, 1, 5)], key=str)


STATE = "user_id long, last_order timestamp_ntz, total_orders long"


def test_upserts_are_merged(spark, tmp_path):
    """State runs on over the batches; a base takes the place of the batches before it, a replay changes nothing, and what a
    base replaced is deleted once the next one stands."""
    schema = "user_id long, placed_at timestamp_ntz"
    batches = [[(1, at(1)), (2, at(1))], [(1, at(2))], [(3, at(3)), (1, at(1))], [(2, at(4))], [(1, at(5))]]
    out = str(tmp_path / "out")
    streams.run_upserts(streams.running_orders(arriving(spark, tmp_path, batches, schema)), out, str(tmp_path / "state"), "user_id", compact_every=2)
    want = {(1, at(5), 4), (2, at(4), 2), (3, at(3), 1)}
    assert {tuple(r) for r in streams.latest(spark, out, "user_id", STATE).collect()} == want
    assert sorted(p.name for p in (tmp_path / "out/kind=base").glob("batch=*")) == ["batch=1", "batch=3"]
    assert sorted(p.name for p in (tmp_path / "out/kind=delta").glob("batch=*")) == ["batch=2", "batch=3", "batch=4"]
    write = streams.upsert_parquet(out, "user_id", 2)
    write(spark.createDataFrame([(2, at(4), 2)], STATE), 3)
    assert {tuple(r) for r in streams.latest(spark, out, "user_id", STATE).collect()} == want
    assert {tuple(r) for r in streams.latest(spark, out, "user_id", STATE, before=3).collect()} == {(1, at(2), 3), (2, at(1), 1), (3, at(3), 1)}


def test_a_base_counts_once_it_is_whole(spark, tmp_path):
    out = str(tmp_path / "out")
    for batch, row in enumerate([(1, at(1), 1), (1, at(2), 2)]):
        versions.put(spark.createDataFrame([row], STATE), out, batch)
    versions.rebase(spark.createDataFrame([(1, at(9), 9)], STATE), out, 1)
    (tmp_path / "out/kind=base/batch=1/_SUCCESS").unlink()
    assert [r["last_order"] for r in streams.latest(spark, out, "user_id", STATE).collect()] == [at(2)]


def test_keyed_state_outlives_a_restart(spark, tmp_path):
    """The store is RocksDB, as the progress of the query says, and a second start goes on from the first one's counts."""
    schema = "user_id long, placed_at timestamp_ntz"
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    arrived = arriving(spark, tmp_path, [[(1, at(1)), (2, at(1))]], schema)
    query = streams.run_upserts(streams.running_orders(arrived), out, state, "user_id")
    metrics = [o["customMetrics"] for p in query.recentProgress for o in p["stateOperators"]]
    assert metrics and all("rocksdbCommitCheckpointLatency" in m or any(k.startswith("rocksdb") for k in m) for m in metrics)
    assert spark.conf.get(setting, None) == before
    arrived = arriving(spark, tmp_path, [[(1, at(3)), (1, None)]], schema)
    streams.run_upserts(streams.running_orders(arrived), out, state, "user_id")
    assert {tuple(r) for r in streams.latest(spark, out, "user_id", STATE).collect()} == {(1, at(3), 3), (2, at(1), 1)}


REVIEWS = "user_id long, product_id long, order_id long, line int, created_at timestamp_ntz"


def run_dedup(spark, folder, batches, late=timedelta(days=2), every=2):
    stream = arriving(spark, folder, batches, REVIEWS)
    dedup.run_first_of_each(stream, str(folder / "r"), str(folder / "state"), streams.REVIEW_KEY, "created_at", late, ("line",), every)
    got = lambda rows: sorted((tuple(r) for r in rows.collect()), key=str)
    return got(dedup.passed(spark, str(folder / "r"), REVIEWS)), got(dedup.set_aside(spark, str(folder / "r"), REVIEWS))


def test_first_of_each_key_passes(spark, tmp_path):
    """Repeats inside a batch, in the next one, and after a base; a key comes again once it was not seen for two days."""
    key, other = (1, 1, 5), (2, 1, 5)
    batches = [
        [(*key, 2, at(1)), (*key, 1, at(1)), (1, 1, None, 1, at(1)), (1, 1, None, 1, at(1)), (*key, 1, at(1, 9))],
        [(*key, 1, at(2)), (*other, 1, at(2))],
        [(*key, 1, at(4)), (*other, 3, at(3)), (3, 3, 3, 1, at(4))],
        [(*key, 1, at(6, 1)), (*other, 1, at(4)), (3, 3, 3, 1, at(4, 1)), (*key, 1, at(20)), (*key, 2, at(22))],
        [(*key, 1, at(23)), (4, 4, 4, 1, at(17, 23)), (4, 4, 4, 1, at(20)), (4, 4, 4, 1, None)],
    ]
    passed, dead = run_dedup(spark, tmp_path, batches)
    want = [(*key, 1, at(1)), (1, 1, None, 1, at(1)), (1, 1, None, 1, at(1)), (*other, 1, at(2)), (3, 3, 3, 1, at(4)), (*key, 1, at(6, 1)), (*key, 1, at(20)), (4, 4, 4, 1, at(20))]
    assert passed == sorted(want, key=str)
    assert dead == sorted([(4, 4, 4, 1, at(17, 23), "late"), (4, 4, 4, 1, None, "timeless")], key=str)
    # keys that were not seen for twice the lateness are gone from the last base
    last = max((tmp_path / "r/seen/kind=base").glob("batch=*"))
    assert {r["user_id"] for r in spark.read.parquet(str(last)).collect()} == {1}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    batches = [[(1, 1, 5, 1, at(1))], [(1, 1, 5, 1, at(2)), (2, 2, 2, 1, at(2))], [(2, 2, 2, 1, at(3)), (3, 3, 3, 1, at(3))]]
    first = run_dedup(spark, tmp_path, batches)
    write = dedup.first_of_each(str(tmp_path / "r"), streams.REVIEW_KEY, "created_at", timedelta(days=2), ("line",), 2)
    for i in (1, 2):
        write(spark.createDataFrame(batches[i], REVIEWS), i)
    got = lambda rows: sorted((tuple(r) for r in rows.collect()), key=str)
    assert (got(dedup.passed(spark, str(tmp_path / "r"), REVIEWS)), got(dedup.set_aside(spark, str(tmp_path / "r"), REVIEWS))) == first


def test_the_registered_stream_drops_reviews(spark, data, monkeypatch):
    """With the operator taken out, the registered query no longer equals its SQL."""
    from keepwell.plans import queries as plans
    from tests.oracle import assert_same, duck

    def everything(path, key, at, late, ties=(), compact_every=8):
        def write(batch, batch_id):
            batch.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

        return write

    monkeypatch.setattr(dedup, "first_of_each", everything)
    with pytest.raises(AssertionError):
        assert_same(plans.QUERIES["r3_first_reviews"](spark, data), duck(data), plans.ORACLE_SQL["r3_first_reviews"])


def test_reviews_without_order_pass(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, None), (1, 1, None), (1, 1, 5), (1, 1, 5)], "user_id long, product_id long, order_id long").withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), "user_id long, product_id long, order_id long, created_at timestamp_ntz")
    streams.run_available(streams.first_reviews(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
