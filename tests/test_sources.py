import json
from datetime import date

from keepwell.sources import io


def test_predictions_plain_and_wrapped(spark, tmp_path):
    one = {"user_id": 1, "full_name": "A", "risk_level": "HIGH", "churn_probability": 0.5, "evidence": {"logins_prev_30_60d": 1, "logins_recent_30d": 0, "total_orders": 3, "total_tickets": 0, "worst_review_rating": 2}, "reason": "r", "suggested_action": "call"}
    (tmp_path / "p.json").write_text(json.dumps([one, {**one, "user_id": 2}]))
    (tmp_path / "w.json").write_text(json.dumps({"assessments": [one]}))
    plain, wrapped = io.read_predictions(spark, str(tmp_path / "p.json")), io.read_predictions(spark, str(tmp_path / "w.json"))
    assert {r["user_id"] for r in plain.collect()} == {1, 2} and plain.first()["evidence"]["total_orders"] == 3
    assert wrapped.select("user_id", "risk_level").collect() == [(1, "HIGH")]
    io.write_predictions(plain, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_truth(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"user_id": 1, "churned": True, "archetype": "vacationer"}]))
    row = io.read_truth(spark, str(tmp_path / "t.json")).first()
    assert row["churned"] is True and row["pickiness"] is None


def test_contact_log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert io.read_contacts(spark, path).count() == 0
    io.append_contacts(spark.createDataFrame([(1, date(2024, 1, 1))], "user_id long, contacted_on date"), path)
    io.append_contacts(spark.createDataFrame([(1, date(2024, 1, 9))], "user_id long, contacted_on date"), path)
    assert io.read_contacts(spark, path).count() == 2
    texts = spark.createDataFrame([('{"7": "2024-02-03"}',)], "value string")
    assert io.contacts_from_json(texts).collect() == [(7, date(2024, 2, 3))]


def test_report_file(spark, tmp_path):
    lines = spark.createDataFrame([(2, "b"), (1, "a")], "rank int, line string")
    io.write_report(lines, str(tmp_path / "r"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "r")).collect()] == ["a", "b"]


def test_tables(spark, views, tmp_path):
    views.orders.limit(5).write.parquet(str(tmp_path / "orders"))
    assert io.read_table(spark, str(tmp_path), "orders").select("order_id", "delivered_at").count() == 5


def test_tables_over_jdbc(spark):
    """Ranges of user_id, and of product_id for the table without users; values beyond the bounds and nulls come too."""
    url, driver = "jdbc:derby:memory:shop;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    orders = spark.createDataFrame([(i, i * 10) for i in range(7)] + [(7, None)], "order_id long, user_id long")
    products = spark.createDataFrame([(i, float(i)) for i in range(5)], "product_id long, price double")
    for name, rows in (("orders", orders), ("products", products)):
        rows.coalesce(1).write.format("jdbc").options(url=url, dbtable=name, driver=driver).mode("overwrite").save()
        got = io.read_table_jdbc(spark, url, name, 10, 40, 3, driver=driver)
        assert got.rdd.getNumPartitions() == 3
        assert sorted(got.collect(), key=str) == sorted(rows.collect(), key=str)


def test_written_tables_come_and_go(spark):
    from keepwell.sources import shared

    path = shared.new_path(spark, "gone")
    assert not shared.exists(spark, path)
    assert shared.settle(spark.range(3), "gone", path).count() == 3
    assert shared.exists(spark, path)
    shared.remove(spark, path)
    assert not shared.exists(spark, path)
