"""Where a plausible job would give a different answer."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from keepwell.functions import columns as C
from keepwell.operators import activity, contacts, contracts, evaluation, evidence, features, report, scoring, uplift, verdict

AS_OF = datetime(2024, 3, 1, 12, 0)
TS = "timestamp_ntz"


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def at(spark, rows, ddl, *columns):
    """Times are given as text."""
    out = frame(spark, rows, ddl)
    return out.withColumns({c: F.col(c).cast(TS) for c in columns})


@pytest.fixture(scope="module")
def users(spark):
    return frame(spark, [(1, "Ann", "X", "CUSTOMER", "ACTIVE"), (2, "Bo", "X", "CUSTOMER", "SUSPENDED"), (3, "Cy", "Y", "SUPPORT_AGENT", "ACTIVE"), (4, "Di", "Y", "CUSTOMER", "ACTIVE")], "user_id long, full_name string, city string, user_type string, account_status string")


@pytest.fixture(scope="module")
def orders(spark):
    return at(spark, [(10, 1, "CANCELLED", 100.0, "2024-02-28 10:00:00"), (11, 1, "DELIVERED", 50.0, "2024-01-01 00:00:00"), (12, 2, "DELIVERED", 30.0, "2023-12-01 00:00:00")], "order_id long, user_id long, order_status string, total_amount double, placed_at string", "placed_at")


def test_border_event_counts_twice_and_future_counts(spark):
    log = at(spark, [(1, "LOGIN", "2024-01-31 12:00:00"), (1, "LOGIN", "2024-01-01 12:00:00"), (1, "LOGIN", "2024-01-01 11:59:59"), (1, "LOGIN", "2024-05-01 00:00:00"), (1, "LOGOUT", "2024-02-20 00:00:00")], "user_id long, event_type string, event_timestamp string", "event_timestamp")
    assert activity.login_trend(log, AS_OF).collect() == [(1, 2, 2)]


def test_cancelled_orders_count_everywhere(spark, users, orders):
    tickets = frame(spark, [], "user_id long, status string, category string")
    reviews = frame(spark, [], "user_id long, rating int")
    rows = {r["user_id"]: r for r in features.build_features(users, orders, tickets, reviews).collect()}
    assert set(rows) == {1, 2, 4}
    assert (rows[1]["total_orders"], rows[1]["avg_order_value"], rows[1]["cancellation_rate"]) == (2, 75.0, 0.5)
    assert rows[4]["avg_order_value"] is None and rows[4]["total_orders"] == 0 and rows[4]["cancellation_rate"] == 0
    assert rows[4]["avg_review_rating"] is None


def test_tickets_per_order_without_orders(spark, users):
    none = frame(spark, [], "user_id long, order_status string, total_amount double")
    tickets = frame(spark, [(4, "OPEN"), (4, "CLOSED"), (4, "RESOLVED")], "user_id long, status string")
    row = features.build_features(users, none, tickets, frame(spark, [], "user_id long, rating int")).where("user_id = 4").first()
    assert row["tickets_per_order"] == 3.0 and row["unresolved_ticket_rate"] == pytest.approx(1 / 3)


def test_dormancy_two_ways(users, orders):
    one = {r["user_id"] for r in activity.dormant(users, orders, AS_OF, 14).collect()}
    other = {r["user_id"] for r in activity.without_recent_order(users, orders, AS_OF, 14).collect()}
    assert one == other == {2, 4}


def test_quietest_puts_those_without_orders_first(spark, users, orders):
    log = at(spark, [(2, "LOGIN", "2024-02-20 00:00:00")], "user_id long, event_type string, event_timestamp string", "event_timestamp")
    rows = activity.quietest(users, orders, log, AS_OF, AS_OF).orderBy(F.asc_nulls_first("last_order")).collect()
    assert [(r["user_id"], r["total_orders"], r["logins_recent"]) for r in rows] == [(4, 0, 0), (2, 1, 1)]


def test_contact_of_the_day_at_the_edge(spark):
    log = frame(spark, [(1, date(2024, 1, 31)), (2, date(2024, 2, 1)), (3, date(2024, 1, 1)), (3, date(2024, 2, 20))], "user_id long, contacted_on date")
    assert {r["user_id"] for r in contacts.recently_contacted(log, AS_OF, 30).collect()} == {2, 3}
    assert {r["user_id"] for r in contacts.recently_contacted(log, datetime(2024, 3, 1), 30).collect()} == {1, 2, 3}


def test_memory_round_trip(spark):
    empty = frame(spark, [], "user_id long, contacted_on date")
    log = contacts.mark_contacted(empty, frame(spark, [(1,), (2,), (3,), (3,)], "user_id long"), date(2024, 2, 29))
    assert {r["user_id"] for r in contacts.recently_contacted(log, AS_OF).collect()} == {1, 2, 3} and log.count() == 3


def test_suppression_comes_before_the_limit(spark, users):
    scored = frame(spark, [(1, 0.9, 10.0, 1), (2, 0.8, 10.0, 1), (4, 0.7, None, 0)], "user_id long, churn_probability double, avg_order_value double, total_orders long")
    log = frame(spark, [], "user_id long, event_type string").withColumn("event_timestamp", F.lit(None).cast(TS))
    contacted = frame(spark, [(1, date(2024, 2, 25))], "user_id long, contacted_on date")
    top = scoring.top_candidates(scored, users, log, contacted, AS_OF, AS_OF, top_n=1)
    assert [r["user_id"] for r in top.collect()] == [2]
    both = scoring.top_candidates(scored, users, log, contacted, AS_OF, AS_OF, top_n=5).orderBy(F.desc_nulls_last("priority_score")).collect()
    assert [r["user_id"] for r in both] == [2, 4] and both[1]["priority_score"] is None


def test_evidence_missing_claim_is_wrong_and_repeats_count(spark, users, orders):
    tickets, reviews = frame(spark, [(1,)], "user_id long"), frame(spark, [(2, 3)], "user_id long, rating int")
    log = frame(spark, [], "user_id long, event_type string").withColumn("event_timestamp", F.lit(None).cast(TS))
    ids = frame(spark, [(1,), (2,)], "user_id long")
    real = evidence.facts(ids, orders, tickets, reviews, log, AS_OF)
    assert {tuple(r) for r in real.collect()} == {(1, 0, 0, 2, 1, 0), (2, 0, 0, 1, 0, 3)}
    claims = frame(spark, [(1, (0, 0, 2, 1, 0)), (1, (0, 0, 9, 1, 0)), (2, (0, 0, 1, 0, None))], "user_id long, evidence struct<logins_prev_30_60d:int,logins_recent_30d:int,total_orders:int,total_tickets:int,worst_review_rating:int>")
    got = evidence.fidelity(evidence.checks(claims, real)).first()
    assert (got["users_checked"], got["fields_checked"], got["fields_correct"], got["users_with_errors"]) == (2, 15, 13, 2)
    assert evidence.fidelity(evidence.checks(claims.limit(0), real)).first()["fidelity"] == 0.0


def test_agent_scores_count_users_once_and_stand_empty_sides(spark):
    truth = frame(spark, [(1, True), (2, True), (3, False)], "user_id long, churned boolean")
    said = frame(spark, [(1, "HIGH"), (1, "MEDIUM"), (3, "HIGH"), (2, "LOW")], "user_id long, risk_level string")
    assert tuple(evaluation.agent_scores(said, truth).first()) == (1, 1, 1, 0.5, 0.5, 0.5)
    assert tuple(evaluation.agent_scores(said.limit(0), truth).first())[3:] == (0.0, 0.0, 0.0)
    parts = [{r["user_id"] for r in f(said, truth).collect()} for f in (evaluation.caught, evaluation.false_alarms, evaluation.missed)]
    assert parts == [{1}, {3}, {2}]


def test_thresholds_differ_at_the_cut(spark):
    rows = frame(spark, [(1, 0.5)], "user_id long, churn_probability double")
    assert rows.select(C.over("churn_probability"), C.over("churn_probability", inclusive=True)).first()[:] == (False, True)


def test_auc_counts_ties_half(spark):
    rows = frame(spark, [(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)], "churn_probability double, churned int")
    assert evaluation.roc_auc(rows).first()["auc"] == pytest.approx(0.875)
    assert evaluation.roc_auc(rows.where("churned = 1")).first()["auc"] is None


def test_redaction(spark):
    texts = ["mail a.b@c.de or 9876543210", "+919876543210", "+91 9876543210", "é9876543210", "12345678901", "5876543210"]
    got = [r[0] for r in frame(spark, [(t,) for t in texts], "t string").select(C.redact(F.col("t"))).collect()]
    assert got == ["mail [EMAIL] or [PHONE]", "+919876543210", "+91 [PHONE]", "é9876543210", "12345678901", "5876543210"]


def test_winnability_defaults_and_limits(spark):
    rows = frame(spark, [(1.0, 1.0, 0.0), (0.0, 0.0, 1.0), (None, None, None)], "support_pain double, delivery_pain double, pickiness double")
    assert [round(r[0], 6) for r in rows.select(C.winnability()).collect()] == [0.6, 0.0, 0.2]


def test_uplift_of_an_empty_arm(spark):
    rows = frame(spark, [(1, "treatment", 1)], "user_id long, arm string, returned int")
    got = uplift.uplift(rows).first()
    assert got["rate_treatment"] == 1.0 and got["uplift"] is None


def test_arms_do_not_depend_on_partitions(spark, views):
    one = {tuple(r) for r in uplift.assign_arms(views.truth.coalesce(1)).select("user_id", "arm").collect()}
    other = {tuple(r) for r in uplift.assign_arms(views.truth.repartition(7)).select("user_id", "arm").collect()}
    assert one == other


def test_reviews_without_order_are_all_kept(spark):
    rows = frame(spark, [(1, 7, 5, 100), (1, 7, 5, 101), (1, 7, None, 102), (1, 7, None, 103)], "user_id long, product_id long, order_id long, review_id long")
    assert {r["review_id"] for r in contracts.first_reviews(rows, ["review_id"]).collect()} == {100, 102, 103}
    assert contracts.duplicates(rows, "user_id", "product_id", "order_id").collect() == [(1, 7, 5, 2)]


def test_orphans_ignore_missing_keys(spark):
    facts, there = frame(spark, [(1,), (2,), (None,)], "order_id long"), frame(spark, [(1,)], "order_id long")
    assert contracts.orphans(facts, "order_id", there, "order_id").collect() == [(2,)]


def test_verdict_rules(spark):
    rows = frame(spark, [(1, 0.9, "FINE", "SILENT"), (2, 0.9, "FINE", "FINE"), (3, 0.2, "UNHAPPY", "FINE"), (4, 0.2, "NONE", "SILENT"), (5, 0.5, "UNHAPPY", "FINE")], "user_id long, churn_probability double, ticket_signal string, review_signal string")
    got = {r["user_id"]: (r["risk_level"], r["suggested_action"]) for r in verdict.risk_levels(rows).collect()}
    assert got == {1: ("HIGH", "retention call"), 2: ("LOW", "ignore"), 3: ("MEDIUM", "send coupon"), 4: ("LOW", "ignore"), 5: ("HIGH", "retention call")}


def test_critic_lowers_one_level(spark):
    rows = frame(spark, [("HIGH", 10, 8, 3, 1), ("HIGH", 10, 7, 3, 1), ("MEDIUM", 0, 5, 0, 4), ("LOW", 1, 1, 0, 5), ("HIGH", 0, 5, 1, 5)], "risk_level string, logins_prev_30_60d long, logins_recent_30d long, total_tickets long, worst_review_rating long")
    assert [r["revised_level"] for r in verdict.criticise(rows).collect()] == ["MEDIUM", "HIGH", "LOW", "LOW", "HIGH"]


def test_dossier_redacts_and_caps(spark):
    tickets = at(spark, [(1, 5, "call 9876543210", "2024-01-01 00:00:00"), (1, 6, "x", "2024-01-02 00:00:00"), (1, 7, "y", "2024-01-03 00:00:00")], "user_id long, order_id long, description string, created_at string", "created_at")
    reviews = at(spark, [], "user_id long, order_id long, rating int, created_at string", "created_at")
    row = verdict.dossiers(frame(spark, [(1,), (2,)], "user_id long"), tickets, reviews, ["order_id", "description"], ["rating"], (["order_id"], ["order_id"]), 3, ("description",)).where("user_id = 1").first()
    assert "[PHONE]" in row["tickets"] and row["reviews"] == "[]"


def test_report_rank_and_groups(spark):
    rows = frame(spark, [(1, "Ann", 0.4, "Retention CALL and coupon", "HIGH"), (2, "Bo", None, "ignore", "LOW"), (3, "Cy", 0.9, "coupon", "MEDIUM")], "user_id long, full_name string, churn_probability double, suggested_action string, risk_level string")
    ranked = report.with_factor(report.ranked(rows, 5), frame(spark, [(3, "x")], "user_id long, top_factor string"))
    assert {r["user_id"]: (r["rank"], r["top_factor"]) for r in ranked.collect()} == {3: (1, "x"), 1: (2, "-"), 2: (3, "-")}
    groups = {(r["action"], r["user_id"], r["members"]) for r in report.action_groups(ranked).collect()}
    assert groups == {("Retention calls", 1, 1), ("Coupons", 1, 2), ("Coupons", 3, 2)}


def test_no_fan_out(views):
    customers = views.users.where(C.is_customer()).count()
    rows = features.build_features(views.users, views.orders, views.tickets, views.reviews, views.truth)
    assert rows.count() == customers == rows.select("user_id").distinct().count()
    assert {r["churned"] for r in rows.select("churned").distinct().collect()} == {0, 1}
