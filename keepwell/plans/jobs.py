"""The registered jobs: each operator applied to the benchmark views, whole tables each time."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwell.functions import columns as C
from keepwell.operators import activity, causality, contacts, contracts, drift, evaluation, evidence, features, report, rollup, scoring, uplift, verdict
from keepwell.sources import io, store
from keepwell.sources.shared import exists, new_path, remove, settle
from keepwell.sources.views import FAULTS, Views

AS_OF, LOG_AS_OF = datetime(2001, 8, 1), datetime(2024, 1, 31)
#: The log covers one month, so trends compare 20 to 10 days back with the last 10; dormancy is a year here.
EARLIER, RECENT, DORMANT, TOP = 20, 10, 365, 15
TICKET_TIES = ["order_id", "l_linenumber", "l_suppkey", "l_partkey", "category", "priority", "status"]
REVIEW_TIES = ["order_id", "l_linenumber", "l_suppkey", "product_id", "rating"]
#: Entries of a JSON map of the contact log.
MAP_ENTRIES = 10_000
# What an incident adds to the rates.
SHOCK = {"cancellation_rate": 0.20, "unresolved_ticket_rate": 0.15}

JOBS: dict[str, Callable[[Views], DataFrame]] = {}


def job(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    JOBS[f.__name__] = f
    return f


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def r12(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.round(column, 12))


def feature_table(v: Views) -> DataFrame:
    return features.build_features(v.users, v.orders, v.tickets, v.reviews, v.truth)


def scored(v: Views) -> DataFrame:
    return feature_table(v).withColumn("churn_probability", scoring.formula_probability())


def true_facts(v: Views, ids: DataFrame) -> DataFrame:
    return evidence.facts(ids, v.orders, v.tickets, v.reviews, v.log, LOG_AS_OF, EARLIER, RECENT)


def profile(v: Views, logins: bool = False) -> DataFrame:
    return features.profile(v.users, v.orders, v.tickets, v.reviews, activity.login_trend(v.log, LOG_AS_OF, EARLIER, RECENT) if logins else None)


def judged(rows: DataFrame) -> DataFrame:
    """Verdicts by rule from a profile."""
    told = rows.withColumn("churn_probability", scoring.formula_probability())
    told = told.withColumns({"ticket_signal": verdict.ticket_signal_of(F.col("total_tickets"), F.col("bad_tickets")), "review_signal": verdict.review_signal_of(F.col("worst_rating"))})
    return verdict.risk_levels(told.select("user_id", "full_name", "churn_probability", "ticket_signal", "review_signal"))


def signals(v: Views) -> DataFrame:
    return judged(profile(v))


def claims(v: Views) -> tuple[DataFrame, DataFrame]:
    """Predictions and the facts they are held against. Both follow from one profile, which is written once."""
    whole = settle(profile(v, logins=True), "profile")
    real = evidence.facts_of(whole)
    return with_evidence(judged(whole), real), real


def predictions(v: Views) -> DataFrame:
    return claims(v)[0]


def reviewed(v: Views) -> DataFrame:
    whole = settle(profile(v, logins=True), "profile")
    return verdict.criticise(judged(whole).join(evidence.facts_of(whole), "user_id"))


def with_evidence(rows: DataFrame, real: DataFrame) -> DataFrame:
    """Evidence is true but for an order too many of every 17th customer and a missing rating of every 19th."""
    said = F.struct(
        F.col("logins_prev_30_60d"), F.col("logins_recent_30d"),
        (F.col("total_orders") + F.when(F.col("user_id") % 17 == 0, 1).otherwise(0)).alias("total_orders"),
        F.col("total_tickets"), F.when(F.col("user_id") % 19 != 0, F.col("worst_review_rating")).alias("worst_review_rating"),
    )
    return rows.join(real, "user_id").withColumn("evidence", said)


# -- sources, filters --------------------------------------------------------------------------------------------------


@job
def p1_customers(v):
    return v.users.where(C.is_customer()).select("user_id", "full_name")


@job
def p2_active_roster(v):
    return v.users.where(C.is_active_customer() | C.is_support_agent()).select("user_id", F.when(C.is_support_agent(), "agent").otherwise("customer").alias("roster"))


@job
def p3_flagged_verdicts(v):
    return signals(v).where(C.is_flagged()).select("user_id", "risk_level")


@job
def p4_model_flags(v):
    return scored(v).select("user_id", C.over("churn_probability", 0.5).alias("flag_strict"), C.over("churn_probability", 0.5, inclusive=True).alias("flag_inclusive"))


@job
def p5_action_mentions(v):
    return signals(v).select("user_id", C.mentions("suggested_action", "call").alias("is_call"), C.mentions("suggested_action", "coupon").alias("is_coupon"))


@job
def p6_ticket_lookup(v):
    return verdict.of_users(v.tickets, v.contacts, list(TICKET_TIES) + ["created_at"])


@job
def p6_review_lookup(v):
    return verdict.of_users(v.reviews, v.contacts, list(REVIEW_TIES) + ["created_at"])


def fact_store(v: Views, *names: str) -> dict[str, DataFrame]:
    """Tables of the shop laid out in a store: by user, the log by day, and orders by year."""
    root = new_path(v.spark, "store")
    times = {"log": ("event_timestamp", "day"), "orders": ("placed_at", "year")}
    buckets = int(v.spark.conf.get("spark.sql.shuffle.partitions"))
    out = {}
    for n in names:
        at, grain = times.get(n, (None, "day"))
        out[n] = store.write_table(getattr(v, n), root, n, at=at, grain=grain, buckets=buckets)
    return out


@job
def s1_store_features(v):
    """The feature table from the store: no fact is exchanged."""
    t = fact_store(v, "users", "orders", "tickets", "reviews", "truth")
    return r6(features.build_features(t["users"], t["orders"], t["tickets"], t["reviews"], t["truth"]), *C.FEATURES)


@job
def s1_store_trend(v):
    """The login trend from the store: only the window's days are read."""
    log = store.in_folders(fact_store(v, "log")["log"], (LOG_AS_OF - timedelta(days=EARLIER)).date().isoformat())
    return activity.login_trend(log, LOG_AS_OF, EARLIER, RECENT)


@job
def s3_nested_predictions(v):
    return predictions(v).select("user_id", "risk_level", *[F.col(f"evidence.{f}").alias(f) for f in evidence.FIELDS])


@job
def s4_contact_log(v):
    """The log written as JSON maps of about MAP_ENTRIES entries at most, each of one city, and read back."""
    rows = v.contacts.join(v.users, "user_id").select("user_id", "contacted_on", "city")
    maps = -(-v.contacts.count() // MAP_ENTRIES) or 1  # enough for a city that has them all
    by_city = rows.groupBy("city", F.pmod(F.xxhash64("user_id"), F.lit(maps))).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("user_id").cast("string"), F.date_format("contacted_on", "yyyy-MM-dd"))))).alias("value"))
    return io.contacts_from_json(by_city)


@job
def s5_ranked_documents(v):
    top = k2_top_candidates(v).select("user_id", "full_name", "total_orders", "logins_prev", "logins_recent")
    return io.as_json_documents(top)


@job
def s6_report_lines(v):
    rows = signals(v).withColumn("top_factor", C.phrase(F.when(F.col("ticket_signal") == "UNHAPPY", "unresolved_ticket_rate").otherwise(F.col("review_signal"))))
    return report.lines(report.ranked(rows, TOP))


# -- joins -------------------------------------------------------------------------------------------------------------


@job
def j1_customer_facts(v):
    joined = features.with_facts(v.users, features.order_facts(v.orders), features.ticket_facts(v.tickets), features.review_facts(v.reviews))
    return r6(joined, "avg_order_value", "avg_review_rating")


@job
def j2_labels(v):
    return features.with_label(v.users.where(C.is_customer()).select("user_id"), v.truth)


@job
def j3_names(v):
    return r6(scoring.with_names(scored(v).select("user_id", "churn_probability"), v.users), "churn_probability")


@job
def j4_dormant(v):
    return activity.dormant(v.users, v.orders, AS_OF, DORMANT)


@job
def j5_without_recent_order(v):
    return activity.without_recent_order(v.users, v.orders, AS_OF, DORMANT)


@job
def j6_suppressed(v):
    return contacts.suppress(v.users.where(C.is_customer()).select("user_id"), v.contacts, AS_OF, 30)


@job
def j7_trend_of_shortlist(v):
    return activity.with_trend(v.contacts.select("user_id"), v.log, LOG_AS_OF, EARLIER, RECENT)


@job
def j8_claims(v):
    return evidence.checks(*claims(v))


@job
def j9_facts_of_label(v):
    by_user = v.reviews.groupBy("user_id", "rating").agg(F.count("*").alias("n"))
    return by_user.join(v.truth.select("user_id", "churned"), "user_id").groupBy("churned", "rating").agg(F.sum("n").alias("n"))


@job
def j10_truth_flags(v):
    flags = scored(v).where(C.over("churn_probability")).select("user_id", F.lit(True).alias("flagged"))
    return v.truth.select("user_id", "archetype").join(flags, "user_id", "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))


@job
def j11_factors(v):
    known = scored(v).where("unresolved_ticket_rate > 0").select("user_id", C.phrase(F.lit("unresolved_ticket_rate")).alias("top_factor"))
    return report.with_factor(signals(v), known).select("user_id", "top_factor")


# -- aggregates --------------------------------------------------------------------------------------------------------


@job
def a1_order_facts(v):
    return r6(features.order_facts(v.orders), "avg_order_value")


@job
def a2_ticket_facts(v):
    return features.ticket_facts(v.tickets)


@job
def a3_review_facts(v):
    return r6(features.review_facts(v.reviews), "avg_review_rating")


@job
def a4_login_trend(v):
    return activity.login_trend(v.log, LOG_AS_OF, EARLIER, RECENT)


@job
def a5_feature_table(v):
    return r6(feature_table(v), *C.FEATURES)


@job
def a6_evidence_facts(v):
    return true_facts(v, v.users.where(C.is_customer()))


@job
def a7_evidence_fidelity(v):
    return r6(evidence.fidelity(j8_claims(v)), "fidelity")


@job
def a7_mismatches(v):
    return evidence.mismatches(j8_claims(v)).drop("correct")


@job
def a8_agent_scores(v):
    return r6(evaluation.agent_scores(signals(v), v.truth), "precision", "recall", "f1")


@job
def a9_by_archetype(v):
    return r6(evaluation.by_archetype(v.truth, scored(v)), "rate")


@job
def a9_naive_dormancy(v):
    return r6(evaluation.naive_dormancy(v.truth, activity.without_recent_order(v.users, v.orders, AS_OF, DORMANT)), "rate")


@job
def a10_pooled_rates(v):
    return r6(causality.pooled_rates(v.truth, v.orders, v.tickets, v.reviews), "avg_rating", "cancel_rate", "unresolved_rate", "tickets_per_user")


@job
def a11_group_means(v):
    return r6(features.group_means(feature_table(v)), "mean_churned", "mean_active")


@job
def a12_row_counts(v):
    return contracts.row_counts({"users": v.users, "orders": v.orders, "tickets": v.tickets, "reviews": v.reviews, "log": v.log})


@job
def a13_order_span(v):
    return activity.order_span(v.orders)


@job
def a13_dormancy_headline(v):
    return activity.dormancy_headline(v.users, v.orders, AS_OF, DORMANT)


@job
def a14_label_mix(v):
    return evaluation.label_mix(v.truth)


@job
def a15_report_summary(v):
    return report.summary(signals(v))


@job
def a16_action_groups(v):
    ranked = signals(v).withColumns({"rank": F.lit(0), "top_factor": F.lit("-")})
    return r6(report.action_groups(ranked), "churn_probability").drop("rank", "top_factor")


@job
def a17_review_impact(v):
    return r6(evaluation.review_impact(reviewed(v), v.truth), "precision")


@job
def a18_confusion(v):
    return evaluation.confusion(scored(v))


@job
def a18_class_report(v):
    return r6(evaluation.class_report(scored(v)), "precision", "recall", "f1")


@job
def a19_roc_auc(v):
    """Two engines' exp() may differ in a score's last bits, which would make or break ties: 12 places stay."""
    return r6(evaluation.roc_auc(r12(scored(v), "churn_probability")), "auc")


@job
def a20_class_weight(v):
    return r6(evaluation.class_weight(feature_table(v)), "weight")


# -- windows, sorts, sets ----------------------------------------------------------------------------------------------


@job
def w1_report_rank(v):
    return report.ranked(signals(v), 100).select("rank", "user_id", "risk_level")


@job
def w2_newest_tickets(v):
    return verdict.newest_first(v.tickets, TICKET_TIES).select("user_id", "place", "order_id", "status", "created_at")


@job
def w2_newest_reviews(v):
    return verdict.newest_first(v.reviews, REVIEW_TIES).select("user_id", "place", "order_id", "rating", "created_at")


@job
def k1_quietest(v):
    return activity.quietest(v.users, v.orders, v.log, AS_OF, LOG_AS_OF, DORMANT, 10, EARLIER, RECENT)


@job
def k2_top_candidates(v):
    top = scoring.top_candidates(scored(v), v.users, v.log, v.contacts, AS_OF, LOG_AS_OF, TOP, 30, EARLIER, RECENT)
    shown = scoring.presented(top.withColumns({"churn_probability": F.round("churn_probability", 6), "priority_score": F.round("priority_score", 4)}))
    return shown.select("user_id", "full_name", "churn_probability", "avg_order_value", "priority_score", "total_orders", "logins_prev", "logins_recent")


@job
def k3_top_probability(v):
    return r6(scored(v).orderBy(F.desc("churn_probability"), "user_id").limit(3).select("user_id", "churn_probability"), "churn_probability")


@job
def u1_caught(v):
    return evaluation.caught(signals(v), v.truth)


@job
def u2_false_alarms(v):
    return evaluation.false_alarms(signals(v), v.truth)


@job
def u2_missed(v):
    return evaluation.missed(signals(v), v.truth)


@job
def u3_contact_upsert(v):
    return contacts.mark_contacted(v.contacts, v.users.where(F.col("user_id") % 7 == 0), date(2001, 8, 1))


@job
def u3_compacted_log(v):
    """The same from a log of a folder for each day, merged into a snapshot before and after the new day is added."""
    path = new_path(v.spark, "contacts")
    io.append_contacts(v.contacts, path)
    io.compact_contacts(v.spark, path)
    io.append_contacts(v.users.where(F.col("user_id") % 7 == 0).select("user_id", F.lit("2001-08-02").cast("date").alias("contacted_on")), path)
    io.compact_contacts(v.spark, path)
    return io.read_contacts(v.spark, path)


@job
def u4_recently_contacted(v):
    return contacts.recently_contacted(v.contacts, AS_OF, 30)


# -- scalar functions --------------------------------------------------------------------------------------------------


@job
def m2_priority(v):
    return scoring.prioritise(scored(v)).select("user_id", F.round("priority_score", 4).alias("priority_score"))


@job
def m4_redaction(v):
    call = F.concat(F.col("text"), F.lit(" call 9"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(" "))
    docs = v.table("documents").select("doc_id", call.alias("text"))
    clean = C.redact(F.col("text"))
    return docs.select("doc_id", F.md5(clean.cast("binary")).alias("clean_md5"), (clean != F.col("text")).alias("changed"))


@job
def m5_phrases(v):
    names = feature_table(v).unpivot(["user_id"], [*C.FEATURES, "churned"], "feature", "value")
    return names.groupBy("feature").agg(F.count("value").alias("n")).select(C.phrase(F.col("feature")).alias("phrase"), "n")


@job
def m7_winnability(v):
    return r6(v.truth.withColumn("winnability", C.winnability()).select("user_id", "winnability"), "winnability")


@job
def m8_incident(v):
    return r6(drift.incident(feature_table(v), SHOCK).select("user_id", *SHOCK), *SHOCK)


@job
def m9_percent_cells(v):
    return scored(v).select("user_id", C.percent("churn_probability").alias("cell"))


# -- split, drift, uplift, contracts, verdicts -------------------------------------------------------------------------


@job
def l1_split(v):
    from keepwell.operators.model import split

    return split(feature_table(v)).select("user_id", "churned", "is_test")


@job
def l1_exact_split(v):
    from keepwell.operators.model import split_exactly

    return split_exactly(feature_table(v)).select("user_id", "churned", "is_test")


def feature_rows(v: Views) -> DataFrame:
    """The feature table, written once for the jobs that read it several times."""
    return settle(feature_table(v), "features")


def halves(v: Views) -> tuple[DataFrame, DataFrame]:
    rows = feature_rows(v)
    return rows.where("user_id % 2 = 0"), rows.where("user_id % 2 = 1")


@job
def d1_psi(v):
    return r6(drift.stability(*halves(v)), "psi")


@job
def d2_drift_table(v):
    return r6(drift.drift_table(drift.stability(*halves(v))), "psi")


@job
def d2_from_stored_baseline(v):
    """The baseline's summary is written and read back; of the rest, new rows alone are read."""
    base, new = halves(v)
    path = new_path(v.spark, "baseline")
    drift.summarise(base).write.parquet(path)
    stored = v.spark.read.schema(drift.SUMMARY).parquet(path)
    return r6(drift.drift_table(drift.stability_from(stored, new)), "psi")


@job
def d3_drift_after_incident(v):
    rows = feature_rows(v)
    return r6(drift.drift_table(drift.stability(rows, drift.incident(rows, SHOCK))), "psi")


@job
def d3_retrain_verdict(v):
    rows = feature_rows(v)
    return drift.retrain_verdict(drift.drift_table(drift.stability(rows, drift.incident(rows, SHOCK))))


@job
def e1_arms(v):
    return uplift.assign_arms(v.truth).select("user_id", "arm")


@job
def e2_outcomes(v):
    return r6(uplift.with_outcome(uplift.assign_arms(v.truth)).select("user_id", "arm", "return_probability", "returned"), "return_probability")


@job
def e3_uplift(v):
    return r6(uplift.uplift(uplift.with_outcome(uplift.assign_arms(v.truth))), "rate_treatment", "rate_control", "uplift")


@job
def c1_violations(v):
    users = contracts.violations("users", v.users, required=("email", "city"))
    narrow = {"category": contracts.DOMAINS["support_tickets"]["category"], "priority": ("HIGH", "URGENT"), "status": ("RESOLVED", "CLOSED")}
    return users.unionByName(contracts.violations("support_tickets", v.tickets, narrow, {}, ())).unionByName(contracts.violations("reviews", v.reviews, {}, {"rating": (2, 5)}, ()))


def faulty(v: Views) -> dict[str, DataFrame]:
    """The six tables with faults planted in them."""
    tables = {"users": v.users, "products": v.products, "orders": v.orders, "auth_audit_log": v.log, "support_tickets": v.tickets, "reviews": v.reviews}
    return {n: t.withColumns({c: F.expr(e) for c, e in FAULTS[n].items()}) for n, t in tables.items()}


@job
def c1_all_rules(v):
    """Every rule of the six tables that the views' columns allow, each table in one pass."""
    return reduce(DataFrame.unionByName, [contracts.violations(n, t) for n, t in faulty(v).items()])


@job
def c1_while_reading(v):
    """The same counts, gathered while the profiles of all customers are worked out and the products are counted."""
    watch = contracts.Watch()
    t = {n: watch.over(n, rows) for n, rows in faulty(v).items()}
    trend = activity.login_trend(t["auth_audit_log"], LOG_AS_OF, EARLIER, RECENT)
    settle(features.profile(t["users"], t["orders"], t["support_tickets"], t["reviews"], trend), "profile")
    t["products"].agg(F.count("*")).collect()
    return watch.found(v.spark)


@job
def c2_duplicate_emails(v):
    return contracts.duplicates(v.users, "email")


@job
def c2_duplicate_reviews(v):
    return contracts.duplicates(v.reviews, "user_id", "product_id", "order_id")


@job
def c3_first_reviews(v):
    return contracts.first_reviews(v.reviews, ["created_at", "l_linenumber", "l_suppkey", "rating"]).select("user_id", "product_id", "order_id", "rating", "created_at")


@job
def c4_orphan_reviews(v):
    return contracts.orphans(v.reviews, "order_id", v.orders, "order_id").select("user_id", "product_id", "order_id", "rating", "created_at", "l_linenumber", "l_suppkey")


@job
def c4_orphan_references(v):
    """How many facts refer to nothing, for each reference: users, orders, products, and the supplier as a ticket's agent."""
    users, parts, agents = v.users, v.table("part"), v.table("supplier")
    references = [
        ("orders", v.orders, "user_id", users, "user_id"), ("tickets", v.tickets, "user_id", users, "user_id"), ("tickets", v.tickets, "order_id", v.orders, "order_id"), ("tickets", v.tickets, "l_suppkey", agents, "s_suppkey"),
        ("reviews", v.reviews, "user_id", users, "user_id"), ("reviews", v.reviews, "order_id", v.orders, "order_id"), ("reviews", v.reviews, "product_id", parts, "p_partkey"),
    ]
    return contracts.orphan_counts(references)


@job
def v1_ticket_signal(v):
    return verdict.ticket_signal(v.users.where(C.is_customer()), v.tickets)


@job
def v2_review_signal(v):
    return verdict.review_signal(v.users.where(C.is_customer()), v.reviews)


@job
def v3_risk_levels(v):
    return signals(v).select("user_id", "ticket_signal", "review_signal", "risk_level")


@job
def v4_actions(v):
    return signals(v).groupBy("risk_level", "suggested_action").agg(F.count("*").alias("n"))


@job
def v5_critic(v):
    return reviewed(v).select("user_id", "risk_level", "revised_level")


@job
def v6_dossiers(v):
    return verdict.dossiers(v.users.where(C.is_customer()), v.tickets, v.reviews, ["order_id", "category", "status", "description"], ["order_id", "rating"], (TICKET_TIES, REVIEW_TIES), 5, ("description",))


def as_query(f: Callable[[Views], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(Views(spark, sf_dir))


# -- model, explanation and streams: no SQL twin -----------------------------------------------------------------------


#: Where some split feature rows and their model were saved, by application and a digest of the rows: nine jobs fit it once.
FITTED: dict[tuple, tuple[str, str]] = {}


def fitted(v: Views):
    """The model and the split feature table, which are those of the first job on the same tables. The digest runs over all
    rows, so other tables under the same name are fitted anew. A mean of amounts has other last digits whenever it is added
    up in another order, so in its place the amounts themselves are digested."""
    from keepwell.operators import model, trees

    own = new_path(v.spark, "features")
    rows = settle(model.split(feature_table(v)), "features", own)
    digest = lambda t, *columns: t.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
    key = (v.spark.sparkContext.applicationId, *digest(rows, *[c for c in rows.columns if c != "avg_order_value"]), *digest(v.orders, "user_id", "total_amount"))
    if key in FITTED and all(exists(v.spark, p) for p in FITTED[key]):  # the shared folder may have been cleared
        remove(v.spark, own)
    else:
        path = new_path(v.spark, "model")
        trees.save(model.train(rows.where(~F.col("is_test"))), v.spark, path)
        FITTED[key] = path, own
    saved, features_path = FITTED[key]
    return trees.load(v.spark, saved), v.spark.read.schema(rows.schema).parquet(features_path)


def model_scored(v: Views) -> DataFrame:
    from keepwell.operators import model

    m, rows = fitted(v)
    return model.score(m, rows)


@job
def k2_model_candidates(v):
    """The candidate list on the fitted model's probabilities."""
    return scoring.presented(scoring.top_candidates(model_scored(v), v.users, v.log, v.contacts, AS_OF, LOG_AS_OF, TOP, 30, EARLIER, RECENT)).select("user_id", "full_name", "churn_probability", "avg_order_value", "priority_score", "total_orders", "logins_prev", "logins_recent")


@job
def a9_model_by_archetype(v):
    return evaluation.by_archetype(v.truth, model_scored(v))


@job
def l3_model_scores(v):
    from keepwell.operators import model

    m, rows = fitted(v)
    return model.score(m, rows).select("user_id", "is_test", "churn_probability")


@job
def l4_held_out_metrics(v):
    from keepwell.operators import model

    m, rows = fitted(v)
    return evaluation.metrics(model.score(m, rows.where("is_test")))


@job
def l4_feature_ablation(v):
    """The AUC without each feature in turn."""
    from keepwell.operators import model

    return model.ablation(settle(model.split(feature_table(v)), "features"))


@job
def l5_importances(v):
    from keepwell.operators import model

    return model.importances(fitted(v)[0], v.spark)


@job
def l6_attribution(v):
    from keepwell.operators import explain

    return explain.attribute(*fitted(v))


@job
def l7_top_factor(v):
    from keepwell.operators import explain

    return explain.top_factor(l6_attribution(v))


@job
def l8_global_importance(v):
    from keepwell.operators import explain

    return explain.global_importance(l6_attribution(v))


@job
def w3_strongest_factors(v):
    from keepwell.operators import explain

    return explain.strongest(l6_attribution(v), 4)


#: Slices of time that arrive one after the other, each as one micro-batch; files of a slice at least, and rows of a file at most.
SLICES, SLICE_FILES, FILE_ROWS = 3, 4, 2_000_000
REVIEW_STREAM = "user_id long, product_id long, order_id long, l_linenumber int, l_suppkey long, rating int, created_at timestamp_ntz"
REVIEWS_LATE = timedelta(days=90)


def _stream_of(v: Views, table: DataFrame, at: str, name: str, straggling: Column | None = None) -> tuple[DataFrame, str]:
    """A table that arrives in slices of time, read back as a stream; and a folder for the results. Straggling rows of any
    time arrive with the last slice."""
    from keepwell.streaming.jobs import read_stream

    root = new_path(v.spark, name)
    low, high, n = table.agg(F.min(at), F.max(at), F.count("*")).first()
    files = max(SLICE_FILES, -(-n // FILE_ROWS))  # enough for a slice that holds all rows
    straggles = F.lit(False) if straggling is None else F.coalesce(straggling, F.lit(False))
    for i in range(SLICES if low is not None else 0):
        begin, end = (low + (high - low) * j / SLICES for j in (i, i + 1))
        there = F.col(at) >= C.moment(begin)
        there = there & (F.col(at) < C.moment(end)) & ~straggles if i < SLICES - 1 else there | F.col(at).isNull() | straggles
        table.where(there).repartition(files).write.mode("append").parquet(f"{root}/in")
    schema = ", ".join(f"{n} {t}" for n, t in table.dtypes)
    return read_stream(v.spark, f"{root}/in", schema, files), root


def _daily_logins(v: Views) -> DataFrame:
    from keepwell.streaming import jobs as streams

    stream, root = _stream_of(v, v.log, "event_timestamp", "logins")
    streams.run_available(streams.daily_logins(stream), f"{root}/out", f"{root}/state")
    return v.spark.read.schema("user_id long, day timestamp_ntz, logins long").parquet(f"{root}/out")


@job
def r1_daily_logins(v):
    return _daily_logins(v)


@job
def r1_trend_from_days(v):
    """The login trend from the stream's closed days, with the border's day and the days still open from the stored log."""
    path = new_path(v.spark, "days")
    rollup.merge_days(_daily_logins(v), path)
    return rollup.trend_from_days(rollup.read_days(v.spark, path), fact_store(v, "log")["log"], LOG_AS_OF, EARLIER, RECENT)


@job
def r2_running_orders(v):
    from keepwell.streaming import jobs as streams

    stream, root = _stream_of(v, v.orders, "placed_at", "orders")
    streams.run_upserts(streams.running_orders(stream), f"{root}/out", f"{root}/state", "user_id", compact_every=2)
    return streams.latest(v.spark, f"{root}/out", "user_id", "user_id long, last_order timestamp_ntz, total_orders long")


def _review_stream(v: Views, straggling: Column | None = None) -> str:
    from keepwell.streaming import dedup
    from keepwell.streaming.jobs import REVIEW_KEY

    stream, root = _stream_of(v, v.reviews.select(*[c.split()[0] for c in REVIEW_STREAM.split(", ")]), "created_at", "reviews", straggling)
    dedup.run_first_of_each(stream, root, f"{root}/state", REVIEW_KEY, "created_at", REVIEWS_LATE, ("l_linenumber", "l_suppkey", "rating"), compact_every=2)
    return root


@job
def r3_first_reviews(v):
    """Reviews whose key was not seen within REVIEWS_LATE before."""
    from keepwell.streaming import dedup

    return dedup.passed(v.spark, _review_stream(v), REVIEW_STREAM).select("user_id", "product_id", "order_id", "rating", "created_at")


@job
def r3_dead_letters(v):
    """Reviews that arrive behind the watermark: those of every tenth user come with the last slice, whatever their time."""
    from keepwell.streaming import dedup

    return dedup.set_aside(v.spark, _review_stream(v, F.col("user_id") % 10 == 0), REVIEW_STREAM).select("user_id", "product_id", "order_id", "l_linenumber", "rating", "created_at", "reason")
