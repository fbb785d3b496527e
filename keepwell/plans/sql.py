"""DuckDB twins of the registered jobs. Each names the common table expressions it needs; with_ctes() puts them in front."""

from __future__ import annotations

import re

from keepwell.functions.columns import EMAIL, FEATURES, MOBILE, PHRASES
from keepwell.operators.evidence import FIELDS
from keepwell.sources.views import FAULTS, duck_ctes

AS_OF, LOG = "TIMESTAMP '2001-08-01 00:00:00'", "TIMESTAMP '2024-01-31 00:00:00'"
LOG_20, LOG_10 = "TIMESTAMP '2024-01-11 00:00:00'", "TIMESTAMP '2024-01-21 00:00:00'"
YEAR_AGO, MONTH_AGO = "TIMESTAMP '2000-08-01 00:00:00'", "TIMESTAMP '2001-07-02 00:00:00'"


def _hash(seed: str) -> str:
    return f"CAST('0x' || substr(md5(concat('{seed}:', CAST(user_id AS VARCHAR))), 1, 8) AS BIGINT) / 4294967296.0"


def _psi(base: str, new: str) -> str:
    """psi by feature of two long tables (feature, value)."""
    return f"""
pb AS ({base}), pn AS ({new}),
cuts AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS c FROM pb GROUP BY feature),
binned AS (SELECT feature, side, len(list_filter(c[2:len(c) - 1], lambda x: x <= value)) AS bin, len(c) AS n_cuts
  FROM (SELECT feature, value, 'b' AS side FROM pb UNION ALL SELECT feature, value, 'n' FROM pn) JOIN cuts USING (feature)),
tot AS (SELECT feature, count(*) FILTER (side = 'b') AS tb, count(*) FILTER (side = 'n') AS tn, max(n_cuts) AS k FROM binned GROUP BY feature),
shares AS (SELECT feature, bin, count(*) FILTER (side = 'b') / tb + 1e-6 AS b, count(*) FILTER (side = 'n') / tn + 1e-6 AS n
  FROM binned JOIN tot USING (feature) WHERE k >= 2 AND tb > 0 AND tn > 0 GROUP BY feature, bin, tb, tn),
psis AS (SELECT feature, round(sum((n - b) * ln(n / b)), 6) AS psi FROM shares GROUP BY feature)"""


def _long(table: str, where: str = "true", change: dict[str, str] | None = None) -> str:
    change = change or {}
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({change.get(c, c)} AS DOUBLE) AS value FROM {table} WHERE {c} IS NOT NULL AND {where}" for c in FEATURES)


def _all_rules() -> str:
    """table, rule, violations of the tables with planted faults."""
    out = []
    for name, view, domains, required in (
        ("users", "v_users", {"user_type": ("CUSTOMER", "DELIVERY_PARTNER", "ADMIN", "SUPPORT_AGENT"), "account_status": ("ACTIVE", "INACTIVE", "SUSPENDED", "DELETED")}, ("full_name", "email", "phone_number", "user_type", "account_status")),
        ("products", "v_products", {}, ("product_name", "price")),
        ("orders", "v_orders", {"order_status": ("PLACED", "PACKED", "OUT_FOR_DELIVERY", "DELIVERED", "CANCELLED")}, ("user_id", "order_status", "total_amount", "placed_at")),
        ("auth_audit_log", "v_auth_log", {"event_type": ("LOGIN", "LOGOUT", "LOGIN_FAILED", "PASSWORD_RESET"), "event_status": ("SUCCESS", "FAILED")}, ("user_id", "event_type", "event_status", "event_timestamp")),
        ("support_tickets", "v_tickets", {"category": ("ORDER_ISSUE", "PAYMENT", "DELIVERY_DELAY", "PRODUCT_QUALITY", "REFUND", "APP_ISSUE", "OTHER"), "priority": ("LOW", "MEDIUM", "HIGH", "URGENT"), "status": ("OPEN", "IN_PROGRESS", "WAITING_ON_CUSTOMER", "RESOLVED", "CLOSED")}, ("user_id", "description", "category", "priority", "status", "created_at")),
        ("reviews", "v_reviews", {}, ("user_id", "product_id", "rating", "created_at")),
    ):
        faulty = f"(SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in FAULTS[name].items())}) FROM {view})"
        tests = {f"{c} in domain": f"{c} NOT IN ({', '.join(repr(x) for x in values)})" for c, values in domains.items()} | {f"{c} not null": f"{c} IS NULL" for c in required}
        tests |= {"rating in 1..5": "rating NOT BETWEEN 1 AND 5"} if name == "reviews" else {}
        out += [f"SELECT '{name}' AS \"table\", '{rule}' AS rule, count(*) FILTER ({broken}) AS violations FROM {faulty}" for rule, broken in tests.items()]
    return " UNION ALL ".join(out)


VERDICT = "CASE WHEN psi > 0.2 THEN 'DRIFT' WHEN psi > 0.1 THEN 'small shift' ELSE 'stable' END"
SHOCK = {"cancellation_rate": "least(1.0, cancellation_rate + 0.2)", "unresolved_ticket_rate": "least(1.0, unresolved_ticket_rate + 0.15)"}
TICKET_ORDER = "created_at DESC, order_id, l_linenumber, l_suppkey, l_partkey, category, priority, status"
REVIEW_ORDER = "created_at DESC, order_id, l_linenumber, l_suppkey, product_id, rating"
ARCHETYPES = "(VALUES (1, 'cliff_dropper', 'yes', 'recall'), (2, 'gradual_fader', 'yes', 'recall'), (3, 'vacationer', 'NO (trap)', 'false-alarm'), (4, 'loyal_bulk_buyer', 'NO (trap)', 'false-alarm'), (5, 'regular_active', 'no', 'false-alarm')) AS x(place, archetype, churned, meaning)"
OPEN = "('OPEN', 'IN_PROGRESS', 'WAITING_ON_CUSTOMER')"
WIN = "least(0.6, greatest(0.0, 0.35 * support_pain + 0.25 * delivery_pain - 0.20 * pickiness))"

#: name -> body; a body may name tables, views and other entries that stand before it.
CTES: dict[str, str] = {
    **duck_ctes(),
    "customers": "SELECT * FROM v_users WHERE user_type = 'CUSTOMER'",
    "o": "SELECT user_id, count(*) AS total_orders, avg(total_amount) AS avg_order_value, count(*) FILTER (order_status = 'CANCELLED') AS cancelled FROM v_orders GROUP BY 1",
    "t": f"SELECT user_id, count(*) AS total_tickets, count(*) FILTER (status IN {OPEN}) AS unresolved FROM v_tickets GROUP BY 1",
    "r": "SELECT user_id, avg(rating) AS avg_review_rating, count(*) AS total_reviews, count(*) FILTER (rating <= 2) AS low_reviews FROM v_reviews GROUP BY 1",
    "f0": """SELECT user_id, coalesce(total_orders, 0) AS total_orders, coalesce(cancelled, 0) AS cancelled, coalesce(total_tickets, 0) AS total_tickets,
  coalesce(unresolved, 0) AS unresolved, coalesce(total_reviews, 0) AS total_reviews, coalesce(low_reviews, 0) AS low_reviews, avg_order_value, avg_review_rating
FROM customers LEFT JOIN o USING (user_id) LEFT JOIN t USING (user_id) LEFT JOIN r USING (user_id)""",
    "f": """SELECT f0.*, cancelled / greatest(total_orders, 1) AS cancellation_rate, unresolved / greatest(total_tickets, 1) AS unresolved_ticket_rate,
  total_tickets / greatest(total_orders, 1) AS tickets_per_order, low_reviews / greatest(total_reviews, 1) AS pct_low_reviews, coalesce(v_truth.churned::INT, 0) AS churned
FROM f0 LEFT JOIN v_truth USING (user_id)""",
    "s": """SELECT *, 1 / (1 + exp(-(-1.0123 + 3 * cancellation_rate + 2 * unresolved_ticket_rate + 1.5 * pct_low_reviews + 0.5 * tickets_per_order - 0.3 * coalesce(avg_review_rating, 3)))) AS p FROM f""",
    "trend": f"""SELECT user_id, count(*) FILTER (event_timestamp <= {LOG_10}) AS logins_prev, count(*) FILTER (event_timestamp >= {LOG_10}) AS logins_recent
FROM v_auth_log WHERE event_type = 'LOGIN' AND event_timestamp >= {LOG_20} GROUP BY 1""",
    "last_orders": "SELECT user_id, max(placed_at) AS last_order, count(*) AS total_orders FROM v_orders GROUP BY 1",
    "dormant": f"SELECT user_id, full_name, city, last_order, coalesce(total_orders, 0) AS total_orders FROM customers LEFT JOIN last_orders USING (user_id) WHERE last_order IS NULL OR last_order < {YEAR_AGO}",
    "recent_contacts": f"SELECT user_id FROM (SELECT user_id, max(contacted_on) AS d FROM v_contacted GROUP BY 1) WHERE d::TIMESTAMP >= {MONTH_AGO}",
    "facts": """SELECT user_id, coalesce(logins_prev, 0) AS logins_prev_30_60d, coalesce(logins_recent, 0) AS logins_recent_30d, coalesce(o.total_orders, 0) AS total_orders,
  coalesce(t.total_tickets, 0) AS total_tickets, coalesce(worst, 0)::BIGINT AS worst_review_rating
FROM v_users LEFT JOIN trend USING (user_id) LEFT JOIN o USING (user_id) LEFT JOIN t USING (user_id)
LEFT JOIN (SELECT user_id, min(rating) AS worst FROM v_reviews GROUP BY 1) USING (user_id)""",
    "ts": f"""SELECT user_id, CASE WHEN n IS NULL THEN 'NONE' WHEN bad > 0 THEN 'UNHAPPY' ELSE 'FINE' END AS ticket_signal FROM customers LEFT JOIN (
  SELECT user_id, count(*) AS n, count(*) FILTER (status IN {OPEN} OR category IN ('REFUND', 'DELIVERY_DELAY', 'PAYMENT')) AS bad FROM v_tickets GROUP BY 1) USING (user_id)""",
    "rs": """SELECT user_id, CASE WHEN worst IS NULL THEN 'SILENT' WHEN worst <= 2 THEN 'UNHAPPY' ELSE 'FINE' END AS review_signal FROM customers LEFT JOIN (
  SELECT user_id, min(rating) AS worst FROM v_reviews GROUP BY 1) USING (user_id)""",
    "lv": """SELECT s.user_id, full_name, p, ticket_signal, review_signal,
  CASE WHEN p >= 0.5 AND (ticket_signal = 'UNHAPPY' OR review_signal IN ('UNHAPPY', 'SILENT')) THEN 'HIGH'
       WHEN p < 0.5 AND (ticket_signal = 'UNHAPPY' OR review_signal = 'UNHAPPY') THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
FROM s JOIN ts USING (user_id) JOIN rs USING (user_id) JOIN customers USING (user_id)""",
    "sig": "SELECT *, CASE risk_level WHEN 'HIGH' THEN 'retention call' WHEN 'MEDIUM' THEN 'send coupon' ELSE 'ignore' END AS suggested_action FROM lv",
    "claims": """SELECT user_id, risk_level, logins_prev_30_60d, logins_recent_30d, total_orders + CASE WHEN user_id % 17 = 0 THEN 1 ELSE 0 END AS total_orders, total_tickets,
  CASE WHEN user_id % 19 <> 0 THEN worst_review_rating END AS worst_review_rating FROM sig JOIN facts USING (user_id)""",
    "checks": " UNION ALL ".join(f"SELECT c.user_id, '{x}' AS field, c.{x} AS claimed, facts.{x} AS actual, c.{x} IS NOT DISTINCT FROM facts.{x} AS correct FROM claims c JOIN facts USING (user_id)" for x in FIELDS),
    "rev": """SELECT user_id, risk_level, CASE WHEN (logins_prev_30_60d > 0 AND logins_recent_30d >= 0.8 * logins_prev_30_60d) OR (total_tickets = 0 AND worst_review_rating >= 4)
  THEN CASE risk_level WHEN 'HIGH' THEN 'MEDIUM' ELSE 'LOW' END ELSE risk_level END AS revised_level FROM sig JOIN facts USING (user_id)""",
    "flagged": "SELECT DISTINCT user_id FROM sig WHERE risk_level IN ('HIGH', 'MEDIUM')",
    "churners": "SELECT DISTINCT user_id FROM v_truth WHERE churned",
    "cm": "SELECT count(*) FILTER (churned = 0 AND p < 0.5) AS tn, count(*) FILTER (churned = 0 AND p >= 0.5) AS fp, count(*) FILTER (churned = 1 AND p < 0.5) AS fn, count(*) FILTER (churned = 1 AND p >= 0.5) AS tp FROM s",
    "arms": f"SELECT *, CASE WHEN {_hash('arms')} < 0.7 THEN 'treatment' ELSE 'control' END AS arm FROM v_truth WHERE churned",
    "outcomes": f"SELECT user_id, arm, rp, CASE WHEN {_hash('outcome')} < rp THEN 1 ELSE 0 END AS returned FROM (SELECT *, 0.08 + CASE WHEN arm = 'treatment' THEN {WIN} ELSE 0 END AS rp FROM arms)",
    "top15": f"""SELECT user_id, round(p, 6) AS p6, avg_order_value, round(p * avg_order_value, 4) AS pr, p * avg_order_value AS raw, total_orders FROM s
  WHERE user_id NOT IN (SELECT user_id FROM recent_contacts) ORDER BY raw DESC NULLS LAST, user_id LIMIT 15""",
}

_R6 = lambda c: f"round({c}, 6) AS {c}"
_COUNTS = "total_orders, cancelled, total_tickets, unresolved, total_reviews, low_reviews"

BODIES: dict[str, str] = {
    "p1_customers": "SELECT user_id, full_name FROM customers",
    "p2_active_roster": "SELECT user_id, CASE WHEN user_type = 'SUPPORT_AGENT' THEN 'agent' ELSE 'customer' END AS roster FROM v_users WHERE user_type = 'SUPPORT_AGENT' OR (user_type = 'CUSTOMER' AND account_status = 'ACTIVE')",
    "p3_flagged_verdicts": "SELECT user_id, risk_level FROM sig WHERE risk_level IN ('HIGH', 'MEDIUM')",
    "p4_model_flags": "SELECT user_id, p > 0.5 AS flag_strict, p >= 0.5 AS flag_inclusive FROM s",
    "p5_action_mentions": "SELECT user_id, contains(lower(suggested_action), 'call') AS is_call, contains(lower(suggested_action), 'coupon') AS is_coupon FROM sig",
    "p6_ticket_lookup": "SELECT user_id, order_id, l_linenumber, l_suppkey, l_partkey, category, priority, status, created_at FROM v_tickets WHERE user_id IN (SELECT user_id FROM v_contacted)",
    "p6_review_lookup": "SELECT user_id, order_id, l_linenumber, l_suppkey, product_id, rating, created_at FROM v_reviews WHERE user_id IN (SELECT user_id FROM v_contacted)",
    "s6_report_lines": """SELECT rank, '| ' || rank || ' | ' || full_name || ' (#' || user_id || ') | ' || risk_level || ' | ' || printf('%.0f%%', p * 100) || ' | '
  || CASE WHEN ticket_signal = 'UNHAPPY' THEN 'unresolved support tickets' ELSE review_signal END || ' | ' || suggested_action || ' |' AS line
FROM (SELECT *, (row_number() OVER (ORDER BY p DESC, user_id))::INT AS rank FROM sig) WHERE rank <= 15""",
    "s1_store_features": f"SELECT user_id, {_COUNTS}, {', '.join(map(_R6, FEATURES))}, churned FROM f",
    "s1_store_trend": "SELECT * FROM trend",
    "s3_nested_predictions": f"SELECT user_id, risk_level, {', '.join(FIELDS)} FROM claims",
    "s4_contact_log": "SELECT user_id, contacted_on FROM v_contacted JOIN v_users USING (user_id)",
    "s5_ranked_documents": """SELECT '{"user_id":' || user_id || ',"full_name":"' || full_name || '","total_orders":' || total_orders || ',"logins_prev":' || coalesce(logins_prev, 0) || ',"logins_recent":' || coalesce(logins_recent, 0) || '}' AS document
FROM top15 JOIN customers USING (user_id) LEFT JOIN trend USING (user_id)""",
    "j1_customer_facts": "SELECT user_id, total_orders, round(avg_order_value, 6) AS avg_order_value, cancelled, total_tickets, unresolved, round(avg_review_rating, 6) AS avg_review_rating, total_reviews, low_reviews FROM customers LEFT JOIN o USING (user_id) LEFT JOIN t USING (user_id) LEFT JOIN r USING (user_id)",
    "j2_labels": "SELECT user_id, churned FROM f",
    "j3_names": "SELECT user_id, round(p, 6) AS churn_probability, full_name FROM s JOIN customers USING (user_id)",
    "j4_dormant": "SELECT * FROM dormant",
    "j5_without_recent_order": f"SELECT user_id FROM customers c WHERE NOT EXISTS (SELECT 1 FROM v_orders x WHERE x.user_id = c.user_id AND placed_at >= {YEAR_AGO})",
    "j6_suppressed": "SELECT user_id FROM customers WHERE user_id NOT IN (SELECT user_id FROM recent_contacts)",
    "j7_trend_of_shortlist": "SELECT user_id, coalesce(logins_prev, 0) AS logins_prev, coalesce(logins_recent, 0) AS logins_recent FROM v_contacted LEFT JOIN trend USING (user_id)",
    "j8_claims": "SELECT * FROM checks",
    "j9_facts_of_label": "SELECT churned, rating, count(*) AS n FROM v_reviews JOIN v_truth USING (user_id) GROUP BY 1, 2",
    "j10_truth_flags": "SELECT user_id, archetype, coalesce(p > 0.5, false) AS flagged FROM v_truth LEFT JOIN s USING (user_id)",
    "j11_factors": "SELECT user_id, CASE WHEN unresolved_ticket_rate > 0 THEN 'unresolved support tickets' ELSE '-' END AS top_factor FROM f",
    "a1_order_facts": "SELECT user_id, total_orders, round(avg_order_value, 6) AS avg_order_value, cancelled FROM o",
    "a2_ticket_facts": "SELECT * FROM t",
    "a3_review_facts": "SELECT user_id, round(avg_review_rating, 6) AS avg_review_rating, total_reviews, low_reviews FROM r",
    "a4_login_trend": "SELECT * FROM trend",
    "a5_feature_table": f"SELECT user_id, {_COUNTS}, {', '.join(map(_R6, FEATURES))}, churned FROM f",
    "a6_evidence_facts": "SELECT facts.* FROM facts JOIN customers USING (user_id)",
    "a7_evidence_fidelity": "SELECT count(DISTINCT user_id) AS users_checked, count(*) AS fields_checked, count(*) FILTER (correct) AS fields_correct, count(DISTINCT user_id) FILTER (NOT correct) AS users_with_errors, round(count(*) FILTER (correct) / count(*), 6) AS fidelity FROM checks",
    "a7_mismatches": "SELECT user_id, field, claimed, actual FROM checks WHERE NOT correct",
    "a8_agent_scores": """SELECT tp, fp, fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1 FROM (
  SELECT tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re FROM (
    SELECT count(*) FILTER (a.user_id IS NOT NULL AND b.user_id IS NOT NULL) AS tp, count(*) FILTER (b.user_id IS NULL) AS fp, count(*) FILTER (a.user_id IS NULL) AS fn
    FROM flagged a FULL JOIN churners b ON a.user_id = b.user_id))""",
    "a9_by_archetype": f"SELECT place::INT AS place, archetype, x.churned, count(*) AS n, count(*) FILTER (p > 0.5) AS flagged, round(count(*) FILTER (p > 0.5) / count(*), 6) AS rate, meaning FROM v_truth JOIN {ARCHETYPES} USING (archetype) LEFT JOIN s USING (user_id) GROUP BY place, archetype, x.churned, meaning",
    "a9_naive_dormancy": f"SELECT place::INT AS place, archetype, x.churned, count(*) AS n, count(dormant.user_id) AS flagged, round(count(dormant.user_id) / count(*), 6) AS rate, meaning FROM v_truth JOIN {ARCHETYPES} USING (archetype) LEFT JOIN dormant ON v_truth.user_id = dormant.user_id GROUP BY place, archetype, x.churned, meaning",
    "a10_pooled_rates": f"""SELECT churned, users, round(avg_rating, 6) AS avg_rating, round(c / o_, 6) AS cancel_rate, round(u / t_, 6) AS unresolved_rate, round(coalesce(t_, 0) / users, 6) AS tickets_per_user
FROM (SELECT churned, count(*) AS users FROM v_truth GROUP BY 1)
LEFT JOIN (SELECT churned, avg(rating) AS avg_rating FROM v_reviews JOIN v_truth USING (user_id) GROUP BY 1) USING (churned)
LEFT JOIN (SELECT churned, count(*) FILTER (order_status = 'CANCELLED') AS c, count(*) AS o_ FROM v_orders JOIN v_truth USING (user_id) GROUP BY 1) USING (churned)
LEFT JOIN (SELECT churned, count(*) FILTER (status IN {OPEN}) AS u, count(*) AS t_ FROM v_tickets JOIN v_truth USING (user_id) GROUP BY 1) USING (churned)""",
    "a11_group_means": " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}) FILTER (churned = 1), 6) AS mean_churned, round(avg({c}) FILTER (churned = 0), 6) AS mean_active FROM f" for c in FEATURES),
    "a12_row_counts": " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS rows FROM {t}" for n, t in (("users", "v_users"), ("orders", "v_orders"), ("tickets", "v_tickets"), ("reviews", "v_reviews"), ("log", "v_auth_log"))),
    "a13_order_span": "SELECT min(placed_at) AS first_order, max(placed_at) AS last_order FROM v_orders",
    "a13_dormancy_headline": "SELECT (SELECT count(*) FROM dormant) AS dormant, (SELECT count(*) FROM customers) AS customers",
    "a14_label_mix": "SELECT archetype, count(*) AS customers, count(*) FILTER (churned) AS churned FROM v_truth GROUP BY archetype UNION ALL SELECT NULL, count(*), count(*) FILTER (churned) FROM v_truth",
    "a15_report_summary": "SELECT count(*) AS customers, count(*) FILTER (risk_level = 'HIGH') AS high, count(*) FILTER (risk_level = 'MEDIUM') AS medium, count(*) FILTER (contains(suggested_action, 'call')) AS calls FROM sig",
    "a16_action_groups": """SELECT action, user_id, full_name, round(p, 6) AS churn_probability, count(*) OVER (PARTITION BY action) AS members FROM (
  SELECT 'Retention calls' AS action, * FROM sig WHERE contains(suggested_action, 'call') UNION ALL SELECT 'Coupons', * FROM sig WHERE contains(suggested_action, 'coupon'))""",
    "a17_review_impact": """SELECT step, tp, flagged, round(CASE WHEN flagged > 0 THEN tp / flagged ELSE 0 END, 6) AS precision FROM (
  SELECT 'before' AS step, count(*) FILTER (user_id IN (SELECT user_id FROM churners)) AS tp, count(*) AS flagged FROM rev WHERE risk_level IN ('HIGH', 'MEDIUM')
  UNION ALL SELECT 'after', count(*) FILTER (user_id IN (SELECT user_id FROM churners)), count(*) FROM rev WHERE revised_level IN ('HIGH', 'MEDIUM'))""",
    "a18_confusion": "SELECT * FROM cm",
    "a18_class_report": """SELECT "class", round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (
  WITH one AS (SELECT '0' AS "class", tn AS hit, tn + fn AS said, tn + fp AS support FROM cm UNION ALL SELECT '1', tp, tp + fp, tp + fn FROM cm),
  two AS (SELECT "class", support, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall FROM one),
  three AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM two)
  SELECT "class", precision, recall, f1, support FROM three
  UNION ALL SELECT 'accuracy', (tn + tp) / (tn + fp + fn + tp), (tn + tp) / (tn + fp + fn + tp), (tn + tp) / (tn + fp + fn + tp), tn + fp + fn + tp FROM cm
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM three
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM three)""",
    "a19_roc_auc": """SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM (
  SELECT pos, neg, sum(neg) OVER (ORDER BY q) - neg AS below FROM (SELECT round(p, 12) AS q, count(*) FILTER (churned = 1) AS pos, count(*) FILTER (churned = 0) AS neg FROM s GROUP BY 1))""",
    "a20_class_weight": "SELECT neg, pos, round(neg / pos, 6) AS weight FROM (SELECT count(*) FILTER (churned = 0) AS neg, count(*) FILTER (churned = 1) AS pos FROM f)",
    "w1_report_rank": "SELECT (row_number() OVER (ORDER BY p DESC, user_id))::INT AS rank, user_id, risk_level FROM sig ORDER BY p DESC, user_id LIMIT 100",
    "w2_newest_tickets": f"SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY {TICKET_ORDER}))::INT AS place, order_id, status, created_at FROM v_tickets",
    "w2_newest_reviews": f"SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY {REVIEW_ORDER}))::INT AS place, order_id, rating, created_at FROM v_reviews",
    "k1_quietest": "SELECT d.*, coalesce(logins_prev, 0) AS logins_prev, coalesce(logins_recent, 0) AS logins_recent FROM (SELECT * FROM dormant ORDER BY last_order NULLS FIRST, user_id LIMIT 10) d LEFT JOIN trend USING (user_id)",
    "k2_top_candidates": "SELECT user_id, full_name, round(p6, 3) AS churn_probability, round(avg_order_value, 2) AS avg_order_value, round(pr, 2) AS priority_score, total_orders, coalesce(logins_prev, 0) AS logins_prev, coalesce(logins_recent, 0) AS logins_recent FROM top15 JOIN customers USING (user_id) LEFT JOIN trend USING (user_id)",
    "k3_top_probability": "SELECT user_id, round(p, 6) AS churn_probability FROM s ORDER BY p DESC, user_id LIMIT 3",
    "u1_caught": "SELECT user_id FROM flagged INTERSECT SELECT user_id FROM churners",
    "u2_false_alarms": "SELECT user_id FROM flagged EXCEPT SELECT user_id FROM churners",
    "u2_missed": "SELECT user_id FROM churners EXCEPT SELECT user_id FROM flagged",
    "u3_contact_upsert": "SELECT user_id, max(contacted_on) AS contacted_on FROM (SELECT * FROM v_contacted UNION ALL SELECT user_id, DATE '2001-08-01' FROM v_users WHERE user_id % 7 = 0) GROUP BY 1",
    "u3_compacted_log": "SELECT user_id, max(contacted_on) AS contacted_on FROM (SELECT * FROM v_contacted UNION ALL SELECT user_id, DATE '2001-08-02' FROM v_users WHERE user_id % 7 = 0) GROUP BY 1",
    "u4_recently_contacted": "SELECT user_id FROM recent_contacts",
    "m2_priority": "SELECT user_id, round(p * avg_order_value, 4) AS priority_score FROM s",
    "m4_redaction": r"""SELECT doc_id, md5(clean) AS clean_md5, clean <> txt AS changed FROM (
  SELECT doc_id, txt, regexp_replace(regexp_replace(txt, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '\b[6-9]\d{9}\b', '[PHONE]', 'g') AS clean
  FROM (SELECT doc_id, text || ' call 9' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || ' ' AS txt FROM documents))""",
    "m5_phrases": " UNION ALL ".join(f"SELECT '{phrase}' AS phrase, count({c}) AS n FROM f" for c, phrase in (*PHRASES.items(), ("churned", "churned"))),
    "m7_winnability": f"SELECT user_id, round({WIN}, 6) AS winnability FROM v_truth",
    "m8_incident": f"SELECT user_id, round({SHOCK['cancellation_rate']}, 6) AS cancellation_rate, round({SHOCK['unresolved_ticket_rate']}, 6) AS unresolved_ticket_rate FROM f",
    "m9_percent_cells": "SELECT user_id, printf('%.0f%%', p * 100) AS cell FROM s",
    "l1_split": "SELECT user_id, churned, substr(md5(concat('split:', CAST(user_id AS VARCHAR))), 1, 8) < '40000000' AS is_test FROM f",
    "l1_exact_split": "SELECT user_id, churned, row_number() OVER (PARTITION BY churned ORDER BY md5(concat('split:', CAST(user_id AS VARCHAR))), user_id) <= floor(count(*) OVER (PARTITION BY churned) * 0.25 + 0.5) AS is_test FROM f",
    "r1_daily_logins": """SELECT user_id, date_trunc('day', event_timestamp)::TIMESTAMP AS day, count(*) AS logins FROM v_auth_log WHERE event_type = 'LOGIN'
  AND date_trunc('day', event_timestamp) + INTERVAL 2 DAY <= (SELECT max(event_timestamp) FROM v_auth_log WHERE event_type = 'LOGIN') GROUP BY 1, 2""",
    "r2_running_orders": "SELECT * FROM last_orders",
    "r1_trend_from_days": "SELECT * FROM trend",
    "r3_first_reviews": """SELECT user_id, product_id, order_id, rating, created_at FROM (
  SELECT *, lag(created_at) OVER (PARTITION BY user_id, product_id, order_id ORDER BY created_at, l_linenumber, l_suppkey, rating) AS before FROM v_reviews)
WHERE before IS NULL OR created_at > before + INTERVAL 90 DAY""",
    "r3_dead_letters": """SELECT user_id, product_id, order_id, l_linenumber, rating, created_at, 'late' AS reason FROM v_reviews, (
  SELECT cut, max(created_at) FILTER (user_id % 10 <> 0 AND created_at < cut) - INTERVAL 90 DAY AS horizon FROM v_reviews,
    (SELECT make_timestamp(epoch_us(min(created_at)) + (epoch_us(max(created_at)) - epoch_us(min(created_at))) * 2 // 3) AS cut FROM v_reviews) GROUP BY cut)
WHERE user_id % 10 = 0 AND created_at < least(cut, horizon)""",
    "d1_psi": "WITH_PSI " + _psi(_long("f", "user_id % 2 = 0"), _long("f", "user_id % 2 = 1")) + " SELECT feature, coalesce(psi, 0) AS psi FROM psis",
    "d2_drift_table": "WITH_PSI " + _psi(_long("f", "user_id % 2 = 0"), _long("f", "user_id % 2 = 1")) + f" SELECT feature, psi, {VERDICT} AS verdict FROM psis",
    "d2_from_stored_baseline": "WITH_PSI " + _psi(_long("f", "user_id % 2 = 0"), _long("f", "user_id % 2 = 1")) + f" SELECT feature, psi, {VERDICT} AS verdict FROM psis",
    "d3_drift_after_incident": "WITH_PSI " + _psi(_long("f"), _long("f", change=SHOCK)) + f" SELECT feature, psi, {VERDICT} AS verdict FROM psis",
    "d3_retrain_verdict": "WITH_PSI " + _psi(_long("f"), _long("f", change=SHOCK)) + " SELECT count(*) AS n_drifted, coalesce(string_agg(feature, ',' ORDER BY feature), '') AS drifted, count(*) > 0 AS retrain FROM psis WHERE psi > 0.2",
    "e1_arms": "SELECT user_id, arm FROM arms",
    "e2_outcomes": "SELECT user_id, arm, round(rp, 6) AS return_probability, returned FROM outcomes",
    "e3_uplift": """SELECT nt AS n_treatment, rt AS returned_treatment, nc AS n_control, rc AS returned_control, round(rt / nt, 6) AS rate_treatment, round(rc / nc, 6) AS rate_control, round(rt / nt - rc / nc, 6) AS uplift FROM (
  SELECT count(*) FILTER (arm = 'treatment') AS nt, count(*) FILTER (arm = 'treatment' AND returned = 1) AS rt, count(*) FILTER (arm = 'control') AS nc, count(*) FILTER (arm = 'control' AND returned = 1) AS rc FROM outcomes)""",
    "c1_violations": """SELECT 'users' AS "table", 'user_type in domain' AS rule, count(*) FILTER (user_type NOT IN ('CUSTOMER', 'DELIVERY_PARTNER', 'ADMIN', 'SUPPORT_AGENT')) AS violations FROM v_users
UNION ALL SELECT 'users', 'account_status in domain', count(*) FILTER (account_status NOT IN ('ACTIVE', 'INACTIVE', 'SUSPENDED', 'DELETED')) FROM v_users
UNION ALL SELECT 'users', 'email not null', count(*) FILTER (email IS NULL) FROM v_users
UNION ALL SELECT 'users', 'city not null', count(*) FILTER (city IS NULL) FROM v_users
UNION ALL SELECT 'support_tickets', 'category in domain', count(*) FILTER (category NOT IN ('ORDER_ISSUE', 'PAYMENT', 'DELIVERY_DELAY', 'PRODUCT_QUALITY', 'REFUND', 'APP_ISSUE', 'OTHER')) FROM v_tickets
UNION ALL SELECT 'support_tickets', 'priority in domain', count(*) FILTER (priority NOT IN ('HIGH', 'URGENT')) FROM v_tickets
UNION ALL SELECT 'support_tickets', 'status in domain', count(*) FILTER (status NOT IN ('RESOLVED', 'CLOSED')) FROM v_tickets
UNION ALL SELECT 'reviews', 'rating in 2..5', count(*) FILTER (rating NOT BETWEEN 2 AND 5) FROM v_reviews""",
    "c1_all_rules": _all_rules(),
    "c1_while_reading": _all_rules(),
    "c2_duplicate_emails": "SELECT email, count(*) AS n FROM v_users GROUP BY 1 HAVING count(*) > 1",
    "c2_duplicate_reviews": "SELECT user_id, product_id, order_id, count(*) AS n FROM v_reviews GROUP BY ALL HAVING count(*) > 1",
    "c3_first_reviews": "SELECT user_id, product_id, order_id, rating, created_at FROM v_reviews QUALIFY row_number() OVER (PARTITION BY user_id, product_id, order_id ORDER BY created_at, l_linenumber, l_suppkey, rating) = 1",
    "c4_orphan_reviews": "SELECT user_id, product_id, order_id, rating, created_at, l_linenumber, l_suppkey FROM v_reviews WHERE order_id NOT IN (SELECT order_id FROM v_orders)",
    "c4_orphan_references": " UNION ALL ".join(
        f"SELECT '{t.removeprefix('v_')}' AS \"table\", '{c}' AS reference, count(*) AS orphans FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {k} FROM {to})"
        for t, c, to, k in (("v_orders", "user_id", "v_users", "user_id"), ("v_tickets", "user_id", "v_users", "user_id"), ("v_tickets", "order_id", "v_orders", "order_id"), ("v_tickets", "l_suppkey", "supplier", "s_suppkey"), ("v_reviews", "user_id", "v_users", "user_id"), ("v_reviews", "order_id", "v_orders", "order_id"), ("v_reviews", "product_id", "part", "p_partkey"))
    ),
    "v1_ticket_signal": "SELECT * FROM ts",
    "v2_review_signal": "SELECT * FROM rs",
    "v3_risk_levels": "SELECT user_id, ticket_signal, review_signal, risk_level FROM sig",
    "v4_actions": "SELECT risk_level, suggested_action, count(*) AS n FROM sig GROUP BY 1, 2",
    "v5_critic": "SELECT * FROM rev",
    "v6_dossiers": f"""SELECT user_id, part, coalesce(tj, '[]') AS tickets, coalesce(rj, '[]') AS reviews FROM (SELECT user_id, 1 AS part FROM customers)
FULL JOIN (SELECT user_id, part, '[' || string_agg('{{"place":' || place || ',"order_id":' || order_id || ',"category":"' || category || '","status":"' || status || '","description":"' || description || '"}}', ',' ORDER BY place) || ']' AS tj
  FROM (SELECT user_id, place, order_id, category, status, ((place - 1) // 5)::INT + 1 AS part, regexp_replace(regexp_replace(description, '{EMAIL}', '[EMAIL]', 'g'), '{MOBILE}', '[PHONE]', 'g') AS description
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {TICKET_ORDER}) AS place FROM v_tickets WHERE user_id IN (SELECT user_id FROM customers))) GROUP BY 1, 2) USING (user_id, part)
FULL JOIN (SELECT user_id, part, '[' || string_agg('{{"place":' || place || ',"order_id":' || order_id || ',"rating":' || rating || '}}', ',' ORDER BY place) || ']' AS rj
  FROM (SELECT *, ((place - 1) // 5)::INT + 1 AS part FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {REVIEW_ORDER}) AS place FROM v_reviews WHERE user_id IN (SELECT user_id FROM customers))) GROUP BY 1, 2) USING (user_id, part)""",
}


def with_ctes(body: str) -> str:
    """The body behind the expressions it names, and those that they name."""
    names = lambda sql: {w for w in re.findall(r"\b\w+\b", re.sub(r"'[^']*'", "''", sql)) if w in CTES}
    wanted, todo = set(), list(names(body))
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo += names(CTES[name])
    ctes = ",\n".join(f"{n} AS ({CTES[n]})" for n in CTES if n in wanted)
    if body.startswith("WITH_PSI "):
        return f"WITH {ctes},{body.removeprefix('WITH_PSI ')}"
    return f"WITH {ctes}\n{body}" if ctes else body


SQL = {name: with_ctes(body) for name, body in BODIES.items()}
