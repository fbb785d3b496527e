"""The benchmark tables seen as a shop's tables: the same SQL for Spark and for DuckDB."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

#: {name} stands for a benchmark table.
VIEWS = {
    "v_users": """SELECT c_custkey AS user_id, c_name AS full_name, n_name AS city,
  CONCAT('user', CAST(c_custkey % 1400 AS STRING), '@example.com') AS email,
  CONCAT('9', LPAD(CAST(c_custkey AS STRING), 9, '0')) AS phone_number,
  CASE WHEN c_custkey % 50 = 49 THEN 'SUPPORT_AGENT' ELSE 'CUSTOMER' END AS user_type,
  CASE WHEN c_acctbal < 0 THEN 'SUSPENDED' ELSE 'ACTIVE' END AS account_status
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "v_orders": """SELECT o_orderkey AS order_id, o_custkey AS user_id,
  CASE o_orderstatus WHEN 'P' THEN 'CANCELLED' WHEN 'F' THEN 'DELIVERED' ELSE 'OUT_FOR_DELIVERY' END AS order_status,
  o_totalprice AS total_amount, o_orderdate AS placed_at
FROM {orders} WHERE o_custkey % 10 <> 3""",
    "v_tickets": """SELECT o_custkey AS user_id, l_orderkey AS order_id, l_linenumber, l_partkey, l_suppkey,
  CASE l_suppkey % 7 WHEN 0 THEN 'ORDER_ISSUE' WHEN 1 THEN 'PAYMENT' WHEN 2 THEN 'DELIVERY_DELAY' WHEN 3 THEN 'PRODUCT_QUALITY'
       WHEN 4 THEN 'REFUND' WHEN 5 THEN 'APP_ISSUE' ELSE 'OTHER' END AS category,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'URGENT' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS priority,
  CASE WHEN l_linestatus = 'F' AND l_partkey % 2 = 0 THEN 'RESOLVED' WHEN l_linestatus = 'F' THEN 'CLOSED'
       WHEN o_orderpriority = '1-URGENT' THEN 'OPEN' WHEN o_orderpriority = '2-HIGH' THEN 'IN_PROGRESS'
       WHEN o_orderpriority = '3-MEDIUM' THEN 'WAITING_ON_CUSTOMER' WHEN l_partkey % 3 = 0 THEN 'OPEN' ELSE 'CLOSED' END AS status,
  CONCAT('order ', CAST(l_orderkey AS STRING), ' of user', CAST(o_custkey AS STRING), '@example.com, call 9', LPAD(CAST(o_custkey AS STRING), 9, '0')) AS description,
  l_shipdate AS created_at
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
WHERE l_returnflag = 'R' AND o_custkey % 7 <> 2""",
    "v_reviews": """SELECT o_custkey AS user_id, l_partkey % 20 AS product_id, l_orderkey AS order_id, l_linenumber, l_suppkey,
  1 + CAST(l_quantity AS INT) % 5 AS rating, l_shipdate AS created_at
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
WHERE l_returnflag = 'A' AND o_custkey % 6 <> 1""",
    "v_products": "SELECT p_partkey AS product_id, p_name AS product_name, p_brand AS category, p_retailprice AS price FROM {part}",
    "v_auth_log": """SELECT event_id AS log_id, user_id,
  CASE event_type WHEN 'click' THEN 'LOGIN' WHEN 'purchase' THEN 'LOGIN' WHEN 'view' THEN 'LOGOUT'
       WHEN 'error' THEN 'LOGIN_FAILED' ELSE 'PASSWORD_RESET' END AS event_type,
  CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS event_status,
  ts AS event_timestamp
FROM {events}""",
    "v_truth": """SELECT c_custkey AS user_id,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'cliff_dropper' WHEN 'FURNITURE' THEN 'gradual_fader' WHEN 'MACHINERY' THEN 'vacationer'
       WHEN 'HOUSEHOLD' THEN 'loyal_bulk_buyer' ELSE 'regular_active' END AS archetype,
  c_mktsegment IN ('BUILDING', 'FURNITURE') AS churned,
  CAST(c_custkey * 53 % 1000 AS DOUBLE) / 1000 AS delivery_pain, CAST(c_custkey * 37 % 1000 AS DOUBLE) / 1000 AS support_pain,
  CAST(c_custkey * 71 % 1000 AS DOUBLE) / 1000 AS pickiness
FROM {customer} WHERE c_custkey % 50 <> 49 AND c_custkey % 40 <> 0""",
    "v_contacted": """SELECT c_custkey AS user_id, CAST(TIMESTAMP '2001-08-01 00:00:00' - CAST(c_custkey % 60 AS INT) * INTERVAL 1 DAY AS DATE) AS contacted_on
FROM {customer} WHERE c_custkey % 11 = 0""",
}

#: Faults that are planted in the views where the rules of the tables are tested: expressions for Spark and for DuckDB.
FAULTS = {
    "users": {"email": "CASE WHEN user_id % 97 = 0 THEN NULL ELSE email END", "user_type": "CASE WHEN user_id % 89 = 0 THEN 'ROBOT' WHEN user_id % 83 = 0 THEN NULL ELSE user_type END", "account_status": "CASE WHEN user_id % 79 = 0 THEN 'LOST' ELSE account_status END"},
    "products": {"product_name": "CASE WHEN product_id % 73 = 0 THEN NULL ELSE product_name END", "price": "CASE WHEN product_id % 71 = 0 THEN NULL ELSE price END"},
    "orders": {"order_status": "CASE WHEN order_id % 67 = 0 THEN 'EATEN' ELSE order_status END", "total_amount": "CASE WHEN order_id % 61 = 0 THEN NULL ELSE total_amount END"},
    "auth_audit_log": {"event_type": "CASE WHEN log_id % 59 = 0 THEN 'SIGH' WHEN log_id % 53 = 0 THEN NULL ELSE event_type END", "event_status": "CASE WHEN log_id % 47 = 0 THEN 'MAYBE' ELSE event_status END"},
    "support_tickets": {"category": "CASE WHEN order_id % 43 = 0 THEN 'MOOD' ELSE category END", "priority": "CASE WHEN order_id % 41 = 0 THEN NULL ELSE priority END", "status": "CASE WHEN order_id % 37 = 0 THEN 'ASLEEP' ELSE status END", "description": "CASE WHEN order_id % 31 = 0 THEN NULL ELSE description END"},
    "reviews": {"rating": "CASE WHEN order_id % 29 = 0 THEN 6 WHEN order_id % 23 = 0 THEN NULL ELSE rating END"},
}


class Views:
    """DataFrames of the views over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _view(self, name: str) -> DataFrame:
        sql = VIEWS[name]
        return self.spark.sql(sql, **{t: self.table(t) for t in re.findall(r"\{(\w+)\}", sql)})

    @cached_property
    def users(self) -> DataFrame:
        return self._view("v_users")

    @cached_property
    def orders(self) -> DataFrame:
        return self._view("v_orders")

    @cached_property
    def tickets(self) -> DataFrame:
        return self._view("v_tickets")

    @cached_property
    def reviews(self) -> DataFrame:
        return self._view("v_reviews")

    @cached_property
    def products(self) -> DataFrame:
        return self._view("v_products")

    @cached_property
    def log(self) -> DataFrame:
        return self._view("v_auth_log")

    @cached_property
    def truth(self) -> DataFrame:
        return self._view("v_truth")

    @cached_property
    def contacts(self) -> DataFrame:
        return self._view("v_contacted")


def duck_ctes() -> dict[str, str]:
    """Name and body of each view for DuckDB, where the tables have their own names."""
    return {name: re.sub(r"\{(\w+)\}", r"\1", sql) for name, sql in VIEWS.items()}
