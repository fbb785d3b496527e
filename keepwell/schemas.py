"""Explicit schemas of the tables and side datasets, so that no reader infers one."""

from __future__ import annotations

TABLES = {
    "users": "user_id long, full_name string, email string, phone_number string, password_hash string, date_of_birth date, gender string, address_line string, city string, state string, pincode string, user_type string, account_status string, is_email_verified int, is_phone_verified int, created_at timestamp_ntz, updated_at timestamp_ntz",
    "products": "product_id long, product_name string, category string, price double, is_active int",
    "orders": "order_id long, user_id long, order_status string, total_amount double, delivery_address string, placed_at timestamp_ntz, delivered_at timestamp_ntz",
    "auth_audit_log": "log_id long, user_id long, event_type string, event_status string, session_id string, ip_address string, device_type string, device_info string, app_version string, failure_reason string, event_timestamp timestamp_ntz",
    "support_tickets": "ticket_id long, user_id long, order_id long, assigned_agent_id long, subject string, description string, category string, priority string, status string, resolution_notes string, created_at timestamp_ntz, updated_at timestamp_ntz, resolved_at timestamp_ntz",
    "reviews": "review_id long, user_id long, product_id long, order_id long, rating int, review_title string, review_text string, is_verified_purchase int, helpful_count int, created_at timestamp_ntz",
}

TRUTH = "user_id long, churned boolean, archetype string, active_until string, delivery_pain double, support_pain double, pickiness double"
EVIDENCE = "struct<logins_prev_30_60d:int,logins_recent_30d:int,total_orders:int,total_tickets:int,worst_review_rating:int>"
PREDICTIONS = f"user_id long, full_name string, risk_level string, churn_probability double, evidence {EVIDENCE}, reason string, suggested_action string"
CONTACTS = "user_id long, contacted_on date"
