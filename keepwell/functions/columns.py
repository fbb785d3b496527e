"""Column expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Enumerations of the data model.
OPEN_TICKETS = ("OPEN", "IN_PROGRESS", "WAITING_ON_CUSTOMER")
UNHAPPY_CATEGORIES = ("REFUND", "DELIVERY_DELAY", "PAYMENT")
FLAGGED_LEVELS = ("HIGH", "MEDIUM")
FEATURES = ("avg_review_rating", "pct_low_reviews", "cancellation_rate", "unresolved_ticket_rate", "tickets_per_order", "avg_order_value")
# What a feature is called in a report.
PHRASES = {
    "avg_review_rating": "low review ratings",
    "pct_low_reviews": "many low reviews",
    "cancellation_rate": "high cancellation rate",
    "unresolved_ticket_rate": "unresolved support tickets",
    "tickets_per_order": "frequent complaints",
    "avg_order_value": "order value pattern",
}
NO_SIGNAL = "no strong signal"
# The patterns of redaction.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
MOBILE = r"\b[6-9]\d{9}\b"


def moment(at: datetime) -> Column:
    """A point in time as the tables store it: naive, UTC. Folds to a constant, so comparisons reach the scan."""
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def days_before(at: datetime, days: float) -> Column:
    return moment(at - timedelta(days=days))


def rate(part: str, whole: str) -> Column:
    """part / whole, where a whole of 0 counts as 1."""
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def is_customer() -> Column:
    return F.col("user_type") == "CUSTOMER"


def is_active_customer() -> Column:
    return is_customer() & (F.col("account_status") == "ACTIVE")


def is_support_agent() -> Column:
    return F.col("user_type") == "SUPPORT_AGENT"


def is_flagged(level: str = "risk_level") -> Column:
    """A verdict that asks for action."""
    return F.col(level).isin(*FLAGGED_LEVELS)


def is_bad_ticket() -> Column:
    """An open ticket, or one about money or delay."""
    return F.col("status").isin(*OPEN_TICKETS) | F.col("category").isin(*UNHAPPY_CATEGORIES)


def over(probability: str, threshold: float = 0.5, inclusive: bool = False) -> Column:
    return F.col(probability) >= threshold if inclusive else F.col(probability) > threshold


def mentions(text: str, word: str) -> Column:
    """Whether a text holds a word in any case."""
    return F.lower(F.col(text)).contains(word.lower())


def redact(text: Column) -> Column:
    """E-mail addresses, then ten-digit mobile numbers, replaced by tags. A text without an at sign has no address, which
    is told without the pattern."""
    without_mail = F.when(text.contains("@"), F.regexp_replace(text, EMAIL, "[EMAIL]")).otherwise(text)
    return F.regexp_replace(without_mail, MOBILE, "[PHONE]")


def phrase(feature: Column) -> Column:
    """A feature's name in words; other names stay as they are."""
    words = F.create_map(*[F.lit(x) for pair in PHRASES.items() for x in pair])
    return F.coalesce(F.try_element_at(words, feature), feature)


def winnability() -> Column:
    """How far a coupon may lift the chance of return; a missing driver counts as one half."""
    of = lambda c: F.coalesce(F.col(c), F.lit(0.5))
    # The weights, and the most that a coupon lifts.
    return F.least(F.lit(0.6), F.greatest(F.lit(0.0), 0.35 * of("support_pain") + 0.25 * of("delivery_pain") - 0.20 * of("pickiness")))


def shocked(column: str, delta: float) -> Column:
    """A rate after an incident that adds delta, never above 1."""
    return F.least(F.lit(1.0), F.col(column) + delta)


def uniform(seed: str, key: Column) -> Column:
    """A number in [0, 1) that depends on seed and key alone, whatever the partitioning."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def percent(probability: str) -> Column:
    """A probability as whole percent."""
    return F.format_string("%.0f%%", F.col(probability) * 100)
