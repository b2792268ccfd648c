"""One definition per business term; every query builds on these.

Business terms (the semantic layer):
  revenue        price + freight of order items, exact decimal
  delivery days  floored elapsed 24 h periods between purchase and delivery (may be negative)
  late           delivered after the estimated date; a missing delivery is not late
  on-time %      share of not-late rows, item- or order-weighted depending on the query
  unique customers  distinct customer_unique_id
  month          purchase timestamp truncated to the month
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"
RATE = "decimal(4,2)"
# Fixed stand-in rule: the estimated delivery date is 60 days after purchase.
ESTIMATE_DAYS = 60
MICROS_PER_DAY = 86_400_000_000


def q(name: str) -> str:
    """SQL reference to a column name."""
    return "`" + name.replace("`", "``") + "`"


# ---- the formulas, as SQL text over column references --------------------------
def money_sql(x: str) -> str:
    """Exact money (2 digits, HALF_UP) before any arithmetic."""
    return f"CAST({x} AS {MONEY})"


def freight_sql(price: str, rate: str) -> str:
    """Freight of an item as price x rate, rounded to cents on decimals."""
    return f"ROUND(CAST({price} AS {MONEY}) * CAST({rate} AS {RATE}), 2)"


# Money travels through aggregations as integer cents (long): exact, and sums
# stay on the fast fixed-width path (a decimal sum widens past 18 digits and
# drops to BigDecimal arithmetic). Under ANSI mode an overflow raises.
def to_cents_sql(m: str) -> str:
    """Exact cents of a 2-digit money value (at most 12 integer digits)."""
    return f"CAST(CAST({m} AS DECIMAL(14,2)) * 100BD AS BIGINT)"


def cents_of_sql(x: str) -> str:
    """Exact cents of a double amount, equal to the cents of its money value (HALF_UP).

    Fast path: when x*100 lies within 1e-6 of an integer, HALF_UP rounding to
    cents is that integer (far from any .5 tie), so ``rint`` on the double is
    exact and stays in codegen'd primitive arithmetic. Any other value takes the
    decimal cast."""
    c = f"(CAST({x} AS DOUBLE) * 100.0D)"
    return (f"(CASE WHEN abs({c} - rint({c})) < 0.000001D THEN CAST(rint({c}) AS BIGINT) "
            f"ELSE {to_cents_sql(money_sql(x))} END)")


def freight_cents_sql(price_cents: str, rate: str) -> str:
    """round(price x rate, 2) in cents, HALF_UP on integers (rate to 2 decimals first)."""
    prod = f"(({price_cents}) * {cents_of_sql(rate)})"
    return f"(CAST(signum({prod}) AS BIGINT) * ((abs({prod}) + 50) div 100))"


def from_cents_sql(cents: str) -> str:
    """Cents back to exact money, decimal(38,2)."""
    return f"CAST(CAST({cents} AS DECIMAL(20,0)) / 100BD AS DECIMAL(38,2))"


def delivery_days_sql(purchased: str, delivered: str) -> str:
    """Floored whole days of elapsed time (23:00 -> 01:00 next day is 0; -6 h is -1)."""
    d = f"timestampdiff(MICROSECOND, {purchased}, {delivered})"
    return f"CAST(({d} - pmod({d}, {MICROS_PER_DAY}L)) div {MICROS_PER_DAY}L AS INT)"


def is_late_sql(delivered: str, estimated: str) -> str:
    """Never NULL: a missing delivery or estimate compares as not late."""
    return f"coalesce({delivered} > {estimated}, false)"


def estimated_sql(purchased: str) -> str:
    return f"{purchased} + INTERVAL {ESTIMATE_DAYS} DAYS"


def month_start_sql(ts: str) -> str:
    """Month of a timestamp as a DATE (first day)."""
    return f"trunc(CAST({ts} AS DATE), 'month')"


# ---- the same for column names ----------------------------------------------------
def money(x: str) -> Column:
    return F.expr(money_sql(q(x)))


def freight_from_rate(price: str, rate: str) -> Column:
    return F.expr(freight_sql(q(price), q(rate)))


def to_cents(money_col: str) -> Column:
    return F.expr(to_cents_sql(q(money_col)))


def delivery_days(purchased: str, delivered: str) -> Column:
    return F.expr(delivery_days_sql(q(purchased), q(delivered)))


def is_late(delivered: str, estimated: str) -> Column:
    return F.expr(is_late_sql(q(delivered), q(estimated)))


def estimated_delivery(purchased: str) -> Column:
    return F.expr(estimated_sql(q(purchased)))


def revenue(price: str, freight: str) -> Column:
    """Revenue of one item: price + freight (NULL if either is NULL)."""
    return F.col(price) + F.col(freight)
