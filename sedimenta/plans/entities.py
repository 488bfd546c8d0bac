"""The ten silver entities as configurations of the general operators."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import keys
from ..operators.rules import Rule, dq_tag, in_set, matches, none_negative, not_null, positive, required_when, unknown

# The sets that columns may take; so are the keys and rule codes of the entities below.
CHANNELS = ["D2C", "B2B", "STORE"]
STATUSES = ["PENDING", "PROCESSING", "SHIPPED", "DELIVERED", "CANCELLED", "RETURNED", "RETURN_INITIATED"]
SEGMENTS = ["INDIVIDUAL", "BUSINESS", "VIP"]
ACCOUNT_TYPES = ["D2C", "B2B"]
ADDRESS_TYPES = ["HOME", "WORK", "BILLING", "SHIPPING"]
DIVISIONS = ["CONSUMER_ELECTRONICS", "HOME_APPLIANCES", "PERSONAL_CARE", "SPORTS_FITNESS", "PREMIUM_ACCESSORIES"]
PRICING_TYPES = ["STANDARD", "PROMOTIONAL", "CLEARANCE"]
PINCODE = "^[1-9][0-9]{5}$"


def _email(code: str) -> Rule:
    return Rule(code, F.col("email").isNull() | ~F.col("email").contains("@"))


def _either(code: str, allowed: list[str], *columns: str) -> Rule:
    """Any of the columns that is set has a value outside the set."""
    broken = F.lit(False)
    for c in columns:
        broken = broken | F.coalesce(~F.col(c).isin(allowed), F.lit(False))
    return Rule(code, broken)


def _set_and_wrong(code: str, column: str, pattern: str) -> Rule:
    return Rule(code, F.col(column).isNotNull() & matches(code, column, pattern).broken)


@dataclass(frozen=True)
class Entity:
    """``references``: column to (reference table, its key)."""

    keys: list[str]
    rules: list[Rule]
    references: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    order: str = "_bronze_timestamp"

    def tag(self, bronze: DataFrame, tables: Mapping[str, DataFrame], ties: list[Column]) -> DataFrame:
        """The latest row of each key with its rule outcome; reference keys are flagged ``_<column>_known``."""
        rows = keys.dedup_latest(bronze, self.keys, [F.desc_nulls_last(self.order), *ties])
        for column, (table, key) in self.references.items():
            rows = keys.fk_flag(rows, tables[table], column, key, f"_{column}_known")
        return dq_tag(rows, self.rules)


def entities() -> dict[str, Entity]:
    """Built on call, since columns need a session."""
    customers, orders, products = ("customers", "customer_id"), ("orders", "order_id"), ("products", "product_id")
    return {
        "orders": Entity(
            ["order_id"],
            [
                not_null("NULL_ORDER_ID", "order_id"),
                not_null("NULL_CUSTOMER_ID", "customer_id"),
                unknown("UNKNOWN_CUSTOMER_ID", "customer_id"),
                in_set("INVALID_CHANNEL_TYPE", "channel_type", CHANNELS),
                not_null("NULL_ORDER_DATE", "order_date"),
                not_null("NULL_STATUS", "status"),
                positive("INVALID_TOTAL_AMOUNT", "total_amount"),
                required_when("STORE_MISSING_STORE_ID", "store_id", F.col("channel_type") == "STORE"),
                required_when("B2B_MISSING_REP_ID", "rep_id", F.col("channel_type") == "B2B"),
            ],
            {"customer_id": customers},
        ),
        "order_lines": Entity(
            ["line_id"],
            [
                not_null("NULL_LINE_ID", "line_id"),
                not_null("NULL_ORDER_ID", "order_id"),
                not_null("NULL_PRODUCT_ID", "product_id"),
                unknown("UNKNOWN_ORDER_ID", "order_id"),
                unknown("UNKNOWN_PRODUCT_ID", "product_id"),
                positive("INVALID_QUANTITY", "quantity"),
                positive("INVALID_UNIT_PRICE", "unit_price"),
            ],
            {"order_id": orders, "product_id": products},
        ),
        "order_status_log": Entity(
            ["log_id"],
            [
                not_null("NULL_LOG_ID", "log_id"),
                not_null("NULL_ORDER_ID", "order_id"),
                not_null("NULL_TO_STATUS", "to_status"),
                unknown("UNKNOWN_ORDER_ID", "order_id"),
                _either("INVALID_STATUS", STATUSES, "to_status", "from_status"),
            ],
            {"order_id": orders},
        ),
        "customers": Entity(
            ["customer_id"],
            [
                not_null("NULL_CUSTOMER_ID", "customer_id"),
                _email("INVALID_EMAIL"),
                in_set("INVALID_SEGMENT", "segment", SEGMENTS),
                in_set("INVALID_ACCOUNT_TYPE", "account_type", ACCOUNT_TYPES),
                not_null("NULL_FULL_NAME", "full_name"),
            ],
        ),
        "customer_addresses": Entity(
            ["address_id"],
            [
                not_null("NULL_ADDRESS_ID", "address_id"),
                not_null("NULL_CUSTOMER_ID", "customer_id"),
                unknown("UNKNOWN_CUSTOMER_ID", "customer_id"),
                in_set("INVALID_ADDRESS_TYPE", "address_type", ADDRESS_TYPES),
                not_null("NULL_PINCODE", "pincode"),
                _set_and_wrong("INVALID_PINCODE", "pincode", PINCODE),
            ],
            {"customer_id": customers},
        ),
        "products": Entity(
            ["product_id"],
            [
                not_null("NULL_PRODUCT_ID", "product_id"),
                not_null("NULL_SKU", "sku"),
                in_set("INVALID_DIVISION", "division", DIVISIONS),
                not_null("NULL_CATEGORY_ID", "category_id"),
            ],
        ),
        "product_pricing": Entity(
            ["pricing_id"],
            [
                not_null("NULL_PRICING_ID", "pricing_id"),
                not_null("NULL_PRODUCT_ID", "product_id"),
                unknown("UNKNOWN_PRODUCT_ID", "product_id"),
                positive("INVALID_LIST_PRICE", "list_price"),
                in_set("INVALID_PRICING_TYPE", "pricing_type", PRICING_TYPES),
                not_null("NULL_EFFECTIVE_FROM", "effective_from"),
            ],
            {"product_id": products},
        ),
        "inventory_snapshot": Entity(
            ["product_id", "store_id", "snapshot_date"],
            [
                not_null("NULL_SNAPSHOT_ID", "snapshot_id"),
                not_null("NULL_PRODUCT_ID", "product_id"),
                not_null("NULL_STORE_ID", "store_id"),
                not_null("NULL_SNAPSHOT_DATE", "snapshot_date"),
                unknown("UNKNOWN_PRODUCT_ID", "product_id"),
                unknown("UNKNOWN_STORE_ID", "store_id"),
                none_negative("NEGATIVE_STOCK", "opening_stock", "closing_stock"),
            ],
            {"product_id": products, "store_id": ("stores", "store_id")},
        ),
        "sales_reps": Entity(
            ["rep_id"],
            [
                not_null("NULL_REP_ID", "rep_id"),
                _email("INVALID_EMAIL"),
                not_null("NULL_FULL_NAME", "full_name"),
                not_null("NULL_HIRE_DATE", "hire_date"),
            ],
        ),
        "territory_assignments": Entity(
            ["assignment_id"],
            [
                not_null("NULL_ASSIGNMENT_ID", "assignment_id"),
                not_null("NULL_REP_ID", "rep_id"),
                not_null("NULL_TERRITORY_ID", "territory_id"),
                unknown("UNKNOWN_REP_ID", "rep_id"),
                not_null("NULL_ASSIGNED_FROM", "assigned_from"),
            ],
            {"rep_id": ("sales_reps", "rep_id")},
        ),
    }
