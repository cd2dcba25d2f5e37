"""Entity contracts: schema, key, version, deletes, service levels, relations.

A contract is plain configuration. Ingestion, the core layer, the quality panel
and the relation checks all read it, so an entity is described once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)
STR, INT, LONG, BOOL, DATE, TS = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.BooleanType(),
    T.DateType(),
    T.TimestampNTZType(),
)

# Change operations and the technical columns of a landing record.
OPERATIONS = ("c", "u", "d", "r")
TECHNICAL = T.StructType(
    [
        T.StructField("_topic", STR),
        T.StructField("_partition", INT),
        T.StructField("_offset", LONG),
        T.StructField("_kafka_ts", TS),
        T.StructField("_ingested_at", TS),
        T.StructField("_op", STR),
        T.StructField("_cdc_seq", LONG),
        T.StructField("_schema_id", INT),
    ]
)
# Version order of a key: change sequence first, source coordinates break ties.
VERSION_ORDER = ("_cdc_seq", "_kafka_ts", "_partition", "_offset")
OFFSET_KEY = ("_topic", "_partition", "_offset")
# Partition column of stored landing and core tables: yyyyMM of some time column.
MONTH = "_month"
# Partition column of what one micro-batch of a stream wrote.
BATCH = "_batch"

# Status sets used by several marts.
BILLABLE = ("paid", "invoiced", "shipped", "delivered")
CANCELED = "canceled"


@dataclass(frozen=True)
class Relation:
    to: str
    kind: str  # foreign_key | lookup | temporal | loose
    local: tuple[str, ...]
    remote: tuple[str, ...]
    threshold_pct: float = 0.5
    # window, in seconds, of the mart that reads the relation
    window_s: int = 3 * 86400
    # clean the local value before the lookup (coupon codes)
    normalize: bool = False


@dataclass(frozen=True)
class Contract:
    context: str
    entity: str
    fields: tuple[tuple[str, T.DataType, bool], ...]
    key: tuple[str, ...]
    sla_minutes: int
    retention_days: int
    relations: tuple[Relation, ...] = ()
    soft_delete_operations: tuple[str, ...] = ("d",)
    # columns that never change over the versions of one key
    immutable: tuple[str, ...] = ()
    # co-location column(s): the key other entities join on
    bucket_by: tuple[str, ...] = ()
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict, hash=False, compare=False)

    @property
    def name(self) -> str:
        return self.entity

    @property
    def topic(self) -> str:
        return f"sap.{self.context}.{self.entity}.v1"

    @property
    def partition_on(self) -> str | None:
        """Column whose month partitions the stored core. It must not change over
        the versions of a key, or versions would be looked for in one partition only."""
        return self.immutable[0] if self.immutable else None

    @property
    def columns(self) -> list[str]:
        return [name for name, _, _ in self.fields]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in self.fields])

    @property
    def landing_schema(self) -> T.StructType:
        return T.StructType(
            [T.StructField(n, t, True) for n, t, _ in self.fields] + TECHNICAL.fields
        )

    @property
    def required(self) -> list[str]:
        return [name for name, _, nullable in self.fields if not nullable]


def _f(name, dtype, nullable=False):
    return (name, dtype, nullable)


_STAMPS = (_f("created_at", TS), _f("updated_at", TS))

ORDER = Contract(
    "sales",
    "order",
    (
        _f("order_id", STR),
        _f("customer_id", STR),
        _f("business_unit_code", STR),
        _f("order_status", STR),
        _f("channel", STR),
        _f("currency", STR),
        _f("discount_code", STR, True),
        _f("gross_amount", MONEY),
        _f("discount_amount", MONEY),
        _f("freight_amount", MONEY),
        _f("total_amount", MONEY),
        *_STAMPS,
    ),
    key=("order_id",),
    sla_minutes=10,
    retention_days=180,
    immutable=("created_at",),
    bucket_by=("order_id",),
    relations=(
        Relation("customer", "foreign_key", ("customer_id",), ("customer_id",), 0.1),
        Relation("business_unit", "lookup", ("business_unit_code",), ("bu_code",)),
        Relation(
            "discount_codes", "lookup", ("discount_code",), ("discount_code",), 5.0,
            window_s=90 * 86400, normalize=True,
        ),
    ),
    domains={
        "order_status": ("created", "paid", "invoiced", "shipped", "delivered", "canceled"),
        "channel": ("web", "app", "store"),
    },
)

ORDER_ITEM = Contract(
    "sales",
    "order_item",
    (
        _f("order_id", STR),
        _f("item_seq", INT),
        _f("item_id", STR),
        _f("dc_id", STR, True),
        _f("quantity", INT),
        _f("unit_price", MONEY),
        _f("gross_amount", MONEY),
        _f("discount_amount", MONEY),
        _f("total_amount", MONEY),
        *_STAMPS,
    ),
    key=("order_id", "item_seq"),
    sla_minutes=10,
    retention_days=180,
    immutable=("created_at",),
    bucket_by=("order_id",),
    relations=(
        Relation("order", "foreign_key", ("order_id",), ("order_id",)),
        Relation("prices", "temporal", ("item_id",), ("item_id",), window_s=7 * 86400),
        Relation(
            "stock_position", "lookup", ("item_id", "dc_id"), ("item_id", "dc_id"), 2.0,
            window_s=28 * 86400,
        ),
    ),
)

ORDER_PAYMENT = Contract(
    "sales",
    "order_payment",
    (
        _f("payment_id", STR),
        _f("order_id", STR),
        _f("payment_method", STR),
        _f("installments", INT),
        _f("payment_status", STR),
        _f("amount", MONEY),
        _f("acquirer", STR),
        _f("authorized_at", TS, True),
        _f("captured_at", TS, True),
        *_STAMPS,
    ),
    key=("payment_id",),
    sla_minutes=10,
    retention_days=180,
    immutable=("created_at",),
    bucket_by=("order_id",),
    relations=(Relation("order", "foreign_key", ("order_id",), ("order_id",)),),
    domains={
        "payment_method": ("credit_card", "pix", "boleto", "voucher"),
        "payment_status": ("pending", "authorized", "captured", "denied", "refunded"),
    },
)

CUSTOMER = Contract(
    "customer",
    "customer",
    (
        _f("customer_id", STR),
        _f("document_hash", STR),
        _f("first_name", STR),
        _f("email_hash", STR),
        _f("customer_since", DATE),
        _f("segment", STR),
        _f("loyalty_tier", STR),
        _f("city", STR),
        _f("state", STR),
        _f("zipcode", STR),
        *_STAMPS,
    ),
    key=("customer_id",),
    sla_minutes=60,
    retention_days=180,
    immutable=("customer_since",),
    bucket_by=("customer_id",),
)

BUSINESS_UNIT = Contract(
    "organization",
    "business_unit",
    (
        _f("bu_code", STR),
        _f("bu_name", STR),
        _f("channel", STR),
        _f("region", STR),
        _f("country", STR),
        _f("cost_center", STR),
        _f("active", BOOL),
        *_STAMPS,
    ),
    key=("bu_code",),
    sla_minutes=1440,
    retention_days=365,
)

PRICES = Contract(
    "pricing",
    "prices",
    (
        _f("item_id", STR),
        _f("price_list_id", STR),
        _f("currency", STR),
        _f("list_price", MONEY),
        _f("cost_price", MONEY),
        _f("valid_from", TS),
        _f("valid_to", TS, True),
        *_STAMPS,
    ),
    key=("item_id", "price_list_id", "valid_from"),
    sla_minutes=240,
    retention_days=365,
    immutable=("valid_from",),
    bucket_by=("item_id",),
    relations=(Relation("stock_position", "loose", ("item_id",), ("item_id",)),),
)

DISCOUNT_CODES = Contract(
    "pricing",
    "discount_codes",
    (
        _f("discount_code", STR),
        _f("campaign_name", STR),
        _f("discount_type", STR),
        _f("discount_value", MONEY),
        _f("valid_from", TS),
        _f("valid_to", TS),
        _f("max_uses", LONG),
        _f("business_unit_scope", STR, True),
        *_STAMPS,
    ),
    key=("discount_code",),
    sla_minutes=720,
    retention_days=365,
    relations=(
        Relation("business_unit", "lookup", ("business_unit_scope",), ("bu_code",)),
    ),
    domains={"discount_type": ("percent", "fixed", "freight")},
)

STOCK_POSITION = Contract(
    "inventory",
    "stock_position",
    (
        _f("item_id", STR),
        _f("dc_id", STR),
        _f("dc_name", STR),
        _f("on_hand", LONG),
        _f("reserved", LONG),
        _f("available", LONG),
        _f("safety_stock", LONG),
        _f("position_at", TS),
        *_STAMPS,
    ),
    key=("item_id", "dc_id"),
    sla_minutes=30,
    retention_days=90,
    bucket_by=("item_id",),
    relations=(Relation("prices", "loose", ("item_id",), ("item_id",)),),
)

CONTRACTS: dict[str, Contract] = {
    c.entity: c
    for c in (
        ORDER,
        ORDER_ITEM,
        ORDER_PAYMENT,
        CUSTOMER,
        BUSINESS_UNIT,
        PRICES,
        DISCOUNT_CODES,
        STOCK_POSITION,
    )
}
