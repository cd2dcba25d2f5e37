"""Landing records of the eight entities, derived from the retail test tables.

Every function maps one or two source tables to the landing schema of an entity
(business columns, then the technical ones). Doubles become ``decimal(18,4)``
here and nowhere else.
"""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.contracts import CONTRACTS, MONEY
from tidemark.functions import AMOUNT, stamp
from tidemark.sources import files

# The reference instants of the test data.
SALES_AS_OF = datetime(2001, 8, 2)
PAYMENTS_AS_OF = datetime(2024, 1, 31)
WIDE_DAYS = 3650

FEW_BYTES = 1 << 20  # of an orders file so small that its rows may be broadcast


def pick(index: Column, *values) -> Column:
    """The value at ``index`` (0-based) of a short literal list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def _hours(ts, n) -> Column:
    return F.timestamp_add("HOUR", n.cast("int") if isinstance(n, Column) else F.lit(n), ts)


def _seconds(ts, n: Column) -> Column:
    return F.timestamp_add("SECOND", n.cast("int"), ts)


def _ntz(col: Column) -> Column:
    return col.cast("timestamp_ntz")


def _money(name: str) -> Column:
    return F.col(name).cast(MONEY)


def conform(df: DataFrame, entity: str) -> DataFrame:
    """Select exactly the landing columns of the contract, in its types."""
    schema = CONTRACTS[entity].landing_schema
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def _technical(entity: str, partition, offset, kafka_ts, op, seq) -> dict[str, Column]:
    return {
        "_topic": F.lit(CONTRACTS[entity].topic),
        "_partition": partition,
        "_offset": offset,
        "_kafka_ts": kafka_ts,
        "_ingested_at": kafka_ts,
        "_op": op,
        "_cdc_seq": seq,
        "_schema_id": F.lit(1),
    }


class RetailTables:
    """The test tables of one scale folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def landing(self, entity: str) -> DataFrame:
        return self._entities[entity]()

    @cached_property
    def _entities(self):
        return {
            "order": self.order_raw,
            "order_item": self.order_item_raw,
            "order_payment": self.order_payment_raw,
            "customer": self.customer_raw,
            "business_unit": self.business_unit_raw,
            "prices": self.prices_raw,
            "discount_codes": self.discount_codes_raw,
            "stock_position": self.stock_position_raw,
        }

    def order_raw(self) -> DataFrame:
        return order_records(self.table("orders"))

    def order_item_raw(self) -> DataFrame:
        few = files.size(self.spark, f"{self.folder}/orders.parquet") <= FEW_BYTES
        return order_item_records(self.table("lineitem"), self.table("orders"), few)

    def order_payment_raw(self) -> DataFrame:
        return order_payment_records(self.table("events"))

    def customer_raw(self) -> DataFrame:
        return customer_records(self.table("customer"))

    def business_unit_raw(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        key = F.col("n_nationkey")
        start = stamp(datetime(1995, 1, 1))
        df = (
            nation.where(~key.isin(3, 17))
            .join(region, nation.n_regionkey == region.r_regionkey)
            .withColumns(
                {
                    "bu_code": key.cast("string"),
                    "bu_name": F.col("n_name"),
                    "channel": pick(key % 3, "web", "app", "store"),
                    "region": F.col("r_name"),
                    "country": F.concat(F.lit("C"), key.cast("string")),
                    "cost_center": F.concat(F.lit("CC-"), key.cast("string")),
                    "active": key % 7 != 0,
                    "created_at": start,
                    "updated_at": start,
                    **_technical("business_unit", F.lit(0), key, start, F.lit("c"), F.lit(1)),
                }
            )
        )
        return conform(df, "business_unit")

    def prices_raw(self) -> DataFrame:
        return price_records(self.table("part"))

    def discount_codes_raw(self) -> DataFrame:
        start = stamp(datetime(1995, 1, 1))
        code = F.col("o_orderpriority")
        df = (
            self.table("orders")
            .select(code)
            .distinct()
            .where(code != "4-NOT SPECIFIED")
            .withColumns(
                {
                    "discount_code": code,
                    "campaign_name": F.concat(F.lit("campaign "), code),
                    "discount_type": F.lit("percent"),
                    "discount_value": F.lit(10),
                    "valid_from": stamp(datetime(1995, 6, 1)),
                    "valid_to": stamp(datetime(2001, 1, 1)),
                    "max_uses": F.lit(1000),
                    "business_unit_scope": F.when(code == "1-URGENT", "5"),
                    "created_at": start,
                    "updated_at": start,
                    **_technical(
                        "discount_codes",
                        F.lit(0),
                        F.substring(code, 1, 1).cast("bigint"),
                        start,
                        F.lit("c"),
                        F.lit(1),
                    ),
                }
            )
        )
        return conform(df, "discount_codes")

    def stock_position_raw(self) -> DataFrame:
        return stock_records(self.table("part"))


def order_records(orders: DataFrame) -> DataFrame:
    """Up to four versions per order: create, cancel, delete, create again."""
    key, seq = F.col("o_orderkey"), F.col("seq")
    versions = F.filter(
        F.array(
            F.lit(1),
            F.when(key % 5 == 0, 2),
            F.when(key % 67 == 0, 3),
            F.when(key % 134 == 0, 4),
        ),
        lambda v: v.isNotNull(),
    )
    base_status = (
        F.when(F.col("o_orderstatus") == "F", "delivered")
        .when(F.col("o_orderstatus") == "O", "paid")
        .when(key % 2 == 0, "canceled")
        .otherwise("created")
    )
    priority = F.col("o_orderpriority")
    gross = _money("o_totalprice")
    discount = F.when(key % 4 == 0, F.lit(0).cast(AMOUNT)).otherwise(
        (gross * F.lit("0.1").cast("decimal(2,1)")).cast(AMOUNT)
    )
    created = _ntz(F.col("o_orderdate"))
    df = (
        orders.withColumn("seq", F.explode(versions))
        .withColumns(
            {
                "order_id": key.cast("string"),
                "customer_id": F.col("o_custkey").cast("string"),
                "business_unit_code": (F.col("o_custkey") % 25).cast("string"),
                "order_status": F.when(seq == 2, "canceled")
                .when(seq == 4, "delivered")
                .otherwise(base_status),
                "channel": pick(key % 3, "web", "app", "store"),
                "currency": F.when(key % 10 == 0, "USD").otherwise("BRL"),
                "discount_code": F.when(key % 4 == 1, priority)
                .when(key % 4 == 2, F.lower(priority))
                .when(key % 4 == 3, F.concat(F.lit(" "), priority, F.lit("  "))),
                "gross_amount": gross,
                "discount_amount": discount,
                "freight_amount": F.lit(10).cast(AMOUNT),
                "created_at": created,
                "updated_at": _hours(created, key % 72),
            }
        )
        .withColumn(
            "total_amount",
            F.col("gross_amount") - F.col("discount_amount") + F.col("freight_amount"),
        )
        .withColumns(
            _technical(
                "order",
                key % 6,
                # keys divisible by ten are emitted newest version first
                key * 8 + F.when(key % 10 == 0, 5 - seq).otherwise(seq),
                _hours(created, seq),
                pick(seq - 1, "c", "u", "d", "c"),
                seq,
            )
        )
    )
    return conform(df, "order")


def order_item_records(lineitem: DataFrame, orders: DataFrame, few: bool = False) -> DataFrame:
    """The table repeats keys; the repeats are the versions of an item.

    The join is on the key as text, as it stands in the records: whatever groups or joins them by
    ``order_id`` afterwards then needs no second shuffle. What needs nothing of the order is worked out
    before the join, so that whole numbers and one letter are shuffled, not floating point and flags.
    Orders grow as the items do: they are merged and not broadcast through the driver (Spark estimates
    their keys as text at a tenth of what they take there), unless they are ``few``: then it is left to Spark."""
    supp = F.col("l_suppkey")
    created = _ntz(F.col("o_orderdate"))
    head = orders.select(F.col("o_orderkey").cast("string").alias("_head"), F.col("o_orderdate"))
    items = lineitem.select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_linenumber").alias("item_seq"),
        "l_partkey",
        "l_suppkey",
        F.col("l_quantity").cast("int").alias("quantity"),
        _money("l_extendedprice").alias("gross_amount"),
        F.col("l_discount").cast("decimal(4,2)").alias("_discount"),
        _ntz(F.col("l_shipdate")).alias("updated_at"),
        F.datediff(F.to_date(F.col("l_shipdate")), F.lit("1970-01-01").cast("date")).alias("_shipped"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), "d").otherwise("u").alias("_operation"),
    )
    gross = F.col("gross_amount")
    df = (
        items.join(head if few else head.hint("merge"), F.col("order_id") == F.col("_head"), "left")
        .withColumns(
            {
                "item_id": F.col("l_partkey").cast("string"),
                "dc_id": F.when(supp % 9 != 0, (supp % 12).cast("string")),
                "discount_amount": (gross * F.col("_discount")).cast(AMOUNT),
                "created_at": created,
            }
        )
        .withColumns(
            {
                "unit_price": (gross / F.col("quantity").cast("decimal(10,0)")).cast(AMOUNT),
                "total_amount": F.col("gross_amount") - F.col("discount_amount"),
                **_technical(
                    "order_item",
                    F.col("l_partkey"),
                    supp,
                    _hours(created, 1),
                    F.col("_operation"),
                    F.col("_shipped"),
                ),
            }
        )
    )
    return conform(df, "order_item")


def order_payment_records(events: DataFrame) -> DataFrame:
    """Three attempts per order; about a quarter point beyond the orders."""
    key, kind = F.col("event_id"), F.col("event_type")
    created = _ntz(F.col("ts"))
    authorized = F.when(
        kind.isin("click", "purchase", "signup"), _seconds(created, key % 60)
    )
    captured = F.when(kind == "purchase", _seconds(authorized, F.lit(30)))
    df = events.withColumns(
        {
            "payment_id": key.cast("string"),
            "order_id": (2 * (key - key % 3)).cast("string"),
            "payment_method": pick(
                F.col("user_id") % 4, "credit_card", "pix", "boleto", "voucher"
            ),
            "installments": key % 15,
            "payment_status": F.when(kind == "view", "pending")
            .when(kind == "click", "authorized")
            .when(kind == "purchase", "captured")
            .when(kind == "error", "denied")
            .otherwise("refunded"),
            "amount": _money("value"),
            "acquirer": (F.col("user_id") % 5).cast("string"),
            "authorized_at": authorized,
            "captured_at": captured,
            "created_at": created,
            "updated_at": F.coalesce(captured, authorized, created),
            **_technical("order_payment", key % 6, key, created, F.lit("c"), F.lit(1)),
        }
    )
    return conform(df, "order_payment")


def customer_records(customer: DataFrame) -> DataFrame:
    """Registered customers plus ten who never buy; some are deleted later."""
    spark = customer.sparkSession
    base = customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    idle = spark.range(1, 11).select(
        (-F.col("id")).alias("c_custkey"),
        F.concat(F.lit("Idle#"), F.col("id").cast("string")).alias("c_name"),
        F.lit(0).alias("c_nationkey"),
        F.lit("IDLE").alias("c_mktsegment"),
    )
    key, seq = F.col("c_custkey"), F.col("seq")
    since = F.date_add(F.lit("1995-01-01").cast("date"), (F.abs(key) % 2400).cast("int"))
    created = since.cast("timestamp_ntz")
    versions = F.when((key > 0) & (key % 211 == 0), F.array(F.lit(1), F.lit(2))).otherwise(
        F.array(F.lit(1))
    )
    df = (
        base.unionByName(idle)
        .withColumn("seq", F.explode(versions))
        .withColumns(
            {
                "customer_id": key.cast("string"),
                "document_hash": F.concat(F.lit("d"), key.cast("string")),
                "first_name": F.col("c_name"),
                "email_hash": F.concat(F.lit("e"), key.cast("string")),
                "customer_since": since,
                "segment": F.col("c_mktsegment"),
                "loyalty_tier": pick(F.abs(key) % 4, "none", "silver", "gold", "black"),
                "city": F.concat(F.lit("city-"), F.col("c_nationkey").cast("string")),
                "state": F.col("c_nationkey").cast("string"),
                "zipcode": (F.abs(key) % 1000).cast("string"),
                "created_at": created,
                "updated_at": created,
                **_technical(
                    "customer",
                    F.abs(key) % 6,
                    (F.abs(key) + F.when(key < 0, 10**12).otherwise(0)) * 2 + seq,
                    _hours(created, seq),
                    F.when(seq == 2, "d").otherwise("c"),
                    seq,
                ),
            }
        )
    )
    return conform(df, "customer")


def price_records(part: DataFrame) -> DataFrame:
    """Three validities per item; items divisible by forty have no price."""
    key, step = F.col("p_partkey"), F.col("step")
    first = [stamp(datetime(y, 1, 1)) for y in (1996, 1998, 2000)]
    start = F.element_at(F.array(*first), step + 1)
    end = F.when(step < 2, F.element_at(F.array(*first), F.least(step + 2, F.lit(3))))
    factor = F.element_at(
        F.array(*[F.lit(v).cast("decimal(2,1)") for v in ("1.0", "1.1", "1.2")]), step + 1
    )
    df = (
        part.where(key % 40 != 0)
        .withColumn("step", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        .withColumns(
            {
                "item_id": key.cast("string"),
                "price_list_id": F.lit("varejo"),
                "currency": F.lit("BRL"),
                "list_price": (_money("p_retailprice") * factor).cast(AMOUNT),
                "valid_from": start,
                "valid_to": end,
                "created_at": start,
                "updated_at": start,
            }
        )
        .withColumns(
            {
                "cost_price": (
                    F.col("list_price") * F.lit("0.6").cast("decimal(2,1)")
                ).cast(AMOUNT),
                **_technical("prices", key % 6, key * 3 + step, start, F.lit("c"), F.lit(1)),
            }
        )
    )
    return conform(df, "prices")


def stock_records(part: DataFrame) -> DataFrame:
    """Two centres per item, some items in none, five items nobody buys."""
    spark = part.sparkSession
    key = F.col("p_partkey")
    stocked = (
        part.where(key % 25 != 0)
        .select(
            key,
            (F.lit(10) * F.col("p_size")).cast("bigint").alias("on_hand"),
            (key % 120).cast("bigint").alias("reserved"),
            F.explode(F.array(key % 12, (key + 5) % 12)).alias("dc"),
        )
    )
    unsold = spark.range(1, 6).select(
        (-F.col("id")).alias("p_partkey"),
        F.lit(100).cast("bigint").alias("on_hand"),
        F.lit(0).cast("bigint").alias("reserved"),
        F.lit(0).cast("bigint").alias("dc"),
    )
    position = stamp(datetime(2001, 8, 1))
    df = stocked.unionByName(unsold).withColumns(
        {
            "item_id": key.cast("string"),
            "dc_id": F.col("dc").cast("string"),
            "dc_name": F.concat(F.lit("DC "), F.col("dc").cast("string")),
            "available": F.col("on_hand") - F.col("reserved"),
            "safety_stock": F.lit(50),
            "position_at": position,
            "created_at": position,
            "updated_at": position,
            **_technical(
                "stock_position",
                F.col("dc"),
                F.abs(key) + F.when(key < 0, 10**12).otherwise(0),
                stamp(datetime(2001, 8, 1, 23, 30)),
                F.lit("c"),
                F.lit(1),
            ),
        }
    )
    return conform(df, "stock_position")
