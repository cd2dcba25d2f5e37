"""Literal landing records with defaults, and a lake built from them."""

from datetime import date, datetime, timedelta
from decimal import Decimal
from itertools import count

from pyspark.sql import types as T

from tidemark.contracts import CONTRACTS
from tidemark.operators.cdc import Lake
from tidemark.plans.workspace import Workspace, load_lookups

AS_OF = datetime(2026, 9, 13, 12)
SMALL = "/root/testdata/sf0.001"

DEFAULTS = {
    "order_status": "paid", "channel": "web", "currency": "BRL", "business_unit_code": "BU-01",
    "customer_id": "CUST-000001", "payment_status": "captured", "payment_method": "pix",
    "installments": 1, "acquirer": "ACQ", "quantity": 1, "item_seq": 1, "dc_id": "DC-01",
    "price_list_id": "varejo", "segment": "b2c", "loyalty_tier": "none",
    "discount_type": "percent", "max_uses": 1000, "item_id": "SKU-000001",
    "bu_code": "BU-01", "active": True,
}


def ago(days=0, **kw):
    return AS_OF - timedelta(days=days, **kw)


def money(value):
    return Decimal(str(value)).quantize(Decimal("0.0001"))


def records(spark, entity, rows):
    """Landing rows; later rows of the list get a higher sequence and offset
    unless they name their own."""
    contract, offsets = CONTRACTS[entity], count(1)
    out = []
    for row in rows:
        n = next(offsets)
        created = row.get("created_at", ago(1))
        base = {
            "created_at": created, "updated_at": created, "_topic": contract.topic,
            "_partition": 0, "_offset": n, "_kafka_ts": created, "_ingested_at": created,
            "_op": "c", "_cdc_seq": n, "_schema_id": 1,
        }
        values = []
        for field in contract.landing_schema.fields:
            value = row.get(field.name, base.get(field.name, DEFAULTS.get(field.name)))
            optional = {f[0] for f in contract.fields if f[2]}
            if field.name in optional and field.name not in row and field.name != "dc_id":
                value = None
            elif value is None and field.name not in row:
                kind = type(field.dataType)
                value = {
                    T.StringType: "", T.IntegerType: 0, T.LongType: 0, T.BooleanType: False,
                    T.DecimalType: 0, T.DateType: date(2025, 1, 1), T.TimestampNTZType: created,
                }[kind]
            if isinstance(field.dataType, T.DecimalType) and value is not None:
                value = money(value)
            values.append(value)
        out.append(tuple(values))
    return spark.createDataFrame(out, contract.landing_schema)


UNITS = [
    {"bu_code": "BU-01", "bu_name": "Unit 1", "channel": "web", "region": "S"},
    {"bu_code": "BU-02", "bu_name": "Unit 2", "channel": "app", "region": "N"},
    {"bu_code": "BU-TEST", "bu_name": "Unit T", "channel": "web", "region": "S"},
]
CODES = [
    {"discount_code": c, "campaign_name": f"camp {c}", "discount_value": 10,
     "valid_from": ago(400), "valid_to": ago(-400)}
    for c in ("PROMO10", "PROMO20", "FRETEGRATIS")
]


def lake(spark, **entities):
    entities = {"business_unit": UNITS, "discount_codes": CODES, **entities}
    return Lake({e: records(spark, e, entities.get(e, [])) for e in CONTRACTS}, CONTRACTS)


def space(spark, days=400, **entities):
    return Workspace(lake(spark, **entities), AS_OF, AS_OF, days)


def lookups(a_lake):
    return load_lookups(a_lake)


def only(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]
