"""Landing: parse, coerce, quarantine, write by month, retain."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.contracts import MONTH, OFFSET_KEY, OPERATIONS, TECHNICAL, Contract
from tidemark.functions import stamp


def parse_lines(lines: DataFrame, contract: Contract) -> DataFrame:
    """JSON text (column ``value``) to one text column per landing field.

    Everything is read as text first, so a bad value is a finding about its
    column and not a lost row. ``_corrupt`` holds a line that is not JSON. Where
    the source is a topic, the technical columns come from the message itself.
    """
    names = [f.name for f in contract.landing_schema.fields]
    schema = T.StructType(
        [T.StructField(n, T.StringType()) for n in [*names, "_corrupt"]]
    )
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    # ``inline`` keeps the parsed record as a plan step of its own: later filters
    # on its fields are not pushed into (and do not repeat) the parsing
    record = F.inline(F.array(F.from_json("value", schema, options)))
    out = lines.select(F.col("value").alias("_line"), *_message_columns(lines), record)
    for name, source in MESSAGE.items():
        if source in lines.columns:
            out = out.withColumn(name, F.col(f"_msg_{source}")).drop(f"_msg_{source}")
    return out


# Technical column and the message attribute it is taken from.
MESSAGE = {
    "_topic": "topic",
    "_partition": "partition",
    "_offset": "offset",
    "_kafka_ts": "timestamp",
}


def _message_columns(lines: DataFrame) -> list[Column]:
    return [
        F.col(source).cast("string").alias(f"_msg_{source}")
        for source in MESSAGE.values()
        if source in lines.columns
    ]


def kafka_lines(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A topic as a stream of JSON lines with message attributes."""
    return kafka_messages(spark, servers, topic).withColumn("value", F.col("value").cast("string"))


def kafka_messages(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A topic as a stream of binary messages with their attributes. Needs the Kafka
    connector package on the cluster."""
    messages = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .load()
    )
    return messages.select("value", *MESSAGE.values())


def coerce(raw: DataFrame, contract: Contract) -> DataFrame:
    """Text columns to contract types, with the list of failures in ``_errors``:
    not JSON, a required value missing, a value of the wrong type, a value
    outside its domain, or with more decimals than its column. ``_ingested_at`` may be absent; it is then the clock."""
    typed: dict[str, Column] = {}
    cause = F.col("_frame") if "_frame" in raw.columns else F.lit("unparseable")
    errors: list[Column] = [F.when(F.col("_corrupt").isNotNull(), cause)]
    readable = F.col("_corrupt").isNull()
    technical = (f.name for f in TECHNICAL.fields if f.name != "_ingested_at")
    required = {*contract.required, *technical}
    domains = {**contract.domains, "_op": OPERATIONS}
    for field in contract.landing_schema.fields:
        text = F.col(field.name)
        value = text.try_cast(field.dataType)
        errors.append(F.when(text.isNotNull() & value.isNull(), f"type:{field.name}"))
        if isinstance(field.dataType, T.DecimalType):
            # a cast would round what the column cannot hold
            exact = text.try_cast(T.DecimalType(38, 18))
            errors.append(F.when(exact != value.cast(T.DecimalType(38, 18)), f"scale:{field.name}"))
        if field.name in required:
            errors.append(F.when(readable & text.isNull(), f"missing:{field.name}"))
        if field.name in domains:
            errors.append(F.when(~text.isin(*domains[field.name]), f"domain:{field.name}"))
        typed[field.name] = value
    now = F.current_timestamp().cast("timestamp_ntz")
    typed["_ingested_at"] = F.coalesce(typed["_ingested_at"], now)
    return raw.withColumn("_errors", F.array_compact(F.array(*errors))).withColumns(typed)


def split_malformed(coerced: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """(good rows in the landing schema, quarantined lines with their reasons)."""
    names = [f.name for f in contract.landing_schema.fields]
    clean = F.size("_errors") == 0
    good = coerced.where(clean).select(*names)
    bad = coerced.where(~clean).select(
        F.lit(contract.entity).alias("entity"),
        F.col("_line").alias("line"),
        F.array_join("_errors", ",").alias("reason"),
    )
    return good, bad


def read_landing_json(
    spark: SparkSession, path: str, contract: Contract
) -> tuple[DataFrame, DataFrame]:
    """Files of one JSON object per line to (good, quarantined)."""
    lines = spark.read.text(path)
    return split_malformed(coerce(parse_lines(lines, contract), contract), contract)


def to_lines(landing: DataFrame) -> DataFrame:
    """Landing rows as JSON text, decimals and times as strings."""
    fields = [F.col(c).cast("string").alias(c) for c in landing.columns]
    return landing.select(F.to_json(F.struct(*fields)).alias("value"))


def dedup_offsets(landing: DataFrame) -> DataFrame:
    """One row per source coordinate, so a replay adds nothing."""
    return landing.dropDuplicates(list(OFFSET_KEY))


def duplicate_offsets(landing: DataFrame) -> DataFrame:
    """Source coordinates that landed more than once."""
    return (
        landing.groupBy(*OFFSET_KEY)
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
    )


def by_month(landing: DataFrame, ts: str = "_kafka_ts") -> DataFrame:
    return landing.withColumn(MONTH, F.date_format(ts, "yyyyMM"))


def write_partitioned(landing: DataFrame, path: str, ts: str = "_kafka_ts", mode: str = "append") -> None:
    """Append to a table partitioned by month. The rebalance step gathers small
    months into one file and splits a month that is far larger than the others."""
    by_month(landing, ts).hint("rebalance", MONTH).write.mode(mode).partitionBy(MONTH).parquet(path)


def write_core(core: DataFrame, path: str, contract: Contract, mode: str = "append") -> None:
    """Store core rows by month of the contract's immutable column, if it has one.
    ``current_state`` then opens only the months of its window."""
    if contract.partition_on is None:
        core.write.mode(mode).parquet(path)
    else:
        write_partitioned(core, path, contract.partition_on, mode)


def apply_retention(
    df: DataFrame, as_of: datetime, days: int, clock: str = "_ingested_at"
) -> DataFrame:
    """Rows not older than ``days``; a plain filter that prunes files."""
    return df.where(F.col(clock) >= stamp(as_of - timedelta(days=days)))


# --- binary messages with a schema-registry header --------------------------

HEADER_BYTES = 5  # magic byte and schema id


def split_frame(df: DataFrame, col: str) -> DataFrame:
    """Header of a framed message: magic byte, big-endian schema id, payload."""
    data = F.col(col)
    return df.withColumns(
        {
            "_magic": F.conv(F.hex(F.substring(data, 1, 1)), 16, 10).cast("int"),
            "_schema_id": F.conv(F.hex(F.substring(data, 2, 4)), 16, 10).cast("int"),
            "_payload": F.expr(f"substring({col}, 6)"),
        }
    )


@dataclass(frozen=True)
class Framed:
    """How to read framed messages: the known ``schemas`` by id, and ``decode(column, schema)``,
    which gives a struct or null. It defaults to Spark's ``from_avro``, which needs the spark-avro
    package on the cluster."""

    schemas: Mapping[int, str]
    decode: Callable[[Column, str], Column] | None = None

    def decoder(self) -> Callable[[Column, str], Column]:
        if self.decode is not None:
            return self.decode
        from pyspark.sql.avro.functions import from_avro

        return lambda payload, schema: from_avro(payload, schema, {"mode": "PERMISSIVE"})

    def __call__(self, messages: DataFrame, contract: Contract) -> DataFrame:
        return parse_framed(messages, contract, self)


def parse_framed(messages: DataFrame, contract: Contract, framed: Framed) -> DataFrame:
    """Framed binary messages (column ``value``) to one text column per landing field, as
    ``parse_lines`` does for JSON, in one plan for all schema ids.

    ``_schema_id`` is that of the header; the other technical columns come from the message where
    the source is a topic. Fields that a schema does not have are null, fields that the contract
    does not have are left out. ``_frame`` says why a message cannot be read: it is shorter than
    its header, has another magic byte, an unknown schema, or a payload that does not decode.
    The quarantined line is the whole message in hexadecimal, so it can be sent again.
    """
    decode, records = framed.decoder(), {i: f"_record_{i}" for i in framed.schemas}
    value = F.col("value")
    out = split_frame(messages.select("value", *_message_columns(messages)), "value")
    mine = {i: (F.col("_magic") == 0) & (F.col("_schema_id") == i) for i in records}
    # a message is decoded by its own schema alone; ``inline`` keeps decoding a step of its own
    each = [F.when(mine[i], decode(F.col("_payload"), framed.schemas[i])).alias(name) for i, name in records.items()]
    out = out.select("*", F.inline(F.array(F.struct(*each))))
    decoded = reduce(lambda a, b: a | b, [F.col(name).isNotNull() for name in records.values()], F.lit(False))
    frame = (
        F.when(value.isNull() | (F.octet_length(value) < HEADER_BYTES), "frame:short")
        .when(F.col("_magic") != 0, "frame:magic")
        .when(~F.col("_schema_id").isin(*records), "frame:schema")
        .when(~decoded, "frame:payload")
    )
    fields: dict[str, Column] = {}
    for field in contract.landing_schema.fields:
        held = [F.col(f"{r}.{field.name}").cast("string") for r in records.values() if field.name in out.schema[r].dataType.names]
        fields[field.name] = F.coalesce(*held) if held else F.lit(None).cast("string")
    fields["_schema_id"] = F.col("_schema_id").cast("string")
    for name, source in MESSAGE.items():
        if source in messages.columns:
            fields[name] = F.col(f"_msg_{source}")
    line = F.hex(value)
    return out.select(
        line.alias("_line"), frame.alias("_frame"), F.when(frame.isNotNull(), F.coalesce(line, F.lit(""))).alias("_corrupt"),
        *[col.alias(name) for name, col in fields.items()],
    )


# --- schema conformance ---------------------------------------------------


def conformance(landing: DataFrame, contract: Contract) -> DataFrame:
    """One row: nulls in required columns, values outside their domain, and
    columns whose type differs from the contract."""
    actual = {f.name: f.dataType for f in landing.schema.fields}
    mismatched = sum(
        1 for f in contract.landing_schema.fields if actual.get(f.name) != f.dataType
    )
    nulls = [F.count_if(F.col(c).isNull()) for c in contract.required]
    domains = {**contract.domains, "_op": OPERATIONS}
    outside = [F.count_if(~F.col(c).isin(*values)) for c, values in domains.items()]
    return landing.agg(
        sum(nulls, F.lit(0)).cast("bigint").alias("required_nulls"),
        sum(outside, F.lit(0)).cast("bigint").alias("outside_domain"),
    ).select(
        F.lit(contract.context).alias("context"),
        F.lit(contract.entity).alias("entity"),
        "required_nulls",
        "outside_domain",
        F.lit(mismatched).alias("type_mismatches"),
    )
