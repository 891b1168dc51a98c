"""From raw messages to valid rows, quarantine and manifest (P1-P5, F1-F4, A1, U1-U3, T7). Batch and streaming share these."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeaudit.functions import rules
from lakeaudit.functions.envelope import inspect
from lakeaudit.sources import schemas

Decoder = Callable[[Column, str, T.StructType], Column]


def json_decoder(payload: Column, writer: str, reader: T.StructType) -> Column:
    """A JSON body. What is no JSON gives a record of nulls (N8); the writer's schema is not needed."""
    return F.from_json(payload.cast("string"), reader, {"mode": "PERMISSIVE"})


def avro_decoder(reader_json: str) -> Decoder:
    """An Avro body, read from the writer's schema into the reader's; the spark-avro package must be on the class path."""

    def decode(payload: Column, writer: str, reader: T.StructType) -> Column:
        from pyspark.sql.avro.functions import from_avro

        return from_avro(payload, writer, {"mode": "PERMISSIVE", "avroSchema": reader_json})

    return decode


@dataclass(frozen=True)
class SchemaCatalog:
    """The registered versions of a subject: writer schemas by id, and the id of the reader's."""

    writers: dict[int, str]
    reader_id: int

    def __post_init__(self) -> None:
        if self.reader_id not in self.writers:
            raise ValueError("the reader schema is not registered")

    @staticmethod
    def of(versions: DataFrame, subject: str) -> SchemaCatalog:
        """From versions(subject, version, id, schema): the highest version is the reader's (L5). A subject has few versions."""
        rows = versions.where(F.col("subject") == subject).select("version", "id", "schema").collect()
        if not rows:
            raise ValueError(f"no schema is registered for {subject}")
        return SchemaCatalog({r["id"]: r["schema"] for r in rows}, max(rows, key=lambda r: r["version"])["id"])


@dataclass(frozen=True)
class LandingConfig:
    """One pipeline: its name, record schema, rules, and the time column that dates its rows, if any."""

    pipeline: str
    record: T.StructType
    reason: Callable[[Column], Column]
    time_column: str | None = None
    date_column: str | None = None
    decoder: Decoder = json_decoder

    def __post_init__(self) -> None:
        if (self.time_column is None) != (self.date_column is None):
            raise ValueError("time_column and date_column go together")


TRANSACTIONS = LandingConfig("transactions", schemas.TRANSACTION, rules.transaction_reason, "event_time", "event_date")
LABELS = LandingConfig("labels", schemas.LABEL, rules.label_reason)


@dataclass(frozen=True)
class Landed:
    """Messages with their header columns, ``record`` (null where the header is bad) and ``quarantine_reason`` (null if valid; header
    reasons come before those of the record). One row set: each message is inspected and decoded once, whatever is made of it."""

    judged: DataFrame
    config: LandingConfig

    @property
    def decoded(self) -> DataFrame:
        """The messages with a fine header."""
        return self.judged.where("record is not null")

    def valid(self) -> DataFrame:
        """Record fields with lineage, and the date."""
        c = self.config
        lineage = [F.col(k).alias(f"kafka_{k}") for k in ("topic", "partition", "offset", "timestamp")]
        rows = self.judged.where("quarantine_reason is null").select("record.*", "message_schema_id", *lineage)
        return rows.withColumn(c.date_column, F.to_date(c.time_column)) if c.date_column else rows

    def quarantine(self) -> DataFrame:
        """Messages of both kinds of failure, with their bytes."""
        return _quarantined(self.judged.where("quarantine_reason is not null"))

    def manifest(self, batch_id: int) -> DataFrame:
        """Counts for each date and source; what cannot be dated or named has a bucket of its own, as a bad header has no record
        (A1, U3, N9, N10)."""
        c = self.config
        bad = F.col("quarantine_reason").isNotNull()
        date = F.to_date(F.col(f"record.{c.time_column}")) if c.time_column else F.lit(None).cast("date")
        rows = self.judged.select(date.alias("event_date"), rules.known_source(F.col("record.source")).alias("source"), (~bad).alias("ok"))
        counts = rows.groupBy("event_date", "source").agg(F.count("*").alias("input_rows"), F.count_if("ok").alias("valid_rows"), F.count_if(~F.col("ok")).alias("quarantine_rows"))
        return counts.select(F.lit(c.pipeline).alias("pipeline"), F.lit(batch_id).cast("long").alias("batch_id"), *counts.columns)


def _quarantined(messages: DataFrame) -> DataFrame:
    lineage = [F.col(k).alias(f"kafka_{k}") for k in ("topic", "partition", "offset", "timestamp")]
    stored = [F.base64(k).alias(f"kafka_{k}_base64") for k in ("key", "value")]
    when = [F.current_timestamp().alias("quarantined_at"), F.to_date("timestamp").alias("kafka_date")]
    return messages.select("quarantine_reason", "reader_schema_id", "message_schema_id", "magic_byte", "value_size", *lineage, *stored, *when)


def land(messages: DataFrame, catalog: SchemaCatalog, config: LandingConfig) -> Landed:
    """Classify, decode and validate messages.

    The branch of each registered writer is a case of one expression, so that the messages are read once and no union is needed (U1);
    with a JSON body the writer's schema makes no difference. The record comes out of a generator of one row: no filter on its fields is
    pushed below that, where it would decode the body once more for each of them.
    """
    headers = inspect(messages, sorted(catalog.writers), catalog.reader_id)
    if config.decoder is json_decoder:
        decoded = json_decoder(F.col("payload"), "", config.record)
    else:
        decoded = F.lit(None).cast(config.record)
        for writer, schema in sorted(catalog.writers.items()):
            decoded = F.when(F.col("message_schema_id") == writer, config.decoder(F.col("payload"), schema, config.record)).otherwise(decoded)
    # What does not decode is a record of nulls, as from a decoder in permissive mode; no record at all means a bad header.
    blank = F.from_json(F.lit("{}"), config.record)
    record = F.when(F.col("quarantine_reason").isNull(), F.coalesce(decoded, blank))
    rows = headers.select("*", F.explode(F.array(record)).alias("record"))
    reason = F.coalesce("quarantine_reason", F.when(F.col("record").isNotNull(), config.reason(F.col("record"))))
    return Landed(rows.withColumn("quarantine_reason", reason), config)


def replay_quarantine(stored: DataFrame) -> DataFrame:
    """Raw messages again, from the bytes in quarantine, to be landed anew."""
    return stored.select(F.unbase64("kafka_key_base64").alias("key"), F.unbase64("kafka_value_base64").alias("value"), *(F.col(f"kafka_{k}").alias(k) for k in ("topic", "partition", "offset", "timestamp")))
