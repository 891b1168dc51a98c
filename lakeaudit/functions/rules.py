"""Validation rules as column builders: record column to reason, null if valid; the first that applies holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def transaction_reason(record: Column) -> Column:
    event, taken = record["event_time"], record["ingested_at"]
    return (
        F.when(record["event_id"].isNull(), "AVRO_DECODE_FAILED")
        .when(event.isNull(), "MISSING_EVENT_TIME")
        .when(taken.isNull(), "MISSING_INGESTED_AT")
        .when(event > taken, "EVENT_TIME_AFTER_INGESTED_AT")
        .when(record["step"] < 1, "INVALID_STEP")
    )


def label_reason(record: Column) -> Column:
    return (
        F.when(record["event_id"].isNull(), "AVRO_DECODE_FAILED")
        .when(~record["isFraud"].isin(0, 1), "INVALID_IS_FRAUD")
        .when(~record["isFlaggedFraud"].isin(0, 1), "INVALID_IS_FLAGGED_FRAUD")
    )


def known_source(source: Column) -> Column:
    """A null or blank source is unknown; any other stays as it is, untrimmed."""
    return F.when(source.isNull() | (F.trim(source) == ""), "unknown").otherwise(source)
