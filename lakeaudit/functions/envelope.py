"""The message envelope: a zero byte, a big-endian 4-byte schema id, and the body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BYTES = 6


def inspect(messages: DataFrame, schema_ids: list[int], reader_id: int) -> DataFrame:
    """messages(value, ...) with magic_byte, message_schema_id, value_size, payload, reader_schema_id and the header's
    quarantine_reason: the first rule that applies, else null."""
    value = F.col("value")
    number = lambda a, n: F.conv(F.nullif(F.hex(F.substring(value, a, n)), F.lit("")), 16, 10).cast("long")
    parts = messages.withColumns({
        "magic_byte": number(1, 1), "message_schema_id": number(2, 4), "value_size": F.length(value),
        "payload": F.substring(value, LEAST_BYTES, 2**31 - 1), "reader_schema_id": F.lit(reader_id),
    })
    return parts.withColumn("quarantine_reason", header_reason(schema_ids))


def header_reason(schema_ids: list[int]) -> Column:
    return (
        F.when(F.col("value").isNull(), "NULL_KAFKA_VALUE")
        .when(F.col("value_size") < LEAST_BYTES, "CONFLUENT_MESSAGE_TOO_SHORT")
        .when(F.col("magic_byte") != 0, "INVALID_CONFLUENT_MAGIC_BYTE")
        .when(~F.col("message_schema_id").isin(*schema_ids), "UNSUPPORTED_SCHEMA_ID")
    )


def frame(body: Column, schema_id: Column) -> Column:
    """Body bytes in an envelope."""
    return F.concat(F.unhex(F.lit("00")), F.unhex(F.lpad(F.hex(schema_id.cast("long")), 8, "0")), body.cast("binary"))
