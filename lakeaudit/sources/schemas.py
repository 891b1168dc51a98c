"""All schemas are fixed; none is inferred (section 1 of the survey)."""

from __future__ import annotations

from pyspark.sql import types as T

_text, _long, _int, _time, _double = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType(), T.DoubleType()
MONEY = T.DecimalType(18, 2)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, t) for k, t in fields.items()])


RAW_MESSAGE = _struct(key=T.BinaryType(), value=T.BinaryType(), topic=_text, partition=_int, offset=_long, timestamp=_time)
TRANSACTION = _struct(
    event_id=_text, source=_text, event_time=_time, ingested_at=_time, step=_int, type=_text, amount=_double, nameOrig=_text, oldbalanceOrg=_double,
    newbalanceOrig=_double, nameDest=_text, oldbalanceDest=_double, newbalanceDest=_double,
)
LABEL = _struct(event_id=_text, source=_text, isFraud=_int, isFlaggedFraud=_int)
LINEAGE = _struct(message_schema_id=_long, kafka_topic=_text, kafka_partition=_int, kafka_offset=_long, kafka_timestamp=_time)
LANDED_TRANSACTION = T.StructType([*TRANSACTION.fields, *LINEAGE.fields])
LANDED_LABEL = T.StructType([*LABEL.fields, *LINEAGE.fields])
MANIFEST = _struct(pipeline=_text, batch_id=_long, event_date=T.DateType(), source=_text, input_rows=_long, valid_rows=_long, quarantine_rows=_long)
LEDGER = _struct(pipeline=_text, batch_id=_long, status=_text, source_prefix=_text, run_id=_text, finished_at=_time, error_message=_text)
REPLAY_CSV = _struct(
    step=_int, type=_text, amount=_double, nameOrig=_text, oldbalanceOrg=_double, newbalanceOrig=_double, nameDest=_text, oldbalanceDest=_double,
    newbalanceDest=_double, isFraud=_int, isFlaggedFraud=_int,
)
TRAINING = _struct(
    source=_text, event_id=_text, event_time=_time, event_date=T.DateType(), step=_int, transaction_type=_text, amount=MONEY, origin_balance_before=MONEY,
    origin_balance_after=MONEY, destination_balance_before=MONEY, destination_balance_after=MONEY, origin_balance_delta=MONEY, destination_balance_delta=MONEY,
    origin_amount_residual=MONEY, destination_amount_residual=MONEY, is_fraud=_int,
)
