"""Replaying a CSV of transactions as framed messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeaudit.functions.envelope import frame
from lakeaudit.functions.values import event_time_ms
from lakeaudit.sources.schemas import REPLAY_CSV
from lakeaudit.sources.zones import materialized

SOURCE = "paysim"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The file's rows, after a check of its header; a missing column or an empty file is an error."""
    header = spark.read.option("header", True).csv(path).columns
    if missing := set(REPLAY_CSV.fieldNames()) - set(header):
        raise ValueError(f"the CSV lacks columns: {sorted(missing)}")
    by_name = spark.read.option("header", True).csv(path)
    rows = by_name.select(*(F.col(f.name).cast(f.dataType) for f in REPLAY_CSV), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    if rows.isEmpty():
        raise ValueError("the CSV has no rows")
    return rows


def _laid_out(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows in ranges of ``order``, sorted, with ``part`` and ``place``. The layout is written, so that what is counted by it stays so."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return materialized(ranged.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with row_number from 1, by ``order`` (W4). Distributed: rows are range-partitioned and each range is counted; the
    offset of a range is the number of rows before it. Only one count for each range is gathered."""
    laid = _laid_out(rows, order)
    counts = laid.groupBy("part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = counts.select(F.col("part").alias("p"), "first", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    out = laid.join(F.broadcast(before), F.col("part") == F.col("p"))  # a row for each range
    return out.withColumn("row_number", F.col("place") - F.col("first") + F.col("before") + 1).drop("part", "place", "p", "first", "before")


def timed(rows: DataFrame, number: str = "row_number") -> DataFrame:
    """Rows with their place in the step and event time; the counts are those of the whole file (W3, A10, X6). A step that is null or
    below 1 is an error. Distributed as ``numbered`` is: a step that has many rows lies in many ranges, and what is gathered is one count
    for each step of each range."""
    step = F.when(F.col("step") >= 1, F.col("step")).otherwise(F.raise_error(F.lit("a step must be a number from 1")).cast("int"))
    laid = _laid_out(rows.withColumn("step", step), ["step", number])
    counts = laid.groupBy(F.col("step").alias("of_step"), F.col("part").alias("p")).agg(F.count("*").alias("n"), F.min("place").alias("first"))
    whole = W.partitionBy("of_step")
    before = counts.withColumns({"before": F.sum("n").over(whole.orderBy("p")) - F.col("n"), "rows_in_step": F.sum("n").over(whole)}).drop("n")
    out = laid.join(before, (F.col("step") == F.col("of_step")) & (F.col("part") == F.col("p")))
    out = out.withColumn("ordinal", F.col("place") - F.col("first") + F.col("before")).drop("of_step", "part", "place", "p", "first", "before")
    return out.withColumn("event_time_ms", event_time_ms(F.col("step"), F.col("ordinal"), F.col("rows_in_step")))


def part(rows: DataFrame, skip: int = 0, most: int | None = None, number: str = "row_number") -> DataFrame:
    """The rows after the first ``skip``, ``most`` of them; ordinals are those of the whole file."""
    out = rows.where(F.col(number) > skip)
    return out if most is None else out.where(F.col(number) <= skip + most)


def event_id(number: Column) -> Column:
    return F.format_string("paysim-%010d", number)


def events(rows: DataFrame, number: str = "row_number") -> DataFrame:
    """The transaction message of each row."""
    c = F.col
    names = ("type", "amount", "nameOrig", "oldbalanceOrg", "newbalanceOrig", "nameDest", "oldbalanceDest", "newbalanceDest")
    return rows.select(event_id(c(number)).alias("event_id"), F.lit(SOURCE).alias("source"), F.timestamp_millis("event_time_ms").alias("event_time"), F.current_timestamp().alias("ingested_at"), "step", *names)


def labels(rows: DataFrame, number: str = "row_number") -> DataFrame:
    return rows.select(event_id(F.col(number)).alias("event_id"), F.lit(SOURCE).alias("source"), "isFraud", "isFlaggedFraud")


def messages(records: DataFrame, topic: str, schema_id: int) -> DataFrame:
    """Records as framed messages, keyed by event id (S18, S19). The body is JSON; with spark-avro present, frame to_avro instead."""
    body = F.to_json(F.struct(*records.columns))
    headers = F.array(F.struct(F.lit("content-type").alias("key"), F.lit("application/json").cast("binary").alias("value")))
    return records.select(F.col("event_id").cast("binary").alias("key"), frame(body, F.lit(schema_id)).alias("value"), F.lit(topic).alias("topic"), headers.alias("headers"))
