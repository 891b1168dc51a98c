"""Batch loading: pending batches, reconciliation, typed rows, staging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeaudit.functions.values import to_money, unsigned

PIPELINES = ("transactions", "labels")
RUN_LIMIT = 200
ID_BLOCK = 4096
LAST_ID = (1 << 63) - 1
OPEN_RANGES = 256


def loaded_batches(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("pipeline", "batch_id").agg(F.count_if(F.col("status") == "success").alias("n")).where("n > 0").drop("n")


def pending_batches(discovered: DataFrame, ledger: DataFrame, limit: int = RUN_LIMIT, failed_last: bool = False) -> DataFrame:
    """Discovered batches that are not loaded, the first of a run (B1, A8, J8, L1). With ``failed_last`` those that have failed come
    after those that have not, the least tried first, so that broken batches cannot fill every run."""
    pending = discovered.join(loaded_batches(ledger), ["pipeline", "batch_id"], "left_anti")
    if not failed_last:
        return pending.orderBy("pipeline", "batch_id").limit(limit)
    tried = ledger.where("status = 'failed'").groupBy("pipeline", "batch_id").agg(F.count("*").alias("tried"))
    pending = pending.join(tried, ["pipeline", "batch_id"], "left").withColumn("tried", F.coalesce("tried", F.lit(0)))
    return pending.orderBy("pipeline", "tried", "batch_id").limit(limit).select(*discovered.columns)


def open_ranges(ledger: DataFrame, pipeline: str, most: int = OPEN_RANGES) -> list[tuple[int, int]]:
    """The ids that a pipeline has not loaded, as ranges (first, last): the gaps, failed batches among them, and all ids after the last
    loaded (B1). A listing need look at no others.

    Ids are compared by blocks of ``ID_BLOCK``; what reaches the driver is a row for each block and the ids that it lacks. Of
    more than ``most`` ranges the nearest are joined, which lists some loaded batches once more and misses none.
    """
    loaded = ledger.where((F.col("pipeline") == pipeline) & (F.col("status") == "success"))
    blocks = loaded.groupBy(F.expr(f"batch_id div {ID_BLOCK}").alias("block")).agg(F.collect_set("batch_id").alias("ids"))
    first = F.col("block") * ID_BLOCK
    lacking = blocks.select("block", F.array_except(F.sequence(first, first + (ID_BLOCK - 1)), "ids").alias("ids"))
    ranges, at = [], 0
    for r in sorted(lacking.collect(), key=lambda r: r["block"]):
        start = r["block"] * ID_BLOCK
        runs = [(at, start - 1)] if at < start else []
        runs += [(i, i) for i in sorted(r["ids"])]
        for low, high in runs:
            if ranges and ranges[-1][1] == low - 1:
                ranges[-1] = (ranges[-1][0], high)
            else:
                ranges.append((low, high))
        at = start + ID_BLOCK
    if ranges and ranges[-1][1] == at - 1:
        ranges[-1] = (ranges[-1][0], LAST_ID)
    else:
        ranges.append((at, LAST_ID))
    apart = sorted(range(1, len(ranges)), key=lambda i: ranges[i - 1][1] - ranges[i][0])[: most - 1]  # the widest first
    cuts = [0, *sorted(apart), len(ranges)]
    return [(ranges[a][0], ranges[b - 1][1]) for a, b in zip(cuts, cuts[1:], strict=False)]


def manifest_summary(manifest: DataFrame, by: list[str], pipeline: Column, batch: Column) -> DataFrame:
    """The counts that decide on a batch, for all batches at once (A6). Null dates count in a key."""
    return manifest.groupBy(*by).agg(
        F.count("*").alias("manifest_rows"),
        F.count_if((F.col("pipeline") != pipeline) | (F.col("batch_id") != batch)).alias("identity_errors"),
        F.count_if(F.col("input_rows") != F.col("valid_rows") + F.col("quarantine_rows")).alias("reconciliation_errors"),
        F.count_if((F.col("input_rows") < 0) | (F.col("valid_rows") < 0) | (F.col("quarantine_rows") < 0)).alias("negative_counts"),
        (F.count("*") - F.count_distinct(F.struct("event_date", "source"))).alias("duplicate_keys"),
        *(F.sum(c).alias(c) for c in ("input_rows", "valid_rows", "quarantine_rows")),
    )


def rejection_reason() -> Column:
    """Of a summary, the first rule broken (B2). The last cannot be once the rows reconcile; it is an assertion."""
    c = F.col
    return (
        F.when((c("manifest_rows") == 0) | (c("input_rows") == 0), "EMPTY_MANIFEST")
        .when(c("identity_errors") > 0, "IDENTITY_MISMATCH")
        .when(c("reconciliation_errors") > 0, "ROW_NOT_RECONCILED")
        .when(c("negative_counts") > 0, "NEGATIVE_COUNT")
        .when(c("duplicate_keys") > 0, "DUPLICATE_KEY")
        .when(c("input_rows") != c("valid_rows") + c("quarantine_rows"), "TOTALS_NOT_RECONCILED")
        .otherwise("OK")
    )


def count_check(summary: DataFrame, counts: DataFrame, by: list[str]) -> DataFrame:
    """summary with rows_found and count_matches; a batch without valid rows has no files and is not counted."""
    out = summary.join(counts.select(*by, "rows_found"), by, "left").withColumn("rows_found", F.coalesce("rows_found", F.lit(0)))
    return out.withColumn("count_matches", (F.col("valid_rows") == 0) | (F.col("valid_rows") == F.col("rows_found")))


def typed_transactions(landed: DataFrame, batch: Column, file: Column, now: Column) -> DataFrame:
    """Landed transactions as the warehouse has them."""
    c = F.col
    return landed.select(
        "event_id", "source", "event_time", "ingested_at", unsigned(c("step"), 16).alias("step"), c("type").alias("transaction_type"), to_money(c("amount")).alias("amount"),
        c("nameOrig").alias("origin_account"), to_money(c("oldbalanceOrg")).alias("origin_balance_before"), to_money(c("newbalanceOrig")).alias("origin_balance_after"),
        c("nameDest").alias("destination_account"), to_money(c("oldbalanceDest")).alias("destination_balance_before"), to_money(c("newbalanceDest")).alias("destination_balance_after"),
        *_lineage(batch, file, now),
    )


def typed_labels(landed: DataFrame, batch: Column, file: Column, now: Column) -> DataFrame:
    c = F.col
    return landed.select("event_id", "source", unsigned(c("isFraud"), 8).alias("is_fraud"), unsigned(c("isFlaggedFraud"), 8).alias("is_flagged_fraud"), *_lineage(batch, file, now))


def typed_quality(manifest: DataFrame, pipeline: str, batch: Column, now: Column) -> DataFrame:
    """Manifest rows as the warehouse has them; those of another pipeline or batch stay behind."""
    c = F.col
    own = manifest.where((c("pipeline") == pipeline) & (c("batch_id") == batch))
    # A number of unsigned 64 bits does not fit a long; decimal(20,0) holds it, and a negative one is as far below 2**64.
    wide = lambda x: F.pmod(c(x).cast("decimal(38,0)"), F.lit(str(1 << 64)).cast("decimal(38,0)")).cast("decimal(20,0)").alias(x)
    return own.select("pipeline", wide("batch_id"), "event_date", "source", *map(wide, ("input_rows", "valid_rows", "quarantine_rows")), now.alias("loaded_at"))


def _lineage(batch: Column, file: Column, now: Column) -> list[Column]:
    c = F.col
    return [
        unsigned(c("message_schema_id"), 32).alias("schema_id"), "kafka_topic", unsigned(c("kafka_partition"), 16).cast("int").alias("kafka_partition"), c("kafka_offset").cast("long").alias("kafka_offset"),
        "kafka_timestamp", batch.cast("long").alias("minio_batch_id"), file.alias("minio_object"), now.alias("loaded_at"),
    ]


#: The types of the staged columns.
STAGED = {
    "transactions": "event_id string, source string, event_time timestamp_ntz, ingested_at timestamp_ntz, step int, transaction_type string, amount decimal(18,2), origin_account string, origin_balance_before decimal(18,2), origin_balance_after decimal(18,2), destination_account string, destination_balance_before decimal(18,2), destination_balance_after decimal(18,2), schema_id bigint, kafka_topic string, kafka_partition int, kafka_offset bigint, minio_batch_id bigint, minio_object string, loaded_at timestamp_ntz",
    "labels": "event_id string, source string, is_fraud int, is_flagged_fraud int, schema_id bigint, kafka_topic string, kafka_partition int, kafka_offset bigint, minio_batch_id bigint, minio_object string, loaded_at timestamp_ntz",
    "batches": "pipeline string, batch_id bigint, status string, source_prefix string, run_id string, finished_at timestamp_ntz, error_message string",
    "manifest": "pipeline string, batch_id bigint, event_date date, source string, input_rows bigint, valid_rows bigint, quarantine_rows bigint",
}


def staged(rows: DataFrame, name: str, *more: str) -> DataFrame:
    """The columns of a staging view, cast, and ``more`` as they are."""
    fields = T.StructType.fromDDL(STAGED[name])
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields), *more)
