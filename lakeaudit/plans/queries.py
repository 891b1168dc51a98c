"""The registered queries of the event lakehouse, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.functions import envelope, evolution
from lakeaudit.operators import canonical, checks, contract, landing, loading, replay, training
from lakeaudit.plans import suites
from lakeaudit.plans.loader import Warehouse
from lakeaudit.plans.marts import Marts
from lakeaudit.sources import fixtures as fx
from lakeaudit.sources import offsets, zones
from lakeaudit.streaming.landing import Zones, start_landing

CATALOG = landing.SchemaCatalog({1: "", 2: ""}, 2)
#: Three versions of the transaction schema; messages of each are read into the last.
VERSIONS = landing.SchemaCatalog(fx.VERSIONS, max(fx.VERSIONS))
BALANCES = [f"{side}_balance_{when}" for side in ("origin", "destination") for when in ("before", "after")]
FACT = ["source", "event_id", "event_time", "event_date", "step", "transaction_type", "amount", "origin_account", "destination_account", *BALANCES, "canonical_kafka_partition", "canonical_kafka_offset", "canonical_minio_batch_id", "physical_row_count", "replay_row_count", "payload_version_count", "has_payload_conflict", "has_invalid_amount", "has_invalid_balance"]
LABEL_FACT = ["source", "event_id", "is_fraud", "is_flagged_fraud", "canonical_kafka_partition", "canonical_kafka_offset", "canonical_minio_batch_id", "physical_row_count", "replay_row_count", "payload_version_count", "has_payload_conflict"]
#: The months that ``warehouse_months`` reads, and the one that it writes anew.
FIRST_MONTH, MENDED_MONTH, LAST_MONTH = "199512", "199601", "199602"
RANKED = ["source", "event_id", "kafka_partition", "kafka_offset", "minio_batch_id", "canonical_rank", "physical_row_count", "payload_version_count"]


class Lake:
    """The inputs and marts over the tables of one directory; every model is a DataFrame that Catalyst inlines."""

    def __init__(self, spark: SparkSession, sf_dir: str, warehouse: Warehouse | None = None) -> None:
        """Staged rows come from the warehouse if one is given, else from the fixtures over the tables of sf_dir."""
        self.spark, self.dir, self.warehouse = spark, sf_dir, warehouse
        #: What staged rows can be had dealt out by; a warehouse's are dealt out by their key.
        self.deal = None if warehouse else fx.DEAL

    def fixture(self, sql: str) -> DataFrame:
        return fx.spark(self.spark, self.dir, sql)

    def staged(self, name: str) -> DataFrame:
        if self.warehouse:
            return loading.staged(self.warehouse.table(self.spark, name), name)
        sql = {"transactions": fx.TRANSACTIONS, "labels": fx.LABELS, "batches": fx.LEDGER, "manifest": fx.MANIFEST}[name]
        return loading.staged(self.fixture(sql), name)

    def committed(self) -> DataFrame:
        return canonical.committed_batches(self.staged("batches"))

    def committed_rows(self, name: str, committed: DataFrame | None = None) -> DataFrame:
        """The staged transactions or labels of committed batches (J1, J2). The batches are written: Spark broadcasts them while their file is small."""
        return self._of_batches(self.staged(name), name, committed)

    def dealt_rows(self, name: str, committed: DataFrame | None = None) -> DataFrame:
        """The same, with the column ``deal`` and lying by it, if there is one."""
        rows = loading.staged(fx.dealt(self.spark, self.dir, name), name, self.deal) if self.deal else self.staged(name)
        return self._of_batches(rows, name, committed)

    def _of_batches(self, rows: DataFrame, name: str, committed: DataFrame | None) -> DataFrame:
        bits = canonical.batch_bits(self.committed() if committed is None else committed, name)
        return canonical.rows_of_batches(rows, zones.materialized(bits))

    def transactions(self) -> DataFrame:
        return canonical.transaction_facts(self.dealt_rows("transactions"), None, deal=self.deal)

    def labels(self) -> DataFrame:
        return canonical.label_facts(self.dealt_rows("labels"), None, self.deal)

    def labeled(self) -> DataFrame:
        return training.labeled_facts(self.dealt_rows("transactions"), None, self.labels(), self.deal)

    def candidates(self) -> DataFrame:
        return training.candidates(self.labeled())

    def landed(self) -> landing.Landed:
        return landing.land(fx.raw_messages(self.spark, self.dir), CATALOG, landing.TRANSACTIONS)

    def landed_labels(self) -> landing.Landed:
        return landing.land(fx.raw_labels(self.spark, self.dir), CATALOG, landing.LABELS)

    def reasons(self, landed: landing.Landed) -> DataFrame:
        return landed.judged.select("offset", F.coalesce("quarantine_reason", F.lit("VALID")).alias("reason"))

    def summary(self) -> DataFrame:
        return loading.manifest_summary(self.fixture(fx.MANIFEST), ["dir"], F.lit("transactions"), F.col("dir"))

    def replayed(self) -> DataFrame:
        e = self.spark.read.parquet(f"{self.dir}/events.parquet").select(F.col("event_id").alias("id"), (1 + F.col("event_id") % 743).cast("int").alias("step"), "event_type", "value")
        return replay.timed(replay.numbered(e, ["id"]))


def _landing_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landing job itself over raw messages in files; the sum of its manifests."""
    root = f"{zones.shared_folder(spark)}/landing-{uuid.uuid4().hex}"
    messages, n = fx.raw_messages(spark, sf_dir), int(spark.conf.get("spark.sql.shuffle.partitions"))
    messages.repartition(n).write.parquet(f"{root}/raw")
    # A micro-batch takes a quarter of the files: it grows with the input, as do the tasks that write and read them.
    start_landing(zones.raw_stream(spark, f"{root}/raw", max(1, n // 4)), CATALOG, landing.TRANSACTIONS, Zones(root), f"{root}/state", None).awaitTermination()
    return _landed_counts(spark, root)


def _landing_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landing job over a log of two appends, read by offsets; a micro-batch takes a quarter of them. The sum of its manifests."""
    root = f"{zones.shared_folder(spark)}/landing-{uuid.uuid4().hex}"
    messages = fx.raw_messages(spark, sf_dir)
    last = messages.agg(F.max("offset")).first()[0] or 0
    for number, part in enumerate((F.col("offset") <= last // 2, F.col("offset") > last // 2)):
        offsets.append_log(messages.where(part), f"{root}/log", number, max(1, last // 20))
    # The three partitions hold every third offset each, so that their ranges together span three times the last.
    stream = offsets.log_stream(spark, f"{root}/log", max(1, 3 * last // 4))
    query = start_landing(stream, CATALOG, landing.TRANSACTIONS, Zones(root), f"{root}/state", "0 seconds")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return _landed_counts(spark, root)


def _landed_counts(spark: SparkSession, root: str) -> DataFrame:
    manifest = zones.scan(spark, Zones(root).quality, zones.MANIFEST)
    return manifest.groupBy("event_date", "source").agg(*(F.sum(c).alias(c) for c in ("input_rows", "valid_rows", "quarantine_rows")))


def _replay_columns(rows: DataFrame) -> DataFrame:
    blank = [F.col("event_type").alias("type"), F.col("value").alias("amount"), *(F.lit(n[0]).alias(n) for n in ("nameOrig", "nameDest")), *(F.lit(0.0).alias(n) for n in ("oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"))]
    return rows.select("row_number", "step", "event_time_ms", *blank, (F.col("id") % 2).cast("int").alias("isFraud"), F.lit(0).alias("isFlaggedFraud"))


def _layout(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.date_format("event_time", "yyyyMM").alias("event_month")).agg(F.count("*").alias("row_count"), F.count_distinct(F.struct("source", "event_id")).alias("keys"))


def _message_check(lake: Lake) -> DataFrame:
    """Replayed records framed and landed again."""
    records = replay.events(_replay_columns(lake.replayed()))
    sent = replay.messages(records.withColumn("ingested_at", F.col("event_time")), "transactions", 2)
    sent = sent.withColumns({"partition": F.lit(0), "offset": F.lit(0).cast("long"), "timestamp": F.lit(None).cast("timestamp")})
    valid = landing.land(sent.drop("headers"), CATALOG, landing.TRANSACTIONS).valid()
    return valid.select("event_id", "step", F.unix_millis("event_time").alias("event_time_ms"), F.col("message_schema_id").alias("schema_id"))


def _versions(lake: Lake) -> DataFrame:
    """Messages of three writers, landed by the reader's schema."""
    decoder = evolution.resolving_decoder(VERSIONS.writers[VERSIONS.reader_id], evolution.json_body)
    landed = landing.land(fx.raw_versions(lake.spark, lake.dir), VERSIONS, replace(landing.TRANSACTIONS, decoder=decoder))
    row = lambda c: F.col(f"record.{c}").alias(c)
    named = [row(c) for c in ("event_id", "source", "step", "type", "amount", "nameOrig", "oldbalanceOrg", "newbalanceDest")]
    return landed.judged.select("offset", "message_schema_id", F.coalesce("quarantine_reason", F.lit("VALID")).alias("reason"), *named, F.unix_millis("record.event_time").alias("event_time_ms"), F.unix_millis("record.ingested_at").alias("ingested_at_ms"))


def _replayed_quarantine(lake: Lake) -> DataFrame:
    again = landing.replay_quarantine(lake.landed().quarantine())
    return lake.reasons(landing.land(again, CATALOG, landing.TRANSACTIONS)).groupBy("reason").agg(F.count("*").alias("row_count"))


#: The source that the contract asks for.
CONTRACT = contract.Contract("tpch")


def _contract_metrics(lake: Lake) -> DataFrame:
    marts = Marts(lake)
    return CONTRACT.metrics(marts.training, marts.transactions)


def _months(lake: Lake) -> DataFrame:
    """All months are written; one is then put anew without the rows of negative amounts, and three are read."""
    rows, path = lake.staged("transactions"), f"{zones.shared_folder(lake.spark)}/months-{uuid.uuid4().hex}"
    zones.append_monthly(rows, path)
    mended = rows.where((F.date_format("event_time", "yyyyMM") == MENDED_MONTH) & (F.col("amount") >= 0))
    zones.overwrite_months(mended, path)
    read = zones.read_months(lake.spark, path, FIRST_MONTH, LAST_MONTH)
    return read.groupBy("event_month").agg(F.count("*").alias("row_count"), F.sum("amount").cast("decimal(28,2)").alias("amount"), F.count_if(F.col("amount") < 0).alias("negative"))


def _bucketed(lake: Lake) -> DataFrame:
    """Facts and labels, with the columns that their queries give, in buckets by key, joined as they lie."""
    name = f"lake_{uuid.uuid4().hex}"
    root = f"{zones.shared_folder(lake.spark)}/{name}"
    facts = zones.write_bucketed(lake.transactions().select(*FACT), f"{name}_facts", f"{root}/facts", canonical.KEY)
    labels = zones.write_bucketed(lake.labels().select(*LABEL_FACT), f"{name}_labels", f"{root}/labels", canonical.KEY)
    return training.labeled(facts, labels)


_PLAIN: dict[str, Callable[[Lake], DataFrame]] = {
    "envelope_inspect": lambda k: envelope.inspect(fx.raw_messages(k.spark, k.dir), sorted(CATALOG.writers), CATALOG.reader_id).select("offset", "magic_byte", "message_schema_id", F.when(F.col("quarantine_reason").isNotNull(), F.col("value_size")).cast("long").alias("value_size"), F.coalesce("quarantine_reason", F.lit("OK")).alias("reason")),
    "validation_reasons": lambda k: k.reasons(k.landed()),
    "reason_counts": lambda k: k.reasons(k.landed()).groupBy("reason").agg(F.count("*").alias("row_count")),
    "label_validation": lambda k: k.reasons(k.landed_labels()),
    "quarantine_rows": lambda k: k.landed().quarantine().select("quarantine_reason", "kafka_partition", "kafka_offset", "kafka_key_base64", "kafka_date"),
    "schema_versions": _versions,
    "dq_suite_not_null": lambda k: suites.failures(Marts(k)).where("test = 'not_null'").drop("test"),
    "dq_suite_accepted_values": lambda k: suites.failures(Marts(k), [n for n, s in suites.SUITES.items() if s.accepted]).where("test = 'accepted_values'").drop("test"),
    "quarantine_replay": _replayed_quarantine,
    "quality_manifest": lambda k: k.landed().manifest(7),
    "label_manifest": lambda k: k.landed_labels().manifest(7),
    "valid_rows": lambda k: k.landed().valid().select("event_id", "source", "step", "amount", "event_date", "message_schema_id", "kafka_offset"),
    "manifest_reconcile": lambda k: k.summary().select("dir", loading.rejection_reason().alias("reason")),
    "manifest_summary": lambda k: k.summary(),
    "count_check": lambda k: loading.count_check(k.summary(), k.fixture(fx.FILE_COUNTS), ["dir"]).select("dir", "valid_rows", "rows_found", "count_matches"),
    "loaded_batches": lambda k: loading.loaded_batches(k.staged("batches")),
    "pending_batches": lambda k: loading.pending_batches(k.fixture("select 'transactions' pipeline, p_partkey batch_id from {part} union all select 'labels', p_partkey from {part}"), k.staged("batches")),
    "typed_load_transactions": lambda k: loading.typed_transactions(k.fixture(fx.LANDED_TRANSACTIONS), F.col("batch"), F.lit("f"), F.current_timestamp()).drop("loaded_at", "minio_object", "ingested_at", "kafka_timestamp"),
    "typed_load_labels": lambda k: loading.typed_labels(k.fixture(fx.LANDED_LABELS), F.col("batch"), F.lit("f"), F.current_timestamp()).drop("loaded_at", "minio_object", "kafka_timestamp"),
    "stg_transactions": lambda k: k.staged("transactions"),
    "stg_transaction_labels": lambda k: k.staged("labels"),
    "stg_ingestion_batches": lambda k: k.staged("batches"),
    "stg_ingestion_batch_quality": lambda k: k.staged("manifest"),
    "committed_batches": lambda k: k.committed(),
    "transactions_ranked": lambda k: canonical.ranked(k.committed_rows("transactions"), canonical.TRANSACTION_PAYLOAD).select(*RANKED),
    "labels_ranked": lambda k: canonical.ranked(k.committed_rows("labels"), canonical.LABEL_PAYLOAD).select(*RANKED),
    "fct_transactions": lambda k: k.transactions().select(*FACT),
    "fct_transaction_labels": lambda k: k.labels().select(*LABEL_FACT),
    "fct_transactions_labeled": lambda k: k.labeled().select(*FACT, "is_fraud", "has_final_label", "has_label_payload_conflict"),
    "ml_training_candidates": lambda k: k.candidates(),
    "ml_training_transactions": lambda k: training.training_rows(k.candidates()),
    "ml_training_exclusion_summary": lambda k: training.exclusion_summary(k.candidates()),
    "dq_not_null": lambda k: checks.not_null(k.landed().decoded.select("record.*"), ["event_id", "source", "event_time", "ingested_at", "step", "amount"]),
    "dq_accepted_values": lambda k: checks.accepted_values(k.staged("transactions"), "transaction_type", ["CASH_IN", "DEBIT", "PAYMENT"]),
    "dq_business_keys": lambda k: checks.blank_keys(events=k.landed().decoded.select("record.*"), facts=k.transactions()),
    "dq_orphan_labels": lambda k: checks.orphan_labels(k.labels(), k.transactions()),
    "dq_reconciles": lambda k: checks.unreconciled(k.staged("manifest")),
    "dq_candidate_partition": lambda k: checks.inconsistent_candidates(k.candidates().withColumn("training_exclusion_reason", F.when(F.col("step") == 1, "other").otherwise(F.col("training_exclusion_reason")))).select("source", "event_id"),
    "contract_metrics": _contract_metrics,
    "contract_violations": lambda k: Marts(k).violations(CONTRACT),
    "mart_build": lambda k: Marts(k).report(CONTRACT),
    "replay_event_time": lambda k: k.replayed().select("id", "row_number", "step", "ordinal", "rows_in_step", "event_time_ms"),
    "replay_events": lambda k: replay.events(_replay_columns(replay.part(k.replayed(), 100, 100_000))).select("event_id", "source", F.unix_millis("event_time").alias("event_time_ms"), "step", "type", "amount"),
    "replay_events_whole": lambda k: replay.events(_replay_columns(k.replayed())).select("event_id", "source", F.unix_millis("event_time").alias("event_time_ms"), "step", "type", "amount"),
    "replay_labels": lambda k: replay.labels(_replay_columns(k.replayed())),
    "replay_messages": _message_check,
    "temporal_split": lambda k: training.temporal_split(k.replayed().select("id", F.timestamp_millis("event_time_ms").cast("timestamp_ntz").alias("event_time"))).select("id", "split"),
    "feature_set_baseline": lambda k: training.BASELINE.select(training.training_rows(k.candidates())),
    "feature_set_challenger": lambda k: training.CHALLENGER.select(training.training_rows(k.candidates())),
    "warehouse_months": _months,
    "warehouse_buckets": lambda k: _bucketed(k).select(*FACT, "is_fraud", "has_final_label", "has_label_payload_conflict"),
    "warehouse_partition_layout": lambda k: _layout(k.staged("transactions")),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: (lambda spark, sf_dir, f=f: f(Lake(spark, sf_dir))) for name, f in _PLAIN.items()}
    return out | {"landing_stream": _landing_stream, "landing_offsets": _landing_offsets}


def oracle_sql() -> dict[str, str]:
    from lakeaudit.plans.oracles import ORACLES

    return ORACLES
