"""The loader: completed batches into the warehouse, judged and appended all at once, each failing by itself."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeaudit.operators import loading
from lakeaudit.sources import schemas, zones
from lakeaudit.streaming.landing import Zones

LANDED = {"transactions": schemas.LANDED_TRANSACTION, "labels": schemas.LANDED_LABEL}
TYPED = {"transactions": loading.typed_transactions, "labels": loading.typed_labels}


#: The tables of the warehouse (A11), by the names of their staging.
TABLES = {"transactions": "transactions", "labels": "labels", "batches": "ledger", "manifest": "quality"}


@dataclass(frozen=True)
class Warehouse:
    root: str

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def ledger(self, spark: SparkSession) -> DataFrame:
        """All attempts; none before the first load."""
        if not zones.exists(spark, self.path("ledger")):
            return spark.createDataFrame([], schemas.LEDGER)
        return spark.read.schema(schemas.LEDGER).parquet(self.path("ledger"))

    def missing(self, spark: SparkSession) -> list[str]:
        """Which of the four tables are not there."""
        return [t for t in TABLES.values() if not zones.exists(spark, self.path(t))]

    def require(self, spark: SparkSession) -> None:
        """A reader, and a run of the loader, need all four tables."""
        if lacking := self.missing(spark):
            raise RuntimeError(f"the warehouse lacks tables: {lacking}")

    def create(self, spark: SparkSession) -> None:
        """Create the tables that are lacking, empty."""
        lacking = self.missing(spark)
        for name, table in TABLES.items():
            if table in lacking:
                spark.createDataFrame([], table_schema(spark, name)).coalesce(1).write.parquet(self.path(table))

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """What a staging reads."""
        self.require(spark)
        return spark.read.schema(table_schema(spark, name)).parquet(self.path(TABLES[name]))


def table_schema(spark: SparkSession, name: str) -> T.StructType:
    """The columns of a table of the warehouse, as the loader writes them."""
    if name == "batches":
        return schemas.LEDGER
    landed = schemas.MANIFEST if name == "manifest" else LANDED[name]
    batch, now = F.lit(0).cast("long"), F.current_timestamp()
    rows = spark.createDataFrame([], landed)
    if name == "manifest":
        return loading.typed_quality(rows, "", batch, now).schema
    return TYPED[name](rows, batch, F.lit(""), now).schema


def load(spark: SparkSession, pipeline: str, landing: Zones, warehouse: Warehouse, run_id: str, limit: int = loading.RUN_LIMIT) -> dict[int, str]:
    """Load the pending batches of a pipeline: {batch id: OK or the reason of its rejection}.

    The files of the pending batches alone are read, and all are judged in one job and appended in another, rows first, then manifests,
    then the ledger, whose rows commit them. Where a job over several batches fails it is repeated over each half, so that an error
    ends with the batch that has it: that one gets a failed row with the message, the others are loaded, and when all is recorded the
    first error is raised (B5). A crash before the ledger repeats rows, which the canonical facts absorb. Batches that have failed
    come last in the next run, so that they cannot keep others out.
    """
    verdicts, errors = _load(spark, pipeline, landing, warehouse, run_id, limit)
    if errors:
        raise _first(errors)
    return verdicts


def run(spark: SparkSession, landings: dict[str, Zones], warehouse: Warehouse, run_id: str, limit: int = loading.RUN_LIMIT) -> dict[tuple[str, int], str]:
    """One run over all pipelines, {(pipeline, batch id): OK, a reason, or the message of an error}. The four tables must be there
    (A11); the limit is that of the whole run, by pipeline and batch (B1). Errors are in the ledger, not raised."""
    if unknown := set(landings) - set(LANDED):
        raise ValueError(f"no such pipeline: {sorted(unknown)}")
    warehouse.require(spark)
    out: dict[tuple[str, int], str] = {}
    for pipeline in sorted(landings):
        verdicts, errors = _load(spark, pipeline, landings[pipeline], warehouse, run_id, limit - len(out)) if len(out) < limit else ({}, {})
        out |= {(pipeline, i): v for i, v in verdicts.items()} | {(pipeline, i): str(e) for i, e in errors.items()}
    return out


def _first(errors: dict[int, Exception]) -> Exception:
    first = errors[min(errors)]
    first.add_note(f"batches that failed: {sorted(errors)}")
    return first


def isolated(ids: list[int], work: Callable[[list[int]], dict[int, str]]) -> tuple[dict[int, str], dict[int, Exception]]:
    """What work makes of the ids, all at once; where it fails, of each half. An error is left with a single id."""
    if not ids:
        return {}, {}
    try:
        return work(ids), {}
    except Exception as e:
        if len(ids) == 1:
            return {}, {ids[0]: e}
    done, errors = isolated(ids[: len(ids) // 2], work)
    more, others = isolated(ids[len(ids) // 2 :], work)
    return done | more, errors | others


def _load(spark: SparkSession, pipeline: str, landing: Zones, warehouse: Warehouse, run_id: str, limit: int) -> tuple[dict[int, str], dict[int, Exception]]:
    if pipeline not in LANDED:
        raise ValueError(f"no such pipeline: {pipeline}")
    ledger = warehouse.ledger(spark)
    # Loaded batches are not listed again: what is newer is, and the gaps.
    found = zones.completed_batches(spark, landing.quality, pipeline, loading.open_ranges(ledger, pipeline))
    ids = [r["batch_id"] for r in loading.pending_batches(found, ledger, limit, failed_last=True).collect()]  # at most ``limit``
    if not ids:
        return {}, {}

    def read(zone: str, schema: T.StructType, some: list[int]) -> DataFrame:
        # A batch without valid rows may have no directory at all.
        paths = [p for p in (zones.batch_path(zone, i) for i in some) if zones.exists(spark, p)]
        rows = zones.scan(spark, paths, schema) if paths else spark.createDataFrame([], schema).withColumn("file_path", F.lit(""))
        return rows.withColumn("dir", F.regexp_extract("file_path", r"batch_id=([0-9]{20})", 1).cast("long"))

    def judge(some: list[int]) -> dict[int, str]:
        return _judge(pipeline, read(landing.quality, schemas.MANIFEST, some), read(landing.valid, LANDED[pipeline], some), some)

    def append_rows(some: list[int]) -> dict[int, str]:
        rows = read(landing.valid, LANDED[pipeline], some)
        append = zones.append_monthly if pipeline == "transactions" else zones.append_hashed
        append(TYPED[pipeline](rows, F.col("dir"), F.col("file_path"), F.current_timestamp()), warehouse.path(pipeline))
        return dict.fromkeys(some, "OK")

    def append_manifests(some: list[int]) -> dict[int, str]:
        quality = loading.typed_quality(read(landing.quality, schemas.MANIFEST, some), pipeline, F.col("dir"), F.current_timestamp())
        quality.coalesce(1).write.mode("append").parquet(warehouse.path("quality"))
        return dict.fromkeys(some, "OK")

    verdicts, errors = isolated(ids, judge)
    good = sorted(i for i, v in verdicts.items() if v == "OK")
    for step in (append_rows, append_manifests):
        done, failed = isolated(good, step)
        good, errors = sorted(done), errors | failed
    verdicts = {i: v for i, v in verdicts.items() if i not in errors}
    told = [(i, v, "" if v == "OK" else v) for i, v in verdicts.items()] + [(i, "", str(e)) for i, e in errors.items()]
    attempts = [(i, "success" if v == "OK" else "failed", zones.batch_path(landing.valid, i), said) for i, v, said in sorted(told)]
    zones.record_attempts(spark, warehouse.path("ledger"), pipeline, attempts, run_id)
    return verdicts, errors


def _judge(pipeline: str, manifest: DataFrame, rows: DataFrame, ids: list[int]) -> dict[int, str]:
    """The verdict on each batch (B2, B3), from one job."""
    summary = loading.manifest_summary(manifest, ["dir"], F.lit(pipeline), F.col("dir"))
    judged = loading.count_check(summary, rows.groupBy("dir").agg(F.count("*").alias("rows_found")), ["dir"])
    reason = loading.rejection_reason()
    judged = judged.select("dir", F.when((reason == "OK") & ~F.col("count_matches"), "COUNT_MISMATCH").otherwise(reason).alias("reason"))
    found = {r["dir"]: r["reason"] for r in judged.collect()}
    return {i: found.get(i, "EMPTY_MANIFEST") for i in ids}
