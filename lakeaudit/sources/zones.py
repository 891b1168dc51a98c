"""Zones of Parquet batches and the warehouse tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeaudit.sources.schemas import LEDGER, MANIFEST, RAW_MESSAGE  # noqa: F401

MARKER = "_SUCCESS"
#: Batches of one generation of a landing job; the generation stands before its number in the batch id.
GENERATION_SPAN = 10**12
ERROR_CHARS = 2000
BUCKETS = 32


def batch_path(zone: str, batch_id: int) -> str:
    return f"{zone}/batch_id={batch_id:020d}"


def write_batch(rows: DataFrame, zone: str, batch_id: int, by: list[str] | None = None, single_file: bool = False) -> None:
    """Overwrite a batch's directory, so that a repeated batch leaves the same files."""
    writer = (rows.coalesce(1) if single_file else rows).write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(batch_path(zone, batch_id))


def raw_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Raw messages from files, as a stream."""
    return spark.readStream.schema(RAW_MESSAGE).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, most: int = 100) -> DataFrame:
    """Raw messages of a topic; the Kafka connector must be on the class path."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "failOnDataLoss": "true", "maxOffsetsPerTrigger": str(most)}
    return spark.readStream.format("kafka").options(**options).load()


def scan(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Files at any depth, by an explicit schema; directory names add no columns. file_path is the lineage."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*([path] if isinstance(path, str) else path))
    return rows.select("*", F.col("_metadata.file_path").alias("file_path"))


def name_globs(first: int, last: int) -> list[str]:
    """Globs that together match the padded batch ids from first to last and no others."""

    def between(low: str, high: str) -> list[str]:
        if low == "0" * len(low) and high == "9" * len(high):
            return ["?" * len(low)]
        if low[0] == high[0]:
            return [low[0] + rest for rest in between(low[1:], high[1:])] if len(low) > 1 else [low]
        n = len(low) - 1
        if not n:
            return [f"[{low}-{high}]"]
        out = [low[0] + rest for rest in between(low[1:], "9" * n)]
        if int(low[0]) + 1 < int(high[0]):
            out.append(f"[{int(low[0]) + 1}-{int(high[0]) - 1}]" + "?" * n)
        return out + [high[0] + rest for rest in between("0" * n, high[1:])]

    return between(f"{first:020d}", f"{last:020d}")


def completed_batches(spark: SparkSession, zone: str, pipeline: str, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
    """(pipeline, batch_id) of the batches with a success marker (S11), of all or of those with an id in one of the ranges.

    The zone is listed once, where its files are; the names outside the ranges are passed over there. For the others alone, a few bytes
    come to the driver and a marker is looked for.
    """
    jvm = spark._jvm  # noqa: SLF001
    globs = ["?" * 20] if ranges is None else [g for low, high in ranges for g in name_globs(low, high)]
    names: list[str] = []
    if globs:
        pattern = jvm.org.apache.hadoop.fs.Path(f"{zone}/batch_id={{{','.join(globs)}}}")
        found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []  # noqa: SLF001
        names = [m[1] for s in found if (m := re.fullmatch(r"batch_id=([0-9]{20})", s.getPath().getName()))]
    ids = [(int(n),) for n in names if exists(spark, f"{zone}/batch_id={n}/{MARKER}")]
    return spark.createDataFrame(ids, "batch_id long").select(F.lit(pipeline).alias("pipeline"), "batch_id")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)  # noqa: SLF001


def remove(spark: SparkSession, path: str) -> None:
    """Remove a directory and what is in it, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)  # noqa: SLF001


def claim_generation(spark: SparkSession, root: str, checkpoint: str) -> int:
    """The generation of a landing job (T3). A checkpoint belongs to one: what it has claimed is noted in it. A new checkpoint, or one
    that was lost and begins anew, claims the next by creating its file under root, which only one can do; so its batches, which
    are numbered from 0 again, fall on no batch of an earlier one. A checkpoint from before there were generations is of the first.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path  # noqa: SLF001
    note = f"{checkpoint}/generation"
    if exists(spark, note):
        return int(_read_text(spark, note))
    claims, generation = f"{root}/_generations", 0
    if not exists(spark, f"{checkpoint}/offsets"):
        system = path(claims).getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
        if exists(spark, claims):
            taken = [int(s.getPath().getName()) for s in system.listStatus(path(claims)) if s.getPath().getName().isdigit()]
            generation = max(taken, default=-1) + 1
        elif exists(spark, f"{root}/quality"):
            generation = 1  # the zones were filled before there were generations
        while not _create(spark, f"{claims}/{generation}", ""):
            generation += 1
    _create(spark, note, str(generation))
    return generation


def _create(spark: SparkSession, file: str, text: str) -> bool:
    """Create a file, or tell that it is there already."""
    place = spark._jvm.org.apache.hadoop.fs.Path(file)  # noqa: SLF001
    try:
        out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, False)  # noqa: SLF001
    except Py4JJavaError as e:
        if exists(spark, file):
            return False
        raise e
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def _read_text(spark: SparkSession, file: str) -> str:
    return spark.read.text(file, wholetext=True).first()["value"]


def record_attempts(spark: SparkSession, ledger: str, pipeline: str, attempts: list[tuple[int, str, str, str]], run_id: str) -> None:
    """Rows (batch id, status, prefix, error) of the ledger, appended together; this is what commits batches."""
    if bad := {status for _, status, _, _ in attempts} - {"success", "failed"}:
        raise ValueError(f"no such status: {sorted(bad)}")
    rows = spark.createDataFrame(attempts, "batch_id long, status string, source_prefix string, error string").coalesce(1)
    rows = rows.withColumns({"pipeline": F.lit(pipeline), "run_id": F.lit(run_id), "finished_at": F.current_timestamp(), "error_message": F.substring("error", 1, ERROR_CHARS)})
    rows.select(*LEDGER.fieldNames()).write.mode("append").parquet(ledger)


def by_month(rows: DataFrame) -> DataFrame:
    """Rows with their month, dealt out so that files follow the size of the load: the shuffle is rebalanced at run time, small months
    share a task and large ones are split (S12); sorted by key in each file (L4)."""
    rows = rows.withColumn("event_month", F.date_format("event_time", "yyyyMM"))
    return rows.hint("rebalance", "event_month").sortWithinPartitions("event_month", "source", "event_id")


def append_monthly(rows: DataFrame, path: str) -> None:
    """Append to the transaction table: a directory for each month."""
    by_month(rows).write.mode("append").partitionBy("event_month").parquet(path)


def overwrite_months(rows: DataFrame, path: str) -> None:
    """Put rows in the place of all that their months hold; other months stay as they are."""
    by_month(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_month").parquet(path)


def read_months(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """The rows of the months first to last (yyyyMM, inclusive); the directories of others are not read."""
    rows = spark.read.parquet(path)
    return rows.withColumn("event_month", F.col("event_month").cast("string")).where(F.col("event_month").between(first, last))


def append_hashed(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Append to the label table: a directory for each hash of the event id, so that replays lie together (S9, S13, L4). Files follow
    the size of the load, as in ``by_month``."""
    rows = rows.withColumn("event_hash", F.pmod(F.xxhash64("event_id"), F.lit(buckets)).cast("int"))
    rows.hint("rebalance", "event_hash").sortWithinPartitions("event_hash", "source", "event_id").write.mode("append").partitionBy("event_hash").parquet(path)


def write_bucketed(rows: DataFrame, name: str, path: str, by: list[str], buckets: int = BUCKETS) -> DataFrame:
    """A table of the catalog with rows in buckets by the hash of ``by``, one sorted file each: all replays of a key lie together, and a
    join, aggregation or window by the key needs no exchange (S13, L4). Tables that are to be joined have as many buckets."""
    rows.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by).option("path", path).option("compression", "zstd").mode("overwrite").saveAsTable(name)
    return rows.sparkSession.table(name)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one serves a local master,
    whose tasks run on this machine; on a cluster it is an error."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-tables-"))
        folder = context.getCheckpointDir()
    return folder


def materialized(rows: DataFrame, path: str | None = None, view: str | None = None) -> DataFrame:
    """A mart (S15, D9): with ``view`` its name as a temporary view, which is found anew for each reader; else a table at ``path`` (in the
    shared folder if there is none), which is written once and read by all."""
    if view:
        rows.createOrReplaceTempView(view)
        return rows.sparkSession.table(view)
    path = path or f"{shared_folder(rows.sparkSession)}/mart-{uuid.uuid4().hex}"
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
