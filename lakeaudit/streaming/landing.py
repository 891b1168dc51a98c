"""The landing job: micro-batches of raw messages into three zones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakeaudit.operators.landing import Landed, LandingConfig, SchemaCatalog, land
from lakeaudit.sources.zones import GENERATION_SPAN, batch_path, claim_generation, remove, write_batch


@dataclass(frozen=True)
class Zones:
    root: str

    @property
    def valid(self) -> str:
        return f"{self.root}/valid"

    @property
    def quarantine(self) -> str:
        return f"{self.root}/quarantine"

    @property
    def quality(self) -> str:
        return f"{self.root}/quality"


def landing_batch(catalog: SchemaCatalog, config: LandingConfig, zones: Zones, generation: int = 0) -> Callable[[DataFrame, int], None]:
    """What is done with a micro-batch. It is decoded once for three sinks; the manifest goes last, and its marker tells that
    the batch is complete. Its counts are observed while the zones are written (T2, A1): no job asks whether there are rows, an empty batch
    leaves nothing, and where two writes saw different rows the batch fails and has no marker. The generation of the job goes before the batch's number in its id."""

    def process(batch: DataFrame, number: int) -> None:
        batch_id = generation * GENERATION_SPAN + number
        landed = land(batch, catalog, config)
        landed.judged.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            valid = _observed(landed, lambda seen: write_batch(seen.valid(), zones.valid, batch_id, [config.date_column] if config.date_column else None))
            if not valid.get("input_rows"):
                remove(batch.sparkSession, batch_path(zones.valid, batch_id))
                return
            bad = _observed(landed, lambda seen: write_batch(seen.quarantine(), zones.quarantine, batch_id, ["quarantine_reason", "kafka_date"]))
            counts = Observation()
            manifest = landed.manifest(batch_id)
            write_batch(manifest.observe(counts, *(F.sum(c).alias(c) for c in valid)), zones.quality, batch_id, single_file=True)
            if not valid == bad == counts.get:
                remove(batch.sparkSession, batch_path(zones.quality, batch_id))
                raise RuntimeError(f"batch {batch_id} changed while it was written: {valid}, {bad}, {counts.get}")
        finally:
            landed.judged.unpersist()

    return process


def _observed(landed: Landed, write: Callable[[Landed], None]) -> dict[str, int]:
    """Write from rows that are counted on their way, and give the counts."""
    counts, bad = Observation(), F.col("quarantine_reason").isNotNull()
    rows = landed.judged.observe(counts, F.count("*").alias("input_rows"), F.count_if(~bad).alias("valid_rows"), F.count_if(bad).alias("quarantine_rows"))
    write(replace(landed, judged=rows))
    return counts.get


def start_landing(messages: DataFrame, catalog: SchemaCatalog, config: LandingConfig, zones: Zones, checkpoint: str, interval: str | None = "10 seconds") -> StreamingQuery:
    """Start the job; without an interval it takes what is there and ends. Batch numbers come from the checkpoint, so a batch that is
    repeated overwrites itself; the generation comes with the checkpoint too, so one that begins anew overwrites nothing (T3)."""
    generation = claim_generation(messages.sparkSession, zones.root, checkpoint)
    writer = messages.writeStream.foreachBatch(landing_batch(catalog, config, zones, generation)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
