"""Landing, loading and replay over files."""

import pytest
from pyspark.sql import functions as F

from lakeaudit.functions import envelope
from lakeaudit.operators import landing, loading, replay
from lakeaudit.plans.loader import Warehouse, load
from lakeaudit.plans.queries import CATALOG, Lake
from lakeaudit.sources import fixtures, schemas, zones
from lakeaudit.streaming.landing import Zones, landing_batch, start_landing


@pytest.fixture(scope="module")
def landed(spark, sf, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("landing"))
    fixtures.raw_messages(spark, sf).repartition(3).write.parquet(f"{root}/raw")
    run = lambda: start_landing(zones.raw_stream(spark, f"{root}/raw"), CATALOG, landing.TRANSACTIONS, Zones(root), f"{root}/state", None).awaitTermination()
    run()
    return root, run


def _manifest(spark, root):
    return spark.read.schema(schemas.MANIFEST).option("recursiveFileLookup", True).parquet(f"{root}/quality").agg(F.sum("input_rows"), F.sum("valid_rows"), F.sum("quarantine_rows")).first()


def test_manifest_is_what_the_zones_hold(spark, landed, sf):
    root, run = landed
    total, valid, bad = _manifest(spark, root)
    assert total == valid + bad == fixtures.raw_messages(spark, sf).count()
    assert zones.scan(spark, f"{root}/valid", schemas.LANDED_TRANSACTION).count() == valid
    assert spark.read.parquet(f"{root}/quarantine").count() == bad
    run()  # nothing new: nothing changes
    assert tuple(_manifest(spark, root)) == (total, valid, bad)


def test_load_once(spark, landed, tmp_path):
    root, _ = landed
    house = Warehouse(str(tmp_path))
    assert zones.completed_batches(spark, Zones(root).quality, "transactions").count() == 3
    assert set(load(spark, "transactions", Zones(root), house, "r1").values()) == {"OK"}
    assert load(spark, "transactions", Zones(root), house, "r2") == {}
    rows = spark.read.parquet(house.path("transactions"))
    assert rows.count() == _manifest(spark, root)[1] and "minio_object" in rows.columns and dict(rows.dtypes)["amount"] == "decimal(18,2)"
    assert loading.loaded_batches(house.ledger(spark)).count() == 3
    with pytest.raises(ValueError, match="no such pipeline"):
        load(spark, "other", Zones(root), house, "r")


def test_a_lost_row_is_found(spark, landed, tmp_path):
    root, _ = landed
    copy, batch = str(tmp_path / "zone"), 0
    rows = zones.scan(spark, f"{root}/valid/batch_id={batch:020d}", schemas.LANDED_TRANSACTION).drop("file_path")
    zones.write_batch(rows.where("kafka_offset <> (select 0)").limit(rows.count() - 1), f"{copy}/valid", batch)
    zones.write_batch(spark.read.schema(schemas.MANIFEST).parquet(f"{root}/quality/batch_id={batch:020d}"), f"{copy}/quality", batch, single_file=True)
    house = Warehouse(str(tmp_path / "house"))
    assert load(spark, "transactions", Zones(copy), house, "r") == {0: "COUNT_MISMATCH"}
    row = house.ledger(spark).first()
    assert (row["status"], row["error_message"]) == ("failed", "COUNT_MISMATCH")


def test_ledger_rejects_other_states(spark, tmp_path):
    with pytest.raises(ValueError, match="status"):
        zones.record_attempts(spark, str(tmp_path), "labels", [(1, "maybe", "", "")], "r")


def test_an_error_is_recorded_and_goes_on(spark, landed, tmp_path, monkeypatch):
    root, _ = landed
    house = Warehouse(str(tmp_path))

    def broken(*_):
        raise OSError("disk full " + "x" * 3000)

    monkeypatch.setattr(zones, "append_monthly", broken)
    with pytest.raises(OSError, match="disk full"):
        load(spark, "transactions", Zones(root), house, "r1")
    rows = house.ledger(spark).collect()
    assert len(rows) == 3 and all(r["status"] == "failed" and r["error_message"].startswith("disk full") and len(r["error_message"]) == 2000 for r in rows)
    monkeypatch.undo()
    assert set(load(spark, "transactions", Zones(root), house, "r2").values()) == {"OK"} and house.missing(spark) == ["labels"]


def test_a_batch_repeated_leaves_the_same_files(spark, sf, tmp_path):
    batch, root = fixtures.raw_messages(spark, sf).limit(500), Zones(str(tmp_path))
    process = landing_batch(CATALOG, landing.TRANSACTIONS, root)
    process(batch.limit(0), 4)
    assert not (tmp_path / "quality").exists()
    counts = []
    for _ in range(2):
        process(batch, 5)
        counts.append(tuple(_manifest(spark, str(tmp_path))))
    assert counts[0] == counts[1] and counts[0][0] == 500


def test_counts_come_from_the_writes(spark, sf, tmp_path, monkeypatch):
    batch, root = fixtures.raw_messages(spark, sf).limit(500), Zones(str(tmp_path))
    asked = []
    monkeypatch.setattr(type(batch), "isEmpty", lambda self: asked.append(self))
    process = landing_batch(CATALOG, landing.TRANSACTIONS, root)
    process(batch, 1)
    process(batch.limit(0), 2)
    assert not asked and _manifest(spark, str(tmp_path))[0] == 500 and [p.name for p in (tmp_path / "valid").iterdir()] == [f"batch_id={1:020d}"]
    # A manifest of other rows than those that the zones hold: no marker.
    whole = landing.Landed.manifest
    monkeypatch.setattr(landing.Landed, "manifest", lambda self, number: whole(self, number).where("event_date is not null"))
    with pytest.raises(RuntimeError, match="batch 3 changed"):
        process(batch, 3)
    assert [p.name for p in (tmp_path / "quality").iterdir()] == [f"batch_id={1:020d}"]


def test_each_writer_has_its_own_decoder(spark):
    # The body of writer 2 has its fields under other names; the decoder reads them by the writer's schema.
    def decode(payload, writer, reader):
        parsed = F.from_json(payload.cast("string"), writer)
        names = ("id", "src", "f", "g") if writer.startswith("id string") else ("event_id", "source", "isFraud", "isFlaggedFraud")
        return F.struct(*(parsed[n].alias(f.name) for n, f in zip(names, reader.fields, strict=True)))

    catalog = landing.SchemaCatalog({1: "event_id string, source string, isFraud int, isFlaggedFraud int", 2: "id string, src string, f int, g int"}, 1)
    config = landing.LandingConfig("labels", schemas.LABEL, landing.LABELS.reason, decoder=decode)
    bodies = [(1, '{"event_id": "a", "source": "s", "isFraud": 1, "isFlaggedFraud": 0}'), (2, '{"id": "b", "src": "t", "f": 0, "g": 1}'), (3, "{}")]
    rows = spark.createDataFrame(bodies, "id int, body string").select(envelope.frame(F.col("body"), F.col("id")).alias("value"), F.lit(b"k").alias("key"), F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.lit(0).cast("long").alias("offset"), F.current_timestamp().alias("timestamp"))
    landed = landing.land(rows, catalog, config)
    assert sorted(tuple(r)[:4] for r in landed.valid().collect()) == [("a", "s", 1, 0), ("b", "t", 0, 1)]
    assert [r["quarantine_reason"] for r in landed.quarantine().collect()] == ["UNSUPPORTED_SCHEMA_ID"]


def test_staging_from_the_warehouse(spark, landed, sf, tmp_path):
    root, _ = landed
    house = Warehouse(str(tmp_path))
    load(spark, "transactions", Zones(root), house, "r1")
    with pytest.raises(RuntimeError, match="labels"):
        Lake(spark, sf, house).staged("transactions")
    zones.append_hashed(fixtures.spark(spark, sf, fixtures.LABELS), house.path("labels"))
    lake = Lake(spark, sf, house)
    assert lake.transactions().count() == spark.read.parquet(house.path("transactions")).select("source", "event_id").distinct().count()
    view = zones.materialized(lake.committed(), view="committed")
    assert view.count() == 3 and not view.filter("pipeline = 'transactions'").isEmpty()


def test_steps_must_be_numbers_from_one(spark):
    for bad in (0, None):
        with pytest.raises(Exception, match="step"):
            replay.timed(spark.createDataFrame([(1, 1), (bad, 2)], "step int, row_number long")).collect()


def test_csv_header(spark, tmp_path):
    names = schemas.REPLAY_CSV.fieldNames()
    (tmp_path / "a.csv").write_text(",".join(names) + "\n" + "\n".join(f"{1 + i % 2},DEBIT,1.5,a,1,2,b,3,4,0,0" for i in range(5)))
    rows = replay.timed(replay.numbered(replay.read_csv(spark, str(tmp_path / "a.csv")).withColumn("i", F.monotonically_increasing_id()), ["i"]))
    assert sorted(r["row_number"] for r in rows.collect()) == [1, 2, 3, 4, 5]
    got = sorted((r["row_number"], r["ordinal"], r["rows_in_step"]) for r in replay.part(rows, 2, 2).collect())
    assert got == [(3, 1, 3), (4, 1, 2)]
    (tmp_path / "b.csv").write_text("step,type\n1,A\n")
    with pytest.raises(ValueError, match="lacks"):
        replay.read_csv(spark, str(tmp_path / "b.csv"))
    (tmp_path / "c.csv").write_text(",".join(names) + "\n")
    with pytest.raises(ValueError, match="no rows"):
        replay.read_csv(spark, str(tmp_path / "c.csv"))


def test_layouts(spark, sf, tmp_path):
    rows = fixtures.spark(spark, sf, fixtures.TRANSACTIONS)
    zones.append_monthly(rows, str(tmp_path / "m"))
    zones.append_hashed(rows, str(tmp_path / "h"), 4)
    assert spark.read.parquet(str(tmp_path / "m")).count() == spark.read.parquet(str(tmp_path / "h")).count() == rows.count()
    assert spark.read.parquet(str(tmp_path / "h")).groupBy("event_id").agg(F.count_distinct("event_hash").alias("n")).where("n > 1").isEmpty()
