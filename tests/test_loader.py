"""The loader when batches are broken, many or late; landing jobs that begin anew; layouts of the warehouse."""

import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lakeaudit.operators import landing, loading
from lakeaudit.plans.loader import Warehouse, isolated, load, run
from lakeaudit.plans.queries import CATALOG
from lakeaudit.sources import fixtures, schemas, zones
from lakeaudit.streaming.landing import Zones, landing_batch, start_landing


def batches(spark, sf, root, numbers, config=landing.TRANSACTIONS, rows=300):
    """Landed batches of these numbers."""
    messages = fixtures.raw_messages(spark, sf) if config is landing.TRANSACTIONS else fixtures.raw_labels(spark, sf)
    process = landing_batch(CATALOG, config, Zones(root))
    for n in numbers:
        process(messages.where((F.col("offset") >= 40 * n) & (F.col("offset") < 40 * n + rows)), n)
    return Zones(root)


def cut_short(folder):
    """Damage the first file of rows in a folder."""
    file = sorted(p for p in Path(folder).rglob("*.parquet"))[0]
    file.write_bytes(file.read_bytes()[: file.stat().st_size // 2])
    for crc in file.parent.glob(f".{file.name}.crc"):
        crc.unlink()


def states(spark, house):
    return sorted((r["batch_id"], r["status"], bool(r["error_message"])) for r in house.ledger(spark).collect())


def test_a_damaged_file_fails_its_own_batch(spark, sf, tmp_path):
    zone, house = batches(spark, sf, str(tmp_path / "z"), (0, 1, 2)), Warehouse(str(tmp_path / "w"))
    shutil.copytree(zones.batch_path(zone.valid, 1), tmp_path / "sound")
    cut_short(zones.batch_path(zone.valid, 1))
    with pytest.raises(Exception, match="parquet|Parquet") as e:
        load(spark, "transactions", zone, house, "r1")
    assert "batches that failed: [1]" in e.value.__notes__
    assert states(spark, house) == [(0, "success", False), (1, "failed", True), (2, "success", False)]
    count = lambda i: zones.scan(spark, zones.batch_path(zone.valid, i), schemas.LANDED_TRANSACTION).count()
    assert spark.read.parquet(house.path("transactions")).count() == count(0) + count(2)
    # The next run has that one batch, and a newer one goes through beside it.
    batches(spark, sf, zone.root, (3,))
    with pytest.raises(Exception, match="parquet|Parquet"):
        load(spark, "transactions", zone, house, "r2")
    assert states(spark, house)[-1] == (3, "success", False) and len(states(spark, house)) == 5
    shutil.rmtree(zones.batch_path(zone.valid, 1))
    shutil.copytree(tmp_path / "sound", zones.batch_path(zone.valid, 1))
    assert load(spark, "transactions", zone, house, "r3") == {1: "OK"} and load(spark, "transactions", zone, house, "r4") == {}
    rows = spark.read.parquet(house.path("transactions"))
    assert rows.count() == sum(map(count, range(4))) and sorted(r[0] for r in rows.select("minio_batch_id").distinct().collect()) == [0, 1, 2, 3]


def test_a_damaged_manifest_and_an_amount_that_does_not_fit(spark, sf, tmp_path):
    zone, house = batches(spark, sf, str(tmp_path / "z"), range(5)), Warehouse(str(tmp_path / "w"))
    cut_short(zones.batch_path(zone.quality, 0))
    rows = zones.scan(spark, zones.batch_path(zone.valid, 3), schemas.LANDED_TRANSACTION).drop("file_path")
    large = rows.withColumn("amount", F.when(F.col("kafka_offset") == rows.first()["kafka_offset"], F.lit(1e22)).otherwise(F.col("amount"))).withColumn("event_date", F.to_date("event_time"))
    large = spark.createDataFrame(large.collect(), large.schema)
    zones.write_batch(large, zone.valid, 3, ["event_date"])
    house.create(spark)
    out = run(spark, {"transactions": zone}, house, "r1")
    assert {i: out[("transactions", i)] for i in (1, 2, 4)} == dict.fromkeys((1, 2, 4), "OK") and "parquet" in out[("transactions", 0)].lower() and "10000000000000000000000" in out[("transactions", 3)]
    assert states(spark, house) == [(0, "failed", True), (1, "success", False), (2, "success", False), (3, "failed", True), (4, "success", False)]
    assert spark.read.parquet(house.path("transactions")).where("minio_batch_id in (0, 3)").isEmpty()


def test_an_error_stays_with_what_has_it():
    calls = []

    def work(ids):
        calls.append(ids)
        if {3, 90} & set(ids):
            raise OSError(f"bad {ids}")
        return dict.fromkeys(ids, "OK")

    done, errors = isolated(list(range(200)), work)
    assert sorted(errors) == [3, 90] and str(errors[90]) == "bad [90]" and sorted(done) == [i for i in range(200) if i not in (3, 90)] and len(calls) < 40


def test_broken_batches_do_not_fill_every_run(spark, sf, tmp_path):
    zone, house = batches(spark, sf, str(tmp_path / "z"), range(4), rows=40), Warehouse(str(tmp_path / "w"))
    for i in (0, 1):
        cut_short(zones.batch_path(zone.quality, i))
    for turn in range(2):
        with pytest.raises(Exception, match=r"parquet|Parquet") if not turn else _nothing():
            load(spark, "transactions", zone, house, f"r{turn}", limit=2)
    assert states(spark, house) == [(0, "failed", True), (1, "failed", True), (2, "success", False), (3, "success", False)]


class _nothing:
    def __enter__(self):
        return None

    def __exit__(self, *_):
        return None


def test_a_run_over_both_pipelines(spark, sf, tmp_path):
    tx, lb = batches(spark, sf, str(tmp_path / "t"), (0, 1)), batches(spark, sf, str(tmp_path / "l"), (0, 1, 2), landing.LABELS)
    house = Warehouse(str(tmp_path / "w"))
    with pytest.raises(RuntimeError, match="lacks tables"):
        run(spark, {"transactions": tx, "labels": lb}, house, "r0")
    house.create(spark)
    assert house.missing(spark) == [] and house.table(spark, "transactions").count() == 0
    with pytest.raises(ValueError, match="no such pipeline"):
        run(spark, {"other": tx}, house, "r0")
    # Labels come first; the limit is that of the run.
    assert run(spark, {"transactions": tx, "labels": lb}, house, "r1", limit=4) == {("labels", 0): "OK", ("labels", 1): "OK", ("labels", 2): "OK", ("transactions", 0): "OK"}
    assert run(spark, {"transactions": tx, "labels": lb}, house, "r2", limit=4) == {("transactions", 1): "OK"}
    assert run(spark, {"transactions": tx, "labels": lb}, house, "r3") == {}
    house.create(spark)  # what is there stays
    assert house.table(spark, "transactions").count() > 0 and set(house.table(spark, "batches").columns) == set(schemas.LEDGER.fieldNames())


def matches(glob, name):
    """A glob of single characters, ranges and ``?``."""
    at = 0
    while glob:
        if glob[0] == "[":
            ok, glob = glob[1] <= name[at] <= glob[3], glob[5:]
        else:
            ok, glob = glob[0] in ("?", name[at]), glob[1:]
        if not ok:
            return False
        at += 1
    return at == len(name)


def test_globs_of_names():
    rng = random.Random(1)
    for _ in range(300):
        low = rng.choice([0, rng.randrange(10**6), rng.randrange(10**15)])
        high = rng.choice([low, low + rng.randrange(10**4), low + rng.randrange(10**16), loading.LAST_ID])
        globs = zones.name_globs(low, high)
        for x in {low - 1, low, low + 1, (low + high) // 2, high - 1, high, high + 1, rng.randrange(10**17)}:
            if x >= 0:
                assert sum(matches(g, f"{x:020d}") for g in globs) == (low <= x <= high)
        assert len(globs) < 300


def test_open_ranges(spark):
    def ranges(loaded, most=256):
        rows = [("transactions", i, "success") for i in loaded] + [("labels", 7, "success"), ("transactions", 9, "failed")]
        return loading.open_ranges(spark.createDataFrame(rows, "pipeline string, batch_id long, status string"), "transactions", most)

    assert ranges([]) == [(0, loading.LAST_ID)]
    assert ranges([0, 1, 2, 4, 5, 5]) == [(3, 3), (6, loading.LAST_ID)]
    assert ranges([*range(8, 5000), 10**12]) == [(0, 7), (5000, 10**12 - 1), (10**12 + 1, loading.LAST_ID)]
    assert ranges([*range(4096)]) == [(4096, loading.LAST_ID)]
    rng = random.Random(3)
    loaded = set(rng.sample(range(20_000), 12_000))
    for most in (1, 7, 256, 100_000):
        got = ranges(loaded, most)
        assert len(got) <= most and all(a <= b for a, b in got) and all(x[1] < y[0] for x, y in zip(got, got[1:], strict=False))
        lacking = [i for i in range(20_100) if i not in loaded]
        assert all(any(a <= i <= b for a, b in got) for i in lacking)
        if most == 100_000:
            assert not any(a <= i <= b for a, b in got for i in loaded)


def test_only_newer_batches_and_gaps_are_listed(spark, tmp_path, monkeypatch):
    zone, house = str(tmp_path / "q"), Warehouse(str(tmp_path / "w"))
    there = [*range(99_950, 100_020), 10**12, 10**12 + 1, 17, 18]
    for i in there:
        Path(zones.batch_path(zone, i)).mkdir(parents=True)
        if i not in (18, 100_005):  # not complete yet
            Path(zones.batch_path(zone, i), "_SUCCESS").touch()
    Path(zone, "batch_id=12").mkdir()
    Path(zone, "other").touch()
    ledger = spark.range(100_000).where("id not in (17, 18, 99990)").selectExpr("'transactions' pipeline", "id batch_id", "'success' status", "'' source_prefix", "'' run_id", "current_timestamp() finished_at", "'' error_message")
    ledger.write.parquet(house.path("ledger"))
    probed, exists = [], zones.exists
    monkeypatch.setattr(zones, "exists", lambda s, p: probed.append(p) or exists(s, p))
    ranges = loading.open_ranges(house.ledger(spark), "transactions")
    found = {r["batch_id"] for r in zones.completed_batches(spark, zone, "transactions", ranges).collect()}
    want = {17, 99_990, *range(100_000, 100_020), 10**12, 10**12 + 1} - {100_005}
    assert found == want and sum("_SUCCESS" in p for p in probed) == len(want) + 2  # the two that are not complete
    assert {r["batch_id"] for r in zones.completed_batches(spark, zone, "transactions").collect()} == set(there) - {18, 100_005}
    assert zones.completed_batches(spark, str(tmp_path / "none"), "transactions").isEmpty()


def test_a_lost_checkpoint_overwrites_nothing(spark, sf, tmp_path):
    root, house = str(tmp_path / "z"), Warehouse(str(tmp_path / "w"))
    fixtures.raw_messages(spark, sf).repartition(2).write.parquet(f"{root}/raw")
    land = lambda: start_landing(zones.raw_stream(spark, f"{root}/raw"), CATALOG, landing.TRANSACTIONS, Zones(root), f"{root}/state", None).awaitTermination()
    files = lambda: {p: p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet") if "raw" not in p.parts}
    land()
    first = files()
    assert set(load(spark, "transactions", Zones(root), house, "r1")) == {0, 1}
    rows = spark.read.parquet(house.path("transactions")).count()
    land()
    assert files() == first  # the same generation, nothing new
    shutil.rmtree(f"{root}/state")
    land()
    later = files()
    assert {p: later[p] for p in first} == first and len(later) == 2 * len(first)
    span = zones.GENERATION_SPAN
    assert set(load(spark, "transactions", Zones(root), house, "r2")) == {span, span + 1}
    assert spark.read.parquet(house.path("transactions")).count() == 2 * rows
    # New messages of the second generation, which goes on where it was.
    fixtures.raw_messages(spark, sf).limit(50).coalesce(1).write.mode("append").parquet(f"{root}/raw")
    land()
    assert set(load(spark, "transactions", Zones(root), house, "r3")) == {span + 2}
    manifest = spark.read.schema(schemas.MANIFEST).option("recursiveFileLookup", True).parquet(f"{root}/quality")
    assert {r[0] for r in manifest.select("batch_id").distinct().collect()} == {0, 1, span, span + 1, span + 2}


def test_generations_are_claimed_once(spark, tmp_path):
    root = str(tmp_path)
    assert [zones.claim_generation(spark, root, f"{root}/{c}") for c in "aabac"] == [0, 0, 1, 0, 2]
    Path(root, "old", "offsets").mkdir(parents=True)  # a checkpoint from before
    assert zones.claim_generation(spark, root, f"{root}/old") == 0
    Path(root, "other", "quality").mkdir(parents=True)  # zones from before, the checkpoint lost
    assert zones.claim_generation(spark, f"{root}/other", f"{root}/new") == 1
    assert not zones._create(spark, f"{root}/_generations/2", "") and zones._create(spark, f"{root}/_generations/3", "")
