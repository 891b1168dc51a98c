"""Plans and layouts of the warehouse and its marts."""

import re
import uuid

from pyspark.sql import functions as F

from lakeaudit.operators import canonical, training
from lakeaudit.plans.marts import Marts
from lakeaudit.plans.queries import CONTRACT, FIRST_MONTH, LAST_MONTH, MENDED_MONTH, Lake
from lakeaudit.sources import fixtures, zones


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_canonical_rows_are_limited_before_the_shuffle(spark, sf):
    lake = Lake(spark, sf)
    rows = canonical.committed_rows(lake.staged("transactions"), lake.committed(), "transactions")
    text = plan(canonical.canonical(rows, canonical.TRANSACTION_PAYLOAD))
    # Top down: the final limit, an exchange, the limit of each task.
    assert re.search(r"WindowGroupLimit.*Final[\s\S]*?Exchange hashpartitioning\(key_hash[\s\S]*?WindowGroupLimit.*Partial", text)
    old = canonical.ranked(rows, canonical.TRANSACTION_PAYLOAD).where("canonical_rank = 1").drop("canonical_rank")
    new = canonical.canonical(rows, canonical.TRANSACTION_PAYLOAD)
    assert new.select(*old.columns).exceptAll(old).isEmpty() and new.count() == old.count()


def test_a_key_of_a_million_replays(spark, tmp_path):
    n = 1_000_000
    rows = spark.range(0, n + 1000, 1, 16).selectExpr(
        "if(id < 1000000, 's', null) source", "if(id < 1000000, 'hot', concat('k', id div 2)) event_id", "'t' kafka_topic", "cast(id % 3 as int) kafka_partition", "id * 7919 % 1001001 kafka_offset",
        "1L minio_batch_id", "'f' minio_object", "timestamp_ntz'2026-01-01' loaded_at", "cast(id % 5 as int) is_fraud", "0 is_flagged_fraud",
    )
    out = canonical.canonical(rows, canonical.LABEL_PAYLOAD)
    out.write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    r = out.where("event_id = 'hot'").collect()
    assert len(r) == 1 and (r[0]["physical_row_count"], r[0]["payload_version_count"], r[0]["kafka_partition"]) == (n, 5, 0)
    assert r[0]["kafka_offset"] == rows.where("event_id = 'hot' and kafka_partition = 0").agg(F.min("kafka_offset")).first()[0]
    # Keys with a null part are keys like others.
    assert out.where("source is null").count() == 500 and out.where("source is null and physical_row_count = 2 and payload_version_count = 2 and replay_row_count = 1 and has_payload_conflict").count() == 500


def test_whole_rows_are_shuffled_once(spark, sf, tmp_path):
    lake = Lake(spark, sf)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        labels = zones.materialized(lake.labels(), str(tmp_path / "labels"))
        out = training.labeled_facts(lake.committed_rows("transactions"), None, labels)
        # The rows themselves, their counts and their labels come to one place; nothing that is there is dealt out anew.
        assert len(re.findall(r"Exchange hashpartitioning\(key_hash#\d+, key#\d+, \d+\)", plan(out))) == 3 and "Exchange hashpartitioning(key_hash#" in plan(out)
        assert "cast(key#" not in plan(out) and "coalesce(source" not in plan(out)
        old = training.labeled(lake.transactions(), lake.labels())
        assert out.select(*old.columns).exceptAll(old).isEmpty() and out.count() == old.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_dealt_rows_are_shuffled_while_they_are_narrow(spark, sf):
    lake = Lake(spark, sf)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "290k")
    try:
        text = plan(Lake(spark, sf.replace("sf0.001", "sf0.01")).labeled())
        # Lineitem for the facts and for the labels, and the orders that are joined; facts, counts and labels stay where they are.
        assert len(re.findall(r"Exchange hashpartitioning\((?:l_orderkey|order_key)#\d+L?, \d+\), REPARTITION_BY_COL", text)) == 2
        assert "SortMergeJoin [l_orderkey" in text and len(re.findall("Exchange hashpartitioning", text)) == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    out, old = lake.labeled(), training.labeled_facts(lake.committed_rows("transactions"), None, canonical.label_facts(lake.committed_rows("labels"), None))
    assert sorted(out.columns) == sorted(old.columns) and out.select(*old.columns).exceptAll(old).isEmpty() and out.count() == old.count()


def test_canonical_in_place_equals_canonical(spark):
    rows = spark.range(4000).selectExpr(
        "id % 40 deal", "if(id % 40 = 3, null, 's') source", "if(id % 40 = 4, null, concat('k', id % 40, '-', id % 80)) event_id", "'t' kafka_topic", "cast(id % 3 as int) kafka_partition", "id * 7919 % 4001 kafka_offset",
        "1L minio_batch_id", "'f' minio_object", "timestamp_ntz'2026-01-01' loaded_at", "if(id % 11 = 5, null, cast(id % 5 as int)) is_fraud", "0 is_flagged_fraud",
    )
    labels = rows.groupBy("deal", *canonical.KEY).agg(F.max("kafka_offset").alias("label")).where("deal % 2 = 0 or deal = 3")
    old = canonical.canonical(rows.drop("deal"), canonical.LABEL_PAYLOAD, labels.drop("deal"))
    new = canonical.canonical(rows, canonical.LABEL_PAYLOAD, labels, "deal")
    assert new.columns[0] == "deal" and set(new.columns[1:]) == set(old.columns)
    assert new.select(*old.columns).exceptAll(old).isEmpty() and new.count() == old.count() == 80 - 1
    assert new.where("label is not null").count() == old.where("label is not null").count() > 0


def test_labels_of_keys_with_null_parts_are_not_joined(spark):
    rows = spark.sql("select cast(null as string) source, 'a' event_id, 't' kafka_topic, 0 kafka_partition, 1L kafka_offset, 1L minio_batch_id, 'f' minio_object, timestamp_ntz'2026-01-01' loaded_at, 1 is_fraud, 0 is_flagged_fraud union all select 's', 'a', 't', 0, 2L, 1L, 'f', timestamp_ntz'2026-01-01', 0, 0")
    labels = spark.sql("select cast(null as string) source, 'a' event_id, 7 label union all select 's', 'a', 8")
    out = canonical.canonical(rows, canonical.LABEL_PAYLOAD, labels)
    assert {(r["source"], r["label"]) for r in out.collect()} == {(None, None), ("s", 8)}


def test_batches_by_bits(spark):
    ids = [0, 1, 62, 63, 64, 65, 127, 128, -1, -63, -64, -65, 1 << 40, None]
    committed = spark.createDataFrame([("labels", i) for i in ids[::2]] + [("labels", 0), ("other", 1)], "pipeline string, batch_id long")
    rows = spark.createDataFrame([(i,) for i in ids], "minio_batch_id long")
    got = canonical.rows_of_batches(rows, canonical.batch_bits(committed, "labels"))
    want = canonical.committed_rows(rows, committed, "labels")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == sorted((i,) for i in ids[::2])


def test_spark_form_of_the_transactions_equals_its_sql(spark, sf):
    used = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("lineitem", "orders", "customer", "supplier")}
    text = spark.sql(fixtures.TRANSACTIONS.replace("{ts}", "timestamp_ntz"), **used)
    form = fixtures.spark(spark, sf, fixtures.TRANSACTIONS)
    assert form.schema.simpleString() == text.schema.simpleString() and form.count() == text.count() and form.exceptAll(text).isEmpty()


def test_marts_are_built_once(spark, sf, tmp_path):
    lake = Lake(spark, sf)
    marts = Marts(lake, str(tmp_path))
    report = {(r["model"], r["name"]): r["value"] for r in marts.report(CONTRACT).collect()}
    assert marts.built == ["committed_batches", "fct_transactions", "fct_transaction_labels", "ml_training_candidates"] == [marts.built[i] for i in range(4)]
    # What follows reads the tables of the build, and the source tables no more.
    for rows in (marts.transactions, marts.labels, marts.candidates, marts.training, marts.exclusions, marts.violations(CONTRACT)):
        assert all(f.startswith(f"file://{tmp_path}/") for f in rows.inputFiles())
    assert len(marts.built) == 4
    assert report[("ml_training_candidates", "rows")] == sum(v for (m, _), v in report.items() if m == "ml_training_exclusion_summary") == lake.candidates().count()
    assert report[("contract", "missing_lineage_count")] == 0 and report[("contract", "row_count")] == report[("ml_training_exclusion_summary", "eligible")]


def test_buckets_are_joined_without_an_exchange(spark, sf, tmp_path):
    lake, name = Lake(spark, sf), f"t{uuid.uuid4().hex}"
    facts = zones.write_bucketed(lake.transactions(), f"{name}_f", f"{tmp_path}/f", canonical.KEY, 8)
    labels = zones.write_bucketed(lake.labels(), f"{name}_l", f"{tmp_path}/l", canonical.KEY, 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = training.labeled(facts, labels)
        rows = joined.count()
        assert "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined)
        assert rows == training.labeled(lake.transactions(), lake.labels()).count()
        grouped = facts.groupBy(*canonical.KEY).count()
        assert "Exchange" not in plan(grouped)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for x in "fl":
            spark.sql(f"drop table {name}_{x}")


def test_replays_in_buckets_are_ranked_without_an_exchange(spark, sf, tmp_path):
    name = f"t{uuid.uuid4().hex}"
    rows = zones.write_bucketed(fixtures.spark(spark, sf, fixtures.LABELS), name, f"{tmp_path}/r", canonical.KEY, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        facts = canonical.canonical(rows, canonical.LABEL_PAYLOAD)
        assert "Exchange hashpartitioning(key_hash" not in plan(canonical.with_hash(rows, canonical.LABEL_PAYLOAD).groupBy(*canonical.KEY).count())
        assert facts.count() == rows.select(*canonical.KEY).distinct().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"drop table {name}")


def test_months_are_overwritten_and_pruned(spark, sf, tmp_path):
    rows, path = Lake(spark, sf).staged("transactions"), str(tmp_path / "m")
    zones.append_monthly(rows, path)
    month = rows.where(F.date_format("event_time", "yyyyMM") == MENDED_MONTH)
    others = rows.count() - month.count()
    assert month.count() > 5
    zones.overwrite_months(month.limit(3), path)
    assert spark.read.parquet(path).count() == others + 3
    read = zones.read_months(spark, path, FIRST_MONTH, LAST_MONTH)
    assert re.search(r"PartitionFilters: \[[^\]]*event_month", plan(read)) and {r[0] for r in read.select("event_month").distinct().collect()} == {FIRST_MONTH, MENDED_MONTH, LAST_MONTH}
    files = read.where(F.col("event_month") == MENDED_MONTH).select(F.input_file_name()).distinct().collect()
    assert len(files) == 1  # a small month is one file


def test_buckets_are_written_small(spark, tmp_path):
    name = f"t{uuid.uuid4().hex}"
    rows = zones.write_bucketed(spark.sql("select 's' source, cast(id as string) event_id from range(10)"), name, f"{tmp_path}/z", canonical.KEY, 2)
    try:
        assert rows.count() == 10 and all(f.endswith(".zstd.parquet") for f in rows.inputFiles())
    finally:
        spark.sql(f"drop table {name}")
