"""A log read by offsets: what a batch takes, restarts, and losses."""

import shutil

import pytest
from pyspark.sql import functions as F

from lakeaudit.sources import offsets


def messages(spark, first, last):
    """Two partitions of topic a/b c, partition 1 with gaps, offsets first to last; the key tells the offset."""
    rows = spark.range(first, last).selectExpr("id offset", "cast(id % 7 = 0 as int) partition")
    return rows.selectExpr("cast(offset as string) k", "offset", "partition").select(
        F.col("k").cast("binary").alias("key"), F.when(F.col("offset") % 5 != 0, F.concat(F.lit("v"), "k").cast("binary")).alias("value"), F.lit("a/b c").alias("topic"),
        "partition", "offset", (F.timestamp_seconds(F.col("offset")) + F.expr("interval 5 microseconds")).alias("timestamp"), F.lit(1).alias("piece"))


def drain(spark, root, state, seen, most=100):
    """Take what is there; ``seen`` gets the rows of each batch."""
    write = lambda batch, number: seen.update({number: seen.get(number, []) + batch.collect()})
    query = offsets.log_stream(spark, root, most).writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_batches_restart_and_second_append(spark, tmp_path):
    root, state, seen = f"{tmp_path}/log", f"{tmp_path}/state", {}
    offsets.append_log(messages(spark, 0, 250), root, 0, 40)
    offsets.append_log(messages(spark, 0, 250), root, 0, 40)  # the same append again
    drain(spark, root, state, seen)
    batches = len(seen)
    offsets.append_log(messages(spark, 250, 300), root, 1, 40)
    drain(spark, root, state, seen)
    rows = [r for b in seen.values() for r in b]
    assert len(seen) > batches > 3 and all(len(b) <= 100 for b in seen.values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, messages(spark, 0, 300).drop("piece").collect()))
    for b in seen.values():
        spans = [[r["offset"] for r in b if r["partition"] == p] for p in (0, 1)]
        assert sum(max(s) - min(s) + 1 for s in spans if s) <= 100


def test_a_removed_piece_fails_the_query(spark, tmp_path):
    root, state, seen = f"{tmp_path}/log", f"{tmp_path}/state", {}
    offsets.append_log(messages(spark, 0, 200), root, 0, 50)
    drain(spark, root, state, seen, 1000)
    offsets.append_log(messages(spark, 200, 300), root, 1, 50)
    shutil.rmtree(sorted(tmp_path.glob("log/data/append=*1/piece=*"))[0])
    with pytest.raises(Exception, match="data loss"):
        drain(spark, root, state, seen, 1000)
    assert len(seen) == 1


def test_a_piece_that_lost_a_file_is_found(spark, tmp_path):
    offsets.append_log(messages(spark, 0, 100), str(tmp_path), 0)
    reader = offsets.LogReader(str(tmp_path), 1000)
    piece = reader.partitions(reader.initialOffset(), reader.latestOffset())[0]
    assert sum(b.num_rows for b in reader.read(piece)) == piece.rows
    next((tmp_path / piece.path.removeprefix(f"{tmp_path}/")).glob("*.parquet")).unlink()
    with pytest.raises(RuntimeError, match="data loss"):
        list(reader.read(piece))


def test_ranges_that_are_gone(spark, tmp_path):
    for n in range(3):
        offsets.append_log(messages(spark, 100 * n, 100 * n + 100), str(tmp_path), n)
    whole = offsets.LogReader(str(tmp_path), 1000).latestOffset()
    assert whole == {"a/b c/0": 300, "a/b c/1": 295}
    first = {"a/b c/0": 100, "a/b c/1": 99}
    (tmp_path / "index/append=00000000000000000000").rename(tmp_path / "first")
    # What was read already may go; what was not is a loss, in the middle and at the end too.
    assert sum(p.rows for p in offsets.LogReader(str(tmp_path), 1000).partitions(first, whole)) == 200
    with pytest.raises(RuntimeError, match="data loss"):
        offsets.LogReader(str(tmp_path), 1000).partitions({k: v - 1 for k, v in first.items()}, whole)
    (tmp_path / "first").rename(tmp_path / "index/append=00000000000000000000")
    (tmp_path / "index/append=00000000000000000001").rename(tmp_path / "second")
    with pytest.raises(RuntimeError, match="data loss"):
        offsets.LogReader(str(tmp_path), 1000).partitions(first, whole)
    reader = offsets.LogReader(str(tmp_path), 1000)
    reader.position = {"a/b c/0": 400}
    with pytest.raises(RuntimeError, match="data loss"):
        reader.latestOffset()


def test_what_an_append_refuses(spark, tmp_path):
    root = str(tmp_path)
    offsets.append_log(messages(spark, 50, 100), root, 0)
    for bad, said in ((messages(spark, 99, 120), "below the end"), (messages(spark, 100, 120).withColumn("partition", F.lit(None).cast("int")), "lacks")):
        with pytest.raises(Exception, match=said):
            offsets.append_log(bad, root, 1)
    offsets.append_log(messages(spark, 100, 100), root, 1)  # empty
    assert offsets.LogReader(root, 1000).latestOffset() == {"a/b c/0": 100, "a/b c/1": 99}
    assert offsets.LogReader(f"{root}/none", 10).latestOffset() == {} == offsets.LogReader(f"{root}/none", 10).initialOffset()


def test_shares():
    assert offsets.shares({"a": 3, "b": 4}, 10) == {"a": 3, "b": 4}
    for backlog, most in (({"a": 1000, "b": 1, "c": 0}, 100), ({"a": 5, "b": 5, "c": 5}, 7), ({"a": 10**12, "b": 1}, 1)):
        out = offsets.shares(backlog, most)
        assert sum(out.values()) == most and all(0 <= out[k] <= n for k, n in backlog.items())
