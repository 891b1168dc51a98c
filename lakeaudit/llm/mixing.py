"""Operator 7: mixing sources to target weights by systematic sampling.

Every document of a source has the same number of expected copies, the source's target over its size. Documents are laid
out by (source, size, hash of the id, id, hash of the text, number of the row); the expected copies are prefix-summed within the source, one random offset is
added, and a document is emitted once for each whole number that its stretch of the sum crosses. As neighbours in this
order are alike in size, the words taken come near the target. All sums are exact (multiples of 2**-32), so that neither
partitioning nor a rerun changes them.

The prefix sums are distributed: rows are range-partitioned, so that a hot source lies in many partitions; the sums of the
partitions (one row for each partition and source) are accumulated, and the rest is a window within a partition.

Null text: size 0. Null source: a source of its own, last in order. A source of size 0 has target 0 and no copies. Repeated
rows are separate documents with copies of their own; the number of the row parts them, so that they need not share a task, and as
they are alike it does not matter which of them a copy falls to. A null id is ordered by the hash of its text. Empty table: empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeaudit.llm.text import durable

UNIT = 1 << 32
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, most: float = MOST_COPIES) -> DataFrame:
    """sizes(source, weight, source_size) with the target of each source added.

    A source's target is its weight times a level common to all, or ``most`` times its size if that is less; the level is
    such that the targets share the total of all sizes. Sources are few (one row each), so one window orders them all by the
    level at which they stop.
    """
    by_stop = W.orderBy("stop", "source_order").rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy()
    out = sizes.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("stop", F.col("cap") / F.col("weight"))
    out = out.withColumns({
        "total": F.sum("source_size").over(every),
        "cap_before": F.sum("cap").over(by_stop) - F.col("cap"),
        "weight_left": F.sum("weight").over(every) - F.sum("weight").over(by_stop) + F.col("weight"),
    })
    # The level if this source and all that stop later are still open. It rises while the sources before do stop below it and
    # falls from there on.
    level = (F.col("total") - F.col("cap_before")) / F.col("weight_left")
    out = out.withColumn("level", F.max(level).over(every))
    return out.withColumn("target", F.when(F.col("stop") <= F.col("level"), F.col("cap")).otherwise(F.col("weight") * F.col("level")).cast("double"))


def systematic_copies(rows: DataFrame, group: str, expected: str, order: list[str], offset: Column) -> DataFrame:
    """rows with ``copies`` (long): how many whole numbers the stretch of each row crosses in the prefix sum of ``expected``
    (long, in units of 2**-32) within ``group`` by ``order``, moved by ``offset`` (long, 0 to 2**32 - 1, one for a group)."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    # The layout must stay as it is from here on: it is written, not found again.
    laid = durable(ranged.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}))
    part_sum = laid.groupBy(F.col(group).alias("g"), F.col("part").alias("p")).agg(F.sum(F.col(expected).cast("decimal(20,0)")).alias("s"))
    before = part_sum.withColumn("before", (F.sum("s").over(W.partitionBy("g").orderBy("p")) - F.col("s")).cast("decimal(38,0)")).drop("s")
    running = F.sum(F.col(expected).cast("decimal(20,0)")).over(W.partitionBy(group, "part").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow))
    out = laid.withColumn("upto", running.cast("decimal(38,0)"))
    out = out.join(before, F.col(group).eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
    last = F.col("upto") + F.col("before") + offset
    crossed = lambda x: F.floor(x / F.lit(UNIT).cast("decimal(11,0)"))
    copies = crossed(last) - crossed(last - F.col(expected))
    return out.withColumn("copies", copies.cast("long")).drop("part", "place", "upto", "g", "p", "before")


def mix_sources(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken), a row for each row of docs. Sources in code-point order, null
    last, have the weights in turn; the targets share the total size, and none is over ``most`` times its source's size."""
    # The texts are read once; what goes on is three small columns.
    slim = durable(docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), F.xxhash64(text_column).alias("hash"), word_count(F.col(text_column)).alias("size")))
    out = _copies(slim, weights, most, seed).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(F.col("id").alias(id_column), F.col("source").alias(source_column), "size", "source_size", "target", "copies", "taken")


def mixed_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """The rows of docs, each as often as ``mix_sources`` takes it. Rows of equal id, source and text hash share their copies out:
    the mix counts them, and the first by their columns come first."""
    held = F.struct(*docs.columns)
    slim = durable(docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), F.xxhash64(text_column).alias("hash"), word_count(F.col(text_column)).alias("size")))
    copies = _copies(slim, weights, most, seed).groupBy(F.col("id").alias("i"), F.col("source").alias("s"), F.col("hash").alias("h")).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    # Written, so that both sides of the join are shuffles as they are, and a key of very many rows is split among tasks at run time.
    copies = durable(copies.where("copies > 0"))
    rows = docs.select(held.alias("row"), F.col(id_column).alias("id"), F.col(source_column).alias("source"), F.xxhash64(text_column).alias("hash"))
    rows = rows.join(copies, F.col("id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("hash") == F.col("h")))
    # Most keys have one row and need no place among its like; the others are numbered by their columns, the same way in each run.
    ordered = [f"row.`{f.name}`" for f in docs.schema if not re.search("map<|variant", f.dataType.simpleString())]
    place = F.row_number().over(W.partitionBy("i", "s", "h").orderBy(*ordered))
    one = rows.where("rows = 1").withColumn("n", F.col("copies"))
    more = rows.where("rows > 1").withColumn("place", place).withColumn("n", F.floor(F.col("copies") * F.col("place") / F.col("rows")) - F.floor(F.col("copies") * (F.col("place") - 1) / F.col("rows"))).drop("place")
    every = one.unionByName(more).where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return every.select("row.*")


def _copies(slim: DataFrame, weights: tuple[int, ...], most: int, seed: str) -> DataFrame:
    """slim(id, source, size, ...), a written table, with source_size, target and copies."""
    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("source_order", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("source_order") - 1, F.lit(len(weights))) + 1).cast("int"))
    # A few numbers for each source, read for each of its rows: they are written once.
    table = durable(targets(ranked.withColumn("weight", turn), most).select(F.col("source").alias("of_source"), "source_order", "source_size", "target"))
    rows = slim.withColumn("row", F.monotonically_increasing_id()).join(table, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumns({"expected": F.round(ratio * float(UNIT)).cast("long"), "tie": F.md5(F.coalesce(F.col("id").cast("string"), F.concat(F.lit("text:"), F.col("hash").cast("string"))).cast("binary"))})
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("source"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("long")
    return systematic_copies(rows, "source_order", "expected", ["size", "tie", "id", "hash", "row"], drawn).drop("source_order", "expected", "tie", "row")
